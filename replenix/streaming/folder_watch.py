"""A stream of the channels whose input files changed.

A file source sees new paths only; the inputs here are rewritten in place.  This source's
offsets are snapshots: for every channel a fingerprint of the (path, modification time,
length) of its files.  A micro-batch holds the channels whose fingerprints differ between
its two offsets, so a rewritten, added or removed file makes its channel come again, a
replayed batch holds the same channels, and a restart repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAME = "channel_files"
#: channels that one task hands on
CHUNK = 1000


def source() -> type:
    """The data source class.  It is defined here, inside, so that it is sent to Spark's
    Python workers whole and they need no copy of this package."""
    from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

    class Channels(InputPartition):
        def __init__(self, rows: list[tuple[str, str]]):
            self.rows = rows

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.root, self.layout = options["root"], options.get("layout", "landing")
            self.shared, self.chunk = [s for s in options.get("shared", "").split(",") if s], int(options.get("chunk", "1000"))

        def snapshot(self) -> dict[str, str]:
            """Fingerprints by channel, from one recursive listing."""
            import hashlib
            from urllib.parse import unquote

            from pyarrow import fs

            root = self.root
            for short in ("file:///", "file:/"):
                if root.startswith(short):
                    root = "/" + root[len(short):]
                    break
            where, path = fs.FileSystem.from_uri(root)
            path = path.rstrip("/")
            files: dict[str, list[str]] = {}
            common = []
            for f in where.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
                if f.type != fs.FileType.File:
                    continue
                parts = f.path[len(path) + 1:].split("/")
                line = "\t".join((*parts, str(f.mtime_ns), str(f.size)))
                if len(parts) == 1 and parts[0] in self.shared:
                    common.append(line)
                if any(p.startswith((".", "_")) for p in parts) or not parts[-1].endswith(".csv"):
                    continue
                if self.layout == "landing":
                    channel = next((unquote(p[len("channel="):]) for p in parts[:-1] if p.startswith("channel=")), None)
                else:
                    channel = parts[0] if len(parts) == 2 else None
                if channel:
                    files.setdefault(channel, []).append(line)
            return {c: hashlib.blake2b("\n".join(sorted(common) + sorted(lines)).encode(), digest_size=8).hexdigest() for c, lines in sorted(files.items())}

        def initialOffset(self) -> dict:
            return {"channels": {}}

        def latestOffset(self) -> dict:
            return {"channels": self.snapshot()}

        def partitions(self, start: dict, end: dict) -> list:
            before, after = start["channels"], end["channels"]
            rows = [(c, after.get(c)) for c in sorted(before.keys() | after.keys()) if before.get(c) != after.get(c)]
            return [Channels(rows[i:i + self.chunk]) for i in range(0, len(rows), self.chunk)] or [Channels([])]

        def read(self, partition):
            yield from partition.rows

        def commit(self, end: dict) -> None:
            """Nothing is kept outside of the offsets."""

    class ChannelFiles(DataSource):
        @classmethod
        def name(cls) -> str:
            return "channel_files"

        def schema(self) -> str:
            return "channel string, fingerprint string"

        def streamReader(self, schema):
            return Reader(self.options)

    return ChannelFiles


def changed_channels(spark: SparkSession, root: str, layout: str = "landing", shared: tuple[str, ...] = ()) -> DataFrame:
    """Streaming (channel, fingerprint): the channels whose files changed; the fingerprint
    is null where none are left.  ``shared`` names files directly below the root (the
    settings) whose change concerns every channel.

    The root is listed by one process, as every file source's is; an offset holds about
    30 bytes a channel.  A rewrite that leaves length and modification time as they were
    goes unseen, and a file seen half written makes its channel come again."""
    spark.dataSource.register(source())
    return (spark.readStream.format(NAME).option("root", root).option("layout", layout)
            .option("shared", ",".join(shared)).option("chunk", str(CHUNK)).load())
