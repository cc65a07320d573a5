"""Rescans of rewritten inputs (S1) and the result that changes in one step."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from helpers import F1_FILES, write_channel
from replenix import constants as K
from replenix.sinks import snapshots as SN
from replenix.sinks import writers as WR
from replenix.sources.settings import read_settings
from replenix.streaming import folder_watch as FW
from replenix.streaming import scan as SC

ROWS = "channel string, sku string, n int"


def rows_of(spark, path, **how):
    return sorted(tuple(r) for r in SN.read(spark, path, **how).collect())


def scan(spark, root, tmp_dir, **how):
    q = SC.stream_scan(spark, root, f"{tmp_dir}/out", f"{tmp_dir}/ck", lambda: read_settings(spark, root), layout="channel_folders",
                       available_now=True, log_path=f"{tmp_dir}/log", archive_path=f"{tmp_dir}/archive", **how)
    q.awaitTermination()
    return {(r.channel, r.sku, r.region): r for r in SN.read(spark, f"{tmp_dir}/out").collect()}


def batches(tmp_dir):
    return sorted({os.path.basename(p) for p in glob.glob(f"{tmp_dir}/archive/channel=*/run_ts=*")})


def test_rewritten_file_changes_its_channel(spark, tmp_dir):
    root = f"{tmp_dir}/channels"
    for c in ("918", "919", "a b"):
        write_channel(root, c, F1_FILES)
    before = scan(spark, root, tmp_dir)
    assert {k[0] for k in before} == {"918", "919", "a b"} and batches(tmp_dir) == ["run_ts=batch_0"]
    write_channel(root, "918", {"stock.csv": F1_FILES["stock.csv"].replace(",0,10,5", ",0,500,500")})
    after = scan(spark, root, tmp_dir)
    assert before["918", "SKU001", K.SOUTH].on_hand == 10.0 and after["918", "SKU001", K.SOUTH].on_hand == 500.0
    assert {k: r for k, r in after.items() if k[0] != "918"} == {k: r for k, r in before.items() if k[0] != "918"}
    assert glob.glob(f"{tmp_dir}/archive/*/run_ts=batch_1") == [f"{tmp_dir}/archive/channel=918/run_ts=batch_1"]
    # nothing changed: a restart from the checkpoint repeats nothing
    known = SN.versions(spark, f"{tmp_dir}/out")
    assert scan(spark, root, tmp_dir) == after
    assert batches(tmp_dir) == ["run_ts=batch_0", "run_ts=batch_1"] and SN.versions(spark, f"{tmp_dir}/out") == known


def test_settings_new_and_removed_channels(spark, tmp_dir):
    root = f"{tmp_dir}/channels"
    write_channel(root, "918", F1_FILES)
    write_channel(root, ".hidden", F1_FILES)
    write_channel(root, "_own", F1_FILES)
    first = scan(spark, root, tmp_dir)
    assert {k[0] for k in first} == {"918"}
    write_channel(root, "919", F1_FILES)
    with open(f"{root}/channels_settings.json", "w") as fh:
        fh.write('{"channels": {"918": {"LeadTime": 7, "LogisticsTime": 3}}}')
    second = scan(spark, root, tmp_dir)  # the settings concern every channel
    assert {r.lead_time for k, r in second.items() if k[0] == "918"} == {7} and {k[0] for k in second} == {"918", "919"}
    os.remove(f"{root}/919/PO.csv")  # an incomplete channel waits, its rows stay
    assert scan(spark, root, tmp_dir) == second


def test_offsets_are_snapshots(tmp_dir):
    root = f"{tmp_dir}/in"
    write_channel(root, "c1", {"stock.csv": "x", "note.txt": "x", ".part.csv": "x"})
    write_channel(f"{root}/c1", "deep", {"stock.csv": "x"})
    made = FW.source()({"root": f"file:{root}", "layout": "channel_folders", "chunk": "2", "shared": "s.json"}).streamReader(None)
    start = made.latestOffset()
    assert list(start["channels"]) == ["c1"] and made.initialOffset() == {"channels": {}}
    assert [list(made.read(p)) for p in made.partitions(start, start)] == [[]]
    for c in ("c2", "c3", "c4"):
        write_channel(root, c, {"stock.csv": "y"})
    write_channel(root, "c1", {"stock.csv": "xx"})
    end = made.latestOffset()
    got = [[c for c, _ in made.read(p)] for p in made.partitions(start, end)]
    assert got == [["c1", "c2"], ["c3", "c4"]] == [[c for c, _ in made.read(p)] for p in made.partitions(start, end)]
    os.remove(f"{root}/c4/stock.csv")
    assert [r for p in made.partitions(end, made.latestOffset()) for r in made.read(p)] == [("c4", None)]
    end = made.latestOffset()
    with open(f"{root}/s.json", "w") as fh:
        fh.write("{}")
    assert [c for p in made.partitions(end, made.latestOffset()) for c, _ in made.read(p)] == ["c1", "c2", "c3"]
    landing = FW.source()({"root": root + "2", "layout": "landing"}).streamReader(None)
    assert landing.latestOffset() == {"channels": {}}
    write_channel(f"{root}2/stock", "channel=a%2Fb", {"part-0.csv": "x"})
    assert list(landing.latestOffset()["channels"]) == ["a/b"]


def test_commit_replaces_channels_in_one_step(spark, tmp_dir):
    t = f"{tmp_dir}/t"
    with pytest.raises(FileNotFoundError):
        SN.read(spark, t)
    one = spark.createDataFrame([("a/b", "x", 1), ("c d", "y", 2), ("007", "z", 3)], ROWS)
    assert SN.commit(one, t)
    assert rows_of(spark, t) == [("007", "z", 3), ("a/b", "x", 1), ("c d", "y", 2)]
    # a new result of one channel, none of another; the frame may read the table itself
    assert SN.commit(SN.read(spark, t).where("channel = 'a/b'").withColumn("n", F.lit(9)), t, ["a/b", "c d"])
    assert rows_of(spark, t) == [("007", "z", 3), ("a/b", "x", 9)]
    assert rows_of(spark, t, number=1) == [("007", "z", 3), ("a/b", "x", 1), ("c d", "y", 2)]
    assert rows_of(spark, t, channels=["007", "nix"]) == [("007", "z", 3)]
    assert SN.commit(one.limit(0), t, ["007", "a/b"]) and rows_of(spark, t) == []
    # rows of other channels than the named ones are not taken over
    assert SN.commit(one, t, ["007"]) and rows_of(spark, t) == [("007", "z", 3)]


def test_killed_write_leaves_the_old_rows(spark, tmp_dir, monkeypatch):
    t = f"{tmp_dir}/t"
    one = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], ROWS)
    SN.commit(one, t)
    two = spark.createDataFrame([("a", "x", 5)], ROWS)
    staged = SN.stage(two, t, ["a"])  # the rows are written, and then the writer dies
    assert staged.written == ["a"] and rows_of(spark, t) == [("a", "x", 1), ("b", "y", 2)]
    bad = two.withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        SN.commit(bad, t, ["a"])
    assert rows_of(spark, t) == [("a", "x", 1), ("b", "y", 2)]
    monkeypatch.setattr(SN.Folder, "create", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        SN.commit(two, t, ["a"])
    monkeypatch.undo()
    assert rows_of(spark, t) == [("a", "x", 1), ("b", "y", 2)]
    assert SN.commit(two, t, ["a"]) and rows_of(spark, t) == [("a", "x", 5), ("b", "y", 2)]
    # what died is in no manifest and goes with the versions that none reads any more
    assert SN.vacuum(spark, t, keep=2) == 3 and rows_of(spark, t, number=1) == [("a", "x", 1), ("b", "y", 2)]
    assert SN.vacuum(spark, t, keep=1) == 0 and SN.versions(spark, t) == [2]  # b still reads the first
    SN.commit(two.withColumn("channel", F.lit("b")), t, ["b"])
    assert SN.vacuum(spark, t, keep=1) == 1 and rows_of(spark, t) == [("a", "x", 5), ("b", "x", 5)]


def test_two_writers_and_replayed_batches(spark, tmp_dir):
    t = f"{tmp_dir}/t"
    frame = lambda c, n: spark.createDataFrame([(c, "x", n)], ROWS)
    # both start from the same manifest; the second is redone on the first's
    p, q = SN.stage(frame("a", 1), t, writer="w", batch=0), SN.stage(frame("b", 2), t, writer="v", batch=7)
    assert SN.publish(spark, t, p) and SN.publish(spark, t, q)
    assert rows_of(spark, t) == [("a", "x", 1), ("b", "x", 2)]
    folder = SN.Folder(spark, t)
    assert not folder.create("manifests/000000000002.json", "{}") and SN.manifest(spark, t).batches == {"w": 0, "v": 7}
    assert not [n for n in folder.names("manifests") if n.endswith(".tmp")]
    # a replayed or older batch changes nothing, before or after it is staged
    assert not SN.commit(frame("a", 8), t, writer="w", batch=0) and not SN.commit(frame("b", 8), t, writer="v", batch=6)
    late = SN.stage(frame("a", 9), t, writer="w", batch=1)
    assert SN.commit(frame("a", 3), t, writer="w", batch=1) and not SN.publish(spark, t, late)
    assert rows_of(spark, t) == [("a", "x", 3), ("b", "x", 2)] and SN.versions(spark, t) == [1, 2, 3]
    assert SN.commit(frame("a", 4), t, writer="new", batch=0)  # another query's batches count apart


def test_plain_folders_lose_nothing_when_a_write_fails(spark, tmp_dir):
    t = f"{tmp_dir}/p"
    one = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], ROWS)
    WR.write_decisions(one, t, ["a", "b"])
    with pytest.raises(Exception, match="lost"):
        WR.write_decisions(one.withColumn("n", F.raise_error(F.lit("lost")).cast("int")), t, ["a", "b"])
    assert sorted(r.n for r in spark.read.parquet(t).collect()) == [1, 2]
