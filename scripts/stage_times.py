"""Stage durations from a Spark event-log folder (written to a scratch folder,
e.g. ``BENCH_EVENT_LOG=/tmp/run-x python bench.py``).

usage: python scripts/stage_times.py <event-log-dir> [min_seconds]
"""

from __future__ import annotations

import glob
import io
import json
import sys


def events(folder: str):
    for path in sorted(glob.glob(f"{folder}/**/events_*", recursive=True)) + \
            sorted(glob.glob(f"{folder}/*.inprogress")) + sorted(glob.glob(f"{folder}/local-*")):
        raw = open(path, "rb")
        if path.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(raw)
        for line in io.TextIOWrapper(raw, encoding="utf-8"):
            yield json.loads(line)


def main() -> None:
    folder = sys.argv[1]
    floor = float(sys.argv[2]) if len(sys.argv) > 2 else 0.3
    stages = []
    for e in events(folder):
        if e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            ops = [json.loads(r["Scope"])["name"] for r in si["RDD Info"] if r.get("Scope")]
            stages.append((si["Submission Time"], si["Completion Time"], si["Stage ID"], si["Number of Tasks"],
                           sorted(set(ops))[:6]))
    if not stages:
        print("no completed stages")
        return
    t0 = min(s[0] for s in stages)
    total = 0.0
    for start, end, sid, tasks, ops in sorted(stages):
        dur = (end - start) / 1000
        total += dur
        if dur >= floor:
            print(f"stage {sid:5d} at {(start - t0) / 1000:8.2f}s  {dur:6.2f}s  tasks={tasks:4d}  {', '.join(ops)}")
    print(f"{len(stages)} stages, {total:.1f} s of stage time")


if __name__ == "__main__":
    main()
