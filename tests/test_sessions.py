import random
import subprocess
import sys
import threading
from collections import Counter
from pathlib import Path

import pytest

from kinfold.operators.sessions import SessionTable, merge_intervals

SCHEMA = "key string, time long, extra string, start string"


def brute(events, gap):
    out, by = [], {}
    for k, t in events:
        if k is not None and t is not None:
            by.setdefault(k, []).append(t)
    for k, ts in by.items():
        run = None
        for t in sorted(ts):
            if run and t - run[1] <= gap:
                run[1], run[2] = t, run[2] + 1
            else:
                run = [t, t, 1]
                out.append((k, run))
    return Counter((k, *r) for k, r in out)


def rows(df):
    return Counter((r["key"], r["start"], r["end"], r["n"]) for r in df.collect())


def frame(spark, events):
    # columns that clash with the operator's own names don't matter
    return spark.createDataFrame([(k, t, "x", "y") for k, t in events], SCHEMA)


def test_batches_in_any_order_bridge_sessions(spark, scratch):
    rng = random.Random(1)
    events = [(rng.choice("aaab"), rng.randrange(0, 90_000) * 7 - 1000) for _ in range(400)] + [(None, 5), ("a", None), ("a", 70), ("a", 70)]
    table = SessionTable(spark, f"{scratch.path}/t", 1800, bucket_s=3600)
    rng.shuffle(events)
    for i in range(0, len(events), 150):
        table.apply(frame(spark, events[i : i + 150]))
    assert rows(table.read()) == brute(events, 1800)
    table.table.vacuum()
    assert rows(table.read()) == brute(events, 1800)


def test_gap_is_inclusive_and_a_late_event_joins_two_sessions(spark, scratch):
    table = SessionTable(spark, f"{scratch.path}/t", 100)
    table.apply(frame(spark, [("u", 0), ("u", 100), ("u", 300), ("v", 0)]))
    assert rows(table.read()) == Counter([("u", 0, 100, 2), ("u", 300, 300, 1), ("v", 0, 0, 1)])
    version = table.apply(frame(spark, [("u", 200)]), tag="7")
    assert rows(table.read()) == Counter([("u", 0, 300, 4), ("v", 0, 0, 1)])
    assert table.apply(frame(spark, [("u", 200)]), tag="7") == version
    assert table.apply(frame(spark, [])) == version


def test_empty(spark, scratch):
    table = SessionTable(spark, f"{scratch.path}/t", 100)
    assert table.apply(frame(spark, [])) == 0 and table.read().count() == 0


def test_merge_of_long_intervals(spark):
    df = spark.createDataFrame([("a", -50_000, 200_000, 9), ("a", 200_001, 200_001, 1), ("a", 200_010, 200_020, 2), ("b", 0, 0, 1)], "key string, start long, end long, n long")
    assert rows(merge_intervals(df, 5, (-50_000, 200_020))) == Counter([("a", -50_000, 200_001, 10), ("a", 200_010, 200_020, 2), ("b", 0, 0, 1)])
    with pytest.raises(ValueError):
        merge_intervals(df, 0, (0, 1))


def test_a_failed_commit_leaves_the_old_state(spark, scratch):
    table = SessionTable(spark, f"{scratch.path}/t", 100)
    table.apply(frame(spark, [("u", 0)]))
    with pytest.raises(RuntimeError):
        table.table._commit(1, {"parts": {}, "tag": None})
    assert rows(table.read()) == Counter([("u", 0, 0, 1)])


def test_of_two_writers_one_commits(spark, scratch):
    table = SessionTable(spark, f"{scratch.path}/t", 100)
    table.apply(frame(spark, [("u", 0)]))
    done = []

    def commit():
        try:
            table.table._commit(2, table.table.manifest()[1])
            done.append(True)
        except RuntimeError:
            done.append(False)

    writers = [threading.Thread(target=commit) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(done) == [False, False, False, True] and table.table.version == 2
    with pytest.raises(RuntimeError):
        table.table.replace(table.read().withColumn("part", table._part()), [], version=1)


def test_a_small_batch_replaces_few_parts(spark, scratch):
    day = 86400
    events = [(f"k{i}", i % 40 * day + j) for i in range(2000) for j in (0, 5000)]
    table = SessionTable(spark, f"{scratch.path}/t", 1800)
    table.apply(frame(spark, events))
    before = table.table.manifest()[1]["parts"]
    late = [(f"k{i}", 36 * day + 60) for i in range(36, 2000, 400)] + [(f"new{i}", 36 * day) for i in range(5)]
    table.apply(frame(spark, late))
    after = table.table.manifest()[1]["parts"]
    changed = {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
    assert len(before) >= 90 and 0 < len(changed) <= 10
    assert rows(table.read()) == brute(events + late, 1800)
    assert len(table.table.read(sorted(changed)).inputFiles()) < len(table.read().inputFiles()) / 4


def test_another_process_reads_the_table(spark, scratch, tmp_path):
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from kinfold.operators.sessions import SessionTable
from kinfold.session import local_session
spark = local_session(2, spark__checkpoint__dir="file://{tmp_path}/shared")
SessionTable(spark, "file://{tmp_path}/shared/kept", 100).apply(spark.createDataFrame([("u", 0), ("u", 50)], "key string, time long"))
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    kept = SessionTable(spark, f"file://{tmp_path}/shared/kept", 100)
    assert rows(kept.read()) == Counter([("u", 0, 50, 2)])
    assert (tmp_path / "shared" / "kept").exists() and not list((tmp_path / "shared").glob("kinfold-*"))
