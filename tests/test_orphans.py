import datetime as dt
from pathlib import Path

import pytest

from kinfold.operators.orphans import faulty_references, target_states
from kinfold.plans import core_problems

FOLDER = Path("/root/testdata/sf0.001")


def day(month, d, hour=0):
    return dt.datetime(2016, month, d, hour)


def test_reasons(spark, scratch):
    targets = target_states(
        spark.createDataFrame(
            [("u", "t1", False, day(1, 1)), ("u", "t2", False, day(1, 1)), ("u", "t2", True, day(1, 5)), ("u", "t3", False, day(2, 10)), ("u", "t4", True, day(1, 1)), ("u", "t4", False, day(3, 1)), (None, "t5", False, day(1, 1)), ("u", "t6", None, None)],
            "user string, id string, gone boolean, at timestamp_ntz",
        ),
        "k", "user", "id", "gone", "at",
    )
    refs = [
        ("k", "u", "t1", day(1, 1), "same moment"), ("k", "u", "t2", day(2, 1), "dead"), ("k", "u", "t3", day(2, 9), "late in the month"), ("k", "u", "t3", day(2, 10), "in time"),
        ("k", "u", "t3", day(1, 9), "late by a month"), ("k", "u", "t4", day(4, 1), "alive again"), ("k", "u", "t9", day(1, 1), "absent"), ("k", "u", "t9", day(1, 1), "absent"), ("k", "v", "t1", day(1, 1), "other user"),
        ("k", None, "t1", day(1, 1), "null scope"), ("k", "u", None, day(1, 1), "null key"), ("k", "u", "t3", None, "no time"), ("j", "u", "t1", day(1, 1), "other kind"), ("k", "u", "t6", day(1, 1), "no arrival"),
    ]
    df = spark.createDataFrame(refs, "kind string, scope string, key string, at timestamp_ntz, code string")
    found = sorted((r["code"], r["reason"]) for r in faulty_references(df, targets, scratch).collect())
    assert found == sorted(
        [("dead", "deleted"), ("late in the month", "late"), ("late by a month", "late"), ("absent", "missing"), ("absent", "missing"), ("other user", "missing"), ("other kind", "missing")]
    )


def test_empty(spark, scratch):
    targets = target_states(spark.createDataFrame([], "user string, id string, gone boolean, at timestamp_ntz"), "k", "user", "id", "gone", "at")
    refs = spark.createDataFrame([], "kind string, scope string, key string, at timestamp_ntz")
    assert faulty_references(refs, targets, scratch).count() == 0


@pytest.mark.skipif(not FOLDER.exists(), reason="the test tables aren't there")
def test_p3_needs_no_broadcast(spark):
    expected = {tuple(r) for r in core_problems.p3_found(spark, str(FOLDER)).collect()}
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    try:
        for name in names:
            spark.conf.set(name, "-1")
        found = core_problems.p3_found(spark, str(FOLDER))
        assert {tuple(r) for r in found.collect()} == expected
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in names:
            spark.conf.unset(name)
