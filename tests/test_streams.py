"""Streams over several micro-batches, late rows and batches that run again."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from moderata.streaming import jobs as J

DAY = 86_400


def fold(times, threshold, span):
    n, locks, until = 0, 0, None
    for t in times:
        over = until is not None and until <= t
        n = min((0 if over else n) + 1, 255)
        if n >= threshold:
            locks += until is None or over
            until = t + span
        elif over:
            until = None
    return n, locks, until


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize("late_hours", [24, 72])
def test_violations_in_any_order_within_the_lateness(spark, tmp_path, late_hours):
    r = random.Random(late_hours)
    rows = [(None if i % 61 == 0 else r.randrange(8), r.randrange(60 * DAY), i) for i in range(500)] + [(99, 3 * DAY, 1000 + k) for k in range(6)]
    # Each arrives up to the lateness after its time, in six files by arrival; every row of the last file is there twice.
    arrival = sorted(rows, key=lambda x: x[1] + r.random() * late_hours * 3600 * 0.95)
    size = -(-len(arrival) // 6)
    for k in range(6):
        part = arrival[k * size : (k + 1) * size]
        df = spark.createDataFrame(part + (part if k == 5 else []), "account_id long, t long, event_id long").withColumn("ts", F.timestamp_seconds("t"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "account_id long, t long, event_id long, ts timestamp"
    state = J.violation_state(4, 7, late_minutes=late_hours * 60)(stream(spark, str(tmp_path / "in"), schema))
    got = {x[0]: tuple(x)[1:] for x in J.drained(state, str(tmp_path / "out"), "update", "account_id", J.ROCKSDB).collect()}
    by, clock, want = defaultdict(list), max(x[1] for x in rows) - late_hours * 3600, {}
    for a, t, _ in rows:
        by[a].append(t)
    for a, times in by.items():
        n, locks, until = fold(sorted(times), 4, 7 * DAY)
        lifted = until is not None and until <= clock
        want[a] = (0 if lifted else n, locks, None if until is None or lifted else until * 1_000_000)
    assert got == want and want[99] == (0, 1, None)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    first = spark.createDataFrame([(1, 7, None), (2, 7, "spam"), (3, None, "x" * 600), (3, None, "x" * 600)], "review_id long, account_id long, reason string")
    second = spark.createDataFrame([(4, 8, "url")], first.schema)
    add = J.to_sinks(str(tmp_path))
    add(first, 0)
    add(second, 1)
    held = {name: sorted(map(str, J.sink(spark, str(tmp_path), name).collect())) for name in J.SINKS}
    assert [len(held[name]) for name in J.SINKS] == [5, 4, 3]
    # The second batch failed before its last sink, and both run again.
    import shutil

    shutil.rmtree(tmp_path / "notices" / "batch=1")
    add(second, 1)
    add(first, 0)
    assert {name: sorted(map(str, J.sink(spark, str(tmp_path), name).collect())) for name in J.SINKS} == held


def test_each_key_once_over_many_batches(spark, tmp_path):
    r, add, seen = random.Random(1), J.once_by_key(str(tmp_path), "notice_key"), {}
    batches = [[f"k{r.randrange(40)}" for _ in range(30)] for _ in range(5)]
    frame = lambda keys: spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "notice_key string, extra int")
    for b, keys in enumerate(batches):
        add(frame(keys), b)
        for k in keys:
            seen.setdefault(k, b)
        if b in (0, 3):
            add(frame(keys), b)  # again
    rows = spark.read.parquet(str(tmp_path / "told")).collect()
    assert {x["notice_key"]: x["batch"] for x in rows} == seen and len(rows) == len(seen)


def test_a_stream_without_rows(spark, tmp_path):
    schema = "account_id long, event_id long, ts timestamp"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    state = J.violation_state(4, 7)(stream(spark, str(tmp_path / "in"), schema))
    assert J.drained(state, str(tmp_path / "out"), "update", "account_id", J.ROCKSDB).count() == 0
