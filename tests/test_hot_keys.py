"""Folds and windows where one key has a third of all rows: equal to plain folds, and dealt over many tasks."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from moderata.operators import relations as R


@pytest.fixture
def dealt(spark):
    """Sixteen partitions that stay sixteen."""
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def fold(times, threshold, span, cap=255):
    n, locks, until = 0, 0, None
    for t in times:
        over = until is not None and until <= t
        n = min((0 if over else n) + 1, cap)
        if n >= threshold:
            locks += until is None or over
            until = t + span
        elif over:
            until = None
    return n, locks, until


def violations(spark, seed, n=6000, none_every=97):
    """A third for account 1, some with no account, no time, or the time of another."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        account = 1 if i % 3 == 0 else None if i % none_every == 0 else r.randrange(2, 60)
        t = None if i % 211 == 0 else r.choice([r.randrange(0, 400 * 86_400), 86_400 * r.randrange(400)])
        rows.append((account, t, i, "x"))
    df = spark.createDataFrame(rows, "account_id long, t long, event_id long, part string")
    by = defaultdict(list)
    for a, t, _, _ in rows:
        if t is not None:
            by[a].append(t)
    return df.withColumn("ts", F.timestamp_seconds("t")).repartition(7), {a: sorted(x) for a, x in by.items()}


@pytest.mark.parametrize(("threshold", "days", "cap"), [(1, 1, 255), (5, 7, 255), (20, 7, 20), (6, 1, 8), (9, 3, 5)])
def test_a_hot_account_is_folded_by_many_tasks(spark, dealt, threshold, days, cap):
    df, by = violations(spark, threshold)
    got = {x[0]: tuple(x)[1:] for x in R.lockouts(df, threshold, days, cap).collect()}
    want = {a: fold(x, threshold, days * 86_400, cap) for a, x in by.items()}
    assert got == {a: (n, locks, until and until * 1_000_000) for a, (n, locks, until) in want.items()}
    if threshold <= cap:
        sizes = Counter()
        for x in R.lockout_slices(df, threshold, days, cap).where("account_id = 1").collect():
            sizes[x["part"]] += x["size"]
        assert sum(sizes.values()) == len(by[1]) and len(sizes) >= 5 and max(sizes.values()) <= sum(map(len, by.values())) / 8


def test_no_violations(spark):
    df = spark.createDataFrame([], "account_id long, ts timestamp, event_id long")
    assert R.lockouts(df, 5, 7).count() == 0 and R.lockouts(df, 5, 7, 3).count() == 0


def test_trailing_rejects_of_a_hot_account(spark):
    r = random.Random(4)
    rows = []
    for i in range(4000):
        account = 1 if i % 3 == 0 else None if i % 50 == 0 else r.randrange(40)
        rows.append((i, account, r.choice(["Rejected", "Approved", None]), i % 17 == 0, None if i % 101 == 0 else 86_400 * r.randrange(120) + r.randrange(86_400)))
    df = spark.createDataFrame(rows, "review_id long, account_id long, moderation_status string, is_deleted boolean, t long").withColumn("created_at", F.timestamp_seconds("t"))
    by = defaultdict(Counter)
    for _, a, status, gone, t in rows:
        if not gone and t is not None:
            by[a][t // 86_400] += status == "Rejected"
    want = {i: None if t is None else sum(by[a][t // 86_400 - k] for k in range(31)) for i, a, _, gone, t in rows if not gone}
    found = R.trailing_rejects(df)
    assert {x["review_id"]: x["trailing"] for x in found.collect()} == want
    # What is summed in order are days, not reviews.
    assert found.where("false").count() == 0 and "Window" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("spread", [60, 4_000, 400_000, 40_000_000])
def test_a_hot_request_is_followed_through_many_tasks(spark, dealt, spread):
    """From all times within one span to one time in a span; the pointers cross up to sixteen slices."""
    r = random.Random(spread)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"r{r.randrange(30)}", r.randrange(spread) if i % 90 else None) for i in range(5000)]
    rows += [(5000 + i, "hot", rows[3 * i + 3][2]) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, request string, t long").withColumn("ts", F.timestamp_seconds("t")).repartition(5)
    want, anchor = {}, {}
    for i, request, t in sorted(rows, key=lambda x: (x[2] is not None, x[2])):
        if t is None:
            want[i] = None
            continue
        if request not in anchor or t - anchor[request] > 300:
            anchor[request] = t
        want[i] = anchor[request] * 1_000_000
    assert {x["event_id"]: x["anchor"] for x in R.reused_requests(df).collect()} == want
    times = df.where("t is not null").select(F.col("request").alias("own"), F.col("t").alias("time")).distinct()
    ordered = times.repartitionByRange("own", "time").sortWithinPartitions("own", "time").mapInArrow(R._walked(300), "own string, time bigint, anchor bigint, exit bigint, part bigint, opens boolean")
    sizes = [x["count"] for x in ordered.where("own = 'hot'").groupBy("part").count().collect()]
    assert spread == 60 or len(sizes) >= 4 and max(sizes) <= times.count() / 8


def test_no_requests(spark):
    assert R.reused_requests(spark.createDataFrame([], "event_id long, request string, ts timestamp")).count() == 0
