"""Queries whose whole job their SQL doesn't cover, against plain Python on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from moderata.operators import relations as R
from moderata.operators import selection as S
from moderata.plans import registry
from moderata.sources.tables import view


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    orders = [(k, 1 + k % 60, "FOP"[k % 3], datetime.date(1998, 6, 1)) for k in range(1, 200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, f"name {k}") for k in range(1, 50)], "c_custkey long, c_name string").write.parquet(f"{folder}/customer.parquet")
    events = [(i, 40 + i % 20, "error", datetime.datetime(2024, 3, 1)) for i in range(60)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{folder}/events.parquet")
    return folder, orders


def test_every_manual_review_is_sent_to_every_member_of_staff(spark):
    reviews = spark.createDataFrame([(k, f"n{k}", None if k % 3 else "r" * 300, "x") for k in range(200)] + [(5, "n5", None, "x")], "review_id long, account_name string, reason string, x string")
    staff = spark.createDataFrame([(k, 2 + k % 3) for k in range(90)] + [(7, 3)], "account_id long, role_id int")
    got = R.manual_review_notices(reviews, staff, spread=8, members=20).collect()
    assert sorted((r["review_id"], r["account_id"]) for r in got) == sorted((r, a) for r in range(200) for a in range(90))
    assert len({r["notice_key"] for r in got}) == len(got)
    one = next(r for r in got if r["review_id"] == 6 and r["account_id"] == 4)
    assert one["recipient_type"] == "STAFF" and one["notice_key"] == "moderation:review:6:account:4" and one["payload"] == '{"review_id":6,"reason":"%s"}' % ("r" * 200) and one["message"].startswith("n6 ")
    assert {r["recipient_type"] for r in got if r["account_id"] % 3 == 0} == {"ADMIN"}
    counts = {r["review_id"]: r["n"] for r in R.deliveries_by_review(reviews, staff).collect()}
    assert counts == {r: 90 for r in range(200)}
    assert {(r["account_id"], r["n"], r["latest"]) for r in R.inbox(R.manual_review_notices(reviews, staff)).collect()} == {(a, 200, 199) for a in range(90)}
    none = staff.where("account_id < 0")
    assert R.manual_review_notices(reviews, none).count() == 0 and R.deliveries_by_review(reviews, none).count() == 0


def test_no_task_of_the_fan_out_holds_all_reviews_or_all_staff(spark):
    reviews = spark.range(3200).select(F.col("id").alias("review_id"), F.lit("a").alias("account_name"), F.lit("b").alias("reason"))
    staff = spark.range(100).select(F.col("id").alias("account_id"), F.lit(3).alias("role_id"))
    cells = R.manual_review_notices(reviews, staff, spread=32, members=10).groupBy(F.pmod(F.xxhash64("review_id"), F.lit(32)).alias("x"), F.pmod(F.xxhash64("account_id"), F.lit(10)).alias("y")).count()
    sizes = [r["count"] for r in cells.collect()]
    assert sum(sizes) == 320_000 and len(sizes) > 300 and max(sizes) < 6000


def test_validation_splits_and_counts_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "Pending"), (2, 0, "Pending"), (3, None, "no"), (4, 1, None), (5, 1, "Failed")], "review_id long, rating int, moderation_status string")
    good, bad, counts = S.quarantined(S.review_faults(rows), str(tmp_path / "a"))
    assert sorted(r["review_id"] for r in good.collect()) == [1, 5] and counts == {"rows": 5, "refused": 3}
    assert {r["review_id"]: r["faults"] for r in bad.collect()} == {2: "rating", 3: "rating,status", 4: "status"}
    good, bad, counts = S.quarantined(S.review_faults(rows.where("false")), str(tmp_path / "b"))
    assert good.count() == bad.count() == 0 and counts == {"rows": 0, "refused": 0}


def test_a_commit_rewrites_only_parts_with_changes_and_may_run_again(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "review_id long, comment string")
    changes = spark.createDataFrame([(3, "new"), (4, "t4"), (900, "none")], rows.schema)
    folder, schema = str(tmp_path), rows.schema
    S.snapshot(rows, "review_id", folder)
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("table/part=*/*.parquet")}
    before, change = files(), lambda old, new: S.updated_text(old, new, "review_id")
    want = {i: "new" if i == 3 else f"t{i}" for i in range(500)}
    for _ in range(2):
        S.commit(changes, "review_id", folder, schema, change, "one")
        assert {r["review_id"]: r["comment"] for r in S.committed(spark, folder, schema).collect()} == want
        assert 0 < len(before.keys() - files().keys()) <= 3
    # A commit that failed while its parts were put in place is finished by running it again.
    S.commit(spark.createDataFrame([(7, "later")], rows.schema), "review_id", folder, schema, change, "two")
    import shutil

    part = spark.range(1).selectExpr(f"pmod(xxhash64(7L), {S.SNAPSHOT_PARTS})").first()[0]
    shutil.rmtree(tmp_path / "table" / f"part={part}")
    S.commit(spark.createDataFrame([(7, "later")], rows.schema), "review_id", folder, schema, change, "two")
    assert {r["review_id"]: r["comment"] for r in S.committed(spark, folder, schema).collect()} == want | {7: "later"}


def test_every_account_with_a_name_gives_it(spark, tables):
    folder, orders = tables
    got = {r["review_id"]: r["account_name"] for r in registry.QUERIES["join_reviewer_name"](spark, folder).collect()}
    assert got == {k: f"name {a}" if a < 50 else "Customer" for k, a, *_ in orders}


def test_every_counter_comes_out_with_its_count(spark, tables):
    got = sorted((r["account_id"], r["n"]) for r in registry.QUERIES["upsert_violation_rows"](spark, tables[0]).collect())
    assert got == [(k, k % 300) for k in range(1, 50)] + [(k, 0) for k in range(50, 60)]


def test_a_steady_request_is_not_one_array(spark):
    rows = [(i, "hot", i // 2 * 7) for i in range(20_000)] + [(20_000 + i, None if i % 2 else "b", i * 170) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, request string, t long").withColumn("ts", F.timestamp_seconds("t"))
    out, anchor = R.reused_requests(df), {}
    want = {}
    for i, request, t in rows:
        if request not in anchor or t - anchor[request] > 300:
            anchor[request] = t
        want[i] = (request, anchor[request] * 1_000_000)
    assert {r["event_id"]: (r["request"], r["anchor"]) for r in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_pictures_are_read_back_as_they_were_written(spark, tmp_path):
    from moderata.sources import files

    pixels = bytes(range(0, 210, 2)) * 2
    rows = spark.createDataFrame([(1, 10, pixels.hex()), (2, 0, None), (3, 10, None), (10**15, 1, "00ff7f")], "file_id long, height int, pixels string")
    folder = f"file://{tmp_path}/pictures"
    for _ in range(2):  # again, as a task that failed would
        files.write_pictures(rows, folder)
    assert {r["file_id"]: r["length"] for r in files.read_files(spark, folder).collect()} == {1: 54 + 1024 + 240, 2: 13, 3: 13, 10**15: 54 + 1024 + 4}
    got = {r["file_id"]: r["image"] for r in files.read_pictures(spark, folder).collect()}
    assert got.keys() == {1, 10**15}
    image = got[1]
    assert (image["height"], image["width"]) == (10, 21) and bytes(image["data"])[:: image["nChannels"]] == pixels
