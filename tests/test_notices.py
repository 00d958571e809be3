"""Notices to staff: what is made for each pair, and what is counted without the pairs."""

from pyspark.sql import functions as F

from moderata.operators import relations as R
from moderata.plans import registry

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_a_notice_are_made_once_for_a_review_not_for_each_pair(spark):
    reviews = spark.range(50).select(F.col("id").alias("review_id"), F.lit("a").alias("account_name"), F.lit("b").alias("reason"))
    staff = spark.range(20).select(F.col("id").alias("account_id"), F.lit(3).alias("role_id"))
    above = _plan(R.manual_review_notices(reviews, staff)).split("Join")[0]
    assert "to_json" not in above and "format_string" not in above


def test_deliveries_are_counted_for_all_accounts_of_staff(spark):
    accounts = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").toPandas()["c_custkey"]
    members = sum(1 for k in accounts if 1 + k % 3 in (2, 3) and k % 10 and k % 23)
    assert {r["n"] for r in registry.QUERIES["notification_delivery_count"](spark, SF).collect()} == {members}


def test_an_inbox_is_counted_without_its_deliveries(spark):
    assert "Generate" not in _plan(registry.QUERIES["notice_inbox"](spark, SF))
    reviews = spark.createDataFrame([(1,), (5,), (5,), (3,)], "review_id long")
    staff = spark.createDataFrame([(7, 3), (8, 2), (7, 3)], "account_id long, role_id int")
    assert sorted(tuple(r) for r in R.deliveries_by_account(reviews, staff).collect()) == [(7, 3, 5), (8, 3, 5)]
    assert R.deliveries_by_account(reviews.where("review_id < 0"), staff).count() == 0


def test_notices_of_a_review_come_in_the_order_of_the_accounts(spark):
    reviews = spark.range(20).select(F.col("id").alias("review_id"), F.lit("a").alias("account_name"), F.lit("b").alias("reason"))
    staff = spark.range(300).select((F.col("id") * 7919 % 1000).alias("account_id"), F.lit(3).alias("role_id")).repartition(8)
    got = {}
    for r in R.manual_review_notices(reviews, staff, spread=4).collect():
        got.setdefault(r["review_id"], []).append(r["account_id"])
    assert got == {k: sorted(i * 7919 % 1000 for i in range(300)) for k in range(20)}
