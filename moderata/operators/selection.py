"""Work selection: predicates, claims, validation and snapshot updates. Every clock is the `as_of` argument."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from moderata.config import DECISIONS, DEFAULT, STATUS_OF, STATUSES, Settings


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def active(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_deleted"))


def pending(df: DataFrame) -> DataFrame:
    return active(df).where(F.col("moderation_status") == "Pending")


def retry_due(df: DataFrame, as_of: str, s: Settings = DEFAULT) -> DataFrame:
    """Rows that were never retried, or at least retry_minutes ago."""
    return df.where(F.col("last_retry_at").isNull() | (F.col("last_retry_at") <= at(as_of) - F.expr(f"interval {s.retry_minutes} minutes")))


def deadline_expired(df: DataFrame, as_of: str) -> DataFrame:
    return active(df).where((F.col("moderation_status") == "ManualReview") & (F.col("manual_review_deadline") <= at(as_of)))


def expired_targets(comments: DataFrame, as_of: str) -> DataFrame:
    """(target_type, target_id, overdue_minutes): comments and replies whose review by a person is overdue."""
    late = deadline_expired(comments, as_of)
    overdue = F.floor((F.unix_micros(at(as_of)) - F.unix_micros(F.col("manual_review_deadline").cast("timestamp"))) / 60_000_000).alias("overdue_minutes")
    kinds = [late.where(F.col("target_type") == kind).select("target_type", "target_id", overdue) for kind in ("Comment", "Reply")]
    return kinds[0].unionByName(kinds[1])


def ban_expired(bans: DataFrame, as_of: str) -> DataFrame:
    return bans.where(F.col("is_banned") & (F.col("expires_at") <= at(as_of)))


def staff(accounts: DataFrame, roles: tuple[int, ...]) -> DataFrame:
    return active(accounts).where(F.col("role_id").isin(*roles) & F.col("is_active"))


def first_in_order(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows: a top-k per partition, then of those; no full sort."""
    return df.orderBy(*order).limit(n)


def claim_reviews(reviews: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The oldest pending reviews, as they are once claimed."""
    return first_in_order(pending(reviews), s.batch_size, "created_at", "review_id").withColumn("moderation_status", F.lit("Processing"))


def claim_comments(comments: DataFrame, as_of: str, s: Settings = DEFAULT) -> DataFrame:
    """Half a batch of comments and the rest of replies, of those that are due; each kind gets one at least."""
    due = retry_due(pending(comments), as_of, s)
    share = max(1, s.batch_size // 2)
    parts = [first_in_order(due.where(F.col("target_type") == kind), n, "created_at", "target_id") for kind, n in (("Comment", share), ("Reply", max(1, s.batch_size - share)))]
    return parts[0].unionByName(parts[1]).withColumn("moderation_status", F.lit("Processing"))


def claim_requested(rows: DataFrame, wanted: DataFrame, key: str, only_pending: bool) -> DataFrame:
    """The requested rows; comments only if they are pending and not deleted, reviews in any status."""
    rows = pending(rows) if only_pending else rows
    return rows.join(wanted.select(key).distinct(), key, "left_semi").withColumn("moderation_status", F.lit("Processing"))


def looked_up(rows: DataFrame, wanted: DataFrame, key: str, skip_deleted: bool) -> DataFrame:
    """The status of each requested key, null where there is none."""
    rows = active(rows) if skip_deleted else rows
    return wanted.join(rows.select(key, "moderation_status"), key, "left").select(key, "moderation_status")


def faults(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The rows with the names of the checks they fail, comma-joined; null values fail."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
    return df.withColumn("faults", F.array_join(failed, ","))


def review_faults(reviews: DataFrame) -> DataFrame:
    return faults(reviews, {"rating": F.col("rating").between(1, 5), "status": F.col("moderation_status").isin(*STATUSES)})


def comment_faults(comments: DataFrame) -> DataFrame:
    return faults(comments, {"retry_count": F.coalesce("retry_count", F.lit(0)) >= 0, "status": F.col("moderation_status").isin(*STATUSES), "type": F.col("target_type").isin("Comment", "Reply")})


def verdict_faults(verdicts: DataFrame) -> DataFrame:
    return faults(verdicts, {"confidence": F.col("confidence").between(0, 1), "decision": F.col("decision").isin(*DECISIONS)})


def quarantined(faulted: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(accepted, refused, counts): the rows with and without `faults` as two tables, and how many of each there are.

    One pass: rows are written to the folder, split by whether they are refused, and counted on the way (`observe`).
    counts: rows, refused. An empty table gives two empty ones.
    """
    seen, refused = Observation(), F.col("faults") != ""
    watched = faulted.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(refused).alias("refused"))
    watched.withColumn("quarantine", refused).write.partitionBy("quarantine").parquet(folder)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in faulted.schema)
    rows = faulted.sparkSession.read.schema(f"{fields}, quarantine boolean").parquet(folder)
    accepted, held = (rows.where(F.col("quarantine") == x).select(*faulted.columns) for x in (False, True))
    return accepted, held, {k: seen.get[k] for k in ("rows", "refused")}


#: Parts of a snapshot; a commit rewrites those that hold a changed key.
SNAPSHOT_PARTS = 64


def snapshot(rows: DataFrame, key: str, folder: str, parts: int = SNAPSHOT_PARTS) -> None:
    """Writes the rows as a table in parts by their key."""
    rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartition("part").write.partitionBy("part").parquet(f"{folder}/table")


def committed(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The snapshot as it is."""
    return spark.read.schema(StructType([*schema, StructField("part", IntegerType())])).parquet(f"{folder}/table").select(*schema.names)


def commit(changes: DataFrame, key: str, folder: str, schema: StructType, change: Callable[[DataFrame, DataFrame], DataFrame], name: str, parts: int = SNAPSHOT_PARTS) -> None:
    """Brings changes into a snapshot: change(rows, changes) over the parts that hold one of their keys; other parts are not read or written.

    The new parts are written beside the table first, then take the place of the old ones (dynamic overwrite). A commit
    that runs again under its name, after a failure or a success, puts the same parts there.
    """
    spark, part = changes.sparkSession, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    staged, whole = f"{folder}/staged/{name}", StructType([*schema, StructField("part", IntegerType())])
    if not finished(spark, staged):
        touched = [r["part"] for r in changes.select(part.alias("part")).distinct().collect()]  # of `parts` at most
        rows = spark.read.schema(whole).parquet(f"{folder}/table").where(F.col("part").isin(touched)).drop("part")
        change(rows, changes).select(*schema.names).withColumn("part", part).write.mode("overwrite").parquet(staged)
    new = spark.read.schema(whole).parquet(staged).repartition("part")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/table")


def finished(spark: SparkSession, folder: str) -> bool:
    """Whether a job has written the folder to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def status_of(decision: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])[decision]


def model_version(decided_by: Column, text_model: str, image_model: str) -> Column:
    """The model that a decision came from, or null where none was asked."""
    return F.when(decided_by.startswith("llm"), text_model).when(decided_by.startswith("vision"), image_model)


def updated_status(rows: DataFrame, changes: DataFrame, key: str, as_of: str, s: Settings = DEFAULT) -> DataFrame:
    """The next snapshot: changed rows take their new status; the deadline is set for manual review and reset otherwise."""
    changed = changes.select(F.col(key), F.col("moderation_status").alias("new_status"))
    out = rows.join(changed, key, "left")
    touched = F.col("new_status").isNotNull()
    deadline = F.when(F.col("new_status") == "ManualReview", at(as_of) + F.expr(f"interval {s.deadline_hours} hours"))
    return out.withColumn("manual_review_deadline", F.when(touched, deadline).otherwise(F.col("manual_review_deadline"))).withColumn("moderation_status", F.coalesce("new_status", "moderation_status")).drop("new_status")


def updated_text(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The next snapshot with sanitised texts; a text that did not change is not written."""
    changed = changes.select(F.col(key), F.col("comment").alias("new_text"))
    out = rows.join(changed, key, "left")
    differs = F.col("new_text").isNotNull() & ~F.col("new_text").eqNullSafe(F.col("comment"))
    return out.withColumn("changed", differs).withColumn("comment", F.when(differs, F.col("new_text")).otherwise(F.col("comment"))).drop("new_text")


def retried(rows: DataFrame, failures: DataFrame, key: str, as_of: str, s: Settings = DEFAULT) -> DataFrame:
    """Failed rows count one retry more; from retry_max on they are Failed, else Pending again."""
    failed = failures.select(key).distinct().withColumn("failed", F.lit(True))
    out = rows.join(failed, key, "left")
    count = F.col("retry_count") + 1
    status = F.when(count >= s.retry_max, "Failed").otherwise("Pending")
    return (
        out.withColumn("moderation_status", F.when(F.col("failed"), status).otherwise(F.col("moderation_status")))
        .withColumn("last_retry_at", F.when(F.col("failed") & (count < s.retry_max), at(as_of)).otherwise(F.col("last_retry_at")))
        .withColumn("retry_count", F.when(F.col("failed"), count).otherwise(F.col("retry_count")))
        .drop("failed")
    )


def failure_attempts(logs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Each model failure of a review with its attempt number, and what follows: a manual review after the allowed number."""
    failed = logs.where(F.col("result").contains("llm_call_failed"))
    attempt = F.row_number().over(Window.partitionBy("review_id").orderBy("log_id")).cast("long")
    return failed.withColumn("attempt", attempt).withColumn("next_status", F.when(attempt > s.failures_before_alert, "ManualReview").otherwise("Pending"))
