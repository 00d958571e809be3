"""Streams over the tables, drained once; their SQL is that of the batch operators they equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from moderata.plans import duck as Q
from moderata.plans import relational
from moderata.plans.define import Registry
from moderata.sources.shared import shared_folder
from moderata.sources.tables import with_views
from moderata.streaming import jobs as J

registry = Registry()
query = registry.query


@query("stream_moderate", f"{with_views('reviews')},\n{Q.review_reasons('reviews', 'review_id', 'comment')}\nselect review_id, found as reason from reasons")
def stream_moderate(spark, sf):
    return J.drained(J.moderated(J.stream_of(spark, sf, "reviews")).drop("account_id"), shared_folder(spark))


_REASONS = f"{with_views('reviews')},\n{Q.review_reasons('reviews', 'review_id', 'comment')},\nfound_ as (select review_id, account_id, found from reasons join reviews using (review_id))\n"


@query("stream_moderate_sinks", _REASONS + """select 'status' as sink, review_id::varchar as key, case when found is null then 'Processing' else 'Rejected' end as value from found_
 union all select 'log', review_id::varchar, substr(found, 1, 500) from found_ where found is not null
 union all select 'notices', 'rejected:review:' || review_id, account_id::varchar from found_ where found is not null""")
def stream_moderate_sinks(spark, sf):
    """The verdicts of arriving reviews in their three sinks."""
    folder = shared_folder(spark)
    J.into(J.moderated(J.stream_of(spark, sf, "reviews")), J.to_sinks(folder), folder)
    shown = (("status", "review_id", "moderation_status"), ("log", "review_id", "reason"), ("notices", "notice_key", "account_id"))
    parts = [J.sink(spark, folder, name).select(F.lit(name).alias("sink"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value")) for name, key, value in shown]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# The stream's clock ends a day before the latest violation: locks that ended by then are lifted.
_LIFTED = "until <= (select max(epoch_ms(ts)) - 86400000 from violations) * 1000"


@query("stream_violation_state", relational.registry.sql["violation_lockout_fold"].replace("s.n as n, s.locks as locks, s.until as until", f"case when {_LIFTED.replace('until', 's.until')} then 0 else s.n end as n, s.locks as locks, case when {_LIFTED.replace('until', 's.until')} then null else s.until end as until"))
def stream_violation_state(spark, sf):
    return J.drained(J.violation_state(5, 7)(J.stream_of(spark, sf, "violations")), shared_folder(spark), "update", "account_id", J.ROCKSDB)


_CLOCK = "(select max(last_retry_at) - interval '60' minute from comments where not is_deleted)"


@query("stream_deadlines", with_views("comments") + f"select target_id, epoch_us(manual_review_deadline) as deadline from comments where not is_deleted and moderation_status = 'ManualReview' and last_retry_at is not null and manual_review_deadline < {_CLOCK}")
def stream_deadlines(spark, sf):
    rows = J.stream_of(spark, sf, "comments").where("not is_deleted and last_retry_at is not null")
    return J.drained(J.deadlines_passed(rows, "last_retry_at"), shared_folder(spark))


@query("stream_notify_once", with_views("violations") + "select distinct 'violation:account:' || account_id as notice_key from violations")
def stream_notify_once(spark, sf):
    keys = J.stream_of(spark, sf, "violations").select(F.concat(F.lit("violation:account:"), "account_id").alias("notice_key"))
    folder = shared_folder(spark)
    J.into(keys, J.once_by_key(folder, "notice_key"), folder)
    return J.sink(spark, folder, "told")


@query("stream_request_dedup")
def stream_request_dedup(spark, sf):
    """Which of equal events comes through depends on their arrival, so there is no SQL; tests/test_operators.py has the rule."""
    return J.drained(J.requests_once(J.stream_of(spark, sf, "requests")).select("event_id", "request_hash"), shared_folder(spark))


@query("stream_status_counts", with_views("comments") + "select strftime(created_at, '%Y-%m-%d') as day, moderation_status, count(*) as n from comments where not is_deleted group by all")
def stream_status_counts(spark, sf):
    return J.drained(J.status_counts(J.stream_of(spark, sf, "comments"), "created_at"), shared_folder(spark), "update", ["day", "moderation_status"])
