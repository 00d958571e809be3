"""Joins, counts, notifications and account state over the moderation tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moderata.config import DECISIONS, DEFAULT, STATUSES, Settings
from moderata.operators.selection import active, at
from moderata.sources.shared import shared_folder


def reviewer_names(reviews: DataFrame, accounts: DataFrame) -> DataFrame:
    return reviews.join(accounts.select("account_id", "account_name"), "account_id", "left").withColumn("account_name", F.coalesce("account_name", F.lit("Customer")))


def images_of(reviews: DataFrame, images: DataFrame) -> DataFrame:
    """Every review with its images that are not deleted; one row without an image for those that have none."""
    return reviews.join(active(images).select("review_id", "image_id", "image_url"), "review_id", "left")


def reason_or_default(rejected: DataFrame, reasons: DataFrame, preferred: str) -> DataFrame:
    """(…, reason_id, decision): the reason of that content (the smallest id), else the default; manual review if there are none.

    The reasons are a dimension of a few rows; Spark broadcasts it by its size.
    """
    exact = reasons.groupBy("content").agg(F.min("reason_id").alias("exact_id"))
    default = reasons.agg(F.min_by("reason_id", F.struct(F.col("content") != preferred, "reason_id")).alias("default_id"))
    out = rejected.join(exact, rejected["reason_content"] == exact["content"], "left").join(default, F.lit(True), "left")
    out = out.withColumn("reason_id", F.coalesce("exact_id", "default_id")).drop("content", "exact_id", "default_id")
    return out.withColumn("decision", F.when(F.col("reason_id").isNull(), "MANUAL_REVIEW").otherwise("REJECTED"))


def recent_rejects(reviews: DataFrame, as_of: str, s: Settings = DEFAULT) -> DataFrame:
    """(account_id, n): rejected reviews of the trailing window."""
    recent = active(reviews).where((F.col("moderation_status") == "Rejected") & (F.col("updated_at") >= at(as_of) - F.expr(f"interval {s.offender_window_days} days")))
    return recent.groupBy("account_id").agg(F.count("*").alias("n"))


def with_recent_rejects(reviews: DataFrame, as_of: str, s: Settings = DEFAULT) -> DataFrame:
    """Every review with the number of its account; counted once for each account, not once for each review."""
    counts = recent_rejects(reviews, as_of, s)
    return reviews.join(counts, "account_id", "left").withColumn("recent_rejected_count", F.coalesce("n", F.lit(0))).drop("n")


def trailing_rejects(reviews: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Each review with the rejects of its account in the days up to it, itself included; null for a review without a time.

    Rejects are counted for each account and day first, and days are summed for each account; reviews meet the sums by
    account and day. So no task holds an account's reviews, only its days. A null account is one account.
    """
    rows = active(reviews).withColumn("day", F.datediff(F.col("created_at"), F.lit("1970-01-01").cast("date")))
    window = Window.partitionBy("a").orderBy("d").rangeBetween(-s.offender_window_days, 0)
    days = rows.where("day is not null").groupBy(F.col("account_id").alias("a"), F.col("day").alias("d")).agg(F.count_if(F.col("moderation_status") == "Rejected").alias("n"))
    sums = days.select("a", "d", F.sum("n").over(window).alias("trailing"))
    return rows.join(sums, F.col("account_id").eqNullSafe(F.col("a")) & (F.col("day") == F.col("d")), "left").drop("a", "d", "day")


def status_counts(rows: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """(status, n) of the given statuses, zero where there is none; other statuses are left out."""
    named = rows.sparkSession.createDataFrame([(x,) for x in statuses], "status string")
    counts = active(rows).groupBy(F.col("moderation_status").alias("status")).agg(F.count("*").alias("n"))
    return named.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def status_rollup(comments: DataFrame) -> DataFrame:
    return active(comments).rollup("target_type", "moderation_status").agg(F.count("*").alias("n"))


def severity(decision: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in DECISIONS]), decision) - 1


def decision_of(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in DECISIONS]), (level + 1).cast("int"))


def combined(texts: DataFrame, images: DataFrame) -> DataFrame:
    """(review_id, decision, reason): the severest of text and images, with the reason of what brought it, the text first, then the smallest image id (of rows of one id, the smallest reason)."""
    worst = images.withColumn("level", severity(F.col("decision"))).groupBy("review_id").agg(F.max("level").alias("image_level"), F.min_by("reason", F.struct(-F.col("level"), "image_id", "reason")).alias("image_reason"))
    out = texts.withColumn("text_level", severity(F.col("decision"))).join(worst, "review_id", "left")
    level = F.greatest("text_level", F.coalesce("image_level", F.lit(0)))
    return out.select("review_id", decision_of(level).alias("decision"), F.when(F.col("text_level") == level, F.col("reason")).otherwise(F.col("image_reason")).alias("reason"))


# The kind of recipient of each role, and the form of the keys that a delivery is known by.
RECIPIENTS = {2: "ADMIN", 3: "STAFF"}
DELIVERY_OF_REVIEW = "moderation:review:%d:account:"
REASON_CHARS = 200


def manual_review_notices(reviews: DataFrame, staff: DataFrame, *, spread: int = 64, members: int = 20_000) -> DataFrame:
    """(account_id, review_id, recipient_type, title, message, payload, action_target, notice_key): a delivery for each review and member of staff.

    reviews: review_id, account_name, reason (null: empty; cut to 200 characters). Rows of one id are one review or member.
    Each pair is a row to be sent. Pairs meet in a grid of `spread` parts of the reviews and as many parts of the staff as
    hold about `members` each, by an equal join on both parts: no task holds all of either side, and no role is a hot key.
    What a review or a member says is written before they meet; a pair only puts its key together.
    """
    staff = staff.dropDuplicates(["account_id"])
    parts = max(1, -(-staff.count() // members))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    kinds = F.create_map(*[F.lit(v) for pair in RECIPIENTS.items() for v in pair])
    asked = reviews.dropDuplicates(["review_id"]).withColumn("reason", F.substring(F.coalesce("reason", F.lit("")), 1, REASON_CHARS)).select(
        "review_id",
        F.format_string("%s wrote a review that a person has to judge. Why: %s", "account_name", "reason").alias("message"),
        F.to_json(F.struct("review_id", "reason")).alias("payload"),
        F.format_string("/admin/product-reviews?reviewId=%d", "review_id").alias("action_target"),
        F.format_string(DELIVERY_OF_REVIEW, "review_id").alias("key_of_review"),
        part("review_id", spread).alias("x"),
    )
    sent_to = staff.select(
        "account_id",
        F.coalesce(F.try_element_at(kinds, "role_id"), F.lit("STAFF")).alias("recipient_type"),
        F.coalesce(F.col("account_id").cast("string"), F.lit("null")).alias("key_of_account"),
        part("account_id", parts).alias("y"),
    )
    asked = asked.select("*", every(parts).alias("y")).repartition(spread, "x", "y")
    # In the order of their ids: keys that follow each other then share most of their signs, which makes the written rows smaller.
    receivers = F.sort_array(F.collect_list(F.struct("account_id", "recipient_type", "key_of_account")))
    groups = sent_to.groupBy("y").agg(receivers.alias("receivers")).select("*", every(spread).alias("x"))
    return asked.join(groups.hint("shuffle_hash"), ["x", "y"]).withColumn("to", F.explode("receivers")).select(
        "to.account_id",
        "review_id",
        "to.recipient_type",
        F.lit("A review waits for you").alias("title"),
        "message",
        "payload",
        "action_target",
        F.concat("key_of_review", "to.key_of_account").alias("notice_key"),
    )


def deliveries_by_review(reviews: DataFrame, staff: DataFrame) -> DataFrame:
    """(review_id, n): how many members of staff a review is sent to; none of the deliveries is made for it."""
    members = staff.agg(F.count_distinct("account_id").alias("n")).where("n > 0")
    return reviews.select("review_id").distinct().join(members, F.lit(True))


def deliveries_by_account(reviews: DataFrame, staff: DataFrame) -> DataFrame:
    """(account_id, n, latest): what `inbox` counts over the deliveries of all pairs; none of them is made for it.

    A member of staff gets every review, so that the number of reviews and the latest of them are found once.
    """
    sent = reviews.agg(F.count_distinct("review_id").alias("n"), F.max("review_id").alias("latest")).where("n > 0")
    return staff.select("account_id").distinct().join(sent, F.lit(True))


def inbox(notices: DataFrame) -> DataFrame:
    """(account_id, n, latest): the deliveries of each account, and the latest review among them."""
    return notices.groupBy("account_id").agg(F.count("*").alias("n"), F.max("review_id").alias("latest"))


def all_targets(comments: DataFrame, replies: DataFrame) -> DataFrame:
    """(target_type, target_id, account_id, moderation_status) of both tables."""
    rows = lambda df, kind: df.select(F.lit(kind).alias("target_type"), "target_id", "account_id", "moderation_status")
    return rows(active(comments), "Comment").unionByName(rows(active(replies), "Reply"))


def exact_reason(rows: DataFrame, reasons: DataFrame) -> DataFrame:
    """The rows with the smallest reason_id of exactly their reason_content; null where there is none."""
    exact = reasons.groupBy(F.col("content").alias("reason_content")).agg(F.min("reason_id").alias("reason_id"))
    return rows.join(exact, "reason_content", "left")


def default_reason(reasons: DataFrame, preferred: str) -> DataFrame:
    """The one reason that stands for all others: the preferred content first, then the smallest id."""
    return reasons.orderBy(F.col("content") != preferred, "reason_id").limit(1)


def decision_reasons(texts: DataFrame, images: DataFrame) -> DataFrame:
    """(review_id, reason, reason_from): what brought the final decision, the text before the images."""
    final = combined(texts, images).select("review_id", "decision", "reason")
    own = texts.select("review_id", F.col("decision").alias("text_decision"))
    return final.join(own, "review_id").select("review_id", "reason", F.when(F.col("decision") == F.col("text_decision"), "text").otherwise("image").alias("reason_from"))


def rejection_notices(reviews: DataFrame, sent: DataFrame) -> DataFrame:
    """(account_id, title, payload, notice_key): the rows to append to the notifications, one for each rejected review not yet told."""
    key = F.concat(F.lit("rejected:review:"), "review_id")
    rows = active(reviews).where("moderation_status = 'Rejected'").select("account_id", F.lit("Review rejected").alias("title"), F.to_json(F.struct("review_id")).alias("payload"), key.alias("notice_key"))
    return new_by_key(rows, sent, "notice_key")


def new_by_key(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet, one for each key."""
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def with_counter_rows(accounts: DataFrame, counters: DataFrame) -> DataFrame:
    """The counters with a row at 0 for each account that had none."""
    missing = accounts.select("account_id").distinct().join(counters, "account_id", "left_anti")
    return counters.select("account_id", "violation_count").unionByName(missing.select("account_id", F.lit(0).alias("violation_count")))


def violation_counts(violations: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    return violations.groupBy("account_id").agg(F.least(F.count("*"), F.lit(s.counter_cap)).alias("n"))


def lockouts(violations: DataFrame, threshold: int, days: int, cap: int = DEFAULT.counter_cap) -> DataFrame:
    """(account_id, n, locks, until): the counter, the number of locks and the end of the last one after all violations in order.

    A violation adds one, up to the cap; from the threshold on it sets the lock's end `days` later. The first violation
    after that end finds the counter reset. Rows without a time don't count; a null account is one account.

    Violations are sorted by account and time over all tasks. Each slice of an account is one function from the state before
    it to the state after it, and the functions of an account are applied in turn, one for each partition that holds a part
    of it; so an account of any length is folded by many tasks.
    """
    if threshold > cap:  # the counter never gets there
        timed = violations.where(F.col("ts").isNotNull())
        return timed.groupBy("account_id").agg(F.least(F.count("*"), F.lit(cap)).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("locks"), F.lit(None).cast("bigint").alias("until"))
    slices = F.array_sort(F.collect_list(F.struct("part", "first_at", "after"))).alias("slices")
    start = F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in (("n", 0), ("locks", 0), ("until", None))])

    def apply(state: Column, one: Column) -> Column:
        over = state["until"] <= one["first_at"]
        entry = F.when(state["until"].isNull(), state["n"]).when(over, 0).otherwise(threshold)
        found = F.get(one["after"], F.least(entry, F.lit(threshold)).cast("int"))
        n = F.coalesce(found["n"], F.least(state["n"] + found["more"], F.lit(cap)))
        return F.struct(n.cast("bigint").alias("n"), (state["locks"] + found["locks"]).alias("locks"), found["until"].alias("until"))

    found = lockout_slices(violations, threshold, days, cap).groupBy("account_id").agg(slices)
    return found.select("account_id", F.aggregate("slices", start, apply).alias("s")).select("account_id", "s.n", "s.locks", "s.until")


def lockout_slices(violations: DataFrame, threshold: int, days: int, cap: int = DEFAULT.counter_cap) -> DataFrame:
    """(account_id, part, first_at, size, after): each account's violations in one partition as a function of the state before them.

    after[k]: the state from a counter of k that is not locked; after[threshold]: from a lock that still holds at first_at,
    where a null n says that `more` are added to the counter as it was. The first slice of a partition may go on from the
    one before it and has all entries; any other one starts its account and has only that of the counter 0.
    """
    timed = violations.where(F.col("ts").isNotNull())
    rows = timed.select("account_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    ordered = rows.repartitionByRange("account_id", "at", "event_id").sortWithinPartitions("account_id", "at")
    states = "array<struct<n:bigint, more:bigint, locks:bigint, until:bigint>>"
    return ordered.mapInArrow(_sliced(threshold, days * 86_400_000_000, cap), f"account_id bigint, part bigint, first_at bigint, size bigint, after {states}")


def _after(at: np.ndarray, threshold: int, span: int, cap: int, entries: list[int]) -> list[tuple]:
    """(n, more, locks, until) after violations at these times, for each entry: the counter before them, or the threshold for a lock that holds."""
    size = len(at)
    resets = np.flatnonzero(np.diff(at) >= span) + 1  # a lock that holds before these is over at them
    known: dict[int, tuple[int, int, int | None]] = {}

    def fresh(first: int) -> tuple[int, int, int | None]:
        """From a counter of 0 before the violation at `first`: lock, and from the next reset on the same again."""
        path = []
        while first not in known:
            path.append(first)
            lock = first + threshold - 1
            if lock >= size:
                known[first] = (size - first, 0, None)
                break
            k = int(np.searchsorted(resets, lock, side="right"))
            if k == len(resets):
                known[first] = (min(size - first, cap), 1, int(at[-1]) + span)
                break
            first = int(resets[k])
        for before in reversed(path):
            if before not in known:
                n, locks, until = known[first]
                known[before] = (n, locks + 1, until)
            first = before
        return known[first]

    out = []
    for entry in entries:
        # The first violation that finds a lock over: after the one that locks, or from the start if a lock holds.
        lock = threshold - entry - 1 if entry < threshold else -1
        k = int(np.searchsorted(resets, lock, side="right"))
        new = int(entry < threshold)
        if lock >= size:
            out.append((entry + size, 0, 0, None))
        elif k < len(resets):
            n, locks, until = fresh(int(resets[k]))
            out.append((n, 0, locks + new, until))
        elif new:
            out.append((min(entry + size, cap), 0, 1, int(at[-1]) + span))
        else:
            out.append((None, size, 0, int(at[-1]) + span))
    return out


def _sliced(threshold: int, span: int, cap: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held = TaskContext.get().partitionId(), True, []
        schema = pa.schema([("account_id", pa.int64()), ("part", pa.int64()), ("first_at", pa.int64()), ("size", pa.int64()), ("after", pa.list_(pa.struct([(k, pa.int64()) for k in ("n", "more", "locks", "until")])))])

        def told(account: int | None, at: np.ndarray, entries: list[int]) -> dict:
            states = [dict(zip(("n", "more", "locks", "until"), x, strict=True)) for x in _after(at, threshold, span, cap, entries)]
            return {"account_id": account, "part": part, "first_at": int(at[0]), "size": len(at), "after": states}

        for batch in batches:
            if not batch.num_rows:
                continue
            out, accounts = [], batch.column("account_id")
            at = batch.column("at").to_numpy()
            same = accounts.fill_null(0).to_numpy()
            known = accounts.is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((same[1:] != same[:-1]) | (known[1:] != known[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                account = accounts[a].as_py()
                if held and held[0] != account:
                    out.append(told(held[0], np.concatenate(held[1]), list(range(threshold + 1)) if first else [0]))
                    first, held = False, []
                held = held or [account, []]
                held[1].append(at[a:b])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([told(held[0], np.concatenate(held[1]), list(range(threshold + 1)) if first else [0])], schema)

    return fold


def unlocked(bans: DataFrame, as_of: str) -> DataFrame:
    """The next snapshot: bans that ended are lifted and their counters reset."""
    over = F.coalesce(F.col("is_banned") & (F.col("expires_at") <= at(as_of)), F.lit(False))
    return bans.withColumn("unbanned_at", F.when(over, at(as_of))).withColumn("violation_count", F.when(over, 0).otherwise(F.col("violation_count"))).withColumn("is_banned", F.col("is_banned") & ~over)


def reused_requests(requests: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Each request with the time of the answer that it reuses: that of the first equal one of the last reuse_seconds; a reuse does not prolong it.

    A null request is one request; a row without a time reuses nothing.
    """
    return _anchored(requests, s).select("event_id", "request", "anchor")


def answered_requests(requests: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(event_id, answered_by): the request that each gets its answer from, as in `reused_requests`; of equal ones at one time, the smallest event_id."""
    rows = _anchored(requests, s)
    firsts = rows.where("at = anchor").groupBy(F.col("request").alias("r"), F.col("anchor").alias("a")).agg(F.min("event_id").alias("first"))
    same = F.col("request").eqNullSafe(F.col("r")) & (F.col("anchor") == F.col("a"))
    return rows.join(firsts, same, "left").select("event_id", F.coalesce("first", "event_id").alias("answered_by"))


def _anchored(requests: DataFrame, s: Settings) -> DataFrame:
    rows = requests.select("event_id", "request", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    times = rows.where("at is not null").select(F.col("request").alias("own"), F.col("at").alias("time")).distinct()
    same = F.col("request").eqNullSafe(F.col("own")) & (F.col("at") == F.col("time"))
    return rows.join(anchors(times, s.reuse_seconds * 1_000_000), same, "left").select("event_id", "request", "at", "anchor")


def anchors(times: DataFrame, span: int) -> DataFrame:
    """(own, time, anchor) of distinct (own, time): the first time of each is an anchor, and so is the first one more than `span` after an anchor.

    Each time points to the first one beyond its span. Times are sorted over all tasks, and pointers followed within a
    partition; only where a partition goes on with the key that the one before it ended with, the anchor depends on others.
    Of such a slice the times near its start are kept with the last anchor that each leads to, and these pointers across
    slices are doubled until each slice knows where it is entered. What the driver sees is a row of each partition.
    """
    spark = times.sparkSession
    folder = shared_folder(spark)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    ordered = times.repartitionByRange("own", "time").sortWithinPartitions("own", "time")
    found = written(ordered.mapInArrow(_walked(span), "own string, time bigint, anchor bigint, exit bigint, part bigint, opens boolean"), "walked")
    key = F.struct("own", "time")
    ends = found.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.max(F.when(F.col("opens"), F.col("time"))).alias("last"), F.max_by("anchor", key).alias("anchor"))
    parts = sorted(ends.collect(), key=lambda r: r["part"])
    going_on = [b["part"] for a, b in zip(parts, parts[1:], strict=False) if a["hi"]["own"] == b["lo"]["own"]]
    if not going_on:
        return found.select("own", "time", "anchor")
    # Chains of slices: (part, time of its last row), and the last anchor before the first of them.
    chains, before = [], {}
    for a, b in zip(parts, parts[1:], strict=False):
        if a["hi"]["own"] == b["lo"]["own"]:
            if not (chains and chains[-1][-1][0] == a["part"] and a["lo"]["own"] == a["hi"]["own"]):
                chains.append([])
                before[len(chains) - 1] = a["anchor"]
            chains[-1].append((b["part"], b["last"]))
    at = {part: (c, k) for c, chain in enumerate(chains) for k, (part, _) in enumerate(chain)}
    lasts = [np.array([last for _, last in chain], np.int64) for chain in chains]

    def entered(c: int, k: int, exit_: int) -> int | None:
        """The slice from place k of a chain on that holds a time beyond the span of this anchor."""
        k += int(np.searchsorted(lasts[c][k:], exit_ + span, side="right"))
        return chains[c][k][0] if k < len(chains[c]) else None

    def pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [entered(at[p][0], at[p][1] + 1, e) for p, e in zip(batch.column("part").to_pylist(), batch.column("exit").to_pylist(), strict=True)]
            yield batch.append_column("to_part", pa.array(out, pa.int64()))

    slices = spark.createDataFrame([(p,) for p in going_on], "slice bigint")
    opened = found.where("opens").join(slices, F.col("part") == F.col("slice"), "left_semi")
    nodes = written(opened.where("exit is not null").select("part", "time", "exit").mapInArrow(pointed, "part bigint, time bigint, exit bigint, to_part bigint"), "nodes")
    starts = [(-1 - c, before[c], before[c], entered(c, 0, before[c])) for c in range(len(chains))]
    asked = nodes.unionByName(spark.createDataFrame(starts, nodes.schema)).where("to_part is not null")
    # The first time beyond what is asked, in the slice where it lies: of a slice's times and questions from late to early, the last time seen.
    places = nodes.select(F.col("part").alias("slice"), F.col("time").alias("value"), F.lit(None).cast("bigint").alias("from_part"), F.lit(None).cast("bigint").alias("from_time"), F.col("time").alias("to_time"))
    questions = asked.select(F.col("to_part").alias("slice"), (F.col("exit") + span).alias("value"), F.col("part").alias("from_part"), F.col("time").alias("from_time"), F.lit(None).cast("bigint").alias("to_time"))
    later = Window.partitionBy("slice").orderBy(F.col("value").desc(), F.col("from_part").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    links = places.unionByName(questions).withColumn("to_time", F.last("to_time", ignorenulls=True).over(later)).where("from_part is not null")
    links = written(links.select("from_part", "from_time", F.col("slice").alias("to_part"), "to_time"), "links0")
    reached = written(links.where("from_part < 0").select(F.col("to_part").alias("part"), F.col("to_time").alias("time")), "reached0")
    for k in range(1, max(map(len, chains)).bit_length() + 1):
        on = [F.col("part") == F.col("from_part"), F.col("time") == F.col("from_time")]
        further = reached.join(links, on).select(F.col("to_part").alias("part"), F.col("to_time").alias("time"))
        doubled = links.alias("a").join(links.alias("b"), (F.col("a.to_part") == F.col("b.from_part")) & (F.col("a.to_time") == F.col("b.from_time")))
        reached = written(reached.unionByName(further).distinct(), f"reached{k}")
        links = written(doubled.select("a.from_part", "a.from_time", "b.to_part", "b.to_time"), f"links{k}")
    entries = {r["part"]: (r["time"], r["exit"]) for r in reached.join(nodes, ["part", "time"]).collect()}  # one of a slice at most
    first = {}
    for c, chain in enumerate(chains):
        anchor = before[c]
        for part, _ in chain:
            first[part] = (anchor, entries[part][0] if part in entries else None)
            anchor = entries[part][1] if part in entries else anchor
    again = opened.repartition("part").sortWithinPartitions("part", "time").select("own", "time", "part").mapInArrow(_entered(span, first), "own string, time bigint, anchor bigint")
    rest = found.join(slices, (F.col("part") == F.col("slice")) & F.col("opens"), "left_anti")
    return rest.select("own", "time", "anchor").unionByName(again)


def _chain(time: np.ndarray, span: int, anchor: np.ndarray, start: int) -> None:
    """Fills in the anchors from one on."""
    after = np.searchsorted(time, time + span, side="right")
    while start < len(time):
        anchor[start : after[start]] = time[start]
        start = int(after[start])


def _walked(span: int):
    """Anchors as if every key began with its partition; of a partition's first key also the last anchor that each of its first times leads to."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, opens, held = TaskContext.get().partitionId(), True, None

        def told(own: str | None, time: np.ndarray) -> pa.RecordBatch:
            n, anchor, exit_ = len(time), np.empty(len(time), np.int64), pa.nulls(len(time), pa.int64())
            _chain(time, span, anchor, 0)
            if opens:
                to = np.searchsorted(time, time + span, side="right")
                leads = np.where(to < n, to, np.arange(n))
                while True:
                    further = leads[leads]
                    if (further == leads).all():
                        break
                    leads = further
                exit_ = pa.array(time[leads], mask=np.arange(n) > to[0])
            return pa.RecordBatch.from_arrays([pa.array([own] * n, pa.string()), pa.array(time), pa.array(anchor), exit_, pa.array(np.full(n, part)), pa.array(np.full(n, opens))], ["own", "time", "anchor", "exit", "part", "opens"])

        for batch in batches:
            own, time = batch.column("own").to_numpy(zero_copy_only=False), batch.column("time").to_numpy()
            cuts = (np.flatnonzero(own[1:] != own[:-1]) + 1).tolist()
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(time)], strict=True):
                if a < b:
                    if held is not None and held[0] != own[a]:
                        out.append(told(held[0], np.concatenate(held[1])))
                        opens, held = False, None
                    held = held or (own[a], [])
                    held[1].append(time[a:b])
            yield from out
        if held is not None:
            yield told(held[0], np.concatenate(held[1]))

    return fold


def _entered(span: int, first: dict[int, tuple[int, int | None]]):
    """Anchors of slices that go on: up to where a slice is entered those of the anchor before it, from there on its own."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def told() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            time = whole.column("time").to_numpy()
            before, entry = first[part]
            anchor = np.full(len(time), before)
            if entry is not None:
                _chain(time, span, anchor, int(np.searchsorted(time, entry)))
            return pa.RecordBatch.from_arrays([whole.column("own"), whole.column("time"), pa.array(anchor)], ["own", "time", "anchor"])

        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = (np.flatnonzero(np.diff(parts)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(parts)], strict=True):
                if a < b:
                    if held and part != int(parts[a]):
                        yield told()
                        held.clear()
                    part = int(parts[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield told()

    return fold


def review_log_rows(verdicts: DataFrame) -> DataFrame:
    """Audit rows: the reason cut to 500 characters, the verdict as JSON."""
    payload = F.to_json(F.struct("decision", "category"))
    return verdicts.select("review_id", F.lit("AI").alias("moderator"), "decision", F.substring("reason", 1, 500).alias("reason"), payload.alias("result"))


def comment_log_rows(verdicts: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """Audit rows: either the comment's or the reply's id is set, by the target's type."""
    is_comment = F.col("target_type") == "Comment"
    return verdicts.where(F.col("moderation_status").isin(*statuses)).select(F.when(is_comment, F.col("target_id")).alias("comment_id"), F.when(~is_comment, F.col("target_id")).alias("reply_id"), F.col("moderation_status").alias("action"))
