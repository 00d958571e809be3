"""Structured Streaming forms of the moderation operators. Each takes a streaming DataFrame; sinks write to shared storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from moderata.config import DEFAULT, Settings
from moderata.functions import detect as D
from moderata.operators.selection import active
from moderata.sources.tables import VIEWS


def stream_of(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A moderation table as a stream of the files of its base table (a pattern, as a stream's path may not be one file)."""
    base, sql = VIEWS[view]
    schema = spark.read.parquet(f"{sf_dir}/{base}.parquet").schema
    return spark.sql(sql, base=spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/{base}.parque[t]"))


def drained(stream: DataFrame, folder: str, mode: str = "append", key: str | list[str] | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """What the stream gives for all that is there now.

    Every batch is a folder of its own, so that a batch that runs again replaces its rows. Complete: the last batch;
    update: the latest row of each key.
    """
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)

    def add(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    rows = spark.read.schema(f"{fields}, batch bigint").parquet(f"{folder}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("last"))
        rows = rows.join(last, F.col("batch") == F.col("last"), "left_semi")
    elif mode == "update":
        whole = F.struct(*stream.columns)
        rows = rows.groupBy(*([key] if isinstance(key, str) else key)).agg(F.max_by(whole, "batch").alias("r")).select("r.*")
    return rows.select(*stream.columns)


def moderated(reviews: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Arriving reviews with the reason of their rejection: the batch operator, unchanged."""
    return D.with_review_reason(reviews, "comment", "reason", s).select("review_id", "account_id", "reason")


SINKS = ("status", "log", "notices")


def to_sinks(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: one batch of `moderated` rows into three sinks, each batch a folder of its own in each sink.

    The verdicts are written first and read back, so that the rules run once and the sinks agree; a batch that runs again,
    after a failure between any two sinks, replaces its own rows and no others.
    """

    def add(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/verdicts/batch={batch}")
        judged = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/verdicts/batch={batch}")
        rejected = F.col("reason").isNotNull()
        frames = {
            "status": judged.select("review_id", F.when(rejected, "Rejected").otherwise("Processing").alias("moderation_status")),
            "log": judged.where(rejected).select("review_id", F.lit("AI").alias("moderator"), F.lit("REJECTED").alias("decision"), F.substring("reason", 1, 500).alias("reason")),
            "notices": judged.where(rejected).select("account_id", F.concat(F.lit("rejected:review:"), "review_id").alias("notice_key")).dropDuplicates(["notice_key"]),
        }
        for name in SINKS:
            frames[name].write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")

    return add


def sink(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """What a sink holds after the batches so far."""
    return spark.read.option("mergeSchema", "false").parquet(f"{folder}/{name}").drop("batch")


def into(stream: DataFrame, add: Callable[[DataFrame, int], None], folder: str) -> None:
    """Runs the stream over all that is there now."""
    stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()


def once_by_key(folder: str, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the rows whose key no earlier batch has written, one for each key, into a sink of a folder for each batch.

    The sink itself is the memory: the stream keeps no state. A batch that runs again is compared with the batches before
    it, not with its own rows, and replaces these.
    """

    def add(rows: DataFrame, batch: int) -> None:
        spark, new = rows.sparkSession, rows.dropDuplicates([key])
        if batch:
            told = spark.read.schema(f"{key} {dict(rows.dtypes)[key]}, batch bigint").parquet(f"{folder}/told").where(F.col("batch") < batch).select(key)
            new = new.join(told, key, "left_anti")
        new.select(*rows.columns).write.mode("overwrite").parquet(f"{folder}/told/batch={batch}")

    return add


def status_counts(rows: DataFrame, at: str, late_days: int = 90) -> DataFrame:
    """(day, moderation_status, n): rows that are not deleted by day and status. A day is dropped from the state once no row of it may come any more."""
    timed = active(rows).withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", f"{late_days} days")
    counts = timed.groupBy(F.window("at", "1 day").alias("w"), "moderation_status").agg(F.count("*").alias("n"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "moderation_status", "n")


def deadlines_passed(rows: DataFrame, at: str, late_minutes: int = 60) -> DataFrame:
    """(target_id, deadline): each target whose review by a person is overdue, when the stream's clock passes its deadline.

    The clock is the latest time of a row less `late_minutes`. A timer is set for each target; a row with another status or
    another deadline sets it anew, so one that was reviewed in time is never reported.
    """

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame({"target_id": pd.Series([], dtype="int64"), "deadline": pd.Series([], dtype="int64")})
        if state.hasTimedOut:
            (deadline,) = state.get
            state.remove()
            yield pd.DataFrame({"target_id": [key[0]], "deadline": [deadline]})
            return
        # Of rows of one time, the one that waits, with the latest deadline: a review by a person is rather late than left out.
        rows = pd.concat(list(frames))
        last = rows.assign(waits=rows["moderation_status"] == "ManualReview").sort_values(["micros", "waits", "deadline"], na_position="first").iloc[-1]
        waits = last["moderation_status"] == "ManualReview" and not pd.isna(last["deadline"])
        if not waits:
            if state.exists:
                state.remove()
            yield none
            return
        deadline, clock = int(last["deadline"]), state.getCurrentWatermarkMs()
        if deadline // 1000 <= clock:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"target_id": [key[0]], "deadline": [deadline]})
            return
        state.update((deadline,))
        state.setTimeoutTimestamp(deadline // 1000)
        yield none

    timed = rows.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", f"{late_minutes} minutes")
    timed = timed.select("target_id", "moderation_status", "at", F.unix_micros("at").alias("micros"), F.unix_micros(F.col("manual_review_deadline").cast("timestamp")).alias("deadline"))
    return timed.groupBy("target_id").applyInPandasWithState(watch, "target_id bigint, deadline bigint", "deadline bigint", "append", GroupStateTimeout.EventTimeTimeout)


def requests_once(requests: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """The first of equal requests within the time that an answer is reused."""
    keyed = requests.withColumn("request_hash", F.sha2("request", 256)).withColumn("ts", F.col("ts").cast("timestamp"))
    return keyed.withWatermark("ts", f"{s.reuse_seconds} seconds").dropDuplicatesWithinWatermark(["request_hash"])


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _Lockouts(StatefulProcessor):
    """The counter and lock of one account: settled up to the clock, and the violations after it that wait for their turn."""

    def __init__(self, threshold: int, span: int, cap: int) -> None:
        self.threshold, self.span, self.cap = threshold, span, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "n bigint, locks bigint, until bigint")
        self.waiting = handle.getMapState("waiting", "at bigint, event_id bigint", "one int")

    def added(self, state: tuple, times: list[int]) -> tuple:
        n, locks, until = state
        for at in times:
            over = until is not None and until <= at
            n = min((0 if over else n) + 1, self.cap)
            if n >= self.threshold:
                locks += until is None or over
                until = at + self.span
            elif over:
                until = None
        return n, locks, until

    def told(self, account: int | None, clock: int) -> pd.DataFrame:
        """Settles what lies before the clock (milliseconds), lifts a lock that is over by it, and tells the state with what waits."""
        state = self.settled.get() if self.settled.exists() else (0, 0, None)
        waiting = sorted(tuple(x) for x in self.waiting.keys())
        due = [x for x in waiting if x[0] // 1000 < clock]
        later = [x[0] for x in waiting[len(due) :]]
        state = self.added(state, [at for at, _ in due])
        if state[2] is not None and state[2] <= clock * 1000:
            state = (0, state[1], None)
        if due or self.settled.exists():
            self.settled.update(state)
        for x in due:
            self.waiting.removeKey(x)
        n, locks, until = self.added(state, later)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        for at in ([later[-1] // 1000 + 1] if later else []) + ([-(-until // 1000)] if until is not None else []):
            self.handle.registerTimer(at)
        return pd.DataFrame({"account_id": pd.array([account], "Int64"), "n": [n], "locks": [locks], "until": pd.array([until], "Int64")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            for x in zip(frame["at"].tolist(), frame["event_id"].tolist(), strict=True):
                self.waiting.updateValue(x, (1,))
        yield self.told(_id(key[0]), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.told(_id(key[0]), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _id(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


def violation_state(threshold: int, days: int, cap: int = DEFAULT.counter_cap, late_minutes: int = 1440) -> Callable[[DataFrame], DataFrame]:
    """(account_id, n, locks, until) of each account whenever a violation arrives or a lock ends: what the batch fold gives.

    Violations may arrive in any order within `late_minutes`: those after the stream's clock wait, one map entry each, and
    are told in their order with what is settled; once the clock has passed them they are settled and forgotten. A timer
    lifts a lock at its end: the counter is 0 again. One row of state for each account stays, as its counter must; rows
    without a time don't count, and the same event counts once. Needs ROCKSDB in the session.
    """

    def run(violations: DataFrame) -> DataFrame:
        timed = violations.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null").withWatermark("ts", f"{late_minutes} minutes")
        rows = timed.select("account_id", "event_id", "ts", F.unix_micros("ts").alias("at"))
        processor = _Lockouts(threshold, days * 86_400_000_000, cap)
        return rows.groupBy("account_id").transformWithStateInPandas(processor, "account_id bigint, n bigint, locks bigint, until bigint", "update", "eventTime")

    return run
