"""Chat formatting in budgeted windows of whole turns.

Prefix sums of turn tokens lay each conversation on a line; a grid, of what the budget leaves beside system turn and
history, cuts it into windows of the turns that lie inside one cell, and a turn that crosses a grid line is a window of
its own. A window repeats the conversation's system turn and as many turns before it as fit the history budget; repeated
turns carry no loss.
The sums are two-level (blocks of turns first) and windows are bounded by the budgets, so that a very long
conversation is worked on by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moderata.llm import bpe, flat
from moderata.llm.shared import materialised

#: Turns of a conversation that are summed together before the sums are.
BLOCK_TURNS = 256
OPEN, SAYS, CLOSE = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"([\\#<:])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*) </turn>\n", re.DOTALL)


def escape(column: Column) -> Column:
    """Backslashes, `#`, `<` and `:` get a backslash, so that no marker of the template can arise inside a text."""
    return F.regexp_replace(column, r"([\\#<:])", r"\\$1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of the turns in a formatted window; start and end are those of the escaped text."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return out


def _tokens(path: str):
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        for batch in batches:
            for part in flat.steps(batch, "shown", 1 << 20):
                _, at = model.encode(part.column("shown"))
                yield part.append_column("tokens", pa.array(np.diff(at), pa.int64()))

    return tokens


def format_windows(conversations: DataFrame, tokenizer: str | None = None, *, budget: int = 1024, history: int = 256) -> DataFrame:
    """(conv_id, first_turn, n_repeated, text, loss): the formatted windows of each conversation.

    first_turn: place (from 0) of the window's first own turn; n_repeated: turns before it in the text (system and
    history); loss: code point ranges of the assistant texts, each in exactly one window. A window has at most `budget`
    tokens, system turn and history included, unless it is one turn that is too long, or the system turn leaves less
    than a quarter of the budget, which a window's own turns have in any case. Turns go by turn, role, text (nulls
    first); null texts and roles are empty, rows without a conv_id are one conversation, repeated rows are turns of
    their own; only the first turn counts as the system turn. An empty table has no windows. Other columns are not read.
    The tokens are counted once and written to the shared folder.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("said"))
    rows = rows.withColumn("escaped", escape(F.col("said")))
    rows = rows.select("conv_id", "turn", "role", "escaped", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SAYS), "escaped", F.lit(CLOSE)).alias("shown"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = materialised(rows.mapInArrow(_tokens(tokenizer or bpe.default_path()), f"{fields}, tokens bigint"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 40))))
    order = [F.col("turn").asc_nulls_first(), "role", "escaped"]
    inside = Window.partitionBy("conv_id", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum("tokens").over(inside)).withColumn("place", F.row_number().over(inside))
    blocks = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    rows = rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    rows = rows.select("conv_id", "role", "escaped", "shown", (F.col("n0") + F.col("place") - 1).alias("n"), (F.col("t0") + F.col("own")).alias("end"), "tokens").withColumn("start", F.col("end") - F.col("tokens"))
    first = rows.where("n = 0 and role = 'system'").select(F.col("conv_id").alias("g_conv"), F.col("tokens").alias("system_tokens"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("g_conv")), "left").drop("g_conv")
    grid = F.greatest(F.lit(budget - history) - F.coalesce("system_tokens", F.lit(0)), F.lit(max(1, budget // 4)))
    rows = materialised(rows.withColumn("grid", grid).drop("system_tokens"))
    cell = F.floor(F.col("start") / F.col("grid"))
    crossing = F.floor((F.col("end") - 1) / F.col("grid")) > cell
    rows = rows.withColumn("cell", cell).withColumn("window", F.when(crossing, 2 * F.col("cell") + 1).otherwise(2 * F.col("cell")))
    turn = F.struct("n", "role", F.length("escaped").alias("size"), F.length("shown").alias("length"), "shown")
    windows = rows.groupBy("conv_id", "window").agg(F.min("n").alias("first_turn"), F.min("start").alias("from"), F.min("grid").alias("grid"), F.sort_array(F.collect_list(turn)).alias("turns"))
    # Turns before a window's first one that lie wholly inside the history budget: in its own cell or one before.
    reach = windows.select(F.col("conv_id").alias("w_conv"), F.col("window").alias("w"), "from", "first_turn", F.explode(F.sequence(F.greatest(F.floor((F.col("from") - history) / F.col("grid")), F.lit(0)), F.floor(F.col("from") / F.col("grid")))).alias("w_cell"))
    near = rows.where(F.col("tokens") <= history).select("conv_id", "cell", "start", "end", "n", "role", turn.alias("turn"))
    near = near.where("n > 0 or role != 'system'")
    found = near.join(reach, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("cell") == F.col("w_cell")) & (F.col("n") < F.col("first_turn")) & (F.col("start") >= F.col("from") - history) & (F.col("end") <= F.col("from")))
    found = found.groupBy("w_conv", "w").agg(F.sort_array(F.collect_list("turn")).alias("past"))
    # The history is what directly precedes the window: it ends where a turn too long for it stands between.
    system = rows.where("n = 0 and role = 'system'").select(F.col("conv_id").alias("s_conv"), F.array(turn).alias("system"))
    windows = windows.join(found, F.col("conv_id").eqNullSafe(F.col("w_conv")) & (F.col("window") == F.col("w")), "left").join(system, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left")
    none = F.array().cast(system.schema["system"].dataType)
    directly = F.element_at("past", -1)["n"] == F.col("first_turn") - 1
    windows = windows.withColumn("past", F.when(F.col("past").isNotNull() & directly, _run(F.col("past"))).otherwise(none))
    repeated = F.concat(F.when(F.col("first_turn") > 0, F.coalesce("system", none)).otherwise(none), "past")
    windows = windows.select("conv_id", "first_turn", repeated.alias("repeated"), "turns")
    windows = windows.select("conv_id", "first_turn", F.size("repeated").alias("n_repeated"), F.array_join(F.transform(F.concat("repeated", "turns"), lambda x: x["shown"]), "").alias("text"), "turns", F.aggregate(F.transform("repeated", lambda x: x["length"]), F.lit(0), lambda a, b: a + b).alias("skip"))
    # Running (end of turn, its loss range) over the window's own turns.
    start = F.struct(F.col("skip").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["length"]
        closed = end - len(CLOSE)
        span = F.struct((closed - x["size"]).cast("int").alias("start"), closed.cast("int").alias("end"))
        return F.struct(end.alias("at"), F.when(x["role"] == "assistant", F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"]).alias("loss"))

    return windows.select("conv_id", "first_turn", "n_repeated", "text", F.aggregate("turns", start, step)["loss"].alias("loss"))


def _run(turns: Column) -> Column:
    """The turns at the end of a sorted list that follow each other without a gap."""
    return F.filter(turns, lambda x, i: x["n"] - i == F.element_at(turns, -1)["n"] - (F.size(turns) - 1))


def digests(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from formatted windows.

    The windows of a conversation stream in order through one task, which holds one of them at a time.
    """
    import hashlib

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, started, n, chars, size, turns, loss, done = None, False, 0, 0, 0, None, None, []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kinds[k]) for k in range(6)], names)

        def close() -> None:
            if started:
                done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for row in batch.to_pylist():
                if not started or row["conv_id"] != now:
                    close()
                    now, started, n, chars, size, turns, loss = row["conv_id"], True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text, _, _ in read_turns(row["text"])[row["n_repeated"] :]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in row["loss"]:
                    text = unescape(row["text"][span["start"] : span["end"]])
                    loss.update(text.encode())
                    chars += len(text)
                size += len(row["text"])
            if done:
                yield emit()
                done.clear()
        close()
        yield emit()

    ordered = windows.withColumn("conv_id", F.col("conv_id").cast("bigint")).repartition("conv_id").sortWithinPartitions("conv_id", "first_turn")
    return ordered.mapInArrow(read, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
