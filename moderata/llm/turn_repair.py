"""Structure repair of conversations by weighted interval parsing.

The wanted form of a conversation is `(system? (user assistant)+)?`. A repair grammar in Chomsky normal form derives the
rows as they are: its nonterminals X(p, q) are the spans of rows whose edited form leads from place p to place q of that
form, with the rules X(p, q) -> X(p, r) X(r, q) and X(p, q) -> row. A cell holds the least (cost, audit) of each nonterminal
over a span, closed under insertions at either end; audits are the initials of the edits in order.

Cells are combined bottom-up by span length. As X(p, q) has a rule for each place r, every split of a span derives the same
least cell, so that one split is enough: spans of 1, 2, 4, ... rows within a block, blocks within a partition, partitions
within a conversation. Two audits of one cost over one span never are a prefix of each other (what one has more would be
insertions, which cost), so that the least of the parts is the least of the whole.

Rows are range-sorted by conversation and turn: a conversation of any length lies in many tasks, and each sends one cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.llm.shared import materialised

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows, and characters of text, of a block.
BLOCK, BLOCK_CHARS = 256, 1 << 20
SHORT = 8

#: Places: at the start, after the system turn, after a user turn, after an assistant turn; the first and the last are ends.
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {"s": ((START, SYSTEM),), "u": ((START, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
NONTERMINALS = [(p, q) for p in range(4) for q in range(4) if p == q == START or (p == START or (p, q) == (SYSTEM, SYSTEM) or q in (USER, ASSISTANT)) and q != START]
_AT = {pq: i for i, pq in enumerate(NONTERMINALS)}
RULES = [[(_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT] for p, q in NONTERMINALS]

#: A cell: (cost, audit) or None for each nonterminal.
Cell = tuple


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = []
    for splits in RULES:
        best = None
        for x, y in splits:
            a, b = left[x], right[y]
            if a is not None and b is not None:
                cost = a[0] + b[0]
                if best is None or cost <= best[0]:
                    found = (cost, a[1] + b[1])
                    if best is None or found < best:
                        best = found
        out.append(best)
    return tuple(out)


def _inserted() -> Cell:
    """The cell of no rows: insertions only."""
    best = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        for (p, r), (cost, audit) in list(best.items()):
            for r2, q in (*MOVES["u"], *MOVES["a"]):
                if r2 == r:
                    best[p, q] = min(best.get((p, q), (1 << 30, "")), (cost + INSERT, audit + "I"))
    return tuple(best.get(pq) for pq in NONTERMINALS)


EMPTY = _inserted()


def _closed(cell: Cell) -> Cell:
    return joined(EMPTY, joined(cell, EMPTY))


def deleted(n: int) -> Cell:
    """n rows that must go."""
    return _closed(tuple((DELETE * n, "D" * n) if p == q else None for p, q in NONTERMINALS))


@lru_cache(1 << 16)
def _short(kinds: str) -> Cell:
    """The cell of a few rows, each given by its kind: `X` must go; else the role's initial, as a capital letter if truncated."""
    if len(kinds) > 1:
        half = len(kinds) // 2
        return joined(_short(kinds[:half]), _short(kinds[half:]))
    if kinds == "X":
        return deleted(1)
    best = {(p, p): (DELETE, "D") for p in range(4)}
    extra = TRUNCATED if kinds.isupper() else 0
    edits = [(role, REROLE + extra, "R") for role in "ua"] + [(kinds.lower(), extra, "K")]
    for role, cost, letter in edits:
        for pq in MOVES.get(role, ()):
            best[pq] = min(best.get(pq, (1 << 30, "")), (cost, letter))
    return _closed(tuple(best.get(pq) for pq in NONTERMINALS))


def cell_of(kinds: str) -> Cell:
    """The cell of a span of rows, by spans of doubling length."""
    cells = [_short(kinds[i : i + SHORT]) for i in range(0, len(kinds), SHORT)] or [EMPTY]
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def accepted(cell: Cell) -> tuple[int, str]:
    """The cheapest repair that ends where a conversation may end."""
    return min(x for x in (cell[_AT[START, START]], cell[_AT[START, ASSISTANT]]) if x is not None)


def output_role(place: int, odd: bool, own: str) -> str:
    """The role at a place of the repaired conversation; only its system turn keeps the name that it had."""
    if odd and not place:
        return own
    return "assistant" if (place - odd) % 2 else "user"


_BLOCKS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())]))), ("n", pa.int64()),
    ("sizes", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string())), ("ends", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64())),
])
_BLOCKS_DDL = (
    "conv_id bigint, part bigint, seq bigint, rows array<struct<role:string, text:string, n:bigint>>, n bigint, sizes array<bigint>, costs array<bigint>, "
    "audits array<string>, ends array<string>, counts array<bigint>, turns array<bigint>"
)


class _Run:
    """The rows of one conversation in one partition, as far as they were read."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.cell, self.sizes = conv_id, None, []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None
        self.low = self.high = None
        self.distinct = 0
        self.open()

    def open(self) -> None:
        self.rows, self.kinds, self.cells, self.n, self.chars = [], [], [], 0, 0

    def add(self, row: dict) -> None:
        role, n = row["role"], row["n"]
        initial = role[:1] or "-"
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        self.illegal += n - 1
        self.last = initial
        if row["turn"] is not None:
            if self.high != row["turn"]:
                self.distinct += 1
            self.low = row["turn"] if self.low is None else self.low
            self.high = row["turn"]
        if row["is_blank"]:
            self.blank += n
            kind = "X"
        elif not row["is_first"]:
            self.duplicate += n
            kind = "X"
        else:
            self.duplicate += n - 1
            self.truncated += row["is_cut"]
            kind = initial if initial in "sua" else "o"
            kind = kind.upper() if row["is_cut"] else kind
        self.kinds.append(kind)
        if n > 1:
            self.cells.append(cell_of("".join(self.kinds)))
            self.cells.append(deleted(n - 1))
            self.kinds = []
        self.rows.append({"role": role, "text": row["text"], "n": n})
        self.n += n
        self.chars += len(row["text"])

    def full(self) -> bool:
        return len(self.rows) >= BLOCK or self.chars >= BLOCK_CHARS

    def close(self, part: int, seq: int, last: bool) -> dict:
        """The record of the block; that of the last one carries the cell and the counts of the run."""
        cells = [*self.cells, cell_of("".join(self.kinds))] if self.kinds or not self.cells else self.cells
        for cell in cells:
            self.cell = cell if self.cell is None else joined(self.cell, cell)
        self.sizes.append(self.n)
        out = dict.fromkeys(_BLOCKS.names) | {"conv_id": self.conv_id, "part": part, "seq": seq, "rows": self.rows, "n": self.n}
        if last:
            out |= {
                "sizes": self.sizes, "costs": [x and x[0] for x in self.cell], "audits": [x and x[1] for x in self.cell], "ends": [self.first, self.last],
                "counts": [self.blank, self.duplicate, self.truncated, self.illegal], "turns": [self.low, self.high, self.distinct],
            }
        self.open()
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, run, out, size = TaskContext.get().partitionId(), 0, None, [], 0

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, _BLOCKS)

    def record(last: bool) -> None:
        nonlocal seq, size
        size += run.chars + 1000
        out.append(run.close(part, seq, last))
        seq += 1

    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            for row in batch.slice(k, 1024).to_pylist():
                if run is None or row["conv_id"] != run.conv_id:
                    if run is not None:
                        record(last=True)
                    run = _Run(row["conv_id"])
                elif run.full():
                    record(last=False)
                run.add(row)
                if size >= 4 << 20:
                    yield emit()
                    out.clear()
                    size = 0
    if run is not None:
        record(last=True)
    yield emit()


_EDITS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int64()), ("block", pa.int64()), ("edits", pa.string()), ("place", pa.int64()), ("odd", pa.bool_()), ("gaps", pa.int64()), ("blank", pa.int64()),
    ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
])
_EDITS_DDL = "conv_id bigint, part bigint, block bigint, edits string, place bigint, odd boolean, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _parsed(runs: list[dict]) -> Iterator[dict]:
    """A record for each block of a conversation, with its edits; the first one carries the conversation's counts and audit."""
    cell, counts, low, high, distinct, last = None, [0] * 4, None, None, 0, None
    for x in runs:
        own = tuple(None if c is None else (c, a) for c, a in zip(x["costs"], x["audits"], strict=True))
        cell = own if cell is None else joined(cell, own)
        counts = [a + b for a, b in zip(counts, x["counts"], strict=True)]
        if last is not None:
            counts[3] += last + x["ends"][0] not in ("su", "ua", "au")
        last = x["ends"][1]
        if x["turns"][2]:
            distinct += x["turns"][2] - (high == x["turns"][0])
            low, high = x["turns"][0] if low is None else low, x["turns"][1]
    cost, audit = accepted(cell)
    odd = (len(audit) - audit.count("D")) % 2 == 1
    gaps = high - low + 1 - distinct if low is not None else 0
    told = {"gaps": gaps, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": counts[3], "cost": cost, "audit": audit}
    at = place = 0
    blocks = [(x["part"], x["seq"] - len(x["sizes"]) + 1 + i, n) for x in runs for i, n in enumerate(x["sizes"])]
    for i, (part, seq, n) in enumerate(blocks):
        end = at
        while n:
            n -= audit[end] != "I"
            end += 1
        if i == len(blocks) - 1:
            end = len(audit)
        piece = audit[at:end]
        yield dict.fromkeys(_EDITS.names) | {"conv_id": runs[0]["conv_id"], "part": part, "block": seq, "edits": piece, "place": place, "odd": odd} | (told if i == 0 else {})
        place += len(piece) - piece.count("D")
        at = end


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, out = [], []
    for batch in batches:
        for row in batch.to_pylist():
            if runs and runs[0]["conv_id"] != row["conv_id"]:
                out.extend(_parsed(runs))
                runs = []
            runs.append(row)
        yield pa.RecordBatch.from_pylist(out, _EDITS)
        out = []
    if runs:
        out.extend(_parsed(runs))
    yield pa.RecordBatch.from_pylist(out, _EDITS)


_TURNS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("seq", pa.int64()), ("turns", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])))])


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            out = []
            for x in batch.slice(k, 256).to_pylist():
                turns, place, at, left = [], x["place"], 0, 0
                for edit in x["edits"]:
                    if edit == "I":
                        turns.append({"edit": edit, "role": output_role(place, x["odd"], ""), "text": ""})
                        place += 1
                        continue
                    row = x["rows"][at]
                    left = left or row["n"]
                    if edit != "D":
                        turns.append({"edit": edit, "role": row["role"] if edit == "K" else output_role(place, x["odd"], ""), "text": row["text"]})
                        place += 1
                    left -= 1
                    at += not left
                out.append({"conv_id": x["conv_id"], "part": x["part"], "seq": x["seq"], "turns": turns})
            yield pa.RecordBatch.from_pylist(out, _TURNS)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, turns) of conversations (conv_id, turn, role, text).

    audits: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row for each conversation that has rows.
    turns: conv_id, part, seq, turns: the repaired turns (edit, role, text) in blocks that part and seq order.
    Rows go by turn (nulls first), then role and text; a row's first fault counts: blank, duplicate (of an earlier row's role
    and text), truncated. Null roles and texts count as one space, rows without a conv_id are one conversation, equal rows
    are duplicates of the first; roles of other initials can be given a role or go. An empty table gives two empty ones;
    other columns are not read. A block holds 256 rows or 1 MB, or one row; an audit is one string, as long as its
    conversation has rows. Sorted blocks and the edits are written to the shared folder.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), space("role"), space("text"))
    # The first row of each role and text is marked by grouping, not by a join, so that a text said over and over is no hot
    # key; the marks travel with a hash in place of the text.
    rows = rows.withColumn("sum", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    first = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn"))["turn"]
    marks = rows.groupBy("conv_id", "role", "sum").agg(first.alias("turn")).withColumns({"text": F.lit(None).cast("string"), "n": F.lit(0), "is_first": F.lit(True)})
    rows = rows.withColumns({"n": F.lit(1), "is_first": F.lit(False)}).unionByName(marks)
    rows = rows.groupBy("conv_id", "turn", "role", "sum").agg(F.max("text").alias("text"), F.sum("n").alias("n"), F.max("is_first").alias("is_first")).drop("sum")
    key = ["conv_id", "turn", "role", "text"]
    said = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    rows = rows.withColumn("is_blank", said == "").withColumn("is_cut", ~said.rlike(r"[.!?]\z"))
    blocks = materialised(rows.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_blocks, _BLOCKS_DDL))
    runs = blocks.where(F.col("costs").isNotNull()).select("conv_id", "part", "seq", "sizes", "costs", "audits", "ends", "counts", "turns")
    edits = materialised(runs.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_conversations, _EDITS_DDL))
    audits = edits.where(F.col("cost").isNotNull()).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    where = edits.select(F.col("part").alias("e_part"), F.col("block").alias("e_block"), "edits", "place", "odd")
    found = blocks.select("conv_id", "part", "seq", "rows").join(where, (F.col("part") == F.col("e_part")) & (F.col("seq") == F.col("e_block"))).drop("e_part", "e_block")
    turns = found.mapInArrow(_applied, "conv_id bigint, part bigint, seq bigint, turns array<struct<edit:string, role:string, text:string>>")
    return audits, turns


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of `role:text` of the repaired turns, joined by line ends.

    The blocks of a conversation stream in order through one task, which holds one of them at a time.
    """
    import hashlib

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chain, begun = None, None, False
        for batch in batches:
            ids, sums = [], []
            for k in range(0, batch.num_rows, 256):
                for x in batch.slice(k, 256).to_pylist():
                    if chain is None or x["conv_id"] != now:
                        if chain is not None:
                            ids.append(now)
                            sums.append(chain.hexdigest())
                        now, chain, begun = x["conv_id"], hashlib.sha256(), False
                    for t in x["turns"]:
                        chain.update(f"{chr(10) * begun}{t['role']}:{t['text']}".encode())
                        begun = True
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], ["conv_id", "repaired_sha256"])
        if chain is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([chain.hexdigest()])], ["conv_id", "repaired_sha256"])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return ordered.mapInArrow(read, "conv_id bigint, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by their ids: one in twenty each is lost, emptied, without sentence ends, doubled, or said by the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind: Column = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")
