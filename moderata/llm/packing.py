"""Best-fit packing of tokenized documents into sequences, in bulk-synchronous sweeps.

Pieces of one length are interchangeable, and so are sequences with one gap. So documents and gaps are kept as
classes (length or gap, how many), of which there are at most as many as a sequence has tokens, at any size of the
corpus. Spark counts the classes and ranks every piece within its class in parallel (salted, so that a frequent
length is no hot group); the sweeps over the sorted classes yield intervals (length, ranks -> sequences, offset);
a join on the length hands them back to the pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moderata.llm import bpe, flat
from moderata.llm.shared import materialised
from moderata.llm.token_counts import CHUNK, OVERLAP

STEP_BYTES = 4 << 20
#: Texts up to this size are encoded by their units, which is faster; the memory for that is a multiple of it.
LONG_BYTES = 1 << 20
#: Documents are placed by falling length; lengths of one band (a share of the capacity) propose at the same time.
BANDS = 64
#: Ranks of a length that are joined with their intervals as one group.
RANKS = 1 << 15


def sweeps(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): where the pieces of each length class go.

    In a superstep every class of the band that still has pieces takes its successor in the sorted gaps, the smallest
    that holds it. Classes that meet at one gap are ranked by length, the longest first, and served as far as the
    gap's sequences go. Then the gaps are updated and the rest proposes again; what no gap holds opens sequences.
    """
    left = dict(zip(lengths.tolist(), counts.tolist(), strict=True))
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap: [first sequence, how many]
    out, opened, width = [], 0, max(1, capacity // BANDS)
    for top in range(capacity, 0, -width):
        band = [n for n in range(top, max(0, top - width), -1) if left.get(n)]
        while band:
            sizes = np.array(sorted(g for g, runs in gaps.items() if runs and g), np.int64)
            successor = np.searchsorted(sizes, band)
            meet: dict[int, list[int]] = defaultdict(list)
            for n, k in zip(band, successor.tolist(), strict=True):
                if k < len(sizes):
                    meet[int(sizes[k])].append(n)
            if not meet:
                need = -(-sum(n * left[n] for n in band) // capacity)
                gaps[capacity].append([opened, need])
                opened += need
                continue
            updated: list[tuple[int, list[int]]] = []
            for gap, proposers in meet.items():
                runs = gaps[gap]
                for n in proposers:  # the band falls, so the longest comes first
                    while left[n] and runs:
                        first, many = runs[-1]
                        taken = min(many, left[n])
                        out.append((n, rank[n], taken, first, capacity - gap))
                        updated.append((gap - n, [first, taken]))
                        rank[n] += taken
                        left[n] -= taken
                        if taken == many:
                            runs.pop()
                        else:
                            runs[-1] = [first + taken, many - taken]
            for gap, run in updated:
                gaps[gap].append(run)
            band = [n for n in band if left[n]]
    return out


def _encoded(model: bpe.Bpe, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets); a text beyond LONG_BYTES is encoded by overlapping chunks."""
    _, offsets = flat.flatten(texts)
    long = np.diff(offsets) > LONG_BYTES
    ids, at = model.encode(pc.if_else(pa.array(long), "", texts))
    if not long.any():
        return ids, at
    parts = [ids[at[i] : at[i + 1]] for i in range(len(texts))]
    for i in np.flatnonzero(long).tolist():
        parts[i] = np.concatenate([np.array(x, np.uint32) for _, x in model.splices(texts[i].as_py(), CHUNK, OVERLAP)])
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int, end: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): each document's ids and `end`, cut to the capacity; the first piece takes the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(tokenizer)
        for batch in batches:
            for part in flat.steps(batch, "text", STEP_BYTES):
                ids, at = _encoded(model, part.column("text"))
                row, piece, start, length, crc, every = [], [], [], [], [], []
                for i in range(part.num_rows):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end)).astype("<u4")
                    edges = [0, *range((len(own) - 1) % capacity + 1, len(own) + 1, capacity)]
                    for k in range(len(edges) - 1):
                        some = own[edges[k] : edges[k + 1]]
                        row.append(i)
                        piece.append(k)
                        start.append(edges[k])
                        length.append(len(some))
                        crc.append(zlib.crc32(some.tobytes()))
                        if keep_ids:
                            every.append(some.astype(np.int32))
                columns = [part.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(every, pa.list_(pa.int32()))] * keep_ids, ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, tokenizer: str | None = None, *, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every document in sequences of at most `capacity` tokens.

    Only a document longer than a sequence is cut. A null or empty text is its end token. Repeated rows and ids are
    pieces of their own; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    cut = materialised(pieces(docs, tokenizer or bpe.default_path(), capacity=capacity, end=end, id_col=id_col, text_col=text_col, keep_ids=keep_ids))
    salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = materialised(cut.groupBy("length", "salt").agg(F.count("*").alias("n")))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).select("length", "salt", "before")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=pa.schema([("length", pa.int64()), ("n", pa.int64())]))
        found = sweeps(table["length"].to_numpy(), table["n"].to_numpy(), capacity)
        names = ["on_length", "first_rank", "n", "first_sequence", "offset"]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(5)], names)

    classes = counts.groupBy("length").agg(F.sum("n").alias("n")).coalesce(1)
    placed = materialised(classes.mapInArrow(sweep, "on_length bigint, first_rank bigint, n bigint, first_sequence bigint, offset bigint"))
    # The rank is joined in stretches, so that a frequent length is no hot key; nothing is broadcast by hand.
    last = F.col("first_rank") + F.col("n") - 1
    placed = placed.withColumn("on_stretch", F.explode(F.sequence(F.floor(F.col("first_rank") / RANKS), F.floor(last / RANKS))))
    own = Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32")  # rows equal in all four are interchangeable
    ranked = cut.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    ranked = ranked.withColumn("stretch", F.floor(F.col("rank") / RANKS))
    joined = ranked.join(placed, (F.col("length") == F.col("on_length")) & (F.col("stretch") == F.col("on_stretch")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") <= last))
    return joined.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), F.col("offset"))
