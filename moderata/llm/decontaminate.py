"""Benchmark decontamination with an FM-index for each shard of the training texts.

A shard is a run of whole documents inside one Spark partition. Its words become ids of the benchmark's
vocabulary; runs of known words that are too short to hold any window are left out, the rest is indexed:
suffix order -> Burrows-Wheeler transform -> wavelet matrix. All windows of the benchmark are searched backwards
at once, their occurrences located through sampled suffix positions, and the hit words merged into spans.
No shuffle: a document never leaves its partition, so hot sources and long documents cost what their bytes cost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from moderata.llm import flat

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of benchmark text that are sent to the tasks at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 4 << 20
SAMPLE = 8


@dataclass(frozen=True)
class Phrases:
    """The distinct windows of a block of benchmark items, as word ids; ids start from 1."""

    vocabulary: np.ndarray  # sorted word hashes; the id of a word is its rank + 1
    windows: dict[int, np.ndarray]  # by number of words: a row for each distinct window
    items: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: offsets into, and numbers of, the items
    names: list[str]


def phrases(rows: list[tuple[str | None, str | None]], size: int = 10) -> Phrases:
    """Windows of `size` consecutive words; a shorter item that has words is one window."""
    hashes: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[int]]] = {}
    names: dict[str, int] = {}
    for name, text in rows:
        words = WORD.findall((text or "").encode().lower())
        ids = [hashes.setdefault(w, len(hashes)) for w in words]
        if not ids:
            continue
        item = names.setdefault("" if name is None else str(name), len(names))
        n = min(size, len(ids))
        for i in range(len(ids) - n + 1):
            found.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), set()).add(item)
    body = b" ".join(hashes)
    starts, ends, _ = flat.word_bounds(np.frombuffer(body, np.uint8), np.array([0, len(body)]), flat.ALNUM)
    raw = flat.word_hashes(np.frombuffer(body, np.uint8), starts, ends)
    vocabulary = np.sort(raw)
    ids_of = np.searchsorted(vocabulary, raw) + 1
    windows = {n: ids_of[np.array(list(w), np.int64)] for n, w in found.items()}
    items = {}
    for n, w in found.items():
        lists = [sorted(x) for x in w.values()]
        items[n] = (np.cumsum([0, *map(len, lists)]), np.concatenate([np.array(x, np.int64) for x in lists]))
    return Phrases(vocabulary, windows, items, list(names))


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence whose last value is smaller than all others, by doubling."""
    rank, k = np.unique(seq, return_inverse=True)[1].astype(np.int64), 1
    while True:
        after = np.zeros_like(rank)
        after[:-k] = rank[k:] + 1
        key = rank * (len(seq) + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty_like(rank)
        new[order] = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        if new.max() == len(seq) - 1:
            return order
        rank, k = new, k * 2


class FMIndex:
    """Backward search, rank and locate over a sequence of ids >= 0, of which 0 separates runs; the terminal is added here.

    For the suffix order each separator is a symbol of its own, so that doubling ends at the longest run. Searches and
    steps to the left never cross one: the first position of each run is sampled besides every SAMPLE-th.
    """

    def __init__(self, seq: np.ndarray, sigma: int):
        between = seq == 0
        order = suffix_order(np.concatenate((np.where(between, np.cumsum(between), between.sum() + seq), [0])))
        seq = np.concatenate((seq + 1, [0]))
        last = seq[order - 1]
        self.n, self.levels = len(seq), max(1, int(sigma + 1).bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma + 2))))
        self.zeros, self.ranks, values = [], [], last
        for level in range(self.levels - 1, -1, -1):  # a wavelet matrix: one bit vector with rank sums for each level
            bit = (values >> level) & 1
            self.ranks.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(len(bit) - int(self.ranks[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))
        self.sampled = np.flatnonzero((order % SAMPLE == 0) | (last <= 1))
        self.positions = order[self.sampled]
        self.is_sampled = np.zeros(self.n, bool)
        self.is_sampled[self.sampled] = True
        self.last = last

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place of the transform."""
        low, high = np.zeros_like(upto), upto
        for level, zeros, ones in zip(range(self.levels - 1, -1, -1), self.zeros, self.ranks, strict=True):
            bit = (symbol >> level) & 1 == 1
            low, high = np.where(bit, zeros + ones[low], low - ones[low]), np.where(bit, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each row of words; empty where it doesn't occur."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        alive = np.arange(len(words))
        for column in range(words.shape[1] - 1, -1, -1):
            c = words[alive, column] + 1
            low[alive], high[alive] = self.before[c] + self.rank(c, low[alive]), self.before[c] + self.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the transform: steps to the left until a sampled one."""
        rows, out, walked, open_ = rows.copy(), np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(open_):
            done = self.is_sampled[rows[open_]]
            hit = open_[done]
            out[hit] = self.positions[np.searchsorted(self.sampled, rows[hit])] + walked
            open_ = open_[~done]
            c = self.last[rows[open_]]
            rows[open_] = self.before[c] + self.rank(c, rows[open_])
            walked += 1
        return out


def shard_hits(body: np.ndarray, offsets: np.ndarray, block: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words before each text, word starts, word ends, hit word flags, sorted distinct text * items + item)."""
    body = flat.LOWER[body]
    starts, ends, before = flat.word_bounds(body, offsets, flat.ALNUM)
    hit = np.zeros(len(starts) + 1, np.int32)
    pairs = np.zeros(0, np.int64)
    if len(starts) and block.windows:
        hashes = flat.word_hashes(body, starts, ends)
        place = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
        ids = np.where(block.vocabulary[place] == hashes, place + 1, 0)
        text = np.searchsorted(before, np.arange(len(starts)), side="right") - 1
        # Maximal runs of known words within a text that are long enough for the shortest window.
        known = ids > 0
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (known[1:] != known[:-1])))
        run_at = np.flatnonzero(new)
        run_n = np.diff(np.concatenate((run_at, [len(ids)])))
        keep = known[run_at] & (run_n >= min(block.windows))
        run_at, run_n = run_at[keep], run_n[keep]
        if len(run_at):
            total = int((run_n + 1).sum())
            new_at = np.cumsum(run_n + 1) - (run_n + 1)
            word = np.full(total, -1, np.int64)
            shift = np.repeat(run_at - new_at, run_n + 1)
            word = np.arange(total) + shift
            word[new_at + run_n] = -1
            seq = np.where(word >= 0, ids[word], 0)
            index = FMIndex(seq, len(block.vocabulary))
            for n, windows in block.windows.items():
                low, high = index.search(windows)
                count = high - low
                which = np.repeat(np.arange(len(windows)), count)
                rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                at = word[index.locate(rows)]
                np.add.at(hit, at, 1)
                np.add.at(hit, at + n, -1)
                starts_of, numbers = block.items[n]
                k = np.diff(starts_of)[which]
                each = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(starts_of[which], k)
                pairs = np.union1d(pairs, np.repeat(text[at], k) * len(block.names) + numbers[each])
    return before, starts, ends, np.cumsum(hit[:-1]) > 0, pairs


SPANS = "array<struct<start:bigint,end:bigint>>"
SPANS_TYPE = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """(id, n_words, spans, n_hit, items[, text]): the words of each text that lie in an occurrence of a benchmark window.

    spans: byte ranges of the maximal runs of hit words, white space between them included; items: ids of the items
    with occurring windows, sorted as strings. Null or empty texts have no words and no hits; a null item id counts
    as the empty string; repeated ids are rows of their own; an empty benchmark hits nothing. Other columns of the
    inputs are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    out = f"id {kind}, n_words bigint, n_hit bigint, spans {SPANS}, items array<string>"
    found = docs
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        sent = spark.sparkContext.broadcast(phrases([(r["item_id"], r["text"]) for r in rows], window))
        carry = keep_text or k < blocks - 1  # every block is judged on the input text
        found = found.mapInArrow(lambda batches, sent=sent, carry=carry: _scan(batches, sent.value, carry), out + ", text string" * carry)
    return found.withColumnRenamed("id", id_col)


def _earlier(spans: pa.Array, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words in the spans that earlier blocks have found."""
    owner = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy(zero_copy_only=False))
    flat_spans = spans.flatten()
    a, b = (x.to_numpy(zero_copy_only=False) + offsets[owner] for x in flat_spans.flatten())
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, np.searchsorted(starts, a), 1)
    np.add.at(edge, np.searchsorted(ends, b) + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _spans(rows: int, offsets: np.ndarray, before: np.ndarray, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray) -> pa.Array:
    """The maximal runs of hit words of each text, as byte ranges."""
    text = np.searchsorted(before, np.arange(len(starts)), side="right") - 1
    edge = np.zeros(len(starts) + 1, bool)
    edge[before] = True
    first = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate(([False], hit[:-1])))) if len(hit) else np.zeros(0, np.int64)
    last = np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False])))) if len(hit) else first
    owner = text[first] if len(first) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(starts[first] - offsets[owner], pa.int64()), pa.array(ends[last] - offsets[owner], pa.int64())], ["start", "end"]),
    )


def _scan(batches: Iterator[pa.RecordBatch], block: Phrases, keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in flat.steps(batch, "text", SHARD_BYTES):
            body, offsets = flat.flatten(part.column("text"))
            before, starts, ends, hit, pairs = shard_hits(body, offsets, block)
            items: list[set[str]] = [set() for _ in range(part.num_rows)]
            if "spans" in part.schema.names:
                hit = hit | _earlier(part.column("spans"), offsets, starts, ends)
                items = [set(x) for x in part.column("items").to_pylist()]
            upto = np.concatenate(([0], np.cumsum(hit)))
            spans = _spans(part.num_rows, offsets, before, starts, ends, hit)
            for pair in pairs.tolist():
                items[pair // len(block.names)].add(block.names[pair % len(block.names)])
            columns = [part.column("id"), pa.array(np.diff(before), pa.int64()), pa.array(np.diff(upto[before]), pa.int64()), spans, pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            names = ["id", "n_words", "n_hit", "spans", "items"]
            yield pa.RecordBatch.from_arrays(columns + [part.column("text")] * keep_text, names + ["text"] * keep_text)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, every column kept, with the hit words cut out of the text.

    A text without hits (null included) is returned as it is. One pass over the rows, no shuffle; every block of the
    benchmark is judged on the input text, and what any of them hits is cut at the end.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    spans = max(["spans", *docs.columns], key=len) + "_"  # no column has that name
    given = docs.schema
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        sent = spark.sparkContext.broadcast(phrases([(r["item_id"], r["text"]) for r in rows], window))
        last = k == blocks - 1
        docs = docs.mapInArrow(lambda batches, sent=sent, last=last: _cut(batches, sent.value, text_col, spans, last), given if last else StructType([*given, StructField(spans, SPANS_TYPE)]))
    return docs


def _cut(batches: Iterator[pa.RecordBatch], block: Phrases, column: str, spans: str, last_block: bool) -> Iterator[pa.RecordBatch]:
    """The rows with the hit words of all blocks cut out; before the last block, with these words as spans in one more column."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        for part in flat.steps(batch, column, SHARD_BYTES):
            body, offsets = flat.flatten(part.column(at))
            before, starts, ends, hit, _ = shard_hits(body, offsets, block)
            if spans in part.schema.names:
                hit = hit | _earlier(part.column(spans), offsets, starts, ends)
                part = part.select([n for n in part.schema.names if n != spans])
            if not last_block:
                found = _spans(part.num_rows, offsets, before, starts, ends, hit)
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*part.schema.names, spans])
                continue
            text = np.searchsorted(before, np.flatnonzero(hit), side="right") - 1
            if len(text):
                values = part.column(at).to_pylist()
                for i in np.unique(text).tolist():
                    a, b = before[i], before[i + 1]
                    h = hit[a:b]
                    first = np.flatnonzero(h & ~np.concatenate(([False], h[:-1])))
                    last = np.flatnonzero(h & ~np.concatenate((h[1:], [False])))
                    values[i] = flat.without(body_of(body, offsets, i), starts[a:b][first] - offsets[i], ends[a:b][last] - offsets[i]).decode()
                part = part.set_column(at, part.schema.field(at), pa.array(values, part.schema.field(at).type))
            yield part


def body_of(body: np.ndarray, offsets: np.ndarray, i: int) -> np.ndarray:
    return body[offsets[i] : offsets[i + 1]]
