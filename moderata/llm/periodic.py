"""Periodic runs of words, found on the diagonals of each text's comparison with itself.

A diagonal is a lag; at each word, the earlier places where it also stands say which lags match on, and a lag that stops
matching ends its diagonal: if it is long enough, the run is told. Online, a stretch of words at a time; only active lags
are kept between stretches. Two cuts of the work lose nothing:

* A run of `least` words or two periods matches on at least half of `least` words in a row, so that the places looked up
  are those where that many words stand again; in most texts there are none.
* In the middle of a run of period p, lags beyond 2p within that run are multiples of p, which add nothing, or matches of
  fewer than p words. They are left out where a text repeats so much that its pairs exceed one stretch. Of any other run's
  diagonal some pair lies outside such runs (two runs that overlap by their periods are one), which brings up its lag, and
  the diagonals of the lags that came up are then compared word by word.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moderata.llm import flat

U64 = np.uint64
#: Matching pairs of places that are held at once.
PAIRS = 1 << 20
STEP_BYTES = 1 << 22

Run = tuple[int, int, int]


def _spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, x) for each x in lo[k]..hi[k]-1."""
    n = hi - lo
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + lo[k]


def _stretches(matched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each stretch of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], matched.view(np.int8), [0]))))
    return edge[::2], edge[1::2] - 1


class _Diagonals:
    """The active diagonals of one text and what has ended."""

    def __init__(self, size: int, least: int, gram: int) -> None:
        self.size, self.least, self.gram = size, least, gram
        self.first = np.full(size, -1, np.int64)  # of each active lag, where it began to match
        self.active = np.zeros(0, np.int64)
        self.ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def enough(self, lag: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return last - first + self.gram >= np.maximum(self.least - lag, lag)

    def advance(self, a: int, b: int, lag: np.ndarray, i: np.ndarray) -> None:
        """The matches (place, lag) of places a to b-1."""
        key = np.sort(lag * self.size + i)
        new = np.concatenate(([True], np.diff(key) != 1)) if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        lag, first = np.divmod(key[at], self.size)
        last = first + np.diff(np.concatenate((at, [len(key)]))) - 1
        on = (first == a) & (self.first[lag] >= 0)
        first = np.where(on, self.first[lag], first)
        over = np.setdiff1d(self.active, lag[on], assume_unique=True)
        self.ended.append((over, self.first[over], np.full(len(over), a - 1)))
        self.first[self.active] = -1
        stays = last == b - 1
        self.active = lag[stays]
        self.first[self.active] = first[stays]
        self.ended.append((lag[~stays], first[~stays], last[~stays]))

    def finish(self, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.ended.append((self.active, self.first[self.active], np.full(len(self.active), end - 1)))
        return tuple(np.concatenate(x) for x in zip(*self.ended, strict=True))


def runs_of(grams: np.ndarray, least: int, gram: int, pairs: int = PAIRS) -> list[Run]:
    """(start, length, period) of the runs of a text, by start and period; grams: a hash of the `gram` words from each word on."""
    size = len(grams)
    if size + gram - 1 < least:
        return []
    order = np.argsort(grams, kind="stable")
    fresh = np.concatenate(([True], grams[order][1:] != grams[order][:-1]))
    if fresh.all():
        return []
    group = np.empty(size, np.int64)
    group[order] = np.cumsum(fresh) - 1
    key = group[order] * size + order  # the places of each gram, in order
    begin, own = np.flatnonzero(fresh)[group], np.empty(size, np.int64)
    own[order] = np.arange(size)
    total = np.cumsum(own - begin)
    diagonals, a, skipped = _Diagonals(size, least, gram), 0, False
    while a < size:
        b, inside = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + pairs, side="right"))), None
        if b < size and a:
            inside = _longest(grams, diagonals, a)
        if inside is not None and inside[0] > b:
            end, start, period = inside
            skipped = True
            # The places before this run, and those at most two periods back.
            for c in range(a, end, max(1, pairs // (4 * period))):
                i = np.arange(c, min(end, c + max(1, pairs // (4 * period))))
                before = np.searchsorted(key, group[i] * size + start)
                near = np.searchsorted(key, group[i] * size + np.maximum(i - 2 * period, start))
                found = [_spans(lo, hi) for lo, hi in ((begin[i], before), (near, own[i]))]
                k, at = (np.concatenate(x) for x in zip(*found, strict=True))
                diagonals.advance(c, int(i[-1]) + 1, i[k] - order[at], i[k])
            a = end
            continue
        i = np.arange(a, b)
        k, at = _spans(begin[i], own[i])
        diagonals.advance(a, b, i[k] - order[at], i[k])
        a = b
    lag, first, last = diagonals.finish(size)
    if skipped:
        lag, first, last = _compared(grams, np.unique(lag[2 * lag <= size + gram - 1]))
    enough = diagonals.enough(lag, first, last)
    smallest: dict[tuple[int, int], int] = {}
    for q, x, y in zip(lag[enough].tolist(), first[enough].tolist(), last[enough].tolist(), strict=True):
        stretch = (x - q, y + gram)
        smallest[stretch] = min(smallest.get(stretch, q), q)
    return sorted((start, end - start, q) for (start, end), q in smallest.items())


def _longest(grams: np.ndarray, diagonals: _Diagonals, a: int) -> tuple[int, int, int] | None:
    """(end, start, period) of the active run of three periods or more that goes on longest."""
    lag = np.sort(diagonals.active)
    lag = lag[a - diagonals.first[lag] >= 2 * lag][:16]
    found = []
    for q in lag.tolist():
        other = np.flatnonzero(grams[a:] != grams[a - q : -q])
        found.append((a + int(other[0]) if len(other) else len(grams), int(diagonals.first[q]) - q, q))
    return max(found, key=lambda x: (x[0], -x[2])) if found else None


def _compared(grams: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whole diagonals of some lags."""
    out = []
    for q in lags.tolist():
        first, last = _stretches(grams[q:] == grams[:-q])
        out.append((np.full(len(first), q), first + q, last + q))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words, joined by spaces, without what repeats a run's first period."""
    if not runs:
        return b" ".join(words)
    cut = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cut[start + period] += 1
        cut[start + length] -= 1
    return b" ".join(itertools.compress(words, (np.cumsum(cut[:-1]) == 0).tolist()))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """(id, n_words, runs, collapsed): runs array<struct<start, length, period>> of each whole text, by start and period.

    A run is a stretch of words with smallest period q, of at least `least` words and two periods, that no neighbouring
    word extends; collapsed is the text without what follows a run's first period in it, words joined by single spaces.
    Words are told apart by 64-bit hashes. One row for each row (repeated ids too), no shuffle; null and empty texts have
    no words; other columns are not read. A text costs a multiple of its size in memory, however often it repeats.
    """
    gram = max(1, (least + 1) // 2)
    kind = docs.schema[id_col].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in flat.steps(batch, "text", STEP_BYTES):
                body, offsets = flat.flatten(part.column("text"))
                starts, ends, before = flat.word_bounds(body, offsets, flat.NOT_SPACE)
                hashes = flat.word_hashes(body, starts, ends)
                grams = np.zeros(max(0, len(hashes) - gram + 1), U64)
                for k in range(gram):
                    grams = flat.mix(grams + hashes[k : k + len(grams)])
                counts, found, texts = np.diff(before), [], []
                for d, n in enumerate(counts.tolist()):
                    runs = runs_of(grams[before[d] : before[d] + n - gram + 1], least, gram) if n >= least else []
                    found.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                    # Bytes are split at the very characters that end a word here.
                    texts.append(collapsed(body[offsets[d] : offsets[d + 1]].tobytes().split(), runs))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.array(found, item), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(find, f"id {kind}, n_words bigint, runs array<struct<start:bigint, length:bigint, period:bigint>>, collapsed string").withColumnRenamed("id", id_col)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the runs of documents."""
    best = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """One in ten documents, by the checksum of its id, with its words from some place on repeating; a row without an id stays as it is."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), checksum.alias("h"))

    def repeated(words: Column) -> Column:
        n, g = F.size(words), F.floor(F.col("h") / 10)
        start = g % n
        period = 1 + F.floor((n - start) / (3 + g % 8))
        place = lambda i: F.when(i < start, i).otherwise(start + (i - start) % period).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i))), " ")

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), 1)
    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, changed).otherwise(F.col("text")).alias("text"))
