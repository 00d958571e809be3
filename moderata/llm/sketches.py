"""Document fingerprints: the hashes of five-word shingles below a fixed fraction of all values.

A shingle is kept or not by its hash alone, so that sketches of different documents, and of documents of very different
length, hold the same part of what they share: they can be merged, and the share of the smaller document that lies in the
larger one is estimated from the two sketches. A text with few shingles below the fraction keeps its smallest ones instead
and says up to which value it is complete; two sketches are compared below the smaller of their bounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderata.llm import flat
from moderata.llm.minhash import shingles
from moderata.llm.shared import materialised

U64 = np.uint64
#: Hashes have 40 bits; those below an eighth of their range are kept, and the 64 smallest at least.
BITS, SHARE, LEAST = 40, 8, 64
WIDTH = 5
FULL = 1 << BITS
STEP_BYTES = flat.STEP_BYTES

#: A sketch: the bound below which it is complete, and its sorted hashes.
Sketch = tuple[int, np.ndarray]


def kept(hashes: np.ndarray, bound: int = FULL) -> Sketch:
    """The sketch of sorted distinct hashes that are complete below the bound."""
    hashes = hashes[: np.searchsorted(hashes, U64(bound))]
    n = int(np.searchsorted(hashes, U64(FULL // SHARE)))
    if n >= LEAST or bound <= FULL // SHARE:
        return FULL // SHARE, hashes[:n]
    return (int(hashes[LEAST]) if len(hashes) > LEAST else bound), hashes[:LEAST]


def sketches(texts: pa.Array, width: int = WIDTH) -> list[Sketch]:
    """The sketch of each text; a text of fewer words than a shingle has its whole sequence as one, without words it has none."""
    values, offsets = shingles(*flat.flatten(texts), width)
    return [kept(x) for x in flat.distinct_slices(flat.mix(values) >> U64(64 - BITS), offsets)]


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of two documents taken together."""
    return kept(np.union1d(a[1], b[1]), min(a[0], b[0]))


def likeness(a: Sketch, b: Sketch) -> float:
    """The estimated share of the smaller document's shingles that the larger one holds; 1 for two documents without any, 0 without evidence."""
    if not len(a[1]) or not len(b[1]):
        return float(len(a[1]) == len(b[1]))
    bound = U64(min(a[0], b[0]))
    x, y = (h[1][: np.searchsorted(h[1], bound)] for h in (a, b))
    if not len(x) or not len(y):
        return 0.0
    both = np.sort(np.concatenate((x, y)))
    return int((both[1:] == both[:-1]).sum()) / min(len(x), len(y))


def packed(sketch: Sketch) -> bytes:
    """Five bytes for the last value below the bound, then five for each hash."""
    values = np.concatenate((np.array([sketch[0] - 1], U64), sketch[1]))
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def difference(own: Sketch, new: Sketch) -> bytes:
    """A sketch as what it lacks and adds against another: a bit for each hash of the other, then its bound and the hashes added."""
    bits = np.packbits(np.isin(own[1], new[1], assume_unique=True)).tobytes()
    return bits + packed((new[0], np.setdiff1d(new[1], own[1], assume_unique=True)))


def changed(own: Sketch, data: bytes) -> Sketch:
    """The sketch that differs so from its own."""
    n = len(own[1])
    bound, added = unpacked(data[(n + 7) // 8 :])
    stays = np.unpackbits(np.frombuffer(data[: (n + 7) // 8], np.uint8), count=n).astype(bool)
    return bound, np.sort(np.concatenate((own[1][stays], added)))


def unpacked(data: bytes) -> Sketch:
    whole = np.zeros((len(data) // 5, 8), np.uint8)
    whole[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    values = whole.reshape(-1).view(">u8").astype(U64)
    return int(values[0]) + 1, values[1:]


#: As written: checksums and sketches as bytes, the edited text's sketch by its difference.
_FIELDS = [("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_DDL = "n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as many characters from the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(texts: list[str], following: list[str], own: list[Sketch], after: list[Sketch]) -> list[pa.Array]:
    after_edit = pa.array([edited(a, b) for a, b in zip(texts, following, strict=True)], pa.large_string())
    new = sketches(after_edit)
    sums = [hashlib.sha256(x.as_buffer() or b"").digest() for x in after_edit]
    near = [[likeness(a, b) for a, b in zip(own, other, strict=True)] for other in (new, after)]
    found = ([len(x) for x in texts], sums, [packed(x) for x in own], [difference(x, y) for x, y in zip(own, new, strict=True)], *near)
    return [pa.array(x, kind) for x, (_, kind) in zip(found, _FIELDS, strict=True)]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next one's text; of a partition's first and last row the text stays, and the last one waits for the next partition."""
    part, held, first = TaskContext.get().partitionId(), None, True

    def told(ids: pa.Array, compared: list[pa.Array], texts: list[str | None], waits: bool) -> pa.RecordBatch:
        n = len(ids)
        place = [pa.array([part] * n, pa.int64()), pa.array([first] + [False] * (n - 1), pa.bool_()), pa.array([waits] * n, pa.bool_())]
        return pa.RecordBatch.from_arrays([ids, *compared, *place, pa.array(texts, pa.string())], ["id", *[x for x, _ in _FIELDS], "part", "first", "waits", "text"])

    for batch in batches:
        for step in flat.steps(batch, "text", STEP_BYTES):
            ids, texts, own = step.column("id"), [x or "" for x in step.column("text").to_pylist()], sketches(step.column("text"))
            if held is not None:
                ids, texts, own = pa.concat_arrays([held[0], ids]), [held[1], *texts], [held[2], *own]
            if len(texts) > 1:
                yield told(ids[:-1], _compared(texts[:-1], texts[1:], own[:-1], own[1:]), [texts[0] if first else None] + [None] * (len(texts) - 2), waits=False)
                first = False
            held = (ids[-1:], texts[-1], own[-1])
    if held is not None:
        yield told(held[0], [pa.nulls(1, kind) for _, kind in _FIELDS], [held[1]], waits=True)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            x = batch.slice(k, 1)
            a, b = x.column("text"), x.column("following")
            yield pa.RecordBatch.from_arrays([x.column("id"), *_compared(a.to_pylist(), b.to_pylist(), sketches(a), sketches(b))], ["id", *[f for f, _ in _FIELDS]])


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints in hexadecimal digits, both whole."""
    for batch in batches:
        own = batch.column("fingerprint").to_pylist()
        new = [packed(changed(unpacked(a), b)).hex() for a, b in zip(own, batch.column("edited_fingerprint").to_pylist(), strict=True)]
        at = batch.schema.get_field_index
        batch = batch.set_column(at("fingerprint"), "fingerprint", pa.array([x.hex() for x in own], pa.string()))
        yield batch.set_column(at("edited_fingerprint"), "edited_fingerprint", pa.array(new, pa.string()))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each whole text.

    The edited text has the last quarter of its characters replaced by the first as many of the next document's, in the
    order of ids (nulls first; rows of one id by the hash of their text), the first document following the last.
    Null texts are empty; an empty text has a fingerprint without hashes, whose likeness to another such is 1, to any
    other 0. Equal texts have equal fingerprints, a single row follows itself, an empty table gives none, other columns
    are not read. One shuffle by ranges of the id; a long text costs its own size in memory. What a partition's last row
    lacks, the next one's first text, is joined afterwards: two rows of each partition.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("by_text"), F.monotonically_increasing_id().alias("copy"), "text")
    order = ["id", "by_text", "copy"]  # the last two split rows of one id
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    found = materialised(ordered.mapInArrow(_in_order, f"id {kind}, {_DDL}, part bigint, first boolean, waits boolean, text string"))
    parts = sorted(x["part"] for x in found.where("waits").select("part").collect())  # one number of each partition
    following = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "own bigint, after bigint")
    # A partition of one row is first and waits at once.
    heads = found.where("first").select(F.col("part").alias("head"), F.col("text").alias("following"))
    last = found.where("waits").select("id", "part", "text").join(following, F.col("part") == F.col("own")).join(heads, F.col("after") == F.col("head"))
    last = last.select("id", "text", "following").mapInArrow(_pairs, f"id {kind}, {_DDL}")
    whole = found.where("not waits").select(*last.columns).unionByName(last).withColumn("edited_sha256", F.lower(F.hex("edited_sha256")))
    return whole.mapInArrow(_shown, f"id {kind}, {_DDL.replace('binary', 'string')}").withColumnRenamed("id", id_col)
