"""Near-duplicate detection by min-max hashing.

Of each permutation both the smallest and the largest value over a document's shingles are kept, so that half the
hash evaluations give the signature; a band takes minima and maxima of different permutations. Documents with the
same shingle set are collapsed first. Candidates are the pairs in a band bucket, in two rounds:

1. each document with the smallest leader of its buckets: one pair for each document;
2. where a bucket still holds several components, every pair of two components whose signatures allow the similarity;
   the members of such pairs meet again with their shingle sets, in blocks of the bucket, and only links leave a block.

The links of each round, confirmed on the full shingle sets, join documents into components, so that a group of
copies costs a multiple of its size, while each candidate pair is either confirmed, refuted, or within a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderata.llm import flat
from moderata.llm.shared import materialised

U64 = np.uint64
#: 128 permutations give 256 values: 42 bands of 6. A pair at similarity 0.8 is missed with probability 3e-6.
PERMUTATIONS, BANDS, ROWS = 128, 42, 6
#: A pair is refuted without its sets if fewer of its 256 values agree than at 6 standard deviations below the
#: similarity asked for (probability 1e-9).
DEVIATIONS = 6
#: Members of a bucket, and their shingles, in one group of the search; a larger bucket is searched block against block.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
_MULTIPLY = np.random.default_rng(7).integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * U64(2) + U64(1)


def shingles(body: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, and their offsets; a text of fewer words has its whole sequence as one."""
    body = flat.LOWER[body]
    starts, ends, before = flat.word_bounds(body, offsets, flat.NOT_SPACE)
    words = flat.word_hashes(body, starts, ends)
    n = np.diff(before)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    at = np.cumsum(count) - count
    first = np.arange(count.sum()) + np.repeat(before[:-1] - at, count)
    size = np.repeat(np.minimum(n, width), count)
    out = size.astype(U64)
    for k in range(width):
        has = size > k
        out = np.where(has, flat.mix(out + words[np.minimum(first + k, max(len(words) - 1, 0))]), out) if len(words) else out
    return out, np.concatenate((at, [count.sum()]))


def signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes, a byte of each minimum and maximum), a row for each slice of distinct shingles; slices must not be empty."""
    both = np.empty((len(offsets) - 1, 2 * PERMUTATIONS), U64)
    for k in range(PERMUTATIONS):
        x = values * _MULTIPLY[k]
        x ^= x >> U64(32)
        both[:, 2 * k] = np.minimum.reduceat(x, offsets[:-1])
        both[:, (2 * k + PERMUTATIONS + 1) % (2 * PERMUTATIONS)] = np.maximum.reduceat(x, offsets[:-1])
    bands = np.empty((len(both), BANDS), U64)
    for b in range(BANDS):
        h = np.full(len(both), b + 1, U64)
        for r in range(ROWS):
            h = flat.mix(h + both[:, b * ROWS + r])
        bands[:, b] = h
    return bands, (flat.mix(both) & U64(255)).astype(np.uint8)


def _sketch(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.steps(batch, "text"):
                values, offsets = shingles(*flat.flatten(part.column("text")), width)
                sets = list(flat.distinct_slices(values, offsets))
                n = np.array([len(x) for x in sets], np.int64)
                some = np.flatnonzero(n)
                bands = np.zeros((len(n), BANDS), np.int64)
                bytes_ = np.zeros((len(n), 2 * PERMUTATIONS), np.uint8)
                keys = np.zeros((len(n), 2), np.int64)
                if len(some):
                    every, at = np.concatenate(sets), np.concatenate(([0], np.cumsum(n[some])))
                    hashes, bytes_[some] = signatures(every, at)
                    bands[some] = hashes.view(np.int64)
                    keys[some, 0] = np.add.reduceat(flat.mix(every), at[:-1]).view(np.int64)
                    keys[some, 1] = np.add.reduceat(flat.mix(every * U64(0xD6E8FEB86659FD93)), at[:-1]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists, pa.array([x.tobytes() for x in bytes_], pa.binary())], ["id", "n", "k1", "k2", "bands", "signature"])

    return sketch


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in flat.steps(batch, "text"):
                values = flat.distinct_slices(*shingles(*flat.flatten(part.column("text")), width))
                packed = [x.tobytes() for x in values]  # all 64 bits of every hash
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(packed, pa.binary())], ["id", "hashes"])

    return sets


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, U64)


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.sort(np.concatenate((a, b)))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _similar(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(_unpacked(a.as_buffer()), _unpacked(b.as_buffer()), percent) for a, b in zip(batch.column("a_hashes"), batch.column("b_hashes"), strict=True)]
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["u", "v"])

    return similar


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each end of the edges (u, v).

    Alternates the large-star and small-star steps until the edges are stars; each step is an aggregation and a join,
    so that a hub is summed before it is shuffled, and is written to the shared folder.
    """
    edges = materialised(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(least, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = materialised(small)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now


_MEMBER = "band bigint, asker int, holder int, id bigint, n bigint, component bigint, asks boolean, signature binary"


def _candidates(table: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a block that ask, each with the rows of other components whose signatures and sizes allow the similarity."""
    values, share = 2 * PERMUTATIONS, percent / 100
    least = int(values * share - DEVIATIONS * (values * share * (1 - share)) ** 0.5)
    n, component, asks = (table.column(c).to_numpy() for c in ("n", "component", "asks"))
    signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(table.num_rows, values)
    held = np.flatnonzero(~asks)
    for i in np.flatnonzero(asks).tolist():
        fits = (component[held] != component[i]) & (100 * np.minimum(n[held], n[i]) >= percent * np.maximum(n[held], n[i]))
        some = held[fits]
        some = some[(signature[some] == signature[i]).sum(axis=1) >= least]
        if len(some):
            yield i, some


def _search(percent: int) -> Callable[[pa.Table], pa.Table]:
    """The rows of a block that are in a candidate pair."""

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        used = np.zeros(table.num_rows, bool)
        for i, some in _candidates(table, percent):
            used[i] = True
            used[some] = True
        return table.filter(pa.array(used)).select([x.split()[0] for x in _MEMBER.split(", ")])

    return search


def _confirm(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Links of a block, by the full sets; a pair that earlier links of the block have joined is not needed."""

    def confirm(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, component = table.column("id").to_numpy(), table.column("component").to_numpy()
        sets = [_unpacked(x) for x in table.column("hashes").to_pylist()]
        root = {c: c for c in component.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        u, v = [], []
        for i, some in _candidates(table, percent):
            for j in some.tolist():
                a, b = find(int(component[i])), find(int(component[j]))
                if a != b and _alike(sets[i], sets[j], percent):
                    root[max(a, b)] = min(a, b)
                    u.append(int(ids[i]))
                    v.append(int(ids[j]))
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return confirm


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept): groups of texts linked by shingle sets of similarity percent / 100 or more.

    component_id is the smallest id reachable through links, kept marks the document with that id. A text without
    words (null, empty, white space) has no shingles and is linked with nothing. One row for each row; rows that share
    an id are one node of the graph; rows without an id stay alone, with a null component, and are kept. An empty table
    gives an empty result. Integer ids only. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    sketches = materialised(source.mapInArrow(_sketch(width), "id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>, signature binary"))
    named = sketches.where("id is not null and n > 0")
    # One representative for each set; copies are links to it.
    first = materialised(named.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    copies = named.select("id", "k1", "k2", "n").join(first.where("last > rep").select("k1", "k2", "n", "rep"), ["k1", "k2", "n"]).where("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    copies = materialised(copies)
    # By set and id: an id whose one text is a copy may still be the representative of another.
    reps = named.join(first.select("k1", "k2", "n", F.col("rep").alias("id")), ["k1", "k2", "n", "id"], "left_semi")
    banded = reps.select("id", F.col("n").cast("int").alias("n"), F.explode("bands").alias("band"))
    leads = banded.groupBy("band").agg(F.min("id").alias("lead"), F.count("*").alias("members")).where("members > 1").select("band", "lead")
    members = materialised(banded.join(leads, "band"))
    signed = reps.select("id", "signature").distinct()
    # The sets of all that are in a bucket with others, once. The same plan at every size: the text is shuffled by id.
    wanted = members.select("id").distinct()
    sets = source.join(wanted.hint("merge"), "id", "left_semi").mapInArrow(_sets(width), "id bigint, hashes binary").where(F.length("hashes") > 0)
    sets = materialised(sets)

    led = materialised(members.where("id != lead").groupBy(F.col("id").alias("b")).agg(F.min("lead").alias("a")))
    own = led.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("b_hashes")).hint("merge"), "b")
    both = own.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("a_hashes")).hint("merge"), "a")
    links = materialised(both.mapInArrow(_similar(percent), "u bigint, v bigint"))

    labelled = members.select("band", "id", "n").join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    parts = labelled.groupBy("band", "component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    largest = F.max_by(F.struct("component", "size", "shingles"), F.struct("size", "component"))
    mixed = parts.groupBy("band").agg(largest.alias("largest"), F.sum("size").alias("members"), F.sum("shingles").alias("shingles"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda size, shingles: F.greatest(F.lit(1), F.ceil(size / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.select("band", F.col("largest.component").alias("largest"), blocks(F.col("members") - F.col("largest.size"), F.col("shingles") - F.col("largest.shingles")).alias("askers"), blocks(F.col("members"), F.col("shingles")).alias("holders"))
    labelled = labelled.join(mixed, "band").join(signed, "id")
    block = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    columns = ["id", F.col("n").cast("bigint").alias("n"), "component"]
    # All but the largest component ask, every member is held; large buckets in blocks of both, so that a bucket costs its
    # members times the blocks of those that ask, and no more than its members where few are left to ask.
    asking = labelled.where("component != largest").select("band", block("askers").alias("asker"), every("holders").alias("holder"), *columns, F.lit(True).alias("asks"), "signature")
    holding = labelled.select("band", every("askers").alias("asker"), block("holders").alias("holder"), *columns, F.lit(False).alias("asks"), "signature")
    found = materialised(asking.unionByName(holding).groupBy("band", "asker", "holder").applyInArrow(_search(percent), _MEMBER))
    more = found.join(sets, "id").groupBy("band", "asker", "holder").applyInArrow(_confirm(percent), "u bigint, v bigint")
    links = links.unionByName(materialised(more.distinct()))
    # Copies of one set follow their representative, so that they take no part in the rounds of the search for components;
    # only ids of several sets are nodes that link their representatives.
    both = copies.unionByName(first.select(F.col("rep").alias("u"), F.col("rep").alias("v")))
    homes = materialised(both.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("other")).where("u != v or v != other"))
    knots = copies.join(homes.where("v != other").select("u"), "u", "left_semi")
    linked = materialised(components(links.unionByName(knots)))
    follow = homes.where("v = other").join(linked.withColumnRenamed("id", "v"), "v", "left").select(F.col("u").alias("id"), F.coalesce("component", "v").alias("component"))
    groups = linked.unionByName(follow)
    return (
        sketches.select("id", F.col("n").alias("n_shingles"))
        .join(groups, "id", "left")
        .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, every column kept, without those that are linked to one of a smaller id.

    Rows that share the id of a dropped document go with it; rows without an id stay.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
    gone = found.where(~F.col("kept")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
