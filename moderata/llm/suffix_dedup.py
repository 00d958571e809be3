"""Repeated passages: every byte covered by a string of `length` bytes that a document of a smaller id also holds.

1. Documents are dealt to parts by their smallest k-gram hash, so that copies tend to meet; where that would make a
   part too large (a group of copies, a frequent passage), it is split by id. That is one shuffle of the text, which
   Spark reuses. Each window of `length` bytes has one anchor, the smallest hash among its k-grams; windows with one
   anchor in a row form a segment. Each part sends the distinct anchors it holds and gets back which of them another
   document holds too.
2. Segments of repeated anchors are resolved within the part first: of equal segments only those of the smallest id
   are sent on, so that a common passage costs one entry for each part, not for each document.
3. All segments of an anchor meet in one bucket, which thus holds every occurrence of their windows. An anchor of more
   than HOT_SEGMENTS segments is split by its windows: each goes, as a hash of its bytes, to a bucket of its own, once for
   each part except where the document of the part's smallest id repeats it. In a bucket of the others a suffix
   order and its Burrows-Wheeler mapping are built over the distinct segments, and intervals of common prefixes are
   extended backwards breadth-first, all of a level at once: level l finds the neighbours that share exactly l bytes,
   and the search ends at `length`. Rows that no level has parted are the occurrences of one window.
4. Ranges go back to the parts, where they are merged and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moderata.llm import flat
from moderata.llm.shared import materialised, text_bytes

U64 = np.uint64
#: Bytes of text that are hashed at once: what a core's cache holds.
HASH_BYTES = 1 << 17
#: Bytes of text of a part, and of the distinct segments of one suffix order (small enough for a core's cache).
PART_BYTES, BLOCK_BYTES = 8 << 20, 1 << 18
#: Segments of an anchor over all parts from which its windows are dealt one by one: about one suffix order.
HOT_SEGMENTS = 1 << 12
#: Bytes of a k-gram. Shorter ones repeat by chance (at 0.2 GB of text, 12 bytes: half of all), longer ones are more anchors.
GRAM = 20
_SYMBOL = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64)
_POSITION = U64((1 << 21) - 1)
LAST_ID = np.iinfo(np.int64).max


def grams(body: np.ndarray) -> np.ndarray:
    """Hashes of all k-grams of 20 bytes, by doubling to 16 and adding 4."""
    h = _SYMBOL[body]
    h = h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]
    h4 = h[:-2] * U64(0xC2B2AE3D27D4EB4F) + h[2:]
    h8 = h4[:-4] * U64(0x165667B19E3779F9) + h4[4:]
    h16 = h8[:-8] * U64(0x27D4EB2F165667C5) + h8[8:]
    return flat.mix(h16[:-4] * U64(0x85EBCA77C2B2AE63) + h4[16:])


def segments(body: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, text number, first window, windows) of all segments; windows are places in body."""
    parts = []
    width = length - GRAM + 1
    for a in range(0, max(0, len(body) - length + 1), HASH_BYTES):
        some = body[a : a + HASH_BYTES + length - 1]
        if len(some) < length:
            break
        h = grams(some)
        least = (h & ~_POSITION) | np.arange(len(h), dtype=U64)
        reach = 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        anchor = (least & _POSITION).astype(np.int64)
        start = np.arange(a, a + len(anchor))
        text = np.searchsorted(offsets, start, side="right") - 1
        inside = start + length <= offsets[text + 1]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1])) & inside
        first = np.flatnonzero(new)
        if len(first):
            upto = np.concatenate(([0], np.cumsum(inside)))
            count = np.diff(np.concatenate((upto[first], [upto[-1]])))
            parts.append((h[anchor[first]], text[first], first + a, count))
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def gathered(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the given ranges, one after the other."""
    total = np.cumsum(sizes)
    return body[np.arange(total[-1] if len(total) else 0) + np.repeat(starts - total + sizes, sizes)]


def hashed(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each range."""
    a, b = np.empty(len(starts), U64), np.empty(len(starts), U64)
    total = np.cumsum(sizes)
    for k in _chunks(total, HASH_BYTES):
        some = gathered(body, starts[k], sizes[k])
        at = np.cumsum(sizes[k]) - sizes[k]
        a[k], b[k] = flat.word_hashes(some, at, at + sizes[k]), flat.word_hashes(some ^ np.uint8(0x5A), at, at + sizes[k])
    return a, b


def distinct(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one range of each content, the content number of each range), by their hashes."""
    a, b = hashed(body, starts, sizes)
    order = np.argsort(a, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = a[order][1:] != a[order][:-1]
    other = np.flatnonzero(~new)
    if (b[order[other]] != b[order[other - 1]]).any():  # two contents of one hash
        order = np.lexsort((b, a))
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def held_by_smaller(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a smaller id has the same pair of hashes."""
    order = np.lexsort((ids, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    gone = np.empty(len(order), bool)
    gone[order] = ids[order] > ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return gone


def _chunks(total: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of rows, given the running sum of their sizes, of about `limit` each."""
    at = 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, side="right")))
        yield slice(at, end)
        at = end


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array of runs of bytes of which each ends, at `ends`, with a separator of its own (smaller than any byte).

    Doubling from five bytes on. Rank, next rank and place are packed into one word where they fit, which sorts faster.
    """
    n = len(text)
    nearest = ends[np.searchsorted(ends, np.arange(n))]
    symbols = text.astype(U64) + U64(1)
    symbols[ends] = 0
    key = np.zeros(n, U64)
    for k in range(5):
        at = np.minimum(np.arange(n) + k, nearest)
        key = key * U64(257) + symbols[at]
    bits = max(1, int(n).bit_length())
    place = np.arange(n, dtype=U64)
    closed = nearest - np.arange(n) < 5
    reach = 5
    while True:
        if reach == 5 and 41 + bits <= 64 or reach > 5 and 3 * bits <= 64:
            packed = np.sort((key << U64(bits)) | place)
            order, values = (packed & U64((1 << bits) - 1)).astype(np.int64), packed >> U64(bits)
        else:
            order = np.argsort(key, kind="stable")
            values = key[order]
        new = np.ones(n, bool)
        new[1:] = (values[1:] != values[:-1]) | closed[order][1:]
        if new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        after = np.zeros(n, np.int64)
        after[:-reach] = rank[reach:]
        closed = nearest - np.arange(n) < 2 * reach
        # A suffix whose separator lies within reach already has a rank of its own.
        key = (rank.astype(U64) << U64(bits)) | after.astype(U64)
        reach *= 2


def common_windows(text: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix rows of each place, interval of each row): rows in one interval share at least `length` bytes."""
    order = suffix_order(text, ends).astype(np.int32)
    n = len(order)
    row = np.empty(n, np.int32)
    row[order] = np.arange(n, dtype=np.int32)
    first = text[order].astype(np.int16)
    first[row[ends]] = -1
    parted = np.ones(n, bool)  # level 0: another first byte; separators are intervals of their own
    parted[1:] = (first[1:] != first[:-1]) | (first[1:] < 0)
    # The row of the rest of each suffix: the inverse of the last-to-first mapping of the transform.
    rest = row[np.minimum(order + 1, n - 1)]
    open_ = np.flatnonzero(~parted).astype(np.int32)
    after, before = rest[open_], rest[open_ - 1]
    for _ in range(1, length):
        if not len(open_):
            break
        interval = np.cumsum(parted, dtype=np.int32)
        # c + w: the rows of the interval of w that c precedes; neighbours part where their w do.
        same = interval[after] == interval[before]
        if not same.all():
            parted[open_[~same]] = True
            open_, after, before = open_[same], after[same], before[same]
    return row, np.cumsum(parted) - 1


def smaller_holders(body: np.ndarray, sizes: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): for each window of each segment the smallest id that holds it; equal segments are given once."""
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, np.uint8)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = body
    row, interval = common_windows(text, ends, length)
    windows = sizes - length + 1
    at = np.concatenate(([0], np.cumsum(windows)))
    place = np.arange(at[-1]) + np.repeat(ends - sizes - at[:-1], windows)
    group = interval[row[place]]
    least = np.full(int(interval[-1]) + 1, LAST_ID)
    np.minimum.at(least, group, np.repeat(ids, windows))
    return at, least[group]


def _pack(x: np.ndarray) -> bytes:
    """The array's bytes, those of equal place together (small numbers leave planes of zeros), compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _batch(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _part(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts, ids, row numbers, bytes, offsets) of a part; a missing id sorts last.

    Rows are numbered by the hash of id and text, as their order may change from one step to the next; only rows equal in
    both share a number.
    """
    table = table.combine_chunks()
    rows = np.unique(table.column("row").to_numpy(), return_inverse=True)[1]
    ids = table.column("id").combine_chunks().fill_null(LAST_ID).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, np.int64)
    texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    body, offsets = flat.flatten(texts)
    return texts, ids, rows, body, offsets


#: anchors: the distinct ones of a part and bucket, sorted; twice, repeated, hot: a bit for each of them; counts: segments,
#: up to 65,535. Windows of hot anchors have no body, their hashes are in anchors and sizes.
ANCHORS = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("anchors", pa.binary()), ("twice", pa.binary()), ("counts", pa.binary())])
REPEATED = pa.schema([("part", pa.int64()), ("bucket", pa.int32()), ("repeated", pa.binary()), ("hot", pa.binary())])
SEGMENTS = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("local", pa.bool_()), ("body", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("rows", pa.binary()), ("places", pa.binary()), ("anchors", pa.binary())])
RANGES = pa.schema([("part", pa.int64()), ("rows", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
_DDL = {pa.int32(): "int", pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    values, starts = np.unique(bucket[order], return_index=True)
    for value, some in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
        yield value, some


#: Bits of an anchor that are sent; two that agree in them only cost a useless segment.
ANCHOR_BITS = 44


def _bucket_of(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges, so that the steps between sorted anchors are small."""
    return ((anchors >> U64(ANCHOR_BITS - 32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _anchors(body: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(segments' texts, first windows, windows and anchor numbers; sorted distinct anchors, whether two ids hold each)."""
    hashes, text, first, windows = segments(body, offsets, length)
    anchor = flat.mix(hashes) >> U64(64 - ANCHOR_BITS)
    values, number = np.unique(anchor, return_inverse=True)
    low, high = np.full(len(values), LAST_ID), np.full(len(values), np.iinfo(np.int64).min)
    np.minimum.at(low, number, ids[text])
    np.maximum.at(high, number, ids[text])
    return text, first, windows, number, values, low != high


def _send_anchors(length: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        _, ids, _, body, offsets = _part(table)
        *_, number, values, twice = _anchors(body, offsets, ids, length)
        counts = np.minimum(np.bincount(number, minlength=len(values)), 65_535).astype(np.uint16)
        rows = [{"bucket": b, "part": part, "anchors": _pack(np.diff(values[some], prepend=U64(0))), "twice": _pack(np.packbits(twice[some])), "counts": _pack(counts[some])} for b, some in _by_bucket(_bucket_of(values, buckets))]
        return _batch(ANCHORS, rows)

    return send


def _repeated(hot_segments: int):
    def find(table: pa.Table) -> pa.Table:
        sent = [np.cumsum(_unpack(x.as_buffer(), U64)) for x in table.column("anchors")]
        every = np.concatenate(sent)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        edge = np.concatenate(([True], ~same))
        total = np.add.reduceat(np.concatenate([_unpack(x.as_buffer(), np.uint16) for x in table.column("counts")]).astype(np.int64)[order], np.flatnonzero(edge))
        hot = np.empty(len(every), bool)
        hot[order] = (total > hot_segments)[np.cumsum(edge) - 1]
        again = np.zeros(len(every), bool)
        again[order[1:]] = same
        again[order[:-1]] |= same
        rows, at = [], 0
        own = [np.unpackbits(_unpack(t.as_buffer(), np.uint8), count=len(x)).astype(bool) for t, x in zip(table.column("twice"), sent, strict=True)]
        if any(x.any() for x in own):  # two documents of one part are two for all parts
            local = np.concatenate(own)
            again |= np.isin(every, np.unique(every[local]))
        for bucket, part, x in zip(table.column("bucket").to_pylist(), table.column("part").to_pylist(), sent, strict=True):
            rows.append({"part": part, "bucket": bucket, "repeated": _pack(np.packbits(again[at : at + len(x)])), "hot": _pack(np.packbits(hot[at : at + len(x)]))})
            at += len(x)
        return _batch(REPEATED, rows)

    return find


def _send_segments(length: int, buckets: int):
    def send(table: pa.Table, repeated: pa.Table) -> pa.Table:
        if not table.num_rows or not repeated.num_rows:
            return _batch(SEGMENTS, [])
        part = table.column("part")[0].as_py()
        _, ids, numbers, body, offsets = _part(table)
        text, first, windows, number, values, _ = _anchors(body, offsets, ids, length)
        wanted, hot = np.zeros(len(values), bool), np.zeros(len(values), bool)
        flags = {r["bucket"]: (r["repeated"], r["hot"]) for r in repeated.to_pylist()}
        for b, some in _by_bucket(_bucket_of(values, buckets)):
            wanted[some], hot[some] = (np.unpackbits(_unpack(x, np.uint8), count=len(some)) for x in flags[b])
        keep = wanted[number]
        split = hot[number[keep]]
        anchor, text, first, windows = values[number[keep]], text[keep], first[keep], windows[keep]
        if not len(anchor):
            return _batch(SEGMENTS, [])
        sizes = windows + length - 1
        _, number = distinct(body, first, sizes)
        least = np.full(number.max() + 1, LAST_ID)
        owner, row = ids[text], numbers[text]
        np.minimum.at(least, number, owner)
        local = owner > least[number]  # a smaller id of this part holds the same segment
        place = first - offsets[text]
        rows = []
        if local.any():
            rows.append({"bucket": int(part) % buckets, "part": part, "local": True, "body": b"", "sizes": _pack(sizes[local]), "ids": b"", "rows": _pack(row[local]), "places": _pack(place[local]), "anchors": b""})
        split &= ~local
        if split.any():
            n = windows[split]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            one, two = hashed(body, np.repeat(first[split], n) + inside, np.full(len(inside), length))
            holder, held, at = np.repeat(owner[split], n), np.repeat(row[split], n), np.repeat(place[split], n) + inside
            gone = held_by_smaller(one, two, holder)
            if gone.any():
                rows.append({"bucket": int(part) % buckets, "part": part, "local": True, "body": b"", "sizes": _pack(np.full(gone.sum(), length)), "ids": b"", "rows": _pack(held[gone]), "places": _pack(at[gone]), "anchors": b""})
            for b, some in _by_bucket(np.where(gone, -1, _bucket_of(flat.mix(one) >> U64(64 - ANCHOR_BITS), buckets))):
                if b >= 0:
                    rows.append({"bucket": b, "part": part, "local": False, "body": b"", "sizes": _pack(two[some]), "ids": _pack(holder[some]), "rows": _pack(held[some]), "places": _pack(at[some]), "anchors": _pack(one[some])})
        for b, some in _by_bucket(np.where(local | split, -1, _bucket_of(anchor, buckets))):
            if b >= 0:
                some = some[np.argsort(anchor[some], kind="stable")]
                rows.append({"bucket": b, "part": part, "local": False, "body": _pack(gathered(body, first[some], sizes[some])), "sizes": _pack(sizes[some].astype(np.uint16)), "ids": _pack(owner[some]), "rows": _pack(row[some]), "places": _pack(place[some]), "anchors": _pack(anchor[some])})
        return _batch(SEGMENTS, rows)

    return send


def _match(length: int):
    def match(table: pa.Table) -> pa.Table:
        rows, got, single = [], [], []
        for row in table.to_pylist():
            if row["local"]:
                sizes, place = _unpack(row["sizes"], np.int64), _unpack(row["places"], np.int64)
                rows.append({"part": row["part"], "rows": row["rows"], "starts": row["places"], "ends": _pack(place + sizes)})
            elif not row["body"]:
                one, two, ids = _unpack(row["anchors"], U64), _unpack(row["sizes"], U64), _unpack(row["ids"], np.int64)
                single.append((one, two, ids, _unpack(row["rows"], np.int64), _unpack(row["places"], np.int64), np.full(len(ids), row["part"])))
            else:
                body, sizes = _unpack(row["body"], np.uint8), _unpack(row["sizes"], np.uint16).astype(np.int64)
                got.append((body, sizes, _unpack(row["ids"], np.int64), _unpack(row["rows"], np.int64), _unpack(row["places"], np.int64), _unpack(row["anchors"], U64), np.full(len(sizes), row["part"])))
        if single:
            one, two, ids, own, place, part = (np.concatenate(x) for x in zip(*single, strict=True))
            gone = np.flatnonzero(held_by_smaller(one, two, ids))
            for p, some in _by_bucket(part[gone]) if len(gone) else ():
                rows.append({"part": p, "rows": _pack(own[gone[some]]), "starts": _pack(place[gone[some]]), "ends": _pack(place[gone[some]] + length)})
        if got:
            body, sizes, ids, own, place, anchor, part = (np.concatenate(x) for x in zip(*got, strict=True))
            starts = np.cumsum(sizes) - sizes
            out = [[], [], [], []]
            order = np.argsort(anchor, kind="stable")
            # Blocks of whole anchors; each is one suffix order.
            edge = np.flatnonzero(np.concatenate(([True], anchor[order][1:] != anchor[order][:-1])))
            upto = np.concatenate(([0], np.cumsum(sizes[order])))[edge]
            block = np.concatenate(([True], (upto[1:] // BLOCK_BYTES) != (upto[:-1] // BLOCK_BYTES)))
            for some in np.split(order, edge[block][1:]):
                one, number = distinct(body, starts[some], sizes[some])
                least = np.full(len(one), LAST_ID)
                np.minimum.at(least, number, ids[some])
                at, holder = smaller_holders(gathered(body, starts[some][one], sizes[some][one]), sizes[some][one], least, length)
                # Windows of every segment, with the smallest holder of each.
                n = sizes[some] - length + 1
                to = np.concatenate(([0], np.cumsum(n)))
                inside = np.arange(to[-1]) - np.repeat(to[:-1], n)
                gone = holder[inside + np.repeat(at[number], n)] < np.repeat(ids[some], n)
                begin = gone.copy()
                begin[1:] &= ~gone[:-1]
                begin[to[:-1]] = gone[to[:-1]]
                finish = gone.copy()
                finish[:-1] &= ~gone[1:]
                finish[to[1:] - 1] = gone[to[1:] - 1]
                begin, finish = np.flatnonzero(begin), np.flatnonzero(finish)
                owner = some[np.searchsorted(to, begin, side="right") - 1]
                out[0].append(part[owner])
                out[1].append(own[owner])
                out[2].append(place[owner] + inside[begin])
                out[3].append(place[owner] + inside[finish] + length)
            part, own, begin, finish = (np.concatenate(x) for x in out)
            for p, some in _by_bucket(part):
                rows.append({"part": p, "rows": _pack(own[some]), "starts": _pack(begin[some]), "ends": _pack(finish[some])})
        return _batch(RANGES, rows)

    return match


def _whole_characters(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges narrowed to whole UTF-8 characters; empty ones left out."""
    continues = np.append((body & 0xC0) == 0x80, False)
    starts, ends = starts.copy(), ends.copy()
    for _ in range(3):
        starts += continues[starts]
        ends -= continues[ends]
    some = starts < ends
    return starts[some], ends[some]


def _cut(result: pa.Schema, as_text: bool):
    def cut(table: pa.Table, ranges: pa.Table) -> pa.Table:
        if not table.num_rows:
            return result.empty_table()
        texts, _, rows, body, offsets = _part(table)
        some = ranges.to_pylist()
        join = lambda name: np.concatenate([np.zeros(0, np.int64), *[_unpack(r[name], np.int64) for r in some]])
        owner, begin, finish = join("rows"), join("starts"), join("ends")
        order = np.argsort(owner, kind="stable")
        owner, begin, finish = owner[order], begin[order], finish[order]
        low, high = np.searchsorted(owner, rows), np.searchsorted(owner, rows, side="right")
        kept, size, spans = [], np.diff(offsets), []
        for i in range(len(rows)):
            own = body[offsets[i] : offsets[i + 1]]
            b, f = begin[low[i] : high[i]], finish[low[i] : high[i]]
            if len(b):
                b, f = flat.merged(b, f)
                if as_text:
                    b, f = _whole_characters(own, b, f)
            spans.append([{"start": x, "end": y} for x, y in zip(b.tolist(), f.tolist(), strict=True)])
            kept.append(flat.without(own, b, f) if len(b) else own.tobytes())
        out = [table.column(c).combine_chunks() for c in result.names if c in ("id", "rest")]
        if as_text:
            valid = texts.is_valid().to_pylist()
            out.append(pa.array([k.decode() if v else None for k, v in zip(kept, valid, strict=True)], pa.string()))
        else:
            out += [pa.array(size, pa.int64()), pa.array(spans, result.field("spans").type), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays(out, schema=result)

    return cut


def _smallest_gram(parts: int, columns: list[str]):
    """The given columns and the part of each text, or without columns the part and the bytes of each text."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in flat.steps(batch, "text", HASH_BYTES):
                body, offsets = flat.flatten(step.column("text"))
                size = np.diff(offsets)
                key = np.arange(step.num_rows).astype(U64)  # texts without a gram match nothing
                some = np.flatnonzero(size >= GRAM)
                if len(some):
                    h = np.append(grams(body), U64(0))
                    at = np.stack((offsets[some], offsets[some] + size[some] - GRAM + 1), axis=1).ravel()
                    key[some] = flat.mix(np.minimum.reduceat(h, np.minimum(at, len(h) - 1))[::2])
                part = pa.array((key % U64(parts)).astype(np.int64))
                if columns:
                    yield pa.RecordBatch.from_arrays([*[step.column(c) for c in columns], part], [*columns, "part"])
                else:
                    yield pa.RecordBatch.from_arrays([part, pa.array(size)], ["part", "size"])

    return add


def _run(docs: DataFrame, length: int, result: pa.Schema, ddl: str, as_text: bool, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    if length < GRAM + 1:
        raise ValueError(f"length must be at least {GRAM + 1}")
    parts = max(1, -(-text_bytes(docs) // PART_BYTES))
    # What the smallest hashes deal to a part beyond twice its size is split by id; there are fewer such parts than parts.
    sizes = docs.select("text").mapInArrow(_smallest_gram(parts, []), "part bigint, size bigint").groupBy("part").agg(F.sum("size").alias("size"))
    large = materialised(sizes.where(F.col("size") > 2 * PART_BYTES).select("part", F.ceil(F.col("size") / PART_BYTES).alias("splits")))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    dealt = docs.mapInArrow(_smallest_gram(parts, docs.columns), f"{fields}, part bigint").join(large, "part", "left")
    dealt = dealt.withColumn("part", F.col("part") + parts * F.coalesce(F.pmod(F.xxhash64("id"), F.col("splits")), F.lit(0))).drop("splits").withColumn("row", F.xxhash64("id", "text"))
    anchors = dealt.groupBy("part").applyInArrow(_send_anchors(length, parts), _ddl(ANCHORS))
    repeated = anchors.groupBy("bucket").applyInArrow(_repeated(hot_segments), _ddl(REPEATED))
    found = dealt.groupBy("part").cogroup(repeated.groupBy("part")).applyInArrow(_send_segments(length, parts), _ddl(SEGMENTS))
    ranges = found.groupBy("bucket").applyInArrow(_match(length), _ddl(RANGES))
    return dealt.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(_cut(result, as_text), ddl)


def repeated_passages(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(id, n_bytes, spans, kept): the maximal byte ranges to remove from each text, and the bytes outside them.

    A byte goes if a string of `length` bytes around it also starts in a document of a smaller id, judged on the input.
    One row for each row. Matches never cross documents; equal ids, of the same or of different texts, are not smaller than
    each other; a missing id counts as the largest. Null and empty texts have no bytes; an empty table gives an empty
    result. Integer ids. Other columns are not read.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    result = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", span), ("kept", pa.binary())])
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return _run(rows, length, result, "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary", False, hot_segments).withColumnRenamed("id", id_col)


def remove_repeated_passages(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, every column kept, without repeated passages; ranges are narrowed to whole characters.

    Null texts stay null; the smallest id keeps a passage, and rows of that id, or without any id, cut nothing from each
    other. Repeated rows stay repeated; an empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"), F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("rest"))
    arrow = to_arrow_schema(rows.schema)
    result = pa.schema([arrow.field("rest"), pa.field("text", pa.string())])
    out = _run(rows, length, result, f"rest {rows.schema['rest'].dataType.simpleString()}, text string", True)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in docs.columns])
