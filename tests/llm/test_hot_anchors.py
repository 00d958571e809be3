"""A passage that many documents hold within texts of their own: split over the buckets, with the same result."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

pytest.importorskip("moderata.llm")
from moderata.llm import suffix_dedup  # noqa: E402


def texts(n):
    r = random.Random(9)
    say = lambda k: "".join(r.choices("abcdefghij ", k=k))
    passage = say(110)
    return [(i, say(r.randint(0, 90)) + passage * (1 + i % 2) + say(r.randint(0, 90))) for i in range(n)] + [(n, passage[:60]), (n + 1, "a" * 300), (n + 2, "b" + "a" * 200), (n + 3, None)]


@pytest.mark.parametrize("hot_segments", [0, 3, 100, 10**9])
def test_any_split_gives_the_same_passages(spark, hot_segments):
    rows = texts(60)
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), hot_segments=hot_segments).collect()}
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], d) < d:
                cut[i : i + 50] = b"\1" * 50
        assert bytes(got[d]["kept"]) == bytes(x for x, c in zip(b, cut, strict=True) if not c)
        assert len(got[d]["spans"]) == len(re.findall(b"\1+", bytes(cut)))


def test_no_bucket_holds_a_hot_anchor_whole():
    buckets, parts = 16, 6
    rows = texts(300)[:300]
    tables = [pa.table({"id": [i for i, _ in rows if i % parts == p], "text": [t for i, t in rows if i % parts == p], "part": pa.array([p] * 50, pa.int64()), "row": pa.array([i for i, _ in rows if i % parts == p], pa.int64())}) for p in range(parts)]
    sent = pa.concat_tables([suffix_dedup._send_anchors(50, buckets)(t) for t in tables])
    by_bucket = [sent.filter(pa.array([b == k for b in sent.column("bucket").to_pylist()])) for k in range(buckets)]
    flags = pa.concat_tables([suffix_dedup._repeated(100)(t) for t in by_bucket if t.num_rows])
    held = Counter()
    for p, t in enumerate(tables):
        own = flags.filter(pa.array([x == p for x in flags.column("part").to_pylist()]))
        for r in suffix_dedup._send_segments(50, buckets)(t, own).to_pylist():
            if not r["local"]:
                held[r["bucket"]] += len(suffix_dedup._unpack(r["ids"], "i8"))
    assert max(held.values()) < 0.2 * sum(held.values())
