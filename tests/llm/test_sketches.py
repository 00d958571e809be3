"""Fingerprints against whole shingle sets and plain edits."""

import hashlib
import random
import re

import pytest

pytest.importorskip("moderata.llm")
import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from moderata.llm import queries, sketches  # noqa: E402


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def share(a, b):
    x, y = shingles(a), shingles(b)
    return float(not x and not y) if not x or not y else len(x & y) / min(len(x), len(y))


def change(a, b):
    n = len(a) // 4
    return a[: len(a) - n] + b[:n]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    words = ["".join(r.choices("abcdefghé漢", k=r.randint(2, 8))) for _ in range(3000)]
    say = lambda n: " ".join(r.choices(words, k=n))
    found = [say(r.choice([1, 3, 4, 5, 9, 30, 60, 300, 2000])) for _ in range(120)]
    found += [found[7], found[7].upper(), "", None, "   ", "x", "一二三四", say(40_000), found[40] + " " + say(3), "aaa " * 500]
    return [(3 * i, t) for i, t in enumerate(found)]


def test_whole_query_against_brute_force(spark, texts, tmp_path):
    rows = list(texts)
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.QUERIES["op12_document_fingerprints"](spark, str(tmp_path)).collect()}
    assert got.keys() == {d for d, _ in texts}
    for (d, own), (_, after) in zip(texts, [*texts[1:], texts[0]], strict=True):
        own, after, x = own or "", after or "", got[d]
        changed = change(own, after)
        assert (x["n_chars"], x["edited_sha256"]) == (len(own), hashlib.sha256(changed.encode()).hexdigest())
        for near, other in ((x["near_edited"], changed), (x["near_next"], after)):
            if max(len(shingles(own)), len(shingles(other))) <= sketches.LEAST:
                assert near == share(own, other)  # both sketches hold whole sets
            elif min(len(shingles(own)), len(shingles(other))) > sketches.LEAST:
                assert abs(near - share(own, other)) < 0.25
            assert 0 <= near <= 1
    by_text = {}
    for d, t in texts:
        by_text.setdefault(t or "", set()).add(got[d]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert len({t for t in by_text if len(shingles(t)) > 0}) - len({next(iter(f)) for t, f in by_text.items() if shingles(t)}) <= 1  # upper case is the same text


def test_every_hash_below_the_fraction_is_kept(texts):
    array = pa.array([t for _, t in texts])
    for (_, t), (bound, hashes) in zip(texts, sketches.sketches(array), strict=True):
        whole = [sketches.sketches(pa.array([" ".join(s)]))[0][1] for s in shingles(t or "")] if len(t or "") < 3000 else None
        if whole is not None:
            every = np.unique(np.concatenate([*whole, np.zeros(0, np.uint64)]).astype(np.uint64))
            assert (every[every < np.uint64(bound)] == hashes).all() and len(hashes) >= min(len(every), sketches.LEAST)
            assert bound >= sketches.FULL // sketches.SHARE


def test_sketches_merge():
    r = np.random.default_rng(2)
    for n, m in ((0, 0), (3, 5), (64, 1), (64, 64), (65, 70), (500, 10), (3000, 4000), (3000, 0)):
        a, b = (np.unique(r.integers(0, sketches.FULL, k, dtype=np.uint64)) for k in (n, m))
        bound, hashes = sketches.merged(sketches.kept(a), sketches.kept(b))
        want = sketches.kept(np.union1d(a, b))
        assert bound == want[0] and (hashes == want[1]).all()
        assert sketches.unpacked(sketches.packed((bound, hashes)))[0] == bound and (sketches.unpacked(sketches.packed(want))[1] == want[1]).all()


def test_containment_of_very_unequal_documents():
    r = np.random.default_rng(3)
    large = np.unique(r.integers(0, sketches.FULL, 200_000, dtype=np.uint64))
    small = np.unique(np.concatenate((r.choice(large, 1500, replace=False), r.integers(0, sketches.FULL, 500, dtype=np.uint64))))
    assert abs(sketches.likeness(sketches.kept(small), sketches.kept(large)) - 0.75) < 0.1


def test_odd_tables(spark):
    assert sketches.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = sketches.fingerprints(spark.createDataFrame([("k", "one two three four five six seven", 1)], "name string, body string, part int"), id_col="name", text_col="body").collect()
    assert one[0]["name"] == "k" and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(change(*["one two three four five six seven"] * 2).encode()).hexdigest()
    rows = [(None, "a b c d e f"), (5, "x y"), (5, "x y"), (5, "x y"), (1, None)]
    got = sorted((x["doc_id"] or 0, x["n_chars"], x["near_next"]) for x in sketches.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 11, 0.0), (1, 0, 0.0), (5, 3, 0.0), (5, 3, 1.0), (5, 3, 1.0)]
