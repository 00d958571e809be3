"""Rows without an id, and rows of one id with different texts, against brute force."""

import random

import pytest

pytest.importorskip("moderata.llm")
from moderata.llm import minhash, suffix_dedup  # noqa: E402


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    words = ["".join(r.choices("abcdefé", k=r.randint(2, 7))) for _ in range(200)]
    say = lambda n: " ".join(r.choices(words, k=n))
    a, b = say(40), say(40)
    return [(None, f"{say(20)} {a} {say(9)}"), (None, f"{say(30)} {say(30)}"), (None, f"{a} {b}"), (7, f"{b} {say(12)}"), (7, f"{say(25)} {a}"), (7, f"{b} {say(12)}"), (9, f"{say(50)} {b}"), (9, f"{a} {say(50)}"), (9, f"{a} {say(50)}"), (3, say(60)), (None, None), (7, ""), (9, None)]


def cut(rows, length=50):
    order = [float("inf") if d is None else d for d, _ in rows]
    smallest = {}
    for d, (_, t) in zip(order, rows, strict=True):
        x = (t or "").encode()
        for i in range(len(x) - length + 1):
            smallest[x[i : i + length]] = min(d, smallest.get(x[i : i + length], d))
    out = []
    for d, (own, t) in zip(order, rows, strict=True):
        x, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(x) - length + 1):
            if smallest[x[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out.append((own, len(x), bytes(c for c, g in zip(x, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot_segments", [suffix_dedup.HOT_SEGMENTS, 1])
def test_every_row_keeps_what_is_its_own(spark, rows, hot_segments):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in suffix_dedup.repeated_passages(docs, length=50, hot_segments=hot_segments).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(got, key=key) == sorted(cut(rows), key=key)


def test_texts_of_one_id_are_cut_apart(spark):
    shared = "a passage that is longer than fifty bytes and that stands in two rows, "
    rows = [(1, shared), (2, f"{shared}first"), (2, f"second {shared}"), (None, f"other:{shared}"), (None, "an own text that no other row holds, of more than fifty bytes")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["text"] for r in suffix_dedup.remove_repeated_passages(docs).collect())
    assert got == sorted([shared, "first", "second ", "other:", rows[4][1]])


def test_an_id_of_several_texts_links_the_copies_of_each(spark):
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choices("abcdef", k=5)) for _ in range(n))
    a, b, c = say(60), say(60), say(60)
    rows = [(1, a), (2, a), (2, b), (3, f"{b} more"), (4, c), (5, c), (6, c), (6, b), (6, b), (7, f"{c} more"), (8, say(60)), (9, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((x["doc_id"] or 0, x["component_id"], x["kept"]) for x in minhash.near_duplicates(docs).collect())
    assert got == [(0, None, True), (1, 1, True), *[(d, 1, False) for d in (2, 2, 3, 4, 5, 6, 6, 6, 7)], (8, 8, True), (9, 9, True)]
