"""Periodic runs against a comparison of every word with every earlier one."""

import hashlib
import random
import time
import zlib

import pytest

pytest.importorskip("moderata.llm")
import numpy as np  # noqa: E402
from moderata.llm import flat, periodic, queries  # noqa: E402


def brute(w, least=12):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = q
        while i < len(w):
            first = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i > first and i - first + q >= max(least, 2 * q):
                out.setdefault((first - q, i), q)
            i += i == first
    return sorted((a, b - a, q) for (a, b), q in out.items())


def found(w, least=12, pairs=periodic.PAIRS):
    gram = (least + 1) // 2
    h = np.array(w, np.uint64)
    g = np.zeros(max(0, len(h) - gram + 1), np.uint64)
    for k in range(gram):
        g = flat.mix(g + h[k : k + len(g)] + np.uint64(1))
    return periodic.runs_of(g, least, gram, pairs)


def texts(r, n):
    for _ in range(n):
        parts, k = [], r.choice([1, 2, 2, 3, 5])
        while sum(map(len, parts)) < r.randint(5, 120):
            unit = r.choice(parts)[:60] if parts and r.random() < 0.3 else [r.randrange(k) for _ in range(r.randint(1, 14))]
            parts.append(unit * r.randint(1, 6))
        yield [x for p in parts for x in p] * r.choice([1, 1, 2])


@pytest.mark.parametrize("pairs", [periodic.PAIRS, 40, 7])
def test_runs_in_any_stretches(pairs):
    """Small stretches make the text's middle of a run be left out again and again."""
    for w in texts(random.Random(pairs), 400):
        assert found(w, 12, pairs) == brute(w), w
        assert found(w, 5, pairs) == brute(w, 5), w


def test_texts_that_repeat_all_along_take_no_square_of_their_length():
    began = time.time()
    assert found([1] * 200_000) == [(0, 200_000, 1)]
    assert found([1, 2, 3, 4, 5, 6, 7, 8, 9] * 20_000) == [(0, 180_000, 9)]
    assert (0, 202_000, 101) in found(([1] * 100 + [2]) * 2000)
    assert time.time() - began < 60


def test_whole_query(spark, tmp_path):
    r = random.Random(7)
    vocabulary = ["".join(r.choices("abcé", k=4)) for _ in range(300)]
    rows = []
    for d in range(150):
        w = r.choices(vocabulary, k=r.choice([0, 1, 5, 12, 40, 200]))
        if d % 3 == 0:
            at = r.randint(0, len(w))
            w[at:at] = r.choices(vocabulary, k=r.randint(1, 9)) * r.randint(2, 9)
        rows.append((d, r.choice([" ", "\n", " \t "]).join(w)))
    rows += [(1000, None), (1001, "  "), (None, "a b " * 9), (1002, "x " * 5000), (1003, " ".join(map(str, range(20_000))) + " z y" * 12), (7, "a b c " * 8), (7, "a b c " * 8)]
    spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t in rows:
        w, h = (t or "").split(), zlib.crc32(str(d).encode()) if d is not None else 1
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w) if n < 1000 else [(0, n, 1)] if d == 1002 else [(20_000, 24, 2)]
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        cut = {i for s, m, q in runs for i in range(s + q, s + m)}
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        told = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want.append((d, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in cut).encode()).hexdigest()))
    assert sum(x[1] > 0 for x in want) > 40
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(x[n] for n in names) for x in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
