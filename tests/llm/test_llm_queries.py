"""The numbered queries without SQL, and the pipeline, against brute force on tables of their own."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("moderata.llm")
import corpus_pipeline  # noqa: E402
from moderata.llm import bpe, quality, queries  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    common = quality.WORD_SHARES["en"]  # as often as in the language; with fewer the quality stage rightly rejects the texts
    words = [*common, *["".join(r.choices("abcdefghijéü", k=r.randint(5, 9))) for _ in range(400)]]
    weights = [*common.values(), *[(1 - sum(common.values())) / 400] * 400]
    say = lambda n: " ".join(r.choices(words, weights, k=n))
    passage, leak = say(60), say(14)
    docs = [(i, say(r.randint(120, 200)), "en", "s", 1) for i in range(30)]
    docs += [(100 + i, f"{say(80)} {passage} {say(60)}", "en", "s", 1) for i in range(6)]
    docs += [(200 + i, docs[i][1] + " " + say(2), "en", "s", 1) for i in range(5)]
    docs += [(300, docs[3][1], "en", "s", 1), (301, None, "en", "s", 1), (302, "", None, None, None), (303, f"{say(90)} {leak} {say(90)}", "en", "s", 1), (304, "## $$ %% " * 60, "en", "s", 1), (305, say(3000), "en", "s", 1)]
    pages = [(i, f"http://a.example/{i}", f"<article><p>{say(20)}</p></article>") for i in range(5)]
    talks = [(c, t, "assistant" if t % 2 else "user", say(r.randint(1, 30))) for c in range(5) for t in range(4)]
    folder = str(tmp_path_factory.mktemp("sf"))
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", [(1, leak), (2, None)], "item_id long, text string"), ("pages", pages, "page_id long, url string, html string"), ("conversations", talks, "conv_id long, turn long, role string, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder, docs, talks, leak


def removed(texts, length=50):
    """(id, bytes, flags of removed bytes)."""
    first, out = {}, []
    for d, t in sorted(texts):
        b = (t or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first.setdefault(b[i : i + length], d) < d:
                cut[i : i + length] = b"\1" * length
        out.append((d, b, bytes(cut)))
    return out


def test_op1(spark, tables):
    folder, docs, _, _ = tables
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_suffix_array_dedup"](spark, folder).collect()}
    for d, b, cut in removed([(x[0], x[1]) for x in docs]):
        kept = bytes(x for x, c in zip(b, cut, strict=True) if not c)
        assert (got[d]["n_bytes"], got[d]["n_removed"], got[d]["n_spans"], got[d]["kept_sha256"]) == (len(b), sum(cut), len(re.findall(b"\1+", cut)), hashlib.sha256(kept).hexdigest())


def test_op3(spark, tables):
    from tokenizers import Tokenizer

    folder, docs, _, _ = tables
    tok = Tokenizer.from_file(bpe.default_path())
    got = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in queries.QUERIES["op3_token_counts"](spark, folder).collect()}
    n = {x[0]: len(tok.encode(x[1] or "", add_special_tokens=False).ids) for x in docs}
    assert got == {d: (k, k > 1024) for d, k in n.items()}


def test_op8(spark, tables):
    folder, _, talks, _ = tables
    got = {r["conv_id"]: r for r in queries.QUERIES["op8_chat_formatting"](spark, folder).collect()}
    by = defaultdict(list)
    for c, _, role, text in [*talks, (-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]:
        by[c].append((role, text))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[c]["n_turns"] == len(turns)


@pytest.mark.parametrize("name", ["op2_warc_round_trip", "op9_html_extraction"])
def test_page_queries_return_every_page(spark, tables, name):
    assert queries.QUERIES[name](spark, tables[0]).count() == 5


def test_pipeline(spark, tables):
    from tokenizers import Tokenizer

    folder, docs, _, leak = tables
    kept = {r["doc_id"] for r in quality.quality(spark.read.parquet(f"{folder}/documents.parquet")).where("kept").collect()}
    assert 304 not in kept and 301 not in kept and {x[0] for x in docs if x[0] < 300} <= kept
    texts = {x[0]: x[1] for x in docs if x[0] in kept}
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    gone = {b for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    left = {}
    for d, b, cut in removed([(d, t) for d, t in texts.items() if d not in gone]):
        keep, at = "", 0
        for ch in b.decode():
            n = len(ch.encode())
            keep += ch * (not all(cut[at : at + n]))
            at += n
        left[d] = keep
    assert leak in texts[303]
    words = re.escape(leak)
    left[303] = re.sub(words, "", left[303], flags=re.IGNORECASE)
    tok = Tokenizer.from_file(bpe.default_path())
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 0] for d, t in left.items()}
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]].append(r)
    assert got.keys() == ids.keys()
    for d, parts in got.items():
        for p in parts:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[d][p["start"] : p["start"] + p["length"]], "<u4").tobytes()), d
        assert sum(p["length"] for p in parts) == len(ids[d])


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables[0]).columns == docs.columns
