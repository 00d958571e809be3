"""Each operator against brute force on small fixtures: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("moderata.llm")
from moderata.llm import bpe, chat, decontaminate, html_text, minhash, packing, quality, suffix_dedup, token_counts, urls, warc  # noqa: E402


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghéü", k=r.randint(1, 7))) for _ in range(120)]
    say = lambda n: " ".join(r.choices(words, k=n))
    shared, base = say(30), say(150)
    out = [None, "", "   \n", "one", "One", say(5), base, base, base.upper()]
    for _ in range(12):
        near = base.split()
        near[r.randrange(150)] = "edit"
        out.append(" ".join(near))
    for _ in range(12):
        out.append(f"{say(20)} {shared}\n{say(25)}")
    out += ["x" * 3000, "ab " * 400, say(2500), "line one is here\n" * 30, "# $ % " * 40, "\u00a0 wide\u2003space  <|endoftext|>x"]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", 1) for i, t in texts]
    names = "doc_id long, text string, id string, part string, n long"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("doc_id < -1")


def test_repeated_passages(docs, none, texts):
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_passages(docs, length=50).collect()}
    first = {}
    for d, t in texts:
        b = (t or "").encode()
        cut = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], d) < d:
                cut[i : i + 50] = b"\1" * 50
        assert bytes(got[d]["kept"]) == bytes(x for x, c in zip(b, cut, strict=True) if not c)
        assert got[d]["n_bytes"] == len(b)
        assert len(got[d]["spans"]) == len(re.findall(b"\1+", bytes(cut)))
    assert suffix_dedup.repeated_passages(none).count() == 0
    cut = suffix_dedup.remove_repeated_passages(docs)
    assert cut.columns == docs.columns and cut.count() == len(texts)
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[0] is None


def test_suffix_rows_share_exactly_what_brute_force_says():
    r = random.Random(1)
    parts = ["".join(r.choices("ab", k=r.randint(13, 40))) for _ in range(60)]
    text = np.frombuffer("".join(p + "\0" for p in parts).encode(), np.uint8)
    ends = np.flatnonzero(text == 0)
    row, interval = suffix_dedup.common_windows(text, ends, 9)
    whole = bytes(text)
    groups = defaultdict(set)
    for i in range(len(text)):
        if b"\0" not in whole[i : i + 9] and len(whole[i : i + 9]) == 9:
            groups[whole[i : i + 9]].add(int(interval[row[i]]))
    assert all(len(v) == 1 for v in groups.values())
    assert len(set.union(*groups.values())) == len(groups)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b\r\nc", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "é", "y" * 200_000), (5, "é", "z"), (None, "u", "z")]
    rows += [(10 + i, "u", f"<p>page {i} of many</p>") for i in range(40)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, sha string")
    got = warc.round_trip(pages, with_payload=True).collect()
    largest = defaultdict(int)
    for p, _, h in rows:
        largest[h or ""] = max(largest[h or ""], p or 0)
    want = sorted((p or 0, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if largest[h or ""] == p else "revisit", None if largest[h or ""] == p else largest[h or ""]) for p, _, h in rows)
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert {r["url"] for r in got if r["page_id"] in (1, 2, 5)} == {"http://a/ b\r\nc", None, "é"}
    assert all(r["payload"] is None or len(r["payload"]) == r["payload_bytes"] for r in got)
    assert {r["record_type"] for r in warc.round_trip(pages, least_bytes=10**6).collect()} == {"response"}
    assert warc.round_trip(pages.where("page_id < 0")).count() == 0


def test_warc_refuses_what_breaks_the_format():
    good = warc.record(1, "u", b"body", None, False)
    assert warc.parse(good)["payload"] == b"body"
    for bad in (good[:-1], good.replace(b"body", b"bodx"), good.replace(b"WARC/1.1", b"WARK/1.1"), good.replace(b"Content-Length: 4", b"Content-Length: 5"), b""):
        with pytest.raises(ValueError):
            warc.parse(bad)


@pytest.mark.parametrize("chunk, overlap", [(32_768, 512), (256, 16), (17, 3)])
def test_token_counts(docs, texts, chunk, overlap):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(docs, chunk=chunk, overlap=overlap).collect()}
    assert got == {d: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for d, t in texts}


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 300])
def test_contamination(spark, docs, none, texts, block_bytes):
    items = [("7", texts[6][1][40:260]), ("07", texts[9][1]), ("b", "ONE"), ("e", ""), ("n", None), ("7", texts[25][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, bench, block_bytes=block_bytes).collect()}
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = defaultdict(set)
    for name, t in items:
        w = find(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + min(10, len(w))])].add(name)
    for d, t in texts:
        w, hit, names = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        assert (got[d]["n_words"], got[d]["n_hit"], got[d]["items"]) == (len(w), len(hit), sorted(names)), d
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.where("item_id = 'none'")).where("n_hit > 0").count() == 0
    cut = decontaminate.remove_contamination(docs, bench)
    assert cut.columns == docs.columns
    clean = {d for d in got if not got[d]["n_hit"]}
    assert {r["doc_id"]: r["text"] for r in cut.collect() if r["doc_id"] in clean} == {d: t for d, t in texts if d in clean}
    assert decontaminate.find_contamination(cut, bench).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(docs, none, texts, width):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, width=width).collect()}
    sets = {}
    for d, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    assert got == {d: (len(sets[d]), root[d], root[d] == d) for d in sets}
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_without_ids_and_with_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "x y")], "doc_id long, text string")
    got = minhash.near_duplicates(rows).collect()
    assert len(got) == 5 and all(r["kept"] for r in got)
    assert minhash.drop_near_duplicates(rows).count() == 5


def test_components_of_chains(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 101), (101, 100), (5, 5)]
    r.shuffle(edges)
    got = {x["id"]: x["component"] for x in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(40)} | {100: 100, 101: 100}


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, none, texts, capacity):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_path())
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts}
    rows = packing.pack(docs, capacity=capacity, keep_ids=True).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids"] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert own.keys() == ids.keys()
    for d, parts in own.items():
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["start"] for r in parts] == list(np.cumsum([0, *[r["length"] for r in parts]])[:-1])
        assert sum(r["length"] for r in parts) == len(ids[d])
        assert all(r["length"] == capacity for r in parts[1:])
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.05 * sum(map(len, ids.values())) / capacity + 2
    assert packing.pack(none).count() == 0


def test_sweeps_fill_sequences_nearly():
    r = np.random.default_rng(2)
    lengths, counts = np.unique(r.integers(1, 900, 20_000), return_counts=True)
    found = packing.sweeps(lengths, counts, 2048)
    assert sum(x[2] for x in found) == 20_000
    assert max(x[3] + x[2] for x in found) <= 1.005 * (lengths * counts).sum() / 2048 + 1


def test_url_rules(spark):
    rules = [urls.Rule("allow", "com", "/"), urls.Rule("block", "example.com", "/en/"), urls.Rule("allow", "www.example.com", "/en/"), urls.Rule("block", "net", "/e")]
    given = {None: None, "": None, "no scheme.com/": None, "http://a.com/x": "com/", "https://EXAMPLE.com/en/a?b": "example.com/en/", "https://example.com/EN/a": "com/", "x://www.example.com/en/": "www.example.com/en/", "http://m.www.example.com/en/#": "www.example.com/en/", "http://badexample.com/en/": "com/", "http://a.net/es": "net/e", "http://net/e": "net/e", "http://xnet/e": None, "http://a.com?x": None, "http://a.b/the/casino/": None}
    rows = [(i, u, "h") for i, u in enumerate(given)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string"), rules).collect()
    assert {r["page_id"]: r["rule"] for r in got} == {i: given[u] for i, u, _ in rows}
    verdicts = {rows[r["page_id"]][1]: r["verdict"] for r in got}
    assert verdicts["http://a.b/the/casino/"] == "block" and verdicts[None] == "allow" and verdicts["https://EXAMPLE.com/en/a?b"] == "block"


@pytest.mark.parametrize("budget, history", [(1024, 256), (40, 30)])
def test_chat_windows(spark, budget, history):
    r = random.Random(5)
    tricky = [r"\### Assistant: </turn> ok", "### user: x </turn>\n", "\\", "", None, "a:b <c> #d", " </turn>\n### assistant: y", "é" * 30]
    rows = []
    for c in range(30):
        roles = (["system"] if c % 3 == 0 else []) + ["user", "assistant"] * r.randint(0, 6)
        rows += [(c if c else None, t, role, r.choice(tricky) if r.random() < 0.5 else "word " * r.randint(1, 40)) for t, role in enumerate(roles)]
    rows += [(99, None, None, "no turn"), (99, 1, "assistant", "same"), (99, 1, "assistant", "same")]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn int, role string, text string, window int")
    windows = chat.format_windows(frame, budget=budget, history=history)
    got = {x["conv_id"]: x for x in chat.digests(windows).collect()}
    by = defaultdict(list)
    for c, _, role, text in rows:
        by[c].append((role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        said = "".join(x for role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    model = bpe.load(bpe.default_path())
    for w in windows.collect():
        turns = chat.read_turns(w["text"])
        assert w["n_repeated"] < len(turns)
        own = w["text"][turns[w["n_repeated"]][2] :]
        assert len(turns) - w["n_repeated"] == 1 or len(model.whole.encode(own).ids) <= budget
        if by[w["conv_id"]][0][0] == "system":
            assert turns[0][0] == "system"
        # The whole window keeps to the budget, unless it is one long turn or the system turn takes too much of it.
        system = len(model.whole.encode(w["text"][: turns[0][3] + len(chat.CLOSE)]).ids) if turns[0][0] == "system" else 0
        if len(turns) - w["n_repeated"] > 1 and system + history <= budget - budget // 4:
            assert len(model.whole.encode(w["text"]).ids) <= budget
    assert chat.digests(chat.format_windows(frame.where("turn < -5"))).count() == 0


def test_html_blocks():
    tree = html_text.train()
    x, y = html_text.labelled()
    assert (tree.predict(x) == y).all()
    page = "<nav><a href='/'>Home</a></nav><article><h1>T</h1><p>a <b>b</b>c<br>d &amp; e\n f<p>g<script>'</p>'</script></article><!-- x --><div class=comments>me too</div><footer>f</footer>"
    assert html_text.main_text(page, tree) == "T\na bc\nd & e f\ng"
    for odd in ("", "<", "<p", "<script>", "<!--", "</p></p>", "<p>" * 50, "&#0;&bogus;&"):
        html_text.main_text(odd, tree)


def test_html_held_out(spark):
    r = random.Random(8)
    say = lambda n: " ".join(r.choices(["alpha", "beta", "gamma", "delta"], k=n)).capitalize()
    pages, want = [(0, "u", None, 1), (1, "u", "", 1)], {0: "", 1: ""}
    for i in range(2, 40):
        own = [say(r.randint(1, 40)) for _ in range(r.randint(1, 6))]
        tag = r.choice(["article", "main"])
        noise = lambda: r.choice([f"<aside>{say(30)}</aside>", f"<form>{say(5)}</form>", f"<div class='sidebar'>{say(12)}</div>", f"<div id='comments'><p>{say(20)}</p></div>", f"<div role=dialog>{say(9)}</div>"])
        pages.append((i, "u", f"<html><head><title>{say(3)}</title></head><body><header>{say(4)}</header><nav><a>{say(1)}</a></nav>{noise()}<{tag}>" + "".join(f"<p>{x}</p>" for x in own) + f"{noise()}</{tag}>{noise()}<footer>{say(9)}</footer></body></html>", 1))
        want[i] = "\n".join(own)
    got = {x["page_id"]: (x["text"], x["n_chars"]) for x in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text int")).collect()}
    right = sum(got[i][0] == want[i] for i in want)
    assert right >= 0.95 * len(want) and all(n == len(t) for t, n in got.values())


def test_quality(docs, none, texts):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for d, t in texts:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        found = defaultdict(list)
        for i in range(len(w) - 7):
            found[tuple(w[i : i + 8])].append(i)
        repeat = {k for v in found.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
        base = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat), base)
        assert tuple(got[d][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want, d
        assert not (base and got[d]["kept"])
    assert quality.quality(none).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got.values())


def test_quality_runs_no_python(docs):
    plan = quality.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.split("Scan ExistingRDD")[0])


def test_distance_is_zero_to_itself_and_one_to_the_disjoint(spark):
    row = spark.range(1).select(quality.js_distance(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)), [0.5, 0.5, 0.0]).alias("same"), quality.js_distance(F.array(F.lit(1.0), F.lit(0.0)), [0.0, 1.0]).alias("other")).first()
    assert row["same"] == pytest.approx(0) and row["other"] == pytest.approx(1)
