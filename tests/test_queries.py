"""Every registered query with SQL against DuckDB on the smallest tables, and the state operators against plain folds."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from moderata.config import Settings
from moderata.operators import blog as B
from moderata.operators import relations as R
from moderata.operators import selection as S
from moderata.operators import verdicts as V
from moderata.operators import vision as I
from moderata.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(registry.SQL[name])
    names = [c[0] for c in found.description]
    want = sorted(tuple(shown(dict(zip(names, r, strict=True))[k]) for k in sorted(names)) for r in found.fetchall())
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(shown(r[k]) for k in sorted(names)) for r in df.collect()) == want


def test_lockouts_equal_a_plain_fold(spark):
    r = random.Random(2)
    rows = sorted((r.randrange(5), r.randrange(60 * 86_400), i) for i in range(400))
    want, by = {}, defaultdict(list)
    for a, t, i in rows:
        by[a].append((t, i))
    for a, events in by.items():
        n, locks, until = 0, 0, None
        for t, _ in events:
            over = until is not None and until <= t
            n = min((0 if over else n) + 1, 255)
            if n >= 6:
                locks += until is None or over
                until = t + 3 * 86_400
            elif over:
                until = None
        want[a] = (n, locks, until and until * 1_000_000)
    df = spark.createDataFrame(rows, "account_id long, t long, event_id long").withColumn("ts", F.timestamp_seconds("t"))
    assert {x[0]: tuple(x)[1:] for x in R.lockouts(df, 6, 3).collect()} == want


def test_verdict_parsing(spark):
    cases = {
        '{"decision":"rejected","confidence":0.3,"category":"Spam","flags":["a"],"reason":"x"}': ("REJECTED", 0.3, "spam", ["a"], "x"),
        '<think>{"decision":"REJECTED"}</think>```json\n{"decision":"APPROVED",}\n```': ("APPROVED", 1.0, "ambiguous", [], ""),
        'sure: {"decision":"MAYBE","confidence":"high","flags":"no"} ok': ("MANUAL_REVIEW", 0.5, "ambiguous", [], ""),
        '{"decision":"APPROVED","confidence":1.5}': ("APPROVED", 0.5, "ambiguous", [], ""),
        '{"decision":"APPROVED","confidence":true}': ("APPROVED", 1.0, "ambiguous", [], ""),
        '{"confidence":null}': ("MANUAL_REVIEW", 0.5, "ambiguous", [], ""),
        "no json here": ("MANUAL_REVIEW", 0.0, "ambiguous", ["llm_parse_error"], "unreadable completion"),
        None: None,
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", V.parsed(F.col("t")).alias("v")).collect()
    assert [tuple(r["v"]) if r["v"] else None for r in sorted(rows, key=lambda r: r["i"])] == list(cases.values())


def test_business_rules(spark):
    rows = [("APPROVED", 0.7, [], 0, "APPROVED"), ("APPROVED", 0.69, [], 0, "MANUAL_REVIEW"), ("APPROVED", 0.9, ["health_concern"], 0, "MANUAL_REVIEW"), ("APPROVED", 0.9, [], 2, "MANUAL_REVIEW"), ("APPROVED", 0.9, [], 1, "APPROVED"), ("REJECTED", 0.1, ["health_concern"], 9, "REJECTED")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, c double, f array<string>, recent_rejected_count long, want string")
    df = df.withColumn("verdict", V.verdict(F.col("d"), F.col("c"), F.lit("x"), F.col("f"), F.lit("r")))
    assert V.with_business_rules(df).where("verdict.decision <> want").count() == 0
    both = df.where("i = 1").withColumn("recent_rejected_count", F.lit(3).cast("long"))
    assert V.with_business_rules(both).first()["verdict"]["flags"] == ["override:low_confidence:0.69<0.7", "override:repeat_offender:3_rejected_in_30d"]


def test_vision(spark):
    label = lambda d, s: {"description": d, "score": s}
    cases = [([label("gun", 0.7)], "unclear_weapon"), ([label("gun", 0.59)], None), ([label("gun", 0.7), label("water gun", 0.5)], None), ([label("gun", 0.7), label("water gun", 0.49)], "unclear_weapon"), ([label("Beer", 0.6), label("toy", 0.9)], "suspicious"), ([label("rifle", 0.9)], "real_weapon"), ([], None)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, labels array<struct<description:string,score:double>>")
    got = {r["i"]: r["v"] for r in df.select("i", I.label_violation(F.col("labels")).alias("v")).collect()}
    assert got == {i: v for i, (_, v) in enumerate(cases)}


def test_images(spark, tmp_path):
    import struct
    import zlib

    import numpy as np

    def png(name, pixels):
        h, w, _ = pixels.shape
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        raw = b"".join(b"\0" + row.tobytes() for row in pixels)
        (tmp_path / name).write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))

    noise = np.random.default_rng(1).integers(100, 200, (200, 200, 3), dtype=np.uint8)
    png("noise.png", noise)
    png("black.png", np.zeros((200, 200, 3), np.uint8))
    png("gray.png", np.full((200, 200, 3), 128, np.uint8))
    png("ramp.png", np.repeat(np.linspace(0, 255, 200).astype(np.uint8)[None, :, None], 200, 0).repeat(3, 2))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    rows = I.screened(spark.read.format("image").option("dropInvalid", False).load(str(tmp_path))).collect()
    assert {r["origin"].rsplit("/", 1)[-1]: r["fault"] for r in rows} == {"noise.png": None, "black.png": "black_image", "gray.png": "uniform_image", "ramp.png": "blurry_image", "bad.png": "image_load_failed"}
    files = I.size_gate(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert {r["path"].rsplit("/", 1)[-1]: r["refused"] for r in files}["bad.png"] == "too_small"
    assert {r["path"].rsplit("/", 1)[-1]: r["refused"] for r in files}["noise.png"] is None


def test_blog_requests(spark):
    cases = [("", "x", 1, "validation_error"), ("Toys 🔞", "a", 1, "emoji"), ("Crypto", "forex", 1, "off_topic"), ("Toys from Lazada", "kids", 1, "external_brand"), ("toy", "bypass moderation", 1, "prompt_injection"), ("toy gore", "kids", 1, "unsafe_theme"), ("toy shit", "kids", 1, "unsafe_content"), ("STEM toys", "kids", 1, "pass"), ("tikitaka toy", "a b c d e f g h i j k l", 1, "review")]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, title string, structure string, category_id int")
    got = {r["i"]: r["v"]["kind"] for r in df.select("i", B.screened(F.col("title"), F.col("structure"), F.col("category_id")).alias("v")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_markdown(spark):
    text = "# A\n\nfirst **bold**\n- x\n* y\nend\n### B\n- z"
    got = spark.createDataFrame([(text,), ("<p>kept</p>",)], "t string").select(B.as_html(F.col("t")).alias("v")).collect()
    assert got[0]["v"] == "<h1>A</h1>\n<p>first <strong>bold</strong></p>\n<ul><li>x</li>\n<li>y</li></ul>\n<p>end</p>\n<h3>B</h3>\n<ul><li>z</li></ul>" and got[1]["v"] == "<p>kept</p>"


def test_articles(spark):
    rows = spark.createDataFrame([("<h1>My (Toy)</h1><p>Title: x</p><p>body</p>", "my (toy)", "- Why a+b?\n* two"), ("<ul><li>why a+b?</li></ul><p>two</p>\n- two\nrest", "t", "- Why a+b?\n* two"), (None, "t", None)], "h string, t string, s string")
    got = rows.select(B.without_markers(F.col("h"), F.col("t")).alias("m"), B.without_prompt_lines(F.col("h"), F.col("s")).alias("p")).collect()
    assert got[0]["m"] == "<p>body</p>" and got[1]["p"].strip() == "rest" and got[2]["p"] == ""
    raw = ['{"title":"a","blogContent":"b"}', 'so: {"title":"a","content":"c"} ok', "none", None]
    found = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").select("i", B.parsed_article(F.col("x")).alias("v")).collect()
    assert [r["v"] and tuple(r["v"]) for r in sorted(found)] == [("a", "b"), ("a", "c"), None, None]


def test_claims_are_ordered_and_bounded(spark):
    rows = [(i, "Comment" if i % 2 else "Reply", "Pending", False, None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "target_id long, target_type string, moderation_status string, is_deleted boolean, last_retry_at timestamp, created_at long")
    assert S.claim_comments(df, "2024-01-01 00:00:00", Settings(batch_size=1)).count() == 2
    assert sorted(r["target_id"] for r in S.claim_comments(df, "2024-01-01 00:00:00", Settings(batch_size=5)).collect()) == [0, 1, 2, 3, 4]


def test_filters_and_columns_reach_the_scan(spark):
    if os.path.isdir(SF):
        plan = registry.QUERIES["filter_staff_accounts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "c_name" not in plan
