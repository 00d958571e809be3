"""Operators whose behaviour their SQL doesn't show, on small tables."""

import hashlib
import os
import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from moderata.operators import blog as B
from moderata.operators import verdicts as V
from moderata.operators import vision as I
from moderata.plans import registry
from moderata.sources.tables import view


def test_models_are_asked_in_batches_and_may_stay_silent(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(50)], "review_id long, prompt string")
    got = V.score_with(rows, lambda prompts: prompts.where(prompts.str.len() % 2 == 0, None)).collect()
    assert {r["review_id"]: r["completion"] for r in got} == {i: "x" * i if i % 2 == 0 else None for i in range(50)}
    assert V.score_with(rows.where("review_id < 0"), lambda x: pd.Series(x)).count() == 0


def test_recognised_text(spark):
    raw = [None, "no json", "[1]", '{"decision":"REJECTED","confidence":0.9}', '{"decision":"APPROVED"}']
    got = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").select("i", V.read_ocr(F.col("raw")).alias("v")).orderBy("i").collect()
    assert [(r["v"]["decision"], r["v"]["confidence"], r["v"]["flags"]) for r in got] == [("APPROVED", 0.85, ["ocr_llm_skipped_on_error"]), ("APPROVED", 0.85, ["ocr_llm_parse_fallback"]), ("APPROVED", 0.85, ["ocr_llm_skipped_on_error"]), ("REJECTED", 0.9, []), ("APPROVED", 1.0, [])]


def test_flags_are_there_once(spark):
    rows = spark.createDataFrame([(["a"],), (["b", "a"],), ([],)], "f array<string>")
    assert [r["v"] for r in rows.select(V.with_flag(F.col("f"), "b").alias("v")).collect()] == [["a", "b"], ["b", "a"], ["b"]]


def test_rules_in_their_order(spark):
    texts = spark.createDataFrame([(1, "A toy from Zalo"), (2, "nothing"), (3, None), (4, "the toyshop"), (5, "")], "i int, text string")
    rules = spark.createDataFrame([(2, "toy"), (1, "ZALO"), (7, "hop"), (7, "shop"), (0, ""), (0, None), (9, "zalo")], "rule_id int, word string")
    for block in (1, 2, 1000):
        assert [r["rule"] for r in B.first_rule(texts, rules, "text", block).orderBy("i").collect()] == ["zalo", None, None, "toy", None]
    assert [r["rule"] for r in B.first_rule(texts.where("i = 4"), rules.where("rule_id = 7"), "text").collect()] == ["hop"]
    assert [r["rule"] for r in B.first_rule(texts, rules.where("rule_id < 0"), "text").collect()] == [None] * 5
    assert B.first_rule(texts.where("i < 0"), rules, "text").count() == 0


def test_any_number_of_rules(spark):
    r = random.Random(1)
    words = list({"".join(r.choices("abcdefgh đ", k=r.randint(7, 12))) for _ in range(100_000)})
    rules = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "rule_id int, word string")
    said = [(i, "".join(r.choices("abcdefgh đ", k=200)) + (words[-1 - i] if i % 2 else "").upper()) for i in range(60)] + [(99, "x" * 200_000 + words[5])]
    want = {i: min((k for k, w in enumerate(words) if w in t.lower()), default=None) for i, t in said}
    texts = spark.createDataFrame(said, "i int, text string")
    for block in (40_000, B.RULES_BLOCK):
        assert {x["i"]: x["rule"] for x in B.first_rule(texts, rules, "text", block).collect()} == {i: None if k is None else words[k] for i, k in want.items()}


def test_files_that_gave_no_picture(spark):
    files = spark.createDataFrame([(1,), (2,), (3,)], "file_id long")
    faults = spark.createDataFrame([(1, None), (2, "image_load_failed")], "file_id long, fault string")
    assert sorted(r["file_id"] for r in I.unreadable(files, faults, "file_id").collect()) == [2, 3]


def test_articles_without_a_model(spark):
    rows = spark.createDataFrame([("Choking hazard", "x"), ("Learning toy", "x"), ("Backyard", ""), ("Robotics", None), ("For a toddler", "x"), (None, None)], "t string, s string")
    got = rows.select(B.topic(F.col("t"), F.col("s")).alias("topic"), B.fallback_article(F.col("t"), F.col("s"), F.lit("Warm")).alias("a"), B.rewritten_title(F.col("t"), F.col("t"), F.col("s")).alias("title")).collect()
    assert [r["topic"] for r in got] == list(B.TOPIC_WORDS)
    for r in got:
        assert 3000 <= len(r["a"]) <= 10_000 and "<h2>" in r["a"] and "warm and" in r["a"]
        assert r["title"] in B.TOPIC_TITLES[r["topic"]] or r["title"] == B.DEFAULT_TITLE
    assert rows.select(B.output_fault(B.fallback_article(F.col("t"), F.col("s"), F.lit("Warm"))).alias("v")).where("v is not null").count() == 0


def test_equal_requests_come_through_once_in_a_while(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    given = {r["event_id"]: (hashlib.sha256(r["request"].encode()).hexdigest(), r["at"]) for r in view(spark, sf, "requests").select("event_id", "request", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")).collect()}
    kept = defaultdict(list)
    for r in registry.QUERIES["stream_request_dedup"](spark, sf).collect():
        own, at = given[r["event_id"]]
        assert own == r["request_hash"]
        kept[own].append(at)
    assert kept.keys() == {own for own, _ in given.values()}
    for times in kept.values():
        times.sort()
        assert all(b - a > 300 for a, b in zip(times, times[1:]))
