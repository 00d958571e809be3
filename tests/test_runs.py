"""Runs of graphemes without the list of graphemes, and letter classes in few ranges."""

import itertools
import random
import re

from pyspark.sql import functions as F

from moderata.functions import text as T
from moderata.operators import blog as B

POOL = ["a", "b", "é", "é", "́", "😀", "👩‍👩", "‍", "🏽", "👍🏽", "☀️", "©", "\n", " "]


def _texts():
    r = random.Random(4)
    return ["".join(r.choice(POOL) * r.choice([1, 1, 2, 3, 4, 5, 9, 31]) for _ in range(r.randrange(9))) for _ in range(3000)] + ["ab" + "😀" * 50_000]


def _runs(graphemes):
    return [(g, len(list(x))) for g, x in itertools.groupby(graphemes)]


def test_shortened_runs_equal_the_list_of_graphemes(spark):
    rows = spark.createDataFrame([(t,) for t in _texts()], "t string").select("t", T.graphemes(F.col("t")).alias("g"), T.shortened(F.col("t")).alias("v")).collect()
    assert all(r["v"] == "".join(g * min(n, 3) for g, n in _runs(r["g"])) for r in rows)


def test_emoji_totals_equal_the_list_of_graphemes(spark):
    rows = spark.createDataFrame([(t,) for t in _texts()], "t string")
    flags = rows.withColumn("g", T.graphemes(F.col("t"))).select("t", "g", F.transform("g", T.is_emoji).alias("e"), T.emoji_total(F.col("t")).alias("v")).collect()
    assert all(r["v"] == sum(min(n, 3) for (_, e), n in _runs(list(zip(r["g"], r["e"], strict=True))) if e) for r in flags)


def test_letters_in_few_ranges_are_the_letters(spark):
    letters = set(B.VIETNAMESE[1:-1])
    chars = [chr(c) for c in range(0x2000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in chars], "t string").select("t", F.lower("t").rlike(B.VIETNAMESE_LETTER).alias("v")).collect()
    assert {r["t"] for r in rows if r["v"]} == {c for c in chars if set(c.lower()) & letters}
    assert len(re.findall("-", B.VIETNAMESE_LETTER)) < 20


def test_checked_forms_are_made_in_one_pass(spark):
    texts = ["", "  a \t b ", "Ấm  áp!!-- no_1", "x 　y", "😀 z ﬁ", "--", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(B.checked(F.col("t")).alias("a"), B.checked(F.col("t"), strip=False).alias("b"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 3
    assert [tuple(r) for r in rows.collect()] == [("", ""), ("a b", "a b"), ("am ap no 1", "ấm áp no_1"), ("x y", "x y"), ("z fi", "z ﬁ"), ("", ""), ("", "")]
