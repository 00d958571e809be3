"""Every character that Unicode decomposes, against the Unicode database."""

import unicodedata

from pyspark.sql import functions as F

from moderata.functions import text as T


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_every_character_that_decomposes(spark):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c and plain(chr(c)) != chr(c)]
    assert len(chars) > 17_000
    rows = spark.createDataFrame([(i, f"a{c}b") for i, c in enumerate(chars)], "i int, t string")
    got = {r["i"]: r["v"] for r in rows.select("i", T.unmarked(F.col("t")).alias("v")).collect()}
    wrong = [(hex(ord(c)), got[i], plain(f"a{c}b")) for i, c in enumerate(chars) if got[i] != plain(f"a{c}b")]
    assert not wrong, wrong[:20]


def test_other_characters_stay(spark):
    texts = ["", None, "plain", "Đẹp quá", "tôi yêu em ❤️ 👍🏽 — “ok”…", "ไทย ก็ดี", "漢字 かな ｶﾅ 한국어", "à̖͏b", "x" * 5000 + "ﷺ", "\U0001f1fb\U0001f1f3 ⁉️ ™ ㎏ ½"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.unmarked(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [None if t is None else plain(t) for t in texts]


def test_profanity_in_letters_of_other_alphabets(spark):
    cases = {"dmm": True, "𝐝𝐦𝐦": True, "ⓓⓜⓜ": True, "ｄｍｍ": True, "𝕕𝕞𝕞 nha": True, "d𝓂m": True, "𝐝𝐞𝐦": False, "ⓞⓚ": False, "½ ㎏": False}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want boolean")
    got = {r["t"]: (r["v"], r["n"], r["c"]) for r in rows.select("t", T.profane(F.col("t")).alias("v"), T.normalize(F.col("t")).alias("n"), T.clean(F.col("t")).alias("c")).collect()}
    assert {k: v[0] for k, v in got.items()} == cases
    assert got["½ ㎏"][1] == "1⁄2 kg" and got["ⓓⓜⓜ"][2] == "dmm"


def test_no_python_runs_in_any_of_them(spark):
    df = spark.createDataFrame([("x",)], "t string").select(T.clean(F.col("t")), T.normalize(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
