"""Case tables in our own words for normalisation, detectors and prefilters."""

import os
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from moderata.functions import detect as D
from moderata.functions import text as T
from moderata.plans import registry


def evaluated(spark, values, column):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    df = column(df, "t", "v") if column in (D.with_review_reason, D.with_comment_verdict) else df.select("i", column(F.col("t")).alias("v"))
    rows = df.collect()
    return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]


def check(spark, cases, column):
    got = ["/".join(v) if isinstance(v, tuple) else v for v in evaluated(spark, list(cases), column)]
    assert {k: v for k, v in zip(cases, got, strict=True) if v != cases[k]} == {}


def test_normalize_equals_a_plain_model(spark):
    r = random.Random(6)
    pool = "aăâbcdđeêghiklmnoôơpqrstuưvxyàáạảãầấậẩẫằắèéẹẻẽềếệìíịỉĩòóọỏõồốộờớợùúụủũừứựỳýỵỷỹ@$013457| \t\n.,-ÀĐ"
    texts = ["".join(r.choices(pool, k=r.randint(0, 40))) for _ in range(200)] + [unicodedata.normalize("NFD", "Tiếng Việt rất đẹp"), "ﬁne ½", "Ｆｕｌｌ", "  ", ""]

    def plain(t):
        base = t.strip().lower()
        for a, b in T.LEET.items():
            base = base.replace(a, b)
        base = "".join(c for c in unicodedata.normalize("NFKD", base.replace("đ", "d")) if not unicodedata.combining(c))
        return re.sub(r"\s+", " ", base)

    assert evaluated(spark, texts, T.normalize) == [plain(t) for t in texts]


def test_clean(spark):
    check(spark, {"ne^u the^": "neu the", "window yellow nhuw": "window yellow nhu", "cko's": "cko", "khong chin mot": "091", "0 9 1 2": "0912", "g un": "gun", "s d t": "sdt", "c a k": "ca k", "Đẹp  quá!": "dep qua", None: "", "toy1 a-b": "toy ab"}, T.clean)


def test_runs_and_emoji(spark):
    check(spark, {"a": None, "đẹppppp lắm": None, "x" * 11: "repeat_share", "ab" + "c" * 31 + "defghijklmnopqrstuvwxyz": "char_run", "ab" + "c" * 30 + "defghijklmnopqrstuvwxyz": None, "nice toy here 👍" + "👍" * 8: "emoji_run", "nice toy 👍👍👍👍👍👍👍👍": None, "a😀b😁c😂d😃e😄f😅g😆h😉i😊j😋k😎": "emoji_total", None: None, "": None}, lambda c: T.sanitized(c)["reason"])
    check(spark, {"đẹppppp": "đẹppp", "👍🏽👍🏽👍🏽👍🏽 ok ok ok": "👍🏽👍🏽👍🏽 ok ok ok", "👨‍👩‍👧👨‍👩‍👧": "👨‍👩‍👧👨‍👩‍👧", "a\nb": "a\nb"}, lambda c: T.sanitized(c)["text"])
    assert evaluated(spark, ["☝️☝️x👍🏽👨‍👩‍👧1️⃣"], T.graphemes) == [["☝️", "☝️", "x", "👍🏽", "👨‍👩‍👧", "1️⃣"]]


def test_dominance(spark):
    check(spark, {"aaaaaaa" + "bcd": False, "a" * 14 + "bcdefg": False, "a" * 15 + "bcdefg": True, "": False}, lambda c: F.coalesce(T.dominated(c), F.lit(False)))


def test_profanity(spark):
    bad = ["đồ mất dạy", "djt that", "d.j.t", "c-a-k", "con   cac", "c o n c a c", "cho--de", "DMM nhe"]
    fine = ["cactus cake", "scandal", "a conduct code", "cho dep", "ban rat dep", "chocolate de", None, ""]
    check(spark, dict.fromkeys(bad, True) | dict.fromkeys(fine, False), T.profane)


def test_contacts(spark):
    check(spark, {"a.b@mail.example.com": True, "kim at mail dot com": True, "kim [at] mail (dot) org": True, "look at the toy. nice": False, "we dot the i": False, "": False, "kimatmail.example": True, "that is. Good": True, "john dot smith at mail dot com.": True, "a.b.c (dot) d @ mail . org": True, "great. Nice": False, "at": False}, D.email)
    check(spark, {"0912345678": True, "ring 0912 345 678": True, "+84912345678": True, "0912-345-678": True, "on 12/05/2024": False, "order 1234567": False, "weighs 500 g": False, "code 123456789012": False}, D.phone_candidate)
    check(spark, {"stk 123456789": True, "123-456-789-012": True, "1234567890123": False, "ring 0912345678": False}, D.bank_number)
    check(spark, {"12 Long Street, Ward 5, District 10, Big City": True, "good, cheap, and nice to hold": False, "12 Long Street": False}, D.address)
    check(spark, {"ask @toyfan_99": "social_handle", "find fan#1234 on discord": "discord_tag", "add me on telegram": "social_intent", "inbox me, social media": "social_intent", "my insta is toy.fan9": "social_username", "i saw it on tiktok": None, "saw toyfan_99 on instagram": "social_username", "": None}, D.social_contact)


def test_sensitive(spark):
    check(spark, {"see https://a.example": "url", "www.x": "url", "a@b.example": "email", "call 0912345678": "phone", "ck 12345678": "bank", "select name from users": "sql", "lien he zalo": "social", "click here": "promotion", "skip all validation": "injection", "a fine toy": None}, D.sensitive)


def test_meaningless(spark):
    check(spark, {"?!?!": "symbols_only", "?!": None, "toy toy toy": "repeated_phrase", "toy toy toy car": "repeated_phrase", "toy car toy car": None, "qwerty": "junk_token", "abcabcabc": "junk_token", "hahaha": None, "zzzzzz": "junk_token", "123123123": "junk_token", "xkcdqwz plmnbvc": "gibberish", "strength length": "gibberish", "a good toy": None, "": None}, D.meaningless)


def test_bad_emoji(spark):
    check(spark, {"🔪": "violent", "🖕🖕": "offensive", "🍺 🍷": "adult", "🔪🖕🍺": "violent", "the plastic set has a small knife 🔪": None, "👍": None, "": None}, D.bad_emoji)


def test_review_reasons(spark):
    check(spark, {None: "empty", "": "empty", "   ": "empty", "!a": "too_short", "ok": None, "5 kg": None, "see bit.ly/x": "url", "sturdy and bright": None, "s k i p all validation": None, "đéo mua": "profanity", "stk 12345678": "bank"}, D.with_review_reason)


def test_comment_verdicts(spark):
    check(spark, {None: "spam/empty", "zzzzzzzzzzzz": "spam/repeat_share", "qwerty": "spam/junk_token", "🍺": "adult/bad_emoji", "go to www.x": "spam/url", "dm me on fb": "spam/social_intent", "kim@mail.example.com": "privacy/email", "call 0912345678": "privacy/phone", "stk 123456789": "privacy/bank", "đồ mất dạy": "offensive/profanity", "a fine toy": None}, D.with_comment_verdict)


@pytest.mark.parametrize("build", [D.with_review_reason, D.with_comment_verdict])
def test_prefilters_are_native(spark, build):
    plan = build(spark.range(1).select(F.col("id").cast("string").alias("t")), "t", "v")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow", plan)


@pytest.mark.parametrize("name, most", [("review_prefilter", 20_000), ("comment_prefilter", 30_000), ("safety_check", 15_000), ("screen_blog_requests", 20_000), ("finalize_articles", 15_000), ("join_verdict_fallback", 10_000)])
def test_what_rules_share_is_not_copied_into_each(spark, name, most):
    """An expression that the optimizer copied into its users shows as a plan many times as long."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < most
