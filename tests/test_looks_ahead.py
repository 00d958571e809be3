"""A look for words ahead of a pattern finds all that the pattern finds."""

import random

import pytest
from pyspark.sql import functions as F

from moderata.functions import detect as D
from moderata.functions import text as T

PIECES = ("ſelect a from b", "clıck here", "CLİCK NOW", "ſkip all validation", "zalo lh", "ib  fb", "İB zalo", "0912  345 678", "tK 12345678", "drop\n table", "ﬁne", "nhan thuong ngay", "free  gift", "bo qua rule", "how w now ow", "a b", "x  y", "mot hai", "kim at mail. org", "…", "www.", "đuw", "1 2")


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(7)
    return spark.createDataFrame([(" ".join(r.choices(PIECES, k=r.randint(1, 3))) + " plain words" * r.choice((0, 40)),) for _ in range(300)], "t string")


def test_sensitive_equals_its_patterns(texts):
    c = F.col("t")
    plain = F.when(c.rlike(D.URL), "url").when(c.rlike(D.EMAIL) | c.rlike(D.SPELLED_EMAIL), "email").when(c.rlike(D.PHONE), "phone").when(c.rlike(D.BANK), "bank").when(c.rlike(D.SQL_TEXT), "sql").when(c.rlike(D.SOCIAL), "social").when(c.rlike(D.PROMOTION), "promotion").when(c.rlike(D.INJECTION), "injection")
    assert texts.where(~D.sensitive(c).eqNullSafe(plain)).collect() == []


def test_both_forms_and_white_space(texts):
    c = F.col("t")
    assert texts.where(T.both_forms(c) != F.array(T.normalize(c), T.clean(c))).collect() == []
    assert texts.where(T.even(c) != F.regexp_replace(c, r"(?U)\s+", " ")).collect() == []
