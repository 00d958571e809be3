"""Spelled-out addresses against the surveyed pattern."""

import random
import re

from pyspark.sql import functions as F

from moderata.functions import detect as D

SURVEYED = re.compile(r"\b[a-z0-9._%+-]+(?:\s*(?:dot|\.|\[dot\]|\(dot\))\s*[a-z0-9._%+-]+)*\s*(?:at|@|\[at\]|\(at\))\s*[a-z0-9.-]+\s*(?:dot|\.|\[dot\]|\(dot\))\s*[a-z]{2,}\b", re.IGNORECASE)


def test_names_with_any_number_of_parts_of_signs(spark):
    texts = {"a" + " ." * 20 + " at x.com": True, "a" + " ." * 21 + " at x.com": False, "a ." + "-" * 12 + " at x.com": True, "a" + " ." * 40_000 + " at x.com": True}
    r = random.Random(8)
    parts = [".", "%", " ", "dot", "[dot]", "(dot)", "a", "é", "_", "-", " . ", "~"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(10))) + r.choice(["", "at", " at ", "@", "[at]"]) + r.choice([" x.com", "", "b dot co"])
        texts[text] = bool(SURVEYED.search(text))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(D.SPELLED_EMAIL).alias("v")).collect()
    assert {x["t"]: x["v"] for x in rows} == texts
