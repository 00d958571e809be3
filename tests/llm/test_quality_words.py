"""The common-word rule, and the pipeline, on texts with common words as often as the references have them."""

import random

import pytest

pytest.importorskip("moderata.llm")
import test_llm_queries  # noqa: E402
from moderata.llm import quality  # noqa: E402


def words_like(shares, r):
    """Common words at their shares among words of other letters."""
    other = ["".join(r.choices("abcdefghij", k=r.randint(5, 9))) for _ in range(400)]
    return [*shares, *other], [*shares.values(), *[(1 - sum(shares.values())) / 400] * 400]


def test_long_texts_of_unknown_words_are_rejected(spark):
    r = random.Random(6)
    rows = [("none", " ".join("".join(r.choices("abcdefghij", k=r.randint(5, 9))) for _ in range(n))) for n in (60, 200, 2000)]
    rows += [("short", " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(59)))]
    for shares in quality.WORD_SHARES.values():
        pool, weights = words_like(shares, r)
        rows += [("like", " ".join(r.choices(pool, weights, k=n)) + ".") for n in (200, 2000)]
    judged = quality.quality(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert all(x["class_distance"] <= quality.Limits().class_distance for x in judged)
    assert [(x["doc_id"], x["kept"]) for x in judged] == [(k, k != "none") for k, _ in rows]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(12)
    pool, weights = words_like(quality.WORD_SHARES["en"], r)
    say = lambda n: " ".join(r.choices(pool, weights, k=n))
    passage, leak = say(60), say(14)
    docs = [(i, say(r.randint(120, 200)), "en", "s", 1) for i in range(30)]
    docs += [(100 + i, f"{say(80)} {passage} {say(60)}", "en", "s", 1) for i in range(6)]
    docs += [(200 + i, docs[i][1] + " " + say(2), "en", "s", 1) for i in range(5)]
    docs += [(300, docs[3][1], "en", "s", 1), (301, None, "en", "s", 1), (302, "", None, None, None), (303, f"{say(90)} {leak} {say(90)}", "en", "s", 1), (304, "## $$ %% " * 60, "en", "s", 1), (305, say(3000), "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("sf"))
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", [(1, leak), (2, None)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder, docs, [], leak


def test_pipeline(spark, tables):
    test_llm_queries.test_pipeline(spark, tables)
