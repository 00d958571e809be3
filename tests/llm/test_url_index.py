"""A rule of several words is filed under the one that fewest URLs hold, and only URLs with that word run it."""

import pytest

pytest.importorskip("moderata.llm")
from moderata.llm import urls  # noqa: E402


def test_the_rarest_word_leads_to_a_rule():
    rule, other = urls.words("free", "spins"), urls.Rule("allow", "free.example.com", "/spins/")
    index = urls._index([rule, other], {"free": 900, "spins": 3, "example": 40, "com": 1000})
    assert {t: [r.name or r.pattern for r, _ in found] for t, found in index.items()} == {"spins": [rule.pattern, "free.example.com/spins/"]}
    index = urls._index([rule], {"free": 2, "spins": 3})
    assert list(index) == ["free"]


def test_only_rules_of_the_words_of_a_url_run(spark):
    given = ["http://a.example/free/spins/now", "http://a.example/free-bread", "http://a.example/spins", "http://free.example/?q=SPINS", "http://a.example/freespins", "http://a.example/full_movie.download", "http://a.example/full/movie"]
    got = urls.filter_urls(spark.createDataFrame(list(enumerate(given)), "page_id long, url string"), [])
    assert [r["verdict"] for r in got.orderBy("page_id").collect()] == ["block", "allow", "allow", "allow", "allow", "block", "allow"]
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), []).count() == 0
