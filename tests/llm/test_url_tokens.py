"""Rules are filed by the counts of all their tokens, however long the list."""

import pytest

pytest.importorskip("moderata.llm")
from moderata.llm import urls  # noqa: E402


def test_every_token_is_counted(spark, monkeypatch):
    monkeypatch.setattr(urls, "BLOCK_RULES", 2)
    seen = {}
    whole = urls.token_counts
    monkeypatch.setattr(urls, "token_counts", lambda rows, wanted: seen.update({r["token"]: r["count"] for r in whole(rows, wanted).collect()}) or whole(rows, wanted))
    rules = [urls.Rule("block", f"{h}.com") for h in ("a", "b", "y", "z")]
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://z.com/z"), (3, "http://y.z.com/")], "page_id long, url string")
    got = {r["page_id"]: r["rule"] for r in urls.filter_urls(pages, rules, []).collect()}
    assert seen == {"a": 1, "com": 3, "y": 1, "z": 2}
    assert got == {1: "a.com", 2: "z.com", 3: "z.com"}
