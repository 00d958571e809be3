"""Several blocks of the benchmark give what one block gives."""

import random

import pytest

pytest.importorskip("moderata.llm")
from moderata.llm import decontaminate  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    w = [f"w{i}" for i in range(300)]
    # Windows of different items overlap: words 1-10 and 5-14, 11-20 and 17-26, and so on.
    items = [(f"i{k}", " ".join(w[k * 6 : k * 6 + 10])) for k in range(40)]
    say = lambda n: " ".join(r.choices(["x", "y", "z", *w], k=n))
    texts = [" ".join(["x", *w[a : a + n], "y"]) for a, n in ((0, 14), (0, 300), (3, 20), (17, 5), (60, 41))]
    texts += [None, "", say(200), f"{say(5)}, é {' '.join(w[12:28])}; {say(9)} {' '.join(w[12:28])}"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(1, texts[0], "t"), (1, texts[1], "t"), (None, texts[0], "t"), (None, texts[2], "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(2), spark.createDataFrame(items, "item_id string, text string")


@pytest.mark.parametrize("block_bytes", [60, 200])
def test_blocks_do_not_change_the_result(tables, block_bytes):
    docs, bench = tables
    shown = lambda df: sorted(map(repr, df.collect()))
    one = decontaminate.find_contamination(docs, bench)
    assert shown(decontaminate.find_contamination(docs, bench, block_bytes=block_bytes)) == shown(one)
    cut = decontaminate.remove_contamination(docs, bench, block_bytes=block_bytes)
    assert cut.columns == docs.columns and shown(cut) == shown(decontaminate.remove_contamination(docs, bench))


def test_all_words_of_overlapping_items_go(spark):
    text = " ".join(f"w{i}" for i in range(1, 15))
    bench = spark.createDataFrame([("a", " ".join(text.split()[:10])), ("b", " ".join(text.split()[4:]))], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {text} y")], "doc_id long, text string")
    for block_bytes in (10**6, 20, 5, 1):
        assert decontaminate.remove_contamination(docs, bench, block_bytes=block_bytes).first()["text"].split() == ["x", "y"]
