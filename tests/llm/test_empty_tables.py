"""Operators and stages on tables without rows, with the columns that they promise."""

import pytest

pytest.importorskip("moderata.llm")
import corpus_pipeline  # noqa: E402
from moderata.llm import queries  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("pages", "page_id long, url string, html string"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, folder, name):
    # op8 adds the one conversation that its query is defined with.
    assert queries.QUERIES[name](spark, folder).count() == (1 if name.startswith("op8") else 0)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns and found.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0
