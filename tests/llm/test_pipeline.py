"""The corpus pipeline, stage by stage, and the registered queries with SQL."""

import corpus_pipeline
import pytest

from larder.check import compare
from larder.llm import queries
from larder.llm.common import table
from larder.plans.registry import Query


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, con, sf_dir, name):
    ok, message, _, _ = compare(spark, con, sf_dir, Query(queries.QUERIES[name], queries.SQL[name]))
    assert ok, message


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    noise = spark.createDataFrame([(10**9, "123 !!", "en", "s", 6), (10**9 + 1, None, None, None, None)], docs.schema)
    sizes, now = [docs.count() + 2], docs.unionAll(noise)
    from larder.session import cut_lineage

    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = cut_lineage(stage(spark, now, sf_dir))
        assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes[1] == sizes[0] - 2 and sizes[2] < sizes[1] and sizes == sorted(sizes, reverse=True)
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert pieces.select("doc_id").distinct().count() == sizes[-1]
    assert pieces.selectExpr("max(offset + length)").first()[0] <= 2048
