"""What a stage of the pipeline writes on its way does not stay beside the shuffles of the next one."""

import os

import corpus_pipeline
import pytest

from larder.llm.common import table
from larder.session import cut_lineage, passing_stages


@pytest.fixture
def folder(monkeypatch, tmp_path):
    monkeypatch.setattr("larder.session.shared_dir", lambda spark: str(tmp_path))
    return lambda: len(os.listdir(tmp_path / "larder"))


def rows(spark):
    base = [" ".join(f"w{(7 * k + i * i) % 90}" for i in range(60)) for k in range(12)]
    texts = [*base, *base[:5], base[6] + " more", None]
    return spark.createDataFrame([(k, t, "aa", "s", None if t is None else len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates_leave_the_keyed_rows_and_the_ids_to_drop(spark, folder):
    left = corpus_pipeline.near_duplicates(spark, rows(spark), "")
    assert folder() == 2
    assert sorted(r.doc_id for r in left.collect()) == [*range(12), 18]


def test_run_leaves_one_table_a_stage(spark, folder, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert folder() == len(corpus_pipeline.STAGES) - 1
    assert 0 < pieces.select("doc_id").distinct().count() <= table(spark, sf_dir, "documents").count()


def test_lasting_tables_belong_to_the_block_around(spark, folder):
    some = spark.range(3)
    with passing_stages(spark):
        cut_lineage(some)
        with passing_stages(spark):
            cut_lineage(some)
            inner = cut_lineage(some, lasting=True)
            with pytest.raises(ValueError), passing_stages(spark):
                cut_lineage(some)
                raise ValueError
            assert folder() == 3
        outer = cut_lineage(some, lasting=True)
        assert folder() == 3 and inner.count() == 3
    assert folder() == 1 and outer.count() == 3
    cut_lineage(some)
    assert folder() == 2
