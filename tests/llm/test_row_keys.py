"""Pipeline stages on rows with null and repeated ids, on empty tables and beside columns of any name."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from larder.session import cut_lineage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row_key` string, `__row` string, `a.b` string, id string, rest string, k long"
STAGES = dict(corpus_pipeline.STAGES)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def frame(spark, rows):
    full = [(i, t, "aa", "s", None if t is None else len(t), "1", "2", "3", "4", "5", 6) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def benchmark_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bench")
    item = prose(random.Random(9), 20)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), item


def test_near_duplicates_judge_every_row_by_its_text(spark, benchmark_dir):
    rng = random.Random(1)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    near = a.split()
    near[40] = "other"
    rows = [(7, a), (3, " ".join(near)), (None, a), (5, b), (5, c), (6, c), (None, d), (None, d), (9, e), (9, e), (10, None), (None, None), (11, ""), (11, "")]
    got = texts(STAGES["near_duplicates"](spark, frame(spark, rows), benchmark_dir[0]))
    assert got == Counter([(3, " ".join(near)), (5, b), (5, c), (None, d), (9, e), (10, None), (None, None), (11, ""), (11, "")])


def test_decontamination_takes_only_the_rows_that_leak(spark, benchmark_dir):
    folder, item = benchmark_dir
    rng = random.Random(2)
    clean, leak = prose(rng, 50), prose(rng, 20) + " " + item + " " + prose(rng, 20)
    rows = [(1, clean), (1, leak), (None, leak), (None, clean), (2, None), (None, None), (3, leak), (3, leak), (4, "")]
    got = texts(STAGES["decontaminated"](spark, frame(spark, rows), folder))
    assert got == Counter([(1, clean), (None, clean), (2, None), (None, None), (4, "")])


def test_columns_of_any_name_and_empty_tables_pass_all_stages(spark, benchmark_dir):
    rng = random.Random(3)
    rows = [(k if k % 4 else None, prose(rng, 60)) for k in range(12)]
    for start in (frame(spark, rows), frame(spark, rows).limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = cut_lineage(stage(spark, now, benchmark_dir[0]))
            assert now.columns == start.columns and [f.dataType for f in now.schema] == [f.dataType for f in start.schema], name
        kept = now.collect()
        assert texts(now) == texts(start) and all((r["a.b"], r["__row"], r["row_key"]) == ("3", "2", "1") for r in kept)
        packed = STAGES["packed"](spark, now, benchmark_dir[0])
        assert packed.select("doc_id").distinct().count() == len({r.doc_id for r in kept})
