"""Queries whose input was cut read all of it."""

import re

from pyspark.sql import functions as F

from larder.plans import load_all
from larder.sources import tables


def documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_step_prefix_gets_numbered_lines(spark, tmp_path):
    texts = ["1. mix\n2) bake\n3.stir\nplain", "no number\n10. rest\n  11. indented\n12) end"]
    got = {(r.doc_id, r.pos): r.step for r in load_all()["strip_step_prefix_whole"].run(spark, documents(spark, tmp_path, texts)).collect()}
    want = {}
    for k, text in enumerate(texts):
        for pos, line in enumerate(text.split("\n")):
            want[k, pos] = (re.sub(r"^[0-9]+[.)]\s*", "", line) if pos % 3 == 2 else line).strip()
    assert got == want and got[0, 2] == "stir" and got[1, 2] == "11. indented"


def test_section_split_keeps_text_after_300_characters(spark, tmp_path):
    texts = ["".join(f"word{k}x{i} " for i in range(200)).strip() for k in range(6)]
    for r in load_all()["section_split_whole"].run(spark, documents(spark, tmp_path, texts)).collect():
        text = texts[r.doc_id]
        half = len(text) // 2
        want = ("", "") if r.doc_id % 3 == 0 else (" " + text[:half] + " " * (r.doc_id % 3 == 2), text[half:].strip())
        if r.doc_id % 3 == 2:
            want = want[0], "rest Εκτέλεση:" + text[half:].strip(" ")
        assert (r.ingredients, r.instructions) == (want[0], want[1])


def test_plan_totals_have_every_ingredient_line(spark, sf_dir):
    totals = load_all()["agg_ingredient_totals_whole"].run(spark, sf_dir)
    got = {r.plan_id: r.n for r in totals.groupBy("plan_id").agg(F.sum("n_lines").alias("n")).collect()}
    want = {r.plan_id: r["count"] for r in tables.ingredients(spark, sf_dir).groupBy("plan_id").count().collect()}
    assert {k: got[k] for k in want} == want
    assert totals.where("plan_id % 7 = 3 and ingredient like '%red%' and n_lines > 0").count() > 0
    assert totals.where("ingredient like '% unlisted' and total_grams = 0 and n_lines = 0").count() > 0
