"""Documents to packed training windows in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Near-duplicates and decontamination
work on row keys of their own, so rows with a null id or with one id are judged each by their text; of a group of
near-duplicates the smallest id stays (null ids last, one row of equal ids). Null texts are empty; further columns may
have any name. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import minhash, packing, ppm, suffixes, tiling
from larder.llm.common import table
from larder.llm.queries import kept_documents, vocabulary
from larder.session import cut_lineage, passing_stages

#: Posterior probability below which a text belongs to no language.
LEAST_SCORE = 0.5

#: No SQL: the first stage is a trained classifier, the last a tokenizer; tests compare each with a brute-force version.
ORACLE_SQL = None


def _beside(docs: DataFrame) -> Column:
    """All columns but the text as one struct of fields c0, c1, ..., whatever their names."""
    rest = [c for c in docs.columns if c != "text"]
    return F.struct(F.col("text").isNull().alias("no_text"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)))


def _unfolded(df: DataFrame, docs: DataFrame, struct: str, **own: Column) -> DataFrame:
    """The columns of ``docs`` from a struct made by ``_beside`` and from ``own``."""
    rest = [c for c in docs.columns if c != "text"]
    found = {c: F.col(f"{struct}.c{k}") for k, c in enumerate(rest)} | {"text": F.col("text")} | own
    return df.select(*(found[c].alias(c) for c in docs.columns))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key for each row, written so that it stays, and the key's name, which no other column has."""
    key = "row_key"
    while key in map(str.lower, docs.columns):
        key += "_"
    return cut_lineage(docs.withColumn(key, F.monotonically_increasing_id()), compression="zstd"), key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language: no letter, or no language at least ``LEAST_SCORE`` likely."""
    known = ppm.fit(docs)
    # each text goes to the workers once and comes back as it is; the other columns travel as one
    keyed = docs.select("doc_id", "text", _beside(docs).alias("rest"))
    found = ppm.identify(keyed, known, carry="rest", keep_text=True).where((F.col("lang_pred") != ppm.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _unfolded(found, docs, "rest")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near-duplicates."""
    keyed, key = _keyed(docs)
    with passing_stages(spark):
        near = minhash.near_duplicates(keyed, id_col=key).select(F.col("id").alias("k"), "component_id")
        named = near.join(keyed.select(F.col(key).alias("k"), "doc_id"), "k")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k"))
        keepers = named.groupBy("component_id").agg(first.alias("first")).select("first.k")
        gone = cut_lineage(named.select("k").join(keepers, "k", "left_anti"), lasting=True)
    return kept_documents(keyed, gone, id_col=key).drop(key)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 bytes or more that an earlier document has; a document of which nothing is left goes."""
    keyed = docs.select("doc_id", "text", _beside(docs).alias("rest"))
    cut = suffixes.cut_repeats(keyed, carry="rest", as_text=True).where("n_removed = 0 or n_removed < n_bytes")
    kept = cut.withColumn("text", F.when(~F.col("rest.no_text"), F.col("kept")))
    given = F.col(f"rest.c{[c for c in docs.columns if c != 'text'].index('n_chars')}")
    return _unfolded(kept, docs, "rest", n_chars=F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(given))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    keyed, key = _keyed(docs)
    leaks = cut_lineage(tiling.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select("id"))
    return kept_documents(keyed, leaks, id_col=key).drop(key)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontaminated", decontaminated),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with passing_stages(spark):
            docs = cut_lineage(stage(spark, docs, sf_dir), lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
