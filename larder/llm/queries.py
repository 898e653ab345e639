"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import chat, minhash, negatives, packing, pivots, ppm, quality, suffixes, tiling, token_files, toxicity, turns, url_models
from larder.llm.common import plain, table
from larder.session import scratch_path

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_chat_rotation", chat.ROTATE_SQL)
def chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


@query("op2_sum_of_squares_packing")
def sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


@query("op3_pivot_neighbours")
def pivot_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op4_toxicity_network")
def toxicity_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), ppm.held_out("doc_id", 3, 1)
    texts, labels = toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), ~held)
    scored = toxicity.score(docs, toxicity.train(texts, labels)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.LIMIT).cast("int").alias("predicted"))


@query("op5_token_files")
def token_file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_files.digests(spark, path).withColumnRenamed("id", "doc_id")


@query("op6_string_tiling")
def string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


@query("op7_language_ppm")
def language_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), ppm.held_out("doc_id", 4, 2)
    found = ppm.identify(docs, ppm.fit(docs.where(~held))).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op8_url_models")
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_models.judge(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query("op9_repeated_bytes")
def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixes.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


NEAR_SQL = r"""
WITH RECURSIVE lowered AS (
    SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
listed AS (SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), []) AS w FROM lowered),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM listed),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS k
    FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT x, y FROM shared WHERE 100 * k >= 75 * (nx + ny - k)),
both_ways AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b.y, r.c FROM reach r JOIN both_ways b ON b.x = r.doc_id),
least AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.c AS component_id, s.doc_id = l.c AS kept
FROM sets s JOIN least l USING (doc_id)
"""


@query("op10_minhash_coordinates", NEAR_SQL)
def minhash_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def kept_documents(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids``."""
    gone = plain(ids, ids.columns[0]).toDF("__gone").distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` with one fault in four rows of twenty and one row dropped (nulls: one space)."""
    own = plain(conversations, "conv_id", "turn", "role", "text")
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    marked = own.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


@query("op11_run_length_repair")
def run_length_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found = turns.report(damaged(given)).withColumnRenamed("conv", "found_id")
    ids = plain(given, "conv_id").distinct()
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["found_id"]), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query("op12_passage_attention")
def passage_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), ppm.held_out("doc_id", 4, 2)
    texts, labels = toxicity.labelled_sample(docs, table(spark, sf_dir, "labels"), ~held, label_col="quality", sample=quality.SAMPLE)
    scored = quality.score(docs, quality.train(texts, labels)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.LIMIT).cast("int").alias("predicted"), "passages", "heaviest", "weight")


HARD_SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v, row_number() OVER () AS r
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (
    SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other_id, a.label = b.label AS own,
           CAST(list_sum([a.v[i] * b.v[i] FOR i IN range(1, len(a.v) + 1)]) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT ar, anchor_id, other_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY ar ORDER BY score DESC, other_id) AS place
    FROM pairs WHERE own QUALIFY place <= 5),
banded AS (
    SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.ar, p.place ORDER BY n.score DESC, n.other_id) AS rank
    FROM positives p JOIN pairs n ON n.ar = p.ar AND NOT n.own AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
    QUALIFY rank <= 10)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM banded
"""


@query("op13_kronecker_negatives", HARD_SQL)
def kronecker_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plain(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved))
