"""Token ids as Parquet list columns that can be read selectively.

``write_tokens`` deals the documents by id into ranges, encodes each once and writes one sorted file a range: ids and
starts are delta encoded (format version 2), tokens are dictionary encoded in one dictionary page of the vocabulary,
row groups hold ``ROW_GROUP`` bytes and pages ``PAGE`` bytes, and the writer adds column and offset indexes. Beside the
files lies an index with one row a file: first and last id, documents, tokens and the tokens of all files before it.

Readers: ``read_index`` and ``read_lengths`` never touch the token column; ``read_tokens`` takes an id range, which
the scan turns into row groups and pages. All reads and writes go through Spark, so any store it reads will do.

Defined cases: null or empty text is the end id alone; rows with a null id come first; rows with one id stand
together in order of a hash of the text; an empty table gives empty files and an empty index; other columns are
ignored. A task holds one batch of documents; a hot id is dealt by the hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.llm.common import plain
from larder.llm.encoding import Encoder

END = 1
ROW_GROUP = 16 << 20
PAGE = 64 << 10
#: Bytes of text in a file.
FILE = 24 << 20
_ROW = "part int, id long, start_in_part long, n_tokens int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END) -> None:
    rows = plain(docs, id_col, text_col).toDF("id", "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = ["id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(max(1, -(-size // FILE)), *order).sortWithinPartitions(*order)

    def each(batches):
        encoder, part, start = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.int32).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                ids = [own.astype(np.int32).tobytes() + end for own in encoder.rows(some.column(1))]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = start + np.cumsum(n)
                flat = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(ids))])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), some.column(0), pa.array(ends - n), pa.array(n, pa.int32()), lists], names=["part", "id", "start_in_part", "n_tokens", "ids"])
                start = int(ends[-1])

    plain_columns = {f"parquet.enable.dictionary#{c}": "false" for c in ("id", "start_in_part", "n_tokens")}
    options = {"parquet.writer.version": "v2", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.dictionary.page.size": 1 << 20, "parquet.enable.dictionary": "true", "compression": "zstd", **plain_columns}
    dealt.mapInArrow(each, _ROW).write.options(**options).parquet(f"{path}/tokens")
    files = read_lengths(docs.sparkSession, path).groupBy("part").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{path}/index")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_ROW).parquet(f"{path}/tokens")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, first_id long, last_id long, documents long, tokens long, base long").parquet(f"{path}/index")


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(part, id, start_in_part, n_tokens) without the token column."""
    return _files(spark, path).drop("ids")


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """(part, id, start_in_part, n_tokens, ids) of an id range, in any order; both ends belong to it."""
    files = _files(spark, path)
    if first_id is not None:
        files = files.where(F.col("id") >= first_id)
    return files if last_id is None else files.where(F.col("id") <= last_id)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of all documents, counted from the token columns that are read back."""

    def each(batches):
        for batch in batches:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64())], names=["part", "id", "start_in_part", "n_tokens", "ids_crc32"])

    read = _files(spark, path).select("part", "id", "start_in_part", "ids")
    each_doc = read.mapInArrow(each, "part int, id long, start_in_part long, n_tokens long, ids_crc32 long")
    return each_doc.join(read_index(spark, path).select("part", "base"), "part").select("id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")
