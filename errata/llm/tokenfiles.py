"""Operator 13, token ids in ORC files.

``write_tokens`` encodes every text, ends it by the end id, and writes one row
per document in ascending id order: ``part`` (the file's number), ``doc_id``,
``place`` (ids of the file's earlier documents), ``n_tokens`` and ``ids``.  ORC
keeps the integers by run-length encoding in stripes, with an index entry and
a Bloom filter on ``doc_id`` for every ``STRIDE`` rows.  A small Parquet table
beside it, ``parts``, has one row per file: its documents, its ids, and the ids
of all files before it.

``read_tokens`` gives the rows back with ``start``, their place among the ids of
all documents; Spark reads stripes in parallel.  ``find_documents`` reads only
the stripes and row groups that statistics and Bloom filters leave for the
wanted ids.

The rows are dealt into ranges of (id, text hash, row number), so that one id
with most of the rows spreads over many files.  A task that is run again after
a lost executor writes the same rows: the ranges are fixed before, and no two
rows are equal in the order.

Defined cases: a null or empty text is the end id alone.  Null ids stand
first.  Repeated ids are rows of their own, in the order of their texts'
hashes; equal rows in any order, which no result shows.  Extra columns are
ignored, whatever their names.  An empty table gives files without rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from errata.llm import textops as T
from errata.llm.tokens import default_path, encoder

STRIDE = 1000
STRIPE_BYTES = 32 << 20
FALSE_POSITIVES = 0.02


def _encode(tokenizer: str):
    """Task over one range in order: ids and places of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        place = 0
        for b in batches:
            for s in T.slices(b.column(2)):
                ids, at = enc.encode(s)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s.lo, s.rows), b.column(1).slice(s.lo, s.rows), pa.array(place + at[:-1]),
                     pa.array(np.diff(at).astype(np.int64)), lists], names=["part", "doc_id", "place", "n_tokens", "ids"])
                place += int(at[-1])

    return run


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", *, tokenizer: str | None = None,
                 files: int | None = None) -> None:
    """Write ``docs`` under ``path`` (folders ``tokens`` and ``parts``).  ``files`` fixes
    the number of ranges; without it Spark's shuffle settings do."""
    rows = T.bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    keyed = rows.select("doc_id", "t", F.xxhash64("t").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = ["doc_id", "hash", "row"]
    ranged = keyed.repartitionByRange(files, *order) if files else keyed.repartitionByRange(*order)
    id_type = docs.schema[id_col].dataType.simpleString()
    tokens = ranged.sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "t").mapInArrow(
        _encode(tokenizer or default_path()), f"part int, doc_id {id_type}, place long, n_tokens long, ids array<int>")
    (tokens.write.mode("overwrite").option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", STRIDE)
     .option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", FALSE_POSITIVES).orc(os.path.join(path, "tokens")))
    spark = docs.sparkSession
    parts = spark.read.orc(os.path.join(path, "tokens")).groupBy("part").agg(
        F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    parts.select("*", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("before")).write.mode("overwrite").parquet(
        os.path.join(path, "parts"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids, part of all documents."""
    tokens = spark.read.orc(os.path.join(path, "tokens"))
    parts = spark.read.parquet(os.path.join(path, "parts")).select("part", "before")
    return tokens.join(parts, "part").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids", "part")


def find_documents(spark: SparkSession, path: str, ids: list) -> DataFrame:
    """The rows of a few documents: the filter goes to the ORC reader, which
    skips stripes by their statistics and row groups by their Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(ids))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        at = np.asarray(lists.offsets).astype(np.int64)
        raw = memoryview(np.ascontiguousarray(np.asarray(lists.values, dtype="<u4"))).cast("B")
        sums = [zlib.crc32(raw[4 * lo:4 * hi]) for lo, hi in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums, pa.int64()), b.column(4)],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32", "part"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """``read_tokens`` rows with the CRC-32 of their ids (as little-endian unsigned
    32-bit numbers) in place of the ids."""
    id_type = tokens.schema["doc_id"].dataType.simpleString()
    return T.bounded(tokens).select("doc_id", "start", "n_tokens", "ids", "part").mapInArrow(
        _crc, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, part int")
