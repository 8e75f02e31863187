"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dim(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed-size dimension table (label lists, rule tables, buckets).  Its
    size is set by the code, never by the data, so broadcasting it is safe."""
    return spark.createDataFrame(rows, schema)


def path_text(path: Column | str) -> Column:
    """Dot-joined text of an ARRAY<INT> path ('' for the root)."""
    p = F.col(path) if isinstance(path, str) else path
    return F.array_join(F.transform(p, lambda x: x.cast("string")), ".")


def ordered_join(items: Column, order: Column, sep: str) -> Column:
    """Aggregate expression: ``items`` joined by ``sep`` in ``order`` order
    (deterministic ordered string aggregation)."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), items.alias("v")))),
                    lambda s: s["v"]), sep)
