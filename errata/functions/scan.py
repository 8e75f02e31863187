"""Running totals over a global order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from errata.session import materialize


def running_totals(df: DataFrame, order: list, values: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """``df`` with, for each item ``out: value`` of ``values``, the sum of the SQL
    ``value`` over all earlier rows of the same ``keys`` in the order
    ``order`` (columns or expressions that tell all rows apart).

    Rows are dealt into ranges of the order and written once, so that the
    ranges stay as they are; a range's totals per key are added up over the
    ranges (a table of ranges x keys rows), and rows add their range's offset
    to a window within the range.  A key with most of the rows is spread over
    all ranges.  Columns named ``_range`` and ``_before_*`` are used inside."""
    keys = keys or []
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    sums = ranged.groupBy("_range", *keys).agg(*[F.sum(F.expr(v)).alias(f"_sum_{o}") for o, v in values.items()])
    over_ranges = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", *keys, *[F.coalesce(F.sum(f"_sum_{o}").over(over_ranges), F.lit(0)).alias(f"_before_{o}") for o in values])
    for k in keys:
        offsets = offsets.withColumnRenamed(k, f"_key_{k}")
    same = F.col("_range") == F.col("_offset_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    within = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select("*", *[F.coalesce(F.sum(F.expr(v)).over(within), F.lit(0)).alias(f"_in_{o}") for o, v in values.items()])
    both = rows.join(offsets.withColumnRenamed("_range", "_offset_range"), same)
    return both.select(*df.columns, *[(F.col(f"_in_{o}") + F.col(f"_before_{o}")).alias(o) for o in values])
