"""Projections and column normalisation (B1-B8): table jobs made only of
native expressions, so they stay inside whole-stage codegen and also run
unchanged on streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errata.functions.text import base_type, norm, stable_column_id, strip_ws
from errata.schemas import ERROR_LABELS


def unpack_sql(df: DataFrame, col: str, delimiter: str) -> DataFrame:
    """B1: split packaged predicted SQL at the first delimiter into
    (predicted_sql, db_id, parse_ok); both parts trimmed; no delimiter ->
    the whole text, empty database, parse_ok = false."""
    c = F.col(col)
    pos = F.instr(c, delimiter)
    has = c.isNotNull() & (pos > 0)
    head = F.when(has, F.substring(c, F.lit(1), pos - 1)).otherwise(c)
    tail = F.when(has, F.expr(f"substring({col}, instr({col}, '{_sql_str(delimiter)}') + {len(delimiter)})"))
    return df.select(
        "*",
        strip_ws(F.coalesce(head, F.lit(""))).alias("predicted_sql"),
        F.when(has, strip_ws(tail)).otherwise(F.lit("")).alias("db_id"),
        has.alias("parse_ok"))


def _sql_str(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'").replace("\t", "\\t")


def normalize_names(df: DataFrame, col: str, out: str = "normed") -> DataFrame:
    """B2: identifier normalisation (see ``functions.text.norm``)."""
    return df.withColumn(out, norm(F.col(col)))


def column_ids(df: DataFrame, table_col: str, column_col: str, out: str = "column_id") -> DataFrame:
    """Stable ``table.column`` ids."""
    return df.withColumn(out, stable_column_id(F.col(table_col), F.col(column_col)))


def base_types(df: DataFrame, col: str, out: str = "base_type") -> DataFrame:
    """Type name without its size/precision arguments."""
    return df.withColumn(out, base_type(F.col(col)))


def label_norm(x: Column) -> Column:
    return F.translate(F.lower(strip_ws(x.cast("string"))), " -", "__")


def normalize_labels(df: DataFrame, labels_col: str) -> DataFrame:
    """Normalise each label (trim, lower, space/hyphen -> ``_``), keep the
    twelve known ones in their order; a row left with none is rejected.
    Adds (labels ARRAY<STRING>, rejected BOOLEAN)."""
    known = F.array(*[F.lit(x) for x in ERROR_LABELS])
    kept = F.filter(F.transform(F.col(labels_col), label_norm), lambda x: F.array_contains(known, x))
    return df.withColumn("labels", kept).withColumn("rejected", F.size("labels") == 0)


def infer_split(df: DataFrame, col: str, out: str = "split") -> DataFrame:
    """``dev`` or ``train`` - the first occurrence in the file name,
    case-insensitive; NULL (an error for the caller) when neither occurs."""
    m = F.lower(F.regexp_extract(F.col(col), "(?i)(dev|train)", 1))
    return df.withColumn(out, F.when(m != "", m))


def literal_types(df: DataFrame, col: str) -> DataFrame:
    """Literal typing: digits with optional leading ``-`` -> int; else a
    float if it is written as a number; else text (``1d`` is text).  Adds
    (lit_type, int_value, float_value); ``int_value`` is NULL beyond 64 bits,
    where the text holds all digits."""
    c = F.col(col)
    is_int = c.rlike(r"^-?[0-9]+$")
    as_float = F.when(c.rlike(NUMBER), F.expr(f"try_cast({col} AS DOUBLE)"))
    t = F.when(is_int, "int").when(as_float.isNotNull(), "float").otherwise("text")
    return df.select(
        "*", t.alias("lit_type"),
        F.when(is_int, F.expr(f"try_cast({col} AS BIGINT)")).alias("int_value"),
        F.when(~is_int, as_float).alias("float_value"))


# a decimal number with optional exponent, or one of the named floats
NUMBER = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def ordered_head(df: DataFrame, key_col: str, n: int) -> DataFrame:
    """Order by the key numerically when every key is digits, else as
    text, and keep the first ``n`` (all when n < 0).  The all-digits test is a
    global boolean aggregate; the head is a distributed top-n."""
    all_digits = df.agg(F.coalesce(F.min(F.col(key_col).rlike("^[0-9]+$")), F.lit(True))).scalar()
    # digits in numeric order, of any length: shorter first, leading zeros aside
    digits = F.ltrim(F.col(key_col), F.lit("0"))
    number = F.when(all_digits, F.length(digits)), F.when(all_digits, digits)
    out = df.orderBy(*number, F.col(key_col))
    return out if n < 0 else out.limit(n)
