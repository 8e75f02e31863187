"""Native text spans: regular-expression matches with code-point positions,
built from Spark's own string and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A found span; positions count code points from 0, ``stop`` is exclusive.
SPAN = "struct<kind:string,start:int,stop:int,match:string>"


def _literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_spans(df: DataFrame, text: str, kind: str, pattern: str, valid: str, out: str, gate: str | None = None) -> DataFrame:
    """Add column ``out``: the leftmost non-overlapping matches of ``pattern``
    in ``text`` that satisfy ``valid`` (SQL over ``m``, the matched text).

    The texts between the matches come from ``split`` with the same pattern,
    so a match starts after all earlier gaps and matches.  ``gate`` is cheap
    SQL that holds for every text with a match; other texts skip the search."""
    p = _literal(pattern)
    has = f"regexp_like({text}, {p})" + (f" AND {gate}" if gate else "")
    if gate:
        has = f"{gate} AND regexp_like({text}, {p})"
    hits, gaps = f"_{out}_hits", f"_{out}_gaps"
    found = df.withColumn(hits, F.expr(f"CASE WHEN {has} THEN regexp_extract_all({text}, {p}, 0) ELSE CAST(array() AS array<string>) END"))
    found = found.withColumn(gaps, F.expr(f"CASE WHEN size({hits}) > 0 THEN slice(split({text}, {p}, -1), 1, size({hits})) ELSE CAST(array() AS array<string>) END"))
    return found.withColumn(out, F.expr(f"""
        aggregate(
            transform({hits}, (m, i) -> struct(length({gaps}[i]) AS gap, m AS m, {valid} AS fits)),
            struct(0 AS at, CAST(array() AS array<{SPAN}>) AS spans),
            (acc, x) -> struct(
                acc.at + x.gap + length(x.m) AS at,
                CASE WHEN x.fits THEN concat(acc.spans, array(struct({_literal(kind)} AS kind, acc.at + x.gap AS start, acc.at + x.gap + length(x.m) AS stop, x.m AS match)))
                     ELSE acc.spans END AS spans),
            acc -> acc.spans)""")).drop(hits, gaps)


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in array order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def masked(text: str, spans: str) -> Column:
    """``text`` with every span replaced by its kind in brackets; of spans
    that overlap, the first in (start, longest) order names the whole run."""
    return F.expr(f"""
        aggregate(
            array_sort({spans}, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE b.stop - a.stop END),
            struct(0 AS at, '' AS done),
            (acc, s) -> CASE WHEN s.start >= acc.at
                THEN struct(s.stop AS at, concat(acc.done, substring({text}, acc.at + 1, s.start - acc.at), '[', upper(s.kind), ']') AS done)
                ELSE struct(greatest(acc.at, s.stop) AS at, acc.done AS done) END,
            acc -> concat(acc.done, substring({text}, acc.at + 1)))""")


def count_kind(spans: Column, kind: str) -> Column:
    """Number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
