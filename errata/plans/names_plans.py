"""Registered queries for name/text projections (B1-B8) and error
classification (F6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.functions.frames import ordered_join
from errata.functions.rules import EXEC_RULES, FAMILIES
from errata.operators import detect as D
from errata.operators import names as B
from errata.plans.registry import query
from errata.sources import workload as W
from errata.sources.fixtures import workload


def _df(spark: SparkSession, sf_dir: str, builder) -> DataFrame:
    w = workload(spark, sf_dir)
    return w.derived(builder(w.d))


def _catalog_df(spark: SparkSession, sf_dir: str, builder) -> DataFrame:
    w = workload(spark, sf_dir)
    return w._catalog(builder(w.d))


DUCK_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def duck_norm(x: str) -> str:
    inner = f"translate(lower(coalesce(CAST({x} AS VARCHAR), '')), ' -`\"', '__')"
    return DUCK_TRIM.format(x=inner)


# B1 --------------------------------------------------------------------------

def oracle_unpack(d: W.Dialect) -> str:
    delim = "chr(9) || '----- bird -----' || chr(9)"
    return f"""
WITH p AS ({W.packed_prediction_sql(d)})
SELECT example_id,
       {DUCK_TRIM.format(x=f"CASE WHEN strpos(packed, {delim}) > 0 THEN substr(packed, 1, strpos(packed, {delim}) - 1) ELSE packed END")} AS predicted_sql,
       CASE WHEN strpos(packed, {delim}) > 0 THEN {DUCK_TRIM.format(x=f"substr(packed, strpos(packed, {delim}) + 18)")} ELSE '' END AS db_id,
       strpos(packed, {delim}) > 0 AS parse_ok
FROM p"""


@query("unpack_sql", oracle_unpack)
def q_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _df(spark, sf_dir, W.packed_prediction_sql)
    return B.unpack_sql(df, "packed", W.PACKAGE_DELIM).select("example_id", "predicted_sql", "db_id", "parse_ok")


# B2 --------------------------------------------------------------------------

def oracle_normalize_names(d: W.Dialect) -> str:
    return f"SELECT ident_id, raw, {duck_norm('raw')} AS normed FROM ({W.identifier_sql(d)}) i"


@query("normalize_names", oracle_normalize_names)
def q_normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.normalize_names(_df(spark, sf_dir, W.identifier_sql), "raw")


# B3 / B4 ------------------------------------------------------------------------

def duck_column_id(t: str, col: str) -> str:
    c = f"translate(lower({col}), ' /', '__')"
    c = f"regexp_replace({c}, '(\\d)-(\\d)', '\\1_\\2', 'g')"
    c = f"regexp_replace({c}, '([a-z])-([a-z])', '\\1_\\2', 'g')"
    c = f"regexp_replace({c}, '[-()#%]', '', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '_+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"(replace(lower({t}), ' ', '_') || '.' || {c})"


def oracle_column_ids(d: W.Dialect) -> str:
    return f"""SELECT db_id, column_idx, {duck_column_id('table_name', 'column_name')} AS column_id
FROM ({W.decorated_column_sql(d)}) x"""


@query("column_ids", oracle_column_ids)
def q_column_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _catalog_df(spark, sf_dir, W.decorated_column_sql)
    return B.column_ids(df, "table_name", "column_name").select("db_id", "column_idx", "column_id")


def oracle_base_types(d: W.Dialect) -> str:
    return f"""SELECT db_id, column_idx, type, split_part(type, '(', 1) AS base_type
FROM ({W.decorated_column_sql(d)}) x"""


@query("base_types", oracle_base_types)
def q_base_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _catalog_df(spark, sf_dir, W.decorated_column_sql)
    return B.base_types(df, "type").select("db_id", "column_idx", "type", "base_type")


# B5 --------------------------------------------------------------------------

def oracle_normalize_labels(d: W.Dialect) -> str:
    known = ", ".join(f"'{x}'" for x in W.ERROR_LABELS)
    n = f"translate(lower({DUCK_TRIM.format(x='label')}), ' -', '__')"
    return f"""
WITH r AS ({W.raw_labels_sql(d)}),
k AS (SELECT example_id, pos, {n} AS lab FROM r)
SELECT example_id,
       coalesce(string_agg(CASE WHEN lab IN ({known}) THEN lab END, ',' ORDER BY pos), '') AS labels_text,
       count(CASE WHEN lab IN ({known}) THEN 1 END) = 0 AS rejected
FROM k GROUP BY example_id"""


@query("normalize_labels", oracle_normalize_labels)
def q_normalize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _df(spark, sf_dir, W.raw_labels_sql)
    arr = raw.groupBy("example_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"]).alias("raw"))
    out = B.normalize_labels(arr, "raw")
    return out.select("example_id", F.array_join("labels", ",").alias("labels_text"), "rejected")


# B6 --------------------------------------------------------------------------

def oracle_infer_split(d: W.Dialect) -> str:
    m = "lower(regexp_extract(name, '(?i)(dev|train)', 1))"
    return f"SELECT file_id, name, CASE WHEN {m} <> '' THEN {m} END AS split FROM ({W.file_name_sql(d)}) f"


@query("infer_split", oracle_infer_split)
def q_infer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.infer_split(_df(spark, sf_dir, W.file_name_sql), "name")


# B7 --------------------------------------------------------------------------

def oracle_literal_types(d: W.Dialect) -> str:
    return f"""
SELECT lit_id, text,
       CASE WHEN regexp_full_match(text, '-?[0-9]+') THEN 'int'
            WHEN try_cast(text AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'text' END AS lit_type,
       CASE WHEN regexp_full_match(text, '-?[0-9]+') THEN try_cast(text AS BIGINT) END AS int_value,
       CASE WHEN NOT regexp_full_match(text, '-?[0-9]+') THEN try_cast(text AS DOUBLE) END AS float_value
FROM ({W.literal_value_sql(d)}) l"""


@query("literal_types", oracle_literal_types)
def q_literal_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.literal_types(_df(spark, sf_dir, W.literal_value_sql), "text")


# B8 --------------------------------------------------------------------------

HEAD_N = 100


def oracle_ordered_head(d: W.Dialect) -> str:
    return f"""SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders
ORDER BY CASE WHEN (SELECT bool_and(regexp_full_match(CAST(o_orderkey AS VARCHAR), '[0-9]+')) FROM orders)
              THEN o_orderkey END, CAST(o_orderkey AS VARCHAR) LIMIT {HEAD_N}"""


@query("ordered_head", oracle_ordered_head)
def q_ordered_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First n prediction keys in numeric-aware order (the head is the feature)."""
    keys = workload(spark, sf_dir).table("orders").select(F.col("o_orderkey").cast("string").alias("k"))
    return B.ordered_head(keys, "k", HEAD_N)


# F6 --------------------------------------------------------------------------

def oracle_classify_errors(d: W.Dialect) -> str:
    parts = []
    for rank, fam in enumerate(FAMILIES):
        rules = [(p, l, t, c) for f, p, l, t, c in EXEC_RULES if f == fam]
        lab = " ".join(f"WHEN regexp_matches(message, '(?i){p}') THEN '{l}'" for p, l, t, c in rules)
        val_cases = []
        typ_cases = []
        for p, l, t, c in rules:
            if c:
                cap = f"nullif(regexp_replace(regexp_extract(message, '(?i){p}', 1), '^[\"`'']+|[\"`'']+$', '', 'g'), '')"
                val_cases.append(f"WHEN regexp_matches(message, '(?i){p}') THEN {cap}")
                typ_cases.append(f"WHEN regexp_matches(message, '(?i){p}') THEN CASE WHEN {cap} IS NOT NULL THEN '{t}' END")
            else:
                val_cases.append(f"WHEN regexp_matches(message, '(?i){p}') THEN NULL")
                tv = f"'{t}'" if t else "NULL"
                typ_cases.append(f"WHEN regexp_matches(message, '(?i){p}') THEN {tv}")
        parts.append(f"""SELECT log_id, example_id, message, {rank} AS family_rank, '{fam}' AS family,
       CASE {lab} END AS error_label,
       CAST(CASE {' '.join(typ_cases)} END AS VARCHAR) AS target_type,
       CAST(CASE {' '.join(val_cases)} END AS VARCHAR) AS target_value
FROM e""")
    body = "\nUNION ALL\n".join(parts)
    return f"WITH e AS ({W.error_log_sql(d)}) SELECT * FROM ({body}) x WHERE error_label IS NOT NULL"


@query("classify_errors", oracle_classify_errors)
def q_classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = workload(spark, sf_dir).error_log()
    return D.classify_errors(log).select(
        "log_id", "example_id", "message", F.col("family_rank").cast("int").alias("family_rank"),
        "family", "error_label", "target_type", "target_value")


def oracle_classify_spark_errors(d: W.Dialect) -> str:
    return f"""SELECT example_id, 'pred_typo' AS template_id, 'UNRESOLVED_COLUMN.WITH_SUGGESTION' AS error,
       'attribute_redundancy' AS error_label FROM ({W.eval_spine_sql(d)}) s WHERE variant = 3"""


@query("classify_spark_errors", oracle_classify_spark_errors)
def q_classify_spark_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the Spark error conditions raised by the derived workload."""
    from errata.plans.evaluation_plans import workload_results

    res, _ = workload_results(spark, sf_dir)
    return D.classify_spark_errors(res.where(~F.col("ok"))).select("example_id", "template_id", "error", "error_label")
