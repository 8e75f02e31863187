"""Registered queries for prompt/completion tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.operators import prompts as I
from errata.plans.registry import query
from errata.schemas import DESCRIPTIONS, DISPLAY_NAMES, ERROR_LABELS, PRIORITY
from errata.sources import workload as W
from errata.sources.fixtures import workload

TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _df(spark, sf_dir, builder):
    w = workload(spark, sf_dir)
    return w.derived(builder(w.d))


def oracle_split_sections(d: W.Dialect) -> str:
    hdr = " ".join(f"WHEN starts_with(line, '{h}') THEN '{n}'" for h, n in I.SECTION_HEADERS)
    return f"""WITH s AS ({W.section_input_sql(d)}),
l AS (SELECT example_id, generate_subscripts(arr, 1) AS ln, unnest(arr) AS line
      FROM (SELECT example_id, string_split(input, chr(10)) AS arr FROM s) x),
h AS (SELECT l.*, CASE {hdr} END AS hdr FROM l),
r AS (SELECT h.*, max(CASE WHEN hdr IS NOT NULL THEN ln END) OVER (PARTITION BY example_id ORDER BY ln
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS start FROM h),
heads AS (SELECT example_id, ln AS start, hdr AS section FROM r WHERE hdr IS NOT NULL),
body AS (SELECT example_id, start, string_agg(line, chr(10) ORDER BY ln) AS content FROM r
         WHERE hdr IS NULL AND start IS NOT NULL GROUP BY example_id, start),
secs AS (SELECT heads.example_id, heads.section, heads.start, {TRIM.format(x="coalesce(body.content, '')")} AS content
         FROM heads LEFT JOIN body ON body.example_id = heads.example_id AND body.start = heads.start)
SELECT example_id, section, arg_max(content, start) AS content FROM secs GROUP BY example_id, section"""


@query("split_sections", oracle_split_sections)
def q_split_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.split_sections(_df(spark, sf_dir, W.section_input_sql), "example_id", "input")


def oracle_parse_tokens(d: W.Dialect) -> str:
    return f"""SELECT seq_id, output, CASE WHEN {TRIM.format(x='output')} = '<no_error>' THEN ''
       ELSE array_to_string(regexp_extract_all(output, '(<error_\\d+>)', 1), ',') END AS tokens
FROM ({W.label_sequence_sql(d)}) s"""


@query("parse_error_tokens", oracle_parse_tokens)
def q_parse_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = I.parse_error_tokens(_df(spark, sf_dir, W.label_sequence_sql), "output")
    return t.select("seq_id", "output", F.array_join("tokens", ",").alias("tokens"))


def oracle_ordered_errors(d: W.Dialect) -> str:
    dims = " UNION ALL ".join(
        f"SELECT '<error_{k}>' AS tok, '{n}' AS name, {PRIORITY.get(n, 99)} AS prio, '{DESCRIPTIONS[n]}' AS descr"
        for k, n in enumerate(DISPLAY_NAMES, 1))
    return f"""WITH s AS ({W.label_sequence_sql(d)}),
t AS (SELECT seq_id, CASE WHEN {TRIM.format(x='output')} = '<no_error>' THEN CAST([] AS VARCHAR[])
             ELSE regexp_extract_all(output, '(<error_\\d+>)', 1) END AS toks FROM s),
e AS (SELECT seq_id, generate_subscripts(toks, 1) AS pos, unnest(toks) AS tok FROM t),
dim AS ({dims}),
n AS (SELECT e.seq_id, e.pos, dim.name, dim.descr, row_number() OVER (PARTITION BY e.seq_id ORDER BY dim.prio, e.pos) AS i
      FROM e JOIN dim ON dim.tok = e.tok),
lines AS (SELECT seq_id, string_agg(CAST(i AS VARCHAR) || '. ' || name || ': ' || descr, chr(10) ORDER BY i) AS display
          FROM n GROUP BY seq_id)
SELECT t.seq_id, coalesce(lines.display, 'No errors detected.') AS display FROM t LEFT JOIN lines ON lines.seq_id = t.seq_id"""


@query("ordered_errors", oracle_ordered_errors)
def q_ordered_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = I.parse_error_tokens(_df(spark, sf_dir, W.label_sequence_sql), "output")
    return I.ordered_errors(t.select("seq_id", "tokens"), "seq_id")


def oracle_extract_sql(d: W.Dialect) -> str:
    sel = TRIM.format(x="regexp_extract(text, '(?is)(SELECT\\s+.*)', 1)")
    return f"""SELECT request_id, kind,
  CASE WHEN regexp_matches(text, '(?is)```sql\\s*(.*?)\\s*```') THEN {TRIM.format(x="regexp_extract(text, '(?is)```sql\\s*(.*?)\\s*```', 1)")}
       WHEN regexp_matches(text, '(?s)```\\s*(.*?)\\s*```') THEN {TRIM.format(x="regexp_extract(text, '(?s)```\\s*(.*?)\\s*```', 1)")}
       WHEN regexp_matches(text, '(?is)(SELECT\\s+.*)') THEN split_part({sel}, chr(10) || chr(10), 1)
       ELSE {TRIM.format(x='text')} END AS sql
FROM ({W.completion_sql(d)}) c"""


@query("extract_sql", oracle_extract_sql)
def q_extract_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.extract_sql(_df(spark, sf_dir, W.completion_sql), "text").select("request_id", "kind", "sql")


def oracle_parse_annotations(d: W.Dialect) -> str:
    known = ", ".join(f"'{x}'" for x in ERROR_LABELS)
    norm = "translate(lower(" + TRIM.format(x="x") + "), ' -', '__')"
    return f"""WITH c AS ({W.completion_sql(d)}),
j AS (SELECT request_id, json_valid(text) AS valid,
             CASE WHEN json_valid(text) THEN json_extract_string(text, '$.refined_sql') END AS refined_sql,
             CASE WHEN json_valid(text) THEN CAST(json_extract(text, '$.error_types') AS VARCHAR[]) END AS raw
      FROM c),
n AS (SELECT j.*, list_filter(list_transform(coalesce(raw, []), lambda x: {norm}), lambda x: x IN ({known})) AS labs FROM j),
r AS (SELECT n.*, CASE WHEN NOT valid THEN 'invalid_json'
                       WHEN coalesce(refined_sql, '') = '' THEN 'empty_refined_sql'
                       WHEN raw IS NULL OR len(raw) = 0 THEN 'no_error_types'
                       WHEN len(labs) = 0 THEN 'no_valid_error_types' END AS reason FROM n)
SELECT request_id, reason IS NULL AS ok, reason, CASE WHEN reason IS NULL THEN array_to_string(labs, ',') END AS error_types,
       refined_sql FROM r"""


@query("parse_annotations", oracle_parse_annotations)
def q_parse_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.parse_annotations(_df(spark, sf_dir, W.completion_sql), "text")
    return p.select("request_id", "ok", "reason", F.array_join("error_types", ",").alias("error_types"), "refined_sql")


def oracle_flagged(d: W.Dialect) -> str:
    return f"SELECT seq_id, output FROM ({W.label_sequence_sql(d)}) s WHERE trim(output, ' ' || chr(9) || chr(10) || chr(13)) <> '<no_error>'"


@query("flagged_samples", oracle_flagged)
def q_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.flagged_samples(_df(spark, sf_dir, W.label_sequence_sql), "output", "seq_id").select("seq_id", "output")
