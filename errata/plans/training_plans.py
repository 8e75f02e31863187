"""Registered queries for training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.functions.rand import uniform
from errata.operators import training as J
from errata.plans.registry import query
from errata.sources import workload as W
from errata.sources.fixtures import workload


def du(key: str, salt: str) -> str:
    return f"CAST(('0x' || substr(md5('42|' || CAST({key} AS VARCHAR) || '|' || '{salt}'), 1, 8)) AS BIGINT)"


def oracle_split(d: W.Dialect) -> str:
    return f"""SELECT example_id, CASE WHEN {du('example_id', 'split')} % 10 < 1 THEN 'validation' ELSE 'train' END AS split
FROM ({W.example_sql(d)}) e"""


@query("train_val_split", oracle_split)
def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = workload(spark, sf_dir).example().select("example_id")
    return J.train_val_split(ex, "example_id")


def oracle_label_sequences(d: W.Dialect) -> str:
    return f"""WITH s AS ({W.label_sequence_sql(d)}),
t AS (SELECT seq_id, output, regexp_extract_all(output, '(<[^<>]*>)', 1) AS toks FROM s),
n AS (SELECT t.*, list_transform(toks, lambda x: CASE WHEN x = '<no_error>' THEN -1
                  ELSE TRY_CAST(regexp_extract(x, '^<error_(\\d+)>$', 1) AS INT) END) AS nums FROM t),
f AS (SELECT n.*,
        coalesce(list_bool_and(list_transform(nums, lambda x: x IS NOT NULL AND (x = -1 OR (x >= 1 AND x <= 31)))), TRUE) AS known,
        (NOT list_contains(nums, -1) OR len(nums) = 1) AS alone,
        (len(nums) <= 1 OR nums = list_sort(list_distinct(nums))) AS incr FROM n),
r AS (SELECT f.*, CASE WHEN len(toks) = 0 THEN 'empty' WHEN NOT known THEN 'unknown_token'
                       WHEN NOT alone THEN 'no_error_not_alone' WHEN NOT incr THEN 'not_increasing'
                       WHEN len(toks) > 4 THEN 'too_long' END AS reason FROM f)
SELECT seq_id, output, CAST(len(toks) AS INT) AS n_tokens, reason IS NULL AS valid, reason FROM r"""


@query("label_sequences", oracle_label_sequences)
def q_label_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.sql(W.label_sequence_sql(workload(spark, sf_dir).d))
    r = J.label_sequences(s, "seq_id", "output")
    return r.select("seq_id", "output", F.col("n_tokens").cast("int").alias("n_tokens"), "valid", "reason")


GAMMAS = [0.0, 2.0]


def oracle_focal(d: W.Dialect) -> str:
    p = f"(({du('doc_id', 'p')} + 1) / 4294967297.0)"
    parts = [f"""SELECT quality, {g} AS gamma,
  round(coalesce(sum(CASE WHEN toxic = 0 THEN pow(1 - {p}, {g}) * -ln({p}) END) / count(CASE WHEN toxic = 0 THEN 1 END), 0.0), 8) AS loss,
  count(CASE WHEN toxic = 0 THEN 1 END) AS n_masked FROM labels GROUP BY quality""" for g in GAMMAS]
    return "\nUNION ALL\n".join(parts)


@query("focal_loss", oracle_focal)
def q_focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels scored with a per-row probability; masked rows are non-toxic."""
    lab = workload(spark, sf_dir).table("labels")
    scored = lab.select("quality", uniform(F.col("doc_id"), F.lit("p")).alias("p"), (F.col("toxic") == 0).alias("m"))
    r = J.focal_loss(scored, "quality", "p", "m", GAMMAS)
    return r.select("quality", "gamma", F.round("loss", 8).alias("loss"), "n_masked")


def oracle_centroids(d: W.Dialect) -> str:
    return """SELECT label, CAST(pos AS INT) AS pos, round(avg(x), 6) AS mean FROM (
  SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS x FROM embeddings) e
GROUP BY label, pos"""


@query("group_centroids", oracle_centroids)
def q_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = workload(spark, sf_dir).table("embeddings")
    r = J.group_centroids(emb, "label", "embedding")
    return r.select("label", F.col("pos").cast("int").alias("pos"), F.round("mean", 6).alias("mean"))


# ---- J1 / J2 -------------------------------------------------------------------

DETECTOR_COLS = ["example_id", "db_id", "question", "external_knowledge", "predicted_sql", "ast", "nodes_text", "edges_text", "execution", "rule_based"]


def _detector_sql(d: W.Dialect) -> str:
    """CTEs up to ``di``, the detector's inputs; outcomes by their derivation."""
    v = d.u("e.example_id", "'predrun'") + " % 4"
    return f"""e AS ({W.detector_example_sql(d)}), a AS ({W.ast_lines_sql(d)}), g AS ({W.graph_text_sql(d)}), f0 AS ({W.finding_sql(d)}),
f AS (SELECT example_id, string_agg(error_label || ': ' || message, chr(10) ORDER BY seq) AS rb FROM f0 GROUP BY example_id),
l AS (SELECT l_orderkey AS id, count(*) AS n, count(*) FILTER (WHERE l_linenumber > 1) AS n1 FROM lineitem GROUP BY l_orderkey),
di AS (SELECT e.example_id, e.db_id, e.question, coalesce(e.evidence, '') AS external_knowledge, e.predicted_sql, coalesce(a.ast, '') AS ast,
        coalesce(g.nodes_text, '') AS nodes_text, coalesce(g.edges_text, '') AS edges_text,
        CASE {v} WHEN 3 THEN 'error: failed' WHEN 0 THEN 'rows: ' || coalesce(l.n, 0) WHEN 1 THEN 'rows: ' || coalesce(l.n1, 0) ELSE 'rows: ' || coalesce(2 * l.n, 0) END AS execution,
        coalesce(f.rb, 'none') AS rule_based
      FROM e LEFT JOIN a ON a.example_id = e.example_id LEFT JOIN g ON g.example_id = e.example_id LEFT JOIN f ON f.example_id = e.example_id LEFT JOIN l ON l.id = e.example_id)"""


def detector_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload(spark, sf_dir)
    d = w.d
    ran = spark.sql(W.predicted_row_sql(d)).selectExpr("example_id", "ok", "CAST(NULL AS string) AS error", "row")
    return J.detector_input(w.derived(W.detector_example_sql(d)), w.derived(W.ast_lines_sql(d)), w.derived(W.graph_text_sql(d)), ran, spark.sql(W.finding_sql(d)))


@query("detector_input", lambda d: f"WITH {_detector_sql(d)} SELECT {', '.join(DETECTOR_COLS)} FROM di")
def q_detector_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detector_frame(spark, sf_dir).select(*DETECTOR_COLS)


def oracle_finetune(d: W.Dialect) -> str:
    from errata.schemas import ERROR_LABELS

    no = "CASE error_label " + " ".join(f"WHEN '{n}' THEN {k}" for k, n in enumerate(ERROR_LABELS, 1)) + " END"
    body = " || chr(10) || ".join(f"'{h}'" + (f" || chr(10) || {c}" if c else "") for h, c in J.INPUT_SECTIONS)
    return f"""WITH {_detector_sql(d)}, t AS (SELECT DISTINCT example_id, {no} AS k FROM ({W.target_label_sql(d)}) x),
o AS (SELECT example_id, string_agg('<error_' || k || '>', '' ORDER BY k) AS tokens FROM t WHERE k IS NOT NULL GROUP BY example_id)
SELECT di.example_id, '{J.INSTRUCTION}' AS instruction, {body} AS input, coalesce(o.tokens, '<no_error>') AS output FROM di LEFT JOIN o ON o.example_id = di.example_id"""


@query("finetune_rows", oracle_finetune)
def q_finetune(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.sql(W.target_label_sql(workload(spark, sf_dir).d))
    return J.finetune_rows(detector_frame(spark, sf_dir), labels)
