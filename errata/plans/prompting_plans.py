"""Registered queries for prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.operators import prompting as Q
from errata.operators.render import schema_ddl
from errata.plans.context_plans import oracle_ddl
from errata.plans.registry import query
from errata.schemas import DESCRIPTIONS, DISPLAY_NAMES, PRIORITY
from errata.sources import workload as W
from errata.sources.fixtures import workload

TEXTS = {
    "annotation_system": "You compare two queries.", "annotation_user": "Schema:\n{schema}\nQuestion: {question}\n{evidence}Predicted: {predicted}\nGold: {gold}\n",
    "localization": "Question: {question}\nSQL: {sql}\nTree:\n{ast}\nErrors:\n{errors}\nFields:\n{fields}\n{unknown}",
    "repair": "Repair this query:\n{sql}\n{errors}\nGive the whole query.", "repair_block": "## {number} {error_type}\n{subtree}\n{subgraph}\n{guideline}\n{few_shot}"}


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEXTS.items()), "name string, text string")


def template_sql(d: W.Dialect) -> str:
    """(error_type, template, wrong_sql, error_description, fixed_sql) of all types but the last."""
    return f"""SELECT t AS error_type, CASE WHEN length(t) % 2 = 0 THEN 'Change ' || chr(123) || 'old_part' || chr(125) || ' to ' || chr(123) || 'new_part' || chr(125) ELSE 'Look again' END AS template,
       'SELECT ' || lower(t) AS wrong_sql, 'wrong: ' || t AS error_description, 'SELECT 1' AS fixed_sql FROM (SELECT {d.explode_values(DISPLAY_NAMES[:-1])} AS t) x"""


def context_sql(d: W.Dialect) -> str:
    """context(example_id, pos, error_type, subtree, subgraph, gkey, gvalue, few_shot)."""
    return f"""SELECT a.example_id, a.pos, a.error_type, 'tree of ' || CAST(a.pos AS STRING) AS subtree, CASE WHEN a.example_id % 3 = 0 THEN NULL ELSE 'graph' END AS subgraph,
       CASE WHEN a.example_id % 4 = 0 THEN NULL ELSE 'located_part' END AS gkey, 'part ' || CAST(a.example_id AS STRING) AS gvalue, 'shot' AS few_shot
FROM ({W.analysis_sql(d, DISPLAY_NAMES)}) a"""


def _filled(name: str, **values: str) -> str:
    text = "'" + TEXTS[name].replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for k, v in values.items():
        text = text.replace("{" + k + "}", f"' || coalesce(CAST({v} AS VARCHAR), '') || '")
    return text


def oracle_annotation(d: W.Dialect) -> str:
    user = _filled("annotation_user", schema="s.ddl", question="e.question", evidence="CASE WHEN coalesce(e.evidence, '') <> '' THEN 'Evidence: ' || e.evidence || chr(10) END",
                   predicted="e.predicted_sql", gold="e.gold_sql")
    return f"""SELECT e.example_id, {_filled('annotation_system')} AS system, md5({user}) AS user FROM ({W.annotated_example_sql(d)}) e JOIN ({oracle_ddl(d)}) s ON s.db_id = e.db_id"""


@query("annotation_prompts", oracle_annotation)
def q_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload(spark, sf_dir)
    ddl = schema_ddl(w.catalog_table(), w.catalog_column(), w.catalog_pk())
    return Q.annotation_prompts(w.derived(W.annotated_example_sql(w.d)), ddl, texts(spark)).withColumn("user", F.md5("user"))


def oracle_localization(d: W.Dialect) -> str:
    about = "CASE error_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DESCRIPTIONS.items()) + " END"
    prompt = _filled("localization", question="e.question", sql="e.predicted_sql", ast="a.ast", errors="x.errors", fields="x.fields")
    return f"""WITH t AS ({template_sql(d)}), n AS (SELECT s.*, t.template, {about.replace('error_type', 's.error_type')} AS about,
  row_number() OVER (PARTITION BY example_id ORDER BY pos) AS i FROM ({W.analysis_sql(d, DISPLAY_NAMES)}) s LEFT JOIN t ON t.error_type = s.error_type),
x AS (SELECT example_id, string_agg(i || '. ' || error_type || coalesce(': ' || about, ''), chr(10) ORDER BY i) AS errors,
  string_agg(error_type || ': old_part, new_part', chr(10) ORDER BY i) FILTER (WHERE contains(template, 'old_part')) AS fields FROM n GROUP BY example_id)
SELECT e.example_id, {prompt} AS prompt FROM ({W.detector_example_sql(d)}) e JOIN x ON x.example_id = e.example_id JOIN ({W.ast_lines_sql(d)}) a ON a.example_id = e.example_id"""


@query("localization_prompts", oracle_localization)
def q_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload(spark, sf_dir)
    d = w.d
    samples = w.derived(W.detector_example_sql(d)).withColumnRenamed("predicted_sql", "sql").join(w.derived(W.ast_lines_sql(d)), "example_id")
    errors = spark.sql(W.analysis_sql(d, DISPLAY_NAMES)).select("example_id", "pos", "error_type")
    return Q.localization_prompts(samples, errors, spark.sql(template_sql(d)).select("error_type", "template"), texts(spark))


@query("few_shot_lookup", lambda d: f"""SELECT a.example_id, a.pos, a.error_type, coalesce('- Wrong: `' || t.wrong_sql || '`' || chr(10) || '- Error: ' || t.error_description
  || chr(10) || '- Fixed: `' || t.fixed_sql || '`', '{Q.NO_EXAMPLE}') AS few_shot FROM ({W.analysis_sql(d, DISPLAY_NAMES)}) a LEFT JOIN ({template_sql(d)}) t ON t.error_type = a.error_type""")
def q_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = workload(spark, sf_dir).d
    return Q.few_shot_lookup(spark.sql(W.analysis_sql(d, DISPLAY_NAMES)).select("example_id", "pos", "error_type"), spark.sql(template_sql(d)))


def oracle_repair(d: W.Dialect) -> str:
    rank = "CASE error_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + f" ELSE {Q.LAST_PRIORITY} END"
    block = _filled("repair_block", number="i", error_type="error_type", subtree="subtree", subgraph=f"coalesce(subgraph, '{Q.NO_SUBGRAPH}')",
                    guideline=f"CASE WHEN gkey IS NULL THEN '{Q.NO_GUIDELINE}' ELSE '- **Located Part**: ' || gvalue END", few_shot="few_shot")
    return f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY {rank}, pos) AS i FROM ({context_sql(d)}) x),
b AS (SELECT example_id, string_agg({block}, chr(10) ORDER BY i) AS errors FROM c GROUP BY example_id)
SELECT e.example_id, {_filled('repair', sql='e.predicted_sql', errors='b.errors')} AS prompt FROM ({W.detector_example_sql(d)}) e JOIN b ON b.example_id = e.example_id"""


@query("repair_prompts", oracle_repair)
def q_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = workload(spark, sf_dir).d
    contexts = spark.sql(context_sql(d)).withColumn("guideline", F.when(F.col("gkey").isNotNull(), F.create_map("gkey", "gvalue")))
    samples = workload(spark, sf_dir).derived(W.detector_example_sql(d)).select("example_id", F.col("predicted_sql").alias("sql"))
    return Q.repair_prompts(samples, contexts, texts(spark))
