"""Registered queries for tree operators (C1, C3-C10).  The Spark side parses
the tree JSON; the oracle reads the node truth derived from query parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.functions.frames import path_text
from errata.operators import trees as C
from errata.plans.registry import query
from errata.sources import workload as W
from errata.sources.fixtures import workload

PATH_LIST = "(CASE WHEN path = '' THEN CAST([] AS INT[]) ELSE list_transform(string_split(path, '.'), lambda x: CAST(x AS INT)) END)"


def tn(d: W.Dialect) -> str:
    """DuckDB node truth with a sortable path list."""
    return f"(SELECT t.*, {PATH_LIST} AS pl FROM ({W.tree_node_sql(d)}) t)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload(spark, sf_dir).nodes


def oracle_flatten(d: W.Dialect) -> str:
    return f"""SELECT example_id, path, CAST(depth AS INT) AS depth,
       CAST(CASE WHEN path = '' THEN 0 ELSE CAST(string_split(path, '.')[-1] AS INT) END AS INT) AS pos,
       node_type, name, value, value_type FROM {tn(d)} n"""


@query("flatten_trees", oracle_flatten)
def q_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C.flatten_trees(workload(spark, sf_dir).tree())
    return n.select("example_id", path_text("path").alias("path"), F.col("depth").cast("int").alias("depth"),
                    F.col("pos").cast("int").alias("pos"), "node_type", "name", "value", "value_type")


def oracle_nodes_by_type(d: W.Dialect) -> str:
    return f"""SELECT example_id, path, name, row_number() OVER (PARTITION BY example_id ORDER BY pl) AS rank
FROM {tn(d)} n WHERE node_type = 'column'"""


@query("nodes_by_type", oracle_nodes_by_type)
def q_nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.nodes_by_type(nodes(spark, sf_dir), ["column"]).select(
        "example_id", path_text("path").alias("path"), "name", F.col("rank").cast("bigint").alias("rank"))


def oracle_tree_references(d: W.Dialect) -> str:
    return f"""SELECT example_id,
  coalesce(string_agg(CASE WHEN node_type = 'column' AND coalesce(name, '') <> '' THEN name END, ',' ORDER BY pl), '') AS columns,
  coalesce(string_agg(CASE WHEN node_type = 'table' AND coalesce(name, '') <> '' THEN name END, ',' ORDER BY pl), '') AS tables,
  coalesce(string_agg(CASE WHEN node_type = 'literal' THEN value || ':' || value_type END, ',' ORDER BY pl), '') AS literals
FROM {tn(d)} n GROUP BY example_id"""


@query("tree_references", oracle_tree_references)
def q_tree_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.tree_references(nodes(spark, sf_dir))
    return r.select(
        "example_id", F.array_join("columns", ",").alias("columns"), F.array_join("tables", ",").alias("tables"),
        F.array_join(F.transform("literals", lambda s: F.concat_ws(":", s["value"], s["value_type"])), ",")
        .alias("literals"))


def oracle_select_columns(d: W.Dialect) -> str:
    skip = ", ".join(f"'{x}'" for x in C.NON_SELECT_CLAUSES)
    return f"""WITH n AS {tn(d)},
top AS (SELECT example_id, path AS tp FROM n WHERE depth = 1 AND node_type NOT IN ({skip}))
SELECT n.example_id, n.path, n.name FROM n JOIN top
  ON top.example_id = n.example_id AND split_part(n.path, '.', 1) = top.tp
WHERE n.node_type = 'column' AND n.depth >= 1"""


@query("select_columns", oracle_select_columns)
def q_select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.select_columns(nodes(spark, sf_dir)).select("example_id", path_text("path").alias("path"), "name")


def oracle_clause_nodes(d: W.Dialect) -> str:
    return f"""WITH n AS {tn(d)}
SELECT example_id, clause, path FROM (
  SELECT example_id, CASE WHEN node_type = 'groupby' THEN 'group' ELSE node_type END AS clause, path,
         row_number() OVER (PARTITION BY example_id, CASE WHEN node_type = 'groupby' THEN 'group' ELSE node_type END
                            ORDER BY pl) AS rk
  FROM n WHERE node_type IN ('where', 'from', 'group', 'groupby', 'order', 'limit')) x WHERE rk = 1
UNION ALL
SELECT example_id, 'join', path FROM n WHERE node_type = 'join'"""


@query("clause_nodes", oracle_clause_nodes)
def q_clause_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clause_nodes(nodes(spark, sf_dir)).select("example_id", "clause", path_text("path").alias("path"))


def oracle_predicate_nodes(d: W.Dialect) -> str:
    cmp_ = ", ".join(f"'{x}'" for x in C.COMPARISON_TYPES)
    return f"""SELECT example_id, path, node_type,
  CASE WHEN node_type IN ({cmp_}) THEN 'comparison' ELSE 'logical' END AS kind
FROM {tn(d)} n WHERE node_type IN ({cmp_}, 'and', 'or')"""


@query("predicate_nodes", oracle_predicate_nodes)
def q_predicate_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.predicate_nodes(nodes(spark, sf_dir)).select(
        "example_id", path_text("path").alias("path"), "node_type", "kind")


def oracle_tree_flags(d: W.Dialect) -> str:
    return f"""SELECT example_id, bool_or(node_type IN ('count', 'sum', 'avg', 'max', 'min')) AS has_aggregation,
  bool_or(node_type = 'distinct') AS has_distinct FROM {tn(d)} n GROUP BY example_id"""


@query("tree_flags", oracle_tree_flags)
def q_tree_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tree_flags(nodes(spark, sf_dir))


REQUEST_PATHS = ["0", "1.0", "3", "12.0"]


def oracle_node_by_path(d: W.Dialect) -> str:
    reqs = " UNION ALL ".join(f"SELECT '{p}' AS req" for p in REQUEST_PATHS)
    return f"""WITH n AS {tn(d)}, r AS ({reqs}),
ex AS (SELECT DISTINCT example_id FROM n)
SELECT ex.example_id, r.req, n.node_type, n.name
FROM ex JOIN r ON TRUE LEFT JOIN n ON n.example_id = ex.example_id AND n.path = r.req"""


@query("node_by_path", oracle_node_by_path)
def q_node_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four path requests per tree (one is out of range for every tree)."""
    w = workload(spark, sf_dir)
    req = w.tree().select("example_id", F.explode(F.array(*[F.lit(p) for p in REQUEST_PATHS])).alias("req"))
    req = req.withColumn("path", F.transform(F.split("req", r"\."), lambda x: x.cast("int")))
    return C.node_by_path(w.nodes, req).select("example_id", "req", "node_type", "name")


def oracle_where_literals(d: W.Dialect) -> str:
    return f"""WITH n AS {tn(d)},
a AS (SELECT example_id, arg_min(path, pl) AS ap, arg_min(pl, pl) AS apl FROM n WHERE node_type = 'where' GROUP BY example_id)
SELECT n.example_id, n.path, n.value, n.value_type FROM n JOIN a ON a.example_id = n.example_id
WHERE n.node_type = 'literal' AND n.pl[1:len(a.apl)] = a.apl"""


@query("where_literals", oracle_where_literals)
def q_where_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.where_literals(nodes(spark, sf_dir)).select(
        "example_id", path_text("path").alias("path"), "value", "value_type")


# ---- C2 ------------------------------------------------------------------------

def oracle_compact(d: W.Dialect) -> str:
    """The trees that the complete ones were made from, by another route than
    contraction: their node truth."""
    return f"SELECT example_id, path, node_type, name, value, value_type FROM ({W.tree_node_sql(d)}) t"


@query("compact_trees", oracle_compact)
def q_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload(spark, sf_dir)
    complete = spark.sql(W.complete_node_sql(w.d, "{nodes}"), nodes=w.tree_node())
    return C.compact_trees(complete).select("example_id", path_text("path").alias("path"), "node_type", "name", "value", "value_type")
