"""Registered queries for execution-based evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.operators import evaluate as G
from errata.plans.registry import query
from errata.sources import workload as W
from errata.sources.fixtures import workload


def workload_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Run the derived workload's templates (G1) -> (results, spine)."""
    w = workload(spark, sf_dir)
    spine = w.eval_spine()
    templates = [G.Template(*t) for t in W.WORKLOAD_TEMPLATES]
    res = G.run_workload(spark, templates, spine, {"orders": w.table("orders")})
    return res, spine


# ---- oracle building blocks (DuckDB) ---------------------------------------

def _duck_flags(d: W.Dialect) -> str:
    """Per example: pred failed?, gold failed?, equal row sets? (DuckDB, set
    semantics by EXCEPT both ways)."""
    return f"""
rr AS ({W.result_row_sql(d)}),
sp AS ({W.eval_spine_sql(d)}),
canon AS (SELECT example_id, side,
                 list_transform(row, lambda x: regexp_replace(x, '^(-?[0-9]+)\\.0+$', '\\1')) AS row FROM rr),
diff AS (
  SELECT example_id FROM (
    (SELECT example_id, row FROM canon WHERE side = 'pred'
     EXCEPT SELECT example_id, row FROM canon WHERE side = 'gold')
    UNION ALL
    (SELECT example_id, row FROM canon WHERE side = 'gold'
     EXCEPT SELECT example_id, row FROM canon WHERE side = 'pred')) x GROUP BY example_id
),
flags AS (
  SELECT sp.example_id, sp.difficulty, sp.variant = 3 AS pred_failed, FALSE AS gold_failed,
         diff.example_id IS NULL AS same
  FROM sp LEFT JOIN diff ON diff.example_id = sp.example_id
)"""


def oracle_run_workload(d: W.Dialect) -> str:
    return f"""
WITH sp AS ({W.eval_spine_sql(d)}),
rows AS (
  SELECT s.example_id, 'gold' AS side, 'gold' AS template_id, o.o_orderkey AS k, o.o_orderpriority AS pr
  FROM sp s JOIN orders o ON o.o_custkey = s.example_id WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH')
  UNION ALL
  SELECT s.example_id, 'pred', 'pred_same', o.o_orderkey, o.o_orderpriority
  FROM sp s JOIN orders o ON o.o_custkey = s.example_id
  WHERE s.variant = 0 AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')
  UNION ALL
  SELECT s.example_id, 'pred', 'pred_urgent', o.o_orderkey, o.o_orderpriority
  FROM sp s JOIN orders o ON o.o_custkey = s.example_id
  WHERE s.variant = 1 AND o.o_orderpriority = '1-URGENT'
)
SELECT example_id, side, template_id, TRUE AS ok, CAST(NULL AS VARCHAR) AS error,
       CAST(k AS VARCHAR) || '|' || pr AS row_text FROM rows
UNION ALL
SELECT s.example_id, 'pred', 'pred_dup', TRUE, NULL, CAST(o.o_orderkey AS VARCHAR) || '|' || o.o_orderpriority
FROM sp s JOIN orders o ON o.o_custkey = s.example_id
WHERE s.variant = 2 AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION ALL
SELECT s.example_id, 'pred', 'pred_dup', TRUE, NULL, CAST(o.o_orderkey AS VARCHAR) || '|' || o.o_orderpriority
FROM sp s JOIN orders o ON o.o_custkey = s.example_id
WHERE s.variant = 2 AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION ALL
SELECT example_id, 'pred', 'pred_typo', FALSE, 'UNRESOLVED_COLUMN.WITH_SUGGESTION', NULL
FROM sp WHERE variant = 3
"""


@query("run_workload", oracle_run_workload)
def q_run_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    res, _ = workload_results(spark, sf_dir)
    return res.select("example_id", "side", "template_id", "ok", "error",
                      F.array_join("row", "|").alias("row_text"))


def oracle_execution_accuracy(d: W.Dialect) -> str:
    return f"""WITH {_duck_flags(d)}
SELECT example_id, CAST(CASE WHEN NOT pred_failed AND NOT gold_failed AND same THEN 1 ELSE 0 END AS BIGINT) AS res
FROM flags"""


@query("execution_accuracy", oracle_execution_accuracy)
def q_execution_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    res, spine = workload_results(spark, sf_dir)
    return G.execution_accuracy(res, spine)


def oracle_accuracy_by_difficulty(d: W.Dialect) -> str:
    return f"""WITH {_duck_flags(d)},
sc AS (SELECT difficulty, CASE WHEN NOT pred_failed AND NOT gold_failed AND same THEN 1 ELSE 0 END AS res
       FROM flags),
b AS (SELECT * FROM (VALUES ('simple', 0), ('moderate', 1), ('challenging', 2)) t(difficulty, ord))
SELECT b.difficulty, CAST(count(sc.res) AS BIGINT) AS n,
       CASE WHEN count(sc.res) > 0 THEN round(sum(sc.res) * 100.0 / count(sc.res), 4)
            ELSE CAST('NaN' AS DOUBLE) END AS acc
FROM b LEFT JOIN sc ON sc.difficulty = b.difficulty GROUP BY b.difficulty
UNION ALL
SELECT 'total', CAST(count(*) AS BIGINT), round(sum(res) * 100.0 / count(*), 4) FROM sc"""


@query("accuracy_by_difficulty", oracle_accuracy_by_difficulty)
def q_accuracy_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    res, spine = workload_results(spark, sf_dir)
    return G.accuracy_by_difficulty(G.execution_accuracy(res, spine), spine)


def oracle_result_set_equal(d: W.Dialect) -> str:
    return f"""
WITH rr AS ({W.result_row_sql(d)}),
sp AS ({W.eval_spine_sql(d)}),
canon AS (SELECT rr.example_id, rr.side, s.variant,
                 list_transform(row, lambda x: regexp_replace(x, '^(-?[0-9]+)\\.0+$', '\\1')) AS row
          FROM rr JOIN sp s ON s.example_id = rr.example_id),
pairs AS (SELECT * FROM (VALUES ('pred_same', 0), ('pred_urgent', 1), ('pred_dup', 2), ('pred_typo', 3)) t(pair_id, v)),
pr AS (SELECT p.pair_id, c.example_id, c.row FROM pairs p JOIN canon c ON c.side = 'pred' AND c.variant = p.v),
gd AS (SELECT p.pair_id, c.example_id, c.row FROM pairs p JOIN canon c ON c.side = 'gold' AND c.variant = p.v),
diff AS (SELECT pair_id FROM ((SELECT * FROM pr EXCEPT SELECT * FROM gd)
                              UNION ALL (SELECT * FROM gd EXCEPT SELECT * FROM pr)) x GROUP BY pair_id)
SELECT p.pair_id, (p.v <> 3 AND diff.pair_id IS NULL) AS equal
FROM pairs p LEFT JOIN diff ON diff.pair_id = p.pair_id"""


@query("result_set_equal", oracle_result_set_equal)
def q_result_set_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each predicted template's whole result set against the gold template's
    (rows carry the example id, so this compares the two complete queries)."""
    res, spine = workload_results(spark, sf_dir)
    with_key = F.concat(F.array(F.col("example_id").cast("string")), F.col("row"))
    pred = res.where(F.col("side") == "pred").select(
        F.col("template_id").alias("pair_id"), "side", "ok", with_key.alias("row"))
    # the gold query of a pair is the gold template over the same parameters
    pair_dim = spark.createDataFrame(
        [(t[0], t[2]) for t in W.WORKLOAD_TEMPLATES if t[1] == "pred"], "pair_id string, variant bigint")
    gold = (res.where(F.col("side") == "gold")
            .join(spine.select("example_id", "variant"), "example_id")
            .join(F.broadcast(pair_dim), "variant")
            .select("pair_id", "side", "ok", with_key.alias("row")))
    return G.result_set_equal(pred.unionByName(gold), pair_dim.select("pair_id"))


def oracle_validate_changes(d: W.Dialect) -> str:
    return f"""WITH {_duck_flags(d)}
SELECT example_id,
       CASE WHEN gold_failed THEN FALSE WHEN pred_failed THEN TRUE WHEN NOT same THEN TRUE ELSE FALSE END AS valid,
       CASE WHEN gold_failed THEN 'invalid' WHEN pred_failed THEN 'hard_error'
            WHEN NOT same THEN 'soft_error' ELSE 'invalid' END AS status
FROM flags"""


@query("validate_changes", oracle_validate_changes)
def q_validate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gold query plays the original, the predicted query the change."""
    res, spine = workload_results(spark, sf_dir)
    return G.validate_changes(res, spine)


def oracle_route_predictions(d: W.Dialect) -> str:
    return f"""WITH {_duck_flags(d)}
SELECT example_id, CASE WHEN NOT pred_failed AND NOT gold_failed AND same THEN 'perturb' ELSE 'annotate' END AS route
FROM flags"""


@query("route_predictions", oracle_route_predictions)
def q_route_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    res, spine = workload_results(spark, sf_dir)
    return G.route_predictions(res, spine)
