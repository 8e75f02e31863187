"""Derived inputs that Spark makes by one join or one grouping give the rows of their SQL."""

from __future__ import annotations

from errata.operators import prompting as Q
from errata.sources import workload as W
from errata.sources.fixtures import Workload
from tests.test_written_inputs import data

from pyspark.sql import functions as F


def odd_data(spark, path):
    """Orders with repeated and null ids and null values; lines of some orders."""
    data(spark, path)
    orders = spark.read.parquet(f"{path}/orders.parquet")
    kept = spark.createDataFrame(orders.unionByName(orders.where("o_orderkey % 4 = 0")).unionByName(
        orders.where("o_orderkey = 8").withColumn("o_custkey", F.lit(3).cast("long"))).unionByName(
        orders.withColumn("o_orderkey", F.lit(None).cast("long")).limit(3)).unionByName(
        orders.where("o_orderkey = 5").selectExpr("o_orderkey", "o_custkey", *[f"CAST(NULL AS {t}) AS {c}" for c, t in orders.dtypes[2:]])).collect(), orders.schema)
    kept.write.mode("overwrite").parquet(f"{path}/orders.parquet")
    lines = [(k, n, k * n) for k in range(0, 44, 3) for n in range(1, k % 4 + 2)] + [(6, None, 7), (None, 1, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.mode("overwrite").parquet(f"{path}/lineitem.parquet")


def rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_grouped_texts(spark, tmp_path):
    data(spark, tmp_path)
    w = Workload(spark, str(tmp_path))
    for text in (W.ast_lines_sql(w.d), W.graph_text_sql(w.d)):
        made = w.derived(text)
        assert rows(made) == rows(spark.sql(text)) != []
        assert (plan(made).count("Relation ["), "Join" in plan(made)) == (1, False)


def test_predicted_rows_join_once(spark, tmp_path):
    odd_data(spark, tmp_path)
    d = W.Dialect("spark", str(tmp_path))
    made = spark.sql(W.predicted_row_sql(d))
    want = spark.sql(W.prediction_row_sql(d)).where("side = 'pred'").select("example_id", "ok", "row")
    assert rows(made) == rows(want) != []
    assert plan(made).count("Join ") == 1


def test_fill_computes_values_outside_the_pieces(spark):
    df = spark.createDataFrame([("{a}-{b}{c}{a} {", "x")], "frame string, v string")
    made = df.select(Q.fill(F.col("frame"), {"a": F.concat(F.reverse("v"), F.lit("{b}")), "b": F.lit(None)}).alias("t"))
    assert made.first().t == "x{b}-{c}x{b} {"
    # the lambda over the pieces looks names up in a variable, not in a map that is built there
    lookup = plan(made).split("try_element_at(" if "try_element_at(" in plan(made) else "element_at(")[1]
    assert "reverse" not in lookup.split(")")[0] and lookup.startswith("lambda ")
