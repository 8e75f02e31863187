"""Hand tables for name/text projections and error classification."""

from pyspark.sql import functions as F

from errata.functions.text import norm, stable_column_id
from errata.operators import detect as D
from errata.operators import names as B


def test_norm_edges(spark):
    df = spark.createDataFrame([("\t`My Col`\n",), ('"a-b"',), (None,), (" x ",)], "v string")
    got = [r[0] for r in df.select(norm(F.col("v"))).collect()]
    # spaces become '_' before the strip, so only tabs/newlines are stripped
    assert got == ["my_col", "a_b", "", "_x_"]


def test_norm_idempotent(spark):
    df = spark.createDataFrame([("A b-C",), ("`q`",)], "v string")
    once = df.select(norm(F.col("v")).alias("v"))
    twice = once.select(norm(F.col("v")).alias("v"))
    assert once.collect() == twice.collect()


def test_column_id_hyphen_rules(spark):
    df = spark.createDataFrame([("T x", "a-b-c"), ("t", "1-2"), ("t", "rate (%)"), ("t", "__a__b__")], "t string, c string")
    got = [r[0] for r in df.select(stable_column_id(F.col("t"), F.col("c"))).collect()]
    assert got == ["t_x.a_bc", "t.1_2", "t.rate", "t.a_b"]


def test_unpack_zero_and_two_delimiters(spark):
    sep = "\t----- bird -----\t"
    df = spark.createDataFrame([(f" q1 {sep}db1",), ("q2",), (f"q3{sep}db{sep}x",)], "p string")
    got = B.unpack_sql(df, "p", sep).select("predicted_sql", "db_id", "parse_ok").collect()
    assert [tuple(r) for r in got] == [("q1", "db1", True), ("q2", "", False), ("q3", f"db{sep}x".strip(), True)]


def test_literal_types(spark):
    df = spark.createDataFrame([("12",), ("-3",), ("1.5",), ("1e3",), ("abc",), ("-",)], "v string")
    got = [r.lit_type for r in B.literal_types(df, "v").collect()]
    assert got == ["int", "int", "float", "float", "text", "text"]


def test_normalize_labels_rejects_empty(spark):
    df = spark.createDataFrame([(["Value Error", "bogus"],), (["nope"],)], "l array<string>")
    got = B.normalize_labels(df, "l").select("labels", "rejected").collect()
    assert got[0].labels == ["value_error"] and not got[0].rejected
    assert got[1].labels == [] and got[1].rejected


def test_ordered_head_numeric(spark):
    df = spark.createDataFrame([(str(i),) for i in range(25)], "k string")
    assert [r.k for r in B.ordered_head(df, "k", 3).collect()] == ["0", "1", "2"]
    df2 = df.union(spark.createDataFrame([("x",)], "k string"))
    assert [r.k for r in B.ordered_head(df2, "k", 3).collect()] == ["0", "1", "10"]


def test_classify_first_match_per_family(spark):
    log = spark.createDataFrame([
        (1, 'no such column: "T1.name"'),
        (2, "misuse of aggregate function COUNT() and datatype mismatch"),
        (3, "everything fine"),
    ], "log_id int, message string")
    got = D.classify_errors(log).select("log_id", "family", "error_label", "target_type", "target_value").collect()
    rows = {(r.log_id, r.family): r for r in got}
    assert rows[(1, "attribute")].target_value == "T1.name"
    assert rows[(2, "function")].target_value == "COUNT"
    assert rows[(2, "value")].error_label == "value_error"
    assert not any(r.log_id == 3 for r in got)
