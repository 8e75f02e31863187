"""Hand tables for cases that the derived inputs never meet."""

import json

from pyspark.sql import functions as F

from errata.operators import detect, evaluate, graph, names, prompts, synth, trees
from errata.sources import loaders


def test_deep_tree_is_whole(spark):
    tree = {"node_type": "leaf", "children": []}
    for k in range(39):
        tree = {"node_type": f"n{k}", "children": [json.dumps(tree) if False else tree]}
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, None)], "example_id long, tree_json string")
    nodes = trees.flatten_trees(df)
    assert nodes.count() == 40 and nodes.agg(F.max("depth")).first()[0] == 39


def test_flagged_samples_strip(spark):
    df = spark.createDataFrame([(1, "<no_error>"), (2, " <no_error> "), (3, "<no_error>\n"), (4, "<x>")], "k long, o string")
    assert [r.k for r in prompts.flagged_samples(df, "o", "k").collect()] == [4]


def test_exempt_reference_does_not_hide_a_later_one(spark):
    nodes = spark.createDataFrame([(1, [0], "column", "my col"), (1, [1], "column", "my_col")],
                                  "example_id long, path array<int>, node_type string, name string")
    examples = spark.createDataFrame([(1, "d")], "example_id long, db_id string")
    known = spark.createDataFrame([("d", "other")], "db_id string, column_name string")
    assert [r.target_value for r in detect.unknown_columns(nodes, examples, known).collect()] == ["my_col"]


def test_mutual_foreign_keys_last_writer(spark):
    ct = spark.createDataFrame([("d", 0), ("d", 1)], "db_id string, table_idx long")
    cc = spark.createDataFrame([("d", 1, 0), ("d", 2, 1)], "db_id string, column_idx long, table_idx long")
    pk = spark.createDataFrame([], "db_id string, column_idx long")
    fk = spark.createDataFrame([("d", 1, 2), ("d", 2, 1)], "db_id string, from_idx long, to_idx long")
    rows = {(r.src_idx, r.tgt_idx): r.rel for r in graph.schema_relations(ct, cc, pk, fk).where("src_kind = 'column' AND tgt_kind = 'column'").collect()}
    assert rows[2, 1] == "column-column-fk" and rows[1, 2] == "column-column-fkr"


def test_literals_with_type_letters_are_text(spark):
    df = spark.createDataFrame([("1d",), ("2f",), ("1e3",), ("-5",), (".5",), ("99999999999999999999",)], "t string")
    got = {r.t: r.lit_type for r in names.literal_types(df, "t").collect()}
    assert got == {"1d": "text", "2f": "text", "1e3": "float", "-5": "int", ".5": "float", "99999999999999999999": "int"}


def test_ordered_head_of_long_keys(spark):
    keys = spark.createDataFrame([("9" * 45,), ("10",), ("9",)], "k string")
    assert [r.k for r in names.ordered_head(keys, "k", -1).collect()] == ["9", "10", "9" * 45]
    mixed = spark.createDataFrame([("b",), ("10",), ("9",)], "k string")
    assert [r.k for r in names.ordered_head(mixed, "k", 2).collect()] == ["10", "9"]


def test_gold_lines_number_over_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"select {i}\tdb{i}\n" for i in range(5)))
    (tmp_path / "b.txt").write_text("".join(f"select {i}\tdb{i}\n" for i in range(5, 400)))
    rows = loaders.load_gold_lines(spark, str(tmp_path)).orderBy("example_id").collect()
    assert [(r.example_id, r.gold_sql, r.db_id) for r in rows] == [(i, f"select {i}", f"db{i}") for i in range(400)]


def test_numbers_of_all_types_and_failures_while_running(spark):
    params = spark.createDataFrame([(1,), (2,)], "example_id long")
    t = lambda i, side, sql: evaluate.Template(i, side, None, sql)
    results = evaluate.run_workload(spark, [
        t("a", "pred", "SELECT example_id, CASE example_id WHEN 1 THEN 2.0E7D ELSE 1.5D END FROM {params}"),
        t("b", "gold", "SELECT example_id, CASE example_id WHEN 1 THEN CAST(20000000 AS DECIMAL(12,2)) ELSE CAST(1.50 AS DECIMAL(12,2)) END FROM {params}")], params, {})
    assert {r.example_id: r.res for r in evaluate.execution_accuracy(results, params).collect()} == {1: 1, 2: 1}
    failing = evaluate.run_workload(spark, [
        t("a", "pred", "SELECT example_id, CAST(concat('x', example_id) AS INT) FROM {params}"),
        t("b", "gold", "SELECT example_id, 1 FROM {params}")], params, {})
    assert {r.example_id: r.res for r in evaluate.execution_accuracy(failing, params).collect()} == {1: 0, 2: 0}
    assert failing.where("side = 'gold' AND ok").count() == 2
    assert "CAST_INVALID_INPUT" in failing.where("NOT ok").first().error


def test_texts_that_look_like_numbers_are_no_numbers(spark):
    params = spark.createDataFrame([(k,) for k in range(1, 7)], "example_id long")
    t = lambda i, side, sql: evaluate.Template(i, side, None, sql)
    cells = {"pred": ["1", "1.0D", "1", "'1'", "\"'1\"", "'x'"], "gold": ["1.0D", "CAST(1 AS DECIMAL(5,2))", "'1'", "'1.0'", "'1'", "'x'"]}
    # one example's cell at a time, so that each keeps its own type
    res = None
    for side, values in cells.items():
        for k, v in enumerate(values, 1):
            r = evaluate.run_workload(spark, [t(f"{side}{k}", side, f"SELECT example_id, {v} FROM {{params}} WHERE example_id = {k}")], params, {})
            res = r if res is None else res.unionByName(r)
    assert {r.example_id: r.res for r in evaluate.execution_accuracy(res, params).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}
