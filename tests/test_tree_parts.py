"""Trees come out of an example's parts in one row and are parsed once; names are normalised once."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from errata.operators import detect, trees
from errata.sources import fixtures
from errata.sources import workload as W

PARTS = "example_id long, db_id string, depth int, clause string, pos long, func string, tbl string, col string, op string, val string, val_type string, is_desc boolean"


def parts(k, *rows):
    return [(k, "db", depth, clause, pos, func, tbl, col, op, val, kind, None) for depth, clause, pos, func, tbl, col, op, val, kind in rows]


SELECTS = [(0, "select", 1, "lower", "t", "a", None, None, None), (0, "select", 0, "max", "t", None, None, None, None), (0, "select", 2, None, "t", "b", None, None, None)]
FROM = (0, "from", 0, None, "t", None, None, None, None)
JOIN = (0, "join", 0, None, "u", "x", "=", "y", "column")
WHERES = [(0, "where", 0, None, "t", "a", "=", "1", "number"), (0, "where", 1, None, "t", "b", "!=", "v", "string"), (0, "where", 2, None, "t", "c", "in", None, "subquery")]
INNER = (1, "where", 0, None, "u", "d", ">", "0", "number")
REST = [(0, "group", 0, None, "t", "a", None, None, None), (0, "order", 0, None, "t", "b", None, None, None), (0, "limit", 0, None, None, None, None, "3", "number"),
        (0, "distinct", 0, None, None, None, None, None, None)]


class Given(fixtures.Workload):
    def __init__(self, spark, rows):
        super().__init__(spark, "/nowhere")
        self.__dict__["_query_part"] = spark.createDataFrame(rows, PARTS).repartition(3)


def folded(w):
    return sorted((r.example_id or -1, r.tree_json) for r in w._folded(w.tree_node()).collect())


def test_trees_come_from_parts_without_a_table_a_stage(spark, monkeypatch):
    made = []
    monkeypatch.setattr(fixtures, "materialize", lambda df, name, write=fixtures.materialize: made.append(name) or write(df, name))
    nothing = [(0, "where", 0, None, "t", "a", "=", None, "number"), (0, "where", 1, None, "t", None, "<", "7", None)]
    rows = (parts(1, *SELECTS, FROM, JOIN, WHERES[0], *REST) + parts(2, FROM, WHERES[0], WHERES[2], INNER) + parts(3, FROM, *WHERES, INNER)
            + parts(4, FROM, *nothing, *REST[2:]) + parts(5, FROM, *WHERES[:2]) + parts(None, FROM, *WHERES) + parts(6, FROM, *WHERES))
    w = Given(spark, rows)
    got = sorted((r.example_id or -1, r.tree_json) for r in w.tree().collect())
    assert made == ["tree"]  # before: the slots, conditions, nested parts and nodes as well
    assert got == folded(w)
    assert json.loads(dict(got)[2])["children"][1]["children"][0]["children"][1]["children"][1]["node_type"] == "subquery"


def test_repeated_parts_go_through_the_nodes(spark):
    twice = parts(7, *SELECTS, FROM, JOIN, WHERES[0])
    w = Given(spark, twice + twice + parts(8, *SELECTS[:2], FROM) + parts(8, *SELECTS[:2]) + parts(9, SELECTS[0]) + parts(10, FROM))
    assert sorted((r.example_id or -1, r.tree_json) for r in w.tree().collect()) == folded(w)


def test_odd_texts_are_parsed_level_by_level(spark, monkeypatch):
    made = []
    monkeypatch.setattr(trees, "materialize", lambda df, name, write=trees.materialize: made.append(write(df, name)) or made[-1])
    texts = ['{"node_type":"a","children":[{"node_type":"b"},5,{"node_type":"c","children":["x",{"node_type":"d","name":1.50}]}]}',
             '{"node_type":"a","children":[{"node_type":"q","children":5,"name":"k"},null,"{\\"node_type\\":\\"s\\"}",{"value":1e400}]}', "null", ""]
    got = trees.flatten_trees(spark.createDataFrame(list(enumerate(texts)), "example_id long, tree_json string")).collect()
    assert len(made) == 1
    rows = {(r.example_id, tuple(r.path)): (r.node_type, r.name, r.value, r.n_children) for r in got}
    assert rows[0, ()] == ("a", None, None, 3) and rows[0, (0,)] == ("b", None, None, 0) and rows[0, (1,)] == (None, None, None, 0)
    assert rows[0, (2, 1)][0] == "d" and rows[1, (0,)] == ("q", "k", None, 0) and rows[1, (2,)][0] == "s" and rows[1, (3,)][2] == "Infinity"
    assert len(got) == len(rows) == 13
    one = trees._parsed(spark.createDataFrame([(1, texts[0])], "example_id long, js string").select(
        "example_id", F.array(F.struct(F.array().cast("array<int>").alias("path"), "js")).alias("front")), "example_id")
    assert one.select(F.size("nodes")).first()[0] == 6


def test_names_are_normalised_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(detect, "materialize", lambda df, name: seen.append(df) or df, raising=False)
    nodes = spark.createDataFrame([(1, [0], "table", " some-thing "), (1, [1], "table", "orders")], "example_id long, path array<int>, node_type string, name string")
    out = detect.unknown_tables(nodes, spark.createDataFrame([(1, "d")], "example_id long, db_id string"), spark.createDataFrame([("d", "Orders")], "db_id string, table_name string"))
    assert [r.target_value for r in out.collect()] == [" some-thing "]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in text.split("\n") if "Filter" in x]
    assert filters and not any("translate" in x for x in filters)  # before: some eighty times a row
    assert len(seen) == 1
