"""Trees are folded and parsed within their rows; only what lies deeper than a round is written as text."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from errata.operators import trees
from errata.sources.fixtures import Workload


def chain(depth):
    node = {"node_type": "literal", "value": depth}
    for k in range(depth - 1, -1, -1):
        node = {"node_type": f"t{k}", "children": [{"node_type": "leaf", "name": f"n{k}"}, node]}
    return json.dumps(node)


def test_texts_are_written_once_a_round(spark, monkeypatch):
    made = []
    monkeypatch.setattr(trees, "materialize", lambda df, name, write=trees.materialize: made.append(write(df, name)) or made[-1])
    deep = trees.ROUND_LEVELS + 3
    df = spark.createDataFrame([(1, chain(3)), (1, chain(3)), (2, None), (None, chain(2)), (3, "no json"), (4, chain(deep))], "example_id long, tree_json string")
    shallow = trees.flatten_trees(df.where("example_id IS NULL OR example_id < 4"))
    assert len(made) == 1 and made[0].where(F.size("front") > 0).isEmpty()  # before: a table per level, with all text below it
    got = sorted((r.example_id or 0, list(r.path), r.depth, r.pos, r.node_type, r.name, r.value, r.n_children) for r in shallow.collect())
    one = [(1, [1] * k, k, min(k, 1), f"t{k}", None, None, 2) for k in range(3)] + [(1, [1] * k + [0], k + 1, 0, "leaf", f"n{k}", None, 0) for k in range(3)]
    one.append((1, [1, 1, 1], 3, 1, "literal", None, "3", 0))
    assert [r for r in got if r[0] == 1] == sorted(one * 2)
    assert len([r for r in got if r[0] == 0]) == 5
    assert [r for r in got if r[0] == 3] == [(3, [], 0, 0, None, None, None, 0)]
    made.clear()
    rows = trees.flatten_trees(df.where("example_id = 4")).collect()
    assert len(made) == 2 and len(rows) == 2 * deep + 1
    assert max(r.depth for r in rows) == deep and {len(r.path) - r.depth for r in rows} == {0}


class Nodes(Workload):
    """A workload whose node table is given."""

    def __init__(self, spark, nodes):
        super().__init__(spark, "/nowhere")
        self.given = nodes

    def tree_node(self):
        return self.given


def test_trees_are_folded_in_their_rows(spark, monkeypatch):
    made = []
    from errata.sources import fixtures
    monkeypatch.setattr(fixtures, "materialize", lambda df, name, write=fixtures.materialize: made.append(name) or write(df, name))
    n = [("", 0, "select", None, None, None), ("10", 1, "column", "c", None, None), ("2", 1, "eq", None, None, None), ("2.0", 2, "column", "a", None, None),
         ("2.1", 2, "literal", None, "7", "number"), ("9.0", 2, "column", "lost", None, None), ("3", 1, "literal", None, None, "string")]
    rows = [(1, *x) for x in n] + [(2, *x) for x in n + n[3:4]] + [(None, *x) for x in n] + [(None, *n[0])]
    given = spark.createDataFrame(rows, "example_id long, path string, depth int, node_type string, name string, value string, value_type string")
    got = Nodes(spark, given).tree().collect()
    assert made == ["tree"]  # before: the heads and every third level
    a = {"node_type": "column", "name": "a", "children": []}
    tree = lambda *kids: {"node_type": "select", "children": [
        {"node_type": "eq", "children": [*kids, {"node_type": "literal", "value": 7, "value_type": "number", "children": []}]},
        {"node_type": "column", "name": "c", "children": []}]}
    bare = {"node_type": "select", "children": []}
    want = [(1, tree(a)), (2, tree(a, a)), (None, bare), (None, bare)]
    assert sorted((r.example_id or 9, r.tree_json) for r in got) == sorted((k or 9, json.dumps(t, separators=(",", ":"))) for k, t in want)
