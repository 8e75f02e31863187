"""Query-tree operators.

Trees arrive as JSON text (one per example).  ``flatten_trees`` turns them
into a node table keyed by (example_id, path ARRAY<INT>); every other tree
operator is a filter, join or grouped aggregate over that table.  Preorder is
the lexicographic order of paths, so "first in preorder" is ``min(path)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from errata.functions.text import norm
from errata.session import materialize

NODE_SCHEMA = ("struct<node_type:string,name:string,value:string,value_type:string,"
               "cast_to:string,children:array<string>>")

NODE_FIELDS = ["node_type", "name", "value", "value_type", "cast_to"]

# Fixed value: the field that marks a text of which a part did not parse.
ODD_TEXT = "_odd_text"

# Numbers beyond a double change their text when they are parsed within a child.
ODD_NUMBERS = r"\d[eE]\+?\d{3}|\d{300}|NaN|Infinity|INF"

# Node-type sets of the tree format.
AGG_TYPES = ["count", "sum", "avg", "max", "min"]
COMPARISON_TYPES = ["eq", "neq", "gt", "lt", "gte", "lte", "like", "in", "between", "is", "is_not"]
LOGICAL_TYPES = ["and", "or"]
NON_SELECT_CLAUSES = ["from", "where", "join", "group", "groupby", "order", "limit", "having"]
FUNCTION_NODE_TYPES = ["func", "function", "call"]


#: Levels that are parsed within a row before what lies below them is written.
ROUND_LEVELS = 12


def flatten_trees(trees: DataFrame, json_col: str = "tree_json", key: str = "example_id") -> DataFrame:
    """Preorder node table of JSON trees of any depth.

    A text is parsed once for ``ROUND_LEVELS`` levels, whose nodes are then
    listed level by level within its row; what lies below them comes as JSON
    texts.  The nodes are written, without any text but those, and the rows that
    have one go on in another round; so the texts of trees up to that depth are
    never written.  A text of which a part is not a node as the schema has it is
    parsed level by level instead: each node's children come as JSON texts, the
    next level's frontier.  A NULL tree gives no rows.

    Returns (key, path ARRAY<INT>, depth, pos, node_type, name, value,
    value_type, cast_to, n_children)."""
    none = F.array().cast("array<int>")
    left = trees.where(F.col(json_col).isNotNull()).select(F.col(key), F.array(F.struct(none.alias("path"), F.col(json_col).alias("js"))).alias("front"))
    out, rounds = None, 0
    while True:
        row = materialize(_parsed(left, key), f"tree-nodes-{rounds}")
        nodes = row.select(key, F.explode("nodes").alias("n")).select(
            key, "n.path", F.size("n.path").alias("depth"),
            F.when(F.size("n.path") > 0, F.element_at("n.path", -1)).otherwise(0).alias("pos"), *[f"n.{c}" for c in NODE_FIELDS], "n.n_children")
        out = nodes if out is None else out.unionByName(nodes)
        left = row.where(F.size("front") > 0).select(key, "front")
        if left.isEmpty():
            return out
        rounds += 1


def _node(path: Column, n: Column) -> Column:
    return F.struct(path.alias("path"), *[n[c].alias(c) for c in NODE_FIELDS], F.coalesce(F.size(n["children"]), F.lit(0)).alias("n_children"))


def _below(items: str, kind: str, name: str) -> Column:
    """The children of all ``items``, each with its path."""
    below = lambda p: F.transform(p["n"]["children"], lambda c, i: F.struct(F.concat(p["path"], F.array(i)).alias("path"), c.alias(name)))
    return F.flatten(F.transform(items, lambda p: F.coalesce(below(p), F.array().cast(f"array<struct<path:array<int>,{name}:{kind}>>"))))


def _parsed(left: DataFrame, key: str) -> DataFrame:
    """(key, front) -> (key, nodes, front): the nodes of ``ROUND_LEVELS`` levels and
    the texts below them.  Both ways of parsing stand in a row; one finds nothing."""
    kinds = ["string"]
    for _ in range(ROUND_LEVELS):
        kinds.append(f"struct<{', '.join(f'{c}:string' for c in NODE_FIELDS)}, children:array<{kinds[-1]}>>")
    whole = kinds[-1][:-1] + f", {ODD_TEXT}:string>"
    row = left.select(key, "front", F.transform("front", lambda f: F.struct(
        f["path"].alias("path"), F.from_json(f["js"], whole, {"columnNameOfCorruptRecord": ODD_TEXT}).alias("n"))).alias("items"))
    odd = F.exists("items", lambda p: p["n"][ODD_TEXT].isNotNull()) | F.exists("front", lambda f: f["js"].rlike(ODD_NUMBERS))
    row = row.select(key, "front", F.coalesce(odd, F.lit(True)).alias("odd"), "items")
    none = lambda name: F.filter(name, lambda _: F.lit(False))
    row = row.select(key, F.when(F.col("odd"), F.col("front")).otherwise(none("front")).alias("front"),
                     F.when(F.col("odd"), none("items")).otherwise(F.col("items")).alias("items"))
    found = []
    for k in range(ROUND_LEVELS):
        last = k == ROUND_LEVELS - 1
        row = row.select(key, "front", *found, F.transform("items", lambda p: _node(p["path"], p["n"])).alias(f"level{k}"),
                         _below("items", kinds[-2 - k], "js" if last else "n").alias("items"))
        found.append(f"level{k}")
    row = row.select(key, "front", F.concat(*found).alias("nodes"), F.col("items").alias("rest"))
    found = ["nodes"]
    for k in range(ROUND_LEVELS):
        row = row.select(key, *found, "rest", F.transform("front", lambda f: F.struct(f["path"].alias("path"), F.from_json(f["js"], NODE_SCHEMA).alias("n"))).alias("items"))
        row = row.select(key, *found, "rest", F.transform("items", lambda p: _node(p["path"], p["n"])).alias(f"level{k}"), _below("items", "string", "js").alias("front"))
        found.append(f"level{k}")
    return row.select(key, F.concat(*found).alias("nodes"), F.concat("rest", "front").alias("front"))


# Arguments of a complete tree that a compact tree leaves out, the
# order of the others (those not named come last, by name), types whose
# children vanish, and types that keep their first argument alone.
SKIPPED_ARGS = ["typed", "safe", "format", "action", "default", "catalog", "db", "hint", "kind", "operation_modifiers",
                "limit_options", "with_fill", "nested", "prefix"]
ARG_ORDER = ["this", "left", "right", "expression", "expressions", "from_", "joins", "where", "group", "having", "order", "limit", "offset"]
LEAF_TYPES = ["table", "column", "literal", "null"]
WRAPPER_TYPES = ["paren", "cast"]


def compact_trees(nodes: DataFrame) -> DataFrame:
    """Complete trees -> compact trees, of any depth.

    ``nodes``: (example_id, node_id, parent_id, arg_key, pos, node_type, name,
    value, value_type, cast_to), a null ``parent_id`` at the root; ``pos`` numbers
    the nodes of a list argument.  A node goes, with all below it, if it is an
    identifier, stands under a skipped argument, under a leaf, or under another
    argument of a parenthesis or a cast than their first.  The others keep their
    order by (argument's rank, argument, pos) and get positions anew.

    Both what goes and the new paths come down from the ancestors by pointer
    doubling: after round k a node knows of 2**k ancestors, so the rounds are
    the logarithm of the depth, each an equi-join on (example_id, node_id).
    Returns (example_id, path ARRAY<INT>, node_type, name, value, value_type, cast_to)."""
    above = nodes.select("example_id", F.col("node_id").alias("parent_id"), F.col("node_type").alias("over"))
    told = nodes.join(above, ["example_id", "parent_id"], "left")
    gone = ((F.col("node_type") == "identifier") | F.col("arg_key").isin(SKIPPED_ARGS) | F.col("over").isin(LEAF_TYPES)
            | (F.col("over").isin(WRAPPER_TYPES) & (F.col("arg_key") != "this")))
    state = told.select("example_id", "node_id", F.col("parent_id").alias("up"), F.coalesce(gone, F.lit(False)).alias("gone"))
    fate = _double(state, "gone", lambda own, higher: own | higher, "compact-fate")
    kept = told.join(fate.where("NOT gone").select("example_id", "node_id"), ["example_id", "node_id"], "left_semi")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(a) for a in ARG_ORDER]), F.col("arg_key")), F.lit(0))
    w = Window.partitionBy("example_id", "parent_id").orderBy(F.when(rank == 0, 10_000).otherwise(rank), "arg_key", "pos", "node_id")
    step = F.when(F.col("parent_id").isNotNull(), F.array((F.row_number().over(w) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    paths = _double(kept.select("example_id", "node_id", F.col("parent_id").alias("up"), step.alias("path")), "path",
                    lambda own, higher: F.concat(higher, own), "compact-paths")
    null = F.col("node_type") == "null"
    return kept.join(paths, ["example_id", "node_id"]).select(
        "example_id", "path", F.when(null, "literal").otherwise(F.col("node_type")).alias("node_type"), "name",
        F.when(~null, F.col("value")).alias("value"), F.when(null, "null").otherwise(F.col("value_type")).alias("value_type"),
        F.when(F.col("node_type") == "cast", F.col("cast_to")).alias("cast_to"))


def _double(state: DataFrame, value: str, join, name: str) -> DataFrame:
    """(example_id, node_id, value) after ``value`` of all ancestors has been
    joined into each node's; ``state`` has ``up``, the parent."""
    state = materialize(state, name)
    while not state.where("up IS NOT NULL").isEmpty():
        higher = state.select("example_id", F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col(value).alias("_value"))
        state = materialize(state.join(higher, ["example_id", "up"], "left").select(
            "example_id", "node_id", F.col("_up").alias("up"),
            F.when(F.col("_value").isNull(), F.col(value)).otherwise(join(F.col(value), F.col("_value"))).alias(value)), name)
    return state.select("example_id", "node_id", value)


def nodes_by_type(nodes: DataFrame, types: list[str]) -> DataFrame:
    """Nodes of a type (or type set) with their preorder rank per tree."""
    w = Window.partitionBy("example_id").orderBy("path")
    return nodes.where(F.col("node_type").isin(types)).withColumn("rank", F.row_number().over(w))


def tree_references(nodes: DataFrame) -> DataFrame:
    """C4: per tree, the preorder lists (duplicates kept, empty names skipped)
    of column names, table names and literals (value, value_type)."""
    def ordered(cond, val):
        items = F.collect_list(F.when(cond, F.struct(F.col("path").alias("p"), val.alias("v"))))
        return F.transform(F.array_sort(items), lambda s: s["v"])

    nonempty = F.col("name").isNotNull() & (F.col("name") != "")
    return nodes.groupBy("example_id").agg(
        ordered((F.col("node_type") == "column") & nonempty, F.col("name")).alias("columns"),
        ordered((F.col("node_type") == "table") & nonempty, F.col("name")).alias("tables"),
        ordered(F.col("node_type") == "literal",
                F.struct(F.col("value").alias("value"), F.col("value_type").alias("value_type"))).alias("literals"))


def select_columns(nodes: DataFrame) -> DataFrame:
    """Column nodes under root children that are not a clause (from,
    where, join, group/groupby, order, limit, having)."""
    top = nodes.where((F.col("depth") == 1) & ~F.col("node_type").isin(NON_SELECT_CLAUSES)).select(
        "example_id", F.col("pos").alias("top_pos"))
    cols = nodes.where((F.col("node_type") == "column") & (F.col("depth") >= 1)).withColumn(
        "top_pos", F.col("path")[0])
    return cols.join(top, ["example_id", "top_pos"], "left_semi").drop("top_pos")


def clause_nodes(nodes: DataFrame) -> DataFrame:
    """First node in preorder of each clause type (nested subqueries
    included), plus every join node.  Returns (example_id, clause, path)."""
    first = (nodes.where(F.col("node_type").isin("where", "from", "group", "groupby", "order", "limit"))
             .withColumn("clause", F.when(F.col("node_type") == "groupby", "group").otherwise(F.col("node_type")))
             .groupBy("example_id", "clause").agg(F.min("path").alias("path")))
    joins = nodes.where(F.col("node_type") == "join").select("example_id", F.lit("join").alias("clause"), "path")
    return first.unionByName(joins)


def predicate_nodes(nodes: DataFrame) -> DataFrame:
    """Comparison and logical nodes, tagged by kind."""
    kind = F.when(F.col("node_type").isin(COMPARISON_TYPES), "comparison").otherwise("logical")
    return nodes.where(F.col("node_type").isin(COMPARISON_TYPES + LOGICAL_TYPES)).withColumn("kind", kind)


def tree_flags(nodes: DataFrame) -> DataFrame:
    """Per tree, any aggregation node / any distinct node."""
    return nodes.groupBy("example_id").agg(
        F.max(F.col("node_type").isin(AGG_TYPES)).alias("has_aggregation"),
        F.max(F.col("node_type") == "distinct").alias("has_distinct"))


def node_by_path(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Node at a requested path (equi-join on path); out of range -> NULLs."""
    n = nodes.select("example_id", "path", "node_type", "name", "value")
    return requests.join(n, ["example_id", "path"], "left")


def where_literals(nodes: DataFrame) -> DataFrame:
    """Literal nodes in the subtree of each tree's first WHERE node."""
    anchor = (nodes.where(F.col("node_type") == "where").groupBy("example_id")
              .agg(F.min("path").alias("anchor")))
    lits = nodes.where(F.col("node_type") == "literal")
    j = lits.join(anchor, "example_id")
    return j.where(F.slice("path", 1, F.size("anchor")) == F.col("anchor")).drop("anchor")


def normalized_name(nodes: DataFrame) -> DataFrame:
    """Node table with ``name_norm`` / ``value_norm`` (identifier norm)."""
    return nodes.withColumn("name_norm", norm(F.col("name"))).withColumn("value_norm", norm(F.col("value")))
