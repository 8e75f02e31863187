"""Spark side of the derived inputs: runs the shared derivation SQL of
:mod:`errata.sources.workload` against one test-data directory."""

from __future__ import annotations

import weakref

from hashlib import md5

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.sources import workload as W
from errata.session import materialize
from errata.sources.loaders import catalog_snapshot

# Written tables and their derivations, the ones that hold others first.
WRITTEN = {"tree_node": W.tree_node_sql, "catalog_column": W.catalog_column_sql, "catalog_table": W.catalog_table_sql,
           "query_part": W.query_part_sql, "example": W.example_sql}

# Derivations that join or number an example's rows, and their forms by one grouping.
GROUPED = {W.ast_lines_sql: W.ast_lines_grouped_sql, W.graph_text_sql: W.graph_text_grouped_sql}


class Workload:
    """Lazily built DataFrames of the derived input tables of one test-data
    directory.  Nothing is collected; every table is a plan over the parquet
    files, so it grows with the data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.d = W.Dialect("spark", self.sf_dir)
        self._made: dict[str, DataFrame] = {}
        self._views: set[str] = set()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames) if frames else self.spark.sql(text)

    def view(self, name: str) -> str:
        """A session view of the table that method or property ``name`` gives."""
        view = f"errata_{name}_{md5(self.sf_dir.encode()).hexdigest()[:8]}"
        if view not in self._views:
            made = getattr(self, name)
            # a fixed table (the columns of the 14 tables) may be broadcast
            (F.broadcast(made) if name == "base_column_raw" else made()).createOrReplaceTempView(view)
            self._views.add(view)
        return view

    def derived(self, text: str, *fixed: str) -> DataFrame:
        """The derivation ``text``; the written tables' own derivations within it
        are read from those tables instead of being computed at every mention.
        A text with a Spark form gives the same rows by that."""
        for make, form in GROUPED.items():
            if text == make(self.d):
                text = form(self.d)
        for name, make in WRITTEN.items():
            part = make(self.d)
            if part in text and part != text:
                text = text.replace(part, f"SELECT * FROM {self.view(name)}")
        for name in fixed:
            if name in text:
                text = text.replace(name, self.view(name))
        return self.spark.sql(text)

    def once(self, name: str, build) -> DataFrame:
        """The written table ``name``, made by ``build`` when first asked for."""
        if name not in self._made:
            self._made[name] = materialize(build(), name)
        return self._made[name]

    # examples and evaluation -------------------------------------------
    @cached_property
    def _example(self) -> DataFrame:
        return materialize(self._sql(W.example_sql(self.d)), "example")

    def example(self) -> DataFrame:
        return self._example

    @cached_property
    def _linking(self) -> DataFrame:
        return materialize(self._sql(W.linking_sql(self.d)), "linking")

    def linking(self) -> DataFrame:
        return self._linking

    @cached_property
    def _picklists(self) -> DataFrame:
        from errata.operators.values import picklists

        return materialize(picklists({t: self.table(t) for t in W.TABLES}), "picklists")

    def picklists(self) -> DataFrame:
        return self._picklists

    def eval_spine(self) -> DataFrame:
        return self._sql(W.eval_spine_sql(self.d))

    # query parts and trees ---------------------------------------------
    def query_part(self) -> DataFrame:
        return self._query_part

    @cached_property
    def _query_part(self) -> DataFrame:
        return materialize(self._sql(W.query_part_sql(self.d)), "query_part")

    @cached_property
    def _tree_node(self) -> DataFrame:
        return self._nodes_of(self._query_part)

    def _nodes_of(self, parts: DataFrame) -> DataFrame:
        """Stages of the node derivation are read many times by the node list;
        each is written once to the checkpoint folder, which also keeps the
        plans small."""
        frames = {"qp": parts}
        for st in W.TREE_STAGES:
            refs = {k: "{" + k + "}" for k in frames}
            frames[st] = materialize(self.spark.sql(W.tree_stage_sql(self.d, st, refs), **frames), st)
        refs = {k: "{" + k + "}" for k in frames}
        return materialize(self.spark.sql(W.tree_stage_sql(self.d, "nodes", refs), **frames), "tree_node")

    def tree_node(self) -> DataFrame:
        return self._tree_node

    @cached_property
    def _tree(self) -> DataFrame:
        """tree(example_id, tree_json).  An example's parts meet in one row by
        one grouping, and its text is one expression over them.  Parts that do
        not stand once each in the places that a generated query has go through
        the node table; no key does in tables without repeated orders."""
        if type(self).tree_node is not Workload.tree_node:  # the node table is given
            return self._folded(self.tree_node())
        parts = self._query_part
        grouped = parts.where("example_id IS NOT NULL").groupBy("example_id").agg(F.collect_list(F.struct(*W.TREE_PART_COLS)).alias("parts"))
        trees = materialize(grouped.select("example_id", F.expr(W.tree_parts_odd_sql()).alias("odd"), "parts").select(
            "example_id", "odd", F.expr(f"CASE WHEN NOT odd THEN {W.tree_parts_json_sql(self.d)} END").alias("tree_json")), "tree")
        lone = parts.where("example_id IS NULL AND clause = 'from' AND depth = 0").select(
            "example_id", F.lit('{"node_type":"select","children":[]}').alias("tree_json"))
        whole = trees.where("NOT odd").select("example_id", "tree_json").unionByName(lone)
        odd = trees.where("odd").select("example_id")
        if not odd.isEmpty():
            whole = whole.unionByName(self._folded(self._nodes_of(parts.join(odd, "example_id", "left_semi"))))
        return whole

    def _folded(self, nodes: DataFrame) -> DataFrame:
        """(example_id, tree_json), nested bottom-up from a node table.  An
        example's nodes meet in one row by one grouping; the levels are folded
        over that row's array, so no level is joined, shuffled or written."""
        n0 = nodes.selectExpr("example_id", "depth", "path", f"{W.node_head_json(self.d, '')} AS head")
        deepest = nodes.agg(F.max("depth")).first()[0] or 0
        if deepest > W.MAX_TREE_DEPTH:
            raise ValueError(f"derived trees reach depth {deepest}; MAX_TREE_DEPTH is {W.MAX_TREE_DEPTH}")
        grouped = n0.where("example_id IS NOT NULL").groupBy("example_id").agg(F.collect_list(F.struct("depth", "path", "head")).alias("nodes")).select(
            "example_id", F.expr("""transform(nodes, n -> named_struct('depth', n.depth, 'path', n.path, 'head', n.head,
                'parent', CASE WHEN n.depth <= 1 THEN '' ELSE substring_index(n.path, '.', n.depth - 1) END,
                'pos', CASE WHEN n.depth = 0 THEN 0 ELSE CAST(substring_index(n.path, '.', -1) AS BIGINT) END))""").alias("nodes"))
        level = None
        for k in range(W.MAX_TREE_DEPTH, -1, -1):
            kids = "array_join(transform(array_sort(filter(below, c -> c.parent = n.path)), c -> c.js), ',')" if level else "''"
            here = f"""transform(filter(nodes, n -> n.depth = {k}), n -> named_struct(
                'pos', n.pos, 'js', concat(n.head, ',"children":[', {kids}, ']}}'), 'parent', n.parent))"""
            # a lambda names the level below, which is so computed once a row and not once a node
            level = f"transform(array({level}), below -> {here})[0]" if level else here
        trees = grouped.select("example_id", F.expr(level).alias("roots")).select("example_id", F.explode("roots.js").alias("tree_json"))
        # a null id equals no other, so its roots have no children
        lone = n0.where("example_id IS NULL AND depth = 0").select("example_id", F.concat("head", F.lit(',"children":[]}')).alias("tree_json"))
        return materialize(trees.unionByName(lone), "tree")

    def tree(self) -> DataFrame:
        return self._tree

    @cached_property
    def nodes(self) -> DataFrame:
        """The flattened trees (C1 output), which C1 has written once to the
        checkpoint folder, so every tree operator starts from the same node table."""
        from errata.operators.trees import flatten_trees

        return flatten_trees(self.tree())

    @cached_property
    def _error_log(self) -> DataFrame:
        return materialize(self._sql(W.error_log_sql(self.d)), "error_log")

    def error_log(self) -> DataFrame:
        return self._error_log

    # catalogs ----------------------------------------------------------
    @cached_property
    def base_column_raw(self) -> DataFrame:
        frames = {t: self.table(t) for t in W.TABLES}
        return catalog_snapshot(self.spark, frames).selectExpr(
            "table_name", "ordinal", "column_name", "raw_type")

    def _catalog(self, text: str) -> DataFrame:
        return self.derived(text, "base_column_raw")

    @cached_property
    def _catalog_table(self) -> DataFrame:
        return materialize(self._sql(W.catalog_table_sql(self.d)), "catalog_table")

    @cached_property
    def _catalog_column(self) -> DataFrame:
        return materialize(self._catalog(W.catalog_column_sql(self.d)), "catalog_column")

    @cached_property
    def _catalog_pk(self) -> DataFrame:
        return materialize(self._catalog(W.catalog_pk_sql(self.d)), "catalog_pk")

    @cached_property
    def _catalog_fk(self) -> DataFrame:
        return materialize(self._catalog(W.catalog_fk_sql(self.d)), "catalog_fk")

    def catalog_table(self) -> DataFrame:
        return self._catalog_table

    def catalog_column(self) -> DataFrame:
        return self._catalog_column

    def catalog_pk(self) -> DataFrame:
        return self._catalog_pk

    def catalog_fk(self) -> DataFrame:
        return self._catalog_fk

    def prepare(self) -> None:
        """Write every derived input once (bench and batch runs)."""
        for t in (self.nodes, self.example(), self.linking(), self.error_log(), self.catalog_table(),
                  self.catalog_column(),
                  self.catalog_pk(), self.catalog_fk()):
            t.count()


_CACHE: "weakref.WeakKeyDictionary[SparkSession, dict[str, Workload]]" = weakref.WeakKeyDictionary()


def workload(spark: SparkSession, sf_dir: str) -> Workload:
    """One Workload per (session, directory), so registered queries share the
    derived inputs already written to the checkpoint folder."""
    known = _CACHE.setdefault(spark, {})
    key = sf_dir.rstrip("/")
    if key not in known:
        known[key] = Workload(spark, sf_dir)
    return known[key]
