"""Catalog-graph operators.

Catalog tables: catalog_table(db_id, table_idx, table_name),
catalog_column(db_id, column_idx, table_idx, column_name, label, type) with
column 0 = ``*``, catalog_pk(db_id, column_idx), catalog_fk(db_id, from_idx,
to_idx).  Every join is keyed by ``db_id`` (plus an index or name); nothing
pairs all items of a database with each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from errata.functions.text import norm, stable_column_id


def _named_columns(ct: DataFrame, cc: DataFrame) -> DataFrame:
    """Real columns (index >= 1) with their table's name."""
    return (cc.where(F.col("column_idx") >= 1)
            .join(ct.select("db_id", "table_idx", "table_name"), ["db_id", "table_idx"]))


def graph_nodes(ct: DataFrame, cc: DataFrame) -> DataFrame:
    """Table nodes first (id = lower table name), then column nodes in
    index order (id = stable column id, label = original column name,
    datatype); column 0 (``*``) is never a node.
    Returns (db_id, node_ord, id, type, label, datatype)."""
    tables = ct.select(
        "db_id", F.col("table_idx").alias("ord"), F.lower("table_name").alias("id"),
        F.lit("table").alias("type"), F.lower("table_name").alias("label"),
        F.lit(None).cast("string").alias("datatype"), F.lit(0).alias("grp"))
    cols = _named_columns(ct, cc).select(
        "db_id", F.col("column_idx").alias("ord"), stable_column_id("table_name", "column_name").alias("id"),
        F.lit("column").alias("type"), F.col("column_name").alias("label"),
        F.col("type").alias("datatype"), F.lit(1).alias("grp"))
    nodes = tables.unionByName(cols)
    w = Window.partitionBy("db_id").orderBy("grp", "ord")
    return nodes.withColumn("node_ord", F.row_number().over(w) - 1).drop("grp", "ord")


def graph_edges(ct: DataFrame, cc: DataFrame, pk: DataFrame, fk: DataFrame) -> DataFrame:
    """has_column (table -> column), has_table (db -> table),
    primary_key_of (column -> table, composite keys flattened), foreign_key_to
    (column -> column, only when both ends are nodes).
    Returns (db_id, src, tgt, rel)."""
    cols = _named_columns(ct, cc).select(
        "db_id", "column_idx", F.lower("table_name").alias("tid"),
        stable_column_id("table_name", "column_name").alias("cid"))
    has_col = cols.select("db_id", F.col("tid").alias("src"), F.col("cid").alias("tgt"),
                          F.lit("has_column").alias("rel"))
    has_tab = ct.select("db_id", F.col("db_id").alias("src"), F.lower("table_name").alias("tgt"),
                        F.lit("has_table").alias("rel"))
    pk_e = cols.join(pk, ["db_id", "column_idx"], "left_semi").select(
        "db_id", F.col("cid").alias("src"), F.col("tid").alias("tgt"), F.lit("primary_key_of").alias("rel"))
    a = cols.select("db_id", F.col("column_idx").alias("from_idx"), F.col("cid").alias("src"))
    b = cols.select("db_id", F.col("column_idx").alias("to_idx"), F.col("cid").alias("tgt"))
    fk_e = fk.join(a, ["db_id", "from_idx"]).join(b, ["db_id", "to_idx"]).select(
        "db_id", "src", "tgt", F.lit("foreign_key_to").alias("rel"))
    return has_col.unionByName(has_tab).unionByName(pk_e).unionByName(fk_e)


def smallest_values(df: DataFrame, table_name: str, k: int = 3) -> DataFrame:
    """D3 for one table: the ``k`` smallest distinct non-null values of every
    primitive column, in the column's own order.

    Round r is one scan with a map-side partial ``min`` per column, filtered
    above the previous round's minimum (a scalar subquery), so the shuffle is
    one row per task whatever the column cardinality.
    Returns (table_name, column_name, rank, value STRING)."""
    cols = [f.name for f in df.schema.fields
            if f.dataType.typeName() not in ("array", "map", "struct", "binary")]
    rounds = []
    prev = None
    for r in range(1, k + 1):
        aggs = []
        for c in cols:
            x = F.col(c)
            cond = x.isNotNull() if prev is None else (x > prev.select(c).scalar())
            aggs.append(F.min(F.when(cond, x)).alias(c))
        cur = df.agg(*aggs).persist()  # one row; read by the next round's filter
        rounds.append(cur.select(*[F.struct(F.lit(c).alias("column_name"), F.lit(r).alias("rank"),
                                             F.col(c).cast("string").alias("value")).alias(c) for c in cols]))
        prev = cur
    out = None
    for r in rounds:
        e = r.select(F.explode(F.array(*cols)).alias("s")).select("s.*")
        out = e if out is None else out.unionByName(e)
    return out.where(F.col("value").isNotNull()).select(F.lit(table_name).alias("table_name"), "*")


def column_examples(tables: dict[str, DataFrame], k: int = 3) -> DataFrame:
    """D3: up to ``k`` example values per column of every table."""
    out = None
    for name, df in tables.items():
        e = smallest_values(df, name, k)
        out = e if out is None else out.unionByName(e)
    return out


def attach_docs(nodes: DataFrame, ct: DataFrame, cc: DataFrame, docs: DataFrame) -> DataFrame:
    """Column descriptions matched case-insensitively on (table, column);
    an empty description means no description."""
    cols = _named_columns(ct, cc).select(
        "db_id", stable_column_id("table_name", "column_name").alias("id"),
        F.lower("table_name").alias("t"), F.lower("column_name").alias("c"))
    d = docs.select("db_id", F.lower("table_name").alias("t"), F.lower("column_name").alias("c"),
                    F.nullif(F.trim("description"), F.lit("")).alias("description"))
    desc = cols.join(d, ["db_id", "t", "c"]).select("db_id", "id", "description")
    return nodes.join(desc, ["db_id", "id"], "left")


def linked_subset(ct: DataFrame, cc: DataFrame, pk: DataFrame, fk: DataFrame, linking: DataFrame) -> DataFrame:
    """Per example, the chosen schema items and their key closure.

    ``linking``: (example_id, db_id, table_name, columns ARRAY<STRING> or NULL).
    Included tables: linked tables (case-insensitive) whose list is not NULL.
    Included columns: columns of those tables whose original name or label
    (lower-cased) is listed; primary-key columns of included tables; both ends
    of foreign keys whose two tables are included.
    Returns (example_id, db_id, kind, idx)."""
    lk = linking.where(F.col("columns").isNotNull()).select(
        "example_id", "db_id", F.lower("table_name").alias("t"), "columns")
    tabs = ct.select("db_id", "table_idx", F.lower("table_name").alias("t"))
    inc_t = lk.join(tabs, ["db_id", "t"]).select("example_id", "db_id", "table_idx", "columns").dropDuplicates(
        ["example_id", "db_id", "table_idx"])
    named = cc.where(F.col("column_idx") >= 1).select("db_id", "table_idx", "column_idx", "column_name", "label")
    listed = (lk.join(tabs, ["db_id", "t"]).select("example_id", "db_id", "table_idx", F.explode("columns").alias("want"))
              .join(named, ["db_id", "table_idx"])
              .where((F.lower("column_name") == F.col("want")) | (F.lower("label") == F.col("want")))
              .select("example_id", "db_id", "column_idx"))
    pk_cols = (inc_t.select("example_id", "db_id", "table_idx")
               .join(named.join(pk, ["db_id", "column_idx"], "left_semi"), ["db_id", "table_idx"])
               .select("example_id", "db_id", "column_idx"))
    ct_idx = named.select("db_id", "column_idx", "table_idx")
    fk_t = (fk.join(ct_idx.withColumnRenamed("column_idx", "from_idx").withColumnRenamed("table_idx", "ft"), ["db_id", "from_idx"])
              .join(ct_idx.withColumnRenamed("column_idx", "to_idx").withColumnRenamed("table_idx", "tt"), ["db_id", "to_idx"]))
    it = inc_t.select("example_id", "db_id", "table_idx")
    fk_inc = (fk_t.join(it.withColumnRenamed("table_idx", "ft"), ["db_id", "ft"])
              .join(it.withColumnRenamed("table_idx", "tt"), ["example_id", "db_id", "tt"]))
    fk_cols = fk_inc.select("example_id", "db_id", F.explode(F.array("from_idx", "to_idx")).alias("column_idx"))
    columns = listed.unionByName(pk_cols).unionByName(fk_cols).distinct()
    return (it.select("example_id", "db_id", F.lit("table").alias("kind"), F.col("table_idx").alias("idx"))
            .unionByName(columns.select("example_id", "db_id", F.lit("column").alias("kind"),
                                        F.col("column_idx").alias("idx"))))


def resolve_targets(ct: DataFrame, cc: DataFrame, linking: DataFrame) -> DataFrame:
    """Each linked column name -> the first (lowest index) column of the
    linked table matching by original name or label; unknown names vanish."""
    tabs = ct.select("db_id", "table_idx", F.lower("table_name").alias("t"))
    named = cc.where(F.col("column_idx") >= 1).select("db_id", "table_idx", "column_idx", "column_name", "label")
    want = (linking.where(F.col("columns").isNotNull())
            .select("example_id", "db_id", "table_name", F.lower("table_name").alias("t"),
                    F.explode("columns").alias("name")))
    hits = (want.join(tabs, ["db_id", "t"]).join(named, ["db_id", "table_idx"])
            .where((F.lower("column_name") == F.col("name")) | (F.lower("label") == F.col("name"))))
    return hits.groupBy("example_id", "db_id", "table_name", "name").agg(F.min("column_idx").alias("column_idx"))


def graph_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per column node, its owner table (has_column edge, else the id's
    prefix before '.'), whether it is a primary key, and its FK targets."""
    cols = nodes.where(F.col("type") == "column").select("db_id", "id")
    owner = edges.where(F.col("rel") == "has_column").groupBy("db_id", F.col("tgt").alias("id")).agg(
        F.min("src").alias("owner_edge"))
    pks = edges.where(F.col("rel") == "primary_key_of").select("db_id", F.col("src").alias("id")).distinct() \
        .withColumn("is_pk", F.lit(True))
    fks = edges.where(F.col("rel") == "foreign_key_to").groupBy("db_id", F.col("src").alias("id")).agg(
        F.array_sort(F.collect_set("tgt")).alias("fk_targets"))
    return (cols.join(owner, ["db_id", "id"], "left").join(pks, ["db_id", "id"], "left")
            .join(fks, ["db_id", "id"], "left")
            .select("db_id", "id",
                    F.coalesce("owner_edge", F.when(F.col("id").contains("."), F.substring_index("id", ".", 1)))
                    .alias("owner_table"),
                    F.coalesce("is_pk", F.lit(False)).alias("is_pk"),
                    F.coalesce("fk_targets", F.array().cast("array<string>")).alias("fk_targets")))


def resolve_names(names: DataFrame, nodes: DataFrame, kind: str = "column") -> DataFrame:
    """Does a name exist among the graph's nodes of ``kind``, and which
    node is the first (node order) whose normalised id tail or normalised
    label equals the normalised name?  ``names``: (example_id, db_id, name).
    Equi-join on the normalised key, so a hot database costs one hash probe
    per name."""
    n = nodes.where(F.col("type") == kind)
    tail = F.substring_index("id", ".", -1) if kind == "column" else F.col("id")
    keys = (n.select("db_id", "node_ord", "id", F.explode(F.array_distinct(F.array(norm(tail), norm(F.col("label")))))
                     .alias("key")))
    first = keys.groupBy("db_id", "key").agg(F.min_by("id", "node_ord").alias("node_id"))
    q = names.withColumn("key", norm(F.col("name")))
    return (q.join(first, ["db_id", "key"], "left")
            .select(*names.columns, F.col("node_id").isNotNull().alias("found"), "node_id"))


def schema_relations(ct: DataFrame, cc: DataFrame, pk: DataFrame, fk: DataFrame) -> DataFrame:
    """The specific relations between schema items of a database, in
    sparse form (every pair not listed is ``generic``; two columns of one
    table are ``sametable``, read off their table index instead of being
    materialised as all pairs).

    table-table: identity; fkb when keys run both ways, else fk / fkr.
    column-column: identity; fk / fkr, where fkr overrides identity on a
    self-reference.  table-column / column-table: has, pk overriding has;
    ``*`` (column 0) is ``has`` to every table.
    Returns (db_id, src_kind, src_idx, tgt_kind, tgt_idx, rel)."""
    col_t = cc.select("db_id", "column_idx", "table_idx")
    # table level ---------------------------------------------------------
    tf = (fk.join(col_t.withColumnRenamed("column_idx", "from_idx").withColumnRenamed("table_idx", "t1"), ["db_id", "from_idx"])
            .join(col_t.withColumnRenamed("column_idx", "to_idx").withColumnRenamed("table_idx", "t2"), ["db_id", "to_idx"])
            .select("db_id", "t1", "t2").distinct())
    rev = tf.select("db_id", F.col("t2").alias("t1"), F.col("t1").alias("t2"), F.lit(True).alias("back"))
    tf = tf.join(rev, ["db_id", "t1", "t2"], "left")
    fwd = tf.select("db_id", "t1", "t2", F.when(F.col("back"), "fkb").otherwise("fk").alias("rel"))
    bwd = tf.where(F.col("back").isNull()).select("db_id", F.col("t2").alias("t1"), F.col("t1").alias("t2"),
                                                  F.lit("fkr").alias("rel"))
    tt = fwd.unionByName(bwd).where(F.col("t1") != F.col("t2"))
    tt = tt.unionByName(ct.select("db_id", F.col("table_idx").alias("t1"), F.col("table_idx").alias("t2"),
                                  F.lit("identity").alias("rel")))
    tt = tt.select("db_id", F.lit("table").alias("src_kind"), F.col("t1").alias("src_idx"),
                   F.lit("table").alias("tgt_kind"), F.col("t2").alias("tgt_idx"), F.concat(F.lit("table-table-"), "rel").alias("rel"))
    # column level: identity, then key pair by key pair in (from, to) order:
    # fk (from,to) and after it fkr (to,from); the last writer wins ----------
    def written(c1, c2, rel, turn, within):
        at = F.array(*[F.lit(x).cast("bigint") if isinstance(x, int) else F.col(x).cast("bigint") for x in (*turn, within)])
        return F.col(c1).alias("c1"), F.col(c2).alias("c2"), F.lit(rel).alias("rel"), at.alias("o")

    cf = fk.select("db_id", *written("from_idx", "to_idx", "fk", (1, "from_idx", "to_idx"), 0))
    cr = fk.select("db_id", *written("to_idx", "from_idx", "fkr", (1, "from_idx", "to_idx"), 1))
    ci = cc.select("db_id", *written("column_idx", "column_idx", "identity", (0, 0, 0), 0))
    cpairs = ci.unionByName(cf.where((F.col("c1") > 0) & (F.col("c2") > 0))).unionByName(
        cr.where((F.col("c1") > 0) & (F.col("c2") > 0)))
    cpairs = cpairs.groupBy("db_id", "c1", "c2").agg(F.max_by("rel", "o").alias("rel"))
    ccr = cpairs.select("db_id", F.lit("column").alias("src_kind"), F.col("c1").alias("src_idx"),
                        F.lit("column").alias("tgt_kind"), F.col("c2").alias("tgt_idx"),
                        F.concat(F.lit("column-column-"), "rel").alias("rel"))
    # table-column ----------------------------------------------------------
    tcol = cc.where(F.col("column_idx") >= 1).join(pk.withColumn("pk", F.lit(True)), ["db_id", "column_idx"], "left")
    kind = F.when(F.col("pk"), "pk").otherwise("has")
    tc = tcol.select("db_id", "table_idx", "column_idx", kind.alias("k"))
    star = ct.select("db_id", "table_idx", F.lit(0).cast("bigint").alias("column_idx"), F.lit("has").alias("k"))
    tc = tc.unionByName(star)
    t2c = tc.select("db_id", F.lit("table").alias("src_kind"), F.col("table_idx").alias("src_idx"),
                    F.lit("column").alias("tgt_kind"), F.col("column_idx").alias("tgt_idx"),
                    F.concat(F.lit("table-column-"), "k").alias("rel"))
    c2t = tc.select("db_id", F.lit("column").alias("src_kind"), F.col("column_idx").alias("src_idx"),
                    F.lit("table").alias("tgt_kind"), F.col("table_idx").alias("tgt_idx"),
                    F.concat(F.lit("column-table-"), "k").alias("rel"))
    return tt.unionByName(ccr).unionByName(t2c).unionByName(c2t)


MAX_RELATIVE_DIST = 4


def token_relations(tokens: DataFrame, key: str = "example_id") -> DataFrame:
    """Relations between question tokens within distance 4
    (``question-question-dist{j-i}``); farther pairs are ``generic`` and are
    not materialised.  ``tokens``: (key, pos).  Each token meets at most 9
    partners, generated by offsets rather than a self-join on the question."""
    offs = F.sequence(F.lit(-MAX_RELATIVE_DIST), F.lit(MAX_RELATIVE_DIST))
    n = tokens.groupBy(key).agg(F.max("pos").alias("max_pos"))
    t = tokens.join(n, key).select(key, F.col("pos").alias("i"), F.explode(offs).alias("d"), "max_pos")
    t = t.withColumn("j", F.col("i") + F.col("d")).where((F.col("j") >= 0) & (F.col("j") <= F.col("max_pos")))
    return t.select(key, "i", "j", F.concat(F.lit("question-question-dist"), F.col("d").cast("string")).alias("rel"))
