"""Corpus synthesis over query parts.

A query is a set of parts (example_id, clause, depth, pos, func, tbl, col,
op, val, val_type, is_desc).  A change picks one target per example by an md5
rank (so the choice is the same on every partition and every retry),
rewrites, drops or adds parts, and ``render_sql`` rebuilds the text with one
ordered aggregation per example.  A change that finds no target emits no
row for that example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from errata.functions.rand import draw, uniform
from errata.functions.text import norm
from errata.schemas import COUNT_WEIGHTS, TYPE_WEIGHTS
from errata.session import materialize

PART_KEY = ["example_id", "clause", "depth", "pos"]
PART_COLS = ["example_id", "db_id", "depth", "clause", "pos", "func", "tbl", "col", "op", "val", "val_type", "is_desc"]

# Functions the target dialect lacks; comparison swaps in the
# fixed order they are tried.
INVALID_FUNCTIONS = ["YEAR", "MONTH", "DAY", "DATEDIFF", "NOW", "CURDATE", "GETDATE",
                     "DATEADD", "DATENAME", "DATEPART", "ISNULL", "NVL", "CONVERT"]
OPERATOR_SWAPS = [("=", ">"), (">", "<"), ("<", ">="), (">=", "<="), ("<=", "!="), ("!=", "=")]
OP_NAMES = {"=": "EQ", ">": "GT", "<": "LT", ">=": "GTE", "<=": "LTE", "!=": "NEQ"}


def _key(*cols: Column) -> Column:
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def _rank(df: DataFrame, salt: str, key: Column, by: list[str] | None = None) -> DataFrame:
    """Number the candidates of each example in md5 order (1 = chosen)."""
    by = by or ["example_id"]
    d = draw(_key(F.col("example_id"), key), F.lit(salt))
    w = Window.partitionBy(*by).orderBy(d, key)
    return df.withColumn("_r", F.row_number().over(w))


def _chosen(ranked: DataFrame, name: str) -> DataFrame:
    """The first of each example, written once: the description and both joins
    with the parts read it."""
    return materialize(ranked.where(F.col("_r") == 1).drop("_r"), f"{name}-chosen")


def _replace(parts: DataFrame, target: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """Parts of the target examples with the target part's fields replaced."""
    t = target.select(*PART_KEY, *[F.col(c).alias(f"_new_{c}") for c in sets])
    touched = parts.join(target.select("example_id").distinct(), "example_id", "left_semi")
    j = touched.join(t, PART_KEY, "left")
    hit = F.col(f"_new_{next(iter(sets))}").isNotNull() if sets else F.lit(False)
    return j.select(*[F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c)
                      for c in PART_COLS])


def _drop(parts: DataFrame, target: DataFrame) -> DataFrame:
    touched = parts.join(target.select("example_id").distinct(), "example_id", "left_semi")
    return touched.join(target.select(*PART_KEY), PART_KEY, "left_anti")


def _result(changed: DataFrame, info: DataFrame, error_type: str) -> DataFrame:
    """(changed parts, per-example description) -> change record."""
    return info.select("example_id", F.lit(error_type).alias("error_type"), "description").join(
        changed.groupBy("example_id").agg(F.collect_list(F.struct(*PART_COLS)).alias("parts")), "example_id")


def column_refs(parts: DataFrame) -> DataFrame:
    """Every column reference: the ``col`` of select/where/group/order/join
    parts and the right-hand column (``val``) of joins."""
    a = parts.where(F.col("col").isNotNull()).select(*PART_KEY, F.lit("col").alias("field"),
                                                      F.col("col").alias("name"), "db_id")
    b = parts.where((F.col("clause") == "join") & F.col("val").isNotNull()).select(
        *PART_KEY, F.lit("val").alias("field"), F.col("val").alias("name"), "db_id")
    return a.unionByName(b)


def _ref_key() -> Column:
    return _key(F.col("clause"), F.col("depth"), F.col("pos"), F.col("field"))


def _set_ref(parts: DataFrame, chosen: DataFrame, new_name: Column) -> DataFrame:
    """Replace the chosen reference (col or val field) by ``new_name``."""
    c = chosen.select(*PART_KEY, "field", new_name.alias("_nm"))
    touched = parts.join(c.select("example_id").distinct(), "example_id", "left_semi")
    j = touched.join(c, PART_KEY, "left")
    col = F.when(F.col("field") == "col", F.col("_nm")).otherwise(F.col("col"))
    val = F.when(F.col("field") == "val", F.col("_nm")).otherwise(F.col("val"))
    return j.select(*[col.alias("col") if x == "col" else val.alias("val") if x == "val" else F.col(x)
                      for x in PART_COLS])


# ---------------------------------------------------------------- H1-H12

def attribute_redundancy(parts: DataFrame, db_columns: DataFrame) -> DataFrame:
    """H1: one column reference becomes another real column of the database
    (any table, different normalised name).  References for which the database
    has no other name are passed over: a database has one for every reference
    if its least and greatest normalised names differ, else for all but that name."""
    names = db_columns.groupBy("db_id").agg(F.min(norm(F.col("column_name"))).alias("_least"), F.max(norm(F.col("column_name"))).alias("_most"))
    able = column_refs(parts).join(names, "db_id").where((norm(F.col("name")) != F.col("_least")) | (norm(F.col("name")) != F.col("_most")))
    refs = _rank(able.drop("_least", "_most"), "h1", _ref_key()).where(F.col("_r") == 1).drop("_r")
    cand = refs.join(db_columns.select("db_id", F.col("column_name").alias("repl")), "db_id").where(
        norm(F.col("repl")) != norm(F.col("name")))
    pick = _chosen(_rank(cand, "h1r", F.col("repl")), "h1")
    info = pick.select("example_id", F.format_string(
        "Replaced column '%s' with unrelated schema column '%s'", F.col("name"), F.col("repl")).alias("description"))
    return _result(_set_ref(parts, pick, F.col("repl")), info, "attribute_redundancy")


def attribute_missing(parts: DataFrame) -> DataFrame:
    """H2: drop one select item of a query with at least two."""
    sel = parts.where(F.col("clause") == "select")
    n = sel.groupBy("example_id").count().where(F.col("count") >= 2)
    t = _rank(sel.join(n.select("example_id"), "example_id", "left_semi"), "h2", F.col("pos")).where(F.col("_r") == 1)
    item = F.when(F.col("func").isNull(), F.col("col")).otherwise(
        F.concat(F.upper("func"), F.lit("("), F.col("col"), F.lit(")")))
    info = t.select("example_id", F.concat(F.lit("Removed SELECT expression: "), item).alias("description"))
    return _result(_drop(parts, t), info, "attribute_missing")


def attribute_mismatch(parts: DataFrame, db_columns: DataFrame) -> DataFrame:
    """H3: a column found in table A (first table in order holding it) becomes
    a random column of another table of the database with a different name.
    Needs two tables; references with no valid swap are passed over."""
    cols = db_columns.select("db_id", "table_idx", "table_name", "column_idx", "column_name")
    ntab = cols.groupBy("db_id").agg(F.countDistinct("table_idx").alias("nt")).where(F.col("nt") >= 2)
    refs = column_refs(parts).join(ntab.select("db_id"), "db_id", "left_semi")
    src = (refs.join(cols.select("db_id", "table_idx", "table_name", F.col("column_name").alias("cn")), "db_id")
           .where(norm(F.col("cn")) == norm(F.col("name")))
           .groupBy(*PART_KEY, "field", "name", "db_id")
           .agg(F.min_by("table_name", "table_idx").alias("src_table"), F.min("table_idx").alias("src_idx")))
    other = src.join(cols.select("db_id", F.col("table_idx").alias("oi"), F.col("table_name").alias("ot")).distinct(),
                     "db_id").where(F.col("oi") != F.col("src_idx"))
    other = _rank(other, "h3t", F.col("oi"), by=["example_id", "clause", "depth", "pos", "field"]).where(
        F.col("_r") == 1).drop("_r")
    repl = other.join(cols.select("db_id", F.col("table_idx").alias("oi"), F.col("column_name").alias("repl"),
                                  F.col("column_idx").alias("ci")), ["db_id", "oi"])
    repl = _rank(repl, "h3c", F.col("ci"), by=["example_id", "clause", "depth", "pos", "field"]).where(
        F.col("_r") == 1).drop("_r")
    ok = repl.where(norm(F.col("repl")) != norm(F.col("name")))
    pick = _chosen(_rank(ok, "h3", _ref_key()), "h3")
    info = pick.select("example_id", F.format_string(
        "Replaced column '%s' (from %s) with '%s' (from %s)", F.col("name"), F.col("src_table"),
        F.col("repl"), F.col("ot")).alias("description"))
    return _result(_set_ref(parts, pick, F.col("repl")), info, "attribute_mismatch")


def _table_refs(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("clause").isin("from", "join") | ((F.col("clause") == "where") & (F.col("depth") == 1)))


def _swap_table(parts: DataFrame, db_tables: DataFrame, salt: str, error_type: str, wording: str) -> DataFrame:
    refs = _table_refs(parts)
    nt = db_tables.groupBy("db_id").count().where(F.col("count") >= 2)
    t = _rank(refs.join(nt.select("db_id"), "db_id", "left_semi"), salt, _key(F.col("clause"), F.col("depth"),
                                                                             F.col("pos"))).where(F.col("_r") == 1).drop("_r")
    cand = t.join(db_tables.select("db_id", F.col("table_name").alias("repl")), "db_id").where(
        norm(F.col("repl")) != norm(F.col("tbl")))
    pick = _chosen(_rank(cand, salt + "r", F.col("repl")), salt)
    info = pick.select("example_id", F.format_string(wording, F.col("tbl"), F.col("repl")).alias("description"))
    return _result(_replace(parts, pick.withColumn("tbl", F.col("repl")), {"tbl": F.col("tbl")}), info, error_type)


def table_redundancy(parts: DataFrame, db_tables: DataFrame) -> DataFrame:
    """H4: one table reference becomes another real table of the database."""
    return _swap_table(parts, db_tables, "h4", "table_redundancy",
                       "Replaced table '%s' with unrelated schema table '%s'")


def table_mismatch(parts: DataFrame, db_tables: DataFrame) -> DataFrame:
    """H6: the same action as H4 with its own label and wording."""
    return _swap_table(parts, db_tables, "h6", "table_mismatch", "Replaced table '%s' with different table '%s'")


def table_missing(parts: DataFrame) -> DataFrame:
    """H5: drop one top-level join."""
    j = parts.where((F.col("clause") == "join") & (F.col("depth") == 0))
    t = _rank(j, "h5", F.col("pos")).where(F.col("_r") == 1)
    info = t.select("example_id", F.format_string("Removed JOIN on table '%s'", F.col("tbl")).alias("description"))
    return _result(_drop(parts, t), info, "table_missing")


def function_error(parts: DataFrame) -> DataFrame:
    """H7: rename one function call to an unsupported function; a query with
    no call instead gets one column reference wrapped in such a function."""
    fn_pick = F.element_at(F.array(*[F.lit(x) for x in INVALID_FUNCTIONS]),
                           (F.pmod(draw(F.col("example_id"), F.lit("h7f")), F.lit(len(INVALID_FUNCTIONS))) + 1).cast("int"))
    calls = parts.where(F.col("func").isNotNull())
    t1 = _rank(calls, "h7", _key(F.col("clause"), F.col("depth"), F.col("pos"))).where(F.col("_r") == 1).drop("_r")
    t1 = t1.withColumn("newf", fn_pick)
    info1 = t1.select("example_id", F.format_string("Replaced function '%s' with invalid '%s'",
                                                    F.upper("func"), F.col("newf")).alias("description"))
    r1 = _result(_replace(parts, t1.withColumn("func", F.col("newf")), {"func": F.col("func")}), info1, "function_error")
    no_call = parts.join(calls.select("example_id").distinct(), "example_id", "left_anti")
    refs = no_call.where(F.col("col").isNotNull() & F.col("clause").isin("select", "join", "where", "group", "order"))
    t2 = _rank(refs, "h7w", _key(F.col("clause"), F.col("depth"), F.col("pos"))).where(F.col("_r") == 1).drop("_r")
    t2 = t2.withColumn("newf", fn_pick)
    info2 = t2.select("example_id", F.format_string("Wrapped column '%s' in invalid function '%s'",
                                                    F.col("col"), F.col("newf")).alias("description"))
    r2 = _result(_replace(parts, t2.withColumn("func", F.col("newf")), {"func": F.col("func")}), info2, "function_error")
    return r1.unionByName(r2)


def value_error(parts: DataFrame) -> DataFrame:
    """H8: one literal of the WHERE clause: text -> 'WRONG_VALUE_12345';
    number -> the text 'not_a_number'."""
    lits = parts.where((F.col("clause") == "where") & F.col("val_type").isin("string", "number"))
    t = _rank(lits, "h8", _key(F.col("depth"), F.col("pos"))).where(F.col("_r") == 1).drop("_r")
    is_s = F.col("val_type") == "string"
    t = t.withColumn("nv", F.when(is_s, F.lit("WRONG_VALUE_12345")).otherwise(F.lit("not_a_number"))).withColumn(
        "nt", F.lit("string"))
    desc = F.when(is_s, F.format_string("Replaced string literal '%s' with 'WRONG_VALUE_12345'", F.col("val"))).otherwise(
        F.format_string("Replaced numeric literal %s with string 'not_a_number'", F.col("val")))
    info = t.select("example_id", desc.alias("description"))
    ch = _replace(parts, t.withColumn("val", F.col("nv")).withColumn("val_type", F.col("nt")),
                  {"val": F.col("val"), "val_type": F.col("val_type")})
    return _result(ch, info, "value_error")


def condition_error(parts: DataFrame) -> DataFrame:
    """H9: the first operator kind present in the fixed order = > < >= <= !=
    is swapped on one comparison of that kind."""
    order = F.create_map(*[x for k, (a, _) in enumerate(OPERATOR_SWAPS) for x in (F.lit(a), F.lit(k))])
    swap = F.create_map(*[x for a, b in OPERATOR_SWAPS for x in (F.lit(a), F.lit(b))])
    names = F.create_map(*[x for a, n in OP_NAMES.items() for x in (F.lit(a), F.lit(n))])
    cmp_ = parts.where((F.col("clause") == "where") & F.col("op").isin([a for a, _ in OPERATOR_SWAPS])).withColumn(
        "k", order[F.col("op")])
    first = cmp_.groupBy("example_id").agg(F.min("k").alias("k"))
    t = _rank(cmp_.join(first, ["example_id", "k"]), "h9", _key(F.col("depth"), F.col("pos"))).where(F.col("_r") == 1)
    t = t.withColumn("nop", swap[F.col("op")])
    info = t.select("example_id", F.format_string("Swapped operator %s -> %s", names[F.col("op")],
                                                  names[F.col("nop")]).alias("description"))
    return _result(_replace(parts, t.withColumn("op", F.col("nop")), {"op": F.col("op")}), info, "condition_error")


def condition_missing(parts: DataFrame) -> DataFrame:
    """Needs a WHERE at any depth; drops the top-level WHERE with the
    nested conditions that hang from it.  A query whose only WHERE is nested
    in another clause keeps all its parts."""
    wh = parts.where(F.col("clause") == "where")
    ex = wh.select("example_id").distinct()
    top = wh.where(F.col("depth") == 0).select("example_id").distinct()
    t = wh.join(top, "example_id", "left_semi").select(*PART_KEY)
    info = ex.select("example_id", F.lit("Removed WHERE clause entirely").alias("description"))
    return _result(_drop(parts, t), info, "condition_missing")


def clause_error(parts: DataFrame) -> DataFrame:
    """Drop the top-level GROUP BY, else ORDER BY, else LIMIT."""
    rank = F.when(F.col("clause") == "group", 0).when(F.col("clause") == "order", 1).when(F.col("clause") == "limit", 2)
    c = parts.where(F.col("clause").isin("group", "order", "limit") & (F.col("depth") == 0)).withColumn("k", rank)
    first = c.groupBy("example_id").agg(F.min("k").alias("k"))
    t = c.join(first, ["example_id", "k"])
    name = F.when(F.col("k") == 0, "GROUP BY").when(F.col("k") == 1, "ORDER BY").otherwise("LIMIT")
    info = t.select("example_id", F.format_string("Removed %s clause", name).alias("description")).distinct()
    return _result(_drop(parts, t), info, "clause_error")


def modifier_error(parts: DataFrame) -> DataFrame:
    """Flip the direction of one ORDER BY item; with no ORDER BY, toggle
    DISTINCT."""
    o = parts.where(F.col("clause") == "order")
    t = _rank(o, "h12", F.col("pos")).where(F.col("_r") == 1)
    t = t.withColumn("nd", ~F.coalesce("is_desc", F.lit(False)))
    info1 = t.select("example_id", F.when(F.col("nd"), "Changed ASC to DESC in ORDER BY")
                     .otherwise("Changed DESC to ASC in ORDER BY").alias("description"))
    r1 = _result(_replace(parts, t.withColumn("is_desc", F.col("nd")), {"is_desc": F.col("is_desc")}),
                 info1, "modifier_error")
    rest = parts.join(o.select("example_id").distinct(), "example_id", "left_anti")
    dist = rest.where(F.col("clause") == "distinct").select(*PART_KEY)
    has = rest.select("example_id").distinct().join(dist.select("example_id").distinct().withColumn("d", F.lit(True)),
                                                    "example_id", "left")
    removed = _drop(rest, dist)
    add = (has.where(F.col("d").isNull()).join(rest.where(F.col("clause") == "from").select("example_id", "db_id"),
                                               "example_id")
           .select("example_id", "db_id", F.lit(0).alias("depth"), F.lit("distinct").alias("clause"),
                   F.lit(0).cast("bigint").alias("pos"), *[F.lit(None).cast(t).alias(c) for c, t in
                                                           [("func", "string"), ("tbl", "string"), ("col", "string"),
                                                            ("op", "string"), ("val", "string"),
                                                            ("val_type", "string"), ("is_desc", "boolean")]]))
    added = rest.join(add.select("example_id"), "example_id", "left_semi").unionByName(add)
    info2 = has.select("example_id", F.when(F.col("d"), "Removed DISTINCT modifier").otherwise(
        "Added DISTINCT modifier").alias("description"))
    r2 = _result(removed.unionByName(added), info2, "modifier_error")
    return r1.unionByName(r2)


# ---------------------------------------------------------------- rendering

def _col_expr(s) -> Column:
    return F.when(s["func"].isNull(), s["col"]).otherwise(F.concat(F.upper(s["func"]), F.lit("("), s["col"], F.lit(")")))


def _lit(s) -> Column:
    return F.when(s["val_type"] == "string", F.concat(F.lit("'"), s["val"], F.lit("'"))).otherwise(s["val"])


def render_sql(changes: DataFrame, parts_col: str = "parts") -> DataFrame:
    """Rebuild SQL text from a parts array (per row, no shuffle):
    SELECT [DISTINCT] items FROM t [JOIN ..] [WHERE ..] [GROUP BY ..]
    [ORDER BY .. [DESC]] [LIMIT n]."""
    p = F.array_sort(F.col(parts_col), lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1)
                     .otherwise(0))

    def of(clause, depth=0):
        return F.filter(p, lambda s: (s["clause"] == clause) & (s["depth"] == depth))

    items = F.array_join(F.transform(of("select"), _col_expr), ", ")
    distinct = F.when(F.size(of("distinct")) > 0, F.lit("DISTINCT ")).otherwise(F.lit(""))
    frm = F.coalesce(F.element_at(of("from"), 1)["tbl"], F.lit(""))
    joins = F.array_join(F.transform(of("join"), lambda s: F.concat(
        F.lit(" JOIN "), s["tbl"], F.lit(" ON "), s["col"], F.lit(" = "), s["val"])), "")
    nested = of("where", 1)
    nested_where = F.array_join(F.transform(nested, lambda s: F.concat(_col_expr(s), F.lit(" "), s["op"], F.lit(" "),
                                                                        _lit(s))), " AND ")
    nested_tbl = F.coalesce(F.element_at(nested, 1)["tbl"], F.lit("customer"))
    sub = F.concat(F.lit(" IN (SELECT c_custkey FROM "), nested_tbl,
                   F.when(F.size(nested) > 0, F.concat(F.lit(" WHERE "), nested_where)).otherwise(F.lit("")), F.lit(")"))
    conds = F.transform(of("where"), lambda s: F.when(s["op"] == "in", F.concat(_col_expr(s), sub)).otherwise(
        F.concat(_col_expr(s), F.lit(" "), s["op"], F.lit(" "), _lit(s))))
    where = F.when(F.size(conds) > 0, F.concat(F.lit(" WHERE "), F.array_join(conds, " AND "))).otherwise(F.lit(""))
    grp = F.when(F.size(of("group")) > 0, F.concat(F.lit(" GROUP BY "), _col_expr(F.element_at(of("group"), 1)))) \
        .otherwise(F.lit(""))
    ordr = F.when(F.size(of("order")) > 0, F.concat(F.lit(" ORDER BY "), F.array_join(F.transform(
        of("order"), lambda s: F.concat(_col_expr(s), F.when(s["is_desc"], F.lit(" DESC")).otherwise(F.lit("")))), ", "))) \
        .otherwise(F.lit(""))
    lim = F.when(F.size(of("limit")) > 0, F.concat(F.lit(" LIMIT "), F.element_at(of("limit"), 1)["val"])) \
        .otherwise(F.lit(""))
    sql = F.concat(F.lit("SELECT "), distinct, items, F.lit(" FROM "), frm, joins, where, grp, ordr, lim)
    return changes.withColumn("sql", sql)


def gold_queries(parts: DataFrame) -> DataFrame:
    """Rendered original query of every example: (example_id, sql)."""
    g = parts.groupBy("example_id").agg(F.collect_list(F.struct(*PART_COLS)).alias("parts"))
    return render_sql(g).select("example_id", "sql")


# ---------------------------------------------------------------- H13-H15, H20, H21

def weighted_choice(keys: DataFrame, id_col: str, salt: str, weights: dict, out: str) -> DataFrame:
    """One weighted choice per row: the draw in (0, 1) falls into the
    cumulative-weight range of the chosen key (fixed, ordered weight table)."""
    total = float(sum(weights.values()))
    u = uniform(F.col(id_col), F.lit(salt)) * F.lit(total)
    expr, acc = None, 0.0
    for k, w in weights.items():
        acc += w
        cond = u <= F.lit(acc)
        expr = F.when(cond, F.lit(k)) if expr is None else expr.when(cond, F.lit(k))
    last = list(weights)[-1]
    return keys.withColumn(out, expr.otherwise(F.lit(last)))


def weighted_sample(rows: DataFrame, id_col: str, n_col: str, salt: str, weights: dict = TYPE_WEIGHTS) -> DataFrame:
    """``n`` distinct types per row, weighted, without replacement:
    exponential keys ``-ln(u)/w`` and the ``n`` smallest (same distribution
    as sequential draws).  Returns rows x chosen types (type, slot)."""
    types = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(float(w)).alias("w")) for t, w in weights.items()])
    e = rows.select("*", F.explode(types).alias("tw"))
    key = -F.log(uniform(_key(F.col(id_col), F.col("tw.t")), F.lit(salt))) / F.col("tw.w")
    w = Window.partitionBy(id_col).orderBy(key, F.col("tw.t"))
    r = e.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= F.col(n_col))
    return r.select(*rows.columns, F.col("tw.t").alias("error_type"), "slot")


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """Sample counts by method, by validation status and by (exploded)
    error type.  Returns (dimension, value, n)."""
    m = corpus.groupBy(F.lit("method").alias("dimension"), F.col("synthesis_method").alias("value")).count()
    s = corpus.groupBy(F.lit("status").alias("dimension"), F.col("validation_status").alias("value")).count()
    t = corpus.select(F.explode("error_types").alias("value")).groupBy(
        F.lit("error_type").alias("dimension"), "value").count()
    return m.unionByName(s).unionByName(t).withColumnRenamed("count", "n")


def limit_examples(examples: DataFrame, n: int, id_col: str = "example_id") -> DataFrame:
    """H21, gold side: the first ``n`` examples in id order (a distributed
    top-n; all when n < 0)."""
    return examples if n < 0 else examples.orderBy(id_col).limit(n)


def limit_predictions(predictions: DataFrame, n: int, idx_col: str = "example_id") -> DataFrame:
    """H21, prediction side: predictions whose positional index is below
    ``n`` (all when n < 0)."""
    return predictions if n < 0 else predictions.where(F.col(idx_col) < n)
