"""Registered queries for corpus synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.operators import synth as H
from errata.plans.names_plans import duck_norm
from errata.plans.registry import query
from errata.schemas import COUNT_WEIGHTS, TYPE_WEIGHTS
from errata.sources import workload as W
from errata.sources.fixtures import workload

COLS = ", ".join(H.PART_COLS)


def ctx(spark: SparkSession, sf_dir: str):
    w = workload(spark, sf_dir)
    ct, cc = w.catalog_table(), w.catalog_column()
    dbc = (cc.where(F.col("column_idx") >= 1).join(ct, ["db_id", "table_idx"])
           .select("db_id", "table_idx", "table_name", "column_idx", "column_name"))
    return w, w.query_part(), dbc, ct.select("db_id", "table_name")


def _out(df: DataFrame) -> DataFrame:
    return H.render_sql(df).select("example_id", "error_type", "description", "sql")


# ---- DuckDB pieces -----------------------------------------------------------

def du(key: str, salt: str) -> str:
    return f"CAST(('0x' || substr(md5('42|' || {key} || '|' || '{salt}'), 1, 8)) AS BIGINT)"


def k(*exprs: str) -> str:
    return "concat_ws(':', " + ", ".join(f"CAST({e} AS VARCHAR)" for e in exprs) + ")"


def rank(key: str, salt: str, by: str = "example_id") -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {du(k('example_id', key), salt)}, {key})"


def col_expr(a: str = "") -> str:
    return f"CASE WHEN {a}func IS NULL THEN {a}col ELSE upper({a}func) || '(' || {a}col || ')' END"


def lit(a: str = "") -> str:
    return f"CASE WHEN {a}val_type = 'string' THEN '''' || {a}val || '''' ELSE {a}val END"


def render(cp: str) -> str:
    """DuckDB rendering of changed parts ``cp`` -> (example_id, sql)."""
    return f"""
nest AS (SELECT example_id, arg_min(tbl, pos) AS ntbl,
                string_agg({col_expr()} || ' ' || op || ' ' || {lit()}, ' AND ' ORDER BY pos) AS nw
         FROM {cp} WHERE clause = 'where' AND depth = 1 GROUP BY example_id),
ctext AS (SELECT c.*, CASE WHEN c.op = 'in' THEN {col_expr('c.')} || ' IN (SELECT c_custkey FROM '
                   || coalesce(n.ntbl, 'customer') || CASE WHEN n.nw IS NOT NULL THEN ' WHERE ' || n.nw ELSE '' END || ')'
                   ELSE {col_expr('c.')} || ' ' || c.op || ' ' || {lit('c.')} END AS ct
          FROM {cp} c LEFT JOIN nest n ON n.example_id = c.example_id),
rendered AS (
  SELECT example_id, 'SELECT '
    || CASE WHEN count(*) FILTER (WHERE clause = 'distinct' AND depth = 0) > 0 THEN 'DISTINCT ' ELSE '' END
    || coalesce(string_agg({col_expr()}, ', ' ORDER BY pos) FILTER (WHERE clause = 'select' AND depth = 0), '')
    || ' FROM ' || coalesce(arg_min(tbl, pos) FILTER (WHERE clause = 'from' AND depth = 0), '')
    || coalesce(string_agg(' JOIN ' || tbl || ' ON ' || col || ' = ' || val, '' ORDER BY pos)
                FILTER (WHERE clause = 'join' AND depth = 0), '')
    || coalesce(' WHERE ' || string_agg(ct, ' AND ' ORDER BY pos) FILTER (WHERE clause = 'where' AND depth = 0), '')
    || coalesce(' GROUP BY ' || arg_min({col_expr()}, pos) FILTER (WHERE clause = 'group' AND depth = 0), '')
    || coalesce(' ORDER BY ' || string_agg({col_expr()} || CASE WHEN is_desc THEN ' DESC' ELSE '' END, ', ' ORDER BY pos)
                FILTER (WHERE clause = 'order' AND depth = 0), '')
    || coalesce(' LIMIT ' || arg_min(val, pos) FILTER (WHERE clause = 'limit' AND depth = 0), '') AS sql
  FROM ctext GROUP BY example_id)"""


def base(d: W.Dialect) -> str:
    return f"qp AS ({W.query_part_sql(d)})"


def finish(d: W.Dialect, cp_body: str, info_body: str, error_type: str, extra: str = "") -> str:
    """``cp_body``: the changed parts of touched examples; ``info_body``:
    (example_id, description)."""
    return f"""WITH {base(d)}{extra},
info AS ({info_body}),
cp AS ({cp_body}),{render('cp')}
SELECT info.example_id, '{error_type}' AS error_type, info.description, rendered.sql
FROM info JOIN rendered ON rendered.example_id = info.example_id"""


def _replace_sql(target: str, field_sets: dict[str, str]) -> str:
    sets = ", ".join(
        f"CASE WHEN t.example_id IS NOT NULL THEN {v} ELSE q.{f} END AS {f}" for f, v in field_sets.items())
    keep = ", ".join(f"q.{c}" for c in H.PART_COLS if c not in field_sets)
    return f"""SELECT {keep}, {sets} FROM qp q JOIN (SELECT DISTINCT example_id FROM {target}) e ON e.example_id = q.example_id
LEFT JOIN {target} t ON t.example_id = q.example_id AND t.clause = q.clause AND t.depth = q.depth AND t.pos = q.pos"""


def _drop_sql(target: str) -> str:
    return f"""SELECT q.* FROM qp q JOIN (SELECT DISTINCT example_id FROM {target}) e ON e.example_id = q.example_id
WHERE NOT EXISTS (SELECT 1 FROM {target} t WHERE t.example_id = q.example_id AND t.clause = q.clause
                  AND t.depth = q.depth AND t.pos = q.pos)"""


# ---- H2 ----------------------------------------------------------------------

def oracle_h2(d: W.Dialect) -> str:
    extra = f""",
tgt AS (SELECT * FROM (SELECT s.*, {rank('s.pos', 'h2')} AS r FROM qp s
        WHERE s.clause = 'select' AND s.example_id IN
          (SELECT example_id FROM qp WHERE clause = 'select' GROUP BY example_id HAVING count(*) >= 2)) x WHERE r = 1)"""
    return finish(d, _drop_sql("tgt"), f"SELECT example_id, 'Removed SELECT expression: ' || {col_expr()} AS description FROM tgt",
                  "attribute_missing", extra)


@query("perturb_attribute_missing", oracle_h2)
def q_h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = workload(spark, sf_dir).query_part()
    return _out(H.attribute_missing(parts))


# ---- H5 ----------------------------------------------------------------------

def oracle_h5(d: W.Dialect) -> str:
    extra = f""",
tgt AS (SELECT * FROM (SELECT s.*, {rank('s.pos', 'h5')} AS r FROM qp s WHERE s.clause = 'join' AND s.depth = 0) x WHERE r = 1)"""
    return finish(d, _drop_sql("tgt"), "SELECT example_id, 'Removed JOIN on table ''' || tbl || '''' AS description FROM tgt",
                  "table_missing", extra)


@query("perturb_table_missing", oracle_h5)
def q_h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = workload(spark, sf_dir).query_part()
    return _out(H.table_missing(parts))


# ---- H8 ----------------------------------------------------------------------

def oracle_h8(d: W.Dialect) -> str:
    extra = f""",
tgt AS (SELECT * FROM (SELECT s.*, {rank(k('s.depth', 's.pos'), 'h8')} AS r FROM qp s
        WHERE s.clause = 'where' AND s.val_type IN ('string', 'number')) x WHERE r = 1)"""
    info = """SELECT example_id, CASE WHEN val_type = 'string'
      THEN 'Replaced string literal ''' || val || ''' with ''WRONG_VALUE_12345'''
      ELSE 'Replaced numeric literal ' || val || ' with string ''not_a_number''' END AS description FROM tgt"""
    cp = _replace_sql("tgt", {"val": "CASE WHEN t.val_type = 'string' THEN 'WRONG_VALUE_12345' ELSE 'not_a_number' END",
                              "val_type": "'string'"})
    return finish(d, cp, info, "value_error", extra)


@query("perturb_value", oracle_h8)
def q_h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = workload(spark, sf_dir).query_part()
    return _out(H.value_error(parts))


# ---- H9 ----------------------------------------------------------------------

def oracle_h9(d: W.Dialect) -> str:
    order = " ".join(f"WHEN '{a}' THEN {i}" for i, (a, _) in enumerate(H.OPERATOR_SWAPS))
    swap = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in H.OPERATOR_SWAPS)
    names = lambda x: "CASE " + x + " " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in H.OP_NAMES.items()) + " END"
    extra = f""",
cm AS (SELECT s.*, CASE s.op {order} END AS kk FROM qp s WHERE s.clause = 'where' AND s.op IN ('=', '>', '<', '>=', '<=', '!=')),
fk AS (SELECT example_id, min(kk) AS kk FROM cm GROUP BY example_id),
tgt AS (SELECT * FROM (SELECT cm.*, {rank(k('cm.depth', 'cm.pos'), 'h9')} AS r FROM cm JOIN fk USING (example_id, kk)) x WHERE r = 1)"""
    info = f"SELECT example_id, 'Swapped operator ' || {names('op')} || ' -> ' || {names(f'CASE op {swap} END')} AS description FROM tgt"
    return finish(d, _replace_sql("tgt", {"op": f"CASE t.op {swap} END"}), info, "condition_error", extra)


@query("perturb_condition", oracle_h9)
def q_h9(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = workload(spark, sf_dir).query_part()
    return _out(H.condition_error(parts))


# ---- H10 ---------------------------------------------------------------------

def oracle_h10(d: W.Dialect) -> str:
    extra = """,
tgt AS (SELECT * FROM qp WHERE clause = 'where' AND example_id IN (SELECT example_id FROM qp WHERE clause = 'where' AND depth = 0))"""
    return finish(d, _drop_sql("tgt"), "SELECT DISTINCT example_id, 'Removed WHERE clause entirely' AS description FROM qp WHERE clause = 'where'",
                  "condition_missing", extra)


@query("perturb_condition_missing", oracle_h10)
def q_h10(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = workload(spark, sf_dir).query_part()
    return _out(H.condition_missing(parts))


# ---- H11 ---------------------------------------------------------------------

def oracle_h11(d: W.Dialect) -> str:
    extra = """,
c AS (SELECT q.*, CASE clause WHEN 'group' THEN 0 WHEN 'order' THEN 1 ELSE 2 END AS kk FROM qp q
      WHERE clause IN ('group', 'order', 'limit') AND depth = 0),
tgt AS (SELECT c.* FROM c JOIN (SELECT example_id, min(kk) AS kk FROM c GROUP BY example_id) m USING (example_id, kk))"""
    info = """SELECT DISTINCT example_id, 'Removed ' || CASE kk WHEN 0 THEN 'GROUP BY' WHEN 1 THEN 'ORDER BY' ELSE 'LIMIT' END
      || ' clause' AS description FROM tgt"""
    return finish(d, _drop_sql("tgt"), info, "clause_error", extra)


@query("perturb_clause", oracle_h11)
def q_h11(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = workload(spark, sf_dir).query_part()
    return _out(H.clause_error(parts))


# ---- H12 ---------------------------------------------------------------------

def oracle_h12(d: W.Dialect) -> str:
    return f"""WITH {base(d)},
tgt AS (SELECT * FROM (SELECT s.*, {rank('s.pos', 'h12')} AS r FROM qp s WHERE s.clause = 'order') x WHERE r = 1),
rest AS (SELECT * FROM qp WHERE example_id NOT IN (SELECT example_id FROM qp WHERE clause = 'order')),
hasd AS (SELECT DISTINCT example_id FROM rest WHERE clause = 'distinct'),
cp1 AS ({_replace_sql('tgt', {'is_desc': 'NOT coalesce(t.is_desc, FALSE)'})}),
cp2 AS (SELECT * FROM rest WHERE NOT (clause = 'distinct')
        UNION ALL
        SELECT example_id, db_id, 0, 'distinct', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM rest
        WHERE clause = 'from' AND example_id NOT IN (SELECT example_id FROM hasd)),
cp AS (SELECT {COLS} FROM cp1 UNION ALL SELECT {COLS} FROM cp2),
info AS (SELECT example_id, CASE WHEN NOT coalesce(is_desc, FALSE) THEN 'Changed ASC to DESC in ORDER BY'
                 ELSE 'Changed DESC to ASC in ORDER BY' END AS description FROM tgt
         UNION ALL
         SELECT DISTINCT example_id, CASE WHEN example_id IN (SELECT example_id FROM hasd) THEN 'Removed DISTINCT modifier'
                 ELSE 'Added DISTINCT modifier' END FROM rest),{render('cp')}
SELECT info.example_id, 'modifier_error' AS error_type, info.description, rendered.sql
FROM info JOIN rendered ON rendered.example_id = info.example_id"""


@query("perturb_modifier", oracle_h12)
def q_h12(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = workload(spark, sf_dir).query_part()
    return _out(H.modifier_error(parts))


# ---- H7 ----------------------------------------------------------------------

def oracle_h7(d: W.Dialect) -> str:
    fn = "CASE " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(H.INVALID_FUNCTIONS)) + " END"
    pick = f"(CASE ({du('CAST(example_id AS VARCHAR)', 'h7f')} % {len(H.INVALID_FUNCTIONS)}) " + \
        " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(H.INVALID_FUNCTIONS)) + " END)"
    del fn
    return f"""WITH {base(d)},
calls AS (SELECT * FROM qp WHERE func IS NOT NULL),
t1 AS (SELECT * FROM (SELECT c.*, {rank(k('c.clause', 'c.depth', 'c.pos'), 'h7')} AS r FROM calls c) x WHERE r = 1),
refs AS (SELECT * FROM qp WHERE example_id NOT IN (SELECT example_id FROM calls) AND col IS NOT NULL
         AND clause IN ('select', 'join', 'where', 'group', 'order')),
t2 AS (SELECT * FROM (SELECT c.*, {rank(k('c.clause', 'c.depth', 'c.pos'), 'h7w')} AS r FROM refs c) x WHERE r = 1),
tgt AS (SELECT *, {pick} AS newf FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) u),
cp AS ({_replace_sql('tgt', {'func': 't.newf'})}),
info AS (SELECT example_id, CASE WHEN func IS NOT NULL
           THEN 'Replaced function ''' || upper(func) || ''' with invalid ''' || newf || ''''
           ELSE 'Wrapped column ''' || col || ''' in invalid function ''' || newf || '''' END AS description FROM tgt),
{render('cp')[1:]}
SELECT info.example_id, 'function_error' AS error_type, info.description, rendered.sql
FROM info JOIN rendered ON rendered.example_id = info.example_id"""


@query("perturb_function", oracle_h7)
def q_h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = workload(spark, sf_dir).query_part()
    return _out(H.function_error(parts))


# ---- H4 / H6 -------------------------------------------------------------------

def _oracle_swap_table(d: W.Dialect, salt: str, error_type: str, wording: str) -> str:
    w = wording.replace("'", "''").replace("%s", "{}")
    a, b = w.split("{}")[0], w.split("{}")[1]
    c = w.split("{}")[2]
    return f"""WITH {base(d)},
ct AS ({W.catalog_table_sql(d)}),
nt AS (SELECT db_id FROM ct GROUP BY db_id HAVING count(*) >= 2),
refs AS (SELECT * FROM qp WHERE (clause IN ('from', 'join') OR (clause = 'where' AND depth = 1)) AND db_id IN (SELECT db_id FROM nt)),
t AS (SELECT * FROM (SELECT s.*, {rank(k('s.clause', 's.depth', 's.pos'), salt)} AS r FROM refs s) x WHERE r = 1),
cand AS (SELECT t.* EXCLUDE (r), ct.table_name AS repl FROM t JOIN ct ON ct.db_id = t.db_id
         WHERE {duck_norm('ct.table_name')} <> {duck_norm('t.tbl')}),
tgt AS (SELECT * FROM (SELECT c.*, {rank('c.repl', salt + 'r')} AS r FROM cand c) x WHERE r = 1),
cp AS ({_replace_sql('tgt', {'tbl': 't.repl'})}),
info AS (SELECT example_id, '{a}' || tbl || '{b}' || repl || '{c}' AS description FROM tgt),
{render('cp')[1:]}
SELECT info.example_id, '{error_type}' AS error_type, info.description, rendered.sql
FROM info JOIN rendered ON rendered.example_id = info.example_id"""


@query("perturb_table_redundancy", lambda d: _oracle_swap_table(
    d, "h4", "table_redundancy", "Replaced table '%s' with unrelated schema table '%s'"))
def q_h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parts, _, dbt = ctx(spark, sf_dir)
    return _out(H.table_redundancy(parts, dbt))


@query("perturb_table_mismatch", lambda d: _oracle_swap_table(
    d, "h6", "table_mismatch", "Replaced table '%s' with different table '%s'"))
def q_h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parts, _, dbt = ctx(spark, sf_dir)
    return _out(H.table_mismatch(parts, dbt))


# ---- H1 / H3 ---------------------------------------------------------------------

def _duck_refs() -> str:
    return """refs AS (SELECT example_id, clause, depth, pos, 'col' AS field, col AS name, db_id FROM qp WHERE col IS NOT NULL
          UNION ALL SELECT example_id, clause, depth, pos, 'val', val, db_id FROM qp WHERE clause = 'join' AND val IS NOT NULL)"""


def _set_ref_sql() -> str:
    return """SELECT q.example_id, q.db_id, q.depth, q.clause, q.pos, q.func, q.tbl,
       CASE WHEN t.field = 'col' THEN t.repl ELSE q.col END AS col, q.op,
       CASE WHEN t.field = 'val' THEN t.repl ELSE q.val END AS val, q.val_type, q.is_desc
FROM qp q JOIN (SELECT DISTINCT example_id FROM tgt) e ON e.example_id = q.example_id
LEFT JOIN tgt t ON t.example_id = q.example_id AND t.clause = q.clause AND t.depth = q.depth AND t.pos = q.pos"""


def oracle_h1(d: W.Dialect) -> str:
    return f"""WITH {base(d)},
ct AS ({W.catalog_table_sql(d)}), cc AS ({W.catalog_column_sql(d)}),
dbc AS (SELECT cc.db_id, cc.column_name FROM cc JOIN ct ON ct.db_id = cc.db_id AND ct.table_idx = cc.table_idx WHERE cc.column_idx >= 1),
{_duck_refs()},
t AS (SELECT * FROM (SELECT s.*, {rank(k('s.clause', 's.depth', 's.pos', 's.field'), 'h1')} AS r FROM refs s) x WHERE r = 1),
cand AS (SELECT t.* EXCLUDE (r), dbc.column_name AS repl FROM t JOIN dbc ON dbc.db_id = t.db_id
         WHERE {duck_norm('dbc.column_name')} <> {duck_norm('t.name')}),
tgt AS (SELECT * FROM (SELECT c.*, {rank('c.repl', 'h1r')} AS r FROM cand c) x WHERE r = 1),
cp AS ({_set_ref_sql()}),
info AS (SELECT example_id, 'Replaced column ''' || name || ''' with unrelated schema column ''' || repl || '''' AS description FROM tgt),
{render('cp')[1:]}
SELECT info.example_id, 'attribute_redundancy' AS error_type, info.description, rendered.sql
FROM info JOIN rendered ON rendered.example_id = info.example_id"""


@query("perturb_attribute_redundancy", oracle_h1)
def q_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parts, dbc, _ = ctx(spark, sf_dir)
    return _out(H.attribute_redundancy(parts, dbc))


def oracle_h3(d: W.Dialect) -> str:
    by = "example_id, clause, depth, pos, field"
    return f"""WITH {base(d)},
ct AS ({W.catalog_table_sql(d)}), cc AS ({W.catalog_column_sql(d)}),
cols AS (SELECT cc.db_id, cc.table_idx, ct.table_name, cc.column_idx, cc.column_name FROM cc
         JOIN ct ON ct.db_id = cc.db_id AND ct.table_idx = cc.table_idx WHERE cc.column_idx >= 1),
nt AS (SELECT db_id FROM cols GROUP BY db_id HAVING count(DISTINCT table_idx) >= 2),
{_duck_refs()},
src AS (SELECT r.example_id, r.clause, r.depth, r.pos, r.field, r.name, r.db_id,
               arg_min(c.table_name, c.table_idx) AS src_table, min(c.table_idx) AS src_idx
        FROM refs r JOIN cols c ON c.db_id = r.db_id AND {duck_norm('c.column_name')} = {duck_norm('r.name')}
        WHERE r.db_id IN (SELECT db_id FROM nt) GROUP BY ALL),
oth AS (SELECT * FROM (SELECT s.*, o.oi, o.ot, {rank('o.oi', 'h3t', by)} AS r FROM src s
        JOIN (SELECT DISTINCT db_id, table_idx AS oi, table_name AS ot FROM cols) o ON o.db_id = s.db_id AND o.oi <> s.src_idx) x
        WHERE r = 1),
rep AS (SELECT * FROM (SELECT o.* EXCLUDE (r), c.column_name AS repl, {rank('c.column_idx', 'h3c', by)} AS r
        FROM oth o JOIN cols c ON c.db_id = o.db_id AND c.table_idx = o.oi) x WHERE r = 1),
ok AS (SELECT * EXCLUDE (r) FROM rep WHERE {duck_norm('repl')} <> {duck_norm('name')}),
tgt AS (SELECT * FROM (SELECT s.*, {rank(k('s.clause', 's.depth', 's.pos', 's.field'), 'h3')} AS r FROM ok s) x WHERE r = 1),
cp AS ({_set_ref_sql()}),
info AS (SELECT example_id, 'Replaced column ''' || name || ''' (from ' || src_table || ') with ''' || repl || ''' (from ' || ot || ')'
         AS description FROM tgt),
{render('cp')[1:]}
SELECT info.example_id, 'attribute_mismatch' AS error_type, info.description, rendered.sql
FROM info JOIN rendered ON rendered.example_id = info.example_id"""


@query("perturb_attribute_mismatch", oracle_h3)
def q_h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, parts, dbc, _ = ctx(spark, sf_dir)
    return _out(H.attribute_mismatch(parts, dbc))


# ---- gold rendering, H13, H14, H20, H21 --------------------------------------------

def oracle_render(d: W.Dialect) -> str:
    return f"""WITH {base(d)},
cp AS (SELECT * FROM qp),{render('cp')}
SELECT example_id, sql FROM rendered"""


@query("render_sql", oracle_render)
def q_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = workload(spark, sf_dir).query_part()
    return H.gold_queries(parts)


def _duck_weighted(id_expr: str, salt: str, weights: dict) -> str:
    total = float(sum(weights.values()))
    u = f"((({du(f'CAST({id_expr} AS VARCHAR)', salt)}) + 1) / 4294967297.0 * {total})"
    acc, whens = 0.0, []
    for key, w in weights.items():
        acc += w
        whens.append(f"WHEN {u} <= {acc} THEN '{key}'")
    return f"CASE {' '.join(whens)} ELSE '{list(weights)[-1]}' END"


def oracle_weighted_choice(d: W.Dialect) -> str:
    cw = {str(kk): v for kk, v in COUNT_WEIGHTS.items()}
    return f"""SELECT example_id, CAST({_duck_weighted('example_id', 'count', cw)} AS INT) AS n_errors,
       {_duck_weighted('example_id', 'type', {kk: float(v) for kk, v in TYPE_WEIGHTS.items()})} AS single_type
FROM ({W.example_sql(d)}) e"""


@query("weighted_choice", oracle_weighted_choice)
def q_weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = workload(spark, sf_dir).example().select("example_id")
    r = H.weighted_choice(ex, "example_id", "count", {str(kk): v for kk, v in COUNT_WEIGHTS.items()}, "n_errors")
    r = H.weighted_choice(r, "example_id", "type", {kk: float(v) for kk, v in TYPE_WEIGHTS.items()}, "single_type")
    return r.select("example_id", F.col("n_errors").cast("int").alias("n_errors"), "single_type")


def oracle_weighted_sample(d: W.Dialect) -> str:
    cw = {str(kk): v for kk, v in COUNT_WEIGHTS.items()}
    types = " UNION ALL ".join(f"SELECT '{t}' AS t, {float(w)} AS w" for t, w in TYPE_WEIGHTS.items())
    key = f"-ln(({du(k('e.example_id', 'tw.t'), 'sample')} + 1) / 4294967297.0) / tw.w"
    return f"""WITH e AS (SELECT example_id, CAST({_duck_weighted('example_id', 'count', cw)} AS INT) AS n_errors
                FROM ({W.example_sql(d)}) x),
tw AS ({types}),
s AS (SELECT e.example_id, e.n_errors, tw.t, row_number() OVER (PARTITION BY e.example_id ORDER BY {key}, tw.t) AS slot
      FROM e, tw)
SELECT example_id, n_errors, t AS error_type, CAST(slot AS INT) AS slot FROM s WHERE slot <= n_errors"""


@query("weighted_sample", oracle_weighted_sample)
def q_weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = workload(spark, sf_dir).example().select("example_id")
    r = H.weighted_choice(ex, "example_id", "count", {str(kk): v for kk, v in COUNT_WEIGHTS.items()}, "n")
    r = r.select("example_id", F.col("n").cast("int").alias("n_errors"))
    s = H.weighted_sample(r, "example_id", "n_errors", "sample")
    return s.select("example_id", "n_errors", "error_type", F.col("slot").cast("int").alias("slot"))


def oracle_limit(d: W.Dialect) -> str:
    return f"SELECT example_id, question FROM ({W.example_sql(d)}) e ORDER BY example_id LIMIT 500"


@query("limit_examples", oracle_limit)
def q_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 500 gold examples (the head is the feature)."""
    ex = workload(spark, sf_dir).example().select("example_id", "question")
    return H.limit_examples(ex, 500)
