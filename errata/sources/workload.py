"""Derivation of the engine's canonical input tables from the driver's test
tables (orders, customer, nation, events, embeddings, ...).

These builders only give rows in the schemas the operators expect; they do
none of an operator's work.  Each derived table is one SQL statement written in
the subset shared by Spark SQL and DuckDB; the few spots where the dialects
differ (md5 draw, ordered string aggregation, array literal, row sequence,
table reference) go through :class:`Dialect`.  The same text therefore feeds
the Spark jobs and the DuckDB oracle, while each operator is implemented
independently on each side.
"""

from __future__ import annotations

from dataclasses import dataclass

# The test tables and their order inside every catalog.
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Key relations of the test schema (from table.column -> to table.column).
FOREIGN_KEYS = [
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]
# Primary keys: the first column of every table, plus the second key column of
# the two tables with a composite key.
EXTRA_PK = [("lineitem", "l_linenumber"), ("conversations", "turn")]

# Columns a generated query may select, in pool order, with their tables.
SELECT_POOL = [
    ("orders", "o_orderkey"), ("orders", "o_orderstatus"), ("orders", "o_totalprice"),
    ("orders", "o_orderdate"), ("orders", "o_orderpriority"),
    ("customer", "c_name"), ("customer", "c_mktsegment"), ("customer", "c_acctbal"),
    ("nation", "n_name"),
]


@dataclass(frozen=True)
class Dialect:
    name: str  # "spark" or "duckdb"
    sf_dir: str = ""

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def t(self, table: str) -> str:
        if self.spark:
            return f"parquet.`{self.sf_dir}/{table}.parquet`"
        return table

    def u(self, id_expr: str, salt_expr: str) -> str:
        key = f"('42' || '|' || CAST({id_expr} AS STRING) || '|' || {salt_expr})"
        if self.spark:
            return f"CAST(conv(substr(md5({key}), 1, 8), 16, 10) AS BIGINT)"
        return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"

    def arr(self, *exprs: str) -> str:
        inner = ", ".join(exprs)
        return f"array({inner})" if self.spark else f"list_value({inner})"

    def agg(self, expr: str, order: str, sep: str) -> str:
        if self.spark:
            return f"listagg({expr}, '{sep}') WITHIN GROUP (ORDER BY {order})"
        return f"string_agg({expr}, '{sep}' ORDER BY {order})"

    def seq(self, n: int) -> str:
        """A one-column relation ``i`` holding 0..n-1."""
        if self.spark:
            return f"(SELECT CAST(id AS BIGINT) AS i FROM range({n}))"
        return f"(SELECT CAST(range AS BIGINT) AS i FROM range({n}))"

    def explode_range(self, n_expr: str) -> str:
        """Select-list generator of 0..n-1 (one row per value)."""
        if self.spark:
            return f"explode(sequence(CAST(0 AS BIGINT), CAST({n_expr} AS BIGINT) - 1))"
        return f"unnest(range(0, CAST({n_expr} AS BIGINT)))"

    def explode_values(self, values: list[str]) -> str:
        """Select-list generator of a fixed list of texts."""
        inner = ", ".join(f"'{v}'" for v in values)
        return f"explode(array({inner}))" if self.spark else f"unnest([{inner}])"

    def collect(self, expr: str) -> str:
        return f"collect_list({expr})" if self.spark else f"list({expr})"

    def pick(self, values: list[str], idx_expr: str) -> str:
        whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
        return f"(CASE {idx_expr} {whens} END)"

    def json_str(self, expr: str) -> str:
        """JSON string of a text expression whose values hold no quote or
        backslash (identifiers and plain literals of the generated queries)."""
        return f"('\"' || {expr} || '\"')"


# ---------------------------------------------------------------- examples

def example_sql(d: Dialect) -> str:
    """example(example_id, db_id, question, evidence, difficulty): one per order;
    the database of an example is its customer's database."""
    return f"""
SELECT o.o_orderkey AS example_id,
       'db' || CAST(o.o_custkey AS STRING) AS db_id,
       'orders of the ' || lower(c.c_mktsegment)
         || (CASE WHEN o.o_orderkey % 2 = 0 THEN 's' ELSE '' END)
         || ' customers in ' || lower(n.n_name) AS question,
       CASE WHEN {d.u('o.o_orderkey', "'ev'")} % 3 = 0 THEN ''
            ELSE 'segment refers to c_mktsegment' END AS evidence,
       CASE o.o_orderstatus WHEN 'F' THEN 'simple' WHEN 'O' THEN 'moderate'
            ELSE 'challenging' END AS difficulty
FROM {d.t('orders')} o
JOIN {d.t('customer')} c ON o.o_custkey = c.c_custkey
JOIN {d.t('nation')} n ON c.c_nationkey = n.n_nationkey
"""


# ---------------------------------------------------------------- evaluation

def eval_spine_sql(d: Dialect) -> str:
    """eval_spine(example_id, difficulty, variant): one evaluated question per
    customer; the variant says which predicted query was written for it."""
    return f"""
SELECT c.c_custkey AS example_id,
       CASE WHEN n.n_regionkey <= 1 THEN 'simple'
            WHEN n.n_regionkey <= 3 THEN 'moderate' ELSE 'challenging' END AS difficulty,
       {d.u('c.c_custkey', "'pred'")} % 4 AS variant
FROM {d.t('customer')} c JOIN {d.t('nation')} n ON c.c_nationkey = n.n_nationkey
"""


# Workload templates: batched queries over a parameter view ``{params}``
# (example_id, variant).  Gold asks for a customer's urgent and high orders;
# predictions: 0 the same, 1 urgent only, 2 the same rows twice, once with the
# key written as a decimal, 3 a misspelt column (fails).
WORKLOAD_TEMPLATES = [
    ("gold", "gold", None,
     "SELECT p.example_id, o.o_orderkey, o.o_orderpriority FROM {params} p "
     "JOIN {orders} o ON o.o_custkey = p.example_id "
     "WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("pred_same", "pred", 0,
     "SELECT p.example_id, o.o_orderkey, o.o_orderpriority FROM {params} p "
     "JOIN {orders} o ON o.o_custkey = p.example_id "
     "WHERE o.o_orderpriority IN ('2-HIGH', '1-URGENT')"),
    ("pred_urgent", "pred", 1,
     "SELECT p.example_id, o.o_orderkey, o.o_orderpriority FROM {params} p "
     "JOIN {orders} o ON o.o_custkey = p.example_id "
     "WHERE o.o_orderpriority = '1-URGENT'"),
    ("pred_dup", "pred", 2,
     "SELECT p.example_id, CAST(o.o_orderkey AS DECIMAL(20, 1)) AS k, o.o_orderpriority FROM {params} p "
     "JOIN {orders} o ON o.o_custkey = p.example_id "
     "WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH') "
     "UNION ALL SELECT p.example_id, o.o_orderkey, o.o_orderpriority FROM {params} p "
     "JOIN {orders} o ON o.o_custkey = p.example_id "
     "WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    ("pred_typo", "pred", 3,
     "SELECT p.example_id, o.o_orderkey, o.o_totalprize FROM {params} p "
     "JOIN {orders} o ON o.o_custkey = p.example_id"),
]


def result_row_sql(d: Dialect) -> str:
    """Oracle-side truth of what the workload templates return:
    result_row(example_id, side, row ARRAY<STRING>) plus failures are the
    examples of variant 3 (no rows)."""
    key = "CAST(o.o_orderkey AS STRING)"
    dbl = "(CAST(o.o_orderkey AS STRING) || '.0')"
    return f"""
SELECT s.example_id, 'gold' AS side, {d.arr(key, 'o.o_orderpriority')} AS row
FROM ({eval_spine_sql(d)}) s JOIN {d.t('orders')} o ON o.o_custkey = s.example_id
WHERE o.o_orderpriority IN ('1-URGENT', '2-HIGH')
UNION ALL
SELECT s.example_id, 'pred' AS side, {d.arr(key, 'o.o_orderpriority')} AS row
FROM ({eval_spine_sql(d)}) s JOIN {d.t('orders')} o ON o.o_custkey = s.example_id
WHERE (s.variant IN (0, 2) AND o.o_orderpriority IN ('1-URGENT', '2-HIGH'))
   OR (s.variant = 1 AND o.o_orderpriority = '1-URGENT')
UNION ALL
SELECT s.example_id, 'pred' AS side, {d.arr(dbl, 'o.o_orderpriority')} AS row
FROM ({eval_spine_sql(d)}) s JOIN {d.t('orders')} o ON o.o_custkey = s.example_id
WHERE s.variant = 2 AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')
"""


# ---------------------------------------------------------------- names and text

PACKAGE_DELIM = "\t----- bird -----\t"


def packed_prediction_sql(d: Dialect) -> str:
    """packed_prediction(example_id, packed): predicted SQL packaged with the
    benchmark delimiter and database; some rows lack the delimiter, some hold
    it twice, some carry surrounding blanks."""
    u = d.u("o.o_orderkey", "'pack'")
    sql = "'SELECT o_orderpriority FROM orders WHERE o_orderkey = ' || CAST(o.o_orderkey AS STRING)"
    delim = "(chr(9) || '----- bird -----' || chr(9))"
    db = "'db' || CAST(o.o_custkey AS STRING)"
    return f"""
SELECT o.o_orderkey AS example_id,
       CASE WHEN {u} % 13 = 0 THEN {sql}
            WHEN {u} % 17 = 0 THEN {sql} || {delim} || {db} || {delim} || 'extra'
            WHEN {u} % 5 = 0 THEN '  ' || {sql} || ' ' || {delim} || ' ' || {db} || chr(10)
            ELSE {sql} || {delim} || {db} END AS packed
FROM {d.t('orders')} o
"""


def identifier_sql(d: Dialect) -> str:
    """identifier(ident_id, raw): column names of the generated queries as
    users write them (quoted, upper case, spaced, hyphenated, tabbed, NULL)."""
    u = d.u("q.example_id * 10 + q.pos", "'ident'")
    spaced = "replace(q.col, '_', ' ')"
    return f"""
SELECT q.example_id * 10 + q.pos AS ident_id,
       CASE {u} % 6 WHEN 0 THEN q.col
            WHEN 1 THEN '`' || upper(q.col) || '`'
            WHEN 2 THEN '"' || q.col || '"'
            WHEN 3 THEN chr(9) || upper({spaced}) || chr(10)
            WHEN 4 THEN replace(q.col, '_', '-')
            ELSE NULL END AS raw
FROM ({query_part_sql(d)}) q WHERE q.clause = 'select'
"""


def decorated_column_sql(d: Dialect) -> str:
    """decorated_column(db_id, column_idx, table_name, column_name, type):
    catalog columns under the naming habits of real databases (spaces, units
    in parentheses, hyphens, hashes, slashes, sized types)."""
    u = d.u("c.db_id || '.' || CAST(c.column_idx AS STRING)", "'deco'")
    return f"""
SELECT c.db_id, c.column_idx, upper(substr(t.table_name, 1, 1)) || substr(t.table_name, 2) || CASE WHEN {u} % 4 = 0 THEN ' Info' ELSE '' END AS table_name,
       CASE {u} % 7 WHEN 0 THEN c.label
            WHEN 1 THEN c.label || ' (%)'
            WHEN 2 THEN replace(c.column_name, '_', '-')
            WHEN 3 THEN c.column_name || '_1-2-3'
            WHEN 4 THEN '#' || c.column_name
            WHEN 5 THEN '_' || c.label || ' / total_'
            ELSE upper(c.column_name) || '--x' END AS column_name,
       CASE {u} % 3 WHEN 0 THEN c.type || '(' || CAST({u} % 50 + 1 AS STRING) || ')'
            WHEN 1 THEN c.type ELSE 'DECIMAL(10, 2)' END AS type
FROM ({catalog_column_sql(d)}) c JOIN ({catalog_table_sql(d)}) t
  ON t.db_id = c.db_id AND t.table_idx = c.table_idx
"""


# The twelve error labels, in taxonomy order.
ERROR_LABELS = [
    "attribute_mismatch", "attribute_redundancy", "attribute_missing",
    "table_mismatch", "table_redundancy", "table_missing",
    "value_error", "condition_missing", "condition_error",
    "function_error", "clause_error", "modifier_error",
]


def raw_labels_sql(d: Dialect) -> str:
    """raw_label(example_id, pos, label): error-type names as a model writes
    them (upper case, spaces, hyphens, padding, unknown names)."""
    pick = d.pick(ERROR_LABELS, f"({d.u('s.o_orderkey * 4 + s.i', chr(39) + 'lab' + chr(39))} % 12)")
    v = f"{d.u('s.o_orderkey * 4 + s.i', chr(39) + 'labv' + chr(39))} % 6"
    n = f"(1 + {d.u('o.o_orderkey', chr(39) + 'labn' + chr(39))} % 3)"
    return f"""
SELECT s.example_id, s.i AS pos,
       CASE {v} WHEN 0 THEN {pick}
            WHEN 1 THEN upper({pick})
            WHEN 2 THEN ' ' || replace({pick}, '_', ' ') || ' '
            WHEN 3 THEN replace({pick}, '_', '-')
            WHEN 4 THEN 'syntax_error'
            ELSE upper(substr({pick}, 1, 1)) || substr(replace({pick}, '_', ' '), 2) END AS label
FROM (SELECT o.o_orderkey, o.o_orderkey AS example_id, {d.explode_range(n)} AS i
      FROM {d.t('orders')} o) s
"""


def file_name_sql(d: Dialect) -> str:
    """file_name(file_id, name): output-file names of tree and prediction dumps."""
    u = d.u("c.c_custkey", "'fname'")
    return f"""
SELECT c.c_custkey AS file_id,
       CASE {u} % 4 WHEN 0 THEN 'ast_Dev_' || CAST(c.c_custkey AS STRING) || '.json'
            WHEN 1 THEN 'bird_TRAIN-' || lower(c.c_mktsegment) || '.json'
            WHEN 2 THEN 'predict_dev_train.json'
            ELSE 'test_' || lower(c.c_mktsegment) || '.json' END AS name
FROM {d.t('customer')} c
"""


def literal_value_sql(d: Dialect) -> str:
    """literal_value(lit_id, text): literal texts as written in queries."""
    u = d.u("l.l_orderkey * 8 + l.l_linenumber", "'lit'")
    return f"""
SELECT l.l_orderkey * 8 + l.l_linenumber AS lit_id,
       CASE {u} % 6 WHEN 0 THEN CAST(l.l_partkey AS STRING)
            WHEN 1 THEN '-' || CAST(l.l_suppkey AS STRING)
            WHEN 2 THEN CAST(l.l_quantity AS STRING)
            WHEN 3 THEN l.l_returnflag || l.l_linestatus
            WHEN 4 THEN CAST(l.l_linenumber AS STRING) || 'e3'
            ELSE '-' END AS text
FROM {d.t('lineitem')} l
"""


# ---------------------------------------------------------------- query parts

def _qp_base(d: Dialect) -> str:
    i = "o.o_orderkey"
    return f"""
SELECT o.o_orderkey AS example_id, 'db' || CAST(o.o_custkey AS STRING) AS db_id,
       o.o_custkey, o.o_orderstatus, o.o_totalprice,
       1 + {d.u(i, "'nsel'")} % 3 AS n_sel,
       {d.u(i, "'njoin'")} % 3 AS n_join,
       1 + {d.u(i, "'nwhere'")} % 2 AS n_where,
       ({d.u(i, "'nest'")} % 11 = 0) AS has_nest,
       ({d.u(i, "'grp'")} % 4 = 0) AS has_group,
       ({d.u(i, "'ord'")} % 3 = 0) AS has_order,
       ({d.u(i, "'lim'")} % 5 = 0) AS has_limit,
       ({d.u(i, "'dst'")} % 7 = 0) AS has_distinct,
       {d.u(i, "'w1'")} AS u_w1,
       {d.u(i, "'ordc'")} AS u_ordc,
       {d.u(i, "'limv'")} AS u_limv
FROM {d.t('orders')} o
"""


def query_part_sql(d: Dialect) -> str:
    """query_part(example_id, db_id, depth, clause, pos, func, tbl, col, op, val,
    val_type, is_desc): the parts of one generated query per example."""
    pool_cols = [c for _, c in SELECT_POOL]
    pool_tbls = [t for t, _ in SELECT_POOL]
    pool_n = "(CASE b.n_join WHEN 0 THEN 5 WHEN 1 THEN 8 ELSE 9 END)"
    sel_idx = f"({d.u('b.example_id', chr(39) + 'sel' + chr(39) + ' || CAST(s.i AS STRING)')} % {pool_n})"
    fn_idx = f"({d.u('b.example_id', chr(39) + 'fn' + chr(39) + ' || CAST(s.i AS STRING)')} % 8)"
    ord_idx = f"(b.u_ordc % {pool_n})"
    cols = "example_id, db_id, depth, clause, pos, func, tbl, col, op, val, val_type, is_desc"
    return f"""
WITH b AS ({_qp_base(d)}),
sel0 AS (SELECT b.example_id, b.db_id, {d.explode_range('b.n_sel')} AS i FROM b),
sel AS (
  SELECT b.example_id, b.db_id, s.i, {sel_idx} AS k, {fn_idx} AS f
  FROM b JOIN sel0 s ON s.example_id = b.example_id
)
SELECT {cols} FROM (
  SELECT sel.example_id, sel.db_id, 0 AS depth, 'select' AS clause, sel.i AS pos,
         {d.pick(['count', 'max', 'min', 'lower', 'year'], 'sel.f')} AS func,
         {d.pick(pool_tbls, 'sel.k')} AS tbl, {d.pick(pool_cols, 'sel.k')} AS col,
         CAST(NULL AS STRING) AS op, CAST(NULL AS STRING) AS val,
         CAST(NULL AS STRING) AS val_type, CAST(NULL AS BOOLEAN) AS is_desc
  FROM sel
  UNION ALL
  SELECT b.example_id, b.db_id, 0, 'from', 0, NULL, 'orders', NULL, NULL, NULL, NULL, NULL FROM b
  UNION ALL
  SELECT b.example_id, b.db_id, 0, 'join', 0, NULL, 'customer', 'o_custkey', '=', 'c_custkey',
         'column', NULL FROM b WHERE b.n_join >= 1
  UNION ALL
  SELECT b.example_id, b.db_id, 0, 'join', 1, NULL, 'nation', 'c_nationkey', '=', 'n_nationkey',
         'column', NULL FROM b WHERE b.n_join >= 2
  UNION ALL
  SELECT b.example_id, b.db_id, 0, 'where', 0, NULL, 'orders', 'o_custkey', '=',
         CAST(b.o_custkey AS STRING), 'number', NULL FROM b
  UNION ALL
  SELECT b.example_id, b.db_id, 0, 'where', 1, NULL, 'orders',
         CASE WHEN b.u_w1 % 2 = 0 THEN 'o_orderstatus' ELSE 'o_totalprice' END,
         CASE WHEN b.u_w1 % 2 = 0 THEN '='
              ELSE {d.pick(['>', '<', '>=', '<=', '!='], '(b.u_w1 % 5)')} END,
         CASE WHEN b.u_w1 % 2 = 0 THEN b.o_orderstatus
              ELSE CAST(CAST(floor(b.o_totalprice) AS BIGINT) AS STRING) END,
         CASE WHEN b.u_w1 % 2 = 0 THEN 'string' ELSE 'number' END, NULL
  FROM b WHERE b.n_where >= 2
  UNION ALL
  SELECT b.example_id, b.db_id, 0, 'where', b.n_where, NULL, 'orders', 'o_custkey', 'in',
         NULL, 'subquery', NULL FROM b WHERE b.has_nest
  UNION ALL
  SELECT b.example_id, b.db_id, 1, 'where', 0, NULL, 'customer', 'c_acctbal', '>', '0',
         'number', NULL FROM b WHERE b.has_nest
  UNION ALL
  SELECT sel.example_id, sel.db_id, 0, 'group', 0, NULL,
         {d.pick(pool_tbls, 'sel.k')}, {d.pick(pool_cols, 'sel.k')}, NULL, NULL, NULL, NULL
  FROM sel JOIN b ON b.example_id = sel.example_id WHERE b.has_group AND sel.i = 0
  UNION ALL
  SELECT b.example_id, b.db_id, 0, 'order', 0, NULL,
         {d.pick(pool_tbls, ord_idx)}, {d.pick(pool_cols, ord_idx)}, NULL, NULL, NULL,
         (b.u_ordc % 2 = 1) FROM b WHERE b.has_order
  UNION ALL
  SELECT b.example_id, b.db_id, 0, 'limit', 0, NULL, NULL, NULL, NULL,
         CAST(1 + b.u_limv % 10 AS STRING), 'number', NULL FROM b WHERE b.has_limit
  UNION ALL
  SELECT b.example_id, b.db_id, 0, 'distinct', 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM b WHERE b.has_distinct
) parts
"""


# Node type of each comparison operator in a tree (fixed by the tree format).
OP_NODE = {"=": "eq", ">": "gt", "<": "lt", ">=": "gte", "<=": "lte", "!=": "neq", "in": "in"}


def _op_node(expr: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OP_NODE.items())
    return f"(CASE {expr} {whens} END)"


TREE_STAGES = ["slot", "wh", "cond", "nested"]


def tree_stage_sql(d: Dialect, stage: str, r: dict[str, str]) -> str:
    """One stage of the tree-node derivation; ``r`` maps earlier stage names
    (``qp`` and the entries of TREE_STAGES) to relation references."""
    if stage == "slot":
        return f"""
SELECT t.*, CAST(ROW_NUMBER() OVER (PARTITION BY t.example_id ORDER BY t.rnk, t.pos) - 1 AS STRING) AS p
FROM (SELECT q.*,
             CASE q.clause WHEN 'select' THEN 0 WHEN 'from' THEN 1 WHEN 'join' THEN 2
                  WHEN 'where' THEN 3 WHEN 'group' THEN 4 WHEN 'order' THEN 5
                  WHEN 'limit' THEN 6 ELSE 7 END AS rnk
      FROM {r['qp']} q WHERE q.depth = 0 AND NOT (q.clause = 'where' AND q.pos > 0)) t
"""
    if stage == "wh":
        return f"""
SELECT s.example_id, s.p AS wp, COUNT(*) AS m
FROM {r['slot']} s JOIN {r['qp']} q ON q.example_id = s.example_id AND q.clause = 'where' AND q.depth = 0
WHERE s.clause = 'where' GROUP BY s.example_id, s.p
"""
    if stage == "cond":
        return f"""
SELECT q.*, w.m,
       CASE WHEN w.m = 1 THEN w.wp || '.0'
            WHEN w.m = 2 THEN w.wp || '.0.' || CAST(q.pos AS STRING)
            WHEN q.pos < 2 THEN w.wp || '.0.0.' || CAST(q.pos AS STRING)
            ELSE w.wp || '.0.1' END AS cp
FROM {r['qp']} q JOIN {r['wh']} w ON w.example_id = q.example_id
WHERE q.clause = 'where' AND q.depth = 0
"""
    if stage == "nested":
        return f"""
SELECT c.example_id, c.cp, q.col, q.op, q.val, q.val_type
FROM {r['cond']} c JOIN {r['qp']} q ON q.example_id = c.example_id AND q.depth = 1
WHERE c.op = 'in'
"""
    slot, wh, cond, nested = r["slot"], r["wh"], r["cond"], r["nested"]
    return f"""
SELECT example_id, path,
       CASE WHEN path = '' THEN 0 ELSE length(path) - length(replace(path, '.', '')) + 1 END AS depth,
       node_type, name, value, value_type
FROM (
  SELECT example_id, '' AS path, 'select' AS node_type, CAST(NULL AS STRING) AS name,
         CAST(NULL AS STRING) AS value, CAST(NULL AS STRING) AS value_type
  FROM {slot} WHERE clause = 'from'
  UNION ALL
  SELECT example_id, p,
         CASE WHEN func IS NULL THEN 'column' WHEN func IN ('lower', 'year') THEN 'func' ELSE func END,
         CASE WHEN func IS NULL THEN col WHEN func IN ('lower', 'year') THEN upper(func) ELSE NULL END,
         NULL, NULL
  FROM {slot} WHERE clause = 'select'
  UNION ALL
  SELECT example_id, p || '.0', 'column', col, NULL, NULL FROM {slot}
  WHERE clause = 'select' AND func IS NOT NULL
  UNION ALL
  SELECT example_id, p, 'from', NULL, NULL, NULL FROM {slot} WHERE clause = 'from'
  UNION ALL
  SELECT example_id, p || '.0', 'table', tbl, NULL, NULL FROM {slot} WHERE clause IN ('from', 'join')
  UNION ALL
  SELECT example_id, p, 'join', NULL, NULL, NULL FROM {slot} WHERE clause = 'join'
  UNION ALL
  SELECT example_id, p || '.1', 'eq', NULL, NULL, NULL FROM {slot} WHERE clause = 'join'
  UNION ALL
  SELECT example_id, p || '.1.0', 'column', col, NULL, NULL FROM {slot} WHERE clause = 'join'
  UNION ALL
  SELECT example_id, p || '.1.1', 'column', val, NULL, NULL FROM {slot} WHERE clause = 'join'
  UNION ALL
  SELECT example_id, p, 'where', NULL, NULL, NULL FROM {slot} WHERE clause = 'where'
  UNION ALL
  SELECT example_id, wp || '.0', 'and', NULL, NULL, NULL FROM {wh} WHERE m >= 2
  UNION ALL
  SELECT example_id, wp || '.0.0', 'and', NULL, NULL, NULL FROM {wh} WHERE m = 3
  UNION ALL
  SELECT example_id, cp, {_op_node('op')}, NULL, NULL, NULL FROM {cond}
  UNION ALL
  SELECT example_id, cp || '.0', 'column', col, NULL, NULL FROM {cond}
  UNION ALL
  SELECT example_id, cp || '.1', 'literal', NULL, val, val_type FROM {cond} WHERE op <> 'in'
  UNION ALL
  SELECT example_id, cp || '.1', 'subquery', NULL, NULL, NULL FROM {nested}
  UNION ALL
  SELECT example_id, cp || '.1.0', 'select', NULL, NULL, NULL FROM {nested}
  UNION ALL
  SELECT example_id, cp || '.1.0.0', 'column', 'c_custkey', NULL, NULL FROM {nested}
  UNION ALL
  SELECT example_id, cp || '.1.0.1', 'from', NULL, NULL, NULL FROM {nested}
  UNION ALL
  SELECT example_id, cp || '.1.0.1.0', 'table', 'customer', NULL, NULL FROM {nested}
  UNION ALL
  SELECT example_id, cp || '.1.0.2', 'where', NULL, NULL, NULL FROM {nested}
  UNION ALL
  SELECT example_id, cp || '.1.0.2.0', {_op_node('op')}, NULL, NULL, NULL FROM {nested}
  UNION ALL
  SELECT example_id, cp || '.1.0.2.0.0', 'column', col, NULL, NULL FROM {nested}
  UNION ALL
  SELECT example_id, cp || '.1.0.2.0.1', 'literal', NULL, val, val_type FROM {nested}
  UNION ALL
  SELECT example_id, p, 'group', NULL, NULL, NULL FROM {slot} WHERE clause = 'group'
  UNION ALL
  SELECT example_id, p || '.0', 'column', col, NULL, NULL FROM {slot} WHERE clause = 'group'
  UNION ALL
  SELECT example_id, p, 'order', NULL, NULL, NULL FROM {slot} WHERE clause = 'order'
  UNION ALL
  SELECT example_id, p || '.0', 'ordered', NULL, NULL, NULL FROM {slot} WHERE clause = 'order'
  UNION ALL
  SELECT example_id, p || '.0.0', 'column', col, NULL, NULL FROM {slot} WHERE clause = 'order'
  UNION ALL
  SELECT example_id, p, 'limit', NULL, NULL, NULL FROM {slot} WHERE clause = 'limit'
  UNION ALL
  SELECT example_id, p || '.0', 'literal', NULL, val, 'number' FROM {slot} WHERE clause = 'limit'
  UNION ALL
  SELECT example_id, p, 'distinct', NULL, NULL, NULL FROM {slot} WHERE clause = 'distinct'
) nodes
"""


def tree_node_sql(d: Dialect) -> str:
    """tree_node(example_id, path STRING, depth, node_type, name, value,
    value_type): preorder node list of each example's query tree, with the
    dot-joined child-position path.  This is the truth the tree JSON is built
    from (DuckDB form: all stages as CTEs)."""
    r = {"qp": "qp", **{k: k for k in TREE_STAGES}}
    ctes = [f"qp AS ({query_part_sql(d)})"] + [
        f"{k} AS ({tree_stage_sql(d, k, r)})" for k in TREE_STAGES]
    return "WITH " + ",\n".join(ctes) + "\n" + tree_stage_sql(d, "nodes", r)


MAX_TREE_DEPTH = 8


def node_head_json(d: Dialect, a: str) -> str:
    """JSON text of a node's own fields (without children), for alias prefix ``a``."""
    return ("('{\"node_type\":' || " + d.json_str(f"{a}node_type")
            + f" || CASE WHEN {a}name IS NULL THEN '' ELSE ',\"name\":' || " + d.json_str(f"{a}name") + " END"
            + f" || CASE WHEN {a}value_type IS NULL THEN '' WHEN {a}value_type = 'number' "
              f"THEN ',\"value\":' || {a}value ELSE ',\"value\":' || " + d.json_str(f"{a}value") + " END"
            + f" || CASE WHEN {a}value_type IS NULL THEN '' ELSE ',\"value_type\":' || "
            + d.json_str(f"{a}value_type") + " END)")


#: Fields of a query part that a tree shows.
TREE_PART_COLS = ["clause", "depth", "pos", "func", "tbl", "col", "op", "val", "val_type"]


def tree_parts_odd_sql() -> str:
    """Spark expression over an example's ``parts`` (TREE_PART_COLS): whether
    two share a place, or the from, condition or nested parts are not as many
    as ``tree_parts_json_sql`` has places for."""
    def many(cond: str) -> str:
        return f"size(filter(parts, q -> {cond}))"

    return f"""(size(array_distinct(transform(parts, q -> struct(q.clause, q.depth, q.pos)))) < size(parts)
        OR {many("q.clause = 'from' AND q.depth = 0")} <> 1 OR {many("q.clause = 'where' AND q.depth = 0")} > 3 OR {many('q.depth = 1')} > 1)"""


def tree_parts_json_sql(d: Dialect) -> str:
    """Spark expression over an example's ``parts``: the text that nesting the
    nodes of ``tree_stage_sql`` gives where every part has a place of its own."""
    def node(kind: str, *kids: str, name: str = "NULL", value: str = "NULL", value_type: str = "NULL") -> str:
        head = f"{d.json_str(kind)}"
        if name != "NULL":
            head += f" || CASE WHEN {name} IS NULL THEN '' ELSE ',\"name\":' || {d.json_str(name)} END"
        if value_type != "NULL":
            head += (f" || CASE WHEN {value_type} IS NULL THEN '' WHEN {value_type} = 'number' THEN ',\"value\":' || {value} ELSE ',\"value\":' || {d.json_str(value)} END"
                     f" || CASE WHEN {value_type} IS NULL THEN '' ELSE ',\"value_type\":' || {d.json_str(value_type)} END")
        # a node whose text is null is left out, as the aggregate over a node's children does
        below = kids[0] if len(kids) == 1 and kids[0].startswith("transform") else f"array({', '.join(kids)})"
        inside = f"array_join({below}, ',')" if kids else "''"
        return f"('{{\"node_type\":' || {head} || ',\"children\":[' || {inside} || ']}}')"

    column = lambda name: node("'column'", name=name)
    literal = lambda x: node("'literal'", value=f"{x}.val", value_type=f"{x}.val_type")
    nested = node("'subquery'", node("'select'", column("'c_custkey'"), node("'from'", node("'table'", name="'customer'")),
                                     node("'where'", node(_op_node("r.op"), column("r.col"), literal("r")))))
    inner = f"get(transform(filter(parts, r -> r.depth = 1), r -> {nested}), 0)"
    cond = node(_op_node("q.op"), column("q.col"), f"CASE WHEN q.op <> 'in' THEN {literal('q')} WHEN q.op = 'in' THEN {inner} END")
    conds = lambda cond_of: f"transform(filter(wheres, q -> {cond_of}), q -> {cond})"
    where = f"""CASE size(wheres) WHEN 1 THEN {node("'where'", conds('true'))} WHEN 2 THEN {node("'where'", node("'and'", conds('true')))}
        ELSE {node("'where'", node("'and'", node("'and'", conds('q.pos < 2')), f"array_join({conds('q.pos >= 2')}, ',')"))} END"""
    # the conditions, in order, are computed once a row
    where = f"""transform(array(array_sort(filter(parts, q -> q.clause = 'where' AND q.depth = 0), (x, y) -> CAST(x.pos - y.pos AS INT))), wheres -> {where})[0]"""
    func = "s.func IN ('lower', 'year')"
    select = f"""CASE WHEN s.func IS NULL THEN {column('s.col')}
        ELSE {node(f"CASE WHEN {func} THEN 'func' ELSE s.func END", column('s.col'), name=f"CASE WHEN {func} THEN upper(s.func) END")} END"""
    slot = f"""CASE s.clause WHEN 'select' THEN {select}
        WHEN 'from' THEN {node("'from'", node("'table'", name='s.tbl'))}
        WHEN 'join' THEN {node("'join'", node("'table'", name='s.tbl'), node("'eq'", column('s.col'), column('s.val')))}
        WHEN 'where' THEN {where}
        WHEN 'group' THEN {node("'group'", column('s.col'))}
        WHEN 'order' THEN {node("'order'", node("'ordered'", column('s.col')))}
        WHEN 'limit' THEN {node("'limit'", node("'literal'", value='s.val', value_type="'number'"))}
        WHEN 'distinct' THEN {node("'distinct'")} END"""
    rank = " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(["select", "from", "join", "where", "group", "order", "limit"]))
    slots = f"""array_sort(transform(filter(parts, s -> s.depth = 0 AND NOT (s.clause = 'where' AND s.pos > 0)),
        s -> named_struct('rnk', CASE s.clause {rank} ELSE 7 END, 'pos', s.pos, 'js', {slot})))"""
    return node("'select'", f"transform({slots}, x -> x.js)")


def tree_json_sql(d: Dialect) -> str:
    """tree(example_id, tree_json): the nested JSON text of each query tree,
    built bottom-up from tree_node (children in position order)."""
    nodes = tree_node_sql(d)
    parent = ("CASE WHEN n.depth <= 1 THEN '' ELSE "
              + ("substring_index(n.path, '.', n.depth - 1)" if d.spark else
                 "array_to_string(string_split(n.path, '.')[1:n.depth - 1], '.')")
              + " END")
    last = ("CAST(substring_index(n.path, '.', -1) AS BIGINT)" if d.spark else
            "CAST(string_split(n.path, '.')[-1] AS BIGINT)")
    head = node_head_json(d, "n.")
    ctes = [f"n0 AS (SELECT n.*, {parent} AS parent, CASE WHEN n.depth = 0 THEN 0 ELSE {last} END AS pos "
            f"FROM ({nodes}) n)"]
    # level MAX: leaves; level k: node text + children of level k+1
    prev = None
    for k in range(MAX_TREE_DEPTH, -1, -1):
        if prev is None:
            body = (f"SELECT n.example_id, n.parent, n.pos, {head} || ',\"children\":[]}}' AS js "
                    f"FROM n0 n WHERE n.depth = {k}")
        else:
            body = (f"SELECT n.example_id, n.parent, n.pos, {head} || ',\"children\":[' "
                    f"|| coalesce(c.kids, '') || ']}}' AS js "
                    f"FROM n0 n LEFT JOIN (SELECT example_id, parent, {d.agg('js', 'pos', ',')} AS kids "
                    f"FROM {prev} GROUP BY example_id, parent) c "
                    f"ON c.example_id = n.example_id AND c.parent = n.path WHERE n.depth = {k}")
        ctes.append(f"j{k} AS ({body})")
        prev = f"j{k}"
    return "WITH " + ",\n".join(ctes) + "\nSELECT example_id, js AS tree_json FROM j0"


# ---------------------------------------------------------------- error log

# One message per execution-error pattern of the six families.
ERROR_MESSAGES = [
    "no such column: {c}",
    "ambiguous column name: {c}",
    "misuse of aliased aggregate {c}",
    "no such table: {t}",
    "no tables specified",
    'near "AND": syntax error',
    "BETWEEN operator requires two values",
    "IN requires a list",
    "datatype mismatch",
    "cannot compare values",
    "invalid literal value",
    "cannot convert text",
    "no such function: {f}",
    "wrong number of arguments to function {f}()",
    "misuse of aggregate function {f}()",
    "misuse of aggregate: {f}()",
    "nested aggregate functions in aggregate not allowed",
    "column must appear in the GROUP BY clause",
    "expression not in GROUP BY",
    "SELECT list expression not in GROUP BY",
    "1st ORDER BY term does not match any column",
    "ORDER BY position 3 not in result",
]


def error_log_sql(d: Dialect) -> str:
    """error_log(log_id, example_id, message): execution errors of predicted
    queries; one row per error event, message chosen by event id."""
    c = "'\"o_total' || CAST(e.user_id AS STRING) || '\"'"
    t = "'`orders_' || CAST(e.user_id AS STRING) || '`'"
    f = "'YEAR' || CAST(e.user_id % 3 AS STRING)"
    whens = []
    for k, m in enumerate(ERROR_MESSAGES):
        parts = []
        rest = m
        for ph, ex in (("{c}", c), ("{t}", t), ("{f}", f)):
            if ph in rest:
                a, b = rest.split(ph)
                expr = f"'{a}' || {ex} || '{b}'"
                break
        else:
            expr = "'" + m.replace("'", "''") + "'"
        whens.append(f"WHEN {k} THEN {expr}")
    return f"""
SELECT e.event_id AS log_id, o.o_orderkey AS example_id,
       CASE e.event_id % {len(ERROR_MESSAGES)} {' '.join(whens)} END AS message
FROM {d.t('events')} e JOIN {d.t('orders')} o ON o.o_orderkey = e.event_id
WHERE e.event_type = 'error'
"""


# ---------------------------------------------------------------- catalogs

def base_columns_sql(d: Dialect) -> str:
    """base_column(table_name, ordinal, column_name, type): the test tables'
    own schemas in a SQLite-like type vocabulary.  On Spark the caller passes
    the snapshot of the tables' schemas (see ``sources.loaders.catalog_snapshot``)
    as view ``base_column_raw``; DuckDB reads its information schema."""
    if d.spark:
        src = "base_column_raw"
    else:
        names = ", ".join(f"'{t}'" for t in TABLES)
        src = (f"(SELECT table_name, CAST(ordinal_position AS BIGINT) AS ordinal, column_name, "
               f"lower(data_type) AS raw_type FROM information_schema.columns "
               f"WHERE table_name IN ({names}))")
    return f"""
SELECT table_name, ordinal, column_name,
       CASE WHEN raw_type IN ('bigint', 'integer', 'int') THEN 'INTEGER'
            WHEN raw_type IN ('varchar', 'string') THEN 'TEXT'
            WHEN raw_type IN ('double', 'float', 'real') THEN 'REAL'
            WHEN raw_type LIKE 'timestamp%' THEN 'DATETIME'
            ELSE 'BLOB' END AS type
FROM {src}
"""


def catalog_table_sql(d: Dialect) -> str:
    """catalog_table(db_id, table_idx, table_name): one database per customer
    holding orders, customer and a drawn subset of the other test tables."""
    ords = " ".join(f"WHEN '{t}' THEN {k}" for k, t in enumerate(TABLES))
    return f"""
WITH tl AS (SELECT c.c_custkey, {d.explode_values(TABLES)} AS table_name FROM {d.t('customer')} c),
inc AS (
  SELECT 'db' || CAST(tl.c_custkey AS STRING) AS db_id, tl.table_name, CASE tl.table_name {ords} END AS ord
  FROM tl
  WHERE tl.table_name IN ('orders', 'customer')
     OR {d.u('tl.c_custkey', 'tl.table_name')} % 4 <> 0
)
SELECT db_id, CAST(ROW_NUMBER() OVER (PARTITION BY db_id ORDER BY ord) - 1 AS BIGINT) AS table_idx,
       table_name
FROM inc
"""


def catalog_column_sql(d: Dialect) -> str:
    """catalog_column(db_id, column_idx, table_idx, column_name, label, type);
    column 0 of every database is ``*`` with table_idx -1."""
    return f"""
WITH ct AS ({catalog_table_sql(d)}),
bc AS ({base_columns_sql(d)}),
cols AS (
  SELECT ct.db_id, ct.table_idx, bc.ordinal, bc.column_name, bc.type
  FROM ct JOIN bc ON bc.table_name = ct.table_name
)
SELECT db_id, CAST(ROW_NUMBER() OVER (PARTITION BY db_id ORDER BY table_idx, ordinal) AS BIGINT) AS column_idx,
       table_idx, column_name, replace(column_name, '_', ' ') AS label, type
FROM cols
UNION ALL
SELECT DISTINCT db_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '*', '*', 'TEXT' FROM ct
"""


def catalog_pk_sql(d: Dialect) -> str:
    """catalog_pk(db_id, column_idx): first column of each table plus the
    second key column of composite keys."""
    extra = " OR ".join(f"(ct.table_name = '{t}' AND cc.column_name = '{c}')" for t, c in EXTRA_PK)
    return f"""
WITH ct AS ({catalog_table_sql(d)}), cc AS ({catalog_column_sql(d)}),
first_col AS (SELECT db_id, table_idx, MIN(column_idx) AS c0 FROM cc WHERE table_idx >= 0
              GROUP BY db_id, table_idx)
SELECT cc.db_id, cc.column_idx
FROM cc JOIN ct ON ct.db_id = cc.db_id AND ct.table_idx = cc.table_idx
JOIN first_col f ON f.db_id = cc.db_id AND f.table_idx = cc.table_idx
WHERE cc.column_idx = f.c0 OR {extra}
"""


def catalog_fk_sql(d: Dialect) -> str:
    """catalog_fk(db_id, from_idx, to_idx): key relations whose two tables are
    both in the database."""
    vals = " UNION ALL ".join(
        f"SELECT '{a}' AS ft, '{b}' AS fc, '{c}' AS tt, '{e}' AS tc" for a, b, c, e in FOREIGN_KEYS)
    return f"""
WITH ct AS ({catalog_table_sql(d)}), cc AS ({catalog_column_sql(d)}),
named AS (SELECT cc.db_id, cc.column_idx, ct.table_name, cc.column_name
          FROM cc JOIN ct ON ct.db_id = cc.db_id AND ct.table_idx = cc.table_idx),
fk AS ({vals})
SELECT a.db_id, a.column_idx AS from_idx, b.column_idx AS to_idx
FROM fk JOIN named a ON a.table_name = fk.ft AND a.column_name = fk.fc
JOIN named b ON b.db_id = a.db_id AND b.table_name = fk.tt AND b.column_name = fk.tc
"""


def column_doc_sql(d: Dialect) -> str:
    """column_doc(db_id, table_name, column_name, description): per-database
    column descriptions, table and column names in varying case, some empty."""
    u = d.u("c.db_id || '.' || CAST(c.column_idx AS STRING)", "'doc'")
    return f"""
SELECT c.db_id,
       CASE WHEN {u} % 3 = 0 THEN upper(t.table_name) ELSE t.table_name END AS table_name,
       CASE WHEN {u} % 4 = 0 THEN upper(c.column_name) ELSE c.column_name END AS column_name,
       CASE WHEN {u} % 5 = 0 THEN '' ELSE 'the ' || c.label || ' of each ' || t.table_name || ' row' END AS description
FROM ({catalog_column_sql(d)}) c JOIN ({catalog_table_sql(d)}) t
  ON t.db_id = c.db_id AND t.table_idx = c.table_idx
"""


def linking_sql(d: Dialect) -> str:
    """linking(example_id, db_id, table_name, columns ARRAY<STRING> or NULL):
    schema-linking output per example - the tables its query touches, with
    the (lower-case) columns used; some lists are NULL, some hold a name the
    catalog lacks."""
    return f"""
WITH q AS (SELECT * FROM ({query_part_sql(d)}) x WHERE tbl IS NOT NULL),
g AS (SELECT example_id, db_id, tbl,
             {d.collect("CASE WHEN col IS NOT NULL AND clause <> 'join' THEN lower(col) END")} AS cols
      FROM q GROUP BY example_id, db_id, tbl)
SELECT g.example_id, g.db_id,
       CASE WHEN {d.u('g.example_id', 'g.tbl')} % 2 = 0 THEN upper(g.tbl) ELSE g.tbl END AS table_name,
       CASE WHEN {d.u('g.example_id', 'g.tbl')} % 7 = 0 THEN NULL
            WHEN {d.u('g.example_id', 'g.tbl')} % 5 = 0 THEN {d.arr("'bogus_col'")}
            ELSE g.cols END AS columns
FROM g
"""


# ---------------------------------------------------------------- completions and labels

def label_sequence_sql(d: Dialect) -> str:
    """label_sequence(seq_id, output): detector outputs - valid ascending token
    lists, repeats, descending pairs, <no_error> with another token, five
    tokens, unknown tokens, lone <no_error>."""
    u = d.u("o.o_orderkey", "'seq'")
    a = f"(1 + {d.u('o.o_orderkey', chr(39) + 'sa' + chr(39))} % 11)"
    b = f"({a} + 1 + {d.u('o.o_orderkey', chr(39) + 'sb' + chr(39))} % (12 - {a}))"
    ta = f"('<error_' || CAST({a} AS STRING) || '>')"
    tb = f"('<error_' || CAST({b} AS STRING) || '>')"
    return f"""
SELECT o.o_orderkey AS seq_id,
       CASE {u} % 7 WHEN 0 THEN {ta} || {tb}
            WHEN 1 THEN {ta} || {ta}
            WHEN 2 THEN {tb} || {ta}
            WHEN 3 THEN '<no_error>' || {ta}
            WHEN 4 THEN '<error_1><error_2><error_3><error_4><error_5>'
            WHEN 5 THEN {ta} || '<error_99>'
            ELSE ' <no_error> ' END AS output
FROM {d.t('orders')} o
"""


def completion_sql(d: Dialect) -> str:
    """completion(request_id, example_id, kind, text): model answers - a sql
    fence, a bare fence, a bare SELECT with a trailing paragraph, invalid JSON,
    valid JSON."""
    u = d.u("o.o_orderkey", "'comp'")
    nl = "chr(10)"
    sql = "'SELECT o_orderpriority FROM orders WHERE o_orderkey = ' || CAST(o.o_orderkey AS STRING)"
    return f"""
SELECT o.o_orderkey AS request_id, o.o_orderkey AS example_id,
       CASE {u} % 5 WHEN 0 THEN 'sql_fence' WHEN 1 THEN 'fence' WHEN 2 THEN 'bare' WHEN 3 THEN 'bad_json'
            ELSE 'json' END AS kind,
       CASE {u} % 5
         WHEN 0 THEN 'Here is the fix:' || {nl} || '```SQL' || {nl} || {sql} || {nl} || '```' || {nl} || 'Done.'
         WHEN 1 THEN '```' || {nl} || '  ' || {sql} || ' ' || {nl} || '```'
         WHEN 2 THEN 'The query is' || {nl} || 'select ' || {sql} || {nl} || 'AND 1 = 1' || {nl} || {nl} || 'It returns the priority.'
         WHEN 3 THEN '{{"error_types": ["value_error", ' || CAST(o.o_orderkey AS STRING)
         ELSE '{{"error_types": [' || CASE WHEN o.o_orderkey % 3 = 0 THEN ''
                                             WHEN o.o_orderkey % 3 = 1 THEN '"Value Error", "condition-error"'
                                             ELSE '"bogus"' END
              || '], "refined_sql": "' || CASE WHEN o.o_orderkey % 4 = 0 THEN '' ELSE {sql} END
              || '", "explanation": "fixed"}}' END AS text
FROM {d.t('orders')} o
"""


SECTION_HEADERS = [
    ("[Question]", "question"), ("[External Knowledge]", "external_knowledge"),
    ("[Question-Schema Structure]", "schema"), ("[Nodes]", "nodes"), ("[Edges]", "edges"),
    ("[Predicted SQL]", "sql"), ("[SQL Abstract Syntax Tree]", "ast"),
    ("[Rule-based Detection Results]", "rule_based"), ("[Execution Results]", "execution"),
]


def section_input_sql(d: Dialect) -> str:
    """section_input(example_id, input): detector inputs with nine bracketed
    sections; some repeat the question section, some carry text before the
    first header."""
    nl = "chr(10)"
    u = d.u("e.example_id", "'sec'")
    return f"""
SELECT e.example_id,
       CASE WHEN {u} % 6 = 0 THEN 'preamble line' || {nl} ELSE '' END
       || '[Question]' || {nl} || e.question || {nl}
       || '[External Knowledge]' || {nl} || e.evidence || {nl}
       || '[Question-Schema Structure]' || {nl}
       || '[Nodes]' || {nl} || 'orders(o_orderkey, o_custkey)' || {nl} || 'customer(c_custkey)' || {nl}
       || '[Edges]' || {nl} || 'orders.o_custkey -> customer.c_custkey' || {nl}
       || '[Predicted SQL]' || {nl} || '  SELECT * FROM orders WHERE o_orderkey = ' || CAST(e.example_id AS STRING) || '  ' || {nl}
       || '[SQL Abstract Syntax Tree]' || {nl} || 'Node[0] | 0 | select | ' || {nl}
       || '[Rule-based Detection Results]' || {nl} || 'none' || {nl}
       || '[Execution Results]' || {nl} || 'rows: ' || CAST({u} % 9 AS STRING)
       || CASE WHEN {u} % 4 = 0 THEN {nl} || '[Question] again: ' || {nl} || 'repeated ' || e.difficulty ELSE '' END
       AS input
FROM ({example_sql(d)}) e
"""


def value_question_sql(d: Dialect) -> str:
    """value_question(example_id, db_id, question): one per order, naming a part
    of its first line and its customer's nation, the part's name as written,
    in the plural, with a letter missing or doubled, possessive, or in capitals."""
    u = d.u("o.o_orderkey", "'vq'")
    return f"""
SELECT o.o_orderkey AS example_id, 'db' || CAST(o.o_custkey AS STRING) AS db_id,
       CASE WHEN {u} % 3 = 0 THEN ' Which ' ELSE 'Who bought ' END
         || CASE {u} % 7 WHEN 0 THEN p.p_name || 's' WHEN 1 THEN substr(p.p_name, 1, 5) || substr(p.p_name, 7)
                 WHEN 2 THEN substr(p.p_name, 1, 4) || substr(p.p_name, 4) WHEN 3 THEN p.p_name || chr(39) || 's'
                 WHEN 4 THEN upper(p.p_name) WHEN 5 THEN replace(p.p_name, ' ', ', ') ELSE p.p_name END
         || CASE WHEN {u} % 2 = 0 THEN ' of type ' || lower(p.p_type) ELSE ' "' || p.p_brand || '"' END
         || ' in ' || lower(n.n_name) || CASE WHEN {u} % 5 = 0 THEN '' ELSE '?' END AS question
FROM {d.t('orders')} o
JOIN (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM {d.t('lineitem')} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
JOIN {d.t('part')} p ON p.p_partkey = l.l_partkey
JOIN {d.t('customer')} c ON c.c_custkey = o.o_custkey
JOIN {d.t('nation')} n ON n.n_nationkey = c.c_nationkey
"""


# ---------------------------------------------------------------- outcomes of changed queries

def run_draw_sql(d: Dialect, sql: str = "m.sql") -> str:
    """How an executed query of example ``m.example_id`` turned out (0 to 5), by
    a draw on its text: 0 fails, 1 and 2 return the original's rows, 3 returns
    them twice, 4 and 5 leave out an order's first line."""
    return d.u(f"m.example_id || ':' || md5({sql})", "'outcome'") + " % 6"


def outcome_row_sql(d: Dialect, made: str, key: str = "example_id") -> str:
    """Executed rows of original and changed queries, ``made`` being (key,
    example_id, sql): (key, side, ok, row ARRAY<STRING>).  The original query of
    an example returns its order's lines, and fails for some examples."""
    row = d.arr("CAST(l.l_linenumber AS STRING)", "CAST(l.l_partkey AS STRING)")
    none = "CAST(NULL AS ARRAY<STRING>)" if d.spark else "CAST(NULL AS VARCHAR[])"
    failed = f"{d.u('m.example_id', chr(39) + 'orig' + chr(39))} % 13 = 0"
    v = run_draw_sql(d)
    lines = f"{made} m JOIN {d.t('lineitem')} l ON l.l_orderkey = m.example_id"
    return f"""
SELECT m.{key}, 'gold' AS side, TRUE AS ok, {row} AS row FROM {lines} WHERE NOT ({failed})
UNION ALL SELECT m.{key}, 'gold', FALSE, {none} FROM {made} m WHERE {failed}
UNION ALL SELECT m.{key}, 'pred', TRUE, {row} FROM {lines} WHERE {v} IN (1, 2, 3) OR ({v} >= 4 AND l.l_linenumber > 1)
UNION ALL SELECT m.{key}, 'pred', TRUE, {row} FROM {lines} WHERE {v} = 3
UNION ALL SELECT m.{key}, 'pred', FALSE, {none} FROM {made} m WHERE {v} = 0
"""


def predicted_part_sql(d: Dialect) -> str:
    """Parts of a predicted query per example: the gold query's without its
    DISTINCT; some predictions have an id that no example has."""
    cols = "db_id, depth, clause, pos, func, tbl, col, op, val, val_type, is_desc"
    extra = f"SELECT -q.example_id AS example_id, {cols} FROM ({query_part_sql(d)}) q WHERE q.example_id % 50 = 0 AND q.clause <> 'distinct'"
    return f"SELECT q.example_id, {cols} FROM ({query_part_sql(d)}) q WHERE q.clause <> 'distinct' UNION ALL {extra}"


def prediction_row_sql(d: Dialect) -> str:
    """Executed rows of gold and predicted queries per example: (example_id,
    side, ok, row); a prediction is right, lacks the first line, is right with
    every row twice, or fails."""
    row = d.arr("CAST(l.l_linenumber AS STRING)", "CAST(l.l_partkey AS STRING)")
    none = "CAST(NULL AS ARRAY<STRING>)" if d.spark else "CAST(NULL AS VARCHAR[])"
    v = d.u("o.o_orderkey", "'predrun'") + " % 4"
    lines = f"{d.t('orders')} o JOIN {d.t('lineitem')} l ON l.l_orderkey = o.o_orderkey"
    return f"""
SELECT o.o_orderkey AS example_id, 'gold' AS side, TRUE AS ok, {row} AS row FROM {lines}
UNION ALL SELECT o.o_orderkey, 'pred', TRUE, {row} FROM {lines} WHERE {v} IN (0, 2) OR ({v} = 1 AND l.l_linenumber > 1)
UNION ALL SELECT o.o_orderkey, 'pred', TRUE, {row} FROM {lines} WHERE {v} = 2
UNION ALL SELECT o.o_orderkey, 'pred', FALSE, {none} FROM {d.t('orders')} o WHERE {v} = 3
"""


def predicted_row_sql(d: Dialect) -> str:
    """Spark form of the predicted side of :func:`prediction_row_sql`
    (example_id, ok, row): orders meet their lines once, and a line comes out as
    often as the prediction returns it."""
    return f"""
SELECT example_id, v <> 3 AS ok, CASE WHEN v <> 3 THEN {d.arr("CAST(l_linenumber AS STRING)", "CAST(l_partkey AS STRING)")} END AS row
FROM (SELECT o.example_id, o.v, l.l_linenumber, l.l_partkey,
        explode(CASE WHEN o.v = 3 THEN array(0) WHEN l.l_orderkey IS NULL THEN NULL WHEN o.v = 2 THEN array(0, 1)
                     WHEN o.v = 0 OR (o.v = 1 AND l.l_linenumber > 1) THEN array(0) END) AS copy
      FROM (SELECT o_orderkey AS example_id, {d.u('o_orderkey', "'predrun'")} % 4 AS v FROM {d.t('orders')} WHERE o_orderkey IS NOT NULL) o
      LEFT JOIN {d.t('lineitem')} l ON l.l_orderkey = o.example_id AND o.v <> 3) x
"""


def annotated_example_sql(d: Dialect) -> str:
    """annotated_example(example_id, db_id, question, evidence, gold_sql,
    predicted_sql): gold queries in five shapes, one of which fails."""
    u = d.u("e.example_id", "'gshape'")
    key = "CAST(e.example_id AS STRING)"
    quote = "chr(39)"
    return f"""
SELECT e.example_id, e.db_id, e.question, e.evidence,
       CASE {u} % 5 WHEN 0 THEN 'SELECT o_orderpriority FROM orders WHERE o_orderkey = ' || {key}
            WHEN 1 THEN 'SELECT o.o_orderpriority FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderkey = ' || {key}
            WHEN 2 THEN 'SELECT o_orderstatus FROM orders WHERE o_orderkey = ' || {key} || ' LIMIT 1'
            WHEN 3 THEN 'SELECT o_orderpriority FROM orders WHERE o_orderpriority <> ' || {quote} || 'it' || {quote} || {quote} || 's 5' || {quote}
                        || ' AND o_orderkey = ' || {key} || ' AND o_totalprice > 0.5'
            ELSE 'SELECT o_priority FROM orders WHERE o_orderkey = ' || {key} END AS gold_sql,
       'SELECT o_orderpriority FROM orders WHERE o_custkey = ' || {key} AS predicted_sql
FROM ({example_sql(d)}) e
"""


# ---------------------------------------------------------------- complete trees

def complete_node_sql(d: Dialect, nodes: str) -> str:
    """complete_node(example_id, node_id, parent_id, arg_key, pos, node_type,
    name, value, value_type, cast_to): the query trees (``nodes``, a relation like
    tree_node's) as a full parser writes them: every child under its argument,
    names as identifier nodes, and arguments that compact trees leave out, with
    whole subtrees under them."""
    parent = ("CASE WHEN n.depth = 0 THEN NULL WHEN n.depth = 1 THEN '' ELSE "
              + ("substring_index(n.path, '.', n.depth - 1)" if d.spark else "array_to_string(string_split(n.path, '.')[1:n.depth - 1], '.')") + " END")
    last = ("CAST(substring_index(n.path, '.', -1) AS BIGINT)" if d.spark else "CAST(string_split(n.path, '.')[-1] AS BIGINT)")
    cols = "example_id, node_id, parent_id, arg_key, pos, node_type, name, value, value_type, cast_to"
    none = "CAST(NULL AS STRING)"
    return f"""
WITH t AS (SELECT n.*, {parent} AS up, CASE WHEN n.depth = 0 THEN 0 ELSE {last} END AS place FROM {nodes} n),
m AS (SELECT t.*, u.node_type AS over FROM t LEFT JOIN t u ON u.example_id = t.example_id AND u.path = t.up),
kept AS (
  SELECT example_id, 'n' || path AS node_id, 'n' || up AS parent_id, place AS pos, node_type, name, value, value_type, {none} AS cast_to,
    CASE WHEN over IS NULL THEN {none}
         WHEN over = 'select' THEN CASE node_type WHEN 'from' THEN 'from_' WHEN 'join' THEN 'joins' WHEN 'where' THEN 'where' WHEN 'group' THEN 'group'
              WHEN 'order' THEN 'order' WHEN 'limit' THEN 'limit' WHEN 'distinct' THEN 'distinct' ELSE 'expressions' END
         WHEN over IN ('group', 'order') THEN 'expressions'
         WHEN over = 'join' AND place = 1 THEN 'on' WHEN over = 'in' AND place = 1 THEN 'query'
         WHEN place = 1 THEN 'expression' ELSE 'this' END AS arg_key
  FROM m)
SELECT {cols} FROM kept
UNION ALL SELECT example_id, node_id || 'i', node_id, 'this', 0, 'identifier', name, {none}, {none}, {none} FROM kept WHERE node_type IN ('column', 'table')
UNION ALL SELECT example_id, node_id || 'ii', node_id || 'i', 'this', 0, 'column', 'inside', {none}, {none}, {none} FROM kept WHERE node_type = 'table'
UNION ALL SELECT example_id, node_id || 'h', node_id, 'hint', 0, 'anonymous', {none}, {none}, {none}, {none} FROM kept WHERE node_type = 'select'
UNION ALL SELECT example_id, node_id || 'hh', node_id || 'h', 'expressions', 0, 'column', 'hinted', {none}, {none}, {none} FROM kept WHERE node_type = 'select'
UNION ALL SELECT example_id, node_id || 'd', node_id, 'expression', 0, 'literal', {none}, '1', 'number', {none} FROM kept WHERE node_type = 'literal'
"""


# ---------------------------------------------------------------- trees as lines

def ast_lines_sql(d: Dialect) -> str:
    """ast_lines(example_id, ast): each query's tree as numbered lines with
    dotted paths; some examples have none."""
    op = _op_node("q.op")
    return f"""
WITH l AS (
  SELECT q.example_id, q.depth, q.pos, q.clause,
    CASE q.clause WHEN 'select' THEN 0 WHEN 'from' THEN 1 WHEN 'join' THEN 2 WHEN 'where' THEN 3 WHEN 'group' THEN 4 WHEN 'order' THEN 5 WHEN 'limit' THEN 6 ELSE 7 END AS rnk,
    CASE q.clause WHEN 'select' THEN 'select.' || CASE WHEN q.func IS NULL THEN 'column' ELSE q.func || '.column' END
         WHEN 'from' THEN 'select.from.table' WHEN 'join' THEN 'select.join.eq' WHEN 'group' THEN 'select.group.column'
         WHEN 'where' THEN CASE WHEN q.depth = 1 THEN 'select.where.in.select.where.' ELSE 'select.where.' END || {op}
         WHEN 'order' THEN 'select.order.ordered' WHEN 'limit' THEN 'select.limit.literal' ELSE 'select.distinct' END AS path,
    coalesce(q.col, q.tbl, q.val) AS value
  FROM ({query_part_sql(d)}) q),
n AS (SELECT example_id, path, value, ROW_NUMBER() OVER (PARTITION BY example_id ORDER BY depth, rnk, pos) AS i FROM l),
t AS (SELECT example_id, 0 AS i, 'Node[0] | select | select' AS line FROM n WHERE i = 1
      UNION ALL SELECT example_id, i, '  Node[' || CAST(i AS STRING) || '] | ' || path || ' | kind' || coalesce(' | ' || value, '') FROM n
      UNION ALL SELECT example_id, 99, '(end of tree)' FROM n WHERE i = 1)
SELECT example_id, CASE WHEN {d.u('example_id', "'noast'")} % 17 = 0 THEN NULL ELSE ast END AS ast
FROM (SELECT example_id, {d.agg('line', 'i', chr(10))} AS ast FROM t GROUP BY example_id) x
"""


def ast_lines_grouped_sql(d: Dialect) -> str:
    """Spark form of :func:`ast_lines_sql`: an example's parts meet once, in one
    sorted array, and are numbered there."""
    parts = ast_lines_sql(d).split(",\nn AS (")[0]
    return f"""{parts}
SELECT example_id, CASE WHEN {d.u('example_id', "'noast'")} % 17 = 0 THEN NULL
  ELSE array_join(concat(array('Node[0] | select | select'), slice(lines, 1, 99), array('(end of tree)'), slice(lines, 100, size(lines))), chr(10)) END AS ast
FROM (SELECT example_id, transform(array_sort(collect_list(struct(depth, rnk, pos, path, value))), (p, k) ->
        '  Node[' || CAST(k + 1 AS STRING) || '] | ' || p.path || ' | kind' || coalesce(' | ' || p.value, '')) AS lines FROM l GROUP BY example_id) x
"""


def analysis_sql(d: Dialect, names: list[str]) -> str:
    """analysis(example_id, pos, error_type, located): localization results, the
    located nodes given as a model writes them (missing, unknown, out of range)."""
    u = d.u("s.id * 4 + s.i", "'loc'")
    v = d.u("s.id * 4 + s.i", "'locv'")
    node = lambda n: f"'Node[' || CAST({n} AS STRING) || ']'"
    return f"""
SELECT s.id AS example_id, s.i AS pos, {d.pick([*names, 'Other Error'], f'({u} % {len(names) + 1})')} AS error_type,
       CASE {v} % 7 WHEN 0 THEN NULL WHEN 1 THEN {d.arr(node(99))} WHEN 2 THEN {d.arr("'the join'")}
            WHEN 3 THEN {d.arr(node(f'{v} % 5') + " || ': wrong'", node(f'{u} % 9'))} ELSE {d.arr(node(f'{v} % 6'))} END AS located
FROM (SELECT o.o_orderkey AS id, {d.explode_range(f"1 + {d.u('o.o_orderkey', chr(39) + 'nloc' + chr(39))} % 2")} AS i FROM {d.t('orders')} o) s
"""


def phrase_question_sql(d: Dialect) -> str:
    """phrase_question(example_id, db_id, question): value questions that also
    name tables, one of them in the singular for some."""
    return f"""SELECT v.example_id, v.db_id, v.question || CASE WHEN v.example_id % 2 = 0 THEN ' among orders of a customer'
       ELSE ' among customers by nation name' END AS question FROM ({value_question_sql(d)}) v"""


# ---------------------------------------------------------------- files

def catalog_json_sql(d: Dialect, ct: str, cc: str, pk: str, fk: str) -> str:
    """catalog_json(value): one JSON object per database, made from the catalog
    relations ``ct``, ``cc``, ``pk`` and ``fk``; keys of two columns are lists."""
    q = d.json_str
    return f"""
WITH t AS (SELECT db_id, {d.agg(q('table_name'), 'table_idx', ',')} AS orig, {d.agg(q("upper(table_name)"), 'table_idx', ',')} AS lab FROM {ct} GROUP BY db_id),
c AS (SELECT db_id, {d.agg("'[' || CAST(table_idx AS STRING) || ',' || " + q('column_name') + " || ']'", 'column_idx', ',')} AS orig,
             {d.agg("'[' || CAST(table_idx AS STRING) || ',' || " + q('label') + " || ']'", 'column_idx', ',')} AS lab,
             {d.agg(q('type'), 'column_idx', ',')} AS types FROM {cc} GROUP BY db_id),
k1 AS (SELECT p.db_id, x.table_idx, COUNT(*) AS n, {d.agg('CAST(p.column_idx AS STRING)', 'p.column_idx', ',')} AS ks
       FROM {pk} p JOIN {cc} x ON x.db_id = p.db_id AND x.column_idx = p.column_idx GROUP BY p.db_id, x.table_idx),
k AS (SELECT db_id, {d.agg("CASE WHEN n = 1 THEN ks ELSE '[' || ks || ']' END", 'table_idx', ',')} AS ks FROM k1 GROUP BY db_id),
f AS (SELECT db_id, {d.agg("'[' || CAST(from_idx AS STRING) || ',' || CAST(to_idx AS STRING) || ']'", 'from_idx', ',')} AS fs FROM {fk} GROUP BY db_id)
SELECT chr(123) || '"db_id":' || {q('t.db_id')} || ',"table_names_original":[' || t.orig || '],"table_names":[' || t.lab || '],"column_names_original":[' || c.orig
       || '],"column_names":[' || c.lab || '],"column_types":[' || c.types || '],"primary_keys":[' || coalesce(k.ks, '') || '],"foreign_keys":['
       || coalesce(f.fs, '') || ']' || chr(125) AS value
FROM t JOIN c ON c.db_id = t.db_id LEFT JOIN k ON k.db_id = t.db_id LEFT JOIN f ON f.db_id = t.db_id
"""


def doc_group_sql(d: Dialect, base: str) -> str:
    """doc_row(db, tbl, column_name, description, again): descriptions of every
    test column (``base``: table_name, ordinal, column_name) for each hundred
    customers; some columns are described twice."""
    u = d.u("g.db || c.column_name", "'docrow'")
    return f"""
SELECT g.db, c.table_name AS tbl, c.ordinal, CASE WHEN {u} % 3 = 0 THEN upper(c.column_name) ELSE c.column_name END AS column_name,
       CASE WHEN {u} % 5 = 0 THEN '' ELSE 'the ' || c.column_name || ', of ' || g.db END AS description, {u} % 4 = 0 AS again
FROM (SELECT DISTINCT 'g' || CAST(CAST(floor(c_custkey / 100) AS BIGINT) AS STRING) AS db FROM {d.t('customer')}) g, {base} c
"""


# ---------------------------------------------------------------- entities

def graph_example_sql(d: Dialect) -> str:
    """graph_example(example_id, db_id, question): the examples, some of which
    name a database that no catalog has."""
    return f"""SELECT example_id, CASE WHEN example_id % 37 = 0 THEN 'nowhere' ELSE db_id END AS db_id, question FROM ({example_sql(d)}) e"""


def entity_match_sql(d: Dialect) -> str:
    """entity_match(example_id, db_id, char_start, char_end, kind, idx): one to
    four matches of question spans to schema items; spans and targets repeat,
    and some indices lie beyond the database."""
    u = lambda salt: d.u("s.example_id * 8 + s.i", f"'{salt}'")
    n = d.u("e.example_id", "'nmatch'")
    return f"""
SELECT s.example_id, s.db_id, CAST({u('ms')} % 3 * 7 AS INT) AS char_start, CAST({u('ms')} % 3 * 7 + 5 + {u('me')} % 2 AS INT) AS char_end,
       CASE WHEN {u('mk')} % 3 = 0 THEN 'table' ELSE 'column' END AS kind,
       CASE WHEN {u('mk')} % 3 = 0 THEN {u('mi')} % 14 ELSE 1 + {u('mi')} % 30 END AS idx
FROM (SELECT e.example_id, e.db_id, {d.explode_range(f'1 + {n} % 4')} AS i FROM ({graph_example_sql(d)}) e) s
"""


# ---------------------------------------------------------------- localization

def graph_text_sql(d: Dialect) -> str:
    """graph_text(example_id, nodes_text, edges_text): the columns of each query
    as node lines, its joins as key edges, its select list as question edges."""
    return f"""
WITH q AS (SELECT example_id, clause, pos, tbl, col, val FROM ({query_part_sql(d)}) x WHERE depth = 0 AND clause IN ('select', 'join', 'where', 'order')),
n AS (SELECT example_id, clause, pos, CASE WHEN pos % 2 = 0 THEN '  ' ELSE '' END || tbl || '.' || upper(col) || ' (column)' AS line FROM q WHERE col IS NOT NULL),
e AS (SELECT example_id, clause, pos, CASE clause WHEN 'join' THEN ' Orders.' || col || ' foreign_key_to ' || tbl || '.' || val
        ELSE 'q_ent_' || CAST(pos + 1 AS STRING) || ' relates_to_column ' || tbl || '.' || col END AS line FROM q WHERE clause <> 'where')
SELECT n.example_id, n.nodes_text, e.edges_text FROM
  (SELECT example_id, {d.agg('line', 'clause, pos', chr(10))} AS nodes_text FROM n GROUP BY example_id) n
  JOIN (SELECT example_id, {d.agg('line', 'clause, pos', ';')} AS edges_text FROM e GROUP BY example_id) e ON e.example_id = n.example_id
"""


def graph_text_grouped_sql(d: Dialect) -> str:
    """Spark form of :func:`graph_text_sql`: node and edge lines in one grouping."""
    parts = graph_text_sql(d).split(",\nn AS (")[0]
    node = "CASE WHEN pos % 2 = 0 THEN '  ' ELSE '' END || tbl || '.' || upper(col) || ' (column)'"
    edge = """CASE clause WHEN 'join' THEN ' Orders.' || col || ' foreign_key_to ' || tbl || '.' || val
        ELSE 'q_ent_' || CAST(pos + 1 AS STRING) || ' relates_to_column ' || tbl || '.' || col END"""
    text = lambda lines, sep: f"nullif(array_join(transform(array_sort({lines}), x -> x.line), {sep}), '')"
    return f"""{parts}
SELECT example_id, {text('nodes', 'chr(10)')} AS nodes_text, {text('edges', "';'")} AS edges_text FROM
  (SELECT example_id, collect_list(CASE WHEN col IS NOT NULL THEN struct(clause, pos, {node} AS line) END) AS nodes,
          collect_list(CASE WHEN clause <> 'where' THEN struct(clause, pos, {edge} AS line) END) AS edges
   FROM q WHERE example_id IS NOT NULL GROUP BY example_id) x
WHERE size(nodes) > 0 AND size(edges) > 0
"""


def element_sql(d: Dialect, names: list[str]) -> str:
    """analysis with ``elements``: tables and columns as a model writes them, or none."""
    v = d.u("a.example_id * 4 + a.pos", "'elem'")
    return f"""
SELECT a.example_id, a.pos, a.error_type, CASE {v} % 6 WHEN 0 THEN NULL WHEN 1 THEN {d.arr("'Orders.o_custkey'")} WHEN 2 THEN {d.arr("'Customer'")}
       WHEN 3 THEN {d.arr("'nation.n_name'", "'orders'", "'ORDERS'")} WHEN 4 THEN {d.arr("'orders.o_totalprice'", "'customer.c_name'")} ELSE {d.arr("'orders'")} END AS elements
FROM ({analysis_sql(d, names)}) a
"""


def localization_sql(d: Dialect) -> str:
    """localization(example_id, text): two analyses, one with fields missing, none,
    an array in place of an object, or no JSON."""
    u = d.u("o.o_orderkey", "'lcz'")
    one = "'{\"error_type\":\"Value Mismatch\",\"located_nodes\":[\"Node[1]\",\"Node[' || CAST(o.o_orderkey AS STRING) || ']\"],\"involved_elements\":[\"orders\"],\"filled_guideline\":{\"fix\":\"it\"}}'"
    two = "'{\"error_type\":\"Clause Error\"}'"
    return f"""
SELECT o.o_orderkey AS example_id, CASE {u} % 5 WHEN 0 THEN '{{"analyses":[' || {one} || ',' || {two} || ']}}' WHEN 1 THEN '{{"analyses":[' || {two} || ']}}'
       WHEN 2 THEN '{{"other":1}}' WHEN 3 THEN '[' || {one} || ']' ELSE 'Sorry, {{' END AS text
FROM {d.t('orders')} o
"""


# ---------------------------------------------------------------- detector inputs

def detector_example_sql(d: Dialect) -> str:
    """detector_example(example_id, db_id, question, evidence, predicted_sql)."""
    return f"""SELECT e.example_id, e.db_id, e.question, CASE WHEN e.evidence = '' THEN NULL ELSE e.evidence END AS evidence,
       'SELECT o_orderkey FROM orders WHERE o_orderkey = ' || CAST(e.example_id AS STRING) AS predicted_sql FROM ({example_sql(d)}) e"""


def finding_sql(d: Dialect) -> str:
    """finding(example_id, seq, error_label, message): rule findings of some examples."""
    return f"""SELECT r.example_id, r.pos AS seq, {d.pick(ERROR_LABELS, f"({d.u('r.example_id * 4 + r.pos', chr(39) + 'find' + chr(39))} % 12)")} AS error_label,
       'at ' || CAST(r.pos AS STRING) AS message FROM ({raw_labels_sql(d)}) r WHERE r.example_id % 3 <> 0"""


def target_label_sql(d: Dialect) -> str:
    """target_label(example_id, error_label): labels to learn, some repeated or unknown."""
    return f"""SELECT r.example_id, CASE WHEN {d.u('r.example_id * 4 + r.pos', "'tl'")} % 9 = 0 THEN 'other_error'
       ELSE {d.pick(ERROR_LABELS, f"({d.u('r.example_id * 4 + r.pos', chr(39) + 'tgt' + chr(39))} % 12)")} END AS error_label
FROM ({raw_labels_sql(d)}) r WHERE r.example_id % 5 <> 0"""
