"""Registered queries for catalog-graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from errata.operators import graph as D
from errata.plans.names_plans import duck_column_id, duck_norm
from errata.plans.registry import query
from errata.sources import workload as W
from errata.sources.fixtures import workload


def cat(spark: SparkSession, sf_dir: str):
    w = workload(spark, sf_dir)
    return w, w.catalog_table(), w.catalog_column(), w.catalog_pk(), w.catalog_fk()


def _duck_cat(d: W.Dialect) -> str:
    return (f"ct AS ({W.catalog_table_sql(d)}), cc AS ({W.catalog_column_sql(d)}), "
            f"pk AS ({W.catalog_pk_sql(d)}), fk AS ({W.catalog_fk_sql(d)}), "
            f"nc AS (SELECT cc.*, ct.table_name FROM cc JOIN ct ON ct.db_id = cc.db_id AND ct.table_idx = cc.table_idx "
            f"WHERE cc.column_idx >= 1)")


def _duck_nodes(d: W.Dialect) -> str:
    return f"""{_duck_cat(d)},
nodes AS (
  SELECT db_id, row_number() OVER (PARTITION BY db_id ORDER BY grp, ord) - 1 AS node_ord, id, type, label, datatype
  FROM (SELECT db_id, 0 AS grp, table_idx AS ord, lower(table_name) AS id, 'table' AS type,
               lower(table_name) AS label, CAST(NULL AS VARCHAR) AS datatype FROM ct
        UNION ALL
        SELECT db_id, 1, column_idx, {duck_column_id('table_name', 'column_name')}, 'column', column_name, type
        FROM nc) x)"""


def _duck_edges(d: W.Dialect) -> str:
    cid = duck_column_id("table_name", "column_name")
    return f"""edges AS (
  SELECT db_id, lower(table_name) AS src, {cid} AS tgt, 'has_column' AS rel FROM nc
  UNION ALL SELECT db_id, db_id, lower(table_name), 'has_table' FROM ct
  UNION ALL SELECT nc.db_id, {duck_column_id('nc.table_name', 'nc.column_name')}, lower(nc.table_name), 'primary_key_of'
            FROM nc JOIN pk ON pk.db_id = nc.db_id AND pk.column_idx = nc.column_idx
  UNION ALL SELECT fk.db_id, {duck_column_id('a.table_name', 'a.column_name')}, {duck_column_id('b.table_name', 'b.column_name')},
            'foreign_key_to'
            FROM fk JOIN nc a ON a.db_id = fk.db_id AND a.column_idx = fk.from_idx
            JOIN nc b ON b.db_id = fk.db_id AND b.column_idx = fk.to_idx)"""


def oracle_graph_nodes(d: W.Dialect) -> str:
    return f"WITH {_duck_nodes(d)} SELECT db_id, CAST(node_ord AS INT) AS node_ord, id, type, label, datatype FROM nodes"


@query("graph_nodes", oracle_graph_nodes)
def q_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ct, cc, _, _ = cat(spark, sf_dir)
    n = D.graph_nodes(ct, cc)
    return n.select("db_id", F.col("node_ord").cast("int").alias("node_ord"), "id", "type", "label", "datatype")


def oracle_graph_edges(d: W.Dialect) -> str:
    return f"WITH {_duck_cat(d)}, {_duck_edges(d)} SELECT * FROM edges"


@query("graph_edges", oracle_graph_edges)
def q_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ct, cc, pk, fk = cat(spark, sf_dir)
    return D.graph_edges(ct, cc, pk, fk)


def _column_examples_text(cols_by_table: dict[str, list[str]]) -> str:
    parts = []
    for t, cols in cols_by_table.items():
        per_col = []
        for c in cols:
            per_col.append(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(rank AS INT) AS rank, value FROM (
  SELECT CAST(k AS VARCHAR) AS value, row_number() OVER (ORDER BY k) AS rank
  FROM (SELECT DISTINCT {c} AS k FROM {t} WHERE {c} IS NOT NULL) x) y WHERE rank <= 3""")
        parts.extend(per_col)
    return "\nUNION ALL\n".join(parts)


# Primitive columns of the test tables (their parquet schemas).
TABLE_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}


@query("column_examples", lambda d: _column_examples_text(TABLE_COLUMNS))
def q_column_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workload(spark, sf_dir)
    out = D.column_examples({t: w.table(t) for t in W.TABLES})
    return out.select("table_name", "column_name", F.col("rank").cast("int").alias("rank"), "value")


def oracle_attach_docs(d: W.Dialect) -> str:
    return f"""WITH {_duck_nodes(d)},
docs AS ({W.column_doc_sql(d)}),
dsc AS (SELECT nc.db_id, {duck_column_id('nc.table_name', 'nc.column_name')} AS id,
               nullif(trim(docs.description), '') AS description
        FROM nc JOIN docs ON docs.db_id = nc.db_id AND lower(docs.table_name) = lower(nc.table_name)
                          AND lower(docs.column_name) = lower(nc.column_name))
SELECT nodes.db_id, nodes.id, nodes.type, dsc.description
FROM nodes LEFT JOIN dsc ON dsc.db_id = nodes.db_id AND dsc.id = nodes.id"""


@query("attach_docs", oracle_attach_docs)
def q_attach_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, ct, cc, _, _ = cat(spark, sf_dir)
    docs = w._catalog(W.column_doc_sql(w.d))
    return D.attach_docs(D.graph_nodes(ct, cc), ct, cc, docs).select("db_id", "id", "type", "description")


def oracle_linked_subset(d: W.Dialect) -> str:
    return f"""WITH {_duck_cat(d)},
lk AS (SELECT example_id, db_id, lower(table_name) AS t, columns FROM ({W.linking_sql(d)}) x WHERE columns IS NOT NULL),
it AS (SELECT DISTINCT lk.example_id, lk.db_id, ct.table_idx FROM lk JOIN ct ON ct.db_id = lk.db_id AND lower(ct.table_name) = lk.t),
listed AS (SELECT lk.example_id, lk.db_id, nc.column_idx
           FROM lk JOIN ct ON ct.db_id = lk.db_id AND lower(ct.table_name) = lk.t
           JOIN nc ON nc.db_id = lk.db_id AND nc.table_idx = ct.table_idx
           WHERE list_contains(lk.columns, lower(nc.column_name)) OR list_contains(lk.columns, lower(nc.label))),
pkc AS (SELECT it.example_id, it.db_id, nc.column_idx FROM it JOIN nc ON nc.db_id = it.db_id AND nc.table_idx = it.table_idx
        JOIN pk ON pk.db_id = nc.db_id AND pk.column_idx = nc.column_idx),
fkt AS (SELECT fk.db_id, fk.from_idx, fk.to_idx, a.table_idx AS ft, b.table_idx AS tt FROM fk
        JOIN nc a ON a.db_id = fk.db_id AND a.column_idx = fk.from_idx
        JOIN nc b ON b.db_id = fk.db_id AND b.column_idx = fk.to_idx),
fkc AS (SELECT i1.example_id, fkt.db_id, unnest([fkt.from_idx, fkt.to_idx]) AS column_idx FROM fkt
        JOIN it i1 ON i1.db_id = fkt.db_id AND i1.table_idx = fkt.ft
        JOIN it i2 ON i2.db_id = fkt.db_id AND i2.table_idx = fkt.tt AND i2.example_id = i1.example_id)
SELECT example_id, db_id, 'table' AS kind, table_idx AS idx FROM it
UNION ALL
SELECT DISTINCT example_id, db_id, 'column', column_idx FROM (SELECT * FROM listed UNION ALL SELECT * FROM pkc
                                                             UNION ALL SELECT * FROM fkc) x"""


@query("linked_subset", oracle_linked_subset)
def q_linked_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, ct, cc, pk, fk = cat(spark, sf_dir)
    return D.linked_subset(ct, cc, pk, fk, w.linking())


def oracle_resolve_targets(d: W.Dialect) -> str:
    return f"""WITH {_duck_cat(d)},
want AS (SELECT example_id, db_id, table_name, lower(table_name) AS t, unnest(columns) AS name
         FROM ({W.linking_sql(d)}) x WHERE columns IS NOT NULL)
SELECT want.example_id, want.db_id, want.table_name, want.name, min(nc.column_idx) AS column_idx
FROM want JOIN ct ON ct.db_id = want.db_id AND lower(ct.table_name) = want.t
JOIN nc ON nc.db_id = want.db_id AND nc.table_idx = ct.table_idx
WHERE lower(nc.column_name) = want.name OR lower(nc.label) = want.name
GROUP BY want.example_id, want.db_id, want.table_name, want.name"""


@query("resolve_targets", oracle_resolve_targets)
def q_resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, ct, cc, _, _ = cat(spark, sf_dir)
    return D.resolve_targets(ct, cc, w.linking())


def oracle_graph_keys(d: W.Dialect) -> str:
    return f"""WITH {_duck_nodes(d)}, {_duck_edges(d)},
owner AS (SELECT db_id, tgt AS id, min(src) AS owner_edge FROM edges WHERE rel = 'has_column' GROUP BY db_id, tgt),
pks AS (SELECT DISTINCT db_id, src AS id FROM edges WHERE rel = 'primary_key_of'),
fks AS (SELECT db_id, src AS id, string_agg(tgt, ',' ORDER BY tgt) AS fk_targets FROM
        (SELECT DISTINCT db_id, src, tgt FROM edges WHERE rel = 'foreign_key_to') x GROUP BY db_id, src)
SELECT n.db_id, n.id, coalesce(o.owner_edge, CASE WHEN contains(n.id, '.') THEN split_part(n.id, '.', 1) END) AS owner_table,
       p.id IS NOT NULL AS is_pk, coalesce(f.fk_targets, '') AS fk_targets
FROM nodes n LEFT JOIN owner o ON o.db_id = n.db_id AND o.id = n.id
LEFT JOIN pks p ON p.db_id = n.db_id AND p.id = n.id
LEFT JOIN fks f ON f.db_id = n.db_id AND f.id = n.id
WHERE n.type = 'column'"""


@query("graph_keys", oracle_graph_keys)
def q_graph_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ct, cc, pk, fk = cat(spark, sf_dir)
    k = D.graph_keys(D.graph_nodes(ct, cc), D.graph_edges(ct, cc, pk, fk))
    return k.select("db_id", "id", "owner_table", "is_pk", F.array_join("fk_targets", ",").alias("fk_targets"))


def oracle_resolve_names(d: W.Dialect) -> str:
    tail = "CASE WHEN contains(id, '.') THEN split_part(id, '.', -1) ELSE id END"
    return f"""WITH {_duck_nodes(d)},
names AS (SELECT DISTINCT t.example_id, e.db_id, t.name FROM ({W.tree_node_sql(d)}) t
           JOIN ({W.example_sql(d)}) e ON e.example_id = t.example_id WHERE t.node_type = 'column'),
keys AS (SELECT DISTINCT db_id, node_ord, id, k FROM (
           SELECT db_id, node_ord, id, {duck_norm(tail)} AS k FROM nodes WHERE type = 'column'
           UNION ALL SELECT db_id, node_ord, id, {duck_norm('label')} FROM nodes WHERE type = 'column') x),
first AS (SELECT db_id, k, arg_min(id, node_ord) AS node_id FROM keys GROUP BY db_id, k)
SELECT names.example_id, names.db_id, names.name, first.node_id IS NOT NULL AS found, first.node_id
FROM names LEFT JOIN first ON first.db_id = names.db_id AND first.k = {duck_norm('names.name')}"""


@query("resolve_names", oracle_resolve_names)
def q_resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column name written in each example's query, looked up in the
    example database's graph."""
    w, ct, cc, _, _ = cat(spark, sf_dir)
    ex = w.example().select("example_id", "db_id")
    names = (w.nodes.where(F.col("node_type") == "column").select("example_id", F.col("name")).distinct()
             .join(ex, "example_id"))
    return D.resolve_names(names.select("example_id", "db_id", "name"), D.graph_nodes(ct, cc)).select(
        "example_id", "db_id", "name", "found", "node_id")


def oracle_schema_relations(d: W.Dialect) -> str:
    return f"""WITH {_duck_cat(d)},
colt AS (SELECT db_id, column_idx, table_idx FROM cc),
tf AS (SELECT DISTINCT fk.db_id, a.table_idx AS t1, b.table_idx AS t2 FROM fk
       JOIN colt a ON a.db_id = fk.db_id AND a.column_idx = fk.from_idx
       JOIN colt b ON b.db_id = fk.db_id AND b.column_idx = fk.to_idx),
tfb AS (SELECT tf.*, EXISTS (SELECT 1 FROM tf r WHERE r.db_id = tf.db_id AND r.t1 = tf.t2 AND r.t2 = tf.t1) AS back FROM tf),
tt AS (SELECT db_id, t1, t2, CASE WHEN back THEN 'fkb' ELSE 'fk' END AS rel FROM tfb WHERE t1 <> t2
       UNION ALL SELECT db_id, t2, t1, 'fkr' FROM tfb WHERE NOT back AND t1 <> t2
       UNION ALL SELECT db_id, table_idx, table_idx, 'identity' FROM ct),
cp AS (SELECT db_id, column_idx AS c1, column_idx AS c2, 'identity' AS rel, [0, 0, 0, 0] AS o FROM cc
       UNION ALL SELECT db_id, from_idx, to_idx, 'fk', [1, from_idx, to_idx, 0] FROM fk WHERE from_idx > 0 AND to_idx > 0
       UNION ALL SELECT db_id, to_idx, from_idx, 'fkr', [1, from_idx, to_idx, 1] FROM fk WHERE from_idx > 0 AND to_idx > 0),
ccr AS (SELECT db_id, c1, c2, arg_max(rel, o) AS rel FROM cp GROUP BY db_id, c1, c2),
tc AS (SELECT cc.db_id, cc.table_idx, cc.column_idx, CASE WHEN pk.column_idx IS NOT NULL THEN 'pk' ELSE 'has' END AS k
       FROM cc LEFT JOIN pk ON pk.db_id = cc.db_id AND pk.column_idx = cc.column_idx WHERE cc.column_idx >= 1
       UNION ALL SELECT db_id, table_idx, 0, 'has' FROM ct)
SELECT db_id, 'table' AS src_kind, t1 AS src_idx, 'table' AS tgt_kind, t2 AS tgt_idx, 'table-table-' || rel AS rel FROM tt
UNION ALL SELECT db_id, 'column', c1, 'column', c2, 'column-column-' || rel FROM ccr
UNION ALL SELECT db_id, 'table', table_idx, 'column', column_idx, 'table-column-' || k FROM tc
UNION ALL SELECT db_id, 'column', column_idx, 'table', table_idx, 'column-table-' || k FROM tc"""


@query("schema_relations", oracle_schema_relations)
def q_schema_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ct, cc, pk, fk = cat(spark, sf_dir)
    r = D.schema_relations(ct, cc, pk, fk)
    return r.select("db_id", "src_kind", F.col("src_idx").cast("bigint").alias("src_idx"), "tgt_kind",
                    F.col("tgt_idx").cast("bigint").alias("tgt_idx"), "rel")


def oracle_token_relations(d: W.Dialect) -> str:
    return f"""WITH t AS (SELECT example_id, CAST(generate_subscripts(string_split(question, ' '), 1) - 1 AS INT) AS pos
                  FROM ({W.example_sql(d)}) e),
m AS (SELECT example_id, max(pos) AS mx FROM t GROUP BY example_id),
o AS (SELECT CAST(range AS INT) AS dd FROM range(-4, 5))
SELECT t.example_id, t.pos AS i, t.pos + o.dd AS j, 'question-question-dist' || CAST(o.dd AS VARCHAR) AS rel
FROM t JOIN m ON m.example_id = t.example_id JOIN o ON t.pos + o.dd BETWEEN 0 AND m.mx"""


@query("token_relations", oracle_token_relations)
def q_token_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex = workload(spark, sf_dir).example()
    toks = ex.select("example_id", F.posexplode(F.split("question", " ")).alias("pos", "tok"))
    r = D.token_relations(toks.select("example_id", F.col("pos").cast("int").alias("pos")))
    return r.select("example_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "rel")
