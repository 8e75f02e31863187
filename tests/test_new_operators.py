"""Hand tables for composed changes, corpora, free SQL, value links, phrase
relations, compact trees, error subtrees, loaders and graph records."""

import json

import pytest
from pyspark.sql import functions as F

from errata.operators import compose, context, corpus, entities, evaluate, linking, synth, trees, values
from errata.sources import loaders

PARTS = "example_id long, db_id string, depth int, clause string, pos long, func string, tbl string, col string, op string, val string, val_type string, is_desc boolean"


def parts(spark, *rows):
    return spark.createDataFrame([(e, "d", dep, cl, pos, fn, t, c, op, v, vt, de) for e, dep, cl, pos, fn, t, c, op, v, vt, de in rows], PARTS)


@pytest.fixture(scope="module")
def query_parts(spark):
    return parts(
        spark, (1, 0, "select", 0, None, "o", "a", None, None, None, None), (1, 0, "select", 1, "max", "o", "b", None, None, None, None),
        (1, 0, "from", 0, None, "o", None, None, None, None, None), (1, 0, "where", 0, None, "o", "a", "=", "x", "string", None),
        (2, 0, "select", 0, None, "o", "a", None, None, None, None), (2, 0, "from", 0, None, "o", None, None, None, None, None))


@pytest.fixture(scope="module")
def catalog(spark):
    columns = spark.createDataFrame([("d", 0, "o", 1, "a"), ("d", 0, "o", 2, "b"), ("d", 1, "p", 3, "c")],
                                    "db_id string, table_idx long, table_name string, column_idx long, column_name string")
    return compose.group_catalog(columns, columns.select("db_id", "table_name").distinct())


def typed(spark, *rows):
    return spark.createDataFrame(list(rows), "example_id long, error_types array<string>")


def test_changes_compose_in_order_and_one_miss_rejects_all(spark, query_parts, catalog):
    queries = compose.group_parts(query_parts)
    made = synth.render_sql(compose.compose_changes(queries, catalog, typed(spark, (1, ["condition_missing", "attribute_missing"]), (2, ["modifier_error", "value_error"]))))
    (r,) = made.collect()
    assert r.example_id == 1 and r.error_type == "condition_missing,attribute_missing"
    assert r.description.startswith("Compound: [Removed WHERE clause entirely] + [Removed SELECT expression: ") and "WHERE" not in r.sql
    # the second change sees the first one's result: no literal is left for it
    assert compose.compose_changes(queries, catalog, typed(spark, (1, ["condition_missing", "value_error"]))).count() == 0
    single = compose.compose_changes(queries, catalog, typed(spark, (2, ["modifier_error"]))).collect()
    assert [r.description for r in single] == ["Added DISTINCT modifier"]
    assert compose.compose_changes(queries, catalog, typed(spark, (1, ["nonsense"]), (2, []))).count() == 0


def test_changes_of_a_database_without_catalog(spark, query_parts, catalog):
    queries = compose.group_parts(query_parts.withColumn("db_id", F.lit("other")))
    types = typed(spark, (1, ["attribute_redundancy"]), (2, ["table_mismatch"]))
    assert compose.compose_changes(queries, catalog, types).count() == 0
    assert compose.compose_changes(queries, catalog, typed(spark, (1, ["value_error"]))).count() == 1


def test_references_without_another_name_are_passed_over(spark, query_parts):
    """A database of the one column A: a is passed over, b becomes A."""
    columns = spark.createDataFrame([("d", 0, "o", 1, "A")], "db_id string, table_idx long, table_name string, column_idx long, column_name string")
    small = compose.group_catalog(columns, columns.select("db_id", "table_name").distinct())
    done = {r.example_id: r.description for r in synth.attribute_redundancy(query_parts, columns).collect()}
    assert done == {1: "Replaced column 'b' with unrelated schema column 'A'"}
    made = compose.compose_changes(compose.group_parts(query_parts), small, typed(spark, (1, ["attribute_redundancy"]), (2, ["attribute_redundancy"])))
    assert {r.example_id: r.description for r in made.collect()} == done


def test_array_changes_equal_the_relational_ones(spark):
    from errata.plans.synth_plans import ctx

    _, qp, columns, tables = ctx(spark, "/root/testdata/sf0.001")
    queries, known = compose.group_parts(qp), compose.group_catalog(columns, tables)
    every = queries.select("example_id", F.array(*[F.lit(t) for t in ("attribute_mismatch",)]).alias("error_types"))
    for name, made in (("attribute_mismatch", synth.attribute_mismatch(qp, columns)), ("modifier_error", synth.modifier_error(qp)),
                       ("table_redundancy", synth.table_redundancy(qp, tables)), ("function_error", synth.function_error(qp))):
        types = every.withColumn("error_types", F.array(F.lit(name)))
        show = lambda df: {tuple(r) for r in synth.render_sql(df).select("example_id", "description", "sql").collect()}
        assert show(compose.compose_changes(queries, known, types)) == show(made)


def test_retries_read_only_what_is_open(spark, query_parts, catalog):
    seen = []

    def validate(made):
        seen.append(sorted((r.example_id, r.attempt) for r in made.collect()))
        # compounds are valid at the third attempt only
        return made.select("example_id", ((F.col("attempt") == 3) | ~F.col("error_type").contains(",")).alias("valid"), F.lit("soft_error").alias("status"))

    rows = [r for e in range(1, 40) for r in (
        (e, 0, "select", 0, None, "o", "a", None, None, None, None), (e, 0, "select", 1, "max", "o", "b", None, None, None, None),
        (e, 0, "from", 0, None, "o", None, None, None, None, None), (e, 0, "join", 0, None, "p", "a", "=", "c", "column", None),
        (e, 0, "where", 0, None, "o", "a", "=", "x", "string", None), (e, 0, "limit", 0, None, None, None, None, "3", "number", None))]
    counts = spark.createDataFrame([(e, 1 + e % 3) for e in range(1, 40)], "example_id long, n_errors int")
    got = compose.first_valid_attempt(compose.group_parts(parts(spark, *rows)), catalog, counts, validate).collect()
    singles = {e for e in range(1, 40) if e % 3 == 0}
    assert {r.attempt for r in got if r.example_id in singles} == {1} and {r.attempt for r in got if r.example_id not in singles} == {3}
    assert len(seen) == 3 and all(e not in singles for e, _ in seen[1] + seen[2])
    assert len({r.example_id for r in got}) == len(got)


def test_free_queries_run_by_shape(spark):
    orders = spark.createDataFrame([(1, "it's", 1.5), (2, "b", 2.0), (3, "b", 0.5)], "k long, s string, x double")
    rows = [(1, "pred", "SELECT s FROM orders WHERE k = 1"), (2, "pred", "SELECT s FROM orders WHERE k = 2;"), (3, "pred", "SELECT s, s FROM orders WHERE s = 'it''s' AND x > 0.5"),
            (4, "pred", "SELECT nope FROM orders WHERE k = 4"), (5, "pred", "SELECT k FROM orders ORDER BY 1 DESC LIMIT 1"), (6, "pred", "SELEC {x}"),
            (7, "pred", "SELECT count(*) FROM orders WHERE s = 'b'"), (8, "pred", None), (1, "gold", "SELECT s FROM orders WHERE k = 9")]
    df = spark.createDataFrame(rows, "example_id long, side string, sql string")
    assert evaluate.query_shapes(df.where("side = 'pred' AND example_id < 3")).select(F.regexp_replace("shape", ";", "")).distinct().count() == 1
    got = evaluate.run_queries(spark, df, {"orders": orders}).collect()
    assert {(r.example_id, r.side): tuple(r.row) for r in got if r.ok} == {
        (1, "pred"): ("it's",), (2, "pred"): ("b",), (3, "pred"): ("it's", "it's"), (5, "pred"): ("3",), (7, "pred"): ("2",)}
    assert {r.example_id for r in got if not r.ok} == {4, 6}
    assert evaluate.run_queries(spark, df.where("false"), {"orders": orders}).count() == 0
    with pytest.raises(ValueError, match="shapes"):
        evaluate.run_queries(spark, df, {"orders": orders}, max_shapes=3)


def links(spark, question, cells, **kw):
    """{(column, value): score} for one question over (column, value) cells."""
    names = sorted({c for c, _ in cells})
    columns = spark.createDataFrame([("d", k, "t", c) for k, c in enumerate(names)], "db_id string, column_idx long, table_name string, column_name string")
    asked = spark.createDataFrame([(1, "d", question)], "example_id long, db_id string, question string")
    picks = spark.createDataFrame([("t", c, v) for c, v in cells], "table_name string, column_name string, value string")
    return {(names[r.column_idx], r.value): round(r.score, 4) for r in values.value_links(asked, picks, columns, **kw).collect()}


def test_value_links_by_hand(spark):
    q = "Which schools in Alameda  County's district were many, fremonts?"
    got = links(spark, q, [("county", "Alameda"), ("county", "alameda"), ("city", "Fremont"), ("city", "FREMONT"), ("name", "Fremont"), ("x", "many"),
                           ("x", "manyy"), ("x", "id"), ("x", "meda"), ("y", "who"), ("y", "12"), ("y", ""), ("y", None), ("z", "Alameda Countys")])
    assert got[("county", "Alameda")] == got[("county", "alameda")] == got[("x", "many")] == 1.0
    assert got[("city", "Fremont")] == round(14 / 15, 4) and ("city", "FREMONT") not in got and ("name", "Fremont") not in got
    assert not {("x", "manyy"), ("x", "id"), ("x", "meda"), ("y", "who")} & set(got)
    assert links(spark, "", [("x", "a")]) == {} == links(spark, "no number 12", [("x", "12"), ("x", "1")])
    five = links(spark, "the blue ones", [("c", f"blue{x}") for x in "abcdef"] + [("c", "blue")])
    assert five[("c", "blue")] == 1.0 and len(five) == values.MAX_PER_COLUMN


def test_value_candidates_are_whole(spark):
    """Every pair within the ratio meets in the index, whatever its letters."""
    import random

    rnd = random.Random(2)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.randint(1, 16))) for _ in range(500)]
    runs = spark.createDataFrame([(w,) for w in sorted(set(words[:250]))], "run string")
    known = spark.createDataFrame([(w, w[0]) for w in sorted(set(words[250:]))], "norm string, first string")

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b, 1):
                now.append(row[j - 1] + 1 if x == y else max(row[j], now[-1]))
            row = now
        return row[-1]
    want = {(a, b, common(a, b)) for a in set(words[:250]) for b in set(words[250:]) if a[0] == b[0] and 40 * common(a, b) >= 17 * (len(a) + len(b))}
    assert {tuple(r) for r in values.scored_runs(runs, known).select("run", "norm", "common").collect()} == want and len(want) > 50


def test_picklists_read_bytes(spark):
    df = spark.createDataFrame([(b"caf\xc3\xa9", "x", 1), (b"caf\xe9", "x", 2), (None, None, 3)], "b binary, s string, n int")
    got = {(r.column_name, r.value) for r in values.picklists({"t": df}).collect()}
    assert got == {("b", "café"), ("s", "x")}


def test_phrases_overwrite_by_length_then_start(spark):
    asked = spark.createDataFrame([(1, "d", "order date of order items")], "example_id long, db_id string, question string")
    names = spark.createDataFrame([("d", "table", 0, "order items"), ("d", "column", 1, "order date"), ("d", "column", 2, "dates")], "db_id string, kind string, idx long, name string")
    linked = spark.createDataFrame([(1, 1, "of order"), (1, 2, "items")], "example_id long, column_idx long, value string")
    got = {(r.tok, r.kind, r.idx): r.relation.split("-")[-1] for r in linking.phrase_relations(asked, names, linked).collect()}
    assert got[0, "table", 0] == "partialmatch" and got[3, "table", 0] == got[4, "table", 0] == "exactmatch"
    assert got[0, "column", 1] == got[1, "column", 1] == "exactmatch" and got[3, "column", 1] == "partialmatch" and got[2, "column", 1] == "valuematch"
    assert got[4, "column", 2] == "valuematch" and (1, "column", 2) not in got


NODES = "example_id long, node_id string, parent_id string, arg_key string, pos long, node_type string, name string, value string, value_type string, cast_to string"


def test_compact_trees_of_any_depth(spark):
    rows = [(1, "r", None, None, 0, "select", None, None, None, None), (1, "w", "r", "where", 0, "where", None, None, None, None),
            (1, "e0", "r", "expressions", 1, "paren", None, None, None, None), (1, "e1", "r", "expressions", 0, "cast", None, None, None, "INT"),
            (1, "p", "e0", "this", 0, "column", "a", None, None, "x"), (1, "q", "e0", "expression", 0, "column", "gone", None, None, None),
            (1, "n", "e1", "this", 0, "null", None, "v", None, None), (1, "to", "e1", "to", 0, "datatype", None, None, None, None),
            (1, "z", "r", "zz", 0, "zeta", None, None, None, None), (1, "k", "r", "kind", 0, "column", "gone", None, None, None),
            (1, "i", "w", "this", 0, "identifier", "gone", None, None, None), (1, "j", "i", "this", 0, "column", "gone", None, None, None)]
    rows += [(2, "0", None, None, 0, "f", None, None, None, None)] + [(2, str(k), str(k - 1), "this", 0, "f", None, None, None, None) for k in range(1, 150)]
    got = trees.compact_trees(spark.createDataFrame(rows, NODES)).collect()
    one = {tuple(r.path): (r.node_type, r.name, r.value_type, r.cast_to) for r in got if r.example_id == 1}
    assert one == {(): ("select", None, None, None), (0,): ("cast", None, None, "INT"), (0, 0): ("literal", None, "null", None), (1,): ("paren", None, None, None),
                   (1, 0): ("column", "a", None, None), (2,): ("where", None, None, None), (3,): ("zeta", None, None, None)}
    assert sorted(len(r.path) for r in got if r.example_id == 2) == list(range(150))


def test_error_subtrees_by_hand(spark):
    lines = ["Node[0] | select | select", " Node[1] | select.from | from", "Node[2] | select.from.table | table | t", "no node", "Node[3] | select.where.eq | eq",
             "Node[4] | select.where.eq.column | column | c"] + [f"Node[{k}] | x.y{k} | n" for k in range(5, 20)]
    asts = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "no tree here")], "example_id long, ast string")
    asked = spark.createDataFrame([(1, 0, "Table Missing", ["Node[2]"]), (1, 1, "Condition Error", ["see Node[4]: c"]), (1, 2, "Clause Error", ["Node[77]"]), (1, 3, "What", []),
                                   (2, 0, "Function Error", ["Node[0]"]), (3, 0, "Value Mismatch", ["Node[0]"])], "example_id long, pos int, error_type string, located array<string>")
    got = {(r.example_id, r.pos): r.subtree for r in context.error_subtrees(asts, asked).collect()}
    assert got[1, 0] == "Node[0] | select | select\nNode[1] | select.from | from\nNode[2] | select.from.table | table | t  <- [ERROR]"
    assert got[1, 1] == "Node[0] | select | select\nNode[3] | select.where.eq | eq\nNode[4] | select.where.eq.column | column | c  <- [ERROR]"
    assert got[1, 2].count("\n") == 9 and "ERROR" not in got[1, 2]
    assert got[1, 3] == "(No specific nodes located - error affects unknown)" and got[2, 0].endswith("affects function)") and got[3, 0] == "(No subtree extracted)"


def test_loaders_of_catalogs_docs_and_linking(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"db_id": "d", "table_names_original": ["T"], "table_names": ["t"], "column_names_original": [[-1, "*"], [0, "A"], [0, "B"]],
                                                  "column_names": [[-1, "*"], [0, "a"]], "column_types": ["text", "number"], "primary_keys": [[1, 2], 1], "foreign_keys": [[1, 2]]}) + "\nnot json\n")
    c = loaders.load_catalog(spark, str(tmp_path / "c.jsonl"))
    assert [tuple(r) for r in c["column"].orderBy("column_idx").select("column_idx", "table_idx", "column_name", "label", "type").collect()] == [
        (0, -1, "*", "*", "text"), (1, 0, "A", "a", "number"), (2, 0, "B", None, None)]
    assert sorted(r.column_idx for r in c["pk"].collect()) == [1, 1, 2] and [tuple(r) for r in c["fk"].collect()] == [("d", 1, 2)]
    (tmp_path / "db1").mkdir()
    (tmp_path / "db1" / "Tab.csv").write_bytes("﻿original_column_name,n,column_description\nA,1, first \nb,2,\"two\nlines\"\n ,3,none\nA,4,last\n".encode())
    (tmp_path / "db1" / "other.csv").write_text("column_description,original_column_name\nturned,C\n")
    docs = {(r.db_id, r.table_name, r.column_name): r.description for r in loaders.load_column_docs(spark, str(tmp_path / "db1")).collect()}
    assert docs == {("db1", "tab", "a"): "last", ("db1", "tab", "b"): "two\nlines", ("db1", "other", "c"): "turned"}
    (tmp_path / "e.jsonl").write_text('{"question_id":7,"db_id":"x"}\n{"question_id":8,"db_id":"y"}\n')
    (tmp_path / "l.jsonl").write_text('{"t":["a"],"u":null}\n{}\n{"v":["b"]}\n')
    rows = loaders.load_linking(spark, str(tmp_path / "e.jsonl"), str(tmp_path / "l.jsonl")).orderBy("line_no", "table_name").collect()
    assert [(r.line_no, r.example_id, r.status, r.mismatch, r.table_name, r.columns) for r in rows] == [
        (0, 7, "paired", 1, "t", ["a"]), (0, 7, "paired", 1, "u", None), (1, 8, "paired", 1, None, None), (2, None, "no_example", 1, "v", ["b"])]


def test_graph_record_order_and_unknown_databases(spark):
    asked = spark.createDataFrame([(1, "d", "abcdef"), (2, "gone", "x"), (3, "d", "y")], "example_id long, db_id string, question string")
    matches = spark.createDataFrame([(1, "d", 2, 4, "table", 0), (1, "d", 0, 1, "table", 9), (1, "d", 2, 4, "table", 0)], "example_id long, db_id string, char_start int, char_end int, kind string, idx long")
    ct = spark.createDataFrame([("d", 0, "T")], "db_id string, table_idx long, table_name string")
    cc = spark.createDataFrame([("d", 1, 0, "A b", "a b", "int")], "db_id string, column_idx long, table_idx long, column_name string, label string, type string")
    none = spark.createDataFrame([], "db_id string, column_idx long")
    fk = spark.createDataFrame([], "db_id string, from_idx long, to_idx long")
    from errata.operators import graph

    nodes, edges, items = graph.graph_nodes(ct, cc), graph.graph_edges(ct, cc, none, fk), entities.schema_items(ct, cc)
    linked = entities.entity_edges(matches, items, nodes)
    got = {r.example_id: r for r in entities.graph_records(asked, nodes, edges, entities.entity_nodes(asked, matches), linked, ct).collect()}
    assert set(got) == {1, 3} and [n.id for n in got[1].nodes] == ["t", "t.a_b", "q_ent_1", "q_ent_2"] and [n.label for n in got[1].nodes][2:] == ["a", "cd"]
    assert [(e.src, e.tgt, e.rel) for e in got[1].edges][-1] == ("q_ent_2", "t", "relates_to_table") and len(got[3].edges) == 2


def test_corpus_statistics(spark):
    rows = [("rule_based", "soft_error", ["a", "b"]), ("rule_based", "hard_error", ["a"]), ("llm_assisted", "verified", [])]
    got = {(r.dimension, r.value): r.n for r in synth.corpus_stats(spark.createDataFrame(rows, "synthesis_method string, validation_status string, error_types array<string>")).collect()}
    assert got == {("method", "rule_based"): 2, ("method", "llm_assisted"): 1, ("status", "soft_error"): 1, ("status", "hard_error"): 1, ("status", "verified"): 1,
                   ("error_type", "a"): 2, ("error_type", "b"): 1}
    assert corpus.SAMPLE_COLS[0] == "example_id"
