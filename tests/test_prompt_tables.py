"""Hand tables for prompts, localizations, outcomes and fine-tuning rows."""

from pyspark.sql import functions as F

from errata.operators import context, prompting, prompts, training


def texts(spark, **rows):
    return spark.createDataFrame(list(rows.items()), "name string, text string")


def test_frames_are_filled_once(spark):
    df = spark.createDataFrame([("a {x} {y} {z} { {x}", "{y}", None)], "frame string, x string, y string")
    assert df.select(prompting.fill(F.col("frame"), {"x": F.col("x"), "y": F.col("y")})).first()[0] == "a {y}  {z} { {y}"


def test_repair_blocks_by_priority(spark):
    samples = spark.createDataFrame([(1, "S {errors}"), (2, "T")], "example_id long, sql string")
    rows = [(1, 0, "Value Mismatch", "t0", None, '{"old_part":"x","fix":null}', "f"), (1, 1, "Table Missing", "t1", "g", None, "f"), (1, 2, "Odd", "t2", "", "{}", "f")]
    contexts = spark.createDataFrame(rows, "example_id long, pos int, error_type string, subtree string, subgraph string, guideline string, few_shot string")
    contexts = contexts.withColumn("guideline", F.from_json("guideline", "map<string,string>"))  # in the text's order
    t = texts(spark, repair="{sql}|{errors}", repair_block="{number} {error_type} {subtree} {subgraph} {guideline}")
    (r,) = prompting.repair_prompts(samples, contexts, t).collect()
    none, blank = prompting.NO_SUBGRAPH, prompting.NO_GUIDELINE
    assert r.prompt == f"S {{errors}}|1 Table Missing t1 g {blank}\n2 Value Mismatch t0 {none} - **Old Part**: x\n- **Fix**: \n3 Odd t2 {none} {blank}"


def test_annotation_prompts_with_and_without_evidence(spark):
    rows = [(1, "d", "q", "e", "p", "g"), (2, "x", "q", "", "p", "g"), (3, "d", None, None, "p", "g")]
    ex = spark.createDataFrame(rows, "example_id long, db_id string, question string, evidence string, predicted_sql string, gold_sql string")
    ddl = spark.createDataFrame([("d", "CREATE")], "db_id string, ddl string")
    got = {r.example_id: (r.system, r.user) for r in prompting.annotation_prompts(ex, ddl, texts(spark, annotation_user="{schema}/{question}\n{evidence}{predicted}")).collect()}
    assert got == {1: ("", "CREATE/q\nEvidence: e\np"), 2: ("", "/q\np"), 3: ("", "CREATE/\np")}


def test_localizations_and_placeholders(spark):
    done = spark.createDataFrame([(1, '{"analyses":[{"error_type":"A","located_nodes":["n"]},{}]}'), (2, "no"), (3, "[1]"), (4, "{}"), (5, None)], "example_id long, text string")
    errors = spark.createDataFrame([(1, 0, "X"), (2, 0, "X"), (2, 1, "Y"), (3, 0, "Z"), (5, 0, "N")], "example_id long, pos int, error_type string")
    got = sorted((r.example_id, r.pos, r.error_type, r.located, dict(r.guideline)) for r in prompts.parse_localizations(done, errors).collect())
    failed = {"error": "Failed to parse LLM response"}
    assert got == [(1, 0, "A", ["n"], {}), (1, 1, "", [], {}), (2, 0, "X", [], failed), (2, 1, "Y", [], failed), (3, 0, "Z", [], failed), (5, 0, "N", [], failed)]


def test_outcomes(spark):
    samples = spark.createDataFrame([(1, "a", " <no_error> "), (2, "b", "<error_1>"), (3, "c", "<error_1>"), (4, "d", "<error_2>"), (5, "e", "text")], "example_id long, sql string, output string")
    calls = spark.createDataFrame([(1, "SELECT 9", None), (2, "```sql\nSELECT 1\n```", None), (3, None, "timeout")], "example_id long, text string, error string")
    got = {r.example_id: (r.refined_sql, r.success, r.error_message) for r in prompts.refinement_results(samples, calls).collect()}
    assert got == {1: ("a", True, None), 2: ("SELECT 1", True, None), 3: ("c", False, "timeout"), 4: ("d", False, "no completion"), 5: ("e", True, None)}


def test_subgraph_sections(spark):
    graphs = spark.createDataFrame([(1, " t.A x\nu.b", "T.a foreign_key_to u.b;" + ";".join(f" q_ent_{k} relates_to_table t{k}" for k in range(7)))], "example_id long, nodes_text string, edges_text string")
    asked = spark.createDataFrame([(1, 0, "Attribute Mismatch", ["T.a", "t"]), (1, 1, "Value Mismatch", ["zz"]), (1, 2, "Table Missing", None), (1, 3, "Function Error", ["t"])],
                                  "example_id long, pos int, error_type string, elements array<string>")
    got = {r.pos: r.subgraph for r in context.error_subgraphs(graphs, asked).collect()}
    assert got[0].split("\n") == ["**Relevant Columns**:", "- t.A x", "", "**Relevant Tables**:", "- t", "", "**Foreign Key Relationships**:", "- T.a foreign_key_to u.b", "",
                                  "**Question-Schema Mappings**:", *[f"- q_ent_{k} relates_to_table t{k}" for k in range(5)]]
    assert got[1] == "\n**Relevant Tables**:\n- zz" and got[2].startswith("Not applicable") and 3 not in got


def test_fine_tuning_rows_read_back(spark):
    ex = spark.createDataFrame([(1, "d", "q?", None, "SELECT 1"), (2, "d", "r?", "e", "SELECT 2")], "example_id long, db_id string, question string, evidence string, predicted_sql string")
    asts = spark.createDataFrame([(1, "Node[0] | select | select")], "example_id long, ast string")
    graphs = spark.createDataFrame([(2, "n1\nn2", "a;b")], "example_id long, nodes_text string, edges_text string")
    ran = spark.createDataFrame([(1, True, None, ["x"]), (1, True, None, ["y"]), (2, False, "timeout", None)], "example_id long, ok boolean, error string, row array<string>")
    found = spark.createDataFrame([(2, 1, "b", "m1"), (2, 0, "a", "m0")], "example_id long, seq int, error_label string, message string")
    inputs = training.detector_input(ex, asts, graphs, ran, found)
    labels = spark.createDataFrame([(1, "modifier_error"), (1, "table_missing"), (1, "table_missing"), (2, "nothing")], "example_id long, error_label string")
    rows = training.finetune_rows(inputs, labels)
    assert {r.example_id: r.output for r in rows.collect()} == {1: "<error_6><error_12>", 2: "<no_error>"}
    parts = {(r.example_id, r.section): r.content for r in prompts.split_sections(rows, "example_id", "input").collect()}
    assert parts[1, "question"] == "q?" and parts[1, "execution"] == "rows: 2" and parts[2, "execution"] == "error: timeout" and parts[2, "nodes"] == "n1\nn2"
    assert parts[2, "rule_based"] == "a: m0\nb: m1" and parts[1, "rule_based"] == "none" and parts[1, "sql"] == "SELECT 1" and parts[1, "external_knowledge"] == ""
    assert len([k for k in parts if k[0] == 1]) == 9


def test_rich_catalog_defaults(spark, tmp_path):
    from errata.sources import loaders

    (tmp_path / "c.jsonl").write_text('{"db_id":"d","tables":{"z":{"fields":{"b":{"type":"INT","primary_key":true},"a":{}}},"y":{}},"foreign_keys":[["z","b","","y","k"]]}\n{"db_id":"e"}\nno\n')
    fields, keys = loaders.load_rich_catalog(spark, str(tmp_path))
    got = [(r.table_idx, r.table_name, r.ordinal, r.field_name, r.type, r.primary_key, r.nullable, r.comment, r.examples) for r in fields.orderBy("table_idx", "ordinal").collect()]
    assert got == [(0, "z", 0, "b", "INT", True, True, "", []), (0, "z", 1, "a", "", False, True, "", [])]
    assert [tuple(r.key) for r in keys.collect()] == [("z", "b", "", "y", "k")]
