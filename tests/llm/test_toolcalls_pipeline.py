"""Operator 3 on a hand table, the pipeline, and the registered names."""

import pytest

from errata.llm import registry
from errata.llm.queries import TOOL_SCHEMAS, tool_calls
from errata.llm.toolcalls import link_tool_calls

SF = "/root/testdata/sf0.001"
CALLS = [(1, "a", 1, "search", '{"limit":2.0,"query":"xxxxxxxxxxxxxxxxxxxxxxx"}', ["b", "zz"]), (1, "b", 2, "search", '{"limit":0,"q":1}', None),
         (1, "c", 3, "nope", "{}", ["a"]), (1, "c", 4, "nope", "{}", ["a"]), (2, "x", 1, "translate", "[]", ["y"]), (2, "y", 2, "translate", None, ["x"]),
         (2, "z", 3, "translate", '{"text":"é"}', ["x"]), (2, "w", 4, "translate", '{"text":"é","lang":"xx"}', []), (3, None, 1, "search", "{}", None)]
RESULTS = [(1, "a", 2, "ok"), (1, "a", 3, "late"), (1, "q", 3, "?"), (2, "z", 9, None), (2, None, 9, "n")]


def frames(spark):
    return (spark.createDataFrame(CALLS, "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"),
            spark.createDataFrame(RESULTS, "conv_id long, call_id string, turn long, content string"),
            spark.createDataFrame(TOOL_SCHEMAS, "name string, schema string"))


def test_links_order_errors_and_json(spark):
    rows = link_tool_calls(*frames(spark)).collect()
    main = {(r.conv_id, r.call_id): r for r in rows if r.place is not None}
    assert [k for _, k in sorted((r.place, r.call_id) for r in rows if r.conv_id == 1 and r.place is not None)] == ["b", "a", "c"]
    assert main[1, "a"].status == "linked" and main[1, "a"].json == \
        '{"arguments":{"limit":2,"query":"xxxxxxxxxxxxxxxxxxxxxxx"},"id":"a","name":"search","result":"ok"}'
    assert main[1, "b"].errors == ["$.query: missing", "$.limit: below minimum", "$.q: unknown"] and main[1, "b"].status == "unanswered"
    assert main[1, "c"].errors == ["unknown tool"] and main[2, "y"].errors == ["not JSON"] and main[2, "x"].errors == ["$: not object"]
    assert {main[2, k].status for k in "xyz"} == {"cycle"} and main[2, "w"].errors == ["$.lang: not in enum"]
    rest = sorted((r.conv_id, str(r.call_id), r.turn, r.status) for r in rows if r.place is None)
    assert rest == [(1, "a", 3, "duplicate"), (1, "c", 4, "duplicate"), (1, "q", 3, "orphan"), (2, "None", 9, "unnamed"), (3, "None", 1, "unnamed")]


def test_legal_and_careless_texts_give_errors(spark):
    texts = ['{"limit":1e999}', "[" * 100_000, '{"query":"\\ud800"}', '{"limit":' + "9" * 5000 + "}", '{"text":"x","lang":true}', "{}"]
    names = ["search", "search", "search", "search", "flags", "broken"]
    calls = spark.createDataFrame([(1, f"c{k}", k, n, t, []) for k, (n, t) in enumerate(zip(names, texts))],
                                  "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>")
    extra = [("flags", '{"properties":{"lang":{"enum":[1]}}}'), ("broken", "{nope")]
    schemas = spark.createDataFrame([*TOOL_SCHEMAS, *extra], "name string, schema string")
    rows = {r.turn: r for r in link_tool_calls(calls, frames(spark)[1].where("false"), schemas).collect()}
    assert [rows[k].errors for k in range(6)] == [["number out of range"], ["nested too deeply"], ["lone surrogate"], ["number out of range"],
                                                  ["$.lang: not in enum"], ["schema is not JSON"]]
    assert not any(r.valid for r in rows.values()) and all("Infinity" not in r.json for r in rows.values())


def test_malformed_schemas():
    from errata.llm.toolcalls import judge

    assert judge("1", "[]", {}) == (1, ["schema is not an object"]) and judge("1", '{"minimum":"x"}', {}) == (1, ["schema is malformed"])
    assert judge("{}", '{"required":5}', {}) == ({}, ["schema is malformed"]) and judge(None, None, {}) == (None, ["not JSON", "unknown tool"])


def test_empty_tables(spark):
    calls, results, schemas = frames(spark)
    assert link_tool_calls(calls.where("false"), results.where("false"), schemas).count() == 0


def test_every_dependency_stands_before(spark):
    calls = [(k % 3, f"c{k}", k, "search", "{}", [f"c{(k * 7) % 40}"] if (k * 7) % 40 != k else None) for k in range(40)]
    frame = spark.createDataFrame(calls, frames(spark)[0].schema)
    got = {(r.conv_id, r.call_id): r for r in link_tool_calls(frame, *frames(spark)[1:]).collect() if r.place is not None}
    for conv, name, _, _, _, needs in calls:
        for d in needs or []:
            if (conv, d) in got and got[conv, name].status != "cycle":
                assert got[conv, d].place < got[conv, name].place


def test_the_querys_order_equals_a_plain_sort(spark):
    """Levels by walking all paths, cycles by reachability, places by sorting."""
    calls, _ = tool_calls(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    plain: dict = {}
    for r in sorted(calls.collect(), key=lambda r: (r.turn, r.name, r.arguments)):
        plain.setdefault(r.conv_id, {}).setdefault(r.call_id, r)
    want, seen = {}, set()
    for conv, own in plain.items():
        needs = {c: {d for d in r.depends_on if d in own} for c, r in own.items()}
        rise = {(d, c): int((own[d].turn, d) >= (own[c].turn, c)) for c in own for d in needs[c]}
        behind = {c: set(needs[c]) for c in own}
        for _ in own:
            behind = {c: ds.union(*(behind[d] for d in ds)) for c, ds in behind.items()}
        loops = {c for c in own if c in behind[c]}
        level = dict.fromkeys(own, 0)
        for _ in own:
            level = {c: max([0, *(level[d] + rise[d, c] for d in needs[c])]) for c in own}
        for c in own:
            if c in loops or behind[c] & loops:
                level[c] = sum(rise.values()) + 1
                seen.add("cycle")
            seen.add(min(level[c], 2))
        for place, c in enumerate(sorted(own, key=lambda c: (level[c], own[c].turn, c))):
            want[conv, c] = (place, level[c], level[c] > sum(rise.values()))
    got = registry.queries()["op3_tool_call_links"](spark, "/root/testdata/sf0.01").where("place IS NOT NULL").collect()
    assert {(r.conv_id, r.call_id): (r.place, r.level, r.status == "cycle") for r in got} == want
    assert seen == {0, 1, 2, "cycle"}


def test_one_query_per_operator():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = stage(spark, docs, SF).cache()
        docs = seen[name]
    assert seen["quality"].count() < n and seen["near_copies"].count() <= seen["quality"].count()
    assert all(seen[k].columns == columns for k in ("quality", "near_copies", "pii", "mixing"))
    assert not seen["pii"].where("text rlike '@mail[0-9]'").count()
    assert seen["packing"].where("length > 4096").count() == 0
    kept = {r.doc_id for r in seen["near_copies"].collect()}
    assert {r.doc_id for r in seen["packing"].select("doc_id").distinct().collect()} <= kept


@pytest.mark.parametrize("name", ["op3_tool_call_links", "op7_edit_recount"])
def test_free_queries_run(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
