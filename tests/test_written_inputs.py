"""Broadcast bound, and derivations that read the written tables."""

from __future__ import annotations

import datetime

import pytest

from errata.operators import synth as H
from errata.session import BROADCAST_BYTES, bound_broadcasts
from errata.sources import workload as W
from errata.sources.fixtures import Workload

KEYS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture
def thresholds(spark):
    before = {k: spark.conf.get(k, None) for k in KEYS}
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("given,kept", [("10485760b", BROADCAST_BYTES), ("10m", BROADCAST_BYTES), ("1GB", BROADCAST_BYTES), ("100k", "100k"), ("-1", "-1")])
def test_threshold_is_lowered_only(spark, thresholds, given, kept):
    for k in KEYS:
        spark.conf.set(k, given)
    bound_broadcasts(spark)
    for k in KEYS:
        assert spark.conf.get(k).rstrip("b") == str(kept).rstrip("b")


def test_threshold_that_nobody_set_is_lowered(spark, thresholds):
    for k in KEYS:
        spark.conf.unset(k)
    bound_broadcasts(spark)
    assert int(spark.conf.get(KEYS[0]).rstrip("b")) == BROADCAST_BYTES
    assert spark.conf.get(KEYS[1], None) is None  # it follows the first


def test_queries_bound_broadcasts(spark, thresholds, tmp_path):
    import __spark_entry__

    data(spark, tmp_path)
    spark.conf.set(KEYS[0], "10m")
    __spark_entry__.queries()["perturb_condition_missing"](spark, str(tmp_path))
    assert int(spark.conf.get(KEYS[0]).rstrip("b")) == BROADCAST_BYTES


def data(spark, path):
    day = datetime.datetime(2024, 1, 1)
    orders = [(k, k % 5, "FOP"[k % 3], 100.5 + k, day, "1-URGENT") for k in range(40)] + [(40, None, None, None, None, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, "
                          "o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    customers = [(k, f"Customer#{k}", k % 2, 1.0 * k, "BUILDING") for k in range(5)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{path}/customer.parquet")
    for t, (col, kind) in {"nation": ("n_nationkey", "int"), "part": ("p_partkey", "long")}.items():
        spark.createDataFrame([(0,), (1,)], f"{col} {kind}").write.parquet(f"{path}/{t}.parquet")
    for t in W.TABLES:
        if not (path / f"{t}.parquet").exists():
            spark.createDataFrame([(1,)], f"{t}_key long").write.parquet(f"{path}/{t}.parquet")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_derived_texts_read_the_written_tables(spark, tmp_path):
    data(spark, tmp_path)
    w = Workload(spark, str(tmp_path))
    for text in (W.ast_lines_sql(w.d), W.graph_text_sql(w.d), W.predicted_part_sql(w.d)):
        read = w.derived(text)
        assert {f.split("/")[-2].split("-")[0] for f in read.inputFiles()} == {"query_part"}
        assert rows(read) == rows(spark.sql(text))


def test_catalog_is_derived_once(spark, tmp_path):
    data(spark, tmp_path)
    w = Workload(spark, str(tmp_path))
    inline = lambda text: spark.sql(text.replace("base_column_raw", "{bcr}"), bcr=w.base_column_raw)
    for name, text in (("catalog_column", W.catalog_column_sql(w.d)), ("catalog_pk", W.catalog_pk_sql(w.d)), ("catalog_fk", W.catalog_fk_sql(w.d))):
        assert not any("customer.parquet" in f for f in w._catalog(text).inputFiles())
        assert rows(getattr(w, name)()) == rows(inline(text))


def test_changes_of_parts_alone_need_no_catalog(spark, tmp_path):
    import __spark_entry__

    data(spark, tmp_path)
    made = __spark_entry__.queries()["perturb_table_missing"](spark, str(tmp_path))
    want = H.render_sql(H.table_missing(Workload(spark, str(tmp_path)).query_part())).select(*made.columns)
    assert rows(made) == rows(want) != []
    assert not any("catalog_" in f for f in made.inputFiles())


def sources(df):
    return {f.split("/")[-2].rsplit("-", 1)[0] for f in df.inputFiles()}


def named_data(spark, path):
    data(spark, path)
    spark.createDataFrame([(0, "FRANCE", 0), (1, "PERU", 1)], "n_nationkey int, n_name string, n_regionkey int").write.mode("overwrite").parquet(f"{path}/nation.parquet")


def test_entity_queries_read_written_tables(spark, tmp_path):
    import __spark_entry__
    from errata.operators import entities as N
    from errata.operators import graph as D
    from errata.sources.fixtures import workload

    named_data(spark, tmp_path)
    made = __spark_entry__.queries()["entity_edges"](spark, str(tmp_path))
    w = workload(spark, str(tmp_path))
    assert sources(made) == {"entity_match", "schema_items", "graph_nodes"}
    assert "_linking" not in vars(w)  # this query has no linked subset
    ct, cc = w.catalog_table(), w.catalog_column()
    want = N.entity_edges(w.derived(W.entity_match_sql(w.d)), N.schema_items(ct, cc), D.graph_nodes(ct, cc))
    assert rows(made) == rows(want) != []


def test_linked_records_plan_holds_no_derivation(spark, tmp_path):
    import __spark_entry__

    named_data(spark, tmp_path)
    made = __spark_entry__.queries()["graph_records_linked"](spark, str(tmp_path))
    assert sources(made) == {"graph_example", "entity_match", "schema_items", "chosen-items", "linked-nodes", "graph_edges", "catalog_table"}
    assert made.count() > 0


def test_column_examples_are_written_once(spark, tmp_path):
    import __spark_entry__
    from errata.operators import graph as D
    from errata.sources.fixtures import workload

    named_data(spark, tmp_path)
    made = [__spark_entry__.queries()[k](spark, str(tmp_path)) for k in ("example_hygiene", "render_tables")]
    w = workload(spark, str(tmp_path))
    assert all("column_examples" in sources(m) for m in made)
    assert rows(w._made["column_examples"]) == rows(D.column_examples({t: w.table(t) for t in W.TABLES})) != []


def test_column_docs_read_each_file_once(spark, tmp_path):
    from errata.sources import loaders

    for t, text in {"a": "original_column_name,column_description\nX, first \nx,last\n", "b": "﻿column_description,original_column_name\n\"of, b\",Y\n,\n", "c": "column_description,original_column_name\n"}.items():
        (tmp_path / "d").mkdir(exist_ok=True)
        (tmp_path / "d" / f"{t}.csv").write_text(text)
    docs = loaders.load_column_docs(spark, str(tmp_path / "d"))
    assert sorted(map(tuple, docs.collect())) == [("d", "a", "x", "last"), ("d", "b", "y", "of, b")]
    assert docs._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_column_doc_files_are_written_by_all_partitions(spark, tmp_path):
    import re

    import __spark_entry__

    data(spark, tmp_path)
    spark.createDataFrame([(k * 100, f"c{k}", 0, 1.0, "X") for k in range(20)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")
    made = __spark_entry__.queries()["load_column_docs"](spark, str(tmp_path))
    files = made.inputFiles()
    assert len(files) == 20 * len(W.TABLES)
    assert len({re.search(r"part-(\d+)", f)[1] for f in files}) > int(spark.conf.get("spark.sql.shuffle.partitions")) // 2


def test_gold_lines_are_sorted_from_written_rows(spark, tmp_path, monkeypatch):
    import __spark_entry__
    from errata.plans import source_plans

    named_data(spark, tmp_path)
    kept = {}
    real = source_plans.materialize
    monkeypatch.setattr(source_plans, "materialize", lambda df, name: kept.setdefault(name, real(df, name)))
    made = __spark_entry__.queries()["load_gold_lines"](spark, str(tmp_path))
    want = [(k, r.sql, r.db_id) for k, r in enumerate(sorted(kept["gold-rows"].collect(), key=lambda r: r.example_id))]
    assert len(want) == 40 and sorted(map(tuple, made.select("example_id", "gold_sql", "db_id").collect())) == want
