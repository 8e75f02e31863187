"""What a change picks is computed once and read by the description and the changed parts."""

from __future__ import annotations

from errata.operators import synth as H

PARTS = "example_id long, db_id string, depth int, clause string, pos long, func string, tbl string, col string, op string, val string, val_type string, is_desc boolean"


def test_targets_are_written_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(H, "materialize", lambda df, name: made.append(name) or df, raising=False)
    parts = spark.createDataFrame([(1, "d", 0, "select", 0, None, "t", "a", None, None, None, None), (1, "d", 0, "from", 0, None, "t", None, None, None, None, None)], PARTS)
    columns = spark.createDataFrame([("d", 0, "t", 1, "a"), ("d", 1, "u", 2, "b")], "db_id string, table_idx int, table_name string, column_idx int, column_name string")
    tables = columns.select("db_id", "table_name")
    for change, over in ((H.attribute_redundancy, columns), (H.attribute_mismatch, columns), (H.table_redundancy, tables), (H.table_mismatch, tables)):
        rows = H.render_sql(change(parts, over)).select("description", "sql").collect()
        assert len(rows) == 1 and ("'b'" in rows[0].description or "'u'" in rows[0].description)
    assert made == ["h1-chosen", "h3-chosen", "h4-chosen", "h6-chosen"]  # before: computed at each of three mentions
