"""Prompts as tables.

All prose is input: ``texts`` (name, text) has the frames, with their blanks in
braces, ``examples`` and ``templates`` a row per error type.  A frame's blanks are
filled in one pass, so that braces in a value stay as they are.  Frames are
scalar subqueries; the other tables are joined by error type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from errata.functions.frames import ordered_join
from errata.functions.text import title_key
from errata.schemas import DESCRIPTIONS, PRIORITY

NO_EXAMPLE = "No reference example available."
NO_GUIDELINE = "No specific analysis available."
NO_SUBGRAPH = "Not applicable for this error type"
LAST_PRIORITY = 99


def fill(frame: Column, values: dict[str, Column]) -> Column:
    """``frame`` with every blank ``{name}`` of ``values`` filled; others stay."""
    known = F.create_map(*[x for k, v in values.items() for x in (F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))])
    pieces = F.regexp_extract_all(frame, F.lit(r"\{\w+\}|[^{]+|\{"), F.lit(0))
    # bound by a lambda: named inside the inner one, the values would be computed again for every piece
    return F.transform(F.array(known), lambda m: F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(m, p), p)), ""))[0]


def _framed(rows: DataFrame, texts: DataFrame, **names: str) -> DataFrame:
    """``rows`` with the frames ``names`` (column: name of a text); a missing text is empty."""
    frames = ", ".join(f"coalesce((SELECT max(text) FROM {{texts}} WHERE name = '{n}'), '') AS {c}" for c, n in names.items())
    return rows.sparkSession.sql(f"SELECT r.*, {frames} FROM {{rows}} r", rows=rows, texts=texts)


def annotation_prompts(examples: DataFrame, ddl: DataFrame, texts: DataFrame) -> DataFrame:
    """(example_id, system, user).  ``examples``: (example_id, db_id, question,
    evidence, predicted_sql, gold_sql); ``ddl``: (db_id, ddl).  The blank
    ``{evidence}`` is a line of its own, or nothing without evidence."""
    rows = _framed(examples.join(ddl, "db_id", "left"), texts, system="annotation_system", _user="annotation_user")
    evidence = F.when(F.coalesce("evidence", F.lit("")) != "", F.concat(F.lit("Evidence: "), "evidence", F.lit("\n"))).otherwise("")
    return rows.select("example_id", "system", fill(F.col("_user"), {
        "schema": F.col("ddl"), "question": F.col("question"), "evidence": evidence, "predicted": F.col("predicted_sql"), "gold": F.col("gold_sql")}).alias("user"))


def localization_prompts(samples: DataFrame, errors: DataFrame, templates: DataFrame, texts: DataFrame) -> DataFrame:
    """(example_id, prompt).  ``samples``: (example_id, question, sql, ast);
    ``errors``: (example_id, pos, error_type); ``templates``: (error_type, template).
    ``{errors}`` is a numbered line of each error's description, ``{fields}`` a line
    of the template's blanks for each type that has a template."""
    described = F.create_map(*[F.lit(x) for kv in DESCRIPTIONS.items() for x in kv])
    asked = errors.join(templates, "error_type", "left").select("example_id", "pos", F.concat_ws(
        ": ", "error_type", described[F.col("error_type")]).alias("line"), "error_type", F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), 1).alias("blanks"))
    fields = F.concat(F.col("error_type"), F.lit(": "), F.array_join("blanks", ", "))
    lists = asked.groupBy("example_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"),
        F.array_sort(F.collect_list(F.when(F.size("blanks") > 0, F.struct(F.col("pos"), fields.alias("line"))))).alias("fields"))
    numbered = F.array_join(F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n")
    rows = _framed(samples.join(lists, "example_id"), texts, _frame="localization")
    return rows.select("example_id", fill(F.col("_frame"), {
        "question": F.col("question"), "sql": F.col("sql"), "ast": F.col("ast"), "errors": numbered,
        "fields": F.array_join(F.transform("fields", lambda x: x["line"]), "\n")}).alias("prompt"))


def few_shot_lookup(errors: DataFrame, examples: DataFrame) -> DataFrame:
    """``errors`` with ``few_shot``, their type's example; ``examples``:
    (error_type, wrong_sql, error_description, fixed_sql), one row per type."""
    text = F.concat(F.lit("- Wrong: `"), "wrong_sql", F.lit("`\n- Error: "), "error_description", F.lit("\n- Fixed: `"), "fixed_sql", F.lit("`"))
    known = examples.select("error_type", text.alias("few_shot"))
    return errors.join(known, "error_type", "left").withColumn("few_shot", F.coalesce("few_shot", F.lit(NO_EXAMPLE))).select(*errors.columns, "few_shot")


def repair_prompts(samples: DataFrame, contexts: DataFrame, texts: DataFrame) -> DataFrame:
    """(example_id, prompt) of the samples with errors.  ``samples``:
    (example_id, sql); ``contexts``: (example_id, pos, error_type, subtree, subgraph,
    guideline MAP, few_shot).  Blocks stand by repair priority, then position."""
    priority = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    guideline = F.array_join(F.transform(F.map_entries("guideline"), lambda e: F.concat(F.lit("- **"), title_key(e["key"]), F.lit("**: "), F.coalesce(e["value"], F.lit("")))), "\n")
    cells = contexts.select("example_id", F.struct(
        F.coalesce(priority[F.col("error_type")], F.lit(LAST_PRIORITY)).alias("priority"), "pos", "error_type", "subtree",
        F.when(F.coalesce("subgraph", F.lit("")) != "", F.col("subgraph")).otherwise(NO_SUBGRAPH).alias("subgraph"),
        F.when(F.size("guideline") > 0, guideline).otherwise(NO_GUIDELINE).alias("guideline"), "few_shot").alias("c"))
    grouped = samples.join(cells.groupBy("example_id").agg(F.array_sort(F.collect_list("c")).alias("blocks")), "example_id")
    rows = _framed(grouped, texts, _frame="repair", _block="repair_block")
    block = lambda c, i: fill(F.col("_block"), {"number": i + 1, **{n: c[n] for n in ("error_type", "subtree", "subgraph", "guideline", "few_shot")}})
    return rows.select("example_id", fill(F.col("_frame"), {"sql": F.col("sql"), "errors": F.array_join(F.transform("blocks", block), "\n")}).alias("prompt"))
