"""Prompt and completion tables (I2, I4-I7, I12-I14): text in, text out;
the model call itself is outside."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from errata.functions.text import strip_ws
from errata.operators.names import normalize_labels
from errata.schemas import DISPLAY_NAMES, PRIORITY

# Section headers of detector inputs and their keys.
SECTION_HEADERS = [
    ("[Question]", "question"), ("[External Knowledge]", "external_knowledge"),
    ("[Question-Schema Structure]", "schema"), ("[Nodes]", "nodes"), ("[Edges]", "edges"),
    ("[Predicted SQL]", "sql"), ("[SQL Abstract Syntax Tree]", "ast"),
    ("[Rule-based Detection Results]", "rule_based"), ("[Execution Results]", "execution"),
]


def split_sections(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """Split bracketed sections: a header opens a section at line start,
    the header's own line is dropped, content runs to the next header and is
    trimmed; text before the first header belongs to no section; when a
    section repeats, the last one wins.  Returns (key, section, content)."""
    lines = df.select(key, F.posexplode(F.split(F.col(text_col), "\n")).alias("ln", "line"))
    sec = None
    for h, name in SECTION_HEADERS:
        c = F.col("line").startswith(h)
        sec = F.when(c, F.lit(name)) if sec is None else sec.when(c, F.lit(name))
    lines = lines.withColumn("hdr", sec)
    w = Window.partitionBy(key).orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("start", F.max(F.when(F.col("hdr").isNotNull(), F.col("ln"))).over(w))
    heads = lines.where(F.col("hdr").isNotNull()).select(key, F.col("ln").alias("start"), F.col("hdr").alias("section"))
    body = lines.where(F.col("hdr").isNull() & F.col("start").isNotNull())
    content = body.groupBy(key, "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda s: s["line"]), "\n")
        .alias("content"))
    secs = heads.join(content, [key, "start"], "left").select(
        key, "section", "start", strip_ws(F.coalesce("content", F.lit(""))).alias("content"))
    last = secs.groupBy(key, "section").agg(F.max_by("content", "start").alias("content"))
    return last


def parse_error_tokens(df: DataFrame, text_col: str) -> DataFrame:
    """``<no_error>`` (alone, after trimming) -> no tokens; else every
    ``<error_n>`` in order, duplicates kept.  Adds tokens ARRAY<STRING>."""
    t = F.col(text_col)
    toks = F.regexp_extract_all(t, F.lit(r"(<error_\d+>)"), 1)
    return df.withColumn("tokens", F.when(strip_ws(t) == "<no_error>", F.array().cast("array<string>"))
                         .otherwise(toks))


def ordered_errors(tokens: DataFrame, key: str) -> DataFrame:
    """Known tokens only, stable-sorted by repair priority (99 when
    unlisted), numbered ``i. Name: description``; none -> ``No errors
    detected.``  ``tokens``: (key, tokens ARRAY<STRING>)."""
    from errata.schemas import DESCRIPTIONS

    names = F.create_map(*[x for k, n in enumerate(DISPLAY_NAMES, 1) for x in (F.lit(f"<error_{k}>"), F.lit(n))])
    prio = F.create_map(*[x for n in DISPLAY_NAMES for x in (F.lit(n), F.lit(PRIORITY.get(n, 99)))])
    desc = F.create_map(*[x for n in DISPLAY_NAMES for x in (F.lit(n), F.lit(DESCRIPTIONS[n]))])
    e = tokens.select(key, F.posexplode_outer("tokens").alias("pos", "tok"))
    e = e.withColumn("name", names[F.col("tok")]).where(F.col("name").isNotNull())
    e = e.withColumn("prio", F.coalesce(prio[F.col("name")], F.lit(99)))
    w = Window.partitionBy(key).orderBy("prio", "pos")
    e = e.withColumn("i", F.row_number().over(w))
    e = e.withColumn("line", F.format_string("%d. %s: %s", F.col("i"), F.col("name"), desc[F.col("name")]))
    lines = e.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))),
                                                        lambda s: s["line"]), "\n").alias("display"))
    return (tokens.select(key).join(lines, key, "left")
            .select(key, F.coalesce("display", F.lit("No errors detected.")).alias("display")))


def extract_sql(df: DataFrame, text_col: str) -> DataFrame:
    """SQL from a completion: the first ```sql fence (any case), else any
    fence, else from the first ``SELECT`` to the first blank line, else the
    trimmed text."""
    t = F.col(text_col)
    fence_sql = F.regexp_extract(t, r"(?is)```sql\s*(.*?)\s*```", 1)
    has_sql = t.rlike(r"(?is)```sql\s*(.*?)\s*```")
    fence = F.regexp_extract(t, r"(?s)```\s*(.*?)\s*```", 1)
    has_fence = t.rlike(r"(?s)```\s*(.*?)\s*```")
    sel = strip_ws(F.regexp_extract(t, r"(?is)(SELECT\s+.*)", 1))
    has_sel = t.rlike(r"(?is)(SELECT\s+.*)")
    sel_cut = F.substring_index(sel, "\n\n", 1)
    out = (F.when(has_sql, strip_ws(fence_sql)).when(has_fence, strip_ws(fence))
           .when(has_sel, sel_cut).otherwise(strip_ws(t)))
    return df.withColumn("sql", out)


ANNOTATION_SCHEMA = "struct<error_types:array<string>,refined_sql:string,explanation:string>"


def parse_annotations(df: DataFrame, text_col: str) -> DataFrame:
    """Parse an annotation completion; reject invalid JSON, an empty
    refined query, a missing/empty type list, or no known type after label
    normalisation.  Adds (ok, reason, error_types, refined_sql, explanation)."""
    j = df.withColumn("_j", F.from_json(F.col(text_col), ANNOTATION_SCHEMA))
    j = normalize_labels(j.withColumn("_types", F.coalesce(F.col("_j.error_types"), F.array().cast("array<string>"))),
                         "_types")
    reason = (F.when(F.expr(f"try_parse_json({text_col})").isNull(), "invalid_json")
              .when(F.coalesce(F.col("_j.refined_sql"), F.lit("")) == "", "empty_refined_sql")
              .when(F.col("_j.error_types").isNull() | (F.size("_j.error_types") == 0), "no_error_types")
              .when(F.col("rejected"), "no_valid_error_types"))
    return j.select(*df.columns, reason.isNull().alias("ok"), reason.alias("reason"),
                    F.when(reason.isNull(), F.col("labels")).alias("error_types"),
                    F.col("_j.refined_sql").alias("refined_sql"), F.col("_j.explanation").alias("explanation"))


def flagged_samples(df: DataFrame, output_col: str, order_col: str, limit: int | None = None) -> DataFrame:
    """Samples whose detector output, white space at its ends aside, is
    not ``<no_error>``; a falsy limit keeps them all, else the first ``limit``
    in input order."""
    f = df.where(F.regexp_replace(output_col, r"^\s+|\s+$", "") != "<no_error>")
    return f.orderBy(order_col).limit(limit) if limit else f


LOCALIZATION_SCHEMA = ("struct<analyses:array<struct<error_type:string,located_nodes:array<string>,involved_elements:array<string>,"
                       "filled_guideline:map<string,string>>>>")


def parse_localizations(completions: DataFrame, errors: DataFrame) -> DataFrame:
    """I4: a localization completion's analyses, in order.

    ``completions``: (example_id, text); ``errors``: (example_id, pos, error_type).
    Absent fields are empty.  A text that is no JSON object gives one placeholder
    per error of its example instead.  Returns (example_id, pos, error_type,
    located, elements, guideline)."""
    none, blank = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    read = completions.select("example_id", F.from_json("text", LOCALIZATION_SCHEMA).alias("j"),
                              F.coalesce(F.expr("schema_of_variant(try_parse_json(text))").startswith("OBJECT"), F.lit(False)).alias("ok"))
    found = read.where("ok").select("example_id", F.posexplode("j.analyses").alias("pos", "a")).select(
        "example_id", "pos", F.coalesce("a.error_type", F.lit("")).alias("error_type"), F.coalesce("a.located_nodes", none).alias("located"),
        F.coalesce("a.involved_elements", none).alias("elements"), F.coalesce("a.filled_guideline", blank).alias("guideline"))
    failed = errors.join(read.where("NOT ok").select("example_id"), "example_id", "left_semi").select(
        "example_id", F.col("pos").cast("int").alias("pos"), "error_type", none.alias("located"), none.alias("elements"),
        F.create_map(F.lit("error"), F.lit("Failed to parse LLM response")).alias("guideline"))
    return found.unionByName(failed)


def refinement_results(samples: DataFrame, completions: DataFrame) -> DataFrame:
    """The outcome of each sample's repair.

    ``samples``: (example_id, sql, output), the detector's output; ``completions``:
    (example_id, text, error), at most one per example.  Without errors to
    repair the query passes as it is; a call that failed, or none, keeps it with
    the error's text; else the completion's query stands.  Returns (example_id,
    original_sql, refined_sql, success, error_message, detected_errors)."""
    told = extract_sql(completions.select("example_id", "text", "error"), "text").select("example_id", "text", "error", F.col("sql").alias("made"))
    judged = parse_error_tokens(samples.select("example_id", "sql", "output"), "output").join(told, "example_id", "left")
    passes = F.size("tokens") == 0
    failed = ~passes & F.col("text").isNull()
    return judged.select("example_id", F.col("sql").alias("original_sql"), F.when(passes | failed, F.col("sql")).otherwise(F.col("made")).alias("refined_sql"),
                         (~failed).alias("success"), F.when(failed, F.coalesce("error", F.lit("no completion"))).alias("error_message"),
                         F.col("output").alias("detected_errors"))
