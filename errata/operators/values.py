"""Linking questions to the values of their database.

Each text column's distinct values are written once.  A value matches a run of
a question's words when twice their longest common subsequence is at least
``RATIO`` of their lengths' sum.  That bounds the letters that differ, so a
value cut into one segment more than these must have a segment that stands
unchanged, and shifted by no more, in the run: values are indexed by (length,
first letter, segment), and runs look up the segments that a partner of each
possible length could share with them.  Every distinct (run, value) that meets
there is scored once, whatever the number of questions it occurs in; no
question is paired with a value otherwise.

A match counts only if the value's longest common substring with the whole
question points to that run: it must start at a word or right after a
separator, and end at most two letters before the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from errata.operators.linking import DEFAULT_STOP_WORDS
from errata.session import materialize

# Separators of words in questions and values, words that count
# only when matched exactly, and a database term that never counts.
SEPARATORS = "'\"()`,.?! "
COMMON_WORDS = ["no", "yes", "many"]
DATABASE_TERMS = ["id"]
MAX_PER_COLUMN = 4
# the least ratio, 0.85, as 2 * 17 / 40: integer tests only
RATIO_OF, RATIO_TO = 17, 40

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|infinity|nan)$"


def picklists(frames: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, value), the distinct values of every text
    column; binary values are read as UTF-8, else as Latin-1; nulls are no values.

    One scan per table, whatever its number of text columns; copies are dropped
    before the shuffle."""
    out = None
    for name, df in frames.items():
        cells = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            if isinstance(f.dataType, T.BinaryType):
                c = F.coalesce(F.expr(f"try_validate_utf8(CAST(`{f.name}` AS string))"), F.decode(c, "ISO-8859-1"))
            elif not isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType)):
                continue
            cells.append(F.struct(F.lit(f.name).alias("column_name"), c.cast("string").alias("value")))
        if cells:
            rows = df.select(F.lit(name).alias("table_name"), F.inline(F.array(*cells))).where("value IS NOT NULL")
            out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def _least_common(a: str, b: str) -> str:
    """SQL for the shortest common subsequence of a match of lengths ``a`` and ``b``."""
    return f"(({RATIO_OF} * ({a} + {b}) + {RATIO_TO - 1}) div {RATIO_TO})"


def _sets(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


SEPS = _sets(SEPARATORS)


def word_runs(questions: DataFrame, text: str, longest: int) -> DataFrame:
    """(text, run) for every distinct run of whole words up to ``longest`` letters."""
    sep = lambda i: f"instr({SEPS}, substr({text}, {i}, 1)) > 0"
    marked = questions.select(text).distinct().selectExpr(
        text, f"filter(sequence(1, length({text})), i -> NOT {sep('i')} AND (i = 1 OR {sep('i - 1')})) AS starts",
        f"filter(sequence(1, length({text})), i -> NOT {sep('i')} AND (i = length({text}) OR {sep('i + 1')})) AS ends").where("size(starts) > 0")
    runs = marked.select(text, "ends", F.explode("starts").alias("lo")).selectExpr(
        text, "lo", f"explode(filter(ends, e -> e >= lo AND e - lo < {longest})) AS hi")
    return runs.selectExpr(text, f"substr({text}, lo, hi - lo + 1) AS run").distinct()


def value_index(values: DataFrame) -> DataFrame:
    """(norm) -> (norm, length, first, part, segment): the segments of each value."""
    most = f"""array_max(transform(sequence(({RATIO_OF} * a + {RATIO_TO - RATIO_OF - 1}) div {RATIO_TO - RATIO_OF}, ({RATIO_TO - RATIO_OF} * a) div {RATIO_OF}),
               b -> a + b - 2 * {_least_common('a', 'b')}))"""
    cut = values.selectExpr("norm", "length(norm) AS a", "first").selectExpr("*", f"greatest({most}, 0) + 1 AS k")
    parts = cut.selectExpr("norm", "a", "first", "k", "explode(sequence(0, k - 1)) AS part")
    return parts.selectExpr("norm", "a AS length", "first", "part", "substr(norm, (part * a) div k + 1, ((part + 1) * a) div k - (part * a) div k) AS segment")


def run_lookups(runs: DataFrame, values: DataFrame) -> DataFrame:
    """(run) -> (run, length, first, part, segment): the segments under which a
    matching value is found, of each possible length that a value with the
    run's first letter has."""
    short, long = f"({RATIO_OF} * b + {RATIO_TO - RATIO_OF - 1}) div {RATIO_TO - RATIO_OF}", f"({RATIO_TO - RATIO_OF} * b) div {RATIO_OF}"
    most = f"""array_max(transform(sequence(({RATIO_OF} * a + {RATIO_TO - RATIO_OF - 1}) div {RATIO_TO - RATIO_OF}, ({RATIO_TO - RATIO_OF} * a) div {RATIO_OF}),
               x -> a + x - 2 * {_least_common('a', 'x')}))"""
    shapes = values.select("first", F.length("norm").alias("a")).distinct()
    sized = runs.selectExpr("run", "length(run) AS b", "substr(run, 1, 1) AS first").selectExpr(
        "run", "first", "b", f"explode(sequence({short}, {long})) AS a").join(shapes, ["first", "a"], "left_semi").selectExpr(
        "run", "b", "a", f"greatest({most}, 0) + 1 AS k", f"{_least_common('a', 'b')} AS common")
    parts = sized.selectExpr("*", "explode(sequence(0, k - 1)) AS part").selectExpr(
        "*", "(part * a) div k AS at", "((part + 1) * a) div k - (part * a) div k AS size")
    # letters that the value lacks shift a segment right, those that the run lacks left
    moved = parts.selectExpr("run", "a", "part", "size", "b", "explode(sequence(at - (a - common), at + (b - common))) AS at").where(
        "at >= 0 AND at + size <= b")
    return moved.selectExpr("run", "a AS length", "substr(run, 1, 1) AS first", "part", "substr(run, at + 1, size) AS segment").distinct()


def common_subsequence(a: str, b: str) -> str:
    """SQL for the length of the longest common subsequence: one row of the
    usual table per letter of ``a``."""
    return f"""element_at(aggregate(sequence(1, length({a})), array_repeat(0, length({b}) + 1), (row, i) ->
        aggregate(sequence(1, length({b})), array(0), (now, j) -> concat(now, array(
            CASE WHEN substr({a}, i, 1) = substr({b}, j, 1) THEN row[j - 1] + 1 ELSE greatest(row[j], now[j - 1]) END)))), -1)"""


def scored_runs(runs: DataFrame, values: DataFrame) -> DataFrame:
    """(run, norm, common) of all pairs within the ratio that share their first letter."""
    met = run_lookups(runs, values).join(value_index(values), ["length", "first", "part", "segment"]).select("run", "norm").distinct()
    near = _spread(met, "run", "norm").where(f"levenshtein(run, norm, length(run) + length(norm) - 2 * {_least_common('length(run)', 'length(norm)')}) >= 0")
    return near.withColumn("common", F.expr(f"explode(array(CASE WHEN run = norm THEN length(run) ELSE {common_subsequence('run', 'norm')} END))")).where(
        f"{RATIO_TO} * common >= {RATIO_OF} * (length(run) + length(norm))")


def _trim_set() -> str:
    return "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Small rows ahead of costly expressions: as many tasks as the shuffle
    setting has, not as few as their bytes would give."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def located(pairs: DataFrame, text: str) -> DataFrame:
    """``pairs`` (text, norm, ...) with ``size``, ``said`` (the longest common
    substring's length and letters: the earliest in the question, then in the
    value) and ``source``, the run that it points to (null if none)."""
    # generators, here and for scores, so that filters above do not compute the expression again
    best = pairs.selectExpr("*", f"""explode(filter(array(array_min(flatten(transform(sequence(1, length(norm)), n ->
        filter(transform(sequence(1, length(norm) - n + 1), b -> struct(-n AS size, instr({text}, substr(norm, b, n)) AS at, b AS b)), x -> x.at > 0))))),
        x -> x IS NOT NULL)) AS m""")
    sep = lambda i: f"instr({SEPS}, substr({text}, {i}, 1)) > 0"
    # where the run starts and ends, both from 1; a separator or an edge must stand near
    edged = best.selectExpr("*", "-m.size AS size", f"substr({text}, m.at, -m.size) AS said").selectExpr(
        "*", f"CASE WHEN {sep('m.at')} THEN m.at WHEN m.at = 1 THEN 1 WHEN {sep('m.at - 1')} THEN m.at - 1 END AS lo",
        f"""get(filter(transform(sequence(m.at + size - 1, m.at + size + 2), i -> CASE WHEN i > length({text}) THEN length({text}) WHEN {sep('i')} THEN i END),
            i -> i IS NOT NULL), 0) AS hi""")
    cut = edged.selectExpr("*", f"CASE WHEN lo IS NOT NULL AND hi >= lo THEN trim(BOTH {SEPS} FROM substr({text}, lo, hi - lo + 1)) END AS run")
    return cut.withColumn("source", F.expr("CASE WHEN length(run) > 1 THEN run END")).drop("m", "lo", "hi", "run")


def value_links(questions: DataFrame, values: DataFrame, columns: DataFrame, stop_words: list[str] = DEFAULT_STOP_WORDS,
                per_column: int = MAX_PER_COLUMN) -> DataFrame:
    """Values of its database that a question names.

    ``questions``: (example_id, db_id, question); ``values``: E1's pick-lists;
    ``columns``: (db_id, column_idx, table_name, column_name).  Returns
    (example_id, column_idx, place, value, source, score), the ``per_column`` best
    of each column by score, match length and value.  Scores below 1 do not
    count for values in capitals, common words and columns named ``name``."""
    asked = questions.select("example_id", "db_id", F.expr(f"lower(trim(BOTH {_trim_set()} FROM question))").alias("asked"))
    texts = materialize(asked.select("asked").distinct(), "value-questions")
    known = values.select("value").distinct().withColumn("norm", F.expr(f"lower(trim(BOTH {_trim_set()} FROM value))"))
    longest = texts.agg(F.max(F.length("asked"))).first()[0] or 0
    known = materialize(known.where(f"norm <> '' AND length(norm) <= {longest} * {RATIO_TO - RATIO_OF} div {RATIO_OF}").withColumn(
        "first", F.expr(f"substr(ltrim({SEPS}, norm), 1, 1)")), "value-texts")
    runs = materialize(word_runs(texts, "asked", longest), "value-runs")
    scored = materialize(scored_runs(runs.select("run").distinct(), known.select("norm", "first").distinct()), "value-scores")

    pairs = runs.join(scored, "run").select("asked", "norm").distinct()
    found = located(_spread(pairs, "asked", "norm"), "asked").where("source IS NOT NULL").join(scored.withColumnRenamed("run", "source"), ["source", "norm"])
    stops, common = (F.array(*[F.lit(w) for w in ws]) for ws in (stop_words, COMMON_WORDS))
    said = F.expr(f"trim(BOTH {_trim_set()} FROM said)")
    whole = F.length("source") == F.col("common")
    exact = whole & (F.length("source") == F.length("norm"))
    named = lambda ws: F.arrays_overlap(F.array("m", "source", "norm"), ws)
    found = found.withColumn("m", said).where(
        (F.col("m") != "") & ~F.regexp_replace("m", ",", "").rlike(NUMBER) & ~F.col("m").isin(DATABASE_TERMS)).where(
        ~named(stops) & (exact | ~named(common)))
    matched = found.join(known.select("value", "norm"), "norm").withColumn("exact", exact).where(
        F.col("exact") | (F.upper("value") != F.col("value")) | (F.lower("value") == F.col("value")))
    matched = matched.select("asked", "value", "source", "size", "exact",
                             (2.0 * F.col("common") / (F.length("source") + F.length("norm"))).alias("score"))

    by_column = matched.join(values, "value").where(F.col("exact") | ~F.lower("column_name").contains("name"))
    order = Window.partitionBy("asked", "table_name", "column_name").orderBy(F.desc("score"), F.desc("size"), "value")
    best = materialize(by_column.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_column), "value-best")
    return (asked.join(best, "asked").join(columns, ["db_id", "table_name", "column_name"])
            .select("example_id", "column_idx", "place", "value", "source", "score"))
