"""Loaders and sinks (A1-A12): the file formats of a text-to-SQL workload read
into the engine's canonical tables with Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKAGE_SEP = "\t----- {bench} -----\t"


def catalog_snapshot(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Tables and columns of live tables as a DataFrame
    (table_name, ordinal, column_name, raw_type, table_norm, column_norm).

    Reads only schemas (metadata), never rows.  A table whose schema cannot be
    read contributes nothing, as an unreadable database gives an empty catalog."""
    rows = []
    for name, df in frames.items():
        try:
            fields = df.schema.fields
        except Exception:  # unreadable source: empty catalog, no error
            continue
        for k, f in enumerate(fields, start=1):
            rows.append((name, k, f.name, f.dataType.simpleString()))
    schema = "table_name string, ordinal bigint, column_name string, raw_type string"
    from errata.functions.text import norm

    return spark.createDataFrame(rows, schema).select(
        "*", norm(F.col("table_name")).alias("table_norm"),
        norm(F.col("column_name")).alias("column_norm"))


def load_predictions(spark: SparkSession, path: str, bench: str = "bird", whole_file: bool = False) -> DataFrame:
    """A1: JSON objects ``{"idx": "sql<TAB>----- bench -----<TAB>db"}`` ->
    prediction(example_id, db_id, predicted_sql, parse_ok).  Non-string values
    give parse_ok = false and an empty db.  Line-delimited objects (any
    number of entries per line, any number of files) are read in parallel;
    ``whole_file`` reads one pretty-printed object per file."""
    raw = spark.read.option("wholetext", "true").text(path) if whole_file else spark.read.text(path)
    m = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    sep = PACKAGE_SEP.format(bench=bench)
    from errata.operators.names import unpack_sql

    return unpack_sql(m.withColumnRenamed("v", "packed"), "packed", sep).select(
        F.col("k").cast("bigint").alias("example_id"),
        "db_id", "predicted_sql", "parse_ok")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line): the lines of text files in name order, numbered from 0
    over all of them.  A line's number is its place in its file split plus the
    lines of the splits before it (a table of one row per split)."""
    raw = spark.read.text(path).select(
        F.col("value").alias("line"), F.input_file_name().alias("_file"), F.input_file_block_start().alias("_at"),
        F.monotonically_increasing_id().alias("_row"))
    splits = raw.groupBy("_file", "_at").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    earlier = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_file", "_at", "_first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    return raw.join(splits, ["_file", "_at"]).select(
        (F.col("_before") + F.col("_row") - F.col("_first")).cast("bigint").alias("line_no"), "line")


def load_gold_lines(spark: SparkSession, path: str) -> DataFrame:
    """A2: ``sql<TAB>db`` per line, id = line number (0-based, across the
    files in name order); the database is after the last tab, a line without
    tab has an empty database."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    has_tab = line.contains("\t")
    return numbered_lines(spark, path).select(
        F.col("line_no").alias("example_id"),
        F.when(has_tab, F.regexp_extract(line, r"^(.*)\t[^\t]*$", 1)).otherwise(line).alias("gold_sql"),
        F.when(has_tab, F.regexp_extract(line, r"\t([^\t]*)$", 1)).otherwise(F.lit("")).alias("db_id"))


def load_linking(spark: SparkSession, examples_path: str, linking_path: str) -> DataFrame:
    """Linking results aligned to examples by position.

    Both files hold one JSON value per line: an example (``question_id``,
    ``db_id``), and a map of table names to lists of columns or null.  Lines are
    numbered on both sides and paired by an outer join, so that a length
    mismatch only leaves lines unpaired: the missing side's columns are null,
    and ``mismatch`` says in every row by how many lines the files differ.
    Returns (line_no, example_id, db_id, status, mismatch, table_name, columns),
    a row per table of a linking, one without table for the other lines."""
    own = numbered_lines(spark, examples_path).select("line_no", F.from_json("line", "question_id bigint, db_id string").alias("e"), F.lit(True).alias("left"))
    other = numbered_lines(spark, linking_path).select("line_no", F.from_json("line", "map<string,array<string>>").alias("links"), F.lit(True).alias("right"))
    paired = own.join(other, "line_no", "full")
    status = F.when(F.col("left").isNull(), "no_example").when(F.col("right").isNull(), "no_linking").otherwise("paired")
    rows = paired.select("line_no", F.col("e.question_id").alias("example_id"), F.col("e.db_id").alias("db_id"), status.alias("status"),
                         F.explode_outer("links").alias("table_name", "columns"))
    return spark.sql("SELECT r.*, (SELECT abs(count(left) - count(right)) FROM {paired}) AS mismatch FROM {rows} r", paired=paired, rows=rows)


def load_catalog(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A4: catalog metadata, one JSON object per line and database, into
    catalog_table(db_id, table_idx, table_name, label), catalog_column(db_id,
    column_idx, table_idx, column_name, label, type), catalog_pk(db_id, column_idx)
    and catalog_fk(db_id, from_idx, to_idx).

    The arrays mix numbers, texts and lists (``[0, "name"]``, keys ``1`` and ``[2, 3]``),
    so each object is kept as a VARIANT and its parallel arrays are exploded with
    their positions; no schema is inferred.  A line that is no JSON is no database."""
    raw = spark.read.text(path).select(F.expr("try_parse_json(value)").alias("v")).where("v IS NOT NULL")
    dbs = raw.selectExpr("variant_get(v, '$.db_id', 'string') AS db_id", "v")

    def items(array: str) -> DataFrame:
        return spark.sql(f"SELECT d.db_id, x.pos, x.value FROM {{dbs}} d, LATERAL variant_explode(variant_get(d.v, '$.{array}', 'variant')) x", dbs=dbs)

    tables = items("table_names_original").selectExpr("db_id", "CAST(pos AS bigint) AS table_idx", "CAST(value AS string) AS table_name").join(
        items("table_names").selectExpr("db_id", "CAST(pos AS bigint) AS table_idx", "CAST(value AS string) AS label"), ["db_id", "table_idx"], "left")
    columns = items("column_names_original").selectExpr(
        "db_id", "CAST(pos AS bigint) AS column_idx", "variant_get(value, '$[0]', 'bigint') AS table_idx", "variant_get(value, '$[1]', 'string') AS column_name")
    for array, value, name in (("column_names", "variant_get(value, '$[1]', 'string')", "label"), ("column_types", "CAST(value AS string)", "type")):
        columns = columns.join(items(array).selectExpr("db_id", "CAST(pos AS bigint) AS column_idx", f"{value} AS {name}"), ["db_id", "column_idx"], "left")
    keys = items("primary_keys").selectExpr("db_id", """explode(CASE WHEN startswith(schema_of_variant(value), 'ARRAY')
        THEN CAST(value AS array<bigint>) ELSE array(CAST(value AS bigint)) END) AS column_idx""")
    links = items("foreign_keys").selectExpr("db_id", "variant_get(value, '$[0]', 'bigint') AS from_idx", "variant_get(value, '$[1]', 'bigint') AS to_idx")
    return {"table": tables, "column": columns, "pk": keys, "fk": links}


DOC_COLUMNS = 16


def load_column_docs(spark: SparkSession, path: str, names: str = r"([^/]+)/([^/]+)\.csv$") -> DataFrame:
    """A5: column descriptions from many small CSV files, each with a header of
    its own order, into column_doc(db_id, table_name, column_name, description).

    The database and the table are the groups of ``names`` in a file's path.  All
    files are read at once by position, each once; a file's first row, without its
    byte order mark, names the cells of its other rows (a running window by file).
    Names are lower-cased, texts trimmed, rows without a column dropped, and of
    a column's rows the last counts.  Missing files give no rows."""
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(DOC_COLUMNS)])
    raw = spark.read.schema(schema).option("multiLine", "true").option("escape", '"').csv(path).select(
        F.array(*schema.names).alias("cells"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    own = Window.partitionBy("file").orderBy("row")
    headed = raw.withColumn("at", F.row_number().over(own)).withColumn("names", F.transform(
        F.first("cells").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), lambda c: F.trim(F.replace(c, F.lit("\ufeff"), F.lit("")))))
    cell = lambda name: F.trim(F.get("cells", (F.array_position("names", name) - 1).cast("int")))
    rows = headed.where("at > 1").select(
        "file", "row", F.lower(cell("original_column_name")).alias("column_name"), F.coalesce(cell("column_description"), F.lit("")).alias("description"))
    named = rows.where("column_name <> ''").select(
        F.regexp_extract("file", names, 1).alias("db_id"), F.lower(F.regexp_extract("file", names, 2)).alias("table_name"), "column_name", "row", "description")
    return named.groupBy("db_id", "table_name", "column_name").agg(F.max_by("description", "row").alias("description"))


EXAMPLE_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("db_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("SQL", T.StringType()),
    T.StructField("difficulty", T.StringType()),
])


def load_examples(spark: SparkSession, path: str, array_lines: bool = False) -> DataFrame:
    """A3: JSON arrays of examples with an explicit schema (never inferred): one
    array per file, or, with ``array_lines``, one per line, which Spark reads in
    parallel within a file."""
    if array_lines:
        df = spark.read.text(path).select(F.inline(F.from_json("value", T.ArrayType(EXAMPLE_SCHEMA))))
    else:
        df = spark.read.schema(EXAMPLE_SCHEMA).option("multiLine", "true").json(path)
    return df.select(
        F.col("question_id").alias("example_id"), "db_id", "question",
        F.coalesce("evidence", F.lit("")).alias("evidence"),
        F.col("SQL").alias("gold_sql"), "difficulty")


def load_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detector output in either shape (prompt/predict/label JSONL or
    input/output array) -> (prompt, predict, label)."""
    schema = "prompt string, predict string, label string, input string, output string"
    df = spark.read.schema(schema).option("multiLine", "false").json(path)
    return df.select(
        F.coalesce("prompt", "input").alias("prompt"),
        F.coalesce("predict", "output").alias("predict"),
        "label")


FIELD = "struct<type:string,primary_key:boolean,nullable:boolean,`default`:string,autoincrement:boolean,comment:string,examples:array<string>>"
RICH_CATALOG = f"struct<db_id:string,`schema`:string,tables:map<string,struct<fields:map<string,{FIELD}>>>,foreign_keys:array<array<string>>>"
FIELD_COLS = ["type", "primary_key", "nullable", "default", "autoincrement", "comment", "examples"]


def save_rich_catalog(fields: DataFrame, foreign_keys: DataFrame, path: str) -> None:
    """One JSON object per database and line, (db_id, schema, tables,
    foreign_keys); tables and fields are objects in catalog order, nulls absent.

    ``fields``: (db_id, schema, table_idx, table_name, ordinal, field_name and
    ``FIELD_COLS``); ``foreign_keys``: (db_id, ord, key ARRAY of table, column,
    schema, table, column)."""
    def ordered(by: str, name: str, value) -> Column:
        """An object of the group's rows in the order of ``by`` (maps have no order of their own)."""
        rows = F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), F.struct(name, value).alias("e"))),
                            lambda a, b: F.when(a["by"] < b["by"], -1).when(a["by"] > b["by"], 1).otherwise(0))
        return F.map_from_entries(F.transform(rows, lambda x: x["e"]))

    tables = fields.groupBy("db_id", "schema", "table_idx", "table_name").agg(ordered("ordinal", "field_name", F.struct(*FIELD_COLS).alias("f")).alias("fields"))
    dbs = tables.groupBy("db_id", "schema").agg(ordered("table_idx", "table_name", F.struct("fields").alias("t")).alias("tables"))
    keys = foreign_keys.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))), lambda x: x["key"]).alias("foreign_keys"))
    dbs.join(keys, "db_id", "left").select(F.to_json(F.struct("db_id", "schema", "tables", "foreign_keys")).alias("value")).write.mode("overwrite").text(path)


def load_rich_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What ``save_rich_catalog`` wrote, as its two tables.  Absent keys get
    defaults: empty texts and lists, no tables, no key, nullable, not counted up;
    a line that is no JSON is no database."""
    dbs = spark.read.text(path).select(F.from_json("value", RICH_CATALOG).alias("c")).where("c.db_id IS NOT NULL").select(
        "c.db_id", F.coalesce("c.schema", F.lit("")).alias("schema"), "c.tables", "c.foreign_keys")
    tables = dbs.select("db_id", "schema", F.posexplode("tables").alias("table_idx", "table_name", "t"))
    rows = tables.select("db_id", "schema", "table_idx", "table_name", F.posexplode("t.fields").alias("ordinal", "field_name", "f"))
    fallback = {"type": F.lit(""), "primary_key": F.lit(False), "nullable": F.lit(True), "default": F.lit(None).cast("string"),
                "autoincrement": F.lit(False), "comment": F.lit(""), "examples": F.array().cast("array<string>")}
    fields = rows.select("db_id", "schema", "table_idx", "table_name", "ordinal", "field_name",
                         *[F.coalesce(F.col(f"f.{c}"), d).alias(c) for c, d in fallback.items()])
    return fields, dbs.select("db_id", F.posexplode("foreign_keys").alias("ord", "key"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None) -> None:
    """Write a result table (partitioned by database when asked)."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.save(path)
