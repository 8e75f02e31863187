"""Operator 3, tool-call linking: calls meet their results by identifier, are
put in topological order, validated and written as canonical JSON.

Linking is an equi-join on (conversation, call).  The order within a
conversation is (level, turn, call): a level starts at 0 and rises only where
a call depends on one that does not stand before it in (turn, call) order, so
conversations whose calls depend on earlier ones need no iteration.  Levels
spread over the edges round by round, only from calls whose level changed; a
level above the number of such edges of its conversation proves a cycle.
Places come from running totals over ranges, so one conversation may hold most
of all rows.

Arguments are checked against the tool's schema: ``type``, ``required``,
``properties``, ``additionalProperties``, ``enum``, ``minimum``, ``maximum``,
``minLength``, ``maxLength`` and ``items``.  Canonical JSON has sorted keys and
no spaces; integral floats are written as integers.

Defined cases: of repeated calls or results with one identifier the first by
(turn, content) counts, the others have status ``duplicate``.  A call without
a result is ``unanswered``, a result without a call ``orphan``, a call on or
behind a cycle ``cycle``.  Null identifiers link with nothing: ``unnamed``.
Dependencies on unknown calls are ignored.  Arguments that are null or no JSON
give the error ``not JSON``; an unknown tool gives ``unknown tool``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from errata.functions.scan import running_totals
from errata.llm import textops as T
from errata.session import materialize

#: Digits of the longest whole number that is read.
MAX_DIGITS = 4000
# JSON types and the Python types that stand for them.
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is_type(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or value == int(value))
    return isinstance(value, TYPES.get(kind, object))


def schema_errors(value, schema: dict, path: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema``, in path order."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is_type(value, k) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    errors = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):  # as JSON: true is not 1
        errors.append(f"{path}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            errors.append(f"{path}: below minimum")
        if value > schema.get("maximum", value):
            errors.append(f"{path}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            errors.append(f"{path}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            errors.append(f"{path}: too long")
    if isinstance(value, list) and "items" in schema:
        for k, item in enumerate(value):
            errors += schema_errors(item, schema["items"], f"{path}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{path}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                errors += schema_errors(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                errors.append(f"{path}.{k}: unknown")
    return errors


def _plain(value):
    if isinstance(value, float) and value.is_integer():
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def canonical(value) -> str:
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class Unusable(ValueError):
    """Arguments or a schema that cannot be judged; the text says why."""


def _reject(name: str):
    raise ValueError(name)


def _fraction(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise Unusable("number out of range")
    return value


def _whole(text: str) -> int:
    if len(text) > MAX_DIGITS:
        raise Unusable("number out of range")
    return int(text)


def parse_arguments(text: str | None):
    """The value of a JSON text that canonical JSON can hold."""
    try:
        value = json.loads(text or "", parse_constant=_reject, parse_float=_fraction, parse_int=_whole)
        canonical([[[[value]]]]).encode()  # with room for the levels around it
    except Unusable:
        raise
    except RecursionError:
        raise Unusable("nested too deeply") from None
    except UnicodeEncodeError:
        raise Unusable("lone surrogate") from None
    except ValueError:
        raise Unusable("not JSON") from None
    return value


def parse_schema(text: str) -> dict:
    try:
        schema = json.loads(text)
    except (ValueError, RecursionError):
        raise Unusable("schema is not JSON") from None
    if not isinstance(schema, dict):
        raise Unusable("schema is not an object")
    return schema


def judge(arguments: str | None, schema: str | None, parsed: dict[str, dict]) -> tuple[object, list[str]]:
    """The arguments' value (None if unusable) and what is wrong with them."""
    value, errors = None, []
    try:
        value = parse_arguments(arguments)
    except Unusable as e:
        errors = [str(e)]
    if schema is None:
        return value, [*errors, "unknown tool"]
    if errors:
        return value, errors
    try:
        if schema not in parsed:
            parsed[schema] = parse_schema(schema)
        return value, schema_errors(value, parsed[schema])
    except Unusable as e:
        return value, [str(e)]
    except (TypeError, AttributeError, KeyError):
        return value, ["schema is malformed"]
    except RecursionError:
        return value, ["schema is nested too deeply"]


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parsed: dict[str, dict] = {}
    for b in batches:
        out = []
        for r in b.to_pylist():
            value, errors = judge(r["arguments"], r["schema"], parsed)
            whole = {"arguments": value, "id": r["call_id"], "name": r["name"], "result": r["content"]}
            # a schema's own texts may hold what UTF-8 cannot
            errors = [e.encode("utf-8", "replace").decode() for e in errors]
            out.append((r["row_key"], not errors, errors, canonical(whole)))
        keys, valid, errors, text = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())),
                                          pa.array(text, pa.string())], names=["row_key", "valid", "errors", "json"])


def _first(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``again``: whether an earlier row has the identifier."""
    place = Window.partitionBy("conv_id", "call_id").orderBy(*order)
    return rows.withColumn("again", F.row_number().over(place) > 1)


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, cyclic) of first calls (conv_id, call_id, turn, depends_on)."""
    nodes = calls.select("conv_id", "call_id", "turn")
    wanted = calls.select("conv_id", F.col("call_id").alias("to"), F.col("turn").alias("to_turn"), F.explode(F.array_distinct("depends_on")).alias("call_id"))
    edges = materialize(wanted.join(nodes, ["conv_id", "call_id"]).select(
        "conv_id", F.col("call_id").alias("at"), "to",
        F.expr("int(struct(turn, call_id) >= struct(to_turn, to))").alias("rise")), "calls-edges")
    limit = edges.groupBy("conv_id").agg(F.sum("rise").alias("limit")).where("limit > 0")
    state = materialize(edges.where("rise = 1").select("conv_id", F.col("to").alias("call_id")).distinct()
                        .select("*", F.lit(1).cast("long").alias("level")), "calls-levels")
    front = state
    while not front.isEmpty():
        reached = (front.join(edges, (front["conv_id"] == edges["conv_id"]) & (front["call_id"] == edges["at"]))
                   .join(limit.withColumnRenamed("conv_id", "limit_conv"), front["conv_id"] == F.col("limit_conv"))
                   .groupBy(front["conv_id"], F.col("to").alias("call_id"))
                   # a level above the limit proves a cycle; what depends on it gets no higher
                   .agg(F.max(F.when(F.col("level") > F.col("limit"), F.col("level")).otherwise(F.col("level") + F.col("rise"))).alias("reached")))
        merged = materialize(state.join(reached, ["conv_id", "call_id"], "full").select(
            "conv_id", "call_id", F.greatest("level", "reached").alias("level"),
            F.coalesce(F.col("reached") > F.coalesce("level", F.lit(0)), F.lit(False)).alias("moved")), "calls-levels")
        state, front = merged.drop("moved"), merged.where("moved").drop("moved")
    return state.join(limit, "conv_id").select("conv_id", "call_id", "level", (F.col("level") > F.col("limit")).alias("cyclic"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result without a call: conv_id, call_id, turn,
    status, place (from 0 in the conversation's order; null for rows that are
    no first calls), level, valid, errors and json.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), depends_on
    (array of call ids).  ``results``: conv_id, call_id, turn, content.
    ``schemas``: name, schema (JSON text)."""
    calls = materialize(_first(calls.select("conv_id", "call_id", "turn", "name", "arguments", "depends_on"),
                               ["turn", "name", "arguments"]).withColumn("row_key", F.monotonically_increasing_id()), "calls")
    results = _first(results.select("conv_id", "call_id", "turn", "content"), ["turn", "content"])
    named = "call_id IS NOT NULL AND conv_id IS NOT NULL"
    firsts = calls.where(f"NOT again AND {named}")
    answers = results.where(f"NOT again AND {named}").select("conv_id", "call_id", "content", F.lit(True).alias("answered"))
    linked = firsts.join(answers, ["conv_id", "call_id"], "left").join(levels(firsts), ["conv_id", "call_id"], "left")
    linked = linked.join(schemas.groupBy("name").agg(F.min("schema").alias("schema")), "name", "left").select(
        "conv_id", "call_id", "turn", "row_key", "name", "arguments", "content", "schema", F.coalesce("level", F.lit(0)).alias("level"),
        F.expr("CASE WHEN cyclic THEN 'cycle' WHEN answered THEN 'linked' ELSE 'unanswered' END").alias("status"))
    linked = materialize(linked, "calls-linked")
    checked = T.bounded(linked).select("row_key", "call_id", "name", "arguments", "content", "schema").mapInArrow(
        _check, "row_key long, valid boolean, errors array<string>, json string")
    order = ["conv_id", "level", "turn", "call_id"]
    placed = running_totals(linked.select("row_key", "status", *order), order, {"place": "1"}, ["conv_id"])
    main = placed.join(checked, "row_key").select("conv_id", "call_id", "turn", "status", "place", "level", "valid", "errors", "json")
    other_calls = calls.where(f"again OR NOT ({named})").select("conv_id", "call_id", "turn", "again")
    others = results.join(firsts.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", "turn", "again").union(
        results.join(firsts.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi").where("again").select("conv_id", "call_id", "turn", "again"))
    rest = other_calls.withColumn("orphan", F.lit(False)).union(others.withColumn("orphan", F.lit(True))).select(
        "conv_id", "call_id", "turn",
        F.expr(f"CASE WHEN NOT ({named}) THEN 'unnamed' WHEN again THEN 'duplicate' WHEN orphan THEN 'orphan' END").alias("status"))
    return main.unionByName(rest, allowMissingColumns=True)
