"""Chat formatting: tool calls linked to their results, ordered, validated, serialised.

``calls`` has conv_id, turn, place (within the turn), call_id, name, arguments (JSON text)
and after (ids of calls whose results it uses); ``results`` has conv_id, turn, call_id,
content. Both are joined by (conv_id, call_id). Of several calls under one identifier the
first by turn, place and content is the call, the others count as repeats; so for results.
Results whose call doesn't exist are rows of ``orphan_results``.

Calls are ordered topologically: a call's level is one more than the highest level of the
calls it follows, and a conversation's order is by level, turn, place. Levels are found in
rounds, one for each level. Calls on a cycle, or behind one, come last and have no level.
The place in the order comes from one sort over everything, so that a conversation of any
length is spread over many tasks.

Arguments are checked against the tool's JSON schema (type, properties, required,
additionalProperties, enum, minimum, maximum, minLength, maxLength, items). Arguments that
are no JSON, nested more than ``MOST_NESTED`` deep, or hold a number of more than 4,300
digits are a fault of the call and stay as text in its line; arguments of any length are
read whole. Each call becomes one line of canonical JSON: keys sorted by code point, no blanks, no escapes but
the needed ones (half a surrogate pair is escaped), whole numbers without a fraction.

Null identifiers, conversations or turns: such calls and results can't be linked and are
left out. Null names, arguments and lists are kept and make the call invalid, invalid or
free. Extra columns are not read; empty tables give empty results.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare
from tidemark.operators.ordered import global_rank
from tidemark.session import write_and_read

_KEY = ["conv_id", "call_id"]
#: Lists and objects within one another that arguments may have.
MOST_NESTED = 100
_HALF_PAIR = re.compile("[\ud800-\udfff]")
_KINDS = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
}


def printable(text: str) -> str:
    """``text`` with halves of surrogate pairs, which UTF-8 can't hold, as JSON escapes."""
    return _HALF_PAIR.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    """JSON text that is the same for equal values."""
    if isinstance(value, bool) or value is None or isinstance(value, int):
        return json.dumps(value)
    if isinstance(value, str):
        return printable(json.dumps(value, ensure_ascii=False))
    if isinstance(value, float):
        if not math.isfinite(value):
            return "null"
        return str(int(value)) if value.is_integer() else repr(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value)) + "}"


def too_deep(value: Any) -> bool:
    """Whether more than ``MOST_NESTED`` lists and objects lie within one another."""
    level, depth = [value], 0
    while level := [v for v in level if isinstance(v, (list, dict))]:
        depth += 1
        if depth > MOST_NESTED:
            return True
        level = [v for held in level for v in (held.values() if isinstance(held, dict) else held)]
    return False


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _KINDS[kind])


def faults(value: Any, schema: dict, path: str = "$") -> list[str]:
    """What is wrong with a value, by path, in a fixed order."""
    kind = schema.get("type")
    if kind and not _is(value, kind):
        return [f"{path}: not {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}: not in enum")
    if _is(value, "number"):
        if value < schema.get("minimum", value):
            found.append(f"{path}: below minimum")
        if value > schema.get("maximum", value):
            found.append(f"{path}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{path}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            found.append(f"{path}: too long")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            found += faults(item, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        found += [f"{path}.{name}: missing" for name in sorted(schema.get("required", [])) if name not in value]
        for name in sorted(value):
            if name in properties:
                found += faults(value[name], properties[name], f"{path}.{name}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{path}.{name}: unexpected")
    return found


def _no_constant(text: str) -> None:
    raise ValueError(text)


def check_arguments(name: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[Any, list[str]]:
    """(arguments, faults) of a call."""
    try:
        value = json.loads(text or "", parse_constant=_no_constant)
    except ValueError:
        return None, ["$: not JSON"]
    except RecursionError:
        return None, ["$: nested too deeply"]
    if too_deep(value):
        return None, ["$: nested too deeply"]
    if name not in schemas:
        return value, ["unknown tool"]
    return value, faults(value, schemas[name])


def _usable(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*_KEY, "turn", *columns).filter(
        "conv_id IS NOT NULL AND call_id IS NOT NULL AND turn IS NOT NULL"
    )


def _first(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row for each identifier, the first in ``order``, and the number of repeats."""
    others = [c for c in rows.columns if c not in _KEY]
    first = F.min(F.struct(*order, *(c for c in others if c not in order)))
    grouped = rows.groupBy(*_KEY).agg(first.alias("first"), (F.count("*") - 1).alias("repeats"))
    return grouped.select(*_KEY, *(F.col(f"first.{c}").alias(c) for c in others), "repeats")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of all ``nodes`` that no cycle holds back.

    ``edges`` (conv_id, call_id, after) point to calls that must come first. Each round
    looks only at the calls of the last level and at edges not yet resolved.
    """
    known = nodes.select("conv_id", F.col("call_id").alias("after"))
    edges = write_and_read(edges.join(known, ["conv_id", "after"]).distinct(), "call-edges")
    front = write_and_read(nodes.select(*_KEY).join(edges, _KEY, "left_anti"), "call-level")
    found, level = front.withColumn("level", F.lit(0)), 0
    while not edges.isEmpty():
        done = front.select("conv_id", F.col("call_id").alias("after"))
        left = write_and_read(edges.join(done, ["conv_id", "after"], "left_anti"), "call-edges")
        front = write_and_read(
            edges.join(done, ["conv_id", "after"]).select(*_KEY).distinct().join(left, _KEY, "left_anti"),
            "call-level",
        )
        if front.isEmpty():
            break
        level += 1
        found = found.unionByName(front.withColumn("level", F.lit(level)))
        edges = left
    return found


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call: conv_id, call_id, place_no (from 1), level, status, faults, line.

    status is ``linked``, ``unanswered`` (no result) or ``cyclic``; faults are joined by
    "; ". repeats counts the further calls and results under the identifier.
    """
    prepare(calls.sparkSession)
    calls = _usable(calls, ["place", "name", "arguments", "after"])
    results = _usable(results, ["content"])
    named = write_and_read(
        _first(calls, ["turn", "place", "name", "arguments"]), "calls"
    )
    answers = _first(results, ["turn", "content"]).select(
        *_KEY, F.col("turn").alias("answered"), "content", F.col("repeats").alias("more")
    )
    edges = named.select(*_KEY, F.explode("after").alias("after")).filter(
        "after IS NOT NULL"
    )
    placed = levels(named, edges)
    linked = named.join(answers, _KEY, "left").join(placed, _KEY, "left")
    order = [F.col("conv_id"), F.col("level").asc_nulls_last(), F.col("turn"), F.col("place"), F.col("call_id")]
    ranked = write_and_read(global_rank(linked, order, "at", "all"), "calls-ranked")
    begins = ranked.groupBy("conv_id").agg(F.min("at").alias("begin"))
    numbered = ranked.join(begins, "conv_id").withColumn("place_no", F.col("at") - F.col("begin") + 1)
    status = (
        F.when(F.col("level").isNull(), "cyclic")
        .when(F.col("answered").isNull(), "unanswered")
        .otherwise("linked")
    )

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrong, lines = [], []
            for row in batch.to_pylist():
                value, bad = check_arguments(row["name"], row["arguments"], schemas)
                wrong.append(printable("; ".join(bad)))
                lines.append(canonical({
                    "after": sorted(a for a in row["after"] or [] if a is not None),
                    "arguments": row["arguments"] if value is None else value,
                    "id": row["call_id"],
                    "name": row["name"],
                    "result": row["content"],
                    "valid": not bad,
                }))
            columns = ["conv_id", "call_id", "place_no", "level", "status", "repeats"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(wrong, pa.string()), pa.array(lines, pa.string())],
                [*columns, "faults", "line"],
            )

    kind = dict(numbered.dtypes)
    return numbered.select(
        "conv_id", "call_id", "place_no", "level", status.alias("status"),
        (F.col("repeats") + F.coalesce("more", F.lit(0))).alias("repeats"),
        "name", "arguments", "after", "content",
    ).mapInArrow(
        serialise,
        f"conv_id {kind['conv_id']}, call_id string, place_no long, level int, status string, "
        "repeats long, faults string, line string",
    )


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per identifier of results whose call doesn't exist, in the columns of ``link_calls``.

    status is ``orphan``; place_no and level are null, and the line holds the first result.
    """
    prepare(calls.sparkSession)
    known = _usable(calls, []).select(*_KEY)
    rows = _first(_usable(results, ["content"]).join(known, _KEY, "left_anti"), ["turn", "content"])
    kind = dict(rows.dtypes)

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            lines = [
                canonical({
                    "after": [], "arguments": None, "id": row["call_id"], "name": None,
                    "result": row["content"], "valid": False,
                })
                for row in batch.to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), batch.column("call_id"),
                    pa.nulls(count, pa.int64()), pa.nulls(count, pa.int32()),
                    pa.array(["orphan"] * count, pa.string()), batch.column("repeats"),
                    pa.array(["no call"] * count, pa.string()), pa.array(lines, pa.string()),
                ],
                ["conv_id", "call_id", "place_no", "level", "status", "repeats", "faults", "line"],
            )

    return rows.select(*_KEY, "repeats", "content").mapInArrow(
        serialise,
        f"conv_id {kind['conv_id']}, call_id string, place_no long, level int, status string, "
        "repeats long, faults string, line string",
    )


#: Schemas of the tools that ``calls_of`` has the assistant call.
SCHEMAS = {
    "search": {
        "type": "object",
        "required": ["query", "limit"],
        "additionalProperties": False,
        "properties": {
            "query": {"type": "string", "minLength": 2},
            "limit": {"type": "integer", "minimum": 1, "maximum": 100},
        },
    },
    "measure": {
        "type": "object",
        "required": ["text"],
        "properties": {"text": {"type": "string", "maxLength": 40}, "unit": {"enum": ["word", "sign"]}},
    },
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as they stand for the turns of plain conversations.

    Every assistant turn is a call: a search for its whole text, or a measurement of it,
    with its length as argument; it follows the calls at half and a third of its turn. The
    user turn behind it is the result.
    """
    text = F.coalesce("text", F.lit(""))
    count = F.size(F.split(text, r"\s+"))
    search = F.to_json(F.struct(
        count.alias("limit"), text.alias("query")
    ))
    measure = F.to_json(F.struct(
        F.when(count % 3 == 0, "line").otherwise("word").alias("unit"),
        text.alias("text"),
    ))
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    turn = F.col("turn")
    calls = conversations.filter("role = 'assistant'").select(
        "conv_id",
        "turn",
        F.lit(0).alias("place"),
        name(turn).alias("call_id"),
        F.when(count % 2 == 0, "search").when(count % 7 == 0, "unknown").otherwise("measure").alias("name"),
        F.when(count % 2 == 0, search).otherwise(measure).alias("arguments"),
        F.array_except(
            F.array_distinct(F.array(name(F.floor(turn / 2)), name(F.floor(turn / 3)))), F.array(name(turn))
        ).alias("after"),
    )
    results = conversations.filter("role = 'user' AND turn > 0").select(
        "conv_id", "turn", name(turn - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results
