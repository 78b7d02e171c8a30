"""Chat formatting: tool calls linked with their results, ordered, checked and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlume.llm import common

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_KEY = ["conv_id", "call_id"]
#: Deepest nesting of a JSON text that is taken as JSON.
DEPTH = 200


def parsed(s: str | None):
    """(value, error) of a JSON text.  Numbers beyond the range of doubles, or of thousands of digits,
    and nesting beyond ``DEPTH`` are errors."""
    if s is None:
        return None, "missing"

    def no_constant(x):
        raise ValueError(x)

    def number(x):
        return float(x) if math.isfinite(float(x)) else no_constant(x)

    try:
        v = json.loads(s, parse_constant=no_constant, parse_float=number)
    except (ValueError, RecursionError):
        return None, "not JSON"
    row = [v]
    for _ in range(DEPTH):
        row = [x for y in row if isinstance(y, (dict, list)) for x in (y.values() if isinstance(y, dict) else y)]
        if not row:
            return v, None
    return None, "nested too deeply"


def plain(v):
    """Numbers with a whole value as integers, so that equal values read alike."""
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 2**53 else v


def writable(s: str) -> str:
    """Halves of surrogate pairs, which UTF-8 cannot hold, as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", s)


def canonical(v) -> str:
    """Keys sorted, no spaces, no escapes beyond those needed."""
    return writable(json.dumps(plain(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def is_a(v, kind: str) -> bool:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    if kind == "number":
        return number
    if kind == "integer":
        return number and (isinstance(v, int) or v.is_integer())
    return isinstance(v, _TYPES[kind])


def violations(v, schema: Mapping, at: str = "$") -> list[str]:
    """Where a value breaks a schema: type, enum, minimum, maximum, minLength, maxLength, items,
    minItems, required, properties and additionalProperties."""
    kinds = schema.get("type")
    if kinds and not any(is_a(v, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    out = []
    if "enum" in schema and canonical(v) not in map(canonical, schema["enum"]):  # true is not 1
        out.append(f"{at}: enum")
    if is_a(v, "number"):
        out += [f"{at}: {k}" for k, wrong in (("minimum", lambda x: v < x), ("maximum", lambda x: v > x)) if k in schema and wrong(schema[k])]
    if isinstance(v, str):
        out += [f"{at}: {k}" for k, wrong in (("minLength", lambda x: len(v) < x), ("maxLength", lambda x: len(v) > x)) if k in schema and wrong(schema[k])]
    if isinstance(v, list):
        if len(v) < schema.get("minItems", 0):
            out.append(f"{at}: minItems")
        if "items" in schema:
            out += [x for k, item in enumerate(v) for x in violations(item, schema["items"], f"{at}[{k}]")]
    if isinstance(v, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", []) if k not in v]
        for k in sorted(v):
            if k in known:
                out += violations(v[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(key, level): numbers that rise from each call to those that need it; null on a cycle or behind one.

    ``calls`` has (key, turn), ``needs`` (key, on).  Where every call of a conversation comes after all it needs, by
    (turn, call_id), the turn is the level, and a conversation may be as long as it likes.  Only the other
    conversations are settled in rounds: 0 for calls that need no other, else one more than the highest they need.
    A round's joins read written tables and no conversation is gathered in a task."""
    at = lambda c: calls.select(F.col("key").alias(c), F.struct("turn", "key.call_id").alias(f"_at_{c}"))
    placed = needs.join(at("key"), "key").join(at("on"), "on")
    early = F.col("_at_key.turn").isNotNull() & F.col("_at_on.turn").isNotNull() & (F.col("_at_on") < F.col("_at_key"))
    late = common.saved(placed.where(~early).select("key.conv_id").distinct())
    by_turn = calls.withColumn("conv_id", F.col("key.conv_id")).join(late, "conv_id", "left_anti").select("key", F.coalesce("turn", F.lit(0)).cast("long").alias("level"))
    rest = common.saved(calls.withColumn("conv_id", F.col("key.conv_id")).join(late, "conv_id", "left_semi").select("key"))
    return by_turn.union(rounds(rest, needs.join(rest, "key", "left_semi")))


def rounds(calls: DataFrame, needs: DataFrame) -> DataFrame:
    pending = common.saved(needs.distinct())
    fresh = common.saved(calls.select("key").join(pending.select("key").distinct(), "key", "left_anti"))
    done, level = [fresh.withColumn("level", F.lit(0).cast("long"))], 0
    while pending.limit(1).count() and fresh.limit(1).count():
        met = pending.join(fresh.select(F.col("key").alias("on")), "on", "left_semi").select("key").distinct()
        pending = common.saved(pending.join(fresh.select(F.col("key").alias("on")), "on", "left_anti"))
        level += 1
        fresh = common.saved(met.join(pending.select("key").distinct(), "key", "left_anti"))
        done.append(fresh.withColumn("level", F.lit(level).cast("long")))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return calls.select("key").join(out, "key", "left")


def first_by(of: list[str]) -> Column:
    return F.min(F.struct(*of))


def link(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """One row per call identifier of a conversation, and per identifier with results only.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), depends (array of call ids of the
    conversation); ``results``: conv_id, call_id, turn, content (JSON or plain text); ``schemas`` by name.
    Returns conv_id, call_id, turn, name, level, status, n_calls, n_results, valid, errors, record.

    Calls and results are folded by identifier before they are joined, so a frequent one makes no
    product: the first call and the first result, by turn and content, count, and their numbers are told.  (level, turn, call_id) is a
    topological order of a conversation.  Status: linked, no_result, cycle (no level, for the call needs itself in the
    end), orphan_result (no call).  A call is valid if its arguments parse and fit the schema of its name, its needs exist and
    it is on no cycle; ``errors`` tells what is wrong.  ``record`` is the canonical JSON of the linked call.

    Calls and results without identifier or conversation are not linked with anything: each is a row
    of its own with a null identifier, status no_result or orphan_result.  Null arguments are an error; null needs are none;
    other columns are ignored.
    """
    calls = calls.select("conv_id", "call_id", "turn", "name", F.col("arguments").cast("string"), F.col("depends").cast("array<string>"))
    results = results.select("conv_id", "call_id", "turn", F.col("content").cast("string"))
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = calls.where(named).groupBy(*_KEY).agg(F.count("*").alias("n_calls"), first_by(["turn", "name", "arguments", "depends"]).alias("_call"))
    one = common.saved(one.withColumn("key", F.struct(*_KEY)))
    back = results.where(named).groupBy(*_KEY).agg(F.count("*").alias("n_results"), first_by(["turn", "content"]).alias("_result"))
    needs = one.select("key", F.explode("_call.depends").alias("_on")).where("_on is not null").select("key", F.struct(F.col("key.conv_id").alias("conv_id"), F.col("_on").alias("call_id")).alias("on"))
    needs = common.saved(needs.distinct())
    there = one.select(F.col("key").alias("on"))
    missing = needs.join(there, "on", "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("on.call_id")).alias("_missing"))
    level = levels(one.select("key", "_call.turn"), needs.join(there, "on", "left_semi"))
    rows = one.join(level, "key", "left").join(missing, "key", "left").drop("key").join(back, _KEY, "full")
    lone = [
        calls.where(~named).select("conv_id", "call_id", F.lit(1).cast("long").alias("n_calls"), F.struct("turn", "name", "arguments", "depends").alias("_call"), F.lit(0).cast("long").alias("level")),
        results.where(~named).select("conv_id", "call_id", F.lit(1).cast("long").alias("n_results"), F.struct("turn", "content").alias("_result")),
    ]
    for x in lone:
        rows = rows.unionByName(x, allowMissingColumns=True)
    rows = rows.select(*_KEY, F.coalesce("_call.turn", "_result.turn").cast("long").alias("turn"), F.col("_call").isNotNull().alias("_is_call"), F.col("_call.name").alias("name"), F.col("_call.arguments").alias("_arguments"),
                       F.col("_call.depends").alias("_depends"), "level", F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("_result.content").alias("_content"), "_missing")
    known = {k: dict(v) for k, v in schemas.items()}

    def write(batches):
        for b in batches:
            out = [serialised(r, known) for r in b.to_pylist()]
            if out:
                status, valid, errors, record = zip(*out, strict=True)
                keep = ("conv_id", "call_id", "turn", "name", "level", "n_calls", "n_results")
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(status), pa.array(valid), pa.array(errors, pa.list_(pa.string())), pa.array(record)], names=[*keep, "status", "valid", "errors", "record"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("conv_id", "call_id", "turn", "name", "level", "n_calls", "n_results"))
    return rows.mapInArrow(write, f"{schema}, status string, valid boolean, errors array<string>, record string")


def serialised(r: dict, schemas: Mapping[str, Mapping]) -> tuple[str, bool, list[str], str]:
    content, bad = parsed(r["_content"])
    result = r["_content"] if bad else content
    if not r["_is_call"]:
        return "orphan_result", False, ["no call"], canonical({"id": r["call_id"], "result": result})
    arguments, error = parsed(r["_arguments"])
    errors = [f"arguments: {error}"] if error else []
    if r["name"] not in schemas:
        errors.append("name: unknown")
    elif not error:
        errors += violations(arguments, schemas[r["name"]])
    errors += [f"depends: no call {x}" for x in r["_missing"] or []]
    if r["level"] is None:
        errors.append("depends: cycle")
    if r["n_calls"] > 1:
        errors.append("call_id: repeated")
    status = "cycle" if r["level"] is None else "linked" if r["n_results"] else "no_result"
    record = {"arguments": r["_arguments"] if error else arguments, "depends": sorted({x for x in r["_depends"] or [] if x is not None}), "id": r["call_id"], "name": r["name"], "order": [r["level"], r["turn"]]}
    if r["n_results"]:
        record["result"] = result
    return status, not errors, [writable(x) for x in errors], canonical(record)
