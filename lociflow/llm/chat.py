"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON.

Calls and results are hash-joined by conversation and identifier. A call may name calls it builds on; its level is one
more than the highest of theirs. Calls that build on one other are resolved by pointer jumping, in as many rounds as
the logarithm of the longest such chain; calls that build on several by rounds that each settle those whose
dependencies are settled, until none moves. Level, then turn, then identifier is a topological order of a conversation;
each call stays a row of its own, so a conversation of any length is never one group. Arguments are checked against
the tool's schema (a subset of JSON Schema: type, required, properties, additionalProperties, enum, minimum, maximum,
minLength, maxLength, items), and each row is one line of JSON with sorted keys, no blanks and plain UTF-8.

Edge cases: results without a call are rows of kind `orphan`, calls without a result have a null result. Of several
results of one call the one of the lowest turn is linked, then of the least text; the rest are orphans. Repeated calls
of one identifier: the first by turn, then by content, stands; the others are repeats, which `repeats` returns as rows
of that kind. Dependencies that name no call of the conversation are ignored; calls on a cycle, or behind one, have
level -1. Arguments that are null or no JSON object, that hold NaN or Infinity, half of a surrogate pair, or more
nesting than Python's parser takes are invalid, each with a problem that says so; the last three are kept as text. Null
conversations or identifiers link with nothing and repeat nothing: each such call is a row without a result, at level
0, and each such result an orphan; they take part in no shuffle. Turns that are neither calls nor results (system
turns, other or null roles) are rows of kind `turn` (others()). Extra columns are ignored. Empty tables give an empty
result.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Schemas of the derived calls' tools.
SCHEMAS: dict[str, dict[str, Any]] = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 1500}, "limit": {"type": "integer", "minimum": 1, "maximum": 40}}},
    "summarise": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 20}, "style": {"enum": ["short", "long"]}}},
    "count": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "limit": {"type": "number", "maximum": 45}}},
}
TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def problems(value: Any, schema: dict[str, Any], at: str = "$") -> list[str]:
    """Where a value departs from a schema."""
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            found.append(f"{at}: too long")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            found.append(f"{at}: too small")
        if value > schema.get("maximum", value):
            found.append(f"{at}: too large")
    if isinstance(value, list) and "items" in schema:
        found += [p for i, x in enumerate(value) for p in problems(x, schema["items"], f"{at}[{i}]")]
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        found += [p for k in sorted(value) if k in properties for p in problems(value[k], properties[k], f"{at}.{k}")]
        if schema.get("additionalProperties") is False:
            found += [f"{at}.{k}: unknown" for k in sorted(value) if k not in properties]
    return found


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _no_number(text: str) -> None:
    raise ValueError(f"{text} is no JSON")


def line(call_id: str | None, name: str | None, arguments: str | None, after: list[str], result: str | None, schemas: dict[str, dict[str, Any]]) -> tuple[bool, str, str]:
    """Whether the call is valid, its problems, and its JSON. Arguments that can't be written as JSON in UTF-8 stay the
    text they came as."""
    whole = {"after": sorted(after), "id": call_id, "name": name, "result": result}
    try:
        value = json.loads(arguments, parse_constant=_no_number) if arguments is not None else None
        bad = problems(value, schemas[name] | {"type": "object"}) if name in schemas else ["$: unknown tool"]
        made = canonical(whole | {"arguments": value})
        made.encode()
        return not bad, ";".join(bad), made
    except UnicodeEncodeError:
        bad = "$: lone surrogate"
    except RecursionError:
        bad = "$: nested too deeply"
    except ValueError:
        bad = "$: not JSON"
    return False, bad, canonical(whole | {"arguments": arguments})


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, after), one row an identifier.

    Calls with one dependency are first pointed past each other, by doubling, to a call with none or several. What is
    left to do in rounds is the calls with several dependencies alone, each round those that became ready; it goes on
    until a round settles none."""
    key = ["conv_id", "call_id"]
    nodes = stored(calls.select(*key, F.array_distinct("after").alias("after")), "calls")
    known = nodes.select("conv_id", F.col("call_id").alias("dep"))
    edges = stored(nodes.select(*key, F.explode("after").alias("dep")).join(known, ["conv_id", "dep"]).select(*key, "dep"), "edges")
    degree = stored(edges.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("dep")), "degree")
    single, several = _jumped(degree.where("n = 1").select(*key, "dep")), degree.where("n > 1").select(*key, F.col("n").alias("open"))
    new = nodes.select(*key).join(degree.select(*key), key, "left_anti").withColumn("level", F.lit(0))
    found = new = stored(new, "levels")
    if several.limit(1).count():
        via = single.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("to"), "far")
        needs = edges.join(several.select(*key), key).join(via, ["conv_id", "dep"], "left")
        needs = stored(needs.select(*key, F.coalesce("to", "dep").alias("dep"), (F.coalesce("far", F.lit(0)) + 1).alias("far")), "needs")
        state, rounds = stored(several.withColumn("best", F.lit(0)), "state"), [found]
        while new.limit(1).count():
            met = needs.join(new.select("conv_id", F.col("call_id").alias("dep"), "level"), ["conv_id", "dep"])
            met = met.groupBy(*key).agg(F.count(F.lit(1)).alias("met"), F.max(F.col("level") + F.col("far")).alias("high"))
            state = stored(state.join(met, key, "left").select(*key, (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.greatest("best", "high").alias("best")), "state")
            new = state.where("open = 0").select(*key, F.col("best").alias("level"))
            state = state.where("open > 0")
            rounds.append(new)
            if len(rounds) > 40:
                rounds = [stored(reduce(DataFrame.union, rounds), "levels")]
        found = stored(reduce(DataFrame.union, rounds), "levels")
    ends = found.select("conv_id", F.col("call_id").alias("dep"), F.col("level").alias("base"))
    behind = single.join(ends, ["conv_id", "dep"]).select(*key, (F.col("base") + F.col("far")).alias("level"))
    return nodes.select(*key).join(found.union(behind), key, "left").withColumn("level", F.coalesce("level", F.lit(-1)))


def _jumped(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, dep, far): each call's pointer (conv_id, call_id, dep) moved on over the table's own calls to
    the first that isn't one of them, far steps away. Each round a pointer takes over its target's. A round in which
    no pointer arrives leaves only cycles and what hangs on them, which are left out."""
    at = stored(single.withColumns({"far": F.lit(1), "on": F.lit(True)}), "jumps")
    left = at.count()
    while left:
        target = at.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("next"), F.col("far").alias("more"))
        step = at.join(target, ["conv_id", "dep"], "left")
        moved = step.select("conv_id", "call_id", F.coalesce("next", "dep").alias("dep"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("on"))
        at = stored(moved, "jumps")
        still = at.where("on").count()
        if still == left:
            break
        left = still
    return at.where("NOT on").drop("on")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, Any]] = SCHEMAS, repeats: bool = False) -> DataFrame:
    """(conv_id, kind, level, turn, call_id, name, linked, valid, problems, json) for each call (conv_id, turn, call_id,
    name, arguments, after) and each orphan of the results (conv_id, turn, call_id, content); with `repeats`, for each
    repeated call too.

    The first of several calls or results with one identifier is a minimum, added up before the shuffle, so that an
    identifier of many rows costs one row a task; the others are told by a number each row gets."""
    keyed, loose = F.expr("conv_id IS NOT NULL AND call_id IS NOT NULL"), F.expr("conv_id IS NULL OR call_id IS NULL")
    key, uid = ["conv_id", "call_id"], F.monotonically_increasing_id().alias("uid")
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("after", F.expr("cast(array() as array<string>)")).alias("after"))
    alone, calls = calls.where(loose), stored(calls.where(keyed).select("*", uid), "asked")
    results = results.select("conv_id", "turn", "call_id", "content")
    lost, results = results.where(loose), stored(results.where(keyed).select("*", uid), "answers")
    first = calls.groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "uid", "after")).alias("c"), F.count(F.lit(1)).alias("n"))
    first = stored(first.select(*key, "n", "c.*"), "first")
    found = results.groupBy(*key).agg(F.min(F.struct("turn", "content", "uid")).alias("r")).select(*key, F.col("r.content").alias("content"), F.col("r.uid").alias("taken"))
    linked = stored(first.drop("uid", "n").join(found, key, "left"), "linked")
    made = linked.join(levels(first), key).withColumns({"kind": F.lit("call"), "linked": F.col("taken").isNotNull()}).drop("taken")
    no = {"linked": F.lit(False), "content": F.lit(None).cast("string")}
    made = made.unionByName(alone.withColumns({"kind": F.lit("call"), "level": F.lit(0), **no}))
    if repeats:
        again = calls.join(first.where("n > 1").select("uid"), "uid", "left_anti").join(first.where("n > 1").select(*key), key, "left_semi")
        made = made.unionByName(again.drop("uid").withColumns({"kind": F.lit("repeat"), "level": F.lit(-1), **no}))
    orphans = results.join(linked.where("taken IS NOT NULL").select(F.col("taken").alias("uid")), "uid", "left_anti").drop("uid").unionByName(lost)
    none = F.lit(None).cast("string")
    orphans = orphans.withColumns({"kind": F.lit("orphan"), "level": F.lit(-1), "linked": F.lit(False), "name": none, "arguments": none, "after": F.lit(None).cast("array<string>")})

    @F.pandas_udf("valid boolean, problems string, json string")
    def formatted(call_id: pd.Series, name: pd.Series, arguments: pd.Series, after: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = [line(*x[:3], list(x[3]), x[4], schemas) if x[3] is not None else (False, "no call", canonical({"id": x[0], "result": x[4]})) for x in zip(call_id, name, arguments, after, content)]
        return pd.DataFrame(rows, columns=["valid", "problems", "json"])

    made = made.unionByName(orphans).withColumn("f", formatted("call_id", "name", "arguments", "after", "content"))
    return made.select("conv_id", "kind", "level", "turn", "call_id", "name", "linked", "f.valid", "f.problems", "f.json")


def derived(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results as a conversations table implies them: each user turn asks a tool about its text, building
    on the call two turns before; each assistant turn is the result of the call one turn before. The table has no tool
    calls of its own. Without a conversation or a turn there is no identifier."""
    of = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    number = F.coalesce(F.length("text"), F.lit(0)) % 50
    pick = F.col("turn") % 3
    arguments = F.when(pick == 0, F.to_json(F.struct(F.col("text").alias("query"), number.alias("limit")))).when(pick == 1, F.to_json(F.struct(F.col("text").alias("text"), F.when(number < 25, "short").otherwise("long").alias("style")))).otherwise(F.to_json(F.struct(number.alias("limit"), F.col("text").alias("text"))))
    name = F.when(pick == 0, "search").when(pick == 1, "summarise").otherwise("count")
    calls = turns.where("role = 'user'").select("conv_id", "turn", of(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"), F.array_compact(F.array(of(F.col("turn") - 2))).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", of(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def others(turns: DataFrame) -> DataFrame:
    """The turns that derived() makes neither calls nor results of, as rows of link()'s columns."""
    none = F.lit(None).cast("string")

    @F.pandas_udf("string")
    def packed(content: pd.Series, role: pd.Series) -> pd.Series:
        return pd.Series([canonical({"content": c, "role": r}) for c, r in zip(content, role)], dtype="object")

    text = packed("text", "role")
    rest = turns.where("coalesce(role NOT IN ('user', 'assistant'), true)")
    return rest.select("conv_id", F.lit("turn").alias("kind"), F.lit(-1).alias("level"), "turn", none.alias("call_id"), none.alias("name"), F.lit(False).alias("linked"), F.lit(True).alias("valid"), F.lit("").alias("problems"), text.alias("json"))
