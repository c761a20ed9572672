"""Chat formatting: tool calls linked to their results, in dependency order, as canonical JSON.

Calls and results are two tables. They meet by a hash join on (conversation, call id). Calls name the calls they
follow; a call's depth is one more than the greatest depth among these, found for all conversations at once by
doubling pointers along chains and by rounds over calls with several predecessors, and the position in the
conversation is the rank by (depth, call id). Arguments are checked against the tool's schema, and each linked call is one JSON
object with sorted keys and without spaces. No conversation is gathered in one task.

Status of a row, the first that holds: ``no_call`` (a result without a call), ``repeated`` (a further call with the same
id in its conversation; the smallest by name and arguments is the call), ``cycle`` (it waits for itself, or for such a
call), ``unknown_tool``, ``bad_arguments`` (not an object of the schema), ``no_result``, ``ok``. Predecessors that do
not exist are ignored. Of several results of one call the smallest content counts. Nulls: a null conversation or call
id is a value like others; null arguments are ``bad_arguments``, null content is null in the JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tintlake.llm.common import stored
from tintlake.runtime import dense_position

# Tools whose schemas are taken to the tasks.
MAX_TOOLS = 10_000
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


def read_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results found in messages whose text is JSON of the usual chat form.

    ``{"tool_calls": [{"id", "name", "arguments", "after": [...]}]}`` makes calls (arguments stay JSON text),
    ``{"tool_call_id", "content"}`` a result; other messages give nothing."""
    text = F.col(f"`{text_col}`")
    parsed = messages.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.from_json(text, "tool_calls array<struct<id: string, name: string, arguments: string, after: array<string>>>, tool_call_id string, content string").alias("m"),
    )
    calls = parsed.select("conv_id", "turn", F.explode("m.tool_calls").alias("c")).select("conv_id", F.col("c.id").alias("call_id"), "c.name", "c.arguments", F.coalesce("c.after", F.array().cast("array<string>")).alias("after"))
    results = parsed.filter("m.tool_call_id is not null").select("conv_id", F.col("m.tool_call_id").alias("call_id"), "m.content")
    return calls, results


def fits(arguments, schema: dict) -> bool:
    """Whether a JSON value is an object of the schema (``properties`` with types and enums, ``required``; no others)."""
    if not isinstance(arguments, dict) or any(k not in arguments for k in schema.get("required", ())):
        return False
    known = schema.get("properties", {})
    for name, value in arguments.items():
        if name not in known:
            return False
        kind = known[name].get("type")
        if kind in _TYPES and (not isinstance(value, _TYPES[kind]) or (kind in ("integer", "number") and isinstance(value, bool))):
            return False
        if "enum" in known[name] and value not in known[name]["enum"]:
            return False
    return True


def canonical(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _serialiser(schemas):
    @F.pandas_udf("status string, json string")
    def serialise(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {name: json.loads(text) for name, text in schemas.value.items()}
        for df in parts:
            out = []
            for call, name, arguments, content, has_call, has_result in zip(df["call_id"], df["name"], df["arguments"], df["content"], df["has_call"], df["has_result"]):
                status, value = "ok", None
                if not has_call:
                    status = "no_call"
                elif name not in known:
                    status = "unknown_tool"
                else:
                    try:
                        value = json.loads(arguments)
                        status = "ok" if fits(value, known[name]) else "bad_arguments"
                    except (TypeError, ValueError):
                        status = "bad_arguments"
                if status == "ok" and not has_result:
                    status = "no_result"
                shown = value if value is not None else arguments
                row = {"id": call, "name": name, "arguments": shown, "result": content}
                out.append((status, canonical({k: None if isinstance(v, float) and v != v else v for k, v in row.items()})))
            yield pd.DataFrame(out, columns=["status", "json"])

    return serialise


def depths(calls: DataFrame) -> DataFrame:
    """(conv, call, depth) of calls (conv, call, after) with distinct ids; calls on or behind a cycle are missing.

    Calls with one predecessor form chains, which pointers cross in doubling steps. What remains are calls with
    several predecessors: rounds release those whose predecessors' chains begin at placed calls."""
    edges = calls.select("conv", "call", F.explode(F.array_distinct("after")).alias("before"))
    edges = stored(edges.join(calls.select("conv", F.col("call").alias("before")), ["conv", "before"]), "edges")
    needs = edges.groupBy("conv", "call").agg(F.count(F.lit(1)).alias("needs"), F.min("before").alias("before"))
    links = stored(needs.filter("needs = 1").select("conv", "call", F.col("before").alias("to"), F.lit(1).alias("steps")), "chains")
    bound = links.count().bit_length() + 1  # a pointer that moves longer goes round a cycle
    for _ in range(bound):
        ahead = links.select("conv", F.col("call").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"))
        moved = links.join(ahead, ["conv", "to"], "left")
        links = stored(moved.select("conv", "call", F.coalesce("further", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("further").isNotNull().alias("moved")), "chains")
        if not links.filter("moved").limit(1).count():
            break
    many = needs.filter("needs > 1").select("conv", "call")
    roots = calls.select("conv", "call").join(needs, ["conv", "call"], "left_anti")
    known = stored(roots.withColumn("depth", F.lit(0)), "depth")
    chain = links.select("conv", F.col("call").alias("before"), F.col("to").alias("start"), "steps")
    joins = edges.join(many, ["conv", "call"], "left_semi").join(chain, ["conv", "before"], "left")
    joins = stored(joins.select("conv", "call", F.coalesce("start", "before").alias("start"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "joins")
    while joins.limit(1).count():
        placed = joins.join(known.select("conv", F.col("call").alias("start"), "depth"), ["conv", "start"], "left")
        ready = placed.groupBy("conv", "call").agg(F.count(F.lit(1)).alias("all"), F.count("depth").alias("got"), F.max(F.col("depth") + F.col("steps")).alias("depth")).filter("got = all")
        ready = stored(ready.select("conv", "call", "depth"), "depth")
        if not ready.limit(1).count():
            break
        known = known.unionByName(ready)
        joins = stored(joins.join(ready, ["conv", "call"], "left_anti"), "joins")
    behind = links.join(known.select("conv", F.col("call").alias("to"), "depth"), ["conv", "to"]).select("conv", "call", (F.col("depth") + F.col("steps")).alias("depth"))
    return known.unionByName(behind)


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call row, and per result without call: conv_id, call_id, position, depth, status, json.

    ``calls``: conv_id, call_id, name, arguments (JSON), after (array of call ids); ``results``: conv_id, call_id,
    content; ``schemas``: name, schema (JSON). Rows that are not linked have no position."""
    tools = schemas.select("name", "schema").limit(MAX_TOOLS + 1).collect()
    if len(tools) > MAX_TOOLS:
        raise ValueError(f"more than {MAX_TOOLS} tools")
    sent = calls.sparkSession.sparkContext.broadcast({r["name"]: r["schema"] for r in tools if r["name"] is not None and r["schema"] is not None})
    conv_type = dict(calls.dtypes)["conv_id"]
    # Keys as text with a mark, so that nulls join and rank like values.
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    given = calls.select("conv_id", key("conv_id").alias("conv"), "call_id", key("call_id").alias("call"), "name", "arguments", F.transform(F.coalesce("after", F.array().cast("array<string>")), lambda a: F.coalesce(F.concat(F.lit("="), a), F.lit(""))).alias("after"))
    order = F.struct("name", "arguments", F.to_json("after"))
    first = given.groupBy("conv", "call").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(order.alias("o"), F.struct("conv_id", "call_id", "name", "arguments", "after").alias("c"))).alias("m"))
    unique = stored(first.select("conv", "call", "rows", "m.c.*"), "calls")
    answers = results.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), key("conv_id").alias("conv"), key("call_id").alias("call"), "content")
    answers = answers.groupBy("conv", "call").agg(F.min("content").alias("content"), F.first("r_conv").alias("r_conv"), F.first("r_call").alias("r_call"), F.lit(True).alias("has_result"))
    linked = unique.withColumn("has_call", F.lit(True)).join(answers, ["conv", "call"], "full")
    linked = linked.select("conv", "call", F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("call_id", "r_call").alias("call_id"), "name", "arguments", "content", "rows", F.coalesce("has_call", F.lit(False)).alias("has_call"), F.coalesce("has_result", F.lit(False)).alias("has_result"))
    checked = linked.withColumn("s", _serialiser(sent)(F.struct("call_id", "name", "arguments", "content", "has_call", "has_result")))
    placed = dense_position(depths(unique.select("conv", "call", "after")), ["conv"], F.col("depth"), ["depth", "call"], "position")
    out = checked.join(placed, ["conv", "call"], "left")
    status = F.when((F.col("depth").isNull()) & F.col("has_call"), F.lit("cycle")).otherwise(F.col("s.status"))
    columns = [F.col("conv_id").cast(conv_type), "call_id", "position", "depth", status.alias("status"), F.col("s.json").alias("json")]
    more = out.filter("rows > 1").select("conv_id", "call_id", F.explode(F.sequence(F.lit(2), F.col("rows").cast("int"))).alias("k"))
    repeats = more.select(F.col("conv_id").cast(conv_type), "call_id", F.lit(None).cast("long").alias("position"), F.lit(None).cast("int").alias("depth"), F.lit("repeated").alias("status"), F.lit(None).cast("string").alias("json"))
    return out.select(*columns).unionByName(repeats)
