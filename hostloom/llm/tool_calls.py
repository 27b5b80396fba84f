"""Chat messages with tool calls linked to their results.

Calls and results of a conversation are joined by call id, calls are put in an
order in which each comes after those it refers to, their arguments are checked
against the schemas of the tools, and everything is written as canonical JSON.

Per conversation and id the first call and the first result count; others are
marked as repeats before the join, so an id used a million times does not
multiply. Chains of single references are followed by doubling, so a chain of n calls
takes log2(n) rounds; only calls with several references are put in order one round
after the other. What never gets a level refers to itself in a circle.

Status of a call: ``linked``, ``unanswered``, ``early`` (its result comes before
it), ``repeat``, ``cycle`` or ``no_id``. Status of a result: ``linked``,
``orphan``, ``early``, ``repeat`` or ``no_id``. Null conversations are one
conversation, null turns come first, null texts are empty. Rows that are wholly
equal are each answered; of calls with one id in one turn the least by name and
arguments is the first. Arguments that are no JSON, are nested too deeply to be read, or
hold numbers out of range or halves of surrogate pairs are errors of their row, which
keeps them as text. Very long texts are written whole. Other columns of the inputs are
not looked at. Empty tables give empty results.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostloom.llm.common import map_batches, settle

# tool -> field -> (type, required); types are those of JSON schemas
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

_KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict,
          "null": type(None)}


class _Written(str):
    """A finished piece of JSON."""


def canonical(value: object) -> str:
    """JSON with sorted keys (by UTF-16 units), no spaces and only the necessary escapes; any depth."""
    out: list[str] = []
    todo = [value]
    while todo:
        item = todo.pop()
        if isinstance(item, _Written):
            out.append(item)
        elif isinstance(item, (dict, list)):
            opened, closed = "{}" if isinstance(item, dict) else "[]"
            parts: list[object] = [_Written(opened)]
            keys = item if isinstance(item, list) else sorted(item, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
            for i, key in enumerate(keys):
                comma = "," if i else ""
                if isinstance(item, dict):
                    parts += [_Written(f"{comma}{json.dumps(key, ensure_ascii=False)}:"), item[key]]
                else:
                    parts += [_Written(comma), key]
            todo += reversed([*parts, _Written(closed)])
        elif isinstance(item, float) and item.is_integer() and abs(item) < 1e21:
            out.append(str(int(item)))
        else:
            out.append(json.dumps(item, ensure_ascii=False, allow_nan=False))
    return "".join(out)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _in_range(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise OverflowError(text)
    return value


def checked(tool: str | None, text: str | None, schemas: Schemas) -> tuple[object, list[str]]:
    """The parsed arguments and what is wrong with them, in order of field names."""
    try:
        value = json.loads(text or "{}", parse_constant=_no_constant, parse_float=_in_range)
        canonical(value).encode()
    except UnicodeEncodeError:
        return None, ["arguments hold half a surrogate pair"]
    except ValueError:
        return None, ["arguments are no JSON"]
    except OverflowError:
        return None, ["arguments hold a number out of range"]
    except RecursionError:
        return None, ["arguments are nested too deeply"]
    if not isinstance(value, dict):
        return value, ["arguments are no object"]
    if tool not in schemas:
        return value, [f"unknown tool {tool or ''}"]
    fields, wrong = schemas[tool], []
    for name in sorted(fields.keys() | value.keys()):
        if name not in fields:
            wrong.append(f"unknown field {name}")
        elif name not in value:
            if fields[name][1]:
                wrong.append(f"missing field {name}")
        elif not isinstance(value[name], _KINDS[fields[name][0]]) or (
                isinstance(value[name], bool) and fields[name][0] in ("integer", "number")):
            wrong.append(f"field {name} is no {fields[name][0]}")
    return value, wrong


def _same(df: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
    """Join on (conv_id, call_id) with null conversations equal; drops the other side's keys."""
    other = other.withColumnRenamed("conv_id", "_conv").withColumnRenamed("call_id", "_call")
    return df.join(other, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_call")),
                   how).drop("_conv", "_call")


def _first(rows: DataFrame, *values: Column) -> DataFrame:
    return rows.filter("call_id is not null").groupBy("conv_id", "call_id").agg(*values)


def _looked_up(df: DataFrame, column: str, other: DataFrame, how: str = "left") -> DataFrame:
    """Join the call that ``column`` names; drops the other side's keys."""
    other = other.withColumnRenamed("conv_id", "_conv").withColumnRenamed("call_id", "_call")
    return df.join(other, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col(column) == F.col("_call")),
                   how).drop("_conv", "_call")


def _anchored(chains: DataFrame) -> DataFrame:
    """Follow single references to the first call that has none or several: (conv_id, call_id, anchor, steps).

    ``chains`` has (conv_id, call_id, ref), one reference each. A round doubles what
    is reached, so the longest possible chain, one call fewer than a conversation has,
    ends after its logarithm; what is not anchored then runs in a circle.
    """
    links = chains.select("conv_id", "call_id", F.col("ref").alias("anchor"), F.lit(1).cast("bigint").alias("steps"))
    ends = chains.select("conv_id", "call_id", F.lit(True).alias("_goes_on"))
    links = settle(_looked_up(links, "anchor", ends).select(
        "conv_id", "call_id", "anchor", "steps", F.col("_goes_on").isNull().alias("done")), "call-chains")
    longest = chains.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        if links.filter("not done").isEmpty():
            break
        ahead = links.select("conv_id", "call_id", F.col("anchor").alias("_anchor"), F.col("steps").alias("_steps"),
                             F.col("done").alias("_done"))
        far = _looked_up(links.filter("not done"), "anchor", ahead, "inner").select(
            "conv_id", "call_id", F.col("_anchor").alias("anchor"), (F.col("steps") + F.col("_steps")).alias("steps"),
            F.col("_done").alias("done"))
        links = settle(links.filter("done").union(far), "call-chains")
    return links.filter("done").drop("done")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that do not depend on a circle.

    ``calls`` has (conv_id, call_id, after), one row per call; references to
    ids that are no calls are passed over. The level is the length of the longest
    chain of references below a call.
    """
    nodes = calls.select("conv_id", "call_id")
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("ref"))
    edges = settle(_looked_up(edges, "ref", nodes, "left_semi"), "call-edges")
    needs = settle(_same(nodes, edges.groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("needs"))).select(
        "conv_id", "call_id", F.coalesce("needs", F.lit(0)).alias("needs")), "call-needs")
    roots = needs.filter("needs = 0").select("conv_id", "call_id", F.lit(0).cast("bigint").alias("level"))
    chains = _anchored(_same(edges, needs.filter("needs = 1"), "inner").drop("needs"))
    known = _ordered(edges, needs.filter("needs > 1"), chains, roots)
    below = _looked_up(chains, "anchor", known, "inner").select(
        "conv_id", "call_id", (F.col("level") + F.col("steps")).alias("level"))
    return known.union(below)


def _ordered(edges: DataFrame, joints: DataFrame, chains: DataFrame, roots: DataFrame) -> DataFrame:
    """Levels of the roots and of the calls with several references, a round for each step between those.

    A round reads what the rounds before wrote; plans do not grow.
    """
    if joints.isEmpty():
        return roots
    steps = _looked_up(_same(edges, joints, "inner"), "ref", chains).select(
        "conv_id", "call_id", "needs", F.coalesce("anchor", "ref").alias("anchor"),
        (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    steps, newest = settle(steps, "call-steps"), settle(roots, "call-levels")
    met, done = None, [newest]
    while not newest.isEmpty():
        reached = _looked_up(steps, "anchor", newest, "inner").select(
            "conv_id", "call_id", "needs", F.lit(1).cast("bigint").alias("c"), (F.col("level") + F.col("steps")).alias("level"))
        met = reached if met is None else met.union(reached)
        met = settle(met.groupBy("conv_id", "call_id", "needs").agg(
            F.sum("c").alias("c"), F.max("level").alias("level")), "call-met")
        newest = settle(met.filter("c = needs").select("conv_id", "call_id", "level"), "call-levels")
        met = met.filter("c < needs")
        done.append(newest)
    # one scan of all rounds' files
    return newest.sparkSession.read.schema(newest.schema).parquet(*[f for d in done for f in d.inputFiles()])


def linked(calls: DataFrame, results: DataFrame, messages: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, result and message, as canonical JSON.

    ``calls`` has (conv_id, turn, call_id, name, arguments, after), ``results``
    (conv_id, turn, call_id, content), ``messages`` (conv_id, turn, role,
    content). Rows: (conv_id, turn, kind, call_id, level, other_turn, status,
    valid, errors, json). ``other_turn`` is the turn of the result or the call.
    Reading a conversation by level and turn gives its calls in an order
    in which each follows those it refers to.
    """
    this_call, this_result = F.struct("turn", "name", "arguments", "after"), F.struct("turn", "content")
    opened = settle(_first(calls, F.min(this_call).alias("first")).select(
        "conv_id", "call_id", F.xxhash64("first").alias("first"), F.col("first.turn").alias("first_turn"),
        F.col("first.after").alias("after")), "calls")
    answered = _first(results, F.min(this_result).alias("answer")).select(
        "conv_id", "call_id", F.xxhash64("answer").alias("answer"), F.col("answer.turn").alias("result_turn"))
    order = settle(levels(opened.select("conv_id", "call_id", "after")), "call-order")
    opened = opened.drop("after")

    asked = calls.select("conv_id", "turn", "call_id", "name", "arguments", F.xxhash64(this_call).alias("mine"))
    asked = _same(_same(_same(asked, opened), answered), order)
    status = (F.when(F.col("call_id").isNull(), "no_id")
              .when(F.col("mine") != F.col("first"), "repeat")
              .when(F.col("level").isNull(), "cycle")
              .when(F.col("result_turn").isNull(), "unanswered")
              .when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked"))
    asked = asked.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.col("level").cast("int").alias("level"), F.col("result_turn").alias("other_turn"),
        status.alias("status"), F.lit("assistant").alias("role"), "name", F.col("arguments").alias("content"))
    told = results.select("conv_id", "turn", "call_id", "content", F.xxhash64(this_result).alias("mine"))
    told = _same(_same(_same(told, opened), answered), order)
    status = (F.when(F.col("call_id").isNull(), "no_id")
              .when(F.col("first_turn").isNull(), "orphan")
              .when(F.col("mine") != F.col("answer"), "repeat")
              .when(F.col("turn") < F.col("first_turn"), "early").otherwise("linked"))
    told = told.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.col("level").cast("int").alias("level"), F.col("first_turn").alias("other_turn"),
        status.alias("status"), F.lit("tool").alias("role"), F.lit(None).cast("string").alias("name"), "content")
    said = messages.select(
        "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"),
        F.lit(None).cast("int").alias("level"), F.lit(None).cast("bigint").alias("other_turn"),
        F.lit("message").alias("status"), "role", F.lit(None).cast("string").alias("name"), "content")

    def write(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines, valid, errors = [], [], []
        for row in batch.select(["kind", "call_id", "role", "name", "content"]).to_pylist():
            wrong: list[str] = []
            if row["kind"] == "call":
                value, wrong = checked(row["name"], row["content"], schemas)
                raw = row["content"] if value is None else value
                call = {"id": row["call_id"], "name": row["name"], "arguments": raw}
                body = {"role": row["role"], "tool_calls": [call]}
            elif row["kind"] == "result":
                body = {"role": row["role"], "tool_call_id": row["call_id"], "content": row["content"] or ""}
            else:
                body = {"role": row["role"], "content": row["content"] or ""}
            lines.append(canonical(body))
            valid.append(not wrong)
            errors.append("; ".join(wrong))
        return pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(valid), pa.array(errors, pa.string()),
                                           pa.array(lines, pa.string())],
                                          names=[*batch.schema.names[:7], "valid", "errors", "json"])

    return map_batches(asked.union(told).union(said), write,
                       "conv_id bigint, turn bigint, kind string, call_id string, level int, other_turn bigint, "
                       "status string, valid boolean, errors string, json string")


CALL = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"


def marked_calls(messages: DataFrame) -> DataFrame:
    """Calls that assistants write as ``<tool_call>{"id", "name", "arguments", "after"}</tool_call>``."""
    found = messages.filter("role = 'assistant'").select(
        "conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).alias("body"))
    body = F.from_json("body", "id string, name string, arguments string, after array<string>")
    return found.select("conv_id", "turn", body.alias("b")).select(
        "conv_id", "turn", F.col("b.id").alias("call_id"), F.col("b.name").alias("name"),
        F.col("b.arguments").alias("arguments"), F.coalesce("b.after", F.array().cast("array<string>")).alias("after"))


def marked_results(messages: DataFrame) -> DataFrame:
    """Results: messages of the role tool with ``{"tool_call_id", "content"}``."""
    body = F.from_json("text", "tool_call_id string, content string")
    return messages.filter("role = 'tool'").select("conv_id", "turn", body.alias("b")).select(
        "conv_id", "turn", F.col("b.tool_call_id").alias("call_id"), F.col("b.content").alias("content"))
