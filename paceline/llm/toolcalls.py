"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from paceline.llm.common import Staged, keeping, query, table

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _is(value, kind: str | list[str]) -> bool:
    if isinstance(kind, list):
        return any(_is(value, k) for k in kind)
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    if kind == "integer":
        return _is(value, "number") and value == int(value)
    return kind not in _TYPES or isinstance(value, _TYPES[kind])


def _same(a, b) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def _value_problems(value, rule: dict, name: str) -> list[str]:
    """The first that is wrong with a value itself, else all that is wrong inside it."""
    if "type" in rule and not _is(value, rule["type"]):
        return [f"type:{name}"]
    if "enum" in rule and not any(_same(value, e) for e in rule["enum"]):
        return [f"enum:{name}"]
    if _is(value, "number") and not (rule.get("minimum", value) <= value <= rule.get("maximum", value)
                                     and not value <= rule.get("exclusiveMinimum", value - 1) and not value >= rule.get("exclusiveMaximum", value + 1)):
        return [f"range:{name}"]
    if isinstance(value, str) and not rule.get("minLength", 0) <= len(value) <= rule.get("maxLength", len(value)):
        return [f"length:{name}"]
    if isinstance(value, str) and "pattern" in rule and not re.search(rule["pattern"], value):
        return [f"pattern:{name}"]
    if isinstance(value, list):
        if not rule.get("minItems", 0) <= len(value) <= rule.get("maxItems", len(value)):
            return [f"length:{name}"]
        return [p for i, v in enumerate(value) for p in _value_problems(v, rule.get("items", {}), f"{name}[{i}]")]
    return _object_problems(value, rule, f"{name}.") if isinstance(value, dict) else []


def _object_problems(value: dict, schema: dict, at: str) -> list[str]:
    known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
    out = [f"missing:{at}{p}" for p in sorted(schema.get("required", [])) if p not in value]
    for name in sorted(value):
        if name in known:
            out += _value_problems(value[name], known[name], at + name)
        elif isinstance(others, dict):
            out += _value_problems(value[name], others, at + name)
        elif not others:
            out.append(f"extra:{at}{name}")
    return out


def problems(arguments, schema: dict | None) -> list[str]:
    """What is wrong with parsed arguments, as ``problem:name``, in a fixed order; names of inner values are paths like ``a.b[0]``.

    Looked at: type (one or several), enum, bounds, lengths and pattern, items,
    properties, required and additional properties, at any depth.  Schemas
    combined by anyOf and the like, and references, are not.
    """
    if schema is None:
        return ["unknown_tool"]
    if not isinstance(arguments, dict):
        return ["not_object"]
    return _object_problems(arguments, schema, "")


def _no_constant(name: str):
    raise ValueError(name)


def _number(text: str) -> float:
    value = float(text)
    if math.isinf(value):
        raise ValueError(text)
    return value


def parse(text: str | None) -> tuple[object, list[str]]:
    """JSON of a call, and the keys that an object of it repeats (the last one counts).

    ValueError where it is no JSON, or holds numbers too large for it or halves
    of characters, which could not be written again.
    """
    repeated = set()

    def pairs(items: list[tuple]) -> dict:
        out = dict(items)
        if len(out) < len(items):
            names = [n for n, _ in items]
            repeated.update(n for n in out if names.count(n) > 1)
        return out

    value = json.loads(text or "", parse_constant=_no_constant, parse_float=_number, object_pairs_hook=pairs)
    canonical(value).encode()
    return value, [f"repeated:{n}" for n in sorted(repeated)]


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and plain characters."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _write(schemas: dict, arrow: pa.Schema):
    def run(frames):
        for f in frames:
            found, lines = [], []
            for r in f.to_pylist():
                errors, arguments = [], None
                if r["has_call"]:
                    try:
                        arguments, errors = parse(r["arguments"])
                        errors = problems(arguments, schemas.get(r["name"])) + errors
                    except (ValueError, RecursionError):
                        arguments, errors = r["arguments"], ["not_json"]
                found.append(errors)
                lines.append(canonical({"arguments": arguments, "call_id": r["call_id"], "name": r["name"],
                                        "result": r["content"], "status": r["status"], "valid": r["has_call"] and not errors}))
            yield pa.RecordBatch.from_arrays(
                [*f.columns, pa.array(found, pa.list_(pa.string())), pa.array(lines, pa.string())], schema=arrow)

    return run


def call_levels(calls: DataFrame, staged: Staged) -> DataFrame:
    """``calls`` (conv_id, key, parent) with the number of calls above each; NULL where parents form a ring.

    Pointers to ancestors double in reach each round, so a chain of n calls
    takes log2(n) rounds, in however large a conversation.
    """
    steps = calls.select("conv_id", "key", F.col("parent").alias("up"), F.when(F.col("parent").isNotNull(), 1).otherwise(0).alias("level"))
    steps, n, left = staged.put("steps0", steps), 0, None
    while True:
        count = steps.filter("up IS NOT NULL").count()
        if count in (0, left):
            break
        left, n = count, n + 1
        above = steps.select("conv_id", F.col("key").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        done, open_ = steps.filter("up IS NULL"), steps.filter("up IS NOT NULL").join(above, ["conv_id", "up"])
        steps = staged.put(f"steps{n}", done.unionByName(open_.select(
            "conv_id", "key", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))))
        staged.drop(f"steps{n - 1}")
    return steps.select("conv_id", "key", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], every: bool = False) -> DataFrame:
    """Every call with its result.

    calls: conv_id, seq, call_id, parent_id (the call whose result it builds
    on), name, arguments (JSON text); results: conv_id, seq, call_id, content.
    Returns conv_id, level, seq, call_id, name, status, n_results, errors, json:
    one row per call and per result without one.  Sorting a conversation by
    level (NULLs last), seq, call_id puts every call behind those it builds on.

    status: linked, unanswered, orphan (a result without call), unknown_parent
    (a call whose parent isn't there; its level is 0), ring (its parents never
    end; its level is NULL).  errors: what the tool's schema finds.

    Calls and results meet in a join on conversation and identifier; levels
    come from pointer doubling: no conversation is gathered anywhere.

    Of several calls or results with one identifier the first by seq counts
    (n_results tells how many there were).  With ``every``, the others are rows
    of their own, without a level: duplicate_call (with its arguments and
    errors) and extra_result (with its content).  A NULL identifier is its own, never
    linked; a NULL conversation is one conversation; NULL arguments are
    not_json, a NULL name is an unknown_tool; empty tables are fine.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("call_id")), F.concat(F.lit("#"), F.coalesce(F.col("seq").cast("string"), F.lit(""))))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("#"))
    staged = Staged(calls.sparkSession, "toolcalls")

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        """Rows with numbers that stay, to find those that don't come first; NULL numbers if nobody asks for them."""
        return staged.put(name, rows.withColumn("row", F.monotonically_increasing_id())) if every else rows.withColumn("row", F.lit(None).cast("long"))

    c = keeping(calls, {n: F.col(n) for n in ("conv_id", "seq", "call_id", "parent_id", "name", "arguments")})
    all_calls = numbered(c.withColumns({"conv": conv, "key": F.concat(F.lit("c"), key)}), "all_calls")
    c = all_calls.groupBy("conv", "key").agg(F.min(F.struct("seq", "name", "arguments", "parent_id", "call_id", "conv_id", "row")).alias("c"))
    c = staged.put("calls", c.select("conv", "key", "c.*"))
    ids = c.select(F.col("conv").alias("conv_id"), F.col("key").alias("parent"))
    asked = c.select(F.col("conv").alias("conv_id"), "key", F.concat(F.lit("c="), F.col("parent_id")).alias("parent"))
    known = asked.join(ids, ["conv_id", "parent"], "left_semi").unionByName(
        asked.join(ids, ["conv_id", "parent"], "left_anti").withColumn("parent", F.lit(None).cast("string")))
    levels = call_levels(known.select("conv_id", "key", "parent"), staged)
    c = c.join(levels.select(F.col("conv_id").alias("conv"), "key", "level"), ["conv", "key"]).join(
        known.select(F.col("conv_id").alias("conv"), "key", F.col("parent").isNull().alias("rootless")), ["conv", "key"])

    r = keeping(results, {n: F.col(n) for n in ("conv_id", "seq", "call_id", "content")})
    all_results = numbered(r.withColumns({"conv": conv, "key": F.concat(F.when(F.col("call_id").isNull(), "r").otherwise("c"), key)}), "all_results")
    r = all_results.groupBy("conv", "key").agg(
        F.min(F.struct("seq", "content", "call_id", "conv_id", "row")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    both = c.withColumn("has_call", F.lit(True)).join(r, ["conv", "key"], "full_outer")
    has_call, has_result = F.coalesce("has_call", F.lit(False)), F.col("r").isNotNull()
    status = (F.when(~has_call, "orphan").when(F.col("level").isNull(), "ring")
              .when(F.col("rootless") & F.col("parent_id").isNotNull(), "unknown_parent")
              .when(has_result, "linked").otherwise("unanswered"))
    rows = both.select(
        F.coalesce("conv_id", "r.conv_id").alias("conv_id"), "level", F.coalesce("seq", "r.seq").alias("seq"),
        F.coalesce("call_id", "r.call_id").alias("call_id"), "name", "arguments", F.col("r.content").alias("content"),
        status.alias("status"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), has_call.alias("has_call"))
    if every:  # the rest meets the first ones by row number, so that no identifier is a hot key
        none = F.lit(None)
        again = all_calls.join(c.select("row"), "row", "left_anti").select(
            "conv_id", none.cast("int").alias("level"), "seq", "call_id", "name", "arguments", none.cast("string").alias("content"),
            F.lit("duplicate_call").alias("status"), F.lit(0).cast("long").alias("n_results"), F.lit(True).alias("has_call"))
        extra = all_results.join(r.select("r.row"), "row", "left_anti").select(
            "conv_id", none.cast("int").alias("level"), "seq", "call_id", none.cast("string").alias("name"), none.cast("string").alias("arguments"),
            "content", F.lit("extra_result").alias("status"), F.lit(0).cast("long").alias("n_results"), F.lit(False).alias("has_call"))
        rows = rows.unionByName(again).unionByName(extra)
    schema = StructType([*rows.schema.fields, StructField("errors", ArrayType(StringType())), StructField("json", StringType())])
    return rows.mapInArrow(_write(schemas, to_arrow_schema(schema)), schema).select(
        "conv_id", "level", "seq", "call_id", "name", "status", "n_results", "errors", "json")


#: The tools that turns of plain conversations are read as calls of.
SCHEMAS = {
    "answer": {"properties": {"text": {"type": "string"}, "turn": {"type": "integer", "minimum": 0},
                              "words": {"type": "integer", "minimum": 1, "maximum": 120}},
               "required": ["text", "turn", "words"], "additionalProperties": False},
    "greet": {"properties": {"text": {"type": "string", "maxLength": 400}, "turn": {"type": "integer", "enum": [0, 1]}},
              "required": ["text", "turn"]},
}


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as calls (of ``greet`` up to turn 1, else ``answer``), each built on the one two turns before;
    the user turn behind a call as its result."""
    name = lambda turn: F.concat_ws("_", F.lit("call"), F.col("conv_id").cast("string"), turn.cast("string"))
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))
    calls = turns.filter("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("seq"), name(F.col("turn")).alias("call_id"),
        F.when(F.col("turn") > 1, name(F.col("turn") - 2)).alias("parent_id"),
        F.when(F.col("turn") > 1, "answer").otherwise("greet").alias("name"),
        F.to_json(F.struct(words.alias("words"), F.col("turn").alias("turn"), text.alias("text"))).alias("arguments"))
    results = turns.filter("role = 'user' AND turn > 0").select(
        "conv_id", F.col("turn").alias("seq"), name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


TOOL_CALLS_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, 'call_' || conv_id || '_' || turn AS call_id,
       CASE WHEN turn > 1 THEN 'answer' ELSE 'greet' END AS name, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS words
     FROM conversations WHERE role = 'assistant'),
d AS (SELECT *, CASE WHEN name = 'greet' AND length(text) > 400 THEN 'length:text' WHEN name = 'answer' AND words NOT BETWEEN 1 AND 120
       THEN 'range:words' ELSE '' END AS errors,
       row_number() OVER (PARTITION BY conv_id, turn ORDER BY '{"words":' || words || ',"turn":' || turn || ',"text":' || to_json(text)::VARCHAR || '}') AS nth FROM t),
c AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM d WHERE nth = 1),
l AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1)::INTEGER AS level FROM c),
r0 AS (SELECT conv_id, turn, text AS content, 'call_' || conv_id || '_' || (turn - 1) AS call_id,
       row_number() OVER (PARTITION BY conv_id, turn ORDER BY text NULLS FIRST) AS nth, count(*) OVER (PARTITION BY conv_id, turn) AS n
     FROM conversations WHERE role = 'user' AND turn > 0),
r AS (SELECT * FROM r0 WHERE nth = 1),
j AS (SELECT coalesce(l.conv_id, r.conv_id) AS conv_id, level, coalesce(l.turn, r.turn) AS seq, coalesce(l.call_id, r.call_id) AS call_id,
       name, content, l.text, words, coalesce(errors, '') AS errors, coalesce(r.n, 0)::BIGINT AS n_results,
       CASE WHEN l.turn IS NULL THEN 'orphan' WHEN level = 0 AND l.turn > 1 THEN 'unknown_parent'
            WHEN r.turn IS NOT NULL THEN 'linked' ELSE 'unanswered' END AS status
     FROM l FULL OUTER JOIN r ON l.conv_id = r.conv_id AND l.call_id = r.call_id
     UNION ALL SELECT conv_id, NULL, turn, call_id, name, NULL, text, words, errors, 0, 'duplicate_call' FROM d WHERE nth > 1
     UNION ALL SELECT conv_id, NULL, turn, call_id, NULL, content, NULL, NULL, '', 0, 'extra_result' FROM r0 WHERE nth > 1)
SELECT conv_id, level, seq, call_id, name, status, n_results, errors, '{"arguments":' ||
  CASE WHEN name IS NULL THEN 'null' ELSE '{"text":' || to_json(text)::VARCHAR || ',"turn":' || seq || ',"words":' || words || '}' END ||
  ',"call_id":"' || call_id || '","name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') ||
  ',"status":"' || status || '","valid":' || CASE WHEN name IS NOT NULL AND errors = '' THEN 'true' ELSE 'false' END || '}' AS json FROM j"""


@query("op6_tool_calls", TOOL_CALLS_SQL)
def op6_tool_calls(spark, sf_dir):
    out = link_tool_calls(*calls_of_turns(table(spark, sf_dir, "conversations")), SCHEMAS, every=True)
    return out.withColumn("errors", F.array_join("errors", ","))
