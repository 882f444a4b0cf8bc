"""Tool-call linking: results joined to calls by identifier, calls in topological order, arguments checked, canonical JSON.

Messages are rows (conv_id, turn, role, text). An assistant message with ``{"tool_calls": [{"id", "name", "arguments", "after"}]}``
makes calls; ``after`` lists the calls whose results it needs. A tool message ``{"tool_call_id", "content"}`` is a result.

* Calls and results meet in a hash join on (conv_id, call_id); both sides hold one row per identifier, combined before the
  shuffle, so an identifier with a third of all rows is no hot task.
* The level of a call is 0 without known calls to wait for, else one more than the highest of those; (level, turn, position) is
  a topological order. Conversations are cut into chunks of ``CHUNK_TURNS`` turns, so no task holds a long one. A round settles
  in every chunk what waits only for settled calls or for calls of the chunk; what crosses chunks takes further rounds, one per
  crossing of the longest path. What no round settles lies on or behind a cycle and has a null level.
* Arguments are checked against the JSON schema of the tool (type, also a list of types, required, properties, enum, minimum, maximum,
  items, additionalProperties; true and false as schemas). ``errors`` is "unknown_tool" without a schema, ":schema" where the schema is no
  JSON or not of that form, ":json" where the arguments are no JSON (NaN and infinite numbers are none), ":depth" where they are nested
  more than ``DEPTH`` deep; in the last two cases the message holds null arguments.

Defined results: of calls that share an identifier in a conversation the first by (turn, position, arguments) counts and
``n_calls`` tells how many there were; of results likewise by (turn, content). Results without a call are returned with
``kind`` orphan_result. Messages whose text is null or no such JSON hold neither. Null conv_ids are a conversation of their
own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from trackloom.llm.common import lookup, materialize, oracle, query

CALL = StructType([StructField("id", StringType()), StructField("name", StringType()), StructField("arguments", StringType()),
                   StructField("after", ArrayType(StringType()))])
CHUNK_TURNS = 512
SHARD_CALLS = 4096


DEPTH = 128  # arguments and schemas nested deeper are not read
NESTING = re.compile(r'"(?:[^"\\]|\\.)*"?|[\[{\]}]', re.S)
LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; values equal in kind and content give equal texts. Lone surrogates stay escapes."""
    return written(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def written(text: str) -> str:
    """The text with lone surrogates as escapes: UTF-8 cannot hold them."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _finite(number: str) -> float:
    if math.isinf(value := float(number)):
        raise ValueError(number)
    return value


def _no_constant(name: str):
    raise ValueError(name)


def parsed(text: str):
    """The value of a JSON text; ValueError where it is none (NaN and infinities are none) and OverflowError where it is nested too deep."""
    depth = most = 0
    for m in NESTING.finditer(text):
        depth += (m[0] in "[{") - (m[0] in "]}")
        most = max(most, depth)
    if most > DEPTH:
        raise OverflowError(most)
    return json.loads(text, parse_constant=_no_constant, parse_float=_finite)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}


def is_kind(value, kind: str) -> bool:
    return isinstance(value, _KINDS[kind]) and (kind == "boolean" or not isinstance(value, bool))


def kinds_of(schema: dict) -> list[str]:
    """The types a schema allows; none named: all."""
    kind = schema.get("type")
    return [] if kind is None else kind if isinstance(kind, list) else [kind]


def well_formed(schema) -> bool:
    """Every rule of the schema that is read has the form it needs; a schema is an object, or true or false."""
    if isinstance(schema, bool):
        return True
    if not isinstance(schema, dict) or not all(isinstance(k, str) and k in _KINDS for k in kinds_of(schema)):
        return False
    properties, required = schema.get("properties", {}), schema.get("required", [])
    return (isinstance(properties, dict) and all(map(well_formed, properties.values())) and isinstance(required, list)
            and all(isinstance(k, str) for k in required) and isinstance(schema.get("enum", []), list) and well_formed(schema.get("items", True))
            and all(is_kind(schema.get(k, 0), "number") for k in ("minimum", "maximum")))


def schema_of(text: str) -> dict | bool | None:
    """The schema a text holds, or null where it holds none."""
    try:
        schema = parsed(text)
    except (ValueError, OverflowError):
        return None
    return schema if well_formed(schema) else None


def violations(value, schema: dict | bool, path: str = "") -> list[str]:
    """What of a well-formed ``schema`` the value breaks, as "path:rule" in a fixed order."""
    if isinstance(schema, bool):
        return [] if schema else [f"{path}:never"]
    found = []
    kinds = kinds_of(schema)
    if kinds and not any(is_kind(value, k) for k in kinds):
        return [f"{path}:type"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{path}:enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{path}:minimum"] * (value < schema.get("minimum", value)) + [f"{path}:maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, dict):
        properties = schema.get("properties", {})
        found += [f"{path}.{k}:required" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in properties:
                found += violations(value[k], properties[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{path}.{k}:additional")
    if isinstance(value, list) and "items" in schema:
        found += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{path}[{i}]")]
    return found


CHECKED = StructType([StructField("errors", StringType()), StructField("message", StringType())])


@F.pandas_udf(CHECKED)
def checked(call_id: pd.Series, name: pd.Series, arguments: pd.Series, schema: pd.Series, result: pd.Series) -> pd.DataFrame:
    out = []
    for i, n, a, s, r in zip(call_id, name, arguments, schema, result):
        value, errors = None, []
        try:
            value = parsed(a) if a is not None else None
        except OverflowError:
            errors = [":depth"]
        except ValueError:
            errors = [":json"]
        if not errors:
            rules = schema_of(s) if s is not None else None
            errors = ["unknown_tool"] if s is None else [":schema"] if rules is None else violations(value, rules)
        out.append((written(",".join(errors)), canonical({"arguments": value, "id": i, "name": n, "result": r})))
    return pd.DataFrame(out, columns=CHECKED.names)


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of messages: one row per identifier and conversation, the first of those that share it."""
    rows = messages.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    calls = (rows.filter("role = 'assistant'")
             .select("conv", "turn", F.posexplode(F.from_json("text", StructType([StructField("tool_calls", ArrayType(CALL))]))["tool_calls"]).alias("pos", "c"))
             .filter("c.id IS NOT NULL")
             .groupBy("conv", F.col("c.id").alias("call_id"))
             .agg(F.min(F.struct("turn", "pos", "c.arguments", "c.name", "c.after")).alias("m"), F.count(F.lit(1)).alias("n_calls"))
             .select("conv", "call_id", "m.turn", "m.pos", "m.name", "m.arguments", "m.after", "n_calls"))
    results = (rows.filter("role = 'tool'")
               .select("conv", "turn", F.from_json("text", "tool_call_id string, content string").alias("r")).filter("r.tool_call_id IS NOT NULL")
               .groupBy("conv", F.col("r.tool_call_id").alias("call_id"))
               .agg(F.min(F.struct("turn", "r.content")).alias("m"), F.count(F.lit(1)).alias("n_results"))
               .select("conv", "call_id", F.col("m.turn").alias("result_turn"), F.col("m.content").alias("result"), "n_results"))
    return calls, results


def _same(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]):
    on = left[pairs[0][0]].eqNullSafe(right[pairs[0][1]])
    for a, b in pairs[1:]:
        on = on & (left[a] == right[b])
    return on


def _settle(rows: list[tuple[str, int, list[str]]]) -> list[tuple[str, int]]:
    """(call, level) of the calls of one chunk that wait for nothing outside it; from (call, level so far, open waits)."""
    base = {call: level for call, level, _ in rows}
    waiting: dict[str, list[str]] = {}
    count = {}
    for call, _, others in rows:
        count[call] = len(others)
        for o in others:
            waiting.setdefault(o, []).append(call)
    ready = [c for c, n in count.items() if n == 0]
    done = []
    while ready:
        call = ready.pop()
        done.append((call, base[call]))
        for later in waiting.get(call, ()):
            base[later] = max(base[later], base[call] + 1)
            count[later] -= 1
            if count[later] == 0:
                ready.append(later)
    return done


def _settle_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """All chunks of a shard; one call of pandas for many small conversations."""
    chunks: dict[tuple, list[tuple]] = {}
    for conv, chunk, call, base, others in zip(pdf["conv"].tolist(), pdf["chunk"].tolist(), pdf["call_id"], pdf["base"].tolist(), pdf["open"]):
        chunks.setdefault((None if pd.isna(conv) else conv, chunk), []).append((call, base, others))
    return pd.DataFrame([(conv, *x) for (conv, _), rows in chunks.items() for x in _settle(rows)], columns=["l_conv", "l_id", "level"])


def levels(calls: DataFrame) -> DataFrame:
    """(l_conv, l_id, level) of the calls that can be ordered."""
    conv_type = dict(calls.dtypes)["conv"]
    nodes = calls.select(F.col("conv").alias("l_conv"), F.col("call_id").alias("l_id"))
    waits = calls.select("conv", "call_id", F.explode("after").alias("other")).distinct()
    waits = materialize(waits.join(nodes, _same(waits, nodes, ("conv", "l_conv"), ("other", "l_id")), "left_semi"), "waits")
    unsettled = calls.select("conv", "call_id", F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(0)).alias("chunk"))
    # some thousand calls to a shard, and no more shards than there is work for
    shards = max(1, -(-calls.count() // SHARD_CALLS))
    done = None
    while True:
        if done is None:
            open_ = waits.groupBy("conv", "call_id").agg(F.lit(0).cast("long").alias("base"), F.collect_list("other").alias("open"))
        else:
            met = waits.join(done, _same(waits, done, ("conv", "l_conv"), ("other", "l_id")), "left")
            open_ = met.groupBy("conv", "call_id").agg(F.coalesce(F.max(F.col("level") + 1), F.lit(0)).alias("base"),
                                                       F.collect_list(F.when(F.col("level").isNull(), F.col("other"))).alias("open"))
        open_ = open_.select(F.col("conv").alias("o_conv"), F.col("call_id").alias("o_id"), "base", "open")
        rows = unsettled.join(open_, _same(unsettled, open_, ("conv", "o_conv"), ("call_id", "o_id")), "left").select(
            "conv", "call_id", "chunk", F.coalesce("base", F.lit(0).cast("long")).alias("base"),
            F.coalesce("open", F.array().cast("array<string>")).alias("open"))
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("conv", "chunk"), F.lit(shards)))
        fresh = materialize(rows.groupBy("shard").applyInPandas(_settle_shard, f"l_conv {conv_type}, l_id string, level long"), "level")
        if not fresh.take(1):
            return done if done is not None else fresh
        done = fresh if done is None else done.unionByName(fresh)
        unsettled = materialize(unsettled.join(fresh, _same(unsettled, fresh, ("conv", "l_conv"), ("call_id", "l_id")), "left_anti"), "unsettled")
        waits = waits.join(unsettled.select(F.col("conv").alias("u_conv"), F.col("call_id").alias("u_id")),
                           F.col("conv").eqNullSafe(F.col("u_conv")) & (F.col("call_id") == F.col("u_id")), "left_semi")
        if not unsettled.take(1):
            return done


def link_tool_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call (kind call) and per result without a call (kind orphan_result); ``schemas`` has (name, schema)."""
    calls, results = parse_messages(messages)
    calls, results = materialize(calls, "calls"), materialize(results, "results")
    order = levels(calls)
    got = results.select(F.col("conv").alias("r_conv"), F.col("call_id").alias("r_id"), "result_turn", "result", "n_results")
    linked = calls.join(got, _same(calls, got, ("conv", "r_conv"), ("call_id", "r_id")), "left")
    linked = linked.join(order, _same(calls, order, ("conv", "l_conv"), ("call_id", "l_id")), "left")
    linked = lookup(linked, schemas.select(F.col("name").alias("s_name"), "schema").dropDuplicates(["s_name"]), F.col("name") == F.col("s_name"), "left")
    linked = linked.withColumn("checked", checked("call_id", "name", "arguments", "schema", "result"))
    calls_out = linked.select(F.col("conv").alias("conv_id"), "call_id", F.lit("call").alias("kind"), "name", "turn", F.col("pos").cast("long").alias("pos"),
                              F.col("level").cast("long").alias("level"), "n_calls", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
                              "result_turn", "checked.errors", F.col("checked.message").alias("message"))
    ids = calls.select(F.col("conv").alias("c_conv"), F.col("call_id").alias("c_id"))
    orphans = results.join(ids, _same(results, ids, ("conv", "c_conv"), ("call_id", "c_id")), "left_anti").select(
        F.col("conv").alias("conv_id"), "call_id", F.lit("orphan_result").alias("kind"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("level"),
        F.lit(0).cast("long").alias("n_calls"), F.col("n_results").cast("long").alias("n_results"), "result_turn",
        F.lit(None).cast("string").alias("errors"), F.lit(None).cast("string").alias("message"))
    return calls_out.unionByName(orphans)


# The given conversations hold no calls. Each assistant turn is read as one or two calls, each user turn as a result for the turn before.
SCHEMAS = {
    "search": {"type": "object", "required": ["limit", "query"], "additionalProperties": False,
               "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 15}}},
    "calculate": {"type": "object", "required": ["left", "op", "right"],
                  "properties": {"left": {"type": "number"}, "right": {"type": "number"}, "op": {"type": "string", "enum": ["add", "sub"]}}},
    "translate": {"type": "object", "required": ["text", "to"], "properties": {"text": {"type": "string"}, "to": {"type": "string"}}},
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Messages with calls and results in JSON, one per row of the given table."""
    n, first = F.length("text"), F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0)
    arguments = F.when((n + F.col("k")) % 4 == 0, F.to_json(F.struct(first.alias("query"), (n % 20).alias("limit")))) \
        .when((n + F.col("k")) % 4 == 1, F.to_json(F.struct(F.when(n % 3 == 0, "add").when(n % 3 == 1, "sub").otherwise("pow").alias("op"),
                                                            n.alias("left"), F.col("k").alias("right")))) \
        .when((n + F.col("k")) % 4 == 2, F.to_json(F.struct(first.alias("text"), F.when(n % 5 != 0, F.lit("de")).alias("to")))) \
        .otherwise("{}")
    name = F.element_at(F.array(*map(F.lit, ("search", "calculate", "translate", "remember"))), ((n + F.col("k")) % 4 + 1).cast("int"))
    ident = lambda turn, k: F.concat(F.lit("c"), turn.cast("string"), F.lit("_"), k.cast("string"))
    after = F.array_compact(F.array(F.when(F.col("turn") >= 2, ident(F.col("turn") - 2, F.lit(1))),
                                    F.when(F.col("k") == 2, ident(F.col("turn"), F.lit(1))),
                                    F.when((F.col("k") == 1) & (n % 97 == 0), ident(F.col("turn"), F.lit(2)))))
    rows = conversations.select("conv_id", "turn", "role", "text").filter("text IS NOT NULL")
    made = rows.filter("role = 'assistant'").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(1) + n % 2)))
    made = made.select("conv_id", "turn", "role", F.to_json(F.struct(F.array(F.struct(
        ident(F.col("turn"), F.col("k")).alias("id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))).alias("tool_calls"))).alias("text"))
    got = rows.filter("role = 'user' AND turn >= 1").select(
        "conv_id", "turn", F.lit("tool").alias("role"),
        F.to_json(F.struct(ident(F.col("turn") - 1, F.lit(1)).alias("tool_call_id"), first.alias("content"))).alias("text"))
    return made.unionByName(got)


@query("op1_link_tool_calls")
def op1_link_tool_calls(spark, sf_dir):
    schemas = spark.createDataFrame([(k, canonical(v)) for k, v in SCHEMAS.items()], "name string, schema string")
    return link_tool_calls(tool_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), schemas)


oracle("op1_link_tool_calls", r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, length(text) AS n, regexp_extract(text, '[^\x20\x09-\x0D]+') AS w FROM conversations WHERE text IS NOT NULL),
q AS (SELECT conv_id, turn, n, w, unnest(range(1, 2 + n % 2)) AS k FROM t WHERE role = 'assistant'),
c0 AS (SELECT conv_id, turn, 'c' || turn || '_' || k AS call_id, k, n, ['search', 'calculate', 'translate', 'remember'][(n + k) % 4 + 1] AS name,
    CASE (n + k) % 4 WHEN 0 THEN '{"limit":' || (n % 20) || ',"query":' || to_json(w) || '}'
      WHEN 1 THEN '{"left":' || n || ',"op":"' || ['add', 'sub', 'pow'][n % 3 + 1] || '","right":' || k || '}'
      WHEN 2 THEN '{"text":' || to_json(w) || CASE WHEN n % 5 <> 0 THEN ',"to":"de"' ELSE '' END || '}' ELSE '{}' END AS args,
    CASE (n + k) % 4 WHEN 0 THEN CASE WHEN n % 20 < 1 THEN '.limit:minimum' WHEN n % 20 > 15 THEN '.limit:maximum' ELSE '' END
      WHEN 1 THEN CASE WHEN n % 3 = 2 THEN '.op:enum' ELSE '' END
      WHEN 2 THEN CASE WHEN n % 5 = 0 THEN '.to:required' ELSE '' END ELSE 'unknown_tool' END AS errors
  FROM q),
c AS (SELECT conv_id, call_id, arg_min((turn, k, n, name, args, errors), (turn, args, name)) AS m, count(*) AS n_calls FROM c0 GROUP BY ALL),
calls AS MATERIALIZED (SELECT conv_id, call_id, m[1] AS turn, m[2] AS k, m[3] AS n, m[4] AS name, m[5] AS args, m[6] AS errors, n_calls FROM c),
waits AS MATERIALIZED (SELECT a.conv_id, a.call_id, a.other FROM (
    SELECT conv_id, call_id, 'c' || (turn - 2) || '_1' AS other FROM calls WHERE turn >= 2
    UNION SELECT conv_id, call_id, 'c' || turn || '_1' FROM calls WHERE k = 2
    UNION SELECT conv_id, call_id, 'c' || turn || '_2' FROM calls WHERE k = 1 AND n % 97 = 0) a
  WHERE EXISTS (SELECT 1 FROM calls b WHERE b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.call_id = a.other)),
stuck AS (SELECT conv_id, call_id FROM waits a WHERE EXISTS (SELECT 1 FROM waits b WHERE b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.call_id = a.other AND b.other = a.call_id)
  UNION SELECT w.conv_id, w.call_id FROM waits w JOIN stuck s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.other = s.call_id),
walk AS (SELECT conv_id, call_id, 0 AS level FROM calls
  UNION SELECT w.conv_id, w.call_id, level + 1 FROM walk k JOIN waits w ON w.conv_id IS NOT DISTINCT FROM k.conv_id AND w.other = k.call_id WHERE level < 20),
lv AS (SELECT conv_id, call_id, max(level) AS level FROM walk GROUP BY ALL),
r AS (SELECT conv_id, 'c' || (turn - 1) || '_1' AS call_id, arg_min((turn, w), (turn, w)) AS m, count(*) AS n_results FROM t WHERE role = 'user' AND turn >= 1 GROUP BY ALL)
SELECT c.conv_id, c.call_id, 'call' AS kind, c.name, c.turn, CAST(0 AS BIGINT) AS pos, CAST(CASE WHEN s.call_id IS NULL THEN lv.level END AS BIGINT) AS level, c.n_calls,
    coalesce(r.n_results, 0) AS n_results, r.m[1] AS result_turn, c.errors,
    '{"arguments":' || args || ',"id":"' || c.call_id || '","name":"' || c.name || '","result":' || coalesce(to_json(r.m[2]), 'null') || '}' AS message
  FROM calls c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.call_id = c.call_id
    LEFT JOIN lv ON lv.conv_id IS NOT DISTINCT FROM c.conv_id AND lv.call_id = c.call_id
    LEFT JOIN stuck s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.call_id = c.call_id
UNION ALL SELECT conv_id, call_id, 'orphan_result', NULL, NULL, NULL, NULL, 0, n_results, m[1], NULL, NULL FROM r
  WHERE NOT EXISTS (SELECT 1 FROM calls b WHERE b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.call_id = r.call_id)""")
