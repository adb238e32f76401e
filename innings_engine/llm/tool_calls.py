"""Tool-call linking: calls and results joined by identifier, ordered by their dependencies, validated and serialised.

Native DataFrame functions only. A call is (conv_id, call_id, position, name, arguments as JSON text, after: call_ids it needs); a
result is (conv_id, call_id, position, content). Both are first reduced to one row per identifier (the earliest; ties by
content; repeats are counted), so the hash-partitioned join has unique keys and no hot one.

*Order.* ``level`` is the length of the longest chain of needed calls; (level, position) is a topological order of a
conversation. Levels come from rounds over the remaining dependency edges: a call stays blocked in a round while a call it needs
is blocked, and its level is the number of rounds it was blocked. A round is one semi join; there are as many as the longest
chain. Calls on or behind a cycle get a null level and the error ``cycle``. A needed call that doesn't exist is the error
``dangling``.

*Schemas* are (name, field, type, required); a type is integer, number, string, boolean, array, object or null. Errors are
listed in order: ``cycle``, ``dangling:id``, ``malformed``, ``missing:field``, ``no_tool``, ``type:field``, ``unknown:field``.

*JSON* is canonical: keys sorted by bytes, no white space, nested values as Spark's variant type writes them (keys sorted).
Malformed arguments are kept as a string. Null arguments are malformed; a null ``after`` is empty; rows with a null
identifier are left out on both sides, as nothing can link them. Extra columns are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

KEY = ["conv_id", "call_id"]


def quoted(text: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _unique(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The earliest row of each identifier and the number of rows."""
    return rows.where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.min(F.struct(*columns)).alias("row"), F.count("*").alias("rows"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, cyclic) of every call that needs an existing call; calls are unique."""
    ids = calls.select("conv_id", F.col("call_id").alias("needs"))
    live = keep(calls.select(*KEY, F.explode(F.array_distinct("after")).alias("needs")).join(ids, ["conv_id", "needs"]).select(*KEY, "needs"), "edges")
    left, rounds, stuck = live.count(), [], None
    while left:
        blocked = live.select(*KEY).distinct()
        rounds.append(blocked)
        on = blocked.withColumnRenamed("call_id", "needs")
        live = keep(live.join(on, ["conv_id", "needs"], "left_semi").select(*KEY, "needs"), "edges")
        before, left = left, live.count()
        if before == left:
            stuck = live.select(*KEY).distinct()
            break
    if not rounds:
        return live.select(*KEY, F.lit(0).alias("level"), F.lit(False).alias("cyclic"))
    every = rounds[0].withColumn("cyclic", F.lit(False))
    for more in rounds[1:]:
        every = every.union(more.withColumn("cyclic", F.lit(False)))
    if stuck is not None:
        every = every.union(stuck.withColumn("cyclic", F.lit(True)))
    found = every.groupBy(*KEY).agg(F.count("*").cast("int").alias("level"), F.max("cyclic").alias("cyclic"))
    return found.withColumn("level", F.when(~F.col("cyclic"), F.col("level")))


def _json_type(schema: Column) -> Column:
    kind = F.regexp_extract(schema, "^[A-Z]+", 0)
    return (F.when(kind == "BIGINT", "integer").when(kind.isin("DECIMAL", "DOUBLE", "FLOAT"), "number").when(kind == "STRING", "string")
            .when(kind == "BOOLEAN", "boolean").when(kind == "ARRAY", "array").when(kind == "OBJECT", "object").otherwise("null"))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call or orphaned result."""
    unique = _unique(calls.withColumn("after", F.coalesce("after", F.array().cast("array<string>"))), ["position", "name", "arguments", "after"])
    unique = keep(unique.select(*KEY, "row.*", F.col("rows").alias("n_calls")), "calls")
    answers = _unique(results, ["position", "content"]).select(*KEY, F.col("row.position").alias("result_position"), F.col("row.content").alias("content"), F.col("rows").alias("n_results"))
    joined = unique.withColumn("called", F.lit(True)).join(answers, KEY, "full").join(levels(unique), KEY, "left")

    needed = unique.select(*KEY, F.explode(F.array_distinct("after")).alias("needs"))
    ids = unique.select("conv_id", F.col("call_id").alias("needs"))
    dangling = needed.join(ids, ["conv_id", "needs"], "left_anti").groupBy(*KEY).agg(F.collect_list(F.concat(F.lit("dangling:"), "needs")).alias("dangling"))
    tools = schemas.groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "type"))).alias("fields"), F.collect_list(F.when(F.col("required"), F.col("field"))).alias("required"))
    read = joined.join(dangling, KEY, "left").join(tools, "name", "left").withColumn("value", F.try_parse_json("arguments"))
    is_object = F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False))
    read = read.withColumn("entries", F.when(is_object, F.map_entries(F.col("value").cast("map<string,variant>"))))
    read = read.withColumn("args", F.array_sort(F.transform("entries", lambda e: F.struct(
        e["key"].alias("key"), _json_type(F.schema_of_variant(e["value"])).alias("type"), F.to_json(e["value"]).alias("json")))))

    none, known = F.array().cast("array<string>"), F.coalesce(F.col("called"), F.lit(False))
    tagged = lambda tag, rows: F.transform(rows, lambda x: F.concat(F.lit(tag), x))
    keys = F.transform("args", lambda a: a["key"])
    errors = F.concat(
        F.when(F.coalesce("cyclic", F.lit(False)), F.array(F.lit("cycle"))).otherwise(none), F.coalesce("dangling", none),
        F.when(F.col("args").isNull(), F.array(F.lit("malformed"))).otherwise(none),
        F.when(F.col("fields").isNull(), F.array(F.lit("no_tool"))).otherwise(none),
        F.coalesce(tagged("missing:", F.array_except("required", keys)), none),
        F.coalesce(tagged("type:", F.transform(F.filter("args", lambda a: F.element_at("fields", a["key"]) != a["type"]), lambda a: a["key"])), none),
        F.coalesce(tagged("unknown:", F.array_except(keys, F.map_keys("fields"))), none))
    arguments = F.coalesce(F.concat(F.lit("{"), F.array_join(F.transform("args", lambda a: F.concat(quoted(a["key"]), F.lit(":"), a["json"])), ","), F.lit("}")),
                           quoted(F.col("arguments")), F.lit("null"))
    whole = F.concat(F.lit('{"arguments":'), F.when(known, arguments).otherwise("null"), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), F.coalesce(quoted(F.col("name")), F.lit("null")),
                     F.lit(',"result":'), F.coalesce(F.when(F.col("content").isNotNull(), quoted(F.col("content"))), F.lit("null")), F.lit("}"))
    return read.select(
        *KEY, F.when(known, "call").otherwise("orphan").alias("kind"), "position", F.when(known & ~F.coalesce("cyclic", F.lit(False)), F.coalesce("level", F.lit(0))).cast("int").alias("level"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        (known & F.coalesce(F.col("result_position") < F.col("position"), F.lit(False))).alias("early"),
        F.array_join(F.when(known, F.array_sort(errors)).otherwise(none), ",").alias("errors"), whole.alias("json"))


#: Tools of the calls derived from ``conversations``.
TOOLS = [
    ("search", "query", "string", True), ("search", "limit", "integer", True), ("search", "strict", "boolean", False),
    ("summarize", "query", "string", True), ("summarize", "limit", "integer", False), ("summarize", "strict", "boolean", False),
    ("classify", "query", "string", True), ("classify", "limit", "integer", False), ("classify", "strict", "boolean", True)]


def schemas_of(spark) -> DataFrame:
    return spark.createDataFrame(TOOLS, "name string, field string, type string, required boolean")


def calls_of(conversations: DataFrame) -> DataFrame:
    """Every turn that isn't the assistant's as a call on its text, needing the call of a quarter of its turn (in pairs)."""
    t, salt = F.col("turn"), F.col("conv_id") + F.col("turn")
    every = lambda n: F.pmod(salt, F.lit(n)) == 0
    text, size = F.coalesce("text", F.lit("")), F.length(F.coalesce("text", F.lit("")))
    arguments = F.concat(
        F.lit('{ "strict": '), F.when(size > 200, "true").otherwise("false"),
        F.when(every(7), "").otherwise(F.concat(F.lit(', "query": '), quoted(text))),
        F.lit(', "limit": '), F.when(every(5), F.concat(F.lit('"'), size.cast("string"), F.lit('"'))).otherwise(size.cast("string")),
        F.when(every(11), ', "debug": true').otherwise(""), F.when(every(13), "").otherwise("}"))
    return conversations.where("role <> 'assistant'").select(
        "conv_id", F.concat(F.lit("call_"), t.cast("string")).alias("call_id"), t.alias("position"),
        F.element_at(F.array(*map(F.lit, ("search", "summarize", "classify", "translate"))), F.when(every(17), 4).otherwise(F.pmod(t, F.lit(3)) + 1).cast("int")).alias("name"),
        arguments.alias("arguments"), F.when(t > 0, F.array(F.concat(F.lit("call_"), (2 * F.floor(t / 4)).cast("string")))).alias("after"))


def results_of(conversations: DataFrame) -> DataFrame:
    """Every turn of the assistant as the result of the call before it."""
    return conversations.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))


SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) AS size, (conv_id + turn) AS salt FROM conversations WHERE role <> 'assistant'),
made AS (
  SELECT conv_id, turn,
    CASE WHEN salt % 17 = 0 THEN 'translate' ELSE ['search', 'summarize', 'classify'][turn % 3 + 1] END AS name,
    '{ "strict": ' || CASE WHEN size > 200 THEN 'true' ELSE 'false' END || CASE WHEN salt % 7 = 0 THEN '' ELSE ', "query": ' || CAST(to_json(text) AS VARCHAR) END
      || ', "limit": ' || CASE WHEN salt % 5 = 0 THEN '"' || size || '"' ELSE size || '' END || CASE WHEN salt % 11 = 0 THEN ', "debug": true' ELSE '' END || CASE WHEN salt % 13 = 0 THEN '' ELSE '}' END AS arguments,
    '{' || CASE WHEN salt % 11 = 0 THEN '"debug":true,' ELSE '' END || '"limit":' || CASE WHEN salt % 5 = 0 THEN '"' || size || '"' ELSE size || '' END
      || CASE WHEN salt % 7 = 0 THEN '' ELSE ',"query":' || CAST(to_json(text) AS VARCHAR) END || ',"strict":' || CASE WHEN size > 200 THEN 'true' ELSE 'false' END || '}' AS canonical,
    salt
  FROM raw),
calls AS (
  SELECT conv_id, turn, count(*) AS n_calls, (min({'name': name, 'arguments': arguments, 'canonical': canonical, 'salt': salt})) AS c FROM made GROUP BY conv_id, turn),
results AS (
  SELECT conv_id, turn - 1 AS turn, count(*) AS n_results, min({'turn': turn, 'text': text}) AS r FROM conversations WHERE role = 'assistant' GROUP BY ALL),
depth AS (
  SELECT conv_id, turn, 0 AS level FROM calls k
  WHERE turn = 0 OR NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = k.conv_id AND p.turn = 2 * (k.turn // 4))
  UNION ALL
  SELECT k.conv_id, k.turn, d.level + 1 FROM depth d JOIN calls k ON k.conv_id = d.conv_id AND d.turn = 2 * (k.turn // 4) AND k.turn > 0),
judged AS (
  SELECT k.*, d.level, c.salt % 13 = 0 AS broken,
    [x FOR x IN [
      CASE WHEN turn > 0 AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = k.conv_id AND p.turn = 2 * (k.turn // 4)) THEN 'dangling:call_' || (2 * (turn // 4)) END,
      CASE WHEN c.salt % 13 = 0 THEN 'malformed' END,
      CASE WHEN c.name = 'translate' THEN 'no_tool' END,
      CASE WHEN c.salt % 13 <> 0 AND c.name <> 'translate' AND c.salt % 7 = 0 THEN 'missing:query' END,
      CASE WHEN c.salt % 13 <> 0 AND c.name <> 'translate' AND c.salt % 5 = 0 THEN 'type:limit' END,
      CASE WHEN c.salt % 13 <> 0 AND c.name <> 'translate' AND c.salt % 11 = 0 THEN 'unknown:debug' END] IF x IS NOT NULL] AS errors
  FROM calls k JOIN depth d USING (conv_id, turn))
SELECT conv_id, 'call_' || turn AS call_id, CASE WHEN j.c IS NULL THEN 'orphan' ELSE 'call' END AS kind, CASE WHEN j.c IS NOT NULL THEN turn END AS position,
  j.level, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, false AS early, coalesce(array_to_string(list_sort(errors), ','), '') AS errors,
  '{"arguments":' || CASE WHEN j.c IS NULL THEN 'null' WHEN broken THEN CAST(to_json(j.c.arguments) AS VARCHAR) ELSE j.c.canonical END || ',"id":"call_' || turn || '","name":'
    || CASE WHEN j.c IS NULL THEN 'null' ELSE '"' || j.c.name || '"' END || ',"result":' || CASE WHEN s.r.text IS NULL THEN 'null' ELSE CAST(to_json(s.r.text) AS VARCHAR) END || '}' AS json
FROM judged j FULL JOIN results s USING (conv_id, turn)
"""
