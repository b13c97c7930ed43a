"""Tool-call linking with DataFrame operations only.

Calls and results meet by (conversation, identifier).  Calls are ordered topologically: a call's step is one more than
the greatest step of the calls it depends on.  Arguments are checked against the tools' schemas, and every call becomes
canonical JSON: keys in order, no blanks, at every depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

#: tool: {parameter: (type, required)}; types are those of JSON, and integer.
Schemas = dict[str, dict[str, tuple[str, bool]]]

_KINDS = {"string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID$"}


def argument_kinds(arguments: Column) -> Column:
    """parameter: type, of a JSON text that is an object; else null."""
    is_object = F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT")
    return F.when(is_object, F.transform_values(F.from_json(arguments, "map<string,variant>"), lambda k, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))))


def argument_errors(name: Column, kinds: Column, schemas: Schemas) -> Column:
    """An array of what is wrong with arguments of such types; empty if nothing is."""
    out = F.array(F.concat(F.lit("tool: unknown "), F.coalesce(name, F.lit("null"))))
    for tool, parameters in schemas.items():
        checks = []
        for p, (kind, required) in sorted(parameters.items()):
            there = F.array_contains(F.map_keys(kinds), p)
            checks.append(F.when(~there, F.lit(f"{p}: missing") if required else F.lit(None)).when(~F.try_element_at(kinds, F.lit(p)).rlike(_KINDS[kind]), F.lit(f"{p}: no {kind}")))
        unknown = F.transform(F.array_sort(_others(F.map_keys(kinds), tuple(parameters))), lambda k: F.concat(k, F.lit(": unknown")))
        found = F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), unknown)
        out = F.when(name == tool, F.when(kinds.isNotNull(), found).otherwise(F.array(F.lit("arguments: no JSON object")))).otherwise(out)
    return out


def _others(keys: Column, names: tuple[str, ...]) -> Column:
    return F.filter(keys, lambda k: ~k.isin(*names))


def hashed(right: DataFrame) -> DataFrame:
    """The side of a hash join that is built; it has a key once (or is asked only whether it has it), so no key is heavy."""
    return right.hint("shuffle_hash")


def steps(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, step) for all calls that are in or behind no cycle.

    calls: distinct (conv_id, call_id); edges: distinct (conv_id, call_id, needs) with both ends among the calls.
    One round for each step: calls whose needs are all placed are placed and leave the table.
    """
    key = ["conv_id", "call_id"]
    placed = stored(calls.join(hashed(edges.select(*key).distinct()), key, "left_anti").withColumn("step", F.lit(0)), "placed")
    rest, layers = stored(edges, "waiting"), [placed]
    while True:
        known = placed.select("conv_id", F.col("call_id").alias("needs"), "step")
        # an edge whose need has been placed keeps its step only
        seen = rest.join(hashed(known), ["conv_id", "needs"], "left") if "at" not in rest.columns else rest.join(hashed(known), ["conv_id", "needs"], "left").withColumn("step", F.coalesce("at", "step")).drop("at")
        seen = stored(seen.withColumnRenamed("step", "at"), "waiting")
        placed = stored(seen.groupBy(*key).agg(F.count(F.when(F.col("at").isNull(), 1)).alias("open"), F.max("at").alias("last")).where("open = 0").select(*key, (F.col("last") + 1).alias("step")), "placed")
        discard(rest)
        if placed.isEmpty():
            break
        layers.append(placed)
        rest = seen.join(hashed(placed), key, "left_anti").select("conv_id", "call_id", "needs", "at")
        rest = stored(rest, "waiting")
        discard(seen)
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    return out


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """A row for each call, and one for each result whose identifier no call has.

    calls: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of identifiers);
    results: conv_id, turn, call_id, content.  Returned: conv_id, turn, call_id, name, status (linked, no_result,
    orphan_result), n_results, step, errors (joined by "; "), message (canonical JSON).

    The result of the earliest turn counts (ties: the least content), and n_results tells how many there are.  Calls
    that share an identifier are all kept and share results and step, which needs what any of them needs.  Needs that
    are no call of the conversation, and a call's need of itself, are errors and don't count for steps; calls in or
    behind a cycle have a null step and an error.  Null conversations or identifiers link to nothing and have step 0.
    Arguments that are no JSON object are an error and null in the message.  Empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    calls = stored(calls.select("conv_id", "turn", "call_id", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")), "calls")
    results = results.select("conv_id", "turn", "call_id", "content")
    nodes = calls.select(*key).where("conv_id IS NOT NULL AND call_id IS NOT NULL").distinct()
    needs = calls.select(*key, F.explode(F.array_distinct("depends_on")).alias("needs")).where("needs IS NOT NULL AND conv_id IS NOT NULL AND call_id IS NOT NULL").distinct()
    known = needs.where("needs <> call_id").join(hashed(nodes.withColumnRenamed("call_id", "needs")), ["conv_id", "needs"], "left_semi")
    edges = stored(known.select("conv_id", "call_id", "needs"), "needs")
    bad = needs.join(hashed(edges), [*key, "needs"], "left_anti").groupBy(*key).agg(F.array_sort(F.collect_set("needs")).alias("bad"))
    answers = results.groupBy(*key).agg(F.min_by("content", F.struct("turn", "content")).alias("content"), F.count(F.lit(1)).alias("n_results"))
    joined = calls.join(hashed(answers), key, "left").join(hashed(steps(nodes, edges)), key, "left").join(hashed(bad), key, "left")
    joined = joined.withColumns({"_kinds": argument_kinds(F.col("arguments")), "_parsed": F.try_parse_json(F.col("arguments"))})
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    step = F.when(~named, F.lit(0)).otherwise(F.col("step"))
    errors = F.concat(argument_errors(F.col("name"), F.col("_kinds"), schemas), F.transform(F.coalesce("bad", F.array().cast("array<string>")), lambda n: F.concat(F.lit("needs: unknown "), n)), F.when(step.isNull(), F.array(F.lit("needs: cycle"))).otherwise(F.array().cast("array<string>")))
    parsed = F.col("_parsed")
    message = F.to_json(F.struct(F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed).alias("arguments"), F.array_sort(F.array_distinct("depends_on")).alias("depends_on"), F.col("call_id").alias("id"), F.col("name").alias("name"), F.col("content").alias("result"), step.alias("step")), {"ignoreNullFields": "false"})
    linked = joined.select("conv_id", "turn", "call_id", "name", F.when(F.col("n_results").isNull(), "no_result").otherwise("linked").alias("status"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), step.alias("step"), F.array_join(errors, "; ").alias("errors"), message.alias("message"))
    orphans = results.join(hashed(nodes), key, "left_anti").select("conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit("orphan_result").alias("status"), F.lit(1).cast("long").alias("n_results"), F.lit(None).cast("int").alias("step"), F.lit("result: no call").alias("errors"), F.to_json(F.struct(F.col("call_id").alias("id"), F.col("content").alias("result")), {"ignoreNullFields": "false"}).alias("message"))
    return linked.unionByName(orphans)


#: The tools that turns_as_calls() speaks of.
TOOLS: Schemas = {
    "lookup": {"exact": ("boolean", False), "key": ("string", True)},
    "rank": {"items": ("array", True), "top": ("integer", False)},
    "search": {"limit": ("integer", True), "query": ("string", True)},
}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations: a user's turn is a call, an assistant's turn is the result of the turn before.

    The tool follows from the text's length n (n % 3); some arguments break the schema (n even).  The call of turn t
    needs that of the turn half as far into the conversation.
    Turns of any other role (system, null, others) are neither calls nor results and give no row, here and in the SQL.
    """
    t = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    n, i = F.length("text"), F.floor(F.col("turn") / 2)
    lookup = F.when(n % 2 == 0, F.to_json(F.struct(F.col("text").alias("key"), F.lit("yes").alias("exact")))).otherwise(F.to_json(F.struct(F.col("text").alias("key"), (F.col("turn") % 4 == 0).alias("exact"))))
    rank = F.when(n % 2 == 0, F.to_json(F.struct(n.alias("top")))).otherwise(F.to_json(F.struct(n.alias("top"), F.array("role", "text").alias("items"))))
    search = F.to_json(F.struct(F.col("text").alias("query"), n.alias("limit")))
    name = F.when(n % 3 == 1, "lookup").when(n % 3 == 2, "rank").otherwise("search")
    identifier = lambda at: F.concat(F.lit("call-"), at.cast("string"))
    needs = F.when(F.col("turn") >= 2, F.array(identifier(F.floor((i - 1) / 2) * 2 + F.col("turn") % 2))).otherwise(F.array().cast("array<string>"))
    calls = t.where("role = 'user'").select("conv_id", "turn", identifier(F.col("turn")).alias("call_id"), name.alias("name"), F.when(n % 3 == 1, lookup).when(n % 3 == 2, rank).when(n % 3 == 0, search).alias("arguments"), needs.alias("depends_on"))
    results = t.where("role = 'assistant'").select("conv_id", "turn", identifier(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations' calls, linked, ordered, validated and serialised."""
    return link_tool_calls(*turns_as_calls(table(spark, sf_dir, "conversations")), TOOLS)


ORACLE = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations),
c AS (SELECT conv_id, turn, 'call-' || turn AS call_id, text, n, role,
             CASE n % 3 WHEN 1 THEN 'lookup' WHEN 2 THEN 'rank' ELSE 'search' END AS name,
             CASE WHEN turn >= 2 THEN CAST(floor((floor(turn / 2.0) - 1) / 2.0) * 2 + turn % 2 AS BIGINT) END AS needs
      FROM t WHERE role = 'user'),
r AS (SELECT conv_id, turn, 'call-' || (turn - 1) AS call_id, text AS content FROM t WHERE role = 'assistant'),
nodes AS (SELECT DISTINCT conv_id, turn FROM c),
e AS (SELECT DISTINCT c.conv_id, c.turn, c.needs FROM c JOIN nodes p ON p.conv_id = c.conv_id AND p.turn = c.needs),
s AS (SELECT n.conv_id, n.turn, 0 AS step FROM nodes n ANTI JOIN e ON e.conv_id = n.conv_id AND e.turn = n.turn
      UNION ALL SELECT e.conv_id, e.turn, s.step + 1 FROM s JOIN e ON e.conv_id = s.conv_id AND e.needs = s.turn),
a AS (SELECT conv_id, call_id, arg_min(content, {'turn': turn, 'content': content}) AS content, count(*) AS n_results FROM r GROUP BY ALL)
SELECT c.conv_id, c.turn, c.call_id, c.name, CASE WHEN a.n_results IS NULL THEN 'no_result' ELSE 'linked' END AS status,
       CAST(coalesce(a.n_results, 0) AS BIGINT) AS n_results, CAST(s.step AS INTEGER) AS step,
       concat_ws('; ', CASE WHEN c.n IS NULL THEN 'arguments: no JSON object' WHEN c.n % 2 = 1 OR c.n % 3 = 0 THEN NULL WHEN c.n % 3 = 1 THEN 'exact: no boolean' ELSE 'items: missing' END,
                 CASE WHEN c.needs IS NOT NULL AND e.needs IS NULL THEN 'needs: unknown call-' || c.needs END) AS errors,
       '{"arguments":' || CASE WHEN c.n IS NULL THEN 'null'
            WHEN c.n % 3 = 0 THEN '{"limit":' || c.n || ',"query":' || to_json(c.text) || '}'
            WHEN c.n % 3 = 1 THEN '{"exact":' || CASE WHEN c.n % 2 = 0 THEN '"yes"' WHEN c.turn % 4 = 0 THEN 'true' ELSE 'false' END || ',"key":' || to_json(c.text) || '}'
            WHEN c.n % 2 = 0 THEN '{"top":' || c.n || '}'
            ELSE '{"items":["user",' || to_json(c.text) || '],"top":' || c.n || '}' END
       || ',"depends_on":[' || coalesce('"call-' || c.needs || '"', '') || '],"id":"' || c.call_id || '","name":"' || c.name || '","result":'
       || CASE WHEN a.content IS NULL THEN 'null' ELSE to_json(a.content) END || ',"step":' || s.step || '}' AS message
FROM c LEFT JOIN a ON a.conv_id = c.conv_id AND a.call_id = c.call_id
LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn
LEFT JOIN e ON e.conv_id = c.conv_id AND e.turn = c.turn
UNION ALL
SELECT r.conv_id, r.turn, r.call_id, NULL, 'orphan_result', 1, NULL, 'result: no call',
       '{"id":"' || r.call_id || '","result":' || CASE WHEN r.content IS NULL THEN 'null' ELSE to_json(r.content) END || '}'
FROM r ANTI JOIN nodes n ON n.conv_id = r.conv_id AND 'call-' || n.turn = r.call_id
"""
