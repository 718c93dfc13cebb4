"""Tool calls of conversations, linked and serialised with DataFrame functions only.

A call is an entry of ``tool_calls`` in a message that is a JSON object: ``id``, ``name``, ``arguments`` and
optionally ``after``, ids of calls that must come before. A result is a message that is a JSON object with
``tool_call_id``. Calls and results meet in a hash join on (conversation, id); levels of the dependency
graph come from joins that double its chains; arguments are checked against schemas; JSON is written canonically,
with sorted keys and no white space. No conversation is gathered: rows carry their place instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.graph import longest_levels

from .common import cut

#: Schemas are broadcast up to this number of tools.
BROADCAST_TOOLS = 50_000


def _get(v: str, path: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({v}, '{path}', '{kind}')")


def _levels(calls: DataFrame) -> DataFrame:
    """``(conv, call_id, level)``: 0 without earlier calls, else one more than the highest; null for calls in or behind a cycle.

    Chains are walked by doubling, so a conversation that is one long chain takes logarithmic rounds.
    """
    node = lambda call_id: F.struct("conv", F.col(call_id).alias("call_id"))
    edges = calls.select(node("call_id").alias("node"), "conv", F.explode("after").alias("dep")).where("dep is not null").select("node", node("dep").alias("dep"))
    return longest_levels(calls.select(node("call_id").alias("node")), edges).select("node.*", F.col("level").cast("int").alias("level"))


#: JSON schema type -> types of a variant value.
TYPES = {"string": "^STRING$", "integer": "^(BIGINT|DECIMAL.*,0.)$", "number": "^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID$"}


def _problems(calls: DataFrame, tools: DataFrame | None) -> DataFrame:
    """``calls`` with ``problems``: null where no schema is known, else sorted texts (none: valid)."""
    if tools is None:
        return calls.withColumn("problems", F.lit(None).cast("array<string>"))
    schema = tools.groupBy("name").agg(F.max(F.struct("required", F.map_entries("properties").alias("properties"), "closed")).alias("s")).select("name", F.col("s.required").alias("required"), F.map_from_entries("s.properties").alias("properties"), F.col("s.closed").alias("closed"))
    side = F.broadcast(schema) if schema.count() <= BROADCAST_TOOLS else schema
    rows = calls.join(side, "name", "left").withColumn("given", F.expr("try_cast(arguments as map<string, variant>)"))
    rows = rows.withColumn("keys", F.coalesce(F.map_keys("given"), F.array().cast("array<string>")))
    known = F.coalesce(F.map_keys("properties"), F.array().cast("array<string>"))
    missing = F.transform(F.array_except(F.coalesce("required", F.array().cast("array<string>")), "keys"), lambda k: F.concat(F.lit("missing "), k))
    extra = F.when(F.col("closed"), F.transform(F.array_except("keys", known), lambda k: F.concat(F.lit("unknown "), k))).otherwise(F.array().cast("array<string>"))
    tests = " or ".join(f"(properties[k] = '{kind}' and schema_of_variant(given[k]) rlike '{pattern}')" for kind, pattern in TYPES.items())
    names = ", ".join(f"'{k}'" for k in TYPES)
    wrong = F.expr(f"transform(filter(keys, k -> map_contains_key(properties, k) and properties[k] in ({names}) and not ({tests})), k -> concat('type ', k))")
    shape = F.when(F.col("given").isNull(), F.array(F.lit("not an object"))).otherwise(F.array_sort(F.concat(missing, extra, F.coalesce(wrong, F.array().cast("array<string>")))))
    return rows.withColumn("problems", F.when(F.col("properties").isNotNull(), shape)).drop("required", "properties", "closed", "given", "keys")


def link_calls(turns: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """A row for each message, call and result of ``turns(conv_id, turn, role, text)``.

    Columns: ``conv_id``, ``turn``, ``item`` (0 for the message, 1.. for its calls), ``kind`` (message, call,
    result), ``call_id``, ``name``, ``status``, ``level``, ``valid``, ``problems`` (comma-joined), ``json``.

    * status of a call: answered, unanswered, cyclic, or duplicate (its id was used earlier in the conversation,
      or it has none); of a result: linked or orphan; of a message: null.
    * level orders calls and results: twice the number of calls that must precede, plus one for a result.
      Unknown ids in ``after`` are ignored; calls in or behind a cycle have none.
    * valid: whether ``arguments`` fit the tool's schema in ``tools(name, required, properties, closed)``
      (``properties`` maps names to JSON types); null without a schema. A tool listed twice uses its largest row.
    * Texts that aren't JSON objects, null and empty texts are plain messages. Null conversations and turns
      keep their rows; calls and results with a null conversation never link. Repeated rows are repeated;
      a repeated call's copies are duplicates. An empty table gives an empty result.
    """
    base = turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    parsed = base.withColumn("v", F.when(F.col("text").rlike(r"^\s*\{"), F.expr("try_parse_json(text)")))
    result_id = _get("v", "$.tool_call_id", "string")
    plain = parsed.select(
        "conv", "turn", F.lit(0).alias("item"), F.when(result_id.isNotNull(), "result").otherwise("message").alias("kind"), result_id.alias("call_id"),
        F.to_json(F.struct(F.coalesce(F.expr("to_json(v)"), F.col("text")).alias("content"), "role"), {"ignoreNullFields": "false"}).alias("json"),
    )
    each = parsed.where("v is not null").select("conv", "turn", F.posexplode(_get("v", "$.tool_calls", "array<variant>")).alias("p", "c"))
    calls = each.select("conv", "turn", (F.col("p") + 1).alias("item"), _get("c", "$.id", "string").alias("call_id"), _get("c", "$.name", "string").alias("name"), _get("c", "$.arguments", "variant").alias("arguments"), F.coalesce(_get("c", "$.after", "array<string>"), F.array().cast("array<string>")).alias("after"), F.monotonically_increasing_id().alias("b"))
    calls = cut(calls.withColumn("args", F.expr("to_json(arguments)")).drop("arguments")).withColumn("arguments", F.expr("parse_json(args)"))
    heads = calls.where("conv is not null and call_id is not null").groupBy("conv", "call_id").agg(F.min_by(F.struct("turn", "item", "name", "after", "b"), F.struct("turn", "item", "b")).alias("h")).select("conv", "call_id", "h.*")
    results = plain.where("kind = 'result'")
    answered = results.select("conv", "call_id").distinct().withColumn("answered", F.lit(True))
    levels = _levels(heads.select("conv", "call_id", "after"))
    state = cut(heads.select("conv", "call_id", "name", F.col("b").alias("first")).join(levels, ["conv", "call_id"], "left").join(answered, ["conv", "call_id"], "left"))
    checked = _problems(calls, tools).join(state.select("conv", "call_id", "first", "level", "answered"), ["conv", "call_id"], "left")
    status = F.when(F.col("first").isNull() | (F.col("first") != F.col("b")), "duplicate").when(F.col("level").isNull(), "cyclic").when(F.col("answered"), "answered").otherwise("unanswered")
    call_json = F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "name"), {"ignoreNullFields": "false"})
    call_rows = checked.select("conv", "turn", "item", F.lit("call").alias("kind"), "call_id", "name", status.alias("status"), F.when(status != "duplicate", 2 * F.col("level")).alias("level"), (F.size("problems") == 0).alias("valid0"), "problems", call_json.alias("json"))
    linked = results.join(state.select("conv", "call_id", "name", "level", F.lit(True).alias("found")), ["conv", "call_id"], "left")
    nothing = F.lit(None).cast("array<string>")
    result_rows = linked.select("conv", "turn", "item", "kind", "call_id", "name", F.when(F.col("found"), "linked").otherwise("orphan").alias("status"), (2 * F.col("level") + 1).alias("level"), F.lit(None).cast("boolean").alias("valid0"), nothing.alias("problems"), "json")
    message_rows = plain.where("kind = 'message'").select("conv", "turn", "item", "kind", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("valid0"), nothing.alias("problems"), "json")
    out = message_rows.unionByName(result_rows).unionByName(call_rows)
    return out.select(F.col("conv").alias("conv_id"), "turn", "item", "kind", "call_id", "name", "status", "level", F.when(F.col("problems").isNotNull(), F.col("valid0")).alias("valid"), F.array_join("problems", ",").alias("problems"), "json")


def derived_calls(turns: DataFrame) -> DataFrame:
    """Plain ``conversations`` as conversations with tools, whole texts kept: the input of the registered query.

    An assistant's turn calls a tool (``lookup``, ``store`` or one without a schema) with its text as an argument, after the
    call two turns before; a user's turn answers the call of the turn before. In some conversations all calls share one
    id (duplicates) or also wait for the call two turns later (cycles); some arguments don't fit their schema.
    """
    t = F.col("turn")
    shared, mutual = F.col("conv_id") % 7 == 3, F.col("conv_id") % 11 == 5
    name = F.when((F.col("conv_id") + t) % 3 == 0, "lookup").when((F.col("conv_id") + t) % 3 == 1, "store").otherwise("other")
    call_id = lambda at: F.when(shared, "c1").otherwise(F.concat(F.lit("c"), at.cast("string")))
    size, quoted = F.length("text"), F.to_json(F.array("text"))
    text = F.expr("substring(q, 2, length(q) - 2)")
    number = F.when(t % 4 == 3, F.concat(F.lit('"'), size.cast("string"), F.lit('"'))).otherwise(size.cast("string"))
    lookup = F.concat(F.lit('{"n":'), number, F.lit(',"q":'), text, F.lit("}"))
    store = F.when(t % 4 == 2, F.concat(F.lit('{"size":'), size.cast("string"), F.lit(',"value":'), text, F.lit("}"))).otherwise(F.concat(F.lit('{"key":"k'), t.cast("string"), F.lit('","value":'), text, F.lit("}")))
    arguments = F.when(name == "lookup", lookup).when(name == "store", store).otherwise(F.concat(F.lit('{"text":'), text, F.lit("}")))
    after = F.concat(F.lit('["c'), (t - 2).cast("string"), F.when(mutual, F.concat(F.lit('","c'), (t + 2).cast("string"))).otherwise(F.lit("")), F.lit('"]'))
    call = F.concat(F.lit('{"content":'), text, F.lit(',"tool_calls":[{"after":'), after, F.lit(',"arguments":'), arguments, F.lit(',"id":"'), call_id(t), F.lit('","name":"'), name, F.lit('"}]}'))
    result = F.concat(F.lit('{"content":'), text, F.lit(',"tool_call_id":"'), call_id(t - 1), F.lit('"}'))
    rows = turns.select("conv_id", "turn", "role", "text", quoted.alias("q"))
    return rows.select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", call).when((F.col("role") == "user") & (t > 0), result).otherwise(F.col("text")).alias("text"))


def derived_tools(spark: SparkSession) -> DataFrame:
    """The schemas of the tools that ``derived_calls`` calls."""
    return spark.sql("""select * from values ('lookup', array('q'), map('q', 'string', 'n', 'integer'), true), ('store', array('key', 'value'), map('key', 'string', 'value', 'string'), true)
as t(name, required, properties, closed)""")


ORACLE = """
with recursive m as (select conv_id c, turn t, role r, text x, conv_id % 7 = 3 shared, conv_id % 11 = 5 mutual, cast(to_json(text) as varchar) q, (conv_id + turn) % 3 tool from conversations),
a as (select c, t, r, case when shared then 'c1' else 'c' || t end id, case tool when 0 then 'lookup' when 1 then 'store' else 'other' end as name,
  case tool when 0 then '{"n":' || case when t % 4 = 3 then '"' || length(x) || '"' else cast(length(x) as varchar) end || ',"q":' || q || '}'
    when 1 then case when t % 4 = 2 then '{"size":' || length(x) || ',"value":' || q || '}' else '{"key":"k' || t || '","value":' || q || '}' end else '{"text":' || q || '}' end args,
  case when tool = 0 and t % 4 = 3 then 'type n' when tool = 1 and t % 4 = 2 then 'missing key,unknown size' when tool < 2 then '' end problems,
  '["c' || (t - 2) || case when mutual then '","c' || (t + 2) else '' end || '"]' after, mutual, q from m where r = 'assistant'),
h as (select c, id, min(t) t, arg_min(name, t) as name, bool_or(mutual) mutual from a group by c, id),
e as (select h.c, h.id, d.id dep from h join h d on d.c = h.c and (d.id = 'c' || (h.t - 2) or h.mutual and d.id = 'c' || (h.t + 2))),
lv(c, id, k) as (select c, id, 0 from h where not exists (select 1 from e where e.c = h.c and e.id = h.id) union all select e.c, e.id, k + 1 from lv join e on e.c = lv.c and e.dep = lv.id),
level as (select c, id, max(k) k from lv group by c, id),
res as (select c, t, r, case when shared then 'c1' else 'c' || (t - 1) end id, '{"content":' || q || ',"tool_call_id":"' || case when shared then 'c1' else 'c' || (t - 1) end || '"}' body from m where r = 'user' and t > 0),
s as (select h.*, k, exists (select 1 from res where res.c = h.c and res.id = h.id) answered from h left join level using (c, id))
select c conv_id, t turn, 0 as item, 'message' as kind, cast(null as varchar) call_id, cast(null as varchar) as name, cast(null as varchar) status, cast(null as integer) as level, cast(null as boolean) valid, cast(null as varchar) problems,
  cast(to_json({'content': x, 'role': r}) as varchar) as json from m where not (r = 'assistant' or r = 'user' and t > 0)
union all select c, t, 0, 'message', null, null, null, null, null, null, cast(to_json({'content': '{"content":' || q || ',"tool_calls":[{"after":' || after || ',"arguments":' || args || ',"id":"' || id || '","name":"' || name || '"}]}', 'role': r}) as varchar) from a
union all select a.c, a.t, 1, 'call', a.id, a.name, case when s.t <> a.t then 'duplicate' when s.k is null then 'cyclic' when s.answered then 'answered' else 'unanswered' end, case when s.t = a.t then 2 * s.k end,
  a.problems = '', a.problems, '{"arguments":' || a.args || ',"id":"' || a.id || '","name":"' || a.name || '"}' from a join s on s.c = a.c and s.id = a.id
union all select res.c, res.t, 0, 'result', res.id, s.name, case when s.id is null then 'orphan' else 'linked' end, 2 * s.k + 1, null, null, cast(to_json({'content': res.body, 'role': res.r}) as varchar) from res left join s on s.c = res.c and s.id = res.id
"""
