"""Queries of agent conversations and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_schema import json_problems
from ..operators import agent as A
from ..operators import ingest as I
from ..sources.adapters import DELTA_CHARS, USER_EVENTS_SQL, table, user_events
from .registry import query

WITH = f"WITH {USER_EVENTS_SQL}"
BLOCK = "CASE WHEN NOT known THEN id WHEN react THEN 'react:' || path ELSE 'llm:' || COALESCE(call_id, exec_id) END"


def messages_sql(keys: str) -> str:
    return f"""mk AS (SELECT *, {BLOCK} AS block_key, COALESCE(call_id, exec_id) AS message_key FROM ue WHERE type IN ('reasoning_delta', 'message_delta', 'message_completed') OR (type = 'tool_call_requested' AND thought IS NOT NULL)),
mw AS (SELECT {keys}, message_key, max(sequence) FILTER (type = 'message_completed' AND content IS NOT NULL) AS ws, max(sequence) FILTER (type = 'tool_call_requested') AS qs,
  min(sequence) FILTER (type = 'reasoning_delta') AS rs, min(sequence) FILTER (type = 'message_completed' AND thought IS NOT NULL) AS ts FROM mk GROUP BY ALL),
mb AS (SELECT *, CASE WHEN qs IS NOT NULL THEN qs WHEN ts IS NOT NULL AND (rs IS NULL OR ts < rs) THEN ts END AS bs FROM mw),
ms AS (SELECT {', '.join('mk.' + k.strip() for k in keys.split(','))}, mk.message_key, min(sequence) AS first_sequence, min(sequence) FILTER (type IN ('message_delta', 'message_completed')) AS message_sequence,
  COALESCE(string_agg(CASE WHEN type = 'message_completed' THEN content ELSE delta END, '' ORDER BY sequence) FILTER ((type = 'message_delta' AND (ws IS NULL OR sequence > ws)) OR sequence = ws), '') AS content,
  COALESCE(string_agg(CASE WHEN type = 'reasoning_delta' THEN delta ELSE thought END, '' ORDER BY sequence) FILTER ((type = 'reasoning_delta' AND (bs IS NULL OR sequence > bs)) OR sequence = bs), '') AS reasoning,
  least(any_value(rs), min(sequence) FILTER (type = 'tool_call_requested'), CASE WHEN any_value(qs) IS NULL THEN any_value(bs) END) AS reasoning_sequence0, bool_or(type = 'message_completed') AS completed, max(at_ms) FILTER (type IN ('message_delta', 'message_completed')) AS occurred_at_ms
  FROM mk JOIN mb ON {' AND '.join(f'mk.{k.strip()} = mb.{k.strip()}' for k in keys.split(','))} AND mk.message_key = mb.message_key GROUP BY ALL)"""


@query(f"{WITH}, {messages_sql('invocation_id')} SELECT invocation_id, message_key, first_sequence, message_sequence, CASE WHEN length(reasoning) > 0 THEN reasoning_sequence0 END AS reasoning_sequence, content, reasoning, completed, occurred_at_ms FROM ms")
def k1_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.messages(user_events(spark, sf_dir))


def tools_sql(keys: str) -> str:
    return f"""tq AS (SELECT {keys}, 't' || turn AS tool_key, 'tool' || conv_id%3 AS name, '{{"n":' || turn || '}}' AS raw_arguments, at_ms AS requested_at_ms, sequence - CASE WHEN m%2=0 AND call_id IS NOT NULL THEN 2 ELSE 0 END AS first_sequence, sequence, call_id FROM (SELECT *, {BLOCK} AS block_key FROM ue) WHERE type = 'tool_call_requested'),
tr AS (SELECT {keys}, 't' || (turn - turn%2) AS tool_key, arg_max(struct_pack(o := 'o' || turn, e := CASE WHEN m%5=0 THEN 'bad' END, a := at_ms), sequence) AS r, min(sequence) AS rs FROM (SELECT *, {BLOCK} AS block_key FROM ue) WHERE type = 'tool_result' GROUP BY ALL)"""


@query(f"""{WITH.replace("FROM conversations", "FROM conversations WHERE turn%7<>3")}, {tools_sql('invocation_id')} SELECT COALESCE(q.invocation_id, tr.invocation_id) AS invocation_id, COALESCE(q.tool_key, tr.tool_key) AS tool_key, name, COALESCE(raw_arguments, '') AS raw_arguments, requested_at_ms, r.o AS output, r.e AS error, r.a AS completed_at_ms, COALESCE(q.first_sequence, rs) AS first_sequence
FROM tq q FULL JOIN tr ON q.invocation_id = tr.invocation_id AND q.tool_key = tr.tool_key""")
def k2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with an id of their own: turns without one share the execution's, and so their streamed indexes."""
    return A.tool_calls(user_events_with_calls(spark, sf_dir))


def user_events_with_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = user_events(spark, sf_dir).filter("operator_call_id IS NOT NULL")
    return e.withColumn("sequence", F.row_number().over(W.partitionBy("invocation_id").orderBy("sequence")).cast("long"))


@query(f"""{WITH} SELECT invocation_id, CASE WHEN NOT known THEN 'custom' WHEN react THEN 'react' ELSE 'llm' END AS block_kind, {BLOCK} AS block_key, min(sequence) AS first_sequence, count(*) AS events,
CAST(arg_max(turn, sequence) FILTER (type = 'agent_output') AS VARCHAR) AS output, max(sequence) FILTER (type = 'agent_output') AS output_sequence FROM ue GROUP BY 1, 2, 3""")
def k3_activity_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.activity_blocks(user_events(spark, sf_dir))


@query(f"""{WITH.replace("FROM conversations", "FROM conversations WHERE turn%7<>3")}, {messages_sql('invocation_id, block_key')}, {tools_sql('invocation_id, block_key')},
told AS (SELECT DISTINCT invocation_id, {BLOCK} AS block_key FROM ue WHERE type = 'agent_output')
SELECT invocation_id, block_key, 'thinking' AS kind, 'thinking:' || message_key AS item_key, reasoning_sequence0 AS sequence FROM ms WHERE reasoning <> ''
UNION ALL SELECT invocation_id, block_key, 'message', 'message:' || message_key, message_sequence FROM ms WHERE content <> '' AND message_sequence IS NOT NULL AND (invocation_id, block_key) NOT IN (SELECT (invocation_id, block_key) FROM told)
UNION ALL SELECT COALESCE(q.invocation_id, tr.invocation_id), COALESCE(q.block_key, tr.block_key), 'tool', 'tool:' || COALESCE(q.tool_key, tr.tool_key), COALESCE(q.first_sequence, rs) FROM tq q FULL JOIN tr ON q.invocation_id = tr.invocation_id AND q.block_key = tr.block_key AND q.tool_key = tr.tool_key
UNION ALL SELECT invocation_id, {BLOCK}, 'generic', id, sequence FROM ue WHERE type IN ('message_aborted', 'agent_failed')""")
def k4_activity_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events_with_calls(spark, sf_dir)
    return A.activity_items(e.withColumn("id", F.concat_ws("-", F.lit("u"), "invocation_id", F.col("sequence").cast("string"))))


@query(f"{WITH} SELECT id, type FROM ue WHERE type NOT IN ('message_delta', 'reasoning_delta', 'tool_call_delta')")
def b6_durable_user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.durable_user_events(user_events(spark, sf_dir)).select("id", "type")


@query(f"{WITH} SELECT id, invocation_id, sequence FROM ue WHERE sequence % 3 = 0")
def a5_append_user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir)
    return I.append(e.filter("sequence % 3 <> 0"), e.filter("sequence % 3 = 0 OR sequence % 5 = 0"), I.USER_EVENT_FIELDS)[0].select("id", "invocation_id", "sequence")


@query(f"""{WITH}, r AS (SELECT invocation_id, conv_id%6 AS rt FROM ue GROUP BY ALL HAVING conv_id%3<>0), q AS (SELECT ue.*, CASE WHEN type LIKE '%\\_delta' ESCAPE '\\' THEN NULL WHEN type = 'tool_call_requested' THEN 'tool_call:t' || turn WHEN type = 'tool_result' THEN 'tool_result:t' || (turn - turn%2) WHEN type = 'message_completed' THEN 'message:' || COALESCE(call_id, exec_id) WHEN type = 'agent_output' THEN 'agent_output:' || invocation_id ELSE 'event:' || id END AS k FROM ue)
SELECT q.invocation_id, count(DISTINCT k) AS unread FROM q LEFT JOIN r ON r.invocation_id = q.invocation_id WHERE k IS NOT NULL AND sequence > COALESCE(rt, 0) GROUP BY 1""")
def d18_unread_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir)
    cursor = e.select("invocation_id").distinct().withColumn("read_through", F.col("invocation_id").cast("long") % 6).filter(F.col("invocation_id").cast("long") % 3 != 0)
    return A.unread_counts(e, cursor)


@query("SELECT CAST(conv_id%50 AS VARCHAR) AS session_id, CASE WHEN conv_id%4=0 THEN 'a/b' ELSE '<root>' END AS path_key, string_agg(role || ':' || text, '|' ORDER BY conv_id*1000 + turn) AS history FROM conversations GROUP BY 1, 2")
def d16_session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    path = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    h = A.session_history(c.select((F.col("conv_id") % 50).cast("string").alias("session_id"), path.alias("workflow_path"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "role", F.col("text").alias("content")))
    return h.withColumn("history", F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS f FROM conversations)
SELECT conv_id AS conversation_id, turn AS call_index, string_agg(CASE WHEN f THEN 'system:Be brief.|user:before|' ELSE '' END || role || ':' || text, '|') OVER w AS messages, CASE WHEN turn%5=2 OR conv_id%3=0 THEN 'none' ELSE 'auto' END AS tool_choice,
first_value('{"t":' || turn || '}') OVER w AS provider_options, first_value('m' || turn%2) OVER w AS mode FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def k5_prepare_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = table(spark, sf_dir, "conversations"), F.col("turn")
    one = lambda r, x: F.array(F.struct(r.alias("role"), x.alias("content")))
    turns = c.select(F.col("conv_id").alias("conversation_id"), t.alias("call_index"), F.when(t % 5 == 2, "output_repair").otherwise("next").alias("kind"), one(F.col("role"), F.col("text")).alias("messages"), one(F.lit("user"), F.lit("before")).alias("history"), (F.col("conv_id") % 3 != 0).alias("has_tools"), F.to_json(F.struct(t.alias("t"))).alias("provider_options"), F.concat(F.lit("m"), (t % 2).cast("string")).alias("mode"))
    out = A.prepare_requests(turns, "Be brief.")
    return out.withColumn("messages", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "|"))


@query("""SELECT event_id, CASE k%5 WHEN 0 THEN '[{"role":"user","content":"x' || k || '"}]' WHEN 1 THEN '[{"role":"user","content":"i' || k || '"}]' WHEN 2 THEN '[{"role":"a"}]' WHEN 3 THEN '[{"role":"user"}]' END AS messages, CASE WHEN k%5=4 THEN 'input_or_messages_required' END AS error FROM (SELECT event_id, CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS k FROM events)""")
def k6_normalize_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))
    k, s = F.col("k") % 5, F.col("k").cast("string")
    v = F.when(k == 0, F.concat(F.lit('"x'), s, F.lit('"'))).when(k == 1, F.concat(F.lit('{"input":"i'), s, F.lit('"}'))).when(k == 2, F.lit('{"messages":[{"role":"a"}]}')).when(k == 3, F.lit('[{"role":"user"}]')).otherwise(F.lit('{"other":1}'))
    return e.select("event_id", A.normalize_initial(v).alias("v")).select("event_id", "v.messages", "v.error")


@query("""SELECT conv_id, turn, concat_ws(';', CASE WHEN turn%9=4 THEN 'unknown_role' END, CASE WHEN turn%3=1 AND (turn%9=4 OR role <> 'assistant') THEN 'reasoning_on_other_role' END, CASE WHEN turn%4=1 THEN 'reserved_options:model,stream' END) AS problems FROM conversations""")
def k7_validate_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = table(spark, sf_dir, "conversations"), F.col("turn")
    options = F.when(t % 4 == 1, F.create_map(F.lit("stream"), F.lit("1"), F.lit("model"), F.lit("m"))).when(t % 4 == 2, F.create_map(F.lit("seed"), F.lit("1")))
    rows = c.select("conv_id", "turn", F.when(t % 9 == 4, "robot").otherwise(F.col("role")).alias("role"), F.when(t % 3 == 1, F.lit("r")).alias("reasoning_content"), options.alias("provider_options"))
    return A.validate_messages(rows).select("conv_id", "turn", F.array_join("problems", ";").alias("problems"))


CALLS_SQL = """tc AS (SELECT l_orderkey AS o, l_linenumber%3 AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS i, l_partkey AS p FROM lineitem),
ck AS (SELECT *, CASE WHEN p%11=0 THEN ' ' ELSE 'c' || i END AS id, CASE WHEN p%13=0 THEN '' ELSE 'tool' || p%6 END AS name, CASE p%4 WHEN 0 THEN '{"a":"1"}' WHEN 1 THEN '{"b":"2","a":"1"}' WHEN 2 THEN '{"b":"2"}' ELSE 'junk' END AS args FROM tc),
ce AS (SELECT *, CASE WHEN trim(id) = '' THEN 'empty_id' WHEN name = '' THEN 'empty_name' WHEN name IN ('tool4', 'tool5') THEN 'unknown_tool' WHEN p%4=3 OR (name IN ('tool0', 'tool1') AND p%4=2) THEN 'invalid_arguments' END AS error FROM ck)"""


def calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window as W

    li, p = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    i = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")).cast("long")
    args = F.when(p % 4 == 0, '{"a":"1"}').when(p % 4 == 1, '{"b":"2","a":"1"}').when(p % 4 == 2, '{"b":"2"}').otherwise("junk")
    c = li.select(F.col("l_orderkey").alias("conversation_id"), (F.col("l_linenumber") % 3).cast("long").alias("response_index"), i.alias("call_index"), p.alias("p")).select("*", F.when(F.col("p") % 11 == 0, " ").otherwise(F.concat(F.lit("c"), F.col("call_index").cast("string"))).alias("id"), F.when(F.col("p") % 13 == 0, "").otherwise(F.concat(F.lit("tool"), (F.col("p") % 6).cast("string"))).alias("name"))
    q = F.col("p")
    c = c.withColumn("raw_arguments", F.when(q % 4 == 0, '{"a":"1"}').when(q % 4 == 1, '{"b":"2","a":"1"}').when(q % 4 == 2, '{"b":"2"}').otherwise("junk"))
    tools = c.filter("p % 13 <> 0 AND p % 6 < 4").select("name").distinct().withColumn("required", F.when(F.col("name").isin("tool0", "tool1"), F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")))
    return c, tools


@query(f"""WITH {CALLS_SQL}, rf AS (SELECT o, r, bool_or(error IS NOT NULL) AS f FROM ce GROUP BY 1, 2), pf AS (SELECT *, CAST(COALESCE(sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY o ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n FROM rf)
SELECT ce.o AS conversation_id, CAST(ce.r AS BIGINT) AS response_index, CAST(i AS BIGINT) AS call_index, CASE WHEN trim(id) = '' THEN 'invalid_tool_call_' || i ELSE id END AS id, CASE WHEN name = '' THEN '__invalid_tool__' ELSE name END AS name, error, n AS previous_failures, f AND n >= 1 AS exhausted FROM ce JOIN pf ON ce.o = pf.o AND ce.r = pf.r""")
def k8_validate_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.validate_tool_calls(*calls(spark, sf_dir), max_repairs=1)


#: Arguments of a tool: a count, a unit, and nested filters.
ARGUMENTS = {
    "type": "object", "required": ["n"], "additionalProperties": False,
    "properties": {"n": {"type": "integer"}, "unit": {"enum": ["day", "week"]}, "where": {"type": "object", "required": ["field"], "properties": {"field": {"type": "string"}, "in": {"type": "array", "items": {"type": ["integer", "null"]}}}}},
}


def schema_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each line item, with arguments that break the schema in one of seven ways, or in none."""
    k = F.col("l_partkey") % 8
    n = F.col("l_partkey").cast("string")
    made = F.when(k == 0, F.concat(F.lit('{"n":'), n, F.lit(',"unit":"day","where":{"field":"x","in":[1,null]}}'))).when(k == 1, F.concat(F.lit('{"n":"'), n, F.lit('"}'))).when(k == 2, '{"unit":"week"}').when(k == 3, '{"n":1,"unit":"year"}')
    made = made.when(k == 4, '{"n":1,"more":2,"most":3}').when(k == 5, '{"n":1,"where":{"in":[1,"2"]}}').when(k == 6, '{"n":1.5,"where":[]}').otherwise("[1")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", made.alias("raw_arguments"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey%8 WHEN 0 THEN '' WHEN 1 THEN 'type:/n' WHEN 2 THEN 'missing:/n' WHEN 3 THEN 'enum:/unit' WHEN 4 THEN 'extra:/more;extra:/most' WHEN 5 THEN 'missing:/where/field;type:/where/in/*' WHEN 6 THEN 'type:/n;type:/where' ELSE 'no_json' END AS problems FROM lineitem""")
def k8_argument_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_arguments(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(json_problems("raw_arguments", ARGUMENTS), ";").alias("problems"))


@query("""WITH c AS (SELECT l_orderkey AS o, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS BIGINT) AS i, l_partkey AS p FROM lineitem)
SELECT o AS conversation_id, i AS call_index, CASE WHEN p%8 <> 0 THEN 'invalid_arguments' END AS error FROM c""")
def k8_validate_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    i = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")).cast("long")
    rows = table(spark, sf_dir, "lineitem").withColumn("i", i).withColumn("call_key", F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "i")]))
    made = schema_arguments(spark, sf_dir).select("l_partkey", "raw_arguments").dropDuplicates(["l_partkey"])
    c = rows.join(made, "l_partkey").select(F.col("l_orderkey").alias("conversation_id"), F.lit(0).cast("long").alias("response_index"), F.col("i").alias("call_index"), F.col("call_key").alias("id"), F.lit("search").alias("name"), "raw_arguments")
    tools = c.select("name").distinct().withColumn("required", F.array(F.lit("n")))
    return A.validate_tool_calls(c, tools, 1, {"search": ARGUMENTS}).select("conversation_id", "call_index", "error")


@query(f"""WITH {CALLS_SQL}, m AS (SELECT o, -1 AS i, 'assistant' AS role, NULL AS id, 'r' || o AS content FROM ce GROUP BY o UNION ALL SELECT o, i, 'tool', id, CASE WHEN error IS NOT NULL THEN '{{"error":{{"type":"tool_arguments_validation_error","tool":"' || name || '","message":"' || error || '","raw_arguments":"' || replace(args, '"', '\\"') || '"}}}}' WHEN p%5=0 THEN '{{"error":{{"type":"tool_execution_error","tool":"' || name || '","exception_type":"E","message":"m' || p || '"}}}}' ELSE 'out' || p END FROM ce)
SELECT o AS response_id, string_agg(role || '/' || COALESCE(id, '') || '/' || content, '|' ORDER BY i) AS messages FROM m GROUP BY 1""")
def k9_tool_result_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, tools = calls(spark, sf_dir)
    v = A.validate_tool_calls(c, tools, 1).select("conversation_id", "call_index", "error")
    own = c.join(v, ["conversation_id", "call_index"]).withColumnRenamed("conversation_id", "response_id")
    ran = own.filter("error IS NULL").select("response_id", "call_index", F.concat(F.lit("out"), F.col("p").cast("string")).alias("output"), F.when(F.col("p") % 5 == 0, "E").alias("error_type"), F.concat(F.lit("m"), F.col("p").cast("string")).alias("error_message"))
    responses = c.select(F.col("conversation_id").alias("response_id")).distinct().withColumn("content", F.concat(F.lit("r"), F.col("response_id").cast("string")))
    out = A.tool_result_messages(responses, own.select("response_id", "call_index", "id", "name", "raw_arguments", "error"), ran)
    return out.withColumn("messages", F.array_join(F.transform("messages", lambda x: F.concat_ws("/", x["role"], F.coalesce(x["tool_call_id"], F.lit("")), x["content"])), "|"))


@query("""WITH r AS (SELECT conv_id, turn, CASE turn%4 WHEN 0 THEN '{"a":' || turn || ',"b":"x"}' WHEN 1 THEN '{"a":' || turn || '}' WHEN 2 THEN 'no json' END AS content, turn%4=0 AS ok FROM conversations), p AS (SELECT *, COALESCE(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM r)
SELECT conv_id AS conversation_id, turn AS response_index, content, CASE WHEN ok THEN 'valid' WHEN n >= 2 THEN 'exhausted' ELSE 'repair' END AS status, CASE WHEN ok THEN content END AS value FROM p""")
def k10_validate_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = table(spark, sf_dir, "conversations"), F.col("turn")
    s = t.cast("string")
    content = F.when(t % 4 == 0, F.concat(F.lit('{"a":'), s, F.lit(',"b":"x"}'))).when(t % 4 == 1, F.concat(F.lit('{"a":'), s, F.lit("}"))).when(t % 4 == 2, "no json")
    return A.validate_outputs(c.select(F.col("conv_id").alias("conversation_id"), t.alias("response_index"), content.alias("content")), "a bigint, b string", 2)


@query("SELECT p_partkey AS id, CASE WHEN p_size%4<>0 THEN CAST(p_size AS BIGINT) END AS input_tokens, CASE WHEN p_size%3<>0 THEN CAST(p_size * 2 AS BIGINT) END AS output_tokens, CAST(NULL AS BIGINT) AS total_tokens FROM part")
def k11_decode_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = table(spark, sf_dir, "part"), F.col("p_size")
    raw = F.concat(F.lit('{"usage":{"prompt_tokens":'), F.when(s % 4 != 0, s.cast("string")).otherwise("true"), F.when(s % 3 != 0, F.concat(F.lit(',"completion_tokens":'), (s * 2).cast("string"))).otherwise(""), F.lit("}}"))
    return p.select(F.col("p_partkey").alias("id"), A.decode_usage(raw).alias("u")).select("id", "u.*")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = user_events(spark, sf_dir).filter(F.col("type").isin("message_delta", "message_completed", "reasoning_delta") & F.col("operator_call_id").isNotNull())
    null = F.lit(None)
    return e.select(F.col("operator_call_id").alias("call_id"), F.col("sequence").alias("seq"), F.lit(0).cast("long").alias("at_ms"), F.when(F.col("type") == "message_completed", "completed").otherwise(F.col("type")).alias("type"), F.coalesce(A.field("delta"), A.field("message.content")).alias("text"), null.cast("int").alias("tool_index"), null.cast("string").alias("tool_id"), null.cast("string").alias("tool_name"))


@query(f"""{WITH}, c AS (SELECT call_id, sequence, type, COALESCE(delta, content) AS text, CASE WHEN type = 'message_delta' THEN (row_number() OVER (PARTITION BY call_id, type ORDER BY sequence) - 1)//3 END AS g FROM ue WHERE call_id IS NOT NULL AND type IN ('message_delta', 'message_completed', 'reasoning_delta')),
d AS (SELECT call_id, min(sequence) AS first_seq, CASE WHEN type = 'message_completed' THEN 'completed' ELSE type END AS type, string_agg(text, '' ORDER BY sequence) AS text FROM c GROUP BY call_id, type, g)
SELECT call_id, CAST(row_number() OVER (PARTITION BY call_id ORDER BY first_seq) - 1 AS BIGINT) AS position, type, text, first_seq FROM d""")
def e11_coalesce_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deltas of 40 characters merge by threes into 120."""
    return A.coalesce_deltas(chunks(spark, sf_dir), chars=2 * DELTA_CHARS + 1)


@query(f"{WITH}, c AS (SELECT call_id, count(*) FILTER (type = 'message_completed') AS n, max(content) AS o FROM ue WHERE call_id IS NOT NULL AND type IN ('message_delta', 'message_completed', 'reasoning_delta') GROUP BY 1) SELECT call_id, CASE WHEN n = 1 THEN o END AS output, CASE WHEN n = 0 THEN 'no_completed_chunk' END AS error FROM c")
def l11_stream_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stream_reduce(chunks(spark, sf_dir))
