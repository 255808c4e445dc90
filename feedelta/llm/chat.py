"""Chat formatting: tool calls are linked with their results, ordered, checked and written as canonical JSON
(DataFrame operations only).

Messages are rows (conv_id, turn, role, text). A text that is a JSON object may hold tool calls,
{"content": ..., "tool_calls": [{"id": ..., "name": ..., "arguments": {...}, "after": [id, ...]}]}, and a message of role
`tool` holds a result, {"tool_call_id": ..., "content": ...}. Calls and results meet by a hash join on conversation and
identifier; arguments are checked against the tool's schema; and each message is written as one line of canonical JSON
(fixed key order, arguments with sorted keys, no spaces).

Order is topological: a result comes after its call, and a message comes after the results of all calls that its own calls
name in `after`, even where the turns say otherwise. Each message gets a place (turn, level), the greatest of its own turn
at level 0 and, for each message it waits for, that one's turn and the next level; chains of waiting messages take a round
each. Only calls of an earlier turn can be waited for, so nothing waits for itself.

The result has a row for each message, not for each conversation, and positions are offsets of ranges of turns, of equal
places within them, and ranks within those, so that neither an endless conversation nor an endless turn is gathered in one
task.

Schemas: rows (name, field, kind, required), kind one of string, number, integer, boolean, object, array. Where none are
given, each conversation has the tools that its own messages of role `system` declare as JSON objects,
{"tools": [{"name": ..., "parameters": {"properties": {field: {"type": kind}}, "required": [...]}}]}, each tool alone or as
the "function" of an object; of declarations of the same name the first counts, and a field without a type takes any kind,
one with a list of types any of them. A call is valid if its tool is known, its arguments are an object, all required
fields are there and all given fields are known and of their kind. In a conversation that declares no tools, and with none
given, a call has `valid` null, as has the count n_valid of its message: arguments were not checked.

Defined results: a text that is no JSON object is plain content; null text is null content; a call without an identifier
or a name is invalid and cannot be linked; of calls with the same identifier in a conversation the first (by turn, then
place in the message) is linked; several results of one call are all linked; a result without a call is an `orphan`, a
call without a result `unanswered`; a message that is a result holds no calls; names in `after` of unknown or later calls
count for nothing; rows with a null conv_id form a conversation of their own, in which nothing is linked; rows with equal
places follow each other by turn, then by the MD5 of role and text; extra columns are ignored; an empty table gives an
empty table. null turns come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedelta.llm.common import cut

#: Turns of a conversation that are ranked together.
RANGE = 1024
#: Calls are read as text first, so that arguments keep their own form.
CALLS = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
SHAPE = "name:string,parameters:struct<properties:map<string,struct<type:string>>,required:array<string>>"
TOOLS = f"array<struct<{SHAPE},function:struct<{SHAPE}>>>"
SCHEMA = "name string, field string, kind string, required boolean"


def tool_schemas(spark: SparkSession, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """{tool: {field: (kind, required)}} as rows; a tool without fields has one row with a null field."""
    rows = [(n, f, k, r) for n, fs in tools.items() for f, (k, r) in (fs or {None: (None, False)}).items()]
    return spark.createDataFrame(rows, SCHEMA)


def _quoted(c: Column) -> Column:
    """A JSON string, or null."""
    inner = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(inner, F.lit(2), F.length(inner) - 2))


def canonical_object(obj: Column) -> Column:
    """An object with sorted keys and no spaces; null if the text is no object."""
    kind = F.schema_of_variant(F.try_parse_json(obj))
    # A variant keeps its object keys sorted, at every level.
    return F.when(kind.startswith("OBJECT"), F.to_json(F.try_parse_json(obj)))


def _kind(value: Column) -> Column:
    """JSON kind of a variant value."""
    s = F.schema_of_variant(value)
    return (
        F.when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .otherwise("null")
    )


def parsed(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, row, calls (array), call_id (of a result), content."""
    cols = {c: F.col(c).cast(t) for c, t in (("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string"))}
    rows = df.select(*(v.alias(c) for c, v in cols.items()))
    obj = F.try_parse_json("text")
    is_obj = F.coalesce(F.schema_of_variant(obj).startswith("OBJECT"), F.lit(False))
    rows = rows.withColumn("v", F.when(is_obj, obj))
    calls = F.from_json(F.try_variant_get("v", "$.tool_calls", "string"), CALLS)
    link = F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))
    calls = F.when(link.isNull(), calls)
    special = F.col("v").isNotNull() & ((F.coalesce(F.size(calls), F.lit(-1)) > 0) | link.isNotNull())
    content = F.when(special, F.try_variant_get("v", "$.content", "string")).otherwise(F.col("text"))
    tools = F.when(F.col("role") == "system", F.from_json(F.try_variant_get("v", "$.tools", "string"), TOOLS))
    return rows.select("conv_id", "turn", "role", "text", F.xxhash64("conv_id", "turn", "role", "text").alias("row"), tools.alias("tools"), F.when(special, calls).alias("calls"), link.alias("call_id"), content.alias("content"))


def declared_tools(messages: DataFrame) -> DataFrame:
    """conv_id, name, kinds, needed: the tools that conversations declare, each by its first declaration."""
    rows = messages.where(F.col("conv_id").isNotNull()).select("conv_id", F.col("turn").isNull().alias("z"), "turn", "row", F.posexplode("tools").alias("at", "t"))
    shape = F.coalesce("t.function.parameters", "t.parameters")
    kinds = F.transform_values(shape["properties"], lambda _, x: F.coalesce(x["type"], F.lit("any")))
    rows = rows.select("conv_id", F.coalesce("t.function.name", "t.name").alias("name"), F.struct("z", "turn", "row", "at").alias("place"), F.coalesce(kinds, F.create_map().cast("map<string,string>")).alias("kinds"), F.coalesce(shape["required"], F.array().cast("array<string>")).alias("needed"))
    first = rows.where(F.col("name").isNotNull()).groupBy("conv_id", "name").agg(F.min_by(F.struct("kinds", "needed"), "place").alias("c"))
    return first.select("conv_id", "name", "c.kinds", "c.needed")


def checked_calls(messages: DataFrame, schemas: DataFrame | None) -> DataFrame:
    """A row for each call: conv_id, turn, row, at, id, name, after, arguments (canonical), valid."""
    calls = messages.select("conv_id", "turn", "row", F.posexplode("calls").alias("at", "c")).select("conv_id", "turn", "row", "at", "c.id", "c.name", "c.after", canonical_object(F.col("c.arguments")).alias("arguments"))
    # The registry of tools has a row for each tool: required fields and kinds as maps.
    if schemas is None:
        tools = declared_tools(messages)
        calls = calls.join(tools, ["conv_id", "name"], "left").join(tools.select("conv_id").distinct().withColumn("listed", F.lit(True)), "conv_id", "left")
    else:
        tools = schemas.groupBy("name").agg(
            F.map_from_entries(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "kind")))).alias("kinds"),
            F.array_compact(F.collect_list(F.when(F.col("required"), F.col("field")))).alias("needed"),
        )
        calls = calls.join(tools, "name", "left").withColumn("listed", F.lit(True))
    given = F.map_entries(F.from_json("arguments", "map<string,variant>"))

    def fits(e: Column) -> Column:
        want, got = F.try_element_at(F.col("kinds"), e["key"]), _kind(e["value"])
        kinds = F.when(want.startswith("["), F.from_json(want, "array<string>")).otherwise(F.array(want))
        return F.coalesce(F.exists(kinds, lambda k: (k == got) | ((k == "number") & (got == "integer")) | (k == "any")), F.lit(False))

    whole = F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("arguments").isNotNull()
    ok = whole & F.col("kinds").isNotNull()
    full = F.size(F.array_except("needed", F.map_keys(F.from_json("arguments", "map<string,variant>")))) == 0
    checked = F.coalesce(ok & full & F.forall(given, fits), F.lit(False))
    return calls.withColumn("valid", F.when(F.col("listed").isNotNull() | ~whole, checked)).drop("kinds", "needed", "listed")


def first_calls(calls: DataFrame) -> DataFrame:
    """conv_id, id, c (z, turn, at, row): the first call with each identifier."""
    named = calls.where(F.col("id").isNotNull() & F.col("conv_id").isNotNull())
    return named.groupBy("conv_id", "id").agg(F.min(F.struct(F.col("turn").isNull().alias("z"), "turn", "at", "row")).alias("c"))


def places(messages: DataFrame, calls: DataFrame, first: DataFrame) -> DataFrame:
    """conv_id, row, place (z, turn, level) of the messages that wait for others or are waited for."""
    results = messages.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()).select("conv_id", F.col("call_id").alias("id"), "turn", "row").distinct()
    answered = cut(results.join(first, ["conv_id", "id"]), "answers")
    own = lambda turn: F.struct(F.col(turn).isNull().alias("z"), F.col(turn).alias("turn"), F.lit(0).alias("level"))
    to_result = answered.select("conv_id", F.col("c.row").alias("a"), F.col("c.turn").alias("a_turn"), F.col("row").alias("b"), F.col("turn").alias("b_turn"))
    waits = calls.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "row", F.explode("after").alias("id")).where(F.col("id").isNotNull()).distinct()
    earlier = F.struct(F.col("c.z").alias("z"), F.col("c.turn").alias("t")) < F.struct(F.col("w_turn").isNull().alias("z"), F.col("w_turn").alias("t"))
    met = waits.select("conv_id", "id", F.col("turn").alias("w_turn"), F.col("row").alias("w_row")).join(answered, ["conv_id", "id"]).where(earlier)
    to_caller = met.select("conv_id", F.col("row").alias("a"), F.col("turn").alias("a_turn"), F.col("w_row").alias("b"), F.col("w_turn").alias("b_turn"))
    edges = cut(to_result.unionAll(to_caller).distinct(), "edges")
    ends = edges.select("conv_id", F.col("a").alias("row"), own("a_turn").alias("place")).unionAll(edges.select("conv_id", F.col("b").alias("row"), own("b_turn").alias("place")))
    known = cut(ends.distinct(), "places")
    while True:
        met = edges.join(known.withColumnRenamed("row", "a"), ["conv_id", "a"]).select("conv_id", F.col("b").alias("row"), F.struct("place.z", "place.turn", (F.col("place.level") + 1).alias("level")).alias("by"))
        raised = known.join(met.groupBy("conv_id", "row").agg(F.max("by").alias("by")), ["conv_id", "row"], "left")
        later = F.coalesce(F.col("by") > F.col("place"), F.lit(False))
        raised = cut(raised.select("conv_id", "row", F.when(later, F.col("by")).otherwise(F.col("place")).alias("place"), later.alias("moved")), "places")
        known = raised.drop("moved")
        if raised.where("moved").isEmpty():
            return known


def format_chats(df: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """conv_id, turn, role, position, n_calls, n_valid, n_unanswered, link, message."""
    messages = cut(parsed(df), "messages")
    calls = cut(checked_calls(messages, schemas), "calls")
    first = cut(first_calls(calls), "first-calls")
    answered = messages.where(F.col("call_id").isNotNull()).select("conv_id", F.col("call_id").alias("id")).distinct()
    # Per message: its calls as canonical JSON, in their order.
    told = calls.join(answered.withColumn("hit", F.lit(True)), ["conv_id", "id"], "left")
    after = F.when(F.size("after") > 0, F.concat(F.lit('"after":'), F.to_json("after"), F.lit(","))).otherwise(F.lit(""))
    text = F.concat(F.lit("{"), F.coalesce(after, F.lit("")), F.lit('"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), _quoted(F.col("id")), F.lit(',"name":'), _quoted(F.col("name")), F.lit(',"valid":'), F.coalesce(F.col("valid").cast("string"), F.lit("null")), F.lit("}"))
    by_message = told.groupBy("conv_id", "turn", "row").agg(
        F.sort_array(F.collect_set(F.struct("at", text.alias("text")))).alias("list"),
        F.count_if(F.col("hit").isNull()).alias("open"),
        F.count(F.lit(1)).alias("all"),
        F.when(F.count_if(F.col("valid").isNull()) == 0, F.count_if("valid")).alias("good"),
    )
    m = messages.join(by_message.select(F.col("row").alias("r"), F.col("conv_id").alias("rc"), F.col("turn").alias("rt"), "list", "open", "all", "good"), (F.col("row") == F.col("r")) & F.col("conv_id").eqNullSafe(F.col("rc")) & F.col("turn").eqNullSafe(F.col("rt")), "left")
    m = m.join(first.select(F.col("conv_id").alias("fc"), F.col("id").alias("fi")), (F.col("conv_id") == F.col("fc")) & (F.col("call_id") == F.col("fi")), "left")
    link = F.when(F.col("call_id").isNull(), F.lit(None)).when(F.col("fi").isNotNull(), "linked").otherwise("orphan")
    at = places(messages, calls, first).select(F.col("conv_id").alias("pc"), F.col("row").alias("pr"), "place")
    m = m.join(at, (F.col("conv_id") == F.col("pc")) & (F.col("row") == F.col("pr")), "left")
    anchor = F.when(F.col("place").isNull(), F.col("turn")).otherwise(F.col("place.turn"))
    m = m.withColumns({"link": link, "anchor": anchor, "level": F.coalesce("place.level", F.lit(0))})
    calls_json = F.array_join(F.transform("list", lambda x: x["text"]), ",")
    line = F.concat(
        F.lit('{"content":'), _quoted(F.col("content")), F.lit(',"role":'), _quoted(F.col("role")),
        F.when(F.col("call_id").isNotNull(), F.concat(F.lit(',"tool_call_id":'), _quoted(F.col("call_id")))).otherwise(F.lit("")),
        F.when(F.col("list").isNotNull(), F.concat(F.lit(',"tool_calls":['), calls_json, F.lit("]"))).otherwise(F.lit("")), F.lit("}"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    h = F.md5(F.concat_ws("|", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))))
    m = m.select("conv_id", "turn", "role", h.alias("h"), "anchor", "level", "link", n("all").alias("n_calls"), F.when(F.col("all").isNotNull(), F.col("good")).otherwise(F.lit(0)).cast("bigint").alias("n_valid"), n("open").alias("n_unanswered"), line.alias("message"))
    return _placed(cut(m, "lines"))


def _placed(m: DataFrame) -> DataFrame:
    """position (from 0) of each message in its conversation: by ranges of turns, equal places in them, and ranks in those."""
    m = m.withColumns({"part": F.coalesce(F.floor(F.col("anchor") / RANGE), F.lit(2**62)).cast("bigint"), "sub": F.substring("h", 1, 2)})
    last = lambda c: (F.col(c).isNull(), F.coalesce(F.col(c), F.lit(0)))
    same = ["conv_id", "part", "anchor", "level", "turn", "sub"]
    groups = cut(m.groupBy(*same).count(), "places")
    before = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = groups.groupBy("conv_id", "part").agg(F.sum("count").alias("count"))
    ranges = ranges.select(F.col("conv_id").alias("rc"), F.col("part").alias("rp"), before(Window.partitionBy("conv_id").orderBy("part")).alias("from_range"))
    inside = before(Window.partitionBy("conv_id", "part").orderBy(*last("anchor"), "level", *last("turn"), "sub"))
    starts = groups.select(*same, inside.alias("inside")).join(ranges, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("part") == F.col("rp")))
    starts = starts.select(*(F.col(c).alias(f"s_{c}") for c in same), (F.col("from_range") + F.col("inside")).alias("start"))
    m = m.withColumn("rank", F.row_number().over(Window.partitionBy(*same).orderBy("h", "message")) - 1)
    met = F.lit(True)
    for c in same:
        met = met & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    m = m.join(cut(starts, "starts"), met)
    return m.select("conv_id", "turn", "role", (F.col("start") + F.col("rank")).cast("bigint").alias("position"), "n_calls", "n_valid", "n_unanswered", "link", "message")


# --- conversations with tools, made of plain ones -------------------------------------------------------------------------

#: Tools of `with_tools`.
REGISTRY = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "count": {"chars": ("integer", True), "ratio": ("number", False)},
}


def with_tools(df: DataFrame) -> DataFrame:
    """Conversations in which assistants call tools, made of plain ones by rule, since plain ones have nothing to link.

    Turns are multiplied by ten. Every answer of an assistant makes a call, some a second one that waits for the call of the
    answer before; ids, turns and text decide what is asked. Some arguments are of the wrong kind, lack a field or have an
    unknown one, some tools are unknown, some calls get no result, some results come before their call or after later
    messages, and some results have no call. Rows without conv_id, turn or text stay plain.
    """
    c, t, text = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("text")
    rows = df.select(c.alias("conv_id"), t.alias("turn"), F.col("role").cast("string").alias("role"), text.cast("string").alias("text"))
    asks = (F.col("role") == "assistant") & c.isNotNull() & t.isNotNull() & text.isNotNull()
    asks = F.coalesce(asks, F.lit(False))
    case, search = (3 * c + t) % 7, (c + t) % 2 == 0
    call_id = lambda turn, k: F.concat(F.lit("c"), c.cast("string"), F.lit("-"), turn.cast("string"), F.lit(f"-{k}"))
    js = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    query, chars, ratio, many = F.left(text, F.lit(12)), F.length(text), F.lit(0.5).cast("double"), F.lit("many")
    of_search = F.when(case == 0, js(limit=many, query=query)).when(case == 1, js(limit=t)).when(case == 3, js(query=query, limit=t, zzz=F.lit(True))).otherwise(js(query=query, limit=t))
    of_count = F.when(case == 0, js(chars=many, ratio=ratio)).when(case == 1, js(ratio=ratio)).when(case == 3, js(zzz=F.lit(True), ratio=ratio, chars=chars)).otherwise(js(ratio=ratio, chars=chars))
    name = F.when(case == 2, "unknown").when(search, "search").otherwise("count")
    one = F.concat(F.lit('{"id":"'), call_id(t, 0), F.lit('", "name":"'), name, F.lit('", "arguments": '), F.when(search, of_search).otherwise(of_count), F.lit("}"))
    two = F.concat(F.lit(', {"name":"search","after":["'), call_id(t - 2, 0), F.lit('"],"id":"'), call_id(t, 1), F.lit('","arguments":{"query":"again","limit":1}}'))
    second = (c + 2 * t) % 3 == 0
    said = F.concat(F.lit('{"tool_calls": ['), one, F.when(second, two).otherwise(F.lit("")), F.lit('], "content": '), _quoted(text), F.lit("}"))
    result = lambda i: js(content=F.concat(F.lit("result of "), i), tool_call_id=i)
    shift = F.when((c + t) % 9 == 0, -5).when((c + t) % 4 == 1, 25).otherwise(3)
    row = lambda turn, role, text: F.struct(turn.alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    answer = lambda k, there: F.when(there & ((5 * c + t + k) % 6 != 0), row(t * 10 + shift + k, "tool", result(call_id(t, k))))
    orphan = F.when((c + t) % 11 == 0, row(t * 10 + 8, "tool", result(F.concat(F.lit("x"), c.cast("string"), F.lit("-"), t.cast("string")))))
    plain = F.struct((t * 10).alias("turn"), F.col("role"), text.alias("text"))
    made = F.when(asks, F.array_compact(F.array(row(t * 10, "assistant", said), answer(0, F.lit(True)), answer(1, second), orphan))).otherwise(F.array(plain))
    return rows.select("conv_id", F.inline(made))


#: DuckDB SQL for format_chats(with_tools(conversations), REGISTRY), from the rules of with_tools and not from its JSON
#: (ids, turns and text not null, one row for each conversation and turn).
SQL = r"""WITH RECURSIVE v AS (SELECT conv_id AS c, turn AS t, role, text FROM conversations),
 a AS (SELECT *, (3 * c + t) % 7 AS k, (c + t) % 2 = 0 AS search, (c + 2 * t) % 3 = 0 AS second, 'c' || c || '-' || t || '-' AS pre,
  CASE WHEN (c + t) % 9 = 0 THEN -5 WHEN (c + t) % 4 = 1 THEN 25 ELSE 3 END AS shift FROM v WHERE role = 'assistant'),
 calls AS (SELECT c, t, pre || '0' AS id, (5 * c + t) % 6 <> 0 AS answered, t * 10 + shift AS r_turn, NULL::VARCHAR AS waits FROM a
  UNION ALL SELECT c, t, pre || '1', (5 * c + t + 1) % 6 <> 0, t * 10 + shift + 1, 'c' || c || '-' || (t - 2) || '-0' FROM a WHERE second),
 results AS (SELECT c, r_turn AS turn, id FROM calls WHERE answered UNION ALL SELECT c, t * 10 + 8, 'x' || c || '-' || t FROM a WHERE (c + t) % 11 = 0),
 edges AS (SELECT c, t * 10 AS src, r_turn AS dst FROM calls WHERE answered
  UNION ALL SELECT w.c, x.r_turn, w.t * 10 FROM calls w JOIN calls x ON x.c = w.c AND x.id = w.waits AND x.answered),
 nodes AS (SELECT c, src AS n FROM edges UNION SELECT c, dst FROM edges),
 walk AS (SELECT c, n, n AS anchor, 0 AS level FROM nodes
  UNION SELECT w.c, e.dst, greatest(w.anchor, e.dst), CASE WHEN e.dst > w.anchor THEN 0 ELSE w.level + 1 END FROM walk w JOIN edges e ON e.c = w.c AND e.src = w.n),
 place AS (SELECT c, n, max((anchor, level)) AS p FROM walk GROUP BY c, n),
 q AS (SELECT *, to_json(text)::VARCHAR AS content, to_json(left(text, 12))::VARCHAR AS head FROM a),
 args AS (SELECT *, CASE WHEN search THEN CASE k WHEN 0 THEN '{"limit":"many","query":' || head || '}' WHEN 1 THEN '{"limit":' || t || '}' WHEN 3 THEN '{"limit":' || t || ',"query":' || head || ',"zzz":true}' ELSE '{"limit":' || t || ',"query":' || head || '}' END
  ELSE CASE k WHEN 0 THEN '{"chars":"many","ratio":0.5}' WHEN 1 THEN '{"ratio":0.5}' WHEN 3 THEN '{"chars":' || length(text) || ',"ratio":0.5,"zzz":true}' ELSE '{"chars":' || length(text) || ',"ratio":0.5}' END END AS arg FROM q),
 m AS (SELECT c, t * 10 AS turn, role, 0 AS n_calls, 0 AS n_valid, 0 AS n_unanswered, NULL::VARCHAR AS link, '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' AS message FROM v WHERE role <> 'assistant'
  UNION ALL SELECT c, t * 10, role, 1 + second::INT, CASE WHEN k IN (0, 1, 2, 3) THEN 0 ELSE 1 END + second::INT, ((5 * c + t) % 6 = 0)::INT + (second AND (5 * c + t + 1) % 6 = 0)::INT, NULL,
   '{"content":' || content || ',"role":"assistant","tool_calls":[{"arguments":' || arg || ',"id":"' || pre || '0","name":"' || CASE WHEN k = 2 THEN 'unknown' WHEN search THEN 'search' ELSE 'count' END || '","valid":' || CASE WHEN k IN (0, 1, 2, 3) THEN 'false' ELSE 'true' END || '}'
   || CASE WHEN second THEN ',{"after":["c' || c || '-' || (t - 2) || '-0"],"arguments":{"limit":1,"query":"again"},"id":"' || pre || '1","name":"search","valid":true}' ELSE '' END || ']}' FROM args
  UNION ALL SELECT c, turn, 'tool', 0, 0, 0, CASE WHEN id LIKE 'x%' THEN 'orphan' ELSE 'linked' END, '{"content":"result of ' || id || '","role":"tool","tool_call_id":"' || id || '"}' FROM results)
SELECT m.c AS conv_id, turn, role, row_number() OVER (PARTITION BY m.c ORDER BY coalesce(p, (turn, 0)), turn) - 1 AS position, n_calls::BIGINT AS n_calls, n_valid::BIGINT AS n_valid, n_unanswered::BIGINT AS n_unanswered, link, message
 FROM m LEFT JOIN place ON m.c = place.c AND m.turn = place.n"""
