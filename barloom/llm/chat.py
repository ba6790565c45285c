"""Tool-call linking: calls and results joined by identifier, ordered, validated and written as canonical JSON.

    messages: conv_id, turn, role, content, tool_calls array<struct<id, name, arguments, after array<string>>>, tool_call_id

Every message, call and result becomes one event at a place (turn, seq). Calls and results are hash-joined by
(conversation, identifier); a result depends on its call, a call on the results its `after` names. An event's order
key is the latest place among itself and all it depends on, with the number of steps from there: sorting by it is a topological
order that otherwise keeps the order of turns. Where every dependence points backwards in time nothing has to be done;
in other conversations settled events are peeled off and chains are walked by doubling, in joins over places and identifiers alone. The
number of rounds grows with the logarithm of the longest chain, for each event with several open predecessors on the way.

A conversation is never gathered: grouping is by identifier with map-side combining, and the order is a sort key, so a
conversation with a third of all rows is spread like any other. Built-in functions only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import release, staged


class Field(NamedTuple):
    """An argument in a tool's schema; least and most bound a number, the length of a string or the size of an array.

    fields are those of an object (others are errors), items says what an array's elements must be (its name is not looked at).
    """

    name: str
    type: str  # string, integer, number, boolean, array or object
    required: bool = True
    least: int | None = None
    most: int | None = None
    choices: tuple[str, ...] = ()
    fields: tuple["Field", ...] = ()
    items: "Field | None" = None


LANGUAGES = ("de", "en", "es", "fr")
TOOLS = {
    "search": (
        Field("query", "string", True, 1, 300),
        Field("top", "integer", True, 1, 40),
        Field("filter", "object", False, fields=(Field("langs", "array", True, 1, 4, items=Field("", "string", choices=LANGUAGES)), Field("exact", "boolean", False))),
    ),
    "translate": (Field("text", "string", True, 1), Field("target", "string", True, choices=LANGUAGES)),
}
#: What schema_of_variant calls the JSON types.
_KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}


def _none() -> Column:
    return F.array().cast("array<string>")


def _value_errors(value: Column, f: Field, label: Column) -> Column:
    """What is wrong with a value (a variant column) that stands for f, as an array of strings that begin with its label."""
    right = F.coalesce(F.schema_of_variant(value).rlike(_KINDS[f.type]), F.lit(False))
    if f.type == "string":
        amount = F.length(F.try_variant_get(value, "$", "string"))
    elif f.type == "array":
        amount = F.size(F.try_variant_get(value, "$", "array<variant>"))
    else:
        amount = F.try_variant_get(value, "$", "double")
    found = [F.when(~right, F.concat(label, F.lit(f": not {f.type}")))]
    if f.least is not None:
        found.append(F.when(right & (amount < f.least), F.concat(label, F.lit(f": below {f.least}"))))
    if f.most is not None:
        found.append(F.when(right & (amount > f.most), F.concat(label, F.lit(f": above {f.most}"))))
    if f.choices:
        found.append(F.when(right & ~F.try_variant_get(value, "$", "string").isin(*f.choices), F.concat(label, F.lit(": no choice"))))
    out = F.array_compact(F.array(*found))
    if f.fields:
        out = F.concat(out, F.when(right, _object_errors(value, f.fields, F.concat(label, F.lit(".")))).otherwise(_none()))
    if f.items is not None:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v, i: _value_errors(v, f.items, F.concat(label, F.lit("["), i.cast("string"), F.lit("]"))))
        out = F.concat(out, F.when(right, F.flatten(each)).otherwise(_none()))
    return out


def _object_errors(value: Column, fields: tuple[Field, ...], prefix: Column) -> Column:
    """What is wrong with an object (a variant column) by its fields, in their order, then its unknown names, sorted."""
    names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
    out = []
    for f in fields:
        label, there = F.concat(prefix, F.lit(f.name)), F.array_contains(names, f.name)
        missing = F.array(F.concat(label, F.lit(": missing"))) if f.required else _none()
        out.append(F.when(there, _value_errors(F.try_variant_get(value, f"$.{f.name}", "variant"), f, label)).otherwise(missing))
    unknown = F.array_sort(F.array_except(names, F.array(*[F.lit(f.name) for f in fields])))
    return F.concat(*out, F.transform(unknown, lambda k: F.concat(prefix, k, F.lit(": unknown"))))


def schema_errors(name: Column, arguments: Column, tools: dict[str, tuple[Field, ...]] = TOOLS) -> Column:
    """An array of what is wrong with a call's arguments (a JSON string), empty if nothing is."""
    value = F.try_parse_json(F.coalesce(arguments, F.lit("")))
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    known = F.lit(None).cast("array<string>")
    for tool, fields in tools.items():
        known = F.when(name == tool, _object_errors(value, fields, F.lit(""))).otherwise(known)
    known = F.coalesce(known, F.array(F.lit("unknown tool")))
    return F.when(value.isNull(), F.array(F.lit("not JSON"))).when(~is_object, F.array(F.lit("not an object"))).otherwise(known)


def _events(messages: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    after = F.array().cast("array<string>")
    base = ["conv_id", "turn"]
    plain = messages.select(
        *base, F.lit(0).alias("seq"), F.when(F.col("role") == "tool", "result").otherwise("message").alias("kind"),
        F.when(F.col("role") == "tool", F.col("tool_call_id")).alias("call_id"), none.alias("name"), F.col("role"), F.col("content"), after.alias("after"),
    )
    calls = messages.filter(F.size("tool_calls") > 0).select(*base, F.posexplode("tool_calls").alias("at", "c"))
    calls = calls.select(
        *base, (F.col("at") + 1).alias("seq"), F.lit("call").alias("kind"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), none.alias("role"),
        F.col("c.arguments").alias("content"), F.coalesce("c.after", after).alias("after"),
    )
    return plain.unionByName(calls)


def _ordered(edges: DataFrame) -> DataFrame:
    """(conv_id, at, key, cyclic): events that are moved or cyclic, from edges (conv_id, pred, at) of places struct<turn, seq>.

    key struct<turn, seq, hops> is the largest of the event's own and one hop beyond each predecessor's. Only
    conversations in which an event comes before one it needs are looked at. A round does two things for every edge at once:
    an edge from an event without open predecessors goes, its key having been passed on; an edge from an event with a single
    open predecessor is lengthened to start there, so that a chain of n hops takes log2(n) rounds. Events with several open predecessors wait until all
    but one are settled. An edge longer than its conversation has edges, and one that no round can change, lead round a cycle.
    """
    place = lambda at: F.struct(F.col(f"{at}.turn").alias("turn"), F.col(f"{at}.seq").alias("seq"), F.lit(0).alias("hops"))
    late = edges.filter("pred >= at").select("conv_id").distinct()
    some = edges.join(late, "conv_id", "left_semi")
    sizes = some.groupBy("conv_id").agg(F.count("*").alias("most"))
    links = staged(some.join(sizes, "conv_id").select("conv_id", "pred", "at", F.lit(1).alias("dist"), "most"), "links")
    ends = links.select("conv_id", "at").unionByName(links.select("conv_id", F.col("pred").alias("at"))).distinct()
    keys = staged(ends.select("conv_id", "at", place("at").alias("key"), F.lit(False).alias("cyclic")), "keys")
    while True:
        open_ = links.groupBy("conv_id", F.col("at").alias("pred")).agg(F.count("*").alias("n"), F.max(F.struct("pred", "dist")).alias("on"))
        known = keys.select("conv_id", F.col("at").alias("pred"), F.col("key").alias("k"), F.col("cyclic").alias("round"))
        met = staged(links.join(known, ["conv_id", "pred"]).join(open_, ["conv_id", "pred"], "left"), "met")
        changed = met.filter("n is null or n = 1")
        if changed.isEmpty():
            break
        beyond = F.struct(F.col("k.turn").alias("turn"), F.col("k.seq").alias("seq"), (F.col("k.hops") + F.col("dist")).alias("hops"))
        longer = F.col("dist") + F.when(F.col("n") == 1, F.col("on.dist")).otherwise(0)
        turned = F.coalesce((F.col("n") == 1) & ((longer > F.col("most")) | (F.col("on.pred") == F.col("at"))), F.lit(False))
        met = met.withColumns({"beyond": beyond, "longer": longer, "turned": turned})
        news = met.groupBy("conv_id", "at").agg(F.max("beyond").alias("new"), F.max(F.col("round") | F.col("turned")).alias("on_round"))
        nxt = met.filter("n is not null and not turned").select("conv_id", F.when(F.col("n") == 1, F.col("on.pred")).otherwise(F.col("pred")).alias("pred"), "at", F.col("longer").alias("dist"), "most")
        nxt = staged(nxt.groupBy("conv_id", "pred", "at").agg(F.max("dist").alias("dist"), F.max("most").alias("most")), "links")
        raised = keys.join(news, ["conv_id", "at"], "left").select(
            "conv_id", "at", F.greatest("key", F.coalesce("new", "key")).alias("key"), (F.col("cyclic") | F.coalesce("on_round", F.lit(False))).alias("cyclic")
        )
        raised = staged(raised, "keys")
        for old in (links, keys, changed):
            release(old)
        links, keys = nxt, raised
    stuck = links.select("conv_id", "at").distinct().withColumn("stuck", F.lit(True))
    out = keys.join(stuck, ["conv_id", "at"], "left").withColumn("cyclic", F.col("cyclic") | F.coalesce("stuck", F.lit(False)))
    return out.filter(F.col("cyclic") | (F.col("key") > place("at"))).select("conv_id", "at", "key", "cyclic")


def link(messages: DataFrame, tools: dict[str, tuple[Field, ...]] = TOOLS) -> DataFrame:
    """(conv_id, turn, seq, kind, call_id, name, status, errors, order_turn, order_seq, order_hops, json), one row for each event.

    status: `linked` (call with a result, result with a call), `unanswered` call, `orphan` result, `duplicate` (a later call or result with
    an identifier already used in its conversation), `no id`, `cyclic` (depends on itself, or on an event that does; keeps its own place), or `plain` for messages.
    errors: what the tool's schema finds wrong, null for other events. json: the event with sorted keys and no spaces; arguments that
    are not JSON are written as a string. Sorting by the order columns and then turn, seq puts every call before its result and every
    needed result before the call that needs it.

    Nulls: a null identifier links with nothing, null tool_calls are none, a null conversation links with nothing; null texts are
    JSON nulls. Repeated rows are the same event, written as often as it came in. An empty table gives an empty result; other columns
    are not looked at.
    """
    events = _events(messages)
    at = F.struct("turn", "seq")
    ids = events.filter("kind <> 'message' and call_id is not null and conv_id is not null")
    first = ids.groupBy("conv_id", "call_id").agg(F.min(F.when(F.col("kind") == "call", at)).alias("call_at"), F.min(F.when(F.col("kind") == "result", at)).alias("result_at"))
    first = staged(first, "identifiers")
    rows = events.join(first, ["conv_id", "call_id"], "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    status = (
        F.when(F.col("kind") == "message", "plain")
        .when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "no id")
        .when(is_result & F.col("call_at").isNull(), "orphan")
        .when(is_call & ~at.eqNullSafe(F.col("call_at")), "duplicate")
        .when(is_result & ~at.eqNullSafe(F.col("result_at")), "duplicate")
        .when(is_call & F.col("result_at").isNull(), "unanswered")
        .otherwise("linked")
    )
    rows = rows.withColumn("status", status)

    answers = first.filter("call_at is not null and result_at is not null").select("conv_id", F.col("call_at").alias("pred"), F.col("result_at").alias("at"))
    needs = events.filter(is_call & (F.size("after") > 0)).select("conv_id", at.alias("at"), F.explode("after").alias("call_id"))
    needs = needs.join(first, ["conv_id", "call_id"]).select("conv_id", F.coalesce("result_at", "call_at").alias("pred"), "at")
    edges = staged(answers.unionByName(needs).filter("pred is not null").distinct(), "edges")
    moved = _ordered(edges)
    rows = rows.withColumn("at", at).join(moved, ["conv_id", "at"], "left")
    cyclic = F.coalesce("cyclic", F.lit(False))
    key = F.when(F.col("key").isNotNull() & ~cyclic, F.col("key")).otherwise(F.struct(F.col("turn").alias("turn"), F.col("seq").alias("seq"), F.lit(0).alias("hops")))
    written = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    canonical = F.coalesce(F.to_json(F.try_parse_json("content")), F.regexp_extract(written(F.col("content").alias("a")), r'(?s)^\{"a":(.*)\}$', 1))
    call = F.concat(F.lit('{"arguments":'), canonical, F.lit(","), F.expr("substr(x, 2)"))
    text = (
        F.when(is_call, call)
        .when(is_result, written("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id")))
        .otherwise(written("content", "role"))
    )
    rows = rows.withColumn("x", written(F.col("call_id").alias("id"), "name", F.lit("function").alias("type"))).withColumn("key", key)
    return rows.select(
        "conv_id", "turn", "seq", "kind", "call_id", "name", F.when(cyclic, "cyclic").otherwise(F.col("status")).alias("status"),
        F.when(is_call, schema_errors(F.col("name"), F.col("content"), tools)).alias("errors"),
        F.col("key.turn").alias("order_turn"), F.col("key.seq").alias("order_seq"), F.col("key.hops").alias("order_hops"), text.alias("json"),
    )


def as_tool_chat(conversations: DataFrame) -> DataFrame:
    """Read a table (conv_id, turn, role, text) as a tool dialogue.

    A user's turn is a call whose identifier is conversation and turn; its tool and arguments follow from the text. It
    needs the result of the call two turns before; in every third conversation that of the call two turns later, and where its text's length is a multiple of
    eleven both, which makes a cycle. An assistant's turn is the result of the call one turn before. Others are messages.
    """
    call_id = lambda step: F.concat(F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") + step).cast("string"))
    size = F.length("text")
    words = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    name = F.when(size % 3 == 0, "search").when(size % 3 == 1, "translate").otherwise("calculate")
    target = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "xx", "fr")]), (size % 4 + 1).cast("int"))
    langs = F.struct((size % 5 == 0).alias("exact"), F.array(F.lit("es"), target).alias("langs"))
    search = F.to_json(F.struct(langs.alias("filter"), words.alias("top"), F.col("text").alias("query")))
    arguments = F.when(size % 3 == 1, F.to_json(F.struct("text", target.alias("target")))).otherwise(search)
    back = F.when(F.col("turn") >= 2, F.array(call_id(-2))).otherwise(_none())
    ahead = F.when(size % 11 == 0, F.concat(back, F.array(call_id(2)))).otherwise(F.array(call_id(2)))
    after = F.when(F.col("conv_id") % 3 == 0, ahead).otherwise(back)
    call = F.struct(call_id(0).alias("id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    user, answer = F.col("role") == "user", F.col("role") == "assistant"
    return conversations.select(
        "conv_id",
        "turn",
        F.when(user, "assistant").when(answer, "tool").otherwise(F.col("role")).alias("role"),
        F.when(~user, F.col("text")).alias("content"),
        F.when(user, F.array(call)).alias("tool_calls"),
        F.when(answer, call_id(-1)).alias("tool_call_id"),
    )


_CHOICES = ", ".join(f"'{c}'" for c in LANGUAGES)
ORACLE = f"""
WITH RECURSIVE c AS (
  SELECT *, conv_id || '-' || turn AS id, conv_id || '-' || (turn - 1) AS before, length(text) AS n,
         len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words,
         ['en', 'de', 'xx', 'fr'][length(text) % 4 + 1] AS target
  FROM conversations
), e AS (
  SELECT conv_id, turn, 0 AS seq, CASE WHEN role = 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE WHEN role = 'assistant' THEN before END AS call_id, CASE WHEN role <> 'user' THEN text END AS content,
         CASE WHEN role = 'user' THEN 'assistant' ELSE role END AS role, NULL::VARCHAR AS name, n, words, target, text
  FROM c
  UNION ALL
  SELECT conv_id, turn, 1, 'call', id, NULL::VARCHAR, NULL::VARCHAR, CASE n % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'translate' ELSE 'calculate' END, n, words, target, text
  FROM c WHERE role = 'user'
), k AS (SELECT DISTINCT call_id, kind FROM e WHERE kind <> 'message'
), places AS (
  SELECT conv_id, call_id, min({{'t': turn, 's': seq}}) FILTER (kind = 'call') AS call_at, min({{'t': turn, 's': seq}}) FILTER (kind = 'result') AS result_at
  FROM e WHERE kind <> 'message' GROUP BY ALL
), wanted AS (
  SELECT conv_id, turn, unnest(CASE WHEN conv_id % 3 <> 0 THEN [turn - 2] WHEN n % 11 = 0 THEN [turn - 2, turn + 2] ELSE [turn + 2] END) AS other
  FROM e WHERE kind = 'call'
), edges AS (
  SELECT conv_id, call_at AS pred, result_at AS here FROM places WHERE call_at IS NOT NULL AND result_at IS NOT NULL
  UNION
  SELECT w.conv_id, coalesce(p.result_at, p.call_at), {{'t': w.turn, 's': 1}}
  FROM wanted w JOIN places p ON p.conv_id = w.conv_id AND p.call_id = w.conv_id || '-' || w.other
), amount AS (SELECT conv_id, count(*) AS most FROM edges GROUP BY conv_id
), walk(conv_id, origin, here, hops) AS (
  SELECT conv_id, pred, here, 1 FROM edges
  UNION
  SELECT w.conv_id, w.origin, g.here, w.hops + 1
  FROM walk w JOIN edges g ON g.conv_id = w.conv_id AND g.pred = w.here JOIN amount a ON a.conv_id = w.conv_id WHERE w.hops <= a.most
), ordered AS (
  SELECT w.conv_id, here.t AS t, here.s AS s, max({{'t': origin.t, 's': origin.s, 'h': hops}}) AS key, max(hops) > max(most) AS round
  FROM walk w JOIN amount a ON a.conv_id = w.conv_id GROUP BY w.conv_id, here
), moved AS (SELECT * FROM ordered WHERE round OR (key.t, key.s) > (t, s))
SELECT e.conv_id, turn, seq, kind, e.call_id, name,
       CASE WHEN m.round THEN 'cyclic' WHEN kind = 'message' THEN 'plain' ELSE CASE kind
         WHEN 'call' THEN CASE WHEN EXISTS (FROM k WHERE k.call_id = e.call_id AND k.kind = 'result') THEN 'linked' ELSE 'unanswered' END
         ELSE CASE WHEN EXISTS (FROM k WHERE k.call_id = e.call_id AND k.kind = 'call') THEN 'linked' ELSE 'orphan' END END END AS status,
       CASE WHEN kind = 'call' THEN concat_ws('; ',
         CASE WHEN name = 'search' AND n < 1 THEN 'query: below 1' END, CASE WHEN name = 'search' AND n > 300 THEN 'query: above 300' END,
         CASE WHEN name = 'search' AND words < 1 THEN 'top: below 1' END, CASE WHEN name = 'search' AND words > 40 THEN 'top: above 40' END,
         CASE WHEN name = 'search' AND target NOT IN ({_CHOICES}) THEN 'filter.langs[1]: no choice' END,
         CASE WHEN name = 'translate' AND n < 1 THEN 'text: below 1' END,
         CASE WHEN name = 'translate' AND target NOT IN ({_CHOICES}) THEN 'target: no choice' END,
         CASE WHEN name = 'calculate' THEN 'unknown tool' END) END AS errors,
       CASE WHEN round OR key IS NULL THEN turn ELSE key.t END AS order_turn, CASE WHEN round OR key IS NULL THEN seq ELSE key.s END AS order_seq,
       CASE WHEN round OR key IS NULL THEN 0 ELSE key.h END AS order_hops,
       CASE kind
         WHEN 'call' THEN '{{"arguments":' || CASE WHEN name = 'translate' THEN '{{"target":' || to_json(target) || ',"text":' || to_json(text) || '}}'
              ELSE '{{"filter":{{"exact":' || (n % 5 = 0) || ',"langs":["es",' || to_json(target) || ']}},"query":' || to_json(text) || ',"top":' || words || '}}' END || ',"id":' || to_json(e.call_id) || ',"name":' || to_json(name) || ',"type":"function"}}'
         WHEN 'result' THEN '{{"content":' || to_json(content) || ',"role":"tool","tool_call_id":' || to_json(e.call_id) || '}}'
         ELSE '{{"content":' || coalesce(to_json(content), 'null') || ',"role":' || to_json(role) || '}}' END AS json
FROM e LEFT JOIN moved m ON m.conv_id = e.conv_id AND m.t = e.turn AND m.s = e.seq
"""
