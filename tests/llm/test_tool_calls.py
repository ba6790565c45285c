"""Tool calls: order of events that depend on later ones, cycles, nested schemas, long texts."""

import json
import random

from pyspark.sql import functions as F

from barloom.llm import chat


def edges_of(spark, rows):
    place = lambda c: F.struct(c.alias("turn"), F.lit(0).alias("seq"))
    return spark.createDataFrame(rows, "conv_id string, a long, b long").select("conv_id", place(F.col("a")).alias("pred"), place(F.col("b")).alias("at"))


def plain(rows):
    """{(conversation, event): key, or "cyclic" on a cycle and behind it} of events that move, by raising keys until nothing changes."""
    out = {}
    for g in {r[0] for r in rows}:
        es = [(a, b) for c, a, b in rows if c == g]
        nodes = {x for e in es for x in e}
        if all(a < b for a, b in es):
            continue
        behind = {v: {b for a, b in es if a == v} for v in nodes}
        key = {v: (v, 0) for v in nodes}
        for _ in range(len(nodes) + 1):
            for v in nodes:
                behind[v] = behind[v].union(*(behind[x] for x in behind[v]))
            for a, b in es:
                key[b] = max(key[b], (key[a][0], key[a][1] + 1))
        on = {v for v in nodes if v in behind[v]}
        on = on.union(*(behind[v] for v in on))
        out |= {(g, v): "cyclic" if v in on else key[v] for v in nodes if v in on or key[v] > (v, 0)}
    return out


def test_order_equals_a_loop(spark):
    rng, rows = random.Random(5), set()
    for g in range(60):
        m = rng.randint(2, 12)
        ranks = rng.sample(range(m), m)
        for _ in range(rng.randint(1, 2 * m)):
            a, b = rng.sample(range(m), 2)
            rows.add((f"g{g}", b, a) if g % 3 and ranks[a] > ranks[b] else (f"g{g}", a, b))
        if g % 10 == 0:
            rows.add((f"g{g}", 0, 0))
    want = plain(sorted(rows))
    assert "cyclic" in want.values() and len(set(want.values())) > 20
    got = {(r.conv_id, r.at.turn): "cyclic" if r.cyclic else (r.key.turn, r.key.hops) for r in chat._ordered(edges_of(spark, sorted(rows))).collect()}
    assert got == want


def test_a_long_chain_and_a_long_cycle_in_few_rounds(spark, monkeypatch):
    n, rounds, write = 10_000, [], chat.staged
    monkeypatch.setattr(chat, "staged", lambda df, name: (rounds.append(name), write(df, name))[1])
    rows = [("chain", k + 1, k) for k in range(n)] + [("round", k, (k + 1) % 77) for k in range(77)]
    out = chat._ordered(edges_of(spark, rows))
    chain = out.filter("conv_id = 'chain'").agg(F.count("*"), F.max("key.hops"), F.min("key.turn"), F.max("cyclic")).first()
    assert tuple(chain) == (n, n, n, False)
    assert out.filter("conv_id = 'round' and cyclic").count() == 77
    assert rounds.count("met") <= 20


def test_nested_schemas(spark):
    F_ = chat.Field
    tools = {"book": (F_("who", "object", fields=(F_("name", "string", least=1), F_("age", "integer", False, 0))), F_("days", "array", False, 1, 3, items=F_("", "object", fields=(F_("d", "integer", most=31),))))}
    cases = {
        '{"who":{"name":"x","age":3},"days":[{"d":1}]}': [],
        "{}": ["who: missing"],
        '{"who":[]}': ["who: not object"],
        '{"who":{"age":-1,"z":1,"b":null}}': ["who.name: missing", "who.age: below 0", "who.b: unknown", "who.z: unknown"],
        '{"who":{"name":""},"days":[]}': ["who.name: below 1", "days: below 1"],
        '{"who":{"name":"x"},"days":[{"d":32},7,{"d":"1"},null],"more":0}': [
            "days: above 3", "days[0].d: above 31", "days[1]: not object", "days[2].d: not integer", "days[3]: not object", "more: unknown",
        ],
        '{"who":null,"days":{}}': ["who: not object", "days: not array"],
        "null": ["not an object"],
        "{": ["not JSON"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "a string")
    got = {r.a: r.e for r in df.select("a", chat.schema_errors(F.lit("book"), F.col("a"), tools).alias("e")).collect()}
    assert got == cases
    none = df.select(chat.schema_errors(F.lit(None).cast("string"), F.lit("{}"), tools).alias("e"), chat.schema_errors(F.lit("book"), F.lit(None).cast("string"), tools).alias("n")).first()
    assert none.e == ["unknown tool"] and none.n == ["not JSON"]


def test_needs_later_calls_and_long_texts(spark):
    schema = "conv_id string, turn long, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, tool_call_id string"
    text = 'long "text" é\n' * 100_000
    args = json.dumps({"text": text, "target": "de"})
    rows = [
        ("a", 0, "assistant", None, [("x", "translate", args, ["y", "z"]), ("w", "translate", args, ["w"])], None), ("a", 1, "tool", text, None, "x"),
        ("a", 2, "assistant", None, [("y", "translate", args, ["z", None, "gone"])], None), ("a", 3, "tool", "y's", None, "y"), ("a", 4, "assistant", None, [("z", "translate", args, [])], None), ("a", 5, "tool", None, None, "z"),
    ]
    got = {(r.turn, r.seq): r for r in chat.link(spark.createDataFrame(rows, schema)).collect()}
    order = sorted(got, key=lambda k: (got[k].order_turn, got[k].order_seq, got[k].order_hops, k))
    assert [k for k in order if k in ((0, 1), (1, 0), (2, 1), (3, 0), (4, 1), (5, 0))] == [(4, 1), (5, 0), (2, 1), (3, 0), (0, 1), (1, 0)]
    assert got[0, 2].status == "cyclic" and got[0, 1].status == "linked" and got[0, 1].errors == []
    assert json.loads(got[0, 1].json)["arguments"] == json.loads(args) and json.loads(got[1, 0].json)["content"] == text
