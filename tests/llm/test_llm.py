"""Each operator against its plain model, and its defined results for nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import json
import os
import random
import re
import struct
import textwrap

import brute
import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import bpe, chat, langid, licenses, minhash, mixing, queries, rules, semdedup, suffix, warc
from barloom.llm.components import components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def words():
    rng = random.Random(1)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="module")
def odd(spark, words):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and columns with the operators' own names."""
    rng = random.Random(2)
    base = [" ".join(rng.choices(words, k=80)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(base)] + [(10, base[0]), (11, base[0] + " tail"), (12, None), (13, ""), (14, " \n\t "), (None, base[1]), (15, "Ünï çödé " * 40), (16, " ".join(rng.choices(words, k=20_000))), (17, "one two"), (18, "One TWO"), (2, base[2])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in ("id", "sig", "key", "did", "uid", "size", "ranges", "_t", "_w", "target", "mark")})


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def test_oracles(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, SF), con.execute(sql)
        columns = [d[0] for d in want.description]
        text = lambda rows, names: sorted(json.dumps([r[names.index(c)] for c in sorted(names)], default=str) for r in rows)
        assert sorted(columns) == sorted(got.columns), name
        assert text([tuple(r) for r in got.collect()], got.columns) == text(want.fetchall(), columns), name


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>A &lt;b&gt;<script>x</script></p><a href=\"/l\">é</a>"), (2, None, None), (None, "http://b/", "")], "page_id long, url string, html string")
    got = warc.derivatives(warc.page_responses(pages), ("page_id",))
    rows = {(r.page_id, r.kind): r for r in got.collect()}
    assert len(rows) == 6 and rows[1, "conversion"].record.endswith("\r\n\r\nA <b>\né")
    assert "outlink: /l\r\n" in rows[1, "metadata"].record and rows[1, "metadata"].refers_to == rows[1, "conversion"].refers_to
    assert "Target-URI" not in rows[2, "conversion"].record and rows[2, "conversion"].content_length == 0
    given = warc.page_responses(pages).withColumn("payload_digest", F.lit("sha1:GIVEN"))
    assert {r.payload_digest for r in warc.derivatives(given).collect()} == {"sha1:GIVEN"}
    warc.write_warc(got, str(tmp_path / "w"), "none")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part*"))
    seen = 0
    while raw:  # lengths lead exactly from record to record
        head, rest = raw.split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)$", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        assert hashlib.sha256(rest[:size]).hexdigest().encode() in head
        raw, seen = rest[size + 4 :], seen + 1
    assert seen == 6 and warc.derivatives(warc.page_responses(empty(spark, "page_id long, url string, html string"))).count() == 0


def test_warc_references_and_links(spark):
    """Numeric and named references, and links in every form of attribute."""
    text = "it&#8217;s &#x2014; caf&eacute; &Eacute;&hellip;&#128512;&#X1f600; &amp;lt; &lt;b&gt; a&nbsp;b a&#160;b &#150; &#0; &#xD800; &#99999999999; &bogus; &; & x &#; &amp &NotEqualTilde;&copy;&#0000065;"
    want = "it\u2019s \u2014 caf\u00e9 \u00c9\u2026\U0001f600\U0001f600 &lt; <b> a b a b \u2013 \ufffd \ufffd \ufffd &bogus; &; & x &#; &amp \u2242\u0338\u00a9A"
    links = "<a href='/1'>x</a><a href=/2>x</a><A\nclass=c HREF =\n\"/3\">x</A><a title=\"see href=/no > \" href= '/4' >x</a><a data-href=\"/no\" href=/5?a=b>x</a><a hidden href=\"\">x</a><abbr href=/no>x</abbr><a href>x</a><a/href=\"/7\"/>x"
    long = "<a " + "k=v " * 50_000 + "href=/8>x</a>"
    rows = [(1, None, text), (2, None, links), (3, None, long), (4, None, "plain")]
    got = warc.derivatives(warc.page_responses(spark.createDataFrame(rows, "page_id long, url string, html string")), ("page_id",)).collect()
    record = {(r.page_id, r.kind): r.record for r in got}
    assert record[1, "conversion"].split("\r\n\r\n", 1)[1] == want
    assert [re.findall("outlink: (.*)\r\n", record[k, "metadata"]) for k in (2, 3, 4)] == [["/1", "/2", "/3", "/4", "/5?a=b", "", "/7"], ["/8"], []]


def test_licenses(spark, odd):
    s = licenses.SENTENCES
    mit = " ".join(s[k][0] for k in ("mit-grant", "mit-notice", "mit-as-is"))
    bsd = "\n".join(s[k][0] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    texts = [mit, bsd + "\n" + s["bsd-endorse"][0], bsd, "x. " + s["apache-2"][0] + "\nAll rights reserved.", s["bsd-source"][0], None, "", "No. Notice."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].licenses for i in range(8)] == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0|Proprietary", "", "", "", ""]
    assert [got[i].n_unmatched for i in range(8)] == [0, 0, 0, 0, 1, 0, 0, 0] and got[7].sentence_ids == "?"
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(empty(spark)).count() == 0


def test_licenses_wrapped(spark):
    """Notices as they stand in files: hard-wrapped, numbered, in comments of several kinds."""
    s = licenses.SENTENCES
    fill = lambda text, first="", rest="": textwrap.fill(text, 72, initial_indent=first, subsequent_indent=rest, break_on_hyphens=False)
    mit = "The MIT License\n\nCopyright (c) 2020 A B\n\n" + "\n\n".join(fill(s[k][0]) for k in ("mit-grant", "mit-notice"))
    mit += "\n\n" + fill(s["mit-as-is"][0] + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.")
    points = [s[k][0] for k in ("bsd-source", "bsd-binary", "bsd-endorse")]
    bsd = lambda n, mark: "\n\n".join([fill(s["bsd-grant"][0])] + [fill(t, mark % k, "   ") for k, t in enumerate(points[:n], 1)])
    apache = "Copyright 2020 A B\n\n" + s["apache-2"][1] + "\n" + fill(s["apache-comply"][0] + " " + s["apache-copy"][0]) + "\n\n    http://www.apache.org/licenses/LICENSE-2.0\n"
    gpl = fill(s["gpl-3-later"][0]) + "\n\n" + fill(s["gpl-warranty"][0])
    isc = "Copyright (c) 2020 A B\n" + fill(s["isc-grant"][0])
    end = bsd(2, "%d. ") + "\n\nTHIS SOFTWARE IS PROVIDED AS IS."
    commented = [f"{a}" + "\n".join((m + line).rstrip() for line in t.split("\n")) + z for a, m, z, t in (("", "// ", "", mit), ("", "# ", "", gpl), ("/*\n", " * ", "\n */", bsd(3, "%d. ")), ("", ";; ", "", apache), ("", "-- ", "", isc), ("<!-- ", "", " -->", "Released under the MIT License"))]
    cases = [(mit, "MIT"), (bsd(2, "%d. "), "BSD-2-Clause"), (end, "BSD-2-Clause"), (bsd(3, "%d. "), "BSD-3-Clause"), (bsd(3, "(%d) "), "BSD-3-Clause"), (apache, "Apache-2.0"), (gpl, "GPL-3.0-or-later"), (isc, "ISC")]
    cases += [(mit.replace("\n", "\r\n"), "MIT"), *zip(commented, ("MIT", "GPL-3.0-or-later", "BSD-3-Clause", "Apache-2.0", "ISC", "MIT"))]
    cases += [("Permission to use,\n\n" + s["isc-grant"][0][19:], ""), ("foo Licensed under the\nMIT License.", ""), ("Licensed under the\nMIT License foo.", "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].licenses for i in range(len(cases))] == [want for _, want in cases]
    assert got[3].sentence_ids == "bsd-grant bsd-source bsd-binary bsd-endorse" and got[3].n_sentences == 4
    assert all(r.n_unmatched == 0 for r in got.values())


def test_minhash(spark, odd, words):
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None and r.doc_id != 16]
    rows = list(dict(rows).items())
    for k in range(60):  # chains of near copies around the threshold
        t = rng.choices(words, k=120)
        for j in range(4):
            rows.append((1000 + 4 * k + j, " ".join(t)))
            t = list(t)
            t[rng.randrange(120)] = "zz%d" % rng.randrange(99)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, size=size).collect()}
        assert got == brute.near(rows, size, 80)
    found = minhash.near_duplicates(odd).collect()
    assert len(found) == odd.count() and [r for r in found if r.doc_id is None][0].kept
    assert {r.doc_id for r in found if r.component_id == 0} == {0, 10, 11} and minhash.near_duplicates(empty(spark)).count() == 0


def test_minhash_blocks(spark, words, monkeypatch):
    """A large bucket in several blocks loses no link."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "BLOCK_ITEMS", 1500)
    rng = random.Random(8)
    t = rng.choices(words, k=150)
    rows = []
    for i in range(60):
        u = list(t)
        for k in range(rng.randint(0, 5)):
            u[rng.randrange(150)] = "q%d" % rng.randrange(9)
        rows.append((i, " ".join(u)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()}
    assert got == {i: v[1] for i, v in brute.near(rows, 4, 80).items()}


def test_suffix(spark, odd, words):
    rng = random.Random(6)
    shared = " ".join(rng.choices(words, k=60))
    texts = [" ".join(rng.choices(words, k=50)) + shared[a:b] + " ".join(rng.choices(words, k=50)) for a, b in ((0, 300), (50, 350), (0, 199), (100, 300), (20, 219))]
    texts += ["ab" * 200, "x" * 250, None, "", "é" * 150, "short"]
    for t in (texts, [r.text for r in odd.collect() if r.doc_id != 16]):
        df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
        for hot in (suffix.HOT, 1):
            got = {r.doc_id: tuple(r)[1:] for r in suffix.removal(df, digests=True, hot=hot).collect()}
            assert got == dict(enumerate(brute.removed(t, 200)))
    kept = suffix.removal(odd, carry=("uid", "lang"))
    assert kept.columns[-2:] == ["uid", "lang"] and kept.count() == odd.count() and suffix.removal(empty(spark)).count() == 0


def test_repeats_across_shards():
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.integers(97, 100, 900, dtype=np.uint8)
    texts = [np.concatenate([rng.integers(97, 123, 300, dtype=np.uint8), a[k : k + 300]]) for k in range(0, 600, 100)]
    for shard in (256, 1 << 18):
        hits = suffix.repeated_starts(texts, 50, 25, shard)
        raw = [t.tobytes() for t in texts]
        seen = {}
        for t in raw:
            for k in range(len(t) - 49):
                seen[t[k : k + 50]] = seen.get(t[k : k + 50], 0) + 1
        for t, h in zip(raw, hits):
            assert [seen[t[k : k + 50]] > 1 for k in range(len(t) - 49)] == h.tolist()


def test_language(spark, odd):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    held = got.filter("held_out and lang is not null")
    assert held.filter("lang = lang_pred").count() >= 0.99 * held.count() > 0
    assert got.filter("score < 0 or score > 1").count() == 0
    found = {r.doc_id: r for r in langid.language_id(odd).collect() if r.doc_id is not None}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (12, 13, 14))
    assert {r.lang_pred for r in langid.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_id(empty(spark)).count() == 0
    fitted = langid.learn(odd.filter("doc_id is not null"), "doc_id", "text", "lang")
    assert langid.recognised(odd, fitted).count() == odd.count() - 3 and langid.recognised(odd, fitted).columns == odd.columns


def test_rules(spark, odd):
    found = rules.ledger(odd)
    assert found.count() == odd.count() and rules.ledger(empty(spark)).count() == 0
    assert {r.n_words for r in found.filter("doc_id in (12, 13, 14)").collect()} == {0}
    docs = rules.ledger(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    rows = docs.collect()
    for name, p in rules.POLICIES.items():
        reject, doubt = rules.mask(p.reject), rules.mask(p.doubt)
        gone = [bool(r.failures & reject) or bool(p.doubt and bin(r.failures & doubt).count("1") >= p.limit) for r in rows]
        v = rules.versions(docs).filter(F.col("version") == name).first()
        assert (v.n, v.dropped) == (len(rows), sum(gone))
    drops = lambda p, f: bool(f & rules.mask(p.reject)) or bool(p.doubt and bin(f & rules.mask(p.doubt)).count("1") >= p.limit)
    # failures of every kind, those that only together make a doubt among them
    every = spark.range(1 << len(rules.RULES)).select(F.col("id").alias("doc_id"), F.col("id").alias("failures"))
    for table in (docs, every):
        bits = [r.failures for r in table.collect()]
        got = {(a.version, a.rule): (a.failed, a.alone) for a in rules.ablations(table).collect()}
        for name, p in rules.POLICIES.items():
            for rule in (*p.reject, *p.doubt):
                bit = rules.mask([rule])
                assert got.pop((name, rule)) == (sum(bool(f & bit) for f in bits), sum(drops(p, f) and not drops(p, f & ~bit) for f in bits))
        assert not got
    assert rules.ablations(rules.ledger(empty(spark))).count() == 0 == rules.versions(rules.ledger(empty(spark))).count()


def seats(votes, n):
    won = [0] * len(votes)
    for _ in range(n):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_mixing(spark, odd):
    rng = random.Random(7)
    for _ in range(4):
        votes = [rng.choice([0, 1, 7, 50, 333]) for _ in range(rng.randint(1, 9))] + [20]
        df = spark.createDataFrame([("g", i, float(v), 37) for i, v in enumerate(votes)], "g string, i int, v double, n long")
        assert [r.quota for r in mixing.sainte_lague(df, ["g"], ["i"], "v", "n").orderBy("i").collect()] == seats(votes, 37)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 90))) if i % 9 else None, rng.choice(["a", "b", "c", "d", None]) if i > 150 else "hot") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = {r.doc_id: r for r in mixing.mix(df, shard=600, carry=("text",)).collect()}
    assert first == {r.doc_id: r for r in mixing.mix(df.repartition(7), shard=600, carry=("text",)).collect()}
    by = {}
    for r in first.values():
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.words * p.times for p in r.parts)
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in first.values())
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and abs(sum(r.taken for r in v) - v[0].target) <= 16 * (2 + v[0].source_size // 600 * 2)
    taken = mixing.taken_texts(mixing.mix(df, shard=600, carry=("text",)))
    assert taken.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == sum(r.taken for r in first.values())
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(empty(spark)).count() == 0


def test_vectors(spark):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        c = [rng.gauss(0, 1) for _ in range(16)]
        for _ in range(25):
            rows.append((len(rows), [x + rng.gauss(0, 0.22) for x in c], g % 3))
    rows += [(900, rows[0][1], 0), (901, None, 0), (902, [0.0] * 16, 0), (903, [float("nan")] + [1.0] * 15, 0), (904, rows[0][1], None), (905, [None] + [1.0] * 15, 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (908, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    want = brute.linked_vectors(rows, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in semdedup.near_vectors(df.withColumn("id", F.lit("x")), cell=20).collect()}
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values()) > 100
    assert semdedup.near_vectors(empty(spark, "vec_id long, embedding array<float>, label int")).count() == 0


def message(conv, turn, role, content=None, calls=None, answer=None):
    return (conv, turn, role, content, calls, answer)


CHAT = "conv_id string, turn long, role string, content string, tool_calls array<struct<id:string,name:string,arguments:string,after:array<string>>>, tool_call_id string"


def test_chat(spark):
    ok = '{"top": 3, "query": "a\\u00e9"}'
    rows = [
        message("a", 0, "user", "hi \"x\"\n"),
        message("a", 1, "assistant", None, [("c1", "search", ok, None), ("c2", "translate", '{"text":"t","target":"xx"}', ["c1"]), ("c1", "search", ok, None), (None, "search", ok, None)]),
        message("a", 2, "tool", "r1", None, "c1"), message("a", 3, "tool", "again", None, "c1"), message("a", 4, "tool", "lost", None, "c9"),
        message("b", 0, "tool", "early", None, "k"), message("b", 1, "tool", "early2", None, "m"), message("b", 2, "assistant", None, [("m", "none", "{}", None)]), message("b", 3, "assistant", None, [("k", "search", "[1]", ["m"])]),
        message("c", 0, "assistant", None, [("p", "search", "no json", ["q"])]), message("c", 1, "assistant", None, [("q", "search", '{"query":1,"more":2}', ["p"])]),
        message(None, 0, None, None), message("a", 0, "user", "hi \"x\"\n"),
    ]
    df = spark.createDataFrame(rows, CHAT).withColumn("status", F.lit("clash"))
    got = chat.link(df).collect()
    assert len(got) == 21
    at = {(r.conv_id, r.turn, r.seq): r for r in got}
    status = {k: v.status for k, v in at.items()}
    assert [status["a", 1, s] for s in (1, 2, 3, 4)] == ["linked", "unanswered", "duplicate", "no id"]
    assert [status["a", t, 0] for t in (2, 3, 4)] == ["linked", "duplicate", "orphan"] and status["c", 0, 1] == status["c", 1, 1] == "cyclic"
    assert at["a", 1, 1].json == '{"arguments":{"query":"aé","top":3},"id":"c1","name":"search","type":"function"}'
    assert at["a", 1, 2].errors == ["target: no choice"] and at["b", 2, 1].errors == ["unknown tool"] and at["b", 3, 1].errors == ["not an object"]
    assert at["c", 0, 1].errors == ["not JSON"] and at["c", 1, 1].errors == ["query: not string", "top: missing", "more: unknown"]
    place = {k: (v.order_turn, v.order_seq, v.order_hops, v.turn, v.seq) for k, v in at.items() if k[0] in ("a", "b")}
    for before, after in (((("b", 3, 1)), ("b", 0, 0)), (("b", 2, 1), ("b", 1, 0)), (("b", 1, 0), ("b", 3, 1)), (("a", 2, 0), ("a", 1, 2)), (("a", 1, 1), ("a", 2, 0))):
        assert place[before] < place[after]
    for r in got:
        value = json.loads(r.json)
        assert json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert chat.link(empty(spark, CHAT)).count() == 0


def test_bpe(spark, odd):
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    rng = random.Random(3)
    alphabet = "abcdefgh ÀÉñß中文🙂́ '!?0123456789\n\tABCΣσ<|endoftext|>"
    texts = [r.text for r in odd.collect()] + ["".join(rng.choices(alphabet, k=rng.randint(0, 80))) for _ in range(400)] + ["<|startoftext|>a<|endoftext|>b", "don't we'll I'M"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.bpe_encode(df, path).collect()}
    digests = {r.doc_id: r for r in bpe.bpe_digests(df, path).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == tok.decode(ids, skip_special_tokens=False), t
        assert digests[i].n_tokens == len(ids) and digests[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()
    assert bpe.bpe_encode(empty(spark), path).count() == 0


def test_bpe_automaton():
    """A second vocabulary, read from its file; one transition for each symbol, kept in the table; what the file asks for beyond that is an error."""
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, own = tokenizers.Tokenizer.from_file(path), bpe.Tokenizer(open(path, "rb").read())
    rng = random.Random(4)
    texts = ["".join(rng.choices("abc the ÀÉß中🙂 '!?01\n\t", k=rng.randint(0, 60))) for _ in range(300)] + ["a" * 3000]
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert own.run(t) == (struct.pack(f"<{len(ids)}I", *ids), tok.decode(ids, skip_special_tokens=False)), t

    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    states = {id(moves): Counted(moves) for moves in own.auto.known.values()}
    for moves in states.values():
        moves |= {symbol: (states[id(move[0])], move[1]) for symbol, move in moves.items() if symbol != bpe.MEMBERS}
    own.auto.begin, known = states[id(own.auto.begin)], own.auto.moves
    word = texts[-1].encode()
    own.auto.encode(word)
    assert Counted.asked == len(word) and own.auto.moves == known
    spec = json.loads(open(path).read())
    for change in ({"normalizer": {"type": "Strip"}}, {"decoder": {"type": "WordPiece"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            bpe.Tokenizer(json.dumps(spec | change).encode())


def test_vectors_share_ids(spark):
    """Different vectors with one id have their own links; the smallest id of a component is a row's id, not a class's number."""
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [0.99, 0.1, 0.0], 0), (1, [0.0, 0.0, 1.0], 0), (3, [0.0, 0.1, 0.99], 0), (1, [1.0, 0.0, 0.0], 0), (0, [0.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in semdedup.near_vectors(df).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1)]


def test_many_languages(spark):
    """More languages than bits of a byte or a word; a null label is filled with what is found; long words lose no n-gram."""
    import numpy as np

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    many = docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 40).cast("string")))
    fitted = langid.learn(many, "doc_id", "text", "lang")
    assert len(fitted.langs) > 64 and langid.identify(docs, fitted).count() == docs.count()
    known = langid.recognised(docs.withColumn("lang", F.lit(None).cast("string")), langid.learn(docs, "doc_id", "text", "lang"), "text", "lang")
    assert known.filter("lang is null").count() == 0
    text = "abcde fgh " * 70_000 + "x" * 600_000
    whole = {n: 0 for n in langid.SIZES}
    for part, rows in langid.pieces([None, text]):
        for n, hashes, row in langid.gram_hashes(part, rows):
            assert set(np.unique(row)) <= {1}
            whole[n] += len(hashes)
    words = text.split()
    assert whole == {n: sum(max(0, len(w) + 2 - n + 1) for w in words) for n in langid.SIZES}


def test_components(spark):
    rng = random.Random(11)
    links = [(i, i + 1) for i in range(0, 90)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)] + [(500, 500 + k) for k in range(1, 60)]
    df = spark.createDataFrame([*links, (7, 7), (None, 3)], "a long, b long")
    want = brute.reachable({x for p in links for x in p}, links)
    got = {r.id: r.component for r in components(df, "a", "b").collect()}
    assert all(want[i] == c for i, c in got.items()) and {i for p in links if p[0] != p[1] for i in p} == set(got)
