"""Token counts and ranked search against the library and a plain model, with their defined cases."""

import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barloom.llm import ranked, tokencount

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CLASHING = ("id", "n", "terms", "tfs", "q", "score", "rank", "term", "row", "item", "n_bytes", "n_tokens")
DOCS = "doc_id long, text string, lang string"


def odd_texts(n: int) -> list[str]:
    rng = random.Random(5)
    alphabet = "ab \n\t▁éñ中文😀<s></s>01'x́\x00"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 200))) for _ in range(n)] + ["a" * 3000, " " * 999, "\n" * 500, "▁" * 777, "<s>" * 300, "<0x41>" * 9]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé7") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60))), "en") for i in range(300)]
    rows += [(1000 + i, rows[7][1], "en") for i in range(40)]  # copies: ties at the last place
    rows += [(5, rows[5][1], "x"), (5, "other " + words[0], None), (None, words[1] + " " + words[2], "en"), (None, rows[7][1], "en"), (2000, None, "en"), (2001, "", "en"), (2002, " .,-\n", "en")]
    rows += [(2003, " ".join(rng.choices(words, k=30_000)), "en"), (2004, words[0].upper() + "_" + words[1], None)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in CLASHING})


@pytest.mark.parametrize("stretch, batch", [(5, 50), (64, 1000), (1 << 15, 1 << 18)])
def test_lengths_equal_the_library(stretch, batch):
    import sentencepiece

    model = tokencount.PieceModel(open(MODEL, "rb").read())
    assert model.cuts
    texts = odd_texts(800)
    want = [len(i) for i in sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts, num_threads=1)]
    assert list(tokencount.batch_lengths(model, texts, stretch, batch)) == want
    assert max(map(len, model.stretches("word " * 5000, stretch))) <= stretch + 8


def test_token_counts(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted(map(tuple, tokencount.token_counts(docs, MODEL, limit=50).collect()), key=str)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert got == sorted(((i, len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 50) for i, t in rows), key=str)
    assert tokencount.token_counts(docs.limit(0), MODEL).collect() == []
    with pytest.raises(ValueError):
        tokencount.token_counts(docs, "vocabulary.txt")


def test_token_counts_of_a_json_file(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    want = sorted((len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()))
    assert sorted(r.n_tokens for r in tokencount.token_counts(docs, path).collect()) == want


def plain_search(docs, queries, k):
    """Every score of every document, in Python's whole numbers."""
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(i, Counter(w)) for i, w in ((i, term(t)) for i, t in docs) if w]
    n_docs, words = len(counted), sum(sum(c.values()) for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in term(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_ranked_search(spark, docs, monkeypatch):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(8)
    queries = [(i, " ".join((rng.choice(texts)[1] or "").split()[:12])) for i in range(25)]
    queries += [(30, None), (31, ""), (32, "!?"), (33, "nowhere at all"), (3, "other"), (None, texts[7][1]), (34, texts[7][1] * 3)]
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})
    want = plain_search(texts, queries, 20)
    assert sorted(map(tuple, ranked.ranked_search(docs.repartition(5), asked).collect()), key=str) == want
    monkeypatch.setattr(ranked, "BLOCK_PAIRS", 50)  # tiny blocks of documents and of queries
    monkeypatch.setattr(ranked, "BLOCK_QUERIES", 9)
    monkeypatch.setattr(ranked, "STRETCH", 100)
    assert sorted(map(tuple, ranked.ranked_search(docs, asked).collect()), key=str) == want
    for d, q in ((docs.limit(0), asked), (docs, asked.limit(0))):
        assert ranked.ranked_search(d, q).collect() == []


def test_bounds_hold():
    """A byte impact is never below the impact, and one less never above."""
    import numpy as np

    rng = np.random.default_rng(2)
    tf, m = rng.integers(1, 10**6, 10**5), rng.integers(75, 10**9, 10**5)
    tf[:1000], m[:1000] = 10**9, 75
    exact = ranked.impact(tf, m)
    byte = -(-exact // ranked.STEP)
    assert byte.max() <= 255 and (byte * ranked.STEP >= exact).all() and (np.maximum(byte - 1, 0) * ranked.STEP <= exact).all()
