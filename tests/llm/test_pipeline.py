"""The stages against plain models, each on its own input, and their defined results for odd rows."""

import brute
import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from barloom.llm.scratch import staged

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "123 456", "en", "src0", 7), (None, "the and of that " * 30, "en", None, 1)], docs.schema)
    docs = docs.unionByName(odd)
    columns, before = docs.columns, docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        after = staged(stage(spark, before, SF), "test")
        was = [r for r in before.collect()]
        now = [r for r in after.collect()]
        if k < 4:
            assert after.columns == columns, name
        if k == 0:
            gone = {r.doc_id for r in was} - {r.doc_id for r in now}
            assert gone == {r.doc_id for r in was if not any(c.isalpha() for c in r.text or "")} and {9001, 9002, 9003} <= gone
        if k == 1:
            found = brute.near([(r.doc_id, r.text) for r in was if r.doc_id is not None], 5, 80)
            assert {r.doc_id for r in now} == {i for i, v in found.items() if v[1] == i} | {None}
        if k == 2:
            want = dict(zip([r.doc_id for r in was], brute.removed([r.text for r in was], 200)))
            assert all(len(r.text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1] and r.n_chars == len(r.text) for r in now) and len(now) == len(was)
            assert all(r.text == w.text for r in now for w in was if r.doc_id == w.doc_id and not want[r.doc_id][1])
        if k == 3:
            size = {r.doc_id: len(brute.WORD.findall(r.text)) for r in was}
            taken = {}
            for r in now:
                taken[r.doc_id] = taken.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
            assert all(n <= 2 * size[i] for i, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
        before = after
    assert before.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert before.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_language_evidence(spark):
    """Texts of unknown n-grams go, all others with a letter stay; without labels, or with hardly any, those with letters stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, "γλώσσα που κανένα έγγραφο δεν γνωρίζει", None, "s", 9), (9002, "xqzj vkxq zzxj qkvz jxqz kqxv", None, "s", 9), (9003, "12 34", None, "s", 5), (9004, "the and that", None, "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    stage = lambda d: {r.doc_id for r in pipeline.language_stage(spark, d, SF).collect()}
    letters = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert stage(docs) == letters - {9001, 9002}
    assert stage(docs.withColumn("lang", F.lit(None).cast("string"))) == letters
    assert stage(docs.withColumn("lang", F.when(F.col("doc_id") == 9004, "en"))) == letters
