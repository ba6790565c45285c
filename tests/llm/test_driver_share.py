"""What the driver is spared: compiling a vocabulary, and jobs that only ask whether components are found."""

import public_tokenizers
from tokenizers import Tokenizer

from barloom.llm import bpe
from barloom.llm.components import components


def test_vocabularies_are_compiled_in_a_task(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(bpe, "library_characters", lambda: 1 / 0)
    monkeypatch.setattr(bpe, "gadgets", lambda *_: 1 / 0)
    got = bpe.bpe_encode(spark.createDataFrame([(1, "Two words, naïve Σ")], "doc_id long, text string"), path).first()
    assert got.ids == Tokenizer.from_file(path).encode("Two words, naïve Σ", add_special_tokens=False).ids


def test_components_ask_once_a_round(spark):
    spark.sparkContext.setJobGroup("components-once", "components")
    try:
        star = components(spark.createDataFrame([(1, k) for k in range(2, 9)], "a long, b long"), "a", "b")
    finally:
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("components-once")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 5, jobs
    assert {(r.id, r.component) for r in star.collect()} == {(k, 1) for k in range(1, 9)}
    two = components(spark.createDataFrame([(k, k + 1) for k in range(20) if k != 9] + [(3, 3), (None, 4)], "a long, b long"), "a", "b")
    assert {(r.id, r.component) for r in two.collect()} == {(k, 0 if k < 10 else 10) for k in range(21)}
