"""A training corpus in five stages, each an operator of barloom.llm applied to all that the stage before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, langid, minhash, mixing, suffix
from barloom.llm.scratch import staged

VOCABULARY = "word_bpe_49k.json"


def _held(docs: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but `own` renamed to names no operator uses, and the way back."""
    back = {f"_held{k}": c for k, c in enumerate(c for c in docs.columns if c not in own)}
    return docs.select(*own, *[F.col(c).alias(h) for h, c in back.items()]), back


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language: no text, no letter in it, or hardly an n-gram of any language.

    The filters are learned from labelled documents of docs; without labels only the letters count. Documents in a
    language keep their rows, and where lang is null the language found is written there.
    """
    fitted = langid.learn(docs, "doc_id", "text", "lang")
    return langid.recognised(docs, fitted, "text", "lang")


def _once(docs: DataFrame) -> DataFrame:
    """docs with one row of those that agree in id and text, whether the id is null or not; which of them stays is open."""
    key = F.xxhash64("text", F.length("text"))
    twice = docs.groupBy("doc_id", key.alias("_twice")).agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_id"), "_twice")
    twice = staged(twice, "repeated-rows")
    if twice.isEmpty():
        return docs
    met = docs["doc_id"].eqNullSafe(twice["_id"]) & (key == twice["_twice"])
    rest, some = docs.join(twice, met, "left_anti"), docs.join(twice, met, "left_semi")
    return rest.unionByName(some.dropDuplicates(["doc_id", "text"]))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8 or more): the smallest doc_id.

    Of rows with the same id and text, and of equal texts without an id, one stays, so that no copy is left for the next stage to cut to nothing. Other
    documents without an id stay. Rows that share an id are one document and stay or go together.
    """
    docs = _once(docs)
    found = minhash.near_duplicates(docs, "doc_id", "text", size=5, percent=80)
    gone = found.filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every passage of 200 bytes or more that also stands elsewhere; n_chars follows."""
    held, back = _held(docs, "doc_id", "text")
    found = suffix.removal(held, "doc_id", "text", carry=tuple(back)).select("doc_id", F.col("kept_text").alias("text"), *back)
    found = found.withColumnsRenamed(back)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights: rows as often as they are taken, cut to the words taken."""
    held, back = _held(docs, "doc_id", "source")
    words = next(h for h, c in back.items() if c == "text")
    mixed = mixing.mix(held, "doc_id", words, "source", carry=tuple(back))
    taken = mixing.taken_texts(mixed, words).select("doc_id", "source", *back).withColumnsRenamed(back)
    return taken.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row."""
    out = bpe.bpe_encode(docs, public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language ID", language_stage),
    ("near-duplicates", near_dedup_stage),
    ("repeated passages", repeats_stage),
    ("source mixing", mixing_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs


#: Merged transforms, MinHash and the tokenizer are not SQL; tests/llm compares the stages with plain models.
ORACLE_SQL = None
