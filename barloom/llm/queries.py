"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from . import bpe, chat, langid, licenses, minhash, mixing, ranked, rules, semdedup, suffix, tokencount, veccodes, warc

#: Vocabulary file of the BPE query; a parameter of the operator, never copied here.
VOCABULARY = "word_bpe_49k.json"
#: Model of the token counts.
PIECES = "piece_bpe_32k.model"


def table(spark, sf_dir, name, *columns):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_warc_derivatives(spark, sf_dir):
    return warc.derivatives(warc.page_responses(table(spark, sf_dir, "pages", "page_id", "url", "html")), carry=("page_id",))


def op2_license_sentences(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), size=4, percent=80)


def op4_suffix_array_dedup(spark, sf_dir):
    return suffix.removal(table(spark, sf_dir, "documents", "doc_id", "text"), digests=True)


def op5_language_id(spark, sf_dir):
    return langid.language_id(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op6_quality_rules(spark, sf_dir):
    found = rules.ledger(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rules.verdicts(found, rules.POLICIES[rules.CURRENT]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures"
    )


def quality_versions(spark, sf_dir):
    """What each policy drops, from the ledger of op6."""
    return rules.versions(rules.ledger(table(spark, sf_dir, "documents", "doc_id", "text")))


def quality_ablations(spark, sf_dir):
    """What each rule of each policy catches, and what only it catches."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents", "doc_id", "text")))


def op7_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op8_embedding_near_dedup(spark, sf_dir):
    return semdedup.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op9_tool_call_linking(spark, sf_dir):
    found = chat.link(chat.as_tool_chat(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
    return found.withColumn("errors", F.array_join("errors", "; "))


def op10_bpe_automaton(spark, sf_dir):
    return bpe.bpe_digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(VOCABULARY))


def op11_vector_codes(spark, sf_dir):
    return veccodes.vector_codes(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_token_counts(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(PIECES), limit=4096)


def op13_ranked_search(spark, sf_dir):
    return ranked.ranked_search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_license_sentences": op2_license_sentences,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_source_mixing": op7_source_mixing,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_tool_call_linking": op9_tool_call_linking,
    "op10_bpe_automaton": op10_bpe_automaton,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_counts": op12_token_counts,
    "op13_ranked_search": op13_ranked_search,
    "quality_versions": quality_versions,
    "quality_ablations": quality_ablations,
}

ORACLES: dict[str, str] = {
    "op1_warc_derivatives": warc.ORACLE,
    "op2_license_sentences": licenses.ORACLE,
    "op6_quality_rules": rules.ORACLE,
    "op9_tool_call_linking": chat.ORACLE,
    "op11_vector_codes": veccodes.ORACLE,
    "op13_ranked_search": ranked.ORACLE,
    "quality_versions": rules.VERSIONS_ORACLE,
    "quality_ablations": rules.ABLATIONS_ORACLE,
}
