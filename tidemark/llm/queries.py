"""Queries opN_* that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import functions as F

from tidemark.llm import langid, ngram_lm, oracles
from tidemark.llm.bpe import encode_decode
from tidemark.llm.conversation_repair import damaged, repair_conversations
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.fingerprints import edited_fingerprints
from tidemark.llm.jaccard_join import jaccard_classes
from tidemark.llm.license_scan import license_scan
from tidemark.llm.packing import pack
from tidemark.llm.periodic_runs import periodic_runs, run_report, with_planted_period
from tidemark.llm.secret_scan import secret_scan
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.llm.topk import exact_topk
from tidemark.session import read_table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the files of the public tokenizers lie; they are no part of this repository."""
    return import_module("public_tokenizers").path(name)


def id_bucket(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_language_model(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_bucket("doc_id", 7) == 2, F.lit(False))
    return ngram_lm.score(documents, ngram_lm.train(documents.where(~held_out)), held_out)


def op3_bpe(spark, sf_dir):
    return encode_decode(read_table(spark, sf_dir, "documents"), vocabulary_path(), digests=True)


def op4_jaccard_join(spark, sf_dir):
    return jaccard_classes(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op5_license_scan(spark, sf_dir):
    """``documents`` has no paths: a document's file is its id, in the directory of its source."""
    documents = read_table(spark, sf_dir, "documents")
    return license_scan(documents.select("doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")))


def op6_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op7_secret_scan(spark, sf_dir):
    return secret_scan(read_table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 5) == 0
    model = langid.train(documents.where(~held_out).select("doc_id", "text", "lang"), vocabulary_path())
    return langid.identify(documents, model, held_out)


def op9_substring_dedup(spark, sf_dir):
    return remove_repeats(read_table(spark, sf_dir, "documents"), digests=True)


def op10_exact_topk(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op11_fingerprints(spark, sf_dir):
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    documents = read_table(spark, sf_dir, "documents")
    return run_report(periodic_runs(documents, with_planted_period(F.col("text"), F.col("doc_id"))))


def op13_conversation_repair(spark, sf_dir):
    rows = damaged(read_table(spark, sf_dir, "conversations"))
    return repair_conversations(rows, present_col="present", digests=True).withColumnRenamed("repaired", "repaired_sha256")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_language_model": op2_language_model,
    "op3_bpe": op3_bpe,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_packing": op6_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_language": op8_language,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_topk": op10_exact_topk,
    "op11_fingerprints": op11_fingerprints,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE = {
    "op1_exact_dedup": oracles.EXACT_DEDUP,
    "op4_jaccard_join": oracles.JACCARD_JOIN,
    "op7_secret_scan": oracles.SECRET_SCAN,
    "op9_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op10_exact_topk": oracles.EXACT_TOPK,
    "op11_fingerprints": oracles.FINGERPRINTS,
    "op12_periodic_runs": oracles.PERIODIC_RUNS,
    "op13_conversation_repair": oracles.CONVERSATION_REPAIR,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
