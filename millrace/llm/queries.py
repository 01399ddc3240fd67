"""Queries over the numbered operators, with production parameters and whole tables."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, chunks, collocations, exact, html, merkle, minhash, neighbours, secrets, sql, surrogates, tokenstore, toxicity, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For the synthetic tables only: real texts need a secret, in the session's setting.
TABLES_KEY = "synthetic tables"


def pii_key(spark: SparkSession) -> str:
    """The key of surrogates: spark.millrace.pii.key, or that of the synthetic tables."""
    return spark.conf.get("spark.millrace.pii.key", TABLES_KEY)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of web pages by tree scoring."""
    return html.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-ID output into a content-addressed store, read back from its files."""
    path = tokenstore.write_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)
    return tokenstore.read_back(spark, path)


def op3_projection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate nearest neighbours of every 50th vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"), 5).select(F.col("query_id"), "rank", "vec_id", "score")


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return surrogates.replace_pii(_table(spark, sf_dir, "documents"), pii_key(spark))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE by a local rank file, and raw-byte decoding."""
    coded = bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier documents have."""
    return chunks.dedup_substrings(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity by a weighted lexicon and Aho-Corasick."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination by winnowing."""
    return winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MinHash near-dedup; the contract takes four-word shingles."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by fixed patterns and by window entropy."""
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup by a heavy-hitter split."""
    return exact.find_copies(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest by superblocks; the contract tampers with some texts before they are verified."""
    tampered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    given = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, tampered).otherwise(F.col("text"))
    return merkle.build(_table(spark, sf_dir, "documents"), {"text": given}).audit()


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase collocations by generalised suffix automata."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_html_extraction, op2_token_store, op3_projection_search, op4_pii_surrogates, op5_byte_bpe, op6_chunk_dedup, op7_toxicity, op8_winnowing, op9_minhash, op10_secret_scan, op11_exact_dedup, op12_merkle_manifest, op13_collocations)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op11_exact_dedup": sql.COPIES, "op12_merkle_manifest": sql.MANIFEST, "op13_collocations": sql.COLLOCATIONS}
