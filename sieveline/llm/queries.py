"""Registered queries of this subpackage and, where SQL can express one, its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.runtime import scratch_path
from sieveline.llm import conversations, language, lattice, mixing, packing, pitman_yor, simhash, substring_dedup, token_files, token_store, topk, toxicity, whitening

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, u.pos - 1 AS i, u.word FROM (
    SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents) d,
  LATERAL (SELECT unnest(d.ws) AS word, generate_subscripts(d.ws, 1) AS pos) u),
win AS (
  SELECT doc_id, i, CASE WHEN count(*) OVER r = 35 THEN md5(string_agg(word, ' ') OVER r) END AS h
  FROM w WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
rep AS (
  SELECT doc_id, i, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS twice FROM win),
cov AS (
  SELECT doc_id, i, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM rep),
agg AS (
  SELECT w.doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (NOT gone), '') AS kept
  FROM w JOIN cov ON w.doc_id = cov.doc_id AND w.i = cov.i GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN agg a ON d.doc_id = a.doc_id
"""


@_query("op1_substring_dedup", _OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs, window=35)
    return out.select("doc_id", "n_words", "n_removed", substring_dedup.kept_hash().alias("kept_sha256"))


@_query("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, bits=4)


@_query("op2_mix_sources")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, weights=(5, 2, 1), cap=3).select("doc_id", "size", "source_size", "target", "taken")


@_query("op5_best_fit_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.token_pieces(docs, capacity=2048), ["doc_id", "piece", "ids_crc32"], capacity=2048)


_OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


@_query("op3_exact_top_k", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.exact_top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256.0)


@_query("op8_embedding_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), cosine=0.98)


@_query("op7_toxic_segments")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = language.held_out("doc_id", 5, 0)
    out = toxicity.score_toxicity(docs, labels.filter(~held))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


@_query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language.held_out("doc_id", 4, 2)
    out = language.identify(docs, learn=~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@_query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_files.corpus_tokens(docs, scratch_path(spark, "tokens"))
    return out.select("doc_id", "number", "start", "n_tokens")


@_query("op6_pitman_yor_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = language.held_out("doc_id", 7, 2)
    out = pitman_yor.score_texts(docs, learn=~held)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, _ = conversations.repair(conversations.damage(given, every=20))
    every = given.select(F.col("conv_id").alias("of")).distinct()
    out = every.join(report, F.col("of").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("of").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@_query("op12_embedding_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4, scale=256.0)


@_query("op13_token_store")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "token-store")
    token_store.write_token_store(docs, path)
    return token_store.read_token_store(spark, path)
