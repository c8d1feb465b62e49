"""Hybrid retrieval: reciprocal rank fusion, lexical coverage, the relevance gate, pinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.config import ARM_DEPTH, COVERAGE_FLOOR, DENSE_FLOOR, IDF_COVERAGE_FLOOR, RRF_K, require
from quarry.functions import text as X
from quarry.operators.index import Index, bm25_idf, in_order
from quarry.operators.lexical import TIE_DECIMALS, as_indexed, figures, ranked, with_df


def first_ranks(hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, rank: first appearance counts."""
    return hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))


def reciprocal_ranks(dense: DataFrame, lexical: DataFrame, k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, fusion_score, dense_rank, bm25_rank: an arm that lacks a chunk adds nothing."""
    require(k > 0, "k must be positive")
    d, b = first_ranks(dense).withColumnRenamed("rank", "dense_rank"), first_ranks(lexical).withColumnRenamed("rank", "bm25_rank")
    part = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    return d.join(b, ["query_id", "chunk_id"], "full_outer").withColumn("fusion_score", part("dense_rank") + part("bm25_rank"))


def fused(dense: DataFrame, lexical: DataFrame, top_k: int = ARM_DEPTH, k: int = RRF_K) -> DataFrame:
    """The top_k by fusion score, ties to the smaller id; each arm's score is null where the arm lacks the chunk."""
    require(top_k >= 0, "top_k must not be negative")
    best = ranked(reciprocal_ranks(dense, lexical, k), top_k, "fusion_score")
    d = dense.select("query_id", "chunk_id", F.col("score").alias("dense_score"))
    b = lexical.select("query_id", "chunk_id", F.col("score").alias("bm25_score"))
    joined = best.join(d, ["query_id", "chunk_id"], "left").join(b, ["query_id", "chunk_id"], "left")
    return joined.withColumn("retrieval_sources", F.array_compact(F.array(F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("bm25_rank").isNotNull(), "bm25"))))


def dense_only(dense: DataFrame) -> DataFrame:
    """The same shape where there is no lexical index: fusion and BM25 are null."""
    nothing = lambda t: F.lit(None).cast(t)
    return dense.select("query_id", "chunk_id", F.col("rank").alias("dense_rank"), nothing("int").alias("bm25_rank"), nothing("double").alias("fusion_score"), "rank", F.col("score").alias("dense_score"), nothing("double").alias("bm25_score"), F.array(F.lit("dense")).alias("retrieval_sources"))


def to_hydrate(fused_hits: DataFrame, dense: DataFrame) -> DataFrame:
    """Chunks that only the lexical arm found."""
    return fused_hits.select("query_id", "chunk_id").join(dense.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def evidence_terms(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, term, idf of distinct query terms of any length; terms outside the index have df 0, and so the largest idf."""
    terms = as_indexed(queries.select("query_id", F.explode(F.array_distinct(X.terms(F.col("text"), 1))).alias("term")), index).distinct()
    rows = with_df(index, terms, "left").join(F.broadcast(figures(index).select("n_chunks")))
    return rows.select("query_id", "term", bm25_idf(F.coalesce(F.col("df"), F.lit(0)), F.col("n_chunks")).alias("idf"))


def coverage(queries: DataFrame, pool: DataFrame, index: Index) -> DataFrame:
    """query_id, chunk_id, coverage, idf_coverage, all_terms for pool rows (query_id, chunk_id, searchable).

    Shares of the query's terms that the chunk has, by count and by idf. Terms outside the
    index stay in the denominator. Null where a query has no terms or no idf at all.
    """
    wanted = evidence_terms(queries, index)
    totals = wanted.groupBy("query_id").agg(F.count("*").alias("n_terms"), in_order("idf", "term").alias("idf_sum"))
    has = as_indexed(pool.select("query_id", "chunk_id", F.explode(F.array_distinct(X.terms(F.col("searchable"), 1))).alias("term")), index).distinct()
    met = has.join(wanted, ["query_id", "term"]).groupBy("query_id", "chunk_id").agg(F.count("*").alias("n_met"), in_order("idf", "term").alias("idf_met"))
    rows = pool.select("query_id", "chunk_id").join(totals, "query_id", "left").join(met, ["query_id", "chunk_id"], "left")
    usable = F.col("idf_sum") > 0
    return rows.select(
        "query_id", "chunk_id",
        F.when(usable, F.coalesce("n_met", F.lit(0)) / F.col("n_terms")).alias("coverage"),
        F.when(usable, F.coalesce("idf_met", F.lit(0.0)) / F.col("idf_sum")).alias("idf_coverage"),
        (F.coalesce("n_terms", F.lit(0)) > 0).__and__(F.coalesce("n_met", F.lit(0)) == F.col("n_terms")).alias("all_terms"),
    )


def relative_bm25(score: Column, by: str = "query_id") -> Column:
    """A score over the best of its query; null where there is none or the best is 0."""
    return score / F.nullif(F.max(score).over(W.partitionBy(by)), F.lit(0.0))


def is_strong(coverage_min: float = COVERAGE_FLOOR, idf_coverage_min: float = IDF_COVERAGE_FLOOR) -> Column:
    """Lexically strong: BM25 found it and it covers enough of the query, limits included."""
    return F.coalesce(F.col("bm25_score").isNotNull() & (F.col("coverage") >= coverage_min) & (F.col("idf_coverage") >= idf_coverage_min), F.lit(False))


def with_evidence(pool: DataFrame, queries: DataFrame, index: Index, coverage_min: float = COVERAGE_FLOOR, idf_coverage_min: float = IDF_COVERAGE_FLOOR) -> DataFrame:
    """pool with coverage, idf_coverage, all_terms, relative_bm25, strong."""
    rows = pool.join(coverage(queries, pool, index), ["query_id", "chunk_id"])
    return rows.withColumn("relative_bm25", relative_bm25(F.col("bm25_score"))).withColumn("strong", is_strong(coverage_min, idf_coverage_min))


def pin_candidates(evidence: DataFrame) -> DataFrame:
    """The best strong chunk of each query: by idf coverage, relative BM25, fusion, then id; what is undefined comes last."""
    order = W.partitionBy("query_id").orderBy(F.desc_nulls_last(F.round("idf_coverage", TIE_DECIMALS)), F.desc_nulls_last(F.round("relative_bm25", TIE_DECIMALS)), F.desc_nulls_last(F.round("fusion_score", TIE_DECIMALS)), "chunk_id")
    return evidence.filter("strong").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def select_context(evidence: DataFrame, top_n: int) -> DataFrame:
    """The first top_n of each query; if none is strong but the pool has a strong one, that replaces the last of them.

    Replacement goes from the end and skips strong chunks, so at least one strong chunk is
    in whenever there is one.
    """
    chosen = evidence.filter(F.col("rank") <= top_n)
    weak = chosen.groupBy("query_id").agg(F.max(F.col("strong").cast("int")).alias("any_strong"), F.max("rank").alias("last")).filter("any_strong = 0").select("query_id", "last")
    pins = pin_candidates(evidence).join(weak, "query_id").withColumn("rank", F.col("last")).drop("last")
    kept = chosen.join(pins.select("query_id", "rank"), ["query_id", "rank"], "left_anti")
    return kept.unionByName(pins.select(kept.columns))


def gate(selected: DataFrame, queries: DataFrame, dense_floor: float = DENSE_FLOOR) -> DataFrame:
    """query_id, passes, reason: a dense score at the floor, a strong chunk, or one chunk with all terms lets a query pass."""
    good = (F.coalesce(F.col("dense_score") >= dense_floor, F.lit(False))) | F.col("strong") | F.col("all_terms")
    seen = selected.groupBy("query_id").agg(F.max(good.cast("int")).alias("good"))
    rows = queries.select("query_id").join(seen, "query_id", "left")
    reason = F.when(F.col("good").isNull(), "no_context").when(F.col("good") == 0, "low_relevance")
    return rows.select("query_id", reason.isNull().alias("passes"), reason.alias("reason"))
