"""Rocchio pseudo-relevance feedback: a first pass finds documents, their mean vector widens the query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.config import ALPHA, B, BETA, EXPANSION_TERMS, FEEDBACK_DOCS, K1, check_choice, check_prf
from quarry.operators.index import Index, in_order, tf_weight, tfidf_idf
from quarry.operators.lexical import TIE_DECIMALS, by_chunk, figures, search_bm25, search_tfidf, search_weighted_bm25, search_weighted_tfidf, tfidf_weights
from quarry.sources.work import written


def centroids(feedback: DataFrame, index: Index) -> DataFrame:
    """query_id, term, mean: the mean TF-IDF vector of each query's feedback chunks (query_id, chunk_id)."""
    counted = feedback.groupBy("query_id").agg(F.count("*").alias("n_feedback"))
    chosen = feedback.join(counted, "query_id").select("query_id", "chunk_id", "n_feedback")
    vectors = by_chunk(index, chosen).join(F.broadcast(figures(index).select("n_chunks")))
    vectors = vectors.withColumn("w", tf_weight(F.col("tf")) * tfidf_idf(F.col("df"), F.col("n_chunks")))
    return vectors.groupBy("query_id", "term").agg((in_order("w", "chunk_id") / F.first("n_feedback")).alias("mean"))


def expanded(weights: DataFrame, feedback: DataFrame, index: Index, expansion_terms: int, alpha: float, beta: float) -> DataFrame:
    """query_id, term, w, added: alpha query + beta centroid over the query's terms and the best new ones.

    Queries without feedback have no rows. New terms need a positive weight; ties go to the
    smaller term.
    """
    both = weights.join(centroids(feedback, index), ["query_id", "term"], "full_outer")
    both = both.join(feedback.select("query_id").distinct(), "query_id", "left_semi")
    both = both.select("query_id", "term", (F.lit(float(alpha)) * F.coalesce("w", F.lit(0.0)) + F.lit(float(beta)) * F.coalesce("mean", F.lit(0.0))).alias("w"), F.col("w").isNull().alias("added"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("w", TIE_DECIMALS)), "term")
    fresh = both.filter("added and w > 0").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= expansion_terms).drop("n")
    return both.filter("not added").unionByName(fresh)


@dataclass(frozen=True)
class Widened:
    hits: DataFrame
    terms: DataFrame  # query_id, term, w, added
    feedback: DataFrame  # query_id, rank, chunk_id


def search_with_feedback(
    queries: DataFrame, index: Index, top_k: int = 10, feedback_docs: int = FEEDBACK_DOCS, expansion_terms: int = EXPANSION_TERMS, alpha: float = ALPHA, beta: float = BETA,
    scoring: str = "tfidf", mode: str = "champion", fallback: bool = True, k1: float = K1, b: float = B,
) -> Widened:
    """Both passes in the same mode; in BM25 the widened TF-IDF weights stand where term counts do.

    A first pass without hits gives no hits and no added terms. With beta 0 the TF-IDF
    result is that of a plain search.
    """
    check_choice("scoring", scoring, ("tfidf", "bm25"))
    check_prf(feedback_docs, expansion_terms, alpha, beta)
    first = search_tfidf(queries, index, feedback_docs, mode, fallback) if scoring == "tfidf" else search_bm25(queries, index, feedback_docs, mode, fallback, k1, b, alone=False)
    feedback = written(first.select("query_id", "rank", "chunk_id"), "feedback")
    terms = written(expanded(written(tfidf_weights(queries, index), "weights"), feedback, index, expansion_terms, alpha, beta), "widened")
    weights = terms.select("query_id", "term", "w")
    hits = search_weighted_tfidf(weights, index, top_k, mode, fallback) if scoring == "tfidf" else search_weighted_bm25(weights, index, top_k, mode, fallback, k1, b)
    return Widened(hits, terms.withColumn("added", F.col("added") & F.lit(beta > 0)), feedback)
