"""Aggregates behind the result views: heat map, document scores, relation graph, highlights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions import text as X
from quarry.operators.lexical import TIE_DECIMALS

WIDTH, HEIGHT = 480, 280
SMALL_RADIUS, RADIUS = 80.0, 96.0


def document_scores(hits: DataFrame) -> DataFrame:
    """query_id, document_id, score (best chunk, 0 at least), matched_terms (all chunks')."""
    by_doc = hits.groupBy("query_id", "document_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched_terms")))).alias("matched_terms"))
    return by_doc


def heat_map(hits: DataFrame, terms: int = 8) -> DataFrame:
    """query_id, document_id, term, value, share, bucket: contributions of the terms that weigh most in the query's hits."""
    cells = hits.select("query_id", "document_id", "chunk_id", F.explode("term_contributions").alias("term", "c"))
    value = F.aggregate(F.array_sort(F.collect_list(F.struct("chunk_id", "c"))), F.lit(0.0), lambda s, x: s + x["c"])
    cells = cells.groupBy("query_id", "document_id", "term").agg(value.alias("value"))
    weight = cells.groupBy("query_id", "term").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("document_id", "value"))), F.lit(0.0), lambda s, x: s + F.abs(x["value"])).alias("weight"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("weight", TIE_DECIMALS)), "term")
    top = weight.withColumn("term_rank", F.row_number().over(order)).filter(F.col("term_rank") <= terms).select("query_id", "term", "term_rank")
    shown = cells.join(top, ["query_id", "term"])
    share = F.coalesce(F.col("value") / F.nullif(F.max("value").over(W.partitionBy("query_id")), F.lit(0.0)), F.lit(0.0))
    return shown.withColumn("share", share).withColumn("bucket", X.heat_bucket(F.col("share")))


def graph_nodes(documents: DataFrame) -> DataFrame:
    """documents (query_id, document_id, score, ...) on a circle from the top; queries with one document have no graph."""
    per = W.partitionBy("query_id")
    rows = documents.withColumn("n", F.count("*").over(per)).filter("n >= 2")
    rows = rows.withColumn("place", F.row_number().over(per.orderBy(F.desc(F.round("score", TIE_DECIMALS)), "document_id")) - 1)
    angle = -math.pi / 2 + 2 * math.pi * F.col("place") / F.col("n")
    radius = F.when(F.col("n") <= 2, SMALL_RADIUS).otherwise(RADIUS)
    return rows.withColumn("x", WIDTH / 2 + radius * F.cos(angle)).withColumn("y", HEIGHT / 2 + radius * F.sin(angle))


def graph_edges(documents: DataFrame, kind: str = "lexical") -> DataFrame:
    """query_id, a, b, weight between a query's documents: matched terms in common, or nearness of best scores.

    Documents are a query's few hits, joined within their query; a is the smaller id.
    """
    a, b = documents.alias("a"), documents.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.document_id") < F.col("b.document_id")))
    shared = F.size(F.array_intersect("a.matched_terms", "b.matched_terms")).cast("double") if kind == "lexical" else 1 / (1 + F.abs(F.col("a.score") - F.col("b.score")))
    return pairs.select("a.query_id", F.col("a.document_id").alias("a"), F.col("b.document_id").alias("b"), shared.alias("weight")).filter("weight > 0")


def contribution_chart(hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, term, contribution, place, width: a hit's terms, the largest first."""
    rows = hits.select("query_id", "chunk_id", F.explode("term_contributions").alias("term", "contribution"))
    per = W.partitionBy("query_id", "chunk_id")
    order = per.orderBy(F.desc(F.round("contribution", TIE_DECIMALS)), "term")
    rows = rows.withColumn("place", F.row_number().over(order))
    return rows.withColumn("width", X.bar_width(F.col("contribution"), F.max(F.abs("contribution")).over(per)))


def graded_terms(hits: DataFrame) -> DataFrame:
    """query_id, chunk_id, term, intensity, bucket within each hit."""
    rows = hits.select("query_id", "chunk_id", F.explode("term_contributions").alias("term", "c"))
    most = F.max(F.abs("c")).over(W.partitionBy("query_id", "chunk_id"))
    rows = rows.withColumn("intensity", F.coalesce(F.abs("c") / F.nullif(most, F.lit(0.0)), F.lit(0.0)))
    return rows.select("query_id", "chunk_id", "term", "intensity", X.heat_bucket(F.col("intensity")).alias("bucket"))
