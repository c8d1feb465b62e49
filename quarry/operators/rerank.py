"""Re-ranking by a pair scorer behind a port."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.config import RERANK_DEPTH, require
from quarry.functions.text import tokens
from quarry.operators.lexical import TIE_DECIMALS
from quarry.sources.work import python_ready


class PairScorer(Protocol):
    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def rerank(hits: DataFrame, queries: DataFrame, make: Callable[[], PairScorer] | None, top_n: int = 10, depth: int = RERANK_DEPTH) -> DataFrame:
    """hits (query_id, rank, chunk_id, text, ...) in the scorer's order, with rerank_score; depth candidates are scored.

    A scorer that cannot be loaded, or none at all, leaves the order and null scores. It is
    loaded once per worker, and a failure is remembered.
    """
    require(top_n > 0, "top_n must be positive")
    pool = hits.filter(F.col("rank") <= depth)
    if make is None:
        return pool.withColumn("rerank_score", F.lit(None).cast("double")).filter(F.col("rank") <= top_n)
    python_ready(hits.sparkSession)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        try:
            model = make()
        except Exception:  # a model that is not there is no error of the query's
            model = None
        for question, text in batches:
            pairs = list(zip(question.fillna(""), text.fillna(""), strict=True))
            yield pd.Series(model.predict(pairs) if model else [None] * len(pairs), dtype="float64")

    scored = pool.join(F.broadcast(queries.select("query_id", F.col("text").alias("question"))) if queries.limit(10_001).count() <= 10_000 else queries.select("query_id", F.col("text").alias("question")), "query_id")
    scored = scored.withColumn("rerank_score", run("question", "text")).drop("question")
    none = F.max("rerank_score").over(W.partitionBy("query_id")).isNull()
    order = W.partitionBy("query_id").orderBy("order_key", "tie_key")
    keyed = scored.withColumn("no_score", none).withColumn("order_key", F.when(F.col("no_score"), F.col("rank").cast("double")).otherwise(-F.round(F.coalesce("rerank_score", F.lit(0.0)), TIE_DECIMALS))).withColumn("tie_key", F.when(F.col("no_score"), F.lit("")).otherwise(F.col("chunk_id")))
    return keyed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n).drop("no_score", "order_key", "tie_key")


def overlap_scores(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """hits with rerank_score by a JVM-side stand-in: the share of distinct query tokens that the text has."""
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("asked"))
    joined = hits.join(asked, "query_id")
    share = F.size(F.array_intersect("asked", tokens(F.col("text")))) / F.greatest(F.size("asked"), F.lit(1))
    return joined.withColumn("rerank_score", share).drop("asked")


def rerank_by_overlap(hits: DataFrame, queries: DataFrame, top_n: int = 10, depth: int = RERANK_DEPTH) -> DataFrame:
    require(top_n > 0, "top_n must be positive")
    scored = overlap_scores(hits.filter(F.col("rank") <= depth), queries)
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("rerank_score", TIE_DECIMALS)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)
