"""Exact nearest neighbours by cosine distance, and the vector table's upkeep."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.config import check_top_k, require
from quarry.functions.vectors import clamped_score, cosine_distance
from quarry.operators.lexical import TIE_DECIMALS
from quarry.sources.work import python_ready

#: Queries answered in one pass over the vectors; more take more passes.
QUERY_BLOCK = 4096


def nearest(vectors: DataFrame, queries: DataFrame, top_k: int = 10, key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, <key>, distance, score: the top_k nearest of each query (query_id, embedding).

    Vectors stream past a block of queries as matrices, and a task passes on only its own
    best, so what is shuffled depends on queries and tasks, not on the vectors. Order is by
    distance, ties to the smaller key; the score 1 - distance is held to 0..1. Zero vectors
    are at distance 1 from everything.
    """
    check_top_k(top_k)
    spark = vectors.sparkSession
    python_ready(spark)
    kind = dict(vectors.dtypes)[key]
    found = None
    rows = queries.select("query_id", F.col(embedding).cast("array<double>").alias("v")).filter("v is not null")
    n = rows.count()
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // QUERY_BLOCK)))))
    for block in range(max(1, -(-n // QUERY_BLOCK))):
        own = numbered.filter(F.col("block") == block).select("query_id", "v").collect()  # a block of queries, not of vectors
        if own:
            part = _one_pass(vectors, [r["query_id"] for r in own], np.array([r["v"] for r in own], float), top_k, key, kind, embedding)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.limit(0).select(F.lit(None).cast("string").alias("query_id"), key, F.lit(0.0).alias("distance"))
    found = found.withColumn("query_id", F.col("query_id").cast(dict(queries.dtypes)["query_id"]))
    order = W.partitionBy("query_id").orderBy(F.round("distance", TIE_DECIMALS), key)
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return best.select("query_id", "rank", key, "distance", clamped_score(F.col("distance")).alias("score"))


def _one_pass(vectors: DataFrame, ids: list, block: np.ndarray, top_k: int, key: str, kind: str, embedding: str) -> DataFrame:
    sizes = np.sqrt((block * block).sum(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            flat = batch.column(1)
            keep = [i for i, v in enumerate(flat.to_pylist()) if v is not None and len(v) == block.shape[1] and None not in v]
            if not keep:
                continue
            matrix = np.array([flat[i].as_py() for i in keep], float)
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = (block @ matrix.T) / (sizes[:, None] * np.sqrt((matrix * matrix).sum(1)))
            distance = 1 - np.where(np.isfinite(cosine), cosine, 0.0)
            near = np.round(distance, TIE_DECIMALS)
            edge = np.partition(near, min(top_k, near.shape[1]) - 1, axis=1)[:, min(top_k, near.shape[1]) - 1]
            for q, i in zip(*np.nonzero(near <= edge[:, None]), strict=True):
                best[q].append((float(near[q, i]), keys[keep[i]], float(distance[q, i])))
            best = [sorted(b)[:top_k] if len(b) > top_k else b for b in best]
        out = [(str(ids[q]), k, d) for q, b in enumerate(best) for _, k, d in b]
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64() if kind in ("bigint", "int") else pa.string()), pa.array(columns[2], pa.float64())], names=["query_id", key, "distance"])

    narrow = vectors.select(F.col(key).cast("bigint" if kind in ("bigint", "int") else "string").alias(key), F.col(embedding).cast("array<double>").alias("v"))
    return narrow.mapInArrow(run, f"query_id string, {key} {'bigint' if kind in ('bigint', 'int') else 'string'}, distance double")


def nearest_to(vectors: DataFrame, query: list[float], top_k: int = 10, key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """One query, in the JVM: rank, <key>, distance, score."""
    check_top_k(top_k)
    literal = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors.select(key, cosine_distance(F.col(embedding), literal).alias("distance")).orderBy(F.round("distance", TIE_DECIMALS), key).limit(top_k)
    return rows.select(F.row_number().over(W.orderBy(F.round("distance", TIE_DECIMALS), key)).alias("rank"), key, "distance", clamped_score(F.col("distance")).alias("score"))


def upserted(vectors: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the table after the upsert, stale ids): a document's vectors are replaced as a whole."""
    documents = fresh.select("document_id").distinct()
    old = vectors.join(documents, "document_id", "left_semi")
    stale = old.select("chunk_id").join(fresh.select("chunk_id"), "chunk_id", "left_anti")
    return vectors.join(documents, "document_id", "left_anti").unionByName(fresh), stale


def check_vectors(fresh: DataFrame) -> None:
    """Before an upsert: there are rows, ids are unique, and each has a vector."""
    got = fresh.agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.count("embedding").alias("vectors")).first()
    require(got["n"] > 0, "there is nothing to index")
    require(got["n"] == got["ids"], "chunk ids must be unique")
    require(got["n"] == got["vectors"], "the embedder returned another number of vectors")


def reindexed(chunks: DataFrame, embed, existing: int, overwrite: bool = False) -> tuple[DataFrame, dict]:
    """Vectors for all chunks in order of document and position, and a report; refuses to replace any without overwrite."""
    require(overwrite or not existing, "the vector table is not empty; pass overwrite to replace it")
    ordered = chunks.repartition("document_id").sortWithinPartitions("document_id", "position")
    vectors = embed(ordered)
    n = chunks.count()
    got = vectors.filter("embedding is not null").count()
    require(n == got, f"{got} vectors were made for {n} chunks")
    documents = chunks.select("document_id").distinct().count()
    return vectors, {"documents": documents, "chunks": n, "vectors": got, "replaced": existing, "overwrite": overwrite, "complete": True}
