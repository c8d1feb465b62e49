"""Retrieval quality: precision, reciprocal rank, nDCG, macro means, and the BM25 grid."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import B, K1, check_top_k
from quarry.operators.index import Index
from quarry.operators.lexical import held, sweep_bm25
from quarry.sources.work import python_ready

# The grid of the sweep.
GRID_K1, GRID_B = (0.9, 1.2, 1.5, 2.0), (0.3, 0.5, 0.75, 1.0)
TIE = 1e-12


def holders(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, document_id: documents (document_id, text) whose text has a query's (query_id, text) as it is.

    Blanks stand around a passage's inner words, so a text that has it has these as words; the
    longest of them leads to the passage, which is then looked for. Passages without are looked for in all.
    """
    asked, got = held(queries.select("query_id", "text").filter("text is not null"))
    if got is None:
        return docs.join(asked.withColumnRenamed("text", "passage"), F.contains("text", "passage")).select("query_id", "document_id")
    python_ready(docs.sparkSession)
    passages, names = got.column("text").to_pylist(), got.column("query_id").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        led: dict[str, list[int]] = {}
        always = []
        for i, passage in enumerate(passages):
            if inner := re.findall(r"(?<=\s)\S+(?=\s)", passage):
                led.setdefault(max(inner, key=len), []).append(i)
            else:
                always.append(i)
        for batch in batches:
            found = [(i, d) for d, text in enumerate(batch.column(1).to_pylist()) if text is not None for i in (*always, *(i for word in led.keys() & set(text.split()) for i in led[word])) if passages[i] in text]
            yield pa.RecordBatch.from_arrays([names.take(pa.array([i for i, _ in found], pa.int64())), batch.column(0).take(pa.array([d for _, d in found], pa.int64()))], names=["query_id", "document_id"])

    narrow = docs.select(F.col("document_id").cast("string"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, document_id string")


def metrics(ranking: DataFrame, qrels: DataFrame, queries: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), item: str = "chunk_id") -> DataFrame:
    """precision, reciprocal_rank, ndcg at k per query (and further keys of the ranking).

    qrels: (query_id, <item>) of what is relevant. Precision divides by k, also where fewer
    were found. Without anything relevant all figures are 0.
    """
    check_top_k(k)
    other = [x for x in keys if x != "query_id"]
    base = queries.select("query_id")
    if other:
        base = base.crossJoin(F.broadcast(ranking.select(*other).distinct()))  # a grid's cells
    relevant = qrels.groupBy("query_id").agg(F.count_distinct(item).alias("n_relevant"))
    hits = ranking.filter(F.col("rank") <= k).join(qrels.select("query_id", item).distinct(), ["query_id", item], "left_semi")
    found = hits.groupBy(*keys).agg(F.count("*").alias("n_hit"), F.min("rank").alias("first"), F.aggregate(F.array_sort(F.collect_list("rank")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0)).alias("dcg"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("n_relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    rows = base.join(relevant, "query_id", "left").join(found, list(keys), "left")
    return rows.select(*keys, F.coalesce(F.col("n_hit") / k, F.lit(0.0)).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.when(F.col("n_relevant") > 0, F.coalesce(F.col("dcg"), F.lit(0.0)) / best).otherwise(0.0).alias("ndcg"))


#: Names of the splits, and the titles of their sections.
SPLITS = {"exact": "Exact vocabulary", "mismatch": "Vocabulary mismatch", "negative": "Nothing relevant"}


def splits(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id, split: negative without anything relevant, mismatch where the note begins with that word, else exact."""
    some = qrels.select("query_id", F.lit(True).alias("some")).distinct()
    mismatch = F.coalesce(F.lower("note").startswith("vocabulary mismatch"), F.lit(False))
    split = F.when(F.col("some").isNull(), "negative").when(mismatch, "mismatch").otherwise("exact")
    return queries.join(some, "query_id", "left").select("query_id", split.alias("split"))


def macro(rows: DataFrame, *by: str) -> DataFrame:
    """Means over queries, per method, split or grid cell."""
    means = [F.avg(c).alias(c) for c in ("precision", "reciprocal_rank", "ndcg")]
    return rows.groupBy(*by).agg(F.count("*").alias("n_queries"), *means)


def rank_positions(ranking: DataFrame, qrels: DataFrame, k: int = 4, item: str = "chunk_id") -> DataFrame:
    """One row: how many relevant items are at each rank up to k, and how many are missed."""
    best = ranking.filter(F.col("rank") <= k).groupBy("query_id", item).agg(F.min("rank").alias("rank"))
    rows = qrels.select("query_id", item).distinct().join(best, ["query_id", item], "left")
    return rows.agg(*[F.count_if(F.col("rank") == r).alias(f"rank_{r}") for r in range(1, k + 1)], F.count_if(F.col("rank").isNull()).alias("missed"))


def sweep(queries: DataFrame, index: Index, qrels: DataFrame, k: int, grid: list[tuple[float, float]] | None = None, item: str = "chunk_id") -> DataFrame:
    """Macro figures for each (k1, b): one pass over the postings for the whole grid."""
    grid = grid or [(k1, b) for k1 in GRID_K1 for b in GRID_B]
    return macro(metrics(sweep_bm25(queries, index, grid, k), qrels, queries, k, ("k1", "b", "query_id"), item), "k1", "b")


def select_parameters(rows: list[dict], keep: tuple[float, float] = (K1, B)) -> tuple[float, float]:
    """The best pair by nDCG, then reciprocal rank; among equals the standard pair if it is one, else the first."""
    best = rows
    for name in ("ndcg", "reciprocal_rank"):
        top = max(r[name] for r in best)
        best = [r for r in best if abs(r[name] - top) <= TIE]
    pairs = sorted((r["k1"], r["b"]) for r in best)
    return keep if keep in pairs else pairs[0]


def report(tables: dict[str, list[dict]], old: str = "") -> str:
    """Markdown sections, one per table; sections of an older report that are not given stay."""
    sections = {}
    for part in old.split("\n## ")[1:]:
        name, _, body = part.partition("\n")
        sections[name.strip()] = body.strip()
    for name, rows in tables.items():
        heads = list(rows[0]) if rows else []
        cell = lambda x: f"{x:.3f}" if isinstance(x, float) else str(x)
        lines = ["| " + " | ".join(heads) + " |", "|" + " --- |" * len(heads), *("| " + " | ".join(cell(r[h]) for h in heads) + " |" for r in rows)]
        sections[name] = "\n".join(lines) if rows else "no rows"
    return "# Retrieval evaluation\n" + "".join(f"\n## {name}\n\n{body}\n" for name, body in sections.items())


def ranking_line(hits: list[dict]) -> str:
    return " ".join(f"{h['rank']}.{h['chunk_id']}:{h['score']:.4f}" for h in sorted(hits, key=lambda h: h["rank"]))
