"""Ranked lexical retrieval for batches of queries: TF-IDF cosine and BM25, exact or over champion lists.

Queries are rows (query_id, text); a single query is a batch of one. Query terms meet
postings by term, what they score is summed per (query, chunk) in term order, and the best
k of each query are kept by a window whose limit Spark also applies before the shuffle.
A batch of many terms over a `Built` index has a task pass on only what may be among the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.config import B, K1, check_bm25, check_choice, check_top_k
from quarry.functions import text as X
from quarry.functions.stem import stems
from quarry.operators.index import Built, Index, bm25_idf, entries_of, in_order, matched, tf_weight, tfidf_idf
from quarry.sources.work import python_ready, written

#: Query terms up to this many rows are broadcast; beyond, the join shuffles.
BROADCAST_TERMS = 100_000
#: Up to this many values of a key are pushed to a scan one by one.
PUSHED_VALUES = 64
#: Scores that agree in this many decimals are ties, which go to the smaller id.
TIE_DECIMALS = 9
#: What a task's scores may be off, in parts of the score or of 1, beyond what rounding to TIE_DECIMALS moves them.
SLACK = 1e-8
#: Scores, of chunks by queries, that a task holds at once.
SCORES_AT_ONCE = 1 << 18


def as_indexed(rows: DataFrame, index: Index | None) -> DataFrame:
    """Rows with a term, as the index has it: stemmed if the index is."""
    if index is None or not index.stem:
        return rows
    return rows.withColumn("term", stems(rows.sparkSession))


def query_terms(queries: DataFrame, index: Index | None = None, min_length: int = 2) -> DataFrame:
    """query_id, term, qtf."""
    rows = as_indexed(queries.select("query_id", F.explode(X.terms(F.col("text"), min_length)).alias("term")), index)
    return rows.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def held(df: DataFrame, rows: int = BROADCAST_TERMS) -> tuple[DataFrame, list | None]:
    """df, computed once and held by the driver if it has at most that many rows; its rows then, else None."""
    got = df.limit(rows + 1).toArrow()
    if got.num_rows > rows:
        return df, None
    spark = df.sparkSession
    return (spark.createDataFrame(got, df.schema) if got.num_rows else spark.createDataFrame([], df.schema)), got


def meet(table: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """table joined with df by a key: df is broadcast if it was counted and is small, else the join shuffles.

    A few values of the key become a filter of the table's scan.
    """
    small, got = held(df)
    if got is None:
        return table.join(df, key)
    values = [v for v in got.column(key).unique().to_pylist() if v is not None]
    if len(values) <= PUSHED_VALUES:
        table = table.filter(reduce(or_, [F.col(key) == F.lit(v) for v in values], F.lit(False)))
    return table.join(F.broadcast(small), key)


def figures(index: Index | Built) -> DataFrame:
    """One row: n_chunks, avg_length."""
    return index.stats.select("n_chunks", "avg_length") if isinstance(index, Index) else index.figures


def with_df(index: Index | Built, rows: DataFrame, how: str = "inner") -> DataFrame:
    """rows (term, ...) with the df of terms that are in the index; others go, or stay without if joined left."""
    if isinstance(index, Built):
        _, got = held(rows.select("term").distinct())
        if got is not None:
            return rows.join(F.broadcast(index.df_of(got.column("term").to_pylist())), "term", how)
    return rows.join(index.terms, "term", how)


def by_term(index: Index | Built, want: DataFrame, *more: str) -> DataFrame:
    """want (query_id, term, ...) with term, chunk_id, document_id, tf and, of df, length and norm, what `more` names."""
    if isinstance(index, Index):
        return meet(index.scored.select("term", "chunk_id", "document_id", "tf", *more), want, "term")
    small, got = held(want)
    if "df" in more:
        small = with_df(index, small)
    if got is None:
        met = index.counted.join(small, "term")
        met = met.join(index.lengths.select("chunk_id", "length"), "chunk_id") if "length" in more else met
    else:
        rows = index.entries(_terms_in(got))
        met = meet(rows if "length" in more else rows.drop("length"), small, "term")
    return met.join(index.norms, "chunk_id") if "norm" in more else met


def by_chunk(index: Index | Built, want: DataFrame) -> DataFrame:
    """want (query_id, chunk_id, ...) with the term, tf and df of each posting of the chunk."""
    if isinstance(index, Index):
        return meet(index.forward.select("term", "chunk_id", "tf", "df"), want, "chunk_id")
    met = written(meet(index.bags.select("chunk_id", "terms", "tfs"), want, "chunk_id"), "feedback_bags").withColumn("p", F.explode(F.arrays_zip("terms", "tfs")))
    return with_df(index, met.withColumn("term", F.col("p.terms")).withColumn("tf", F.col("p.tfs")).drop("p", "terms", "tfs"))


def known_terms(queries: DataFrame, index: Index | Built, alone: bool = False) -> DataFrame:
    """query_id, term, weight (1.0), qtf, df of terms that are in the index; alone if no other term of it will be asked for."""
    asked = query_terms(queries, index)
    if isinstance(index, Index):
        return meet(index.terms, asked, "term").select("query_id", "term", "qtf", "df")
    small, got = held(asked)
    if alone and got is not None:
        index.narrow(_terms_in(got))
    return with_df(index, small).select("query_id", "term", "qtf", "df")


def _expanded(row: np.ndarray, place: np.ndarray, starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (row, place) and each weight of that place: which of the former, and which weight."""
    n = starts[place + 1] - starts[place]
    which = np.repeat(np.arange(len(row)), n)
    return which, of[np.repeat(starts[place] - (np.cumsum(n) - n), n) + np.arange(len(which))]


@dataclass(frozen=True)
class _Asked:
    """Weights (query, term, base) by term: those of terms[i] are of[starts[i]:starts[i + 1]]."""

    terms: list[str]
    starts: np.ndarray
    of: np.ndarray
    query: np.ndarray
    base: np.ndarray
    n_queries: int

    @classmethod
    def made(cls, got: pa.Table) -> _Asked:
        terms = sorted(t for t in got.column("term").unique().to_pylist() if t is not None)
        place = pc.index_in(got.column("term").combine_chunks(), value_set=pa.array(terms, pa.string())).fill_null(len(terms)).to_numpy(zero_copy_only=False)
        query = got.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of = np.argsort(place, kind="stable")
        starts = np.searchsorted(place[of], np.arange(len(terms) + 1))
        base = got.column("base").to_numpy() if "base" in got.column_names else np.ones(len(place))
        return cls(terms, starts, of, query, base, int(query.max()) + 1)

    def slices(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        size = max(1, min(256, SCORES_AT_ONCE // self.n_queries))
        return (batch.slice(at, size) for at in range(0, batch.num_rows, size))


def contenders(bags: DataFrame, got: pa.Table, factor: Callable[[np.ndarray, np.ndarray], np.ndarray], top_k: int, norm: Callable[[pa.ListArray, pa.ListArray], np.ndarray] | None = None) -> DataFrame:
    """wn, chunk_id, document_id, tf and the fifth column of bags, for chunks that may be among the top_k of a query.

    With norm, the fifth column is what it makes of the bag.

    got has weights (query_id, term, base), wn is a place in it. A score is the sum of base
    times factor(tf, fifth column). A task keeps, of each query, its chunks whose score reaches
    its k-th best but for SLACK; of chunks that score by the same counts, those of the
    smallest ids. So what it drops has k others before it, whatever the last digits are.
    """
    python_ready(bags.sparkSession)
    asked = _Asked.made(got)
    fifth, kind = ("norm", "double") if norm else (bags.columns[4], dict(bags.dtypes)[bags.columns[4]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(asked.terms, pa.string())
        floor = np.full(asked.n_queries, -np.inf)
        kept: list[tuple] = []  # query, -score, chunk_id, document_id, wns, tfs, fifth
        fresh, limit = 0, 4 * asked.n_queries * top_k + 1000
        plain = bool((asked.base > 0).all())

        def thinned() -> list[tuple]:
            out, q, n, worst, same = [], None, 0, 0.0, {}
            for x in sorted(kept, key=lambda x: x[:3]):
                if x[0] != q:
                    q, n, worst, same = x[0], 0, np.inf, {}
                n += 1
                if n == top_k:
                    worst = -x[1]
                    floor[q] = max(floor[q], worst)
                if n > top_k and -x[1] < worst - SLACK * max(1.0, abs(worst)):
                    continue
                key = (x[4].tobytes(), x[5].tobytes(), x[6])
                same[key] = same.get(key, 0) + 1
                if same[key] <= top_k:
                    out.append(x)
            return out

        for whole in batches:
            every, at = (norm(whole.column(2), whole.column(3)) if norm else whole.column(4).to_numpy(zero_copy_only=False)), 0
            for batch in asked.slices(whole):
                more, at = every[at : at + batch.num_rows], at + batch.num_rows
                row, place, tf = matched(batch.column(2), batch.column(3), vocabulary)
                if not len(row):
                    continue
                which, wn = _expanded(row, place, asked.starts, asked.of)
                cell = row[which] * asked.n_queries + asked.query[wn]
                shape = (batch.num_rows, asked.n_queries)
                scores = np.bincount(cell, asked.base[wn] * factor(tf, more[row])[which], shape[0] * shape[1]).reshape(shape)
                scores[(scores <= 0 if plain else np.bincount(cell, minlength=scores.size).reshape(shape) == 0)] = -np.inf
                least = floor
                if shape[0] > top_k:
                    least = np.maximum(floor, np.partition(scores, shape[0] - top_k, axis=0)[shape[0] - top_k])
                good = np.isfinite(scores) & (scores >= np.where(np.isfinite(least), least - SLACK * np.maximum(1.0, np.abs(least)), -np.inf))
                found = np.flatnonzero(good)
                if not len(found):
                    continue
                order = np.argsort(cell, kind="stable")
                lo, hi = np.searchsorted(cell[order], found), np.searchsorted(cell[order], found, "right")
                ids, documents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for x, a, b in zip(found, lo, hi, strict=True):
                    r, q = divmod(int(x), asked.n_queries)
                    own = order[a:b]
                    kept.append((q, -float(scores[r, q]), ids[r], documents[r], wn[own], tf[which[own]], more[r]))
                fresh += len(found)
                if fresh > limit:
                    kept, fresh = thinned(), 0
        kept = thinned()
        if kept:
            n = pa.array(np.repeat(np.arange(len(kept)), [len(x[4]) for x in kept]))
            columns = [pa.array(np.concatenate([x[4] for x in kept]), pa.int32()), pa.array([x[2] for x in kept], pa.string()).take(n), pa.array([x[3] for x in kept], pa.string()).take(n), pa.array(np.concatenate([x[5] for x in kept]), pa.int32()), pa.array([x[6] for x in kept]).take(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["wn", "chunk_id", "document_id", "tf", fifth])

    return bags.mapInArrow(run, f"wn int, chunk_id string, document_id string, tf int, {fifth} {kind}")


def candidate_counts(index: Built, got: pa.Table) -> DataFrame:
    """query_id, all_candidates: how many chunks have a term of the query (query_id, term); a task passes on its counts."""
    asked = _Asked.made(got)
    spark = index.chunks.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = pa.array(asked.terms, pa.string()), np.zeros(asked.n_queries, np.int64)
        for whole in batches:
            for batch in asked.slices(whole):
                row, place, _ = matched(batch.column(0), batch.column(1), vocabulary)
                which, wn = _expanded(row, place, asked.starts, asked.of)
                cells = np.bincount(row[which] * asked.n_queries + asked.query[wn], minlength=batch.num_rows * asked.n_queries)
                counts += (cells.reshape(batch.num_rows, asked.n_queries) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(asked.n_queries), pa.int64()), pa.array(counts)], names=["qn", "n"])

    python_ready(spark)
    names = spark.createDataFrame(got.select(["query_id"]).append_column("qn", pa.array(asked.query))).distinct()
    counted = index.bags_with(asked.terms).select("terms", "tfs").mapInArrow(run, "qn long, n long").groupBy("qn").agg(F.sum("n").alias("all_candidates"))
    return counted.join(F.broadcast(names), "qn").select("query_id", "all_candidates")


def ranked(scored: DataFrame, top_k: int, score: str = "score", tie: str = "chunk_id", by: str = "query_id") -> DataFrame:
    order = W.partitionBy(by).orderBy(F.desc(F.round(score, TIE_DECIMALS)), tie)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def candidates(terms: DataFrame, index: Index, top_k: int, mode: str, fallback: bool) -> DataFrame | None:
    """query_id, chunk_id that may be scored; None for exact mode, where every posting's chunk may.

    Champion mode takes the union of the terms' champion lists. With fallback, a query that
    has fewer of them than top_k takes all chunks of its terms instead.
    """
    if mode == "exact":
        return None
    own, got = held(terms.select("query_id", "term"))
    if not isinstance(index, Built) or got is None:
        short = meet(index.champions, own, "term").select("query_id", "chunk_id").distinct()
    else:
        short = written(meet(index.champions_of(_terms_in(got)), own, "term").select("query_id", "chunk_id").distinct(), "short")
    if not fallback:
        return short
    enough = short.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= top_k).select("query_id")
    few, left = held(own.join(enough, "query_id", "left_anti"))
    if left is not None and not left.num_rows:
        return short
    full = by_term(index, few).select("query_id", "chunk_id").distinct()
    return short.join(enough, "query_id", "left_semi").unionByName(full)


def _terms_in(got: pa.Table) -> list[str]:
    return [t for t in got.column("term").unique().to_pylist() if t is not None]


def _hits(weighted: DataFrame, index: Index | Built, contribution: Column, top_k: int, chosen: DataFrame | None, base: Column, factor: Callable[[float], Callable], *more: str) -> DataFrame:
    """Scores of query terms over postings, best top_k of each query; contribution is made of tf, df and `more`.

    Up to rounding it is base, of w and df, times factor(mean length)(tf, what `more` names).
    """
    met = _met(weighted, index, top_k, chosen, base, factor, *more)
    met = met.join(F.broadcast(figures(index)))  # one row
    met = met.select("query_id", "chunk_id", "document_id", "term", contribution.alias("c"))
    grouped = met.groupBy("query_id", "chunk_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("term", "c"))).alias("parts"))
    scored = grouped.withColumn("score", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["c"]))
    best = ranked(scored, top_k).withColumn("contributions", F.map_from_entries("parts"))
    return best.select("query_id", "rank", "chunk_id", "document_id", "score", F.array_sort(F.map_keys("contributions")).alias("matched_terms"), F.col("contributions").alias("term_contributions"))


def _met(weighted: DataFrame, index: Index | Built, top_k: int, chosen: DataFrame | None, base: Column, factor: Callable[[float], Callable], *more: str) -> DataFrame:
    """weighted with the postings of its terms, those at least that may lead to one of the top_k."""
    small, got = held(weighted) if isinstance(index, Built) else (weighted, None)
    if got is not None and got.num_rows and chosen is not None:
        rows = entries_of(meet(index.bags_with(_terms_in(got)), chosen.select("chunk_id").distinct(), "chunk_id"), _terms_in(got))
        met = (rows if "length" in more else rows.drop("length")).join(chosen, "chunk_id").join(F.broadcast(with_df(index, small)), ["query_id", "term"])
        return met.join(index.norms, "chunk_id") if "norm" in more else met
    if got is not None and len(got.column("term").unique()) > PUSHED_VALUES:
        _, based = held(with_df(index, small).join(F.broadcast(figures(index))).withColumn("base", base))
        known = based.drop_columns([c for c in ("n_chunks", "avg_length", "base") if c in based.column_names]).append_column("wn", pa.array(range(based.num_rows), pa.int32()))
        norm = index.norm if "norm" in more else None
        bags = index.bags_with(_terms_in(got)) if "norm" not in more else index.normed if norm is None else index.bags
        rows = bags.select("chunk_id", "document_id", "terms", "tfs", *([] if norm else more))
        found = contenders(rows, based, factor(index.figures.first()["avg_length"]), top_k, norm)
        return found.join(F.broadcast(small.sparkSession.createDataFrame(known)), "wn").drop("wn") if based.num_rows else by_term(index, small, "df", *more)
    met = by_term(index, weighted, "df", *more)
    return met if chosen is None else met.join(chosen, ["query_id", "chunk_id"], "left_semi")


def _checked(top_k: int, mode: str) -> None:
    check_top_k(top_k)
    check_choice("retrieval_mode", mode, ("champion", "exact"))


def tfidf_weights(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, term, w: (1 + ln qtf) idf of terms that are in the index."""
    rows = known_terms(queries, index).join(F.broadcast(figures(index).select("n_chunks")))
    return rows.select("query_id", "term", (tf_weight(F.col("qtf")) * tfidf_idf(F.col("df"), F.col("n_chunks"))).alias("w"))


def search_weighted_tfidf(weights: DataFrame, index: Index, top_k: int = 10, mode: str = "champion", fallback: bool = True) -> DataFrame:
    """Cosine of weighted queries (query_id, term, w) with chunks."""
    _checked(top_k, mode)
    live, _ = held(weights.filter("w != 0").select("query_id", "term", "w"))
    size = live.withColumn("w2", F.col("w") * F.col("w")).groupBy("query_id").agg(F.sqrt(in_order("w2", "term")).alias("qnorm"))
    full = live.join(size, "query_id")
    chosen = candidates(live.filter("w > 0"), index, top_k, mode, fallback)
    doc_weight = tf_weight(F.col("tf")) * tfidf_idf(F.col("df"), F.col("n_chunks"))
    contribution = F.col("w") * doc_weight / (F.col("qnorm") * F.col("norm"))
    base = F.col("w") * tfidf_idf(F.col("df"), F.col("n_chunks")) / F.col("qnorm")
    return _hits(full, index, contribution, top_k, chosen, base, lambda mean: lambda tf, norm: (1 + np.log(tf)) / norm, "norm")


def search_tfidf(queries: DataFrame, index: Index, top_k: int = 10, mode: str = "champion", fallback: bool = True) -> DataFrame:
    """query_id, rank, chunk_id, document_id, score, matched_terms, term_contributions by TF-IDF cosine."""
    _checked(top_k, mode)
    return search_weighted_tfidf(tfidf_weights(queries, index), index, top_k, mode, fallback)


def _bm25_part(k1: Column | float, b: Column | float) -> Column:
    tf = F.col("tf").cast("double")
    spread = tf + k1 * (1 - b + b * F.col("length") / F.col("avg_length"))
    return F.col("w") * bm25_idf(F.col("df"), F.col("n_chunks")) * tf * (F.lit(1.0) * k1 + 1) / spread


def search_weighted_bm25(weights: DataFrame, index: Index, top_k: int = 10, mode: str = "champion", fallback: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """BM25 with a query's weights in place of its term counts."""
    _checked(top_k, mode)
    check_bm25(k1, b)
    live, _ = held(weights.filter("w != 0").select("query_id", "term", "w"))
    chosen = candidates(live.filter("w > 0"), index, top_k, mode, fallback)
    base = F.col("w") * bm25_idf(F.col("df"), F.col("n_chunks"))
    factor = lambda mean: lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
    return _hits(live, index, _bm25_part(F.lit(float(k1)), F.lit(float(b))), top_k, chosen, base, factor, "length")


def search_bm25(queries: DataFrame, index: Index, top_k: int = 10, mode: str = "champion", fallback: bool = True, k1: float = K1, b: float = B, alone: bool = True) -> DataFrame:
    """query_id, rank, chunk_id, document_id, score, matched_terms, term_contributions by Okapi BM25.

    Exact search alone writes bags of the queries' terms only; not alone, those of all terms, which what follows it reads.
    """
    weights = known_terms(queries, index, alone and mode == "exact").select("query_id", "term", F.col("qtf").cast("double").alias("w"))
    return search_weighted_bm25(weights, index, top_k, mode, fallback, k1, b)


def sweep_bm25(queries: DataFrame, index: Index, grid: list[tuple[float, float]], top_k: int) -> DataFrame:
    """k1, b, query_id, rank, chunk_id, document_id, score of exact BM25 for every pair: postings are read once."""
    for k1, b in grid:
        check_bm25(k1, b)
    weights = known_terms(queries, index).select("query_id", "term", F.col("qtf").cast("double").alias("w"))
    met = by_term(index, weights, "df", "length").join(F.broadcast(figures(index)))  # one row
    met = met.withColumn("base", F.col("w") * bm25_idf(F.col("df"), F.col("n_chunks")))
    parts = F.array_sort(F.collect_list(F.struct("term", "base", F.col("tf").cast("double").alias("tf"))))
    grouped = met.groupBy("query_id", "chunk_id", "document_id").agg(parts.alias("parts"), (F.first("length") / F.first("avg_length")).alias("share"))

    def cell(k1: float, b: float) -> Column:
        spread = k1 * (1 - b + b * F.col("share"))
        score = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["base"] * x["tf"] * (k1 + 1) / (x["tf"] + spread))
        return F.struct(F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b"), score.alias("score"))

    # postings are grouped once; each pair of parameters only adds up the same parts anew
    scored = grouped.select("query_id", "chunk_id", "document_id", F.explode(F.array(*[cell(k1, b) for k1, b in grid])).alias("cell")).select("query_id", "chunk_id", "document_id", "cell.*")
    order = W.partitionBy("k1", "b", "query_id").orderBy(F.desc(F.round("score", TIE_DECIMALS)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def diagnostics(queries: DataFrame, index: Index, top_k: int = 10, mode: str = "champion", fallback: bool = True) -> DataFrame:
    """Per query: postings there are and postings visited, candidates, the reduction in per cent, and whether it fell back."""
    _checked(top_k, mode)
    terms = known_terms(queries, index)
    total = terms.groupBy("query_id").agg(F.sum("df").alias("postings_available"), F.sum(F.least("df", F.lit(index.champion_size))).alias("champion_postings"))
    _, got = held(terms.select("query_id", "term")) if isinstance(index, Built) else (terms, None)
    if got is not None and got.num_rows:
        every = candidate_counts(index, got)
    else:
        every = by_term(index, terms.select("query_id", "term")).select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count("*").alias("all_candidates"))
    short = candidates(terms, index, top_k, "champion", False).groupBy("query_id").agg(F.count("*").alias("champion_candidates"))
    rows = queries.select("query_id").join(total, "query_id", "left").join(every, "query_id", "left").join(short, "query_id", "left").fillna(0)
    fell = F.lit(mode == "champion" and fallback) & (F.col("champion_candidates") < top_k)
    exact = F.lit(mode == "exact")
    available = F.col("postings_available")
    # a fall-back reads the champion lists first, then everything; a count never exceeds what there is
    visited = F.when(exact | fell, available).otherwise(F.least(available, F.col("champion_postings")))
    return rows.select(
        "query_id", F.lit(mode).alias("retrieval_mode"), F.lit(index.champion_size).alias("champion_size"), available, visited.alias("postings_visited"),
        F.when(exact | fell, F.col("all_candidates")).otherwise(F.col("champion_candidates")).alias("candidate_count"),
        F.when(available > 0, 100.0 * (available - visited) / available).otherwise(0.0).alias("reduction_percentage"), fell.alias("fallback_occurred"),
    )


def overlap(approximate: DataFrame, exact: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """Per query, the share of the exact best that the approximate best have; 1 where there is no exact hit."""
    there = exact.groupBy("query_id").agg(F.count("*").alias("n_exact"))
    same = approximate.select("query_id", "chunk_id").join(exact.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("same"))
    rows = queries.select("query_id").join(there, "query_id", "left").join(same, "query_id", "left").fillna(0)
    return rows.select("query_id", F.when(F.col("n_exact") == 0, 1.0).otherwise(F.col("same") / F.least(F.col("n_exact"), F.lit(top_k))).alias("exact_top_k_overlap"))


@dataclass(frozen=True)
class Detailed:
    hits: DataFrame
    diagnostics: DataFrame


def search_detailed(queries: DataFrame, index: Index, scoring: str = "tfidf", top_k: int = 10, mode: str = "champion", fallback: bool = True, compare_exact: bool = False, k1: float = K1, b: float = B) -> Detailed:
    """Hits and diagnostics; compare_exact adds the overlap with exact retrieval."""
    check_choice("scoring", scoring, ("tfidf", "bm25"))
    run = (lambda m: search_tfidf(queries, index, top_k, m, fallback)) if scoring == "tfidf" else (lambda m: search_bm25(queries, index, top_k, m, fallback, k1, b))
    hits, said = run(mode), diagnostics(queries, index, top_k, mode, fallback)
    if compare_exact:
        said = said.join(overlap(hits, run("exact"), queries, top_k), "query_id")
    return Detailed(hits, said)
