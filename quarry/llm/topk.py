"""Exact top-k search by inner product: M-trees searched best first.

Vectors become integers. One more coordinate turns the largest inner product into the
smallest distance: with M2 the largest squared length of all vectors, a vector v gets
sqrt(M2 - v.v), a query 0, and then distance2 = q.q + M2 - 2 q.v. An M-tree needs a
metric only, and this is one.

Vectors are dealt into blocks by their nearest pivot, and by their distance to it where a
pivot has many. A block is an M-tree: pages of vectors around a routing vector, pages of
pages above them, each entry with its covering radius and its distance to its parent. A
query first meets the block that can hold its best, which gives it a score to beat, and
then only those blocks whose bound can still beat it. Best first, a page is opened only if
its bound can beat the k-th best, and an entry's distance is computed only if the parent
distances, by the triangle inequality, do not already rule it out. Scores that decide are
integers, as wide as they need to be, so results are exact. A block's best k are merged by
query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm.common import map_arrow, materialize, parts_for, pick, scratch, small_batches, table

SCALE = 256
BLOCK = 4096
QUERY_BLOCK = 2048
PAGE = 64
#: Pivots are the vectors with the smallest id hashes: one for each block's worth of rows, up to this many bytes of them.
PIVOT_BYTES = 8 << 20
#: Slack for bounds computed in floating point; scores themselves are integers.
SLACK = 1e-6
LONG = (-(1 << 63), (1 << 63) - 1)


def integers(values: np.ndarray, scale: int, fits: bool) -> np.ndarray:
    """scale * values, all of them whole numbers: 64-bit integers if products of two rows fit, Python's else."""
    if fits:
        return np.rint(values * scale).astype(np.int64)
    return np.array([[int(x * scale) if abs(x) < 2.0**900 else int(x) * scale for x in row] for row in values.tolist()], object).reshape(values.shape)


class MTree:
    """Pages over the rows of a matrix; points are the lifted vectors, vectors the integers that decide, both in the same unit."""

    def __init__(self, vectors: np.ndarray, points: np.ndarray, top2: float, unit: float = 1.0, page: int = PAGE) -> None:
        self.vectors, self.points, self.top2, self.unit = vectors, points, top2, unit
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        rows = np.arange(len(vectors))
        self.nodes: list[tuple] = []  # (is leaf, entries, distances to the routing row, radii of the entries)
        level = [self._leaf(members) for members in self._split(rows, page)]
        while len(level) > 1:
            routing = np.array([r for r, _, _ in level])
            level = [self._inner([level[i] for i in group]) for group in self._split(routing, page)]
        self.root = level[0] if level else None
        self.computed = 0

    def _between(self, rows: np.ndarray, row: int) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares[rows] + self.squares[row] - 2 * (self.points[rows] @ self.points[row]), 0))

    def _split(self, rows: np.ndarray, page: int) -> list[np.ndarray]:
        """Positions in groups of at most page: each cut by which of two far rows is nearer, in halves."""
        todo, out = [np.arange(len(rows))], []
        while todo:
            part = todo.pop()
            if len(part) <= page:
                if len(part):
                    out.append(part)
                continue
            first = part[np.argmax(self._between(rows[part], rows[part[0]]))]
            near = self._between(rows[part], rows[first])
            second = part[np.argmax(near)]
            order = np.argsort(near - self._between(rows[part], rows[second]), kind="stable")
            todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        return out

    def _routing(self, rows: np.ndarray) -> int:
        """The row nearest to the rows' mean: a routing object out of the page."""
        mean = self.points[rows].mean(0)
        return int(rows[np.argmin(self.squares[rows] - 2 * (self.points[rows] @ mean))])

    def _leaf(self, members: np.ndarray) -> tuple[int, float, int]:
        routing = self._routing(members)
        to = self._between(members, routing)
        self.nodes.append((True, members, to, None))
        return routing, float(to.max()), len(self.nodes) - 1

    def _inner(self, children: list[tuple[int, float, int]]) -> tuple[int, float, int]:
        rows = np.array([r for r, _, _ in children])
        radii = np.array([r for _, r, _ in children])
        routing = self._routing(rows)
        to = self._between(rows, routing)
        self.nodes.append((False, (rows, np.array([n for _, _, n in children])), to, radii))
        return routing, float((to + radii).max()), len(self.nodes) - 1

    def search(self, query: np.ndarray, point: np.ndarray, k: int, ids: np.ndarray, own: int | None, least: float = -np.inf) -> list[tuple[int, int]]:
        """(score, id) of the k best rows, ties to smaller ids, without the row of id own; those that score below least may lack.

        point: the query in floating point, in the unit of the points, its last coordinate 0.
        """
        if self.root is None:
            return []
        q2 = float(point @ point)
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst on top

        def reach() -> float:
            """The distance beyond which nothing can be among the best; grows with rounding."""
            score = max(least, best[0][0] / self.unit / self.unit) if len(best) >= k else least
            if score == -np.inf:
                return np.inf
            limit2 = q2 + self.top2 - 2 * score
            return float(np.sqrt(max(limit2, 0.0))) + SLACK * float(np.sqrt(q2 + self.top2))

        routing, radius, node = self.root
        d = float(np.sqrt(max(self.squares[routing] + q2 - 2 * float(self.points[routing] @ point), 0.0)))
        todo = [(max(0.0, d - radius), node, d)]
        while todo:
            bound, node, d = heapq.heappop(todo)
            if bound > reach():
                break
            leaf, entries, to, radii = self.nodes[node]
            if leaf:
                keep = entries[np.abs(d - to) <= reach()]
                self.computed += len(keep)
                scores = self.vectors[keep] @ query
                if len(best) >= k:
                    could = scores >= best[0][0]
                    keep, scores = keep[could], scores[could]
                if len(keep) > 4 * k:  # only the k best of a page, and what ties with the last, can matter; one more for own
                    could = scores >= np.sort(scores)[len(scores) - k - 1]
                    keep, scores = keep[could], scores[could]
                for score, row in zip(scores.tolist(), ids[keep].tolist(), strict=True):
                    if row != own:
                        if len(best) < k:
                            heapq.heappush(best, (score, -row))
                        elif (score, -row) > best[0]:
                            heapq.heapreplace(best, (score, -row))
            else:
                rows, nodes = entries
                near = np.abs(d - to) - radii <= reach()
                rows, nodes, own_radii = rows[near], nodes[near], radii[near]
                self.computed += len(rows)
                distances = np.sqrt(np.maximum(self.squares[rows] + q2 - 2 * (self.points[rows] @ point), 0))
                for bound, child, at in zip(np.maximum(distances - own_radii, 0).tolist(), nodes.tolist(), distances.tolist(), strict=True):
                    heapq.heappush(todo, (bound, child, at))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) / scale of every component, which a double holds exactly; scale is a power of 2.

    Vectors that are null or hold null or non-finite components go.
    """
    rows = pick(vectors, vec_id="long", embedding="array<double>").filter("vec_id is not null")
    usable = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # a double from 2^45 on has at most 7 binary places, so it stays
    cut = lambda x: F.when(F.abs(x) < 2.0**45, F.floor(F.lit(float(scale)) * x).cast("double") / F.lit(float(scale))).otherwise(x)
    return rows.filter(usable).select("vec_id", F.transform("embedding", cut).alias("v"))


@dataclass(frozen=True)
class Space:
    """What all tasks know of the vectors of one dimension."""

    dim: int
    unit: float  # the largest component: floating point works on shares of it
    top2: float  # the largest squared length, in that unit
    fits: bool  # whether scores fit 64 bits
    scale: int
    pivots: np.ndarray  # lifted

    def lifted(self, v: np.ndarray) -> np.ndarray:
        x = v / self.unit
        return np.concatenate([x, np.sqrt(np.maximum(self.top2 - np.einsum("ij,ij->i", x, x), 0))[:, None]], 1)

    def asked(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v / self.unit, np.zeros((len(v), 1))], 1)

    def tree(self, v: np.ndarray) -> MTree:
        return MTree(integers(v, self.scale, self.fits), self.lifted(v), self.top2, self.unit * self.scale)


def _to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each point to each pivot."""
    return np.sqrt(np.maximum(np.einsum("ij,ij->i", points, points)[:, None] + np.einsum("ij,ij->i", pivots, pivots) - 2 * points @ pivots.T, 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products among the vectors.

    Both have vec_id and v (see `quantized`); other columns are ignored. A query's own id is
    no candidate; ties go to the smaller vec_id; fewer than k candidates give fewer rows.
    Only vectors of the query's dimension are candidates. Equal vectors with several ids are
    each candidates; rows that repeat an id repeat as candidates, and as queries. Components
    may have any size: ranks follow the exact scores, and a score beyond 64 bits is shown
    as the nearest 64-bit number. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    vectors, queries = (df.select("vec_id", "v", F.size("v").alias("dim")).filter("dim > 0") for df in (vectors, queries))
    found = None
    largest = F.max(F.array_max(F.transform("v", F.abs)))
    # one row per dimension that queries have; tables of one embedding have one
    for row in vectors.join(queries.select("dim").distinct(), "dim", "left_semi").groupBy("dim").agg(F.count("*").alias("n"), largest.alias("unit")).orderBy("dim").collect():
        own = lambda df: df.filter(F.col("dim") == row["dim"]).select("vec_id", "v")  # noqa: B023, E731
        part = _top_k_of(own(vectors), own(queries), k, scale, row["dim"], row["n"], row["unit"] or 1.0)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found


#: A candidate: exact is null where the score fits 64 bits, else digits that sort as the score does.
_FOUND = "query_id long, vec_id long, score long, exact string"


def _shown(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    def exact(score: int) -> str | None:
        if LONG[0] <= score <= LONG[1]:
            return None
        digits = str(abs(score))
        key = f"{len(digits):06d}{digits}"
        return f"1{key}" if score > 0 else "0" + key.translate(str.maketrans("0123456789", "9876543210"))

    queries, ids, scores = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(ids, pa.int64()), pa.array([min(max(s, LONG[0]), LONG[1]) for s in scores], pa.int64()), pa.array(list(map(exact, scores)), pa.string())], names=["query_id", "vec_id", "score", "exact"])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id", "number").orderBy(F.desc("score"), F.desc_nulls_last("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _top_k_of(vectors: DataFrame, queries: DataFrame, k: int, scale: int, dim: int, n: int, unit: float) -> DataFrame:
    spark = vectors.sparkSession
    square = F.aggregate(F.transform("v", lambda x: (x / unit) * (x / unit)), F.lit(0.0), lambda a, x: a + x)
    top2 = float(vectors.agg(F.max(square)).first()[0])
    count = max(1, min(-(-n // BLOCK), PIVOT_BYTES // (8 * (dim + 1))))
    drawn = [r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()]  # bounded by PIVOT_BYTES
    bare = Space(dim, unit, top2, dim * (unit * scale) ** 2 < 2.0**62 if unit < 2.0**400 else False, scale, np.zeros((0, dim + 1)))
    space = replace(bare, pivots=bare.lifted(np.array(drawn, float).reshape(len(drawn), dim)))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        away = _to_pivots(space.lifted(_matrix(batch.column(1), dim)), space.pivots)
        near = away.argmin(1)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(near)), near])], names=["vec_id", "v", "pivot", "away"])

    placed = materialize(map_arrow(vectors, place, "vec_id long, v array<double>, pivot int, away double"), "placed")
    # a pivot with many vectors is cut into rings of distance, about a block each; sizes are a row per pivot
    sizes = placed.groupBy("pivot").agg(F.count("*").alias("rows"), F.max("away").alias("widest")).withColumn("rings", F.ceil(F.col("rows") / BLOCK))
    ring = F.least(F.floor(F.col("away") / F.greatest("widest", F.lit(1e-300)) * F.col("rings")), F.col("rings") - 1).cast("int")
    ringed = placed.join(F.broadcast(sizes.select("pivot", "widest", "rings")), "pivot").withColumn("ring", ring)  # bounded by PIVOT_BYTES
    # a ring may still be full, as where vectors are equal: parts by hash
    rings = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("rows"), F.min("away").alias("low"), F.max("away").alias("high"))
    rings = materialize(rings.withColumn("parts", F.ceil(F.col("rows") / BLOCK).cast("int")), "rings")
    dealt = ringed.join(rings.select("pivot", "ring", "parts"), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(17)), F.col("parts")).cast("int"))
    dealt = materialize(dealt.select("pivot", "ring", "part", "vec_id", "v"), "dealt")
    known = rings.orderBy("pivot", "ring").collect()  # as many as vectors have blocks, four numbers each
    table = np.array([(r["pivot"], r["ring"], r["parts"], r["low"], r["high"]) for r in known], float).reshape(len(known), 5)
    numbered = queries.withColumn("number", F.row_number().over(W.partitionBy("vec_id").orderBy("v")))  # ids may repeat

    def bounds(points: np.ndarray) -> np.ndarray:
        """The least distance that a vector of each ring can have to each query."""
        away = _to_pivots(points, space.pivots)[:, table[:, 0].astype(int)]
        return np.maximum(np.maximum(away - table[:, 4], table[:, 3] - away), 0)

    def first(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Each query with the ring that may be nearest."""
        best = bounds(space.asked(_matrix(batch.column(1), dim))).argmin(1)
        return _sent(batch, np.arange(len(best)), best, None)

    def others(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Each query with all rings but the first whose bound its k-th best score so far does not beat."""
        points = space.asked(_matrix(batch.column(1), dim))
        far = bounds(points)
        best, scores = far.argmin(1), np.array([-np.inf if x is None else x for x in batch.column(3).to_pylist()], float)
        scores = np.where(abs(scores) >= 2.0**62, -np.inf, scores) / (unit * scale) ** 2 if space.fits else np.full(len(scores), -np.inf)
        q2 = np.einsum("ij,ij->i", points, points)
        limit = np.where(scores == -np.inf, np.inf, np.sqrt(np.maximum(q2 + top2 - 2 * np.where(scores == -np.inf, 0, scores), 0)) + SLACK * np.sqrt(q2 + top2))
        could = far <= limit[:, None]
        could[np.arange(len(best)), best] = False
        return _sent(batch, *np.nonzero(could), scores)

    def _sent(batch: pa.RecordBatch, which: np.ndarray, to: np.ndarray, least: np.ndarray | None) -> pa.RecordBatch:
        """A row for each part of each ring that a query goes to."""
        parts = table[to, 2].astype(int)
        which, to = np.repeat(which, parts), np.repeat(to, parts)
        part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        floor = np.full(len(which), -np.inf) if least is None else least[which]
        rows = batch.take(pa.array(which))
        return pa.RecordBatch.from_arrays([*(pa.array(table[to, i].astype(np.int32)) for i in (0, 1)), pa.array(part.astype(np.int32)), *rows.columns[:3], pa.array(floor)], names=["pivot", "ring", "part", "vec_id", "v", "number", "least"])

    sent = "pivot int, ring int, part int, vec_id long, v array<double>, number int, least double"
    parts = parts_for(spark, -(-n // BLOCK), 1)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vecs, asked in _cells(batches, dim):
            tree = space.tree(vecs)
            for batch in asked:
                v = _matrix(batch.column("v"), dim)
                exact, points = integers(v, scale, space.fits), space.asked(v)
                out, numbers = [], []
                for i, (q, number, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("vec_id", "number", "least")), strict=True)):
                    got = tree.search(exact[i], points[i], k, ids, q, least)
                    out += [(q, j, s) for s, j in got]
                    numbers += [number] * len(got)
                if out:
                    rows = _shown(out)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(numbers, pa.int32())], names=[*rows.schema.names, "number"])

    def answered(asked: DataFrame) -> DataFrame:
        """Candidates of queries in blocks; a block that many queries ask is held by several tasks."""
        cells = materialize(asked, "asked")
        many = cells.groupBy("pivot", "ring", "part").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))
        here = cells.join(many, ["pivot", "ring", "part"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "number", F.lit(29)), F.col("blocks")).cast("int"))
        there = dealt.join(many, ["pivot", "ring", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        columns = ["pivot", "ring", "part", "block", "side", "vec_id", "v", "number", "least"]
        both = there.select("*", F.lit(0).alias("side"), F.lit(0).alias("number"), F.lit(0.0).alias("least")).select(columns).unionByName(here.withColumn("side", F.lit(1)).select(columns))
        cell = ["pivot", "ring", "part", "block"]
        return both.repartition(parts, *cell).sortWithinPartitions(*cell, "side", "vec_id").mapInArrow(answer, f"{_FOUND}, number int")

    asked = numbered.select("vec_id", "v", "number")
    nearest = materialize(_best(answered(map_arrow(asked, first, sent)), k), "nearest")
    beaten = nearest.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "number", F.col("score").alias("kth"))
    rest = map_arrow(asked.join(beaten, ["vec_id", "number"], "left").select("vec_id", "v", "number", "kth"), others, sent)
    merged = nearest.drop("rank").unionByName(answered(rest).select(nearest.drop("rank").columns))
    return _best(merged, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _cells(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, Iterator[pa.RecordBatch]]]:
    """Per cell of a sorted partition: ids and vectors, then its queries as they come; a block in memory at a time."""

    def pieces() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("pivot", "ring", "part", "block", "side")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield tuple(keys[a].tolist()), batch.slice(a, b - a)

    for cell, group in groupby(pieces(), key=lambda x: x[0][:4]):
        sides = groupby((x for x in group), key=lambda x: x[0][4])
        held: list[pa.RecordBatch] = []
        for side, rows in sides:
            if side == 0:
                held = [batch for _, batch in rows]
            elif held:
                ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
                yield ids, np.concatenate([_matrix(b.column("v"), dim) for b in held]), (batch for _, batch in rows)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: ids divisible by 50; candidates: every other row."""
    with scratch() as keep:
        vectors = materialize(quantized(table(spark, sf_dir, "embeddings")), "vectors")
        return keep(materialize(top_k(vectors, vectors.filter("vec_id % 50 = 0")), "top"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
