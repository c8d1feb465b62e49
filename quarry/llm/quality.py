"""Quality classifier: Bradley-Terry scores learned from preference pairs.

Every labelled document of label 1 is preferred to one of label 0; the model is a weight
per feature, fitted by logistic loss on the differences of the pairs' features. What
Bradley-Terry learns is an order, not a level, so a threshold comes from a quantile of the
training scores: the share of label 0 among them. Scores are the logistic function of the
distance to that threshold, so 0.5 is the cut.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, materialize, pick, scratch, small_batches, table, utf8

#: Labelled rows among which pairs are made; more rows are fitted on in blocks of about so many, by the hash of their id.
BLOCK = 20_000
#: Rows of the rarer label that a block is meant to have at least, which makes blocks larger if need be.
RARER = 100
#: Bins of the scores among which the cut is looked for.
BINS = 4096
#: Preference pairs that each row of the larger class is in; a row of the smaller one is in as many or more.
ROUNDS = 4
FOLDS, HELD = 3, 1

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?", "bang": b"!", "bar": b"|", "junk": b"%$&*#@^~=+<>{}[]\\/_", "quote": b"\"'()-", "line": b"\n"}
NAMES = ("log_words", "word_bytes", *_CLASSES, "beyond_ascii", "distinct_words", "most_frequent", "repeated_lines", "line_words", "long_words", "upper_words", "junk_words", "barred", "sentence_words", "packed", "repeated_fives", "short_share")


def features(text: bytes) -> list[float]:
    """Figures of a text's form; whole text, any length; all 0 but the first few for an empty one."""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    shares = [(size - len(text.translate(None, chars)) - (not text)) / size for chars in _CLASSES.values()]
    lines = [x for x in text.split(b"\n") if x]
    counts, some = Counter(words), max(n, 1)
    fives = list(zip(*(words[i:] for i in range(5)), strict=False))
    return [
        float(np.log1p(n)),
        len(text) / some,
        *shares,
        (size - len(text.translate(None, bytes(range(128, 256)))) - (not text)) / size,
        len(counts) / some,
        max(counts.values(), default=0) / some,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        float(np.log1p(some / max(len(lines), 1))),
        sum(c for w, c in counts.items() if len(w) > 20) / some,
        sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / some,
        sum(c for w, c in counts.items() if w[-1:] in b"%$&*#!") / some,
        counts.get(b"|", 0) / some,
        float(np.log1p(some / (1 + len(re.findall(rb"[.!?](?:\s|$)", text))))),
        len(zlib.compress(text, 1)) / size if n else 0.0,
        1 - len(set(fives)) / len(fives) if fives else 0.0,
        sum(c for w, c in counts.items() if len(w) <= 3) / some,
    ]


@dataclass(frozen=True)
class Model:
    """Weights over standardised features, and the score that is the cut."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; at least 0.5 from the cut on."""
        return 1 / (1 + np.exp(-np.clip(self.strength(rows) - self.cut, -30, 30)))

    def strength(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.spread, -6, 6) @ self.weights


def preference_pairs(good: np.ndarray, bad: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(preferred, other): every row of the larger class with `rounds` rows of the other, which it deals through in turn."""
    draw = np.random.default_rng(seed)
    most, least = max(len(good), len(bad)), min(len(good), len(bad))
    many, few = [], []
    for _ in range(rounds):
        many.append(draw.permutation(most))
        few.append(draw.permutation(least)[np.arange(most) % least])
    many, few = np.concatenate(many), np.concatenate(few)
    return (good[many], bad[few]) if len(good) >= len(bad) else (good[few], bad[many])


def fit(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, ridge: float = 1e-3, seed: int = 7) -> Model:
    """Bradley-Terry by Newton steps on logistic loss; without both labels, every score is 0.5."""
    width = rows.shape[1] if rows.ndim == 2 else len(NAMES)
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean, spread = rows.mean(0), rows.std(0) + 1e-9
    z = np.clip((rows - mean) / spread, -6, 6)
    preferred, other = preference_pairs(good, bad, rounds, seed)
    differences = z[preferred] - z[other]
    weights = np.zeros(width)
    for _ in range(25):
        lost = 1 / (1 + np.exp(np.clip(differences @ weights, -30, 30)))
        slope = differences.T @ lost / len(differences) - ridge * weights
        bend = (differences * (lost * (1 - lost))[:, None]).T @ differences / len(differences) + ridge * np.eye(width)
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    ordered = np.sort(z @ weights)
    return Model(mean, spread, weights, float(np.quantile(ordered, len(bad) / (len(good) + len(bad)))))


def in_fold(column: str, folds: int, fold: int):
    """Whether crc32 of the id as text leaves this remainder; null ids are in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_ids(labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, label) outside the held fold, each once; where labels contradict each other, both count."""
    return pick(labels, doc_id="long", **{label: "int"}).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold("doc_id", folds, held)).dropDuplicates()


def texts_of(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label); where documents repeat an id, the text that sorts first stands for it."""
    found = pick(docs, doc_id="long", text="string").join(ids, "doc_id")
    return found.groupBy("doc_id", label).agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("doc_id", "text", F.col(label).alias("label"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, sample: int) -> DataFrame:
    """(text, label) of at most `sample` labelled ids outside the held fold, smallest id hashes first, each id and label once.

    Where documents repeat an id, the text that sorts first stands for it; where labels
    contradict each other, both count.
    """
    chosen = labelled_ids(labels, label, folds, held).orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(sample)
    # at most `sample` ids and labels: the bound holds at any size of the corpus
    return texts_of(docs, F.broadcast(chosen), label).select("text", "label")


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, column: str, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of make(a batch of a list column as a matrix); a task passes on one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    return np.sum([r["s"] for r in rows.select(column).mapInArrow(run, "s array<double>").collect()], axis=0)


def fit_blocks(rows: DataFrame, rounds: int = ROUNDS, ridge: float = 1e-3, seed: int = 7) -> Model:
    """`fit` on a table (block, label, x) of any size: pairs are made within blocks, sums and the cut are of all rows."""
    width = len(NAMES)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = sum(sizes.values())
    if len(sizes) < 2:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0)
    mean = summed(rows, "x", lambda x: x.sum(0)) / n
    spread = np.sqrt(summed(rows, "x", lambda x: ((x - mean) ** 2).sum(0)) / n) + 1e-9

    def paired(group: pa.Table) -> pa.Table:
        got = sorted(zip(group.column("label").to_pylist(), group.column("x").to_pylist(), strict=True))
        y = np.array([label for label, _ in got])
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        z = np.clip((np.array([x for _, x in got]) - mean) / spread, -6, 6)
        preferred, other = preference_pairs(good, bad, rounds, seed + group.column("block")[0].as_py()) if len(good) and len(bad) else (good[:0], bad[:0])
        flat = (z[preferred] - z[other]).ravel()
        return pa.table([pa.ListArray.from_arrays(pa.array(np.arange(len(preferred) + 1) * width, pa.int32()), pa.array(flat))], names=["d"])

    pairs = materialize(rows.groupBy("block").applyInArrow(paired, "d array<double>"), "pairs")
    n_pairs, weights = pairs.count(), np.zeros(width)

    def slopes(d: np.ndarray) -> np.ndarray:
        lost = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
        return np.concatenate([d.T @ lost, ((d * (lost * (1 - lost))[:, None]).T @ d).ravel()])

    for _ in range(25 if n_pairs else 0):
        got = summed(pairs, "d", slopes) / n_pairs
        step = np.linalg.solve(got[width:].reshape(width, width) + ridge * np.eye(width), got[:width] - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    model = Model(mean, spread, weights, 0.0)

    def strengths(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(model.strength(_matrix(batch.column(0))))], names=["s"])

    scores = materialize(map_arrow(rows.select("x"), strengths, "s double"), "strengths")
    return Model(mean, spread, weights, quantile(scores, sizes[0] / n, n))


def quantile(scores: DataFrame, share: float, n: int) -> float:
    """np.quantile of a table's column s of n rows: a histogram leads to the bins that hold the value, whose distinct scores are counted."""
    least, most = scores.agg(F.min("s"), F.max("s")).first()
    if most <= least:
        return float(least)
    binned = scores.withColumn("b", F.floor((F.col("s") - least) / (most - least) * BINS))
    at = share * (n - 1)
    ranks = [int(np.floor(at)), int(np.ceil(at))]
    counts = sorted((r["b"], r["count"]) for r in binned.groupBy("b").count().collect())
    ends = np.cumsum([c for _, c in counts])
    first, last = np.searchsorted(ends, ranks, "right")
    values = sorted((r["s"], r["count"]) for r in binned.filter(F.col("b").between(counts[first][0], counts[last][0])).groupBy("s").count().collect())
    before = ends[first] - counts[first][1]
    low, high = (values[i][0] for i in np.searchsorted(before + np.cumsum([c for _, c in values]), ranks, "right"))
    return float(low + (high - low) * (at - ranks[0]))


def train(docs: DataFrame, labels: DataFrame, block: int = BLOCK, rounds: int = ROUNDS) -> Model:
    """Fit on all labels outside the held fold; reads text only of the documents."""

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([features(x) for x in utf8(batch.column(1))], pa.list_(pa.float64()))], names=["block", "label", "x"])

    small_batches(docs.sparkSession)
    with scratch():
        ids = materialize(labelled_ids(labels, "quality", FOLDS, HELD), "labelled")
        sizes = [r["count"] for r in ids.groupBy("quality").count().collect()]
        n, rarer = sum(sizes), min(sizes, default=0)
        blocks = max(1, min(-(-n // block), rarer // RARER))
        # as many ids as a task holds with ease are sent to all; more are joined by shuffle
        rows = texts_of(docs, F.broadcast(ids) if n <= 1_000_000 else ids, "quality").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
        measured = map_arrow(rows.select("block", "text", "label"), measure, "block int, label int, x array<double>")
        if n > block:
            return fit_blocks(materialize(measured, "measured"), rounds)
        got = sorted((r["label"], r["x"]) for r in measured.collect())
        return fit(np.array([x for _, x in got]).reshape(len(got), len(NAMES)), np.array([y for y, _ in got], int), rounds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, in any table order.

    Null texts are empty; empty and very long texts are scored like others, whole; null ids
    are not held out; rows that repeat get equal scores, each its row; a score at the
    threshold counts as above it; other columns are ignored; an empty table gives no rows.
    """

    def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = model.scores(np.array([features(x) for x in utf8(batch.column(2))]))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id="long", text="string").select("doc_id", in_fold("doc_id", FOLDS, HELD).alias("held_out"), "text")
    return map_arrow(rows, rate, "doc_id long, held_out boolean, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
