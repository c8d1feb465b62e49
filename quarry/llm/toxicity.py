"""Toxicity: Levenshtein automata over a lexicon trie, weighed by context windows.

The lexicon is learned: words, and stems that many words share, which labelled toxic
documents have and clean ones have not. It becomes a trie; each distinct word of a text
runs through the trie as a Levenshtein automaton, so misspelled terms are caught without
listing spellings. A spelling that clean documents use is no misspelling. Around each
match a window of words tells quotation and report from abuse. A logistic model, fitted
with a prior, turns the matches of a whole text into a score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, materialize, pick, released, small_batches, table
from quarry.llm.quality import in_fold, training_rows

#: Labelled rows that are fitted on, at most.
SAMPLE = 30_000
FOLDS, HELD = 4, 2
THRESHOLD = 0.3
STEM = range(4, 13)
#: The least log odds of a term, and the least documents and share of toxic documents with it.
LEAST_ODDS, LEAST_DOCS, LEAST_SHARE = 2.7, 5, 0.004
#: How many different terms of the lexicon a toxic document is to meet, and the least new documents for a term.
COVER, LEAST_GAIN = 5, 3
#: Words, and stems, at least this long are also found at an edit distance of 1.
FUZZY_LENGTH, FUZZY_STEM = 5, 6
#: Words on each side of a match that tell its context.
WINDOW = 6

_WORD = re.compile(r"[^\W\d_]+")
_UNIT = re.compile(r"[^\W\d_]+|[\"“”„«»‘’`]|[^\w\s]+|[\d_]+")
# Quotation marks, and words of report and of denial, in the corpus's languages.
QUOTES = frozenset("\"“”„«»‘’`")
REPORTS = frozenset(
    "said says called calls quoted quote quotes wrote writes word term phrase insult insults slur defined means "
    "sagte sagt nannte zitat wort begriff schrieb dijo dice palabra cita llamó escribió dit disait mot cité appelé écrit not never".split()
)


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return _WORD.findall(text.lower())


@dataclass
class Lexicon:
    """A trie of terms with weights, matched by Levenshtein automata."""

    terms: tuple[tuple[str, bool, float], ...]  # (letters, whether a stem, log odds)
    spelled: frozenset[str] = frozenset()  # spellings near a term that clean documents use
    memo: dict[str, tuple[float, int]] = field(default_factory=dict, repr=False)

    MEMO = 500_000  # words remembered at once; more are looked up again

    def __post_init__(self) -> None:
        self.root: dict = {}
        self.exact: dict[str, float] = {}
        self.stems: dict[str, float] = {}
        # one edit leaves a term's first half where it was, or its second half within a place
        self.heads: dict[int, set[str]] = {}
        self.ends: dict[int, set[str]] = {}
        self.middles: dict[tuple[int, int], set[str]] = {}
        for letters, stem, weight in self.terms:
            (self.stems if stem else self.exact)[letters] = weight
            if len(letters) >= (FUZZY_STEM if stem else FUZZY_LENGTH):
                node = self.root
                for letter in letters:
                    node = node.setdefault(letter, {})
                node[""] = (stem, weight)
                half = len(letters) // 2
                tail = letters[half:]
                self.heads.setdefault(half, set()).add(letters[:half])
                if stem:
                    for at in (half - 1, half, half + 1):
                        self.middles.setdefault((at, at + len(tail)), set()).add(tail)
                else:
                    self.ends.setdefault(-len(tail), set()).add(tail)
        self.sizes = sorted({len(x) for x in self.stems})

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memo": {}}

    def find(self, word: str) -> tuple[float, int]:
        """(weight, edits) of the best term that the word matches; weight 0 for none."""
        if (got := self.memo.get(word)) is None:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            got = self.memo[word] = self._find(word)
        return got

    def terms_of(self, word: str) -> list[str]:
        """The terms that the word is, or begins with."""
        return [t for t in (word, *(word[:n] for n in self.sizes if n <= len(word))) if (t in self.stems or (t == word and t in self.exact))]

    def _find(self, word: str) -> tuple[float, int]:
        best = self.exact.get(word, 0.0)
        for n in self.sizes:
            best = max(best, self.stems.get(word[:n], 0.0) if n <= len(word) else 0.0)
        if best:
            return best, 0
        if word in self.spelled or not self._may_be_near(word):
            return 0.0, 0
        return self.near(word), 1

    def _may_be_near(self, word: str) -> bool:
        """Whether the word has a half of some term in its place: most words have none."""
        for n, known in self.heads.items():
            if word[:n] in known:
                return True
        for n, known in self.ends.items():
            if word[n:] in known:
                return True
        for (a, b), known in self.middles.items():
            if word[a:b] in known:
                return True
        return False

    def near(self, word: str) -> float:
        """The largest weight of a term within one edit of the word (a stem: of the word's start)."""
        best, size = 0.0, len(word)
        # a state is the automaton's set of (letters of the word used, edits), depth first over the trie
        todo = [(self.root, ((0, 0), (1, 1)))]
        while todo:
            node, state = todo.pop()
            if "" in node:
                stem, weight = node[""]
                if weight > best and any(i == size or (stem and i <= size) or (i == size - 1 and e == 0) for i, e in state):
                    best = weight
            for letter, child in node.items():
                if not letter:
                    continue
                reached = set()
                for i, e in state:
                    if i < size and word[i] == letter:
                        reached.add((i + 1, e))
                        if not e:
                            reached.add((i + 2, 1)) if i + 1 < size else None  # a letter too many comes next
                    if not e:
                        reached.add((i, 1))  # a letter is missing
                        if i < size:
                            reached.add((i + 1, 1))  # a letter is another
                if reached:
                    todo.append((child, tuple(reached)))
        return best


FEATURES = ("plain", "misspelled", "quoted", "share")


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Log weights of plain, misspelled and quoted matches, and the share of words that match."""
    found = Counter(words(text))
    hits = {w: got for w in found if (got := lexicon.find(w))[0] > 0}
    if not hits:
        return [0.0] * len(FEATURES)
    units = _UNIT.findall(text.lower())
    sums = [0.0, 0.0, 0.0]
    quotes = np.cumsum([u in QUOTES for u in units])
    for i, unit in enumerate(units):
        if unit in hits:
            weight, edits = hits[unit]
            before, after = units[max(0, i - WINDOW) : i], units[i + 1 : i + 1 + WINDOW]
            inside = quotes[i] % 2 == 1 and not QUOTES.isdisjoint(before) and not QUOTES.isdisjoint(after)
            kind = 2 if inside or not REPORTS.isdisjoint(before) else 1 if edits else 0
            sums[kind] += weight
    return [*map(math.log1p, sums), math.log1p(1000 * sum(found[w] for w in hits) / sum(found.values())) / 10]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]  # the last is the constant

    def score(self, text: str | None) -> float:
        """Between 0 and 1; empty and null texts get the score of no match."""
        x = sum(w * f for w, f in zip(self.weights, (*features(text or "", self.lexicon), 1.0), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


#: What the model believes before it sees a label: a match counts, a misspelled one less, a quoted one little.
PRIOR = np.array([3.0, 2.0, 0.3, 0.0, -3.5])
PRIOR_STRENGTH = np.array([1.0, 20.0, 20.0, 1.0, 1.0])


def fit(rows: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic weights by Newton steps, held to PRIOR."""
    weights = PRIOR.copy()
    x = np.concatenate([rows.reshape(-1, len(FEATURES)), np.ones((len(labels), 1))], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (labels - p) - PRIOR_STRENGTH * (weights - PRIOR)
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(PRIOR_STRENGTH)
        step = np.linalg.solve(bend, slope)
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(weights.tolist())


def learn_terms(rows: DataFrame) -> tuple[tuple[tuple[str, bool, float], ...], DataFrame]:
    """Terms of the lexicon, and (word, toxic, clean): in how many documents of each kind each word is."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(set(words(text or "")))
        every = sorted(set(toxic) | set(clean))
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([toxic[w] for w in every], pa.int64()), pa.array([clean[w] for w in every], pa.int64())], names=["word", "toxic", "clean"])

    totals = rows.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    n_toxic, n_clean = totals["toxic"] or 0, totals["clean"] or 0
    by_word = materialize(map_arrow(rows, count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "by_word")
    stems = by_word.select(F.explode(F.array_distinct(F.concat(F.transform(F.array(*map(F.lit, STEM)), lambda n: F.substring("word", 1, n)), F.array("word")))).alias("letters"), "word", "toxic", "clean").filter(F.length("letters") >= STEM[0])
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    by_stem = stems.groupBy("letters").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("forms"), F.max(F.when(F.col("word") == F.col("letters"), F.col("toxic"))).alias("own")).withColumn("odds", odds)
    enough = max(LEAST_DOCS, LEAST_SHARE * n_toxic)
    # as many as the toxic documents of the sample have words, at most
    found = by_stem.filter((F.col("toxic") >= enough) & (F.col("odds") >= LEAST_ODDS)).collect()
    return choose(found), by_word


def choose(found: list) -> tuple[tuple[str, bool, float], ...]:
    """Of nested stems, the shortest whose odds hold, made as long as its documents allow."""
    known = {r["letters"]: r for r in found}
    ordered = sorted(known)
    taken: dict[str, tuple[str, bool, float]] = {}
    for r in sorted(found, key=lambda r: (len(r["letters"]), r["letters"])):
        letters = r["letters"]
        if any(letters[:n] in taken for n in range(1, len(letters) + 1)):
            continue
        longer = letters
        extensions = ordered[bisect_left(ordered, letters) : bisect_left(ordered, letters + chr(0x10FFFF))]
        for other in sorted(extensions, key=len):
            if known[other]["toxic"] >= 0.97 * r["toxic"] and known[other]["clean"] <= r["clean"]:
                longer = other
        row = known[longer]
        word_only = (row["own"] or 0) >= 0.97 * row["toxic"]
        taken[letters] = (longer, not word_only, float(row["odds"]))
    return tuple(sorted(taken.values()))


def needed(terms: tuple[tuple[str, bool, float], ...], rows: DataFrame) -> tuple[tuple[str, bool, float], ...]:
    """The terms that it takes to meet every toxic document COVER times, most new documents first.

    Words that merely come with toxic documents, such as those of a text with many copies,
    add nothing to what the others meet, and go. A term whose odds hold in the documents
    that have none of the others stays, however few those are.
    """
    bare = Lexicon(terms)

    def meet(batch: pa.RecordBatch) -> pa.RecordBatch:
        met = [sorted({t for w in set(words(x or "")) for t in bare.terms_of(w)}) for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(met, pa.list_(pa.string()))], names=["met"])

    def lists(label: int) -> list[list[str]]:
        """The terms of each document of the sample that has this label and any term."""
        met_by = map_arrow(rows.filter(F.col("label") == label).select("text"), meet, "met array<string>")
        return sorted(r["met"] for r in met_by.filter("size(met) > 0").collect())

    toxic = lists(1)
    left, taken = [COVER] * len(toxic), set()
    while True:
        gain = Counter(t for k, met in enumerate(toxic) if left[k] for t in met if t not in taken)
        best = min(gain, key=lambda t: (-gain[t], t), default=None)
        if best is None or gain[best] < LEAST_GAIN:
            break
        taken.add(best)
        left = [n - 1 if n and best in met else n for n, met in zip(left, toxic, strict=True)]
    alone = Counter(t for met in toxic if taken.isdisjoint(met) for t in met)
    if alone:
        clean = Counter(t for met in lists(0) if taken.isdisjoint(met) for t in met)
        total = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        taken |= {t for t, n in alone.items() if math.log((n + 0.5) / (total[1] + 1)) - math.log((clean[t] + 0.5) / (total.get(0, 0) + 1)) >= LEAST_ODDS}
    return tuple(t for t in terms if t[0] in taken)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and weights from labels outside the held fold; reads text only of the documents.

    Without toxic labels the lexicon is empty and every score is the prior's.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = materialize(training_rows(docs, labels, "toxic", FOLDS, HELD, sample), "labelled")
    terms, by_word = learn_terms(rows)
    terms = needed(terms, rows)
    bare = Lexicon(terms)

    def near(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = [w for w in batch.column(0).to_pylist() if (got := bare.find(w))[0] and got[1]]
        return pa.RecordBatch.from_arrays([pa.array(hits, pa.string())], names=["word"])

    # all words one edit away from a term that clean documents of the sample use twice
    spelled = map_arrow(by_word.filter("clean >= 2").select("word"), near, "word string").collect()
    lexicon = Lexicon(terms, frozenset(r["word"] for r in spelled))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([features(x or "", lexicon) for x in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    got = sorted((r["label"], r["x"]) for r in map_arrow(rows, measure, "x array<double>, label int").collect())
    released(rows, by_word)
    return Model(lexicon, fit(np.array([x for _, x in got]), np.array([y for y, _ in got], float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, in any table order.

    Null texts are empty; empty and very long texts are scored like others, whole; null ids
    are not held out; rows that repeat get equal scores, each its row; a score at the
    threshold counts as above it; other columns are ignored; an empty table gives no rows.
    """

    def rate(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [model.score(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array([int(x >= THRESHOLD) for x in got], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id="long", text="string").select("doc_id", in_fold("doc_id", FOLDS, HELD).alias("held_out"), "text")
    return map_arrow(rows, rate, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text the model doesn't reject, all columns as they are."""

    @F.pandas_udf("boolean")
    def keeps(texts):
        return texts.map(lambda x: model.score(x) < THRESHOLD).astype(bool)

    small_batches(docs.sparkSession)
    return docs.filter(keeps(F.col("text").cast("string")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
