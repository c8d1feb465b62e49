"""Vector expressions, and embedders behind a small port."""

from __future__ import annotations

import json
import math
import re
import urllib.request
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: As the analyzer's tokens: letters and digits, with one apostrophe suffix.
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - dot(a, b) / size).otherwise(F.lit(1.0))


def clamped_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def normalised(a: Column) -> Column:
    """Unit length; null for a zero vector and for null or non-finite components."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad & (norm(a) > 0), F.transform(a, lambda x: x / norm(a)))


def checked_unit(vector: list[float], dims: int | None = None) -> list[float]:
    """A vector an embedder gave, as a unit vector; ValueError says what is wrong with it."""
    if not isinstance(vector, (list, tuple)) or not vector:
        raise ValueError("an embedding must be a list of numbers")
    if dims is not None and len(vector) != dims:
        raise ValueError(f"an embedding has {len(vector)} dimensions, not {dims}")
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in vector):
        raise ValueError("an embedding must hold finite numbers")
    size = math.sqrt(math.fsum(x * x for x in vector))
    if size == 0:
        raise ValueError("an embedding must not be zero")
    return [x / size for x in vector]


class HashEmbedder:
    """The offline embedder: each token counts in the bin of its code points' sum; unit length, or zeros."""

    def __init__(self, dims: int = 8) -> None:
        self.dims, self.bins = dims, {}

    def _bin(self, token: str) -> int:
        if (got := self.bins.get(token)) is None:
            if len(self.bins) >= 200_000:  # a memory of tokens, not a limit on them
                self.bins.clear()
            got = self.bins[token] = sum(map(ord, token.lower().replace("ß", "ss"))) % self.dims
        return got

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            counts = [0.0] * self.dims
            for token in _TOKEN.findall(text):
                counts[self._bin(token)] += 1
            size = math.sqrt(sum(x * x for x in counts))
            out.append([x / size for x in counts] if size else counts)
        return out

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]


def hash_embedding(text: Column, dims: int = 8) -> Column:
    """The offline embedder as a column, in Arrow batches."""
    from pyspark.sql import SparkSession

    from quarry.sources.work import python_ready

    python_ready(SparkSession.active())

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = HashEmbedder(dims)
        for texts in batches:
            yield pd.Series(model.embed_documents([t or "" for t in texts]))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<double>")(text)


class Embedder(Protocol):
    """What an embedding model must offer."""

    def embed_documents(self, texts: list[str]) -> list[list[float]]: ...

    def embed_query(self, text: str) -> list[float]: ...


class VocabularyEmbedder:
    """Counts of a few words; for tests and examples."""

    def __init__(self, words: tuple[str, ...] = ("retrieval", "database", "neural")) -> None:
        self.words = words

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            counts = [float(text.lower().split().count(w)) for w in self.words]
            size = math.sqrt(sum(x * x for x in counts))
            out.append([x / size for x in counts] if size else counts)
        return out

    def embed_query(self, text: str) -> list[float]:
        if not text.strip():
            raise ValueError("a query must not be blank")
        return self.embed_documents([text])[0]


class HttpEmbedder:
    """One JSON request per text to an embedding service; `send` may be replaced."""

    def __init__(self, url: str, model: str, key: str = "", dims: int | None = None, send: Callable[[str, dict], dict] | None = None) -> None:
        self.url, self.model, self.key, self.dims, self.send = url, model, key, dims, send or self._send

    def _send(self, url: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=60) as got:
            return json.load(got)

    def _one(self, text: str, task: str) -> list[float]:
        return checked_unit(self.send(self.url, {"model": self.model, "input": text, "task": task}).get("embedding"), self.dims)

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        return [self._one(t, "document") for t in texts]

    def embed_query(self, text: str) -> list[float]:
        if not text.strip():
            raise ValueError("a query must not be blank")
        return self._one(text, "query")


_makers: dict[str, Callable[[], Embedder]] = {"hash": HashEmbedder, "vocabulary": VocabularyEmbedder}


def register_embedder(name: str, make: Callable[[], Embedder]) -> None:
    _makers[name] = make
    embedder.cache_clear()


@lru_cache(maxsize=8)
def embedder(name: str) -> Embedder:
    """The embedder of this name, made once per process; an unknown name is an error, never another embedder."""
    if name not in _makers:
        raise ValueError(f"unknown embedder {name}")
    return _makers[name]()


def with_vectors(df: DataFrame, text: str, name: str, dims: int, out: str = "embedding") -> DataFrame:
    """df with vectors by the embedder of this name; the hash one has as many dimensions as asked, the others their own."""
    if name == "hash":
        return df.withColumn(out, hash_embedding(F.col(text), dims))
    if name not in _makers:
        raise ValueError(f"unknown embedder {name}")
    return embedded(df, text, _makers[name], out=out)


def embedded(df: DataFrame, text: str, make: Callable[[], Embedder], batch: int = 32, out: str = "embedding") -> DataFrame:
    """df with vectors from a model that each worker loads once and feeds in batches."""
    from quarry.sources.work import python_ready

    python_ready(df.sparkSession)

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in series:
            got: list[list[float]] = []
            for a in range(0, len(texts), batch):
                some = [t or "" for t in texts.iloc[a : a + batch]]
                vectors = model.embed_documents(some)
                if len(vectors) != len(some):
                    raise ValueError("the embedder returned another number of vectors")
                got += vectors
            yield pd.Series(got)

    return df.withColumn(out, run(text))
