"""One object over store, index and models: what an application calls."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import ARM_DEPTH, RERANK_DEPTH, EngineConfig, bm25_parameters, check_query, check_top_k, prf_options
from quarry.functions.vectors import with_vectors
from quarry.operators import catalog, dense, feedback, fusion, lexical, rag, rerank


@dataclass
class Engine:
    spark: SparkSession
    config: EngineConfig = field(default_factory=EngineConfig)
    models: dict[str, Callable[[], rag.Model]] = field(default_factory=lambda: {"local": rag.Extractive})
    scorer: Callable[[], rerank.PairScorer] | None = None

    @cached_property
    def store(self) -> catalog.Store:
        return catalog.Store(self.spark, self.config.root, self.config)

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version, "store_version": self.store.manifest()["version"]}

    # -- documents --------------------------------------------------------------------

    def ingest_files(self, path: str) -> DataFrame:
        self._forget()
        return self.store.ingest_files(path)

    def ingest_pages(self, pages: DataFrame) -> DataFrame:
        self._forget()
        return self.store.ingest_pages(pages)

    def list_documents(self, limit: int = 20, offset: int = 0, source_type: str | None = None, status: str | None = None) -> tuple[DataFrame, int]:
        return self.store.listing(limit, offset, source_type, status)

    def get_document(self, document_id: str) -> DataFrame:
        return self.store.get(document_id)

    def delete_document(self, document_id: str) -> bool:
        self._forget()
        return self.store.delete(document_id)

    def keyword_stats(self) -> dict:
        return {k: v for k, v in self.store.stats().items() if k != "vector_count"}

    def vector_stats(self) -> dict:
        return {"chunk_count": self.store.table("vectors").count()}

    def reindex_vectors(self, overwrite: bool = False, embed: Callable[[DataFrame], DataFrame] | None = None) -> dict:
        make = embed or self._with_vectors
        vectors, report = dense.reindexed(self.store.table("chunks"), make, self.store.table("vectors").count(), overwrite)
        self.store.replace_vectors(vectors)
        return report

    def reset_vectors(self) -> None:
        """Takes all vectors out; the lexical index stays."""
        self.store.reset_vectors()

    def _with_vectors(self, df: DataFrame) -> DataFrame:
        return with_vectors(df, "text", self.config.embedder, self.config.embedding_dims)

    # -- search -----------------------------------------------------------------------

    @cached_property
    def index(self):
        return self.store.index()

    def _forget(self) -> None:
        self.__dict__.pop("index", None)

    def _asked(self, query: str) -> DataFrame:
        check_query(query)
        return self.spark.createDataFrame([("q", query)], "query_id string, text string")

    def _hydrated(self, hits: DataFrame) -> DataFrame:
        return catalog.hydrate(hits, self.store.table("chunks"), self.store.table("documents").withColumn("title", F.coalesce("title", F.lit(""))))

    def _lexical(self, query: str, top_k: int, scoring: str, use_prf: bool, use_reranker: bool, k1: float, b: float, mode: str, prf: dict) -> DataFrame:
        check_top_k(top_k, 50)
        asked = self._asked(query)
        depth = RERANK_DEPTH if use_reranker else top_k
        if use_prf:
            hits = feedback.search_with_feedback(asked, self.index, depth, **prf_options(self.config, **prf), scoring=scoring, mode=mode, k1=k1, b=b).hits
        elif scoring == "tfidf":
            hits = lexical.search_tfidf(asked, self.index, depth, mode)
        else:
            hits = lexical.search_bm25(asked, self.index, depth, mode, k1=k1, b=b)
        rows = self._hydrated(hits).drop("document_id_2")
        return rerank.rerank(rows, asked, self.scorer, min(top_k, RERANK_DEPTH)) if use_reranker else rows.withColumn("rerank_score", F.lit(None).cast("double"))

    def search_tfidf(self, query: str, top_k: int = 10, use_prf: bool = False, use_reranker: bool = False, retrieval_mode: str = "champion", **prf) -> DataFrame:
        return self._lexical(query, top_k, "tfidf", use_prf, use_reranker, self.config.bm25_k1, self.config.bm25_b, retrieval_mode, prf)

    def search_bm25(self, query: str, top_k: int = 10, mode: str | None = None, k1: float | None = None, b: float | None = None, use_prf: bool = False, use_reranker: bool = False, retrieval_mode: str = "champion", **prf) -> DataFrame:
        k1, b = bm25_parameters(mode, k1, b, (self.config.bm25_k1, self.config.bm25_b))
        return self._lexical(query, top_k, "bm25", use_prf, use_reranker, k1, b, retrieval_mode, prf)

    def search_semantic(self, query: str, top_k: int = 10) -> DataFrame:
        check_top_k(top_k, 50)
        asked = self._with_vectors(self._asked(query)).select("query_id", "embedding")
        return self._hydrated(dense.nearest(self.store.table("vectors"), asked, top_k).join(self.store.table("vectors").select("chunk_id", "document_id"), "chunk_id"))

    def rag(self, query: str, top_k: int = 4, provider: str | None = None, use_reranker: bool = False, use_query_rewrite: bool = False) -> dict:
        """An answer with cited chunks, or why there is none."""
        check_top_k(top_k, 8)
        asked = self._asked(query)
        make = self.models.get(provider or "local") or (lambda: rag.choose_model(self.models, provider))
        rewritten = rag.rewrite(query, make()) if use_query_rewrite else None
        wanted = self._asked(rewritten) if rewritten else asked  # the rewritten query is for the dense arm only
        vectors = self._with_vectors(wanted).select("query_id", "embedding")
        near = dense.nearest(self.store.table("vectors"), vectors, ARM_DEPTH)
        if self.index.stats.first()["n_postings"]:
            found = lexical.search_bm25(asked, self.index, ARM_DEPTH, k1=self.config.bm25_k1, b=self.config.bm25_b)
            arms = fusion.fused(near, found)
        else:
            arms = fusion.dense_only(near)
        pool = arms.join(self.store.table("chunks").select("chunk_id", "document_id"), "chunk_id")
        evidence = fusion.with_evidence(self._hydrated(pool), asked, self.index, self.config.coverage_min, self.config.idf_coverage_min)
        if use_reranker:
            evidence = rerank.rerank(evidence, asked, self.scorer, RERANK_DEPTH)
        selected = fusion.select_context(evidence, top_k)
        gated = fusion.gate(selected, asked, self.config.min_retrieval_score)
        row = rag.outcomes(asked, selected, gated, make, self.config.group_sentences).first()
        return row.asDict(recursive=True) | {"rewritten_query": rewritten}
