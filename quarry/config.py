"""Engine settings: one frozen object, from QUARRY_* environment variables or keywords."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, fields, replace

# Defaults that results depend on.
CHUNK_SIZE, CHUNK_OVERLAP = 500, 75
CHAMPION_SIZE = 50
K1, B = 1.5, 0.75
FEEDBACK_DOCS, EXPANSION_TERMS, ALPHA, BETA = 5, 10, 1.0, 0.75
RRF_K, ARM_DEPTH = 60, 20
DENSE_FLOOR, COVERAGE_FLOOR, IDF_COVERAGE_FLOOR, GROUP_SENTENCES = 0.30, 0.60, 0.40, 2
RERANK_DEPTH = 25
MOST_K1, MOST_FEEDBACK, MOST_EXPANSION, MOST_URL = 10.0, 50, 100, 2000
MAX_UPLOAD_BYTES, MAX_PAGE_BYTES, MAX_REDIRECTS, FETCH_SECONDS = 25 << 20, 5 << 20, 5, 10


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class EngineConfig:
    root: str = "./quarry-data"
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    champion_size: int = CHAMPION_SIZE
    stem: bool = True
    bm25_k1: float = K1
    bm25_b: float = B
    feedback_docs: int = FEEDBACK_DOCS
    expansion_terms: int = EXPANSION_TERMS
    prf_alpha: float = ALPHA
    prf_beta: float = BETA
    min_retrieval_score: float = DENSE_FLOOR
    coverage_min: float = COVERAGE_FLOOR
    idf_coverage_min: float = IDF_COVERAGE_FLOOR
    group_sentences: int = GROUP_SENTENCES
    max_upload_bytes: int = MAX_UPLOAD_BYTES
    embedder: str = "hash"
    embedding_dims: int = 8

    def __post_init__(self) -> None:
        check_chunking(self.chunk_size, self.chunk_overlap)
        check_bm25(self.bm25_k1, self.bm25_b)
        check_prf(self.feedback_docs, self.expansion_terms, self.prf_alpha, self.prf_beta)
        require(self.champion_size >= 1, "champion_size must be at least 1")
        require(all(0 <= x <= 1 for x in (self.min_retrieval_score, self.coverage_min, self.idf_coverage_min)), "thresholds must be in 0..1")
        require(1 <= self.group_sentences <= 8, "group_sentences must be in 1..8")
        require(1 <= self.embedding_dims <= 3072, "embedding_dims must be in 1..3072")

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, **overrides) -> EngineConfig:
        """Defaults, then QUARRY_<NAME> variables, then keywords."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f"QUARRY_{f.name.upper()}")
            if raw is not None:
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if isinstance(f.default, bool) else type(f.default)(raw)
        return replace(cls(), **found, **overrides)


def check_chunking(size: int, overlap: int) -> None:
    require(size > 0, "chunk size must be positive")
    require(0 <= overlap < size, "chunk overlap must be at least 0 and below the chunk size")


def check_top_k(top_k: int, most: int | None = None) -> None:
    require(top_k > 0, "top_k must be positive")
    require(most is None or top_k <= most, f"top_k must be at most {most}")


def check_bm25(k1: float, b: float) -> None:
    require(k1 > 0, "k1 must be positive")
    require(0 <= b <= 1, "b must be between 0 and 1")


def check_prf(feedback_docs: int, expansion_terms: int, alpha: float, beta: float) -> None:
    require(feedback_docs >= 1, "feedback_docs must be at least 1")
    require(expansion_terms >= 0, "expansion_terms must be at least 0")
    require(alpha >= 0 and beta >= 0, "alpha and beta must not be negative")


def check_choice(name: str, value: str, allowed: tuple[str, ...]) -> None:
    require(value in allowed, f"{name} must be one of {', '.join(allowed)}")


def check_query(text: str, most: int = 500) -> None:
    require(1 <= len(text) <= most, f"a query has 1 to {most} characters")


def bm25_parameters(mode: str | None, k1: float | None, b: float | None, tuned: tuple[float, float] = (K1, B)) -> tuple[float, float]:
    """(k1, b) of a mode: none or "tunable" takes the request's, "default" the standard pair, "finetuned" the settings'."""
    if mode == "default":
        return K1, B
    if mode == "finetuned":
        return tuned
    check_choice("mode", mode or "tunable", ("default", "tunable", "finetuned"))
    got = (K1 if k1 is None else k1, B if b is None else b)
    check_bm25(*got)
    require(got[0] <= MOST_K1, f"k1 must be at most {MOST_K1}")
    return got


def prf_options(config: EngineConfig, feedback_docs: int | None = None, max_expansion_terms: int | None = None, expansion_terms: int | None = None, alpha: float | None = None, beta: float | None = None, alias_wins: bool = False) -> dict:
    """Request values where given, else the settings'; of the two names for the term limit, one wins."""
    order = (expansion_terms, max_expansion_terms) if alias_wins else (max_expansion_terms, expansion_terms)
    limit = next((x for x in order if x is not None), config.expansion_terms)
    out = {
        "feedback_docs": config.feedback_docs if feedback_docs is None else feedback_docs,
        "expansion_terms": limit,
        "alpha": config.prf_alpha if alpha is None else alpha,
        "beta": config.prf_beta if beta is None else beta,
    }
    check_prf(**out)
    require(out["feedback_docs"] <= MOST_FEEDBACK, f"feedback_docs must be at most {MOST_FEEDBACK}")
    require(out["expansion_terms"] <= MOST_EXPANSION, f"expansion terms must be at most {MOST_EXPANSION}")
    return out


def collection_name(provider: str, model: str, dims: int | None = None) -> str:
    """A table name for an embedder: lower case, without a path in front, dashes as underscores."""
    slug = re.sub(r"[^a-z0-9_]+", "_", model.lower().rsplit("/", 1)[-1].replace("-", "_")).strip("_")
    return f"{provider}_{slug}" + (f"_{dims}" if dims else "")
