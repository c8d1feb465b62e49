"""Answers from passages: prompts, model ports, and the steps that let an answer through.

Retrieval, selection and the gate are tables for a whole batch of questions; the model is
called once per question that passes, on the executors. Each outcome says why there is no
answer, if there is none.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.config import GROUP_SENTENCES, require
from quarry.functions import citations as C
from quarry.functions import text as X
from quarry.sources.work import python_ready


class Model(Protocol):
    """What a language model must offer."""

    def generate(self, system: str, user: str) -> str: ...


class ModelError(RuntimeError):
    """The model could not be reached or gave nothing."""


class ModelDenied(ModelError):
    """The model's service refused the key."""


@dataclass
class HttpModel:
    """A chat endpoint that takes and gives JSON; `send` may be replaced."""

    url: str
    model: str
    key: str = ""
    temperature: float = 0.0
    seconds: int = 120
    send: Callable[[str, dict, dict], dict] | None = None

    def _send(self, url: str, headers: dict, body: dict) -> dict:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
        try:
            with urllib.request.urlopen(request, timeout=self.seconds) as got:
                return json.load(got)
        except urllib.error.HTTPError as bad:
            raise (ModelDenied if bad.code in (401, 403) else ModelError)(f"the model's service answered {bad.code}") from bad
        except (OSError, ValueError) as bad:
            raise ModelError(f"the model could not be reached: {bad}") from bad

    def generate(self, system: str, user: str) -> str:
        body = {"model": self.model, "stream": False, "temperature": self.temperature, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        got = (self.send or self._send)(self.url, {"Authorization": f"Bearer {self.key}"} if self.key else {}, body)
        said = got.get("message") or (got.get("choices") or [{}])[0].get("message") or {}
        text = strip_thinking(said.get("content") or "")
        if not text:
            raise ModelError("the model gave an empty answer")
        return text


def choose_model(models: dict[str, Callable[[], Model]], asked: str | None, default: str = "local") -> Model:
    """The asked provider, else the default; an unknown one is an error."""
    name = asked or default
    require(name in models, f"unknown model provider {name}")
    return models[name]()


class Extractive:
    """An offline model: answers with the first sentence of the passages that share most words with the question."""

    def generate(self, system: str, user: str) -> str:
        if "Draft:\n" in user:
            return user.split("Draft:\n", 1)[1].split("\n\nKeep", 1)[0]
        question = user.split("\n", 2)[1] if user.startswith("Question:") else user
        wanted = set(re.findall(r"\w+", question.lower()))
        best: tuple[int, int, str] | None = None
        for number, body in re.findall(r"^\[(\d+)\][^\n]*\n(.*?)(?=\n\n\[\d+\]|\n\nAnswer|\Z)", user, re.S | re.M):
            said = " ".join(C.sentences(" ".join(body.split()))[:1]).rstrip(".?! ")
            shared = len(wanted & set(re.findall(r"\w+", body.lower())))
            if said and shared and (best is None or (-shared, int(number)) < best[:2]):
                best = (-shared, int(number), said)
        return f"{best[2].lstrip('#|-*•$ ')} [{best[1]}]." if best else C.ABSTAIN


def strip_thinking(text: str) -> str:
    return re.sub(r"<think>.*?</think>", "", text, flags=re.S | re.I).strip()


def system_prompt(most: int) -> str:
    rule = "End every sentence with the numbers of its passages" if most == 1 else f"End every {most} sentences at most with the numbers of their passages"
    return f"Answer from the numbered passages only, in plain sentences. {rule}, like [1] or [1][2], before the full stop. If the passages do not answer the question, say exactly {C.ABSTAIN}."


def retry_prompt(most: int) -> str:
    return system_prompt(most) + " Your last answer had no valid passage number; write it again with them."


def grounding_prompt(most: int) -> str:
    return f"Check a draft against its passages. Take out or mend what they do not say, keep the numbers, at most {most} sentences to a number. If nothing remains, say exactly {C.ABSTAIN}."


def user_prompt(question: str, context: str) -> str:
    return f"Question:\n{question}\n\nPassages:\n{context}\n\nAnswer with passage numbers."


def grounding_request(question: str, context: str, draft: str) -> str:
    return f"Question:\n{question}\n\nPassages:\n{context}\n\nDraft:\n{draft}\n\nKeep only what the passages say."


def rewrite_prompt() -> str:
    return "Rewrite the question as one short search query. Give the query alone."


def clean_query(raw: str) -> str:
    """First line with text, without quotes around it or a label before it, at most 500 characters."""
    line = next((x.strip() for x in strip_thinking(raw).splitlines() if x.strip()), "")
    if len(line) > 1 and line[0] in "\"'" and line[-1] == line[0]:
        line = line[1:-1].strip()
    line = re.sub(r"^(?:rewritten query|search query|query):\s*", "", line, flags=re.I)
    return line[:500].rstrip() if len(line) > 500 else line


def rewrite(question: str, model: Model) -> str:
    """A search query from the model; the question itself if that fails. For the dense arm only."""
    try:
        return clean_query(model.generate(rewrite_prompt(), question)) or question
    except ModelError:
        return question


@dataclass(frozen=True)
class Outcome:
    answer: str
    cited: list[int] = field(default_factory=list)
    invalid_citations: list[str] = field(default_factory=list)
    reason: str | None = None
    citation_enforced: bool = False

    @property
    def abstained(self) -> bool:
        return self.reason is not None


def answer(question: str, context: str, passages: int, model: Model, most: int = GROUP_SENTENCES) -> Outcome:
    """Draft, one retry for citations, a grounding pass, then the structure check."""
    ask = user_prompt(question, context)
    draft = strip_thinking(model.generate(system_prompt(most), ask))
    if draft == C.ABSTAIN:
        return Outcome("", reason="model_abstained")
    clean, wrong = C.validate(draft, passages)
    if not C.cited_numbers(clean, passages):
        draft = strip_thinking(model.generate(retry_prompt(most), ask))
        clean, more = C.validate(draft, passages)
        wrong = C.merge_markers(wrong, more)
        if not clean or draft == C.ABSTAIN or not C.cited_numbers(clean, passages):
            return Outcome("", [], list(wrong), "citation_failure", True)
    checked = strip_thinking(model.generate(grounding_prompt(most), grounding_request(question, context, clean)))
    final, more = C.validate(checked, passages)
    wrong = C.merge_markers(wrong, more)
    if not final or checked == C.ABSTAIN or not C.cited_numbers(final, passages):
        return Outcome("", [], list(wrong), "grounding_failure", True)
    final = C.normalise_prose(final)
    if not C.is_covered(final, passages, most):
        return Outcome("", [], list(wrong), "citation_failure", True)
    return Outcome(final, C.cited_numbers(final, passages), list(wrong), None, True)


def contexts(selected: DataFrame) -> DataFrame:
    """query_id, context, chunk_ids: numbered passages of each query in rank order (rows need title, pages, text)."""
    order = W.partitionBy("query_id").orderBy("rank")
    numbered = selected.withColumn("prompt_index", F.row_number().over(order))
    block = X.context_block(F.col("prompt_index"), F.col("title"), F.col("page_start"), F.col("page_end"), F.col("text"))
    rows = numbered.withColumn("block", block)
    parts = F.array_sort(F.collect_list(F.struct("prompt_index", "block", "chunk_id")))
    return rows.groupBy("query_id").agg(parts.alias("p")).select("query_id", F.array_join(F.transform("p", lambda x: x["block"]), "\n\n").alias("context"), F.transform("p", lambda x: x["chunk_id"]).alias("chunk_ids"))


def outcomes(queries: DataFrame, selected: DataFrame, gated: DataFrame, make: Callable[[], Model] = Extractive, most: int = GROUP_SENTENCES) -> DataFrame:
    """One row per question: answer, cited chunk ids, why there is none, and the time the model took."""
    python_ready(queries.sparkSession)
    rows = queries.select("query_id", F.col("text").alias("query")).join(gated, "query_id").join(contexts(selected), "query_id", "left")

    @F.pandas_udf("answer string, cited array<int>, invalid_citations array<string>, abstention_reason string, citation_enforced boolean, elapsed_ms double")
    def run(question: pd.Series, context: pd.Series, n: pd.Series, reason: pd.Series) -> pd.DataFrame:
        model, out = make(), []
        for q, c, k, why in zip(question, context, n, reason, strict=True):
            began = time.perf_counter()
            got = Outcome("", reason=why) if why else answer(q, c, int(k), model, most)
            out.append((got.answer, got.cited, got.invalid_citations, got.reason, got.citation_enforced, (time.perf_counter() - began) * 1000))
        return pd.DataFrame(out, columns=["answer", "cited", "invalid_citations", "abstention_reason", "citation_enforced", "elapsed_ms"])

    done = rows.withColumn("got", run("query", "context", F.coalesce(F.size("chunk_ids"), F.lit(0)), "reason"))
    return done.select("query_id", "query", "got.answer", F.transform("got.cited", lambda i: F.get("chunk_ids", i - 1)).alias("cited_chunks"), F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("context_chunks"), "got.invalid_citations", F.col("got.abstention_reason").isNotNull().alias("abstained"), "got.abstention_reason", "got.citation_enforced", "got.elapsed_ms")
