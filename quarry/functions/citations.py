"""Citation grammar of generated answers.

An answer is blocks (paragraphs; a bullet starts its own), a block is groups, a group is
sentences of which the last alone ends in bracketed numbers. A small scanner yields the
tokens that matter - citations, sentence marks, blanks, other text - and every rule below
is stated over those. The rules check structure only, never whether a passage entails a
claim. Spark sees them through the functions named *_column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ABSTAIN = "INSUFFICIENT_EVIDENCE"
MARKS = ".?!"
BULLETS = "-*•"

_LOOSE = re.compile(r"\[n?(\d+)\]")  # what counts as a citation to a reader
_SCAN = re.compile(r"(?P<cite>\[\d+\])|(?P<mark>[.?!])|(?P<blank>\s+)|(?P<other>[^\s.?!\[]+|\[)")
_LIST = r"\[[ \t]*[1-9]\d*(?:[ \t]*,[ \t]*[1-9]\d*)*[ \t]*\]"  # [1] or [1, 2]
_LIST_RUN = re.compile(rf"{_LIST}(?:[ \t]*{_LIST})*")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    start: int
    end: int


def scan(text: str) -> list[Token]:
    return [Token(m.lastgroup, m[0], m.start(), m.end()) for m in _SCAN.finditer(text)]


def bullet(line: str) -> tuple[str, str]:
    """(bullet and blank, body) of a stripped line; no bullet: ("", line)."""
    if len(line) > 2 and line[0] in BULLETS and line[1] in " \t" and line[1:].strip():
        return f"{line[0]} ", line[1:].strip()
    return "", line


def line_blocks(lines: list[str]) -> Iterator[list[int]]:
    """Numbers of the lines of each block: blank lines part blocks, bullets begin one."""
    held: list[int] = []
    for i, line in enumerate(lines):
        clean = line.strip()
        if held and (not clean or bullet(clean)[0]):
            yield held
            held = []
        if clean:
            held.append(i)
    if held:
        yield held


def blocks(answer: str) -> list[str]:
    lines = answer.splitlines()
    return [" ".join(lines[i].strip() for i in numbers) for numbers in line_blocks(lines)]


def expand_lists(answer: str) -> str:
    """[1, 2] as [1][2] where a sentence ends: beside a mark, or at the end of its block.

    Wrapped lines are one block. Bracketed prose elsewhere, and malformed lists, stay.
    """
    lines = answer.split("\n")
    for numbers in line_blocks(lines):
        clean = {i: lines[i].strip() for i in numbers}
        for i in numbers:
            line, done, at = lines[i], [], 0
            for run in _LIST_RUN.finditer(line):
                before = line[: run.start()].strip(" \t") or " ".join(clean[k] for k in numbers if k < i)
                after = line[run.end() :].strip(" \t") or " ".join(clean[k] for k in numbers if k > i)
                if before[-1:] in tuple(MARKS) or not after or after[0] in MARKS:
                    flat = re.sub(_LIST, lambda m: "".join(f"[{x.strip()}]" for x in m[0][1:-1].split(",")) if "," in m[0] else m[0], run[0])
                    done += [line[at : run.start()], flat]
                    at = run.end()
            lines[i] = "".join([*done, line[at:]])
    return "\n".join(lines)


def validate(answer: str, passages: int) -> tuple[str, tuple[str, ...]]:
    """The answer with citations of 1..passages only, and the markers that went, each once."""
    wrong: dict[str, None] = {}

    def one(found: re.Match) -> str:
        if 1 <= int(found[1]) <= passages:
            return f"[{int(found[1])}]"
        wrong.setdefault(found[0])
        return ""

    kept = _LOOSE.sub(one, expand_lists(answer))
    return re.sub(r"[ \t]{2,}", " ", kept).strip(), tuple(wrong)


def merge_markers(*groups: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(m for g in groups for m in g))


def _initial(text: str, dot: int) -> bool:
    """Whether the dot ends a single capital letter, as in I.R."""
    return text[dot] == "." and dot > 0 and text[dot - 1].isupper() and not (dot > 1 and text[dot - 2].isalpha())


def sentence_ends(text: str) -> list[tuple[int, int]]:
    """(past the mark, start of the next sentence): a mark, blanks, then more text."""
    out = []
    tokens = scan(text)
    for mark, gap, more in zip(tokens, tokens[1:], tokens[2:], strict=False):
        if mark.kind == "mark" and gap.kind == "blank" and not _initial(text, mark.start):
            out.append((mark.end, more.start))
    return out


def sentences(text: str) -> list[str]:
    edges = sentence_ends(text)
    starts, ends = [0, *(b for _, b in edges)], [*(a for a, _ in edges), len(text)]
    return [x for a, b in zip(starts, ends, strict=True) if (x := text[a:b].strip())]


@dataclass(frozen=True)
class Cited:
    """A sentence taken apart: prefix, body, mark, and citations at its end."""

    prefix: str
    body: str
    mark: str
    citations: tuple[str, ...]


def cited(sentence: str) -> Cited | None:
    """The parts of a sentence whose citations stand just before or after its final mark, else None."""
    prefix, text = bullet(sentence.strip())
    tokens = scan(text)
    mark = ""
    if tokens and tokens[-1].kind == "mark":
        mark = tokens.pop().text
    run: list[Token] = []
    while tokens and (tokens[-1].kind == "cite" or (tokens[-1].kind == "blank" and not tokens[-1].text.strip(" \t"))):
        run.insert(0, tokens.pop())
    marks = [t.text for t in run if t.kind == "cite"]
    if not marks:
        return None
    if not mark and tokens and tokens[-1].kind == "mark":  # citations after the mark
        mark = tokens.pop().text
    body = text[: tokens[-1].end].strip() if tokens else ""
    return Cited(prefix, body, mark, tuple(marks))


def closed_groups(text: str) -> list[str]:
    """A paragraph cut after each cited sentence end that more prose follows."""
    text = text.strip()
    tokens, cuts = scan(text), []
    for i, token in enumerate(tokens[:-2]):
        if tokens[i + 1].kind != "blank" or tokens[i + 2].kind == "cite":
            continue
        back = i - 1
        if token.kind == "mark":
            while back >= 0 and tokens[back].kind == "blank" and not tokens[back].text.strip(" \t"):
                back -= 1
            closed = back >= 0 and tokens[back].kind == "cite"
        else:
            while back >= 0 and (tokens[back].kind == "cite" or (tokens[back].kind == "blank" and not tokens[back].text.strip(" \t"))):
                back -= 1
            closed = token.kind == "cite" and back >= 0 and tokens[back].kind == "mark"
        if closed:
            cuts.append(token.end)
    edges = [0, *cuts, len(text)]
    return [x for a, b in zip(edges, edges[1:], strict=False) if (x := text[a:b].strip())]


def normalise_sentence(text: str) -> str:
    """`body [a] [b].` for a complete cited sentence; anything else as it is."""
    parts = cited(text)
    if parts is None or not parts.body or _LOOSE.search(parts.body):
        return text
    return f"{parts.prefix}{parts.body} {' '.join(parts.citations)}{parts.mark or '.'}"


def normalise_prose(answer: str) -> str:
    """Citation placement made uniform, closed groups on lines of their own, paragraphs kept."""
    paragraphs: list[list[str]] = [[]]
    for line in answer.splitlines():
        if clean := line.strip():
            paragraphs[-1] += [normalise_sentence(g) for g in closed_groups(clean)]
        elif paragraphs[-1]:
            paragraphs.append([])
    return "\n\n".join("\n".join(p) for p in paragraphs if p)


def _markup(line: str) -> bool:
    """Headings, tables and display formulas are no prose."""
    return line.startswith(("#", "|", "$$")) or line.endswith("$$")


def group_is_covered(group: str, passages: int, most: int) -> bool:
    """1 to `most` sentences, the last alone cited, with numbers in range."""
    _, body = bullet(group.strip())
    if not body or _markup(body) or body[0] in BULLETS:
        return False
    parts = sentences(body)
    if not 0 < len(parts) <= most or any(_LOOSE.search(s) for s in parts[:-1]):
        return False
    last = cited(parts[-1])
    if last is None or not last.body or _LOOSE.search(last.body) or sentence_ends(last.body):
        return False
    return all(1 <= int(c[1:-1]) <= passages for c in last.citations)


def is_covered(answer: str, passages: int, most: int = 2) -> bool:
    """Whether every block consists of covered groups; false for nothing, an abstention, or markup."""
    if most < 1 or answer.strip() in ("", ABSTAIN) or any(_markup(x.strip()) for x in answer.splitlines() if x.strip()):
        return False
    return all((groups := closed_groups(block)) and all(group_is_covered(g, passages, most) for g in groups) for block in blocks(answer))


def cited_numbers(answer: str, passages: int) -> list[int]:
    """Numbers in range by first appearance."""
    return [n for n in dict.fromkeys(int(m[1]) for m in _LOOSE.finditer(answer)) if 1 <= n <= passages]


def link_parts(answer: str) -> list[tuple[str, int | None]]:
    """The answer cut at citations: (text, None) and (marker, number)."""
    out, at = [], 0
    for m in _LOOSE.finditer(answer):
        if m.start() > at:
            out.append((answer[at : m.start()], None))
        out.append((m[0], int(m[1])))
        at = m.end()
    return out + ([(answer[at:], None)] if at < len(answer) else [])


def _udf(returns: str, run: Callable) -> Callable:
    """A pandas UDF, made when it is used, as that needs a session; the executors get this package first."""
    from pyspark.sql import SparkSession

    from quarry.sources.work import python_ready

    python_ready(SparkSession.active())
    return F.pandas_udf(run, returns)


def expand_lists_column(answer: Column) -> Column:
    def run(answers: pd.Series) -> pd.Series:
        return answers.map(lambda x: None if x is None else expand_lists(x))

    return _udf("string", run)(answer)


def validate_column(answer: Column, passages: Column) -> Column:
    """struct<clean, invalid>."""

    def run(answers: pd.Series, counts: pd.Series) -> pd.DataFrame:
        got = [validate(a or "", int(n)) for a, n in zip(answers, counts, strict=True)]
        return pd.DataFrame({"clean": [c for c, _ in got], "invalid": [list(w) for _, w in got]})

    return _udf("clean string, invalid array<string>", run)(answer, passages)


def normalise_prose_column(answer: Column) -> Column:
    def run(answers: pd.Series) -> pd.Series:
        return answers.map(lambda x: None if x is None else normalise_prose(x))

    return _udf("string", run)(answer)


def is_covered_column(answer: Column, passages: Column, most: int = 2) -> Column:
    def run(answers: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([is_covered(a or "", int(n), most) for a, n in zip(answers, counts, strict=True)], dtype=bool)

    return _udf("boolean", run)(answer, passages)
