"""Text expressions on Spark columns: analysis, chunking, labels and clean-up. All run in the JVM."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The analyzer's stop words.
STOP_WORDS = (
    "a an and are as at be been but by can could did do does for from had has have he her hers him his how i if in into "
    "is it its may more most not of on or our she should so such than that the their them there these they this those to "
    "was we were what when where which who will with would you your"
).split()

#: A run of letters and digits, with one apostrophe suffix.
TOKEN = r"([\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?)"
#: A word and the white space before it.
SPACED_WORD = r"((?U)\s*\S+)"
CITATION = r"\[n?(\d+)\]"


def let(value: Column, use) -> Column:
    """use(value) with value computed once: inside lambdas Spark would compute it at each mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _folds() -> dict[str, str]:
    """Characters that fold to something else than their lower case, by the Unicode tables of this Python."""
    every = (chr(c) for c in range(0x80, 0x20000))
    return {c: c.casefold() for c in every if c.casefold() != c.lower()} | {c.lower(): c.casefold() for c in "ẞ"}


FOLDS = _folds()


def casefold(text: Column) -> Column:
    """Full case folding: lower case, and beyond ASCII what differs from it (sharp s, final sigma, ligatures)."""
    table = F.from_json(F.lit(json.dumps(FOLDS)), "map<string,string>")  # one literal, which the planner folds
    one_by_one = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(table[c], F.lower(c))), "")
    return F.when(text.rlike(f"[{''.join(FOLDS)}Σ]"), one_by_one).otherwise(F.lower(text))


def tokens(text: Column) -> Column:
    """array<string>: folded tokens, stop words and short ones included."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), casefold)


def analyzed(text: Column, min_length: int = 2) -> Column:
    """array<struct<position, term>>: tokens that count, with their place among all tokens."""
    placed = F.transform(tokens(text), lambda t, i: F.struct(i.alias("position"), t.alias("term")))
    return F.filter(placed, lambda t: (F.length(t["term"]) >= min_length) & ~t["term"].isin(STOP_WORDS))


def terms(text: Column, min_length: int = 2) -> Column:
    return F.transform(analyzed(text, min_length), lambda t: t["term"])


def normalised(text: Column) -> Column:
    """No NUL, single blanks inside lines, one blank line at most between paragraphs, no outer blanks."""
    clean = F.replace(text, F.lit("\0"), F.lit(""))
    lines = F.transform(F.split(clean, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def spaced_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD), F.lit(1))


def chunk_starts(n_words: Column, size: int, overlap: int) -> Column:
    """First word of each chunk: one chunk up to size words, then a new one every size - overlap."""
    step = size - overlap
    last = F.greatest(F.ceil((n_words - size) / F.lit(float(step))), F.lit(0)).cast("int")
    return F.when(n_words > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def chunks(text: Column, size: int, overlap: int) -> Column:
    """array<struct<position, text, token_count, char_start, char_end>> of a text's word windows."""

    def windows(words: Column) -> Column:
        def piece(start: Column, position: Column) -> Column:
            own = F.slice(words, start + 1, F.lit(size))

            def cut(joined: Column) -> Column:
                def placed(body: Column) -> Column:
                    before = F.length(F.array_join(F.slice(words, F.lit(1), start), "")) + F.length(joined) - F.length(body)
                    return let(before, lambda at: F.struct(position.cast("int").alias("position"), body.alias("text"), F.size(own).alias("token_count"), at.alias("char_start"), (at + F.length(body)).alias("char_end")))

                return let(F.regexp_replace(joined, r"^(?U)\s+", ""), placed)

            return let(F.array_join(own, ""), cut)

        return F.transform(chunk_starts(F.size(words), size, overlap), piece)

    return let(spaced_words(text), windows)


def assembled(segments: Column) -> Column:
    """Segments with normalised text and running char_start; empty ones go; two characters join each to the next."""
    clean = F.filter(F.transform(segments, lambda s: s.withField("text", normalised(s["text"]))), lambda s: F.length(s["text"]) > 0)
    place = lambda known: F.transform(known, lambda s, i: s.withField("char_start", F.aggregate(F.slice(known, F.lit(1), i), F.lit(0), lambda at, x: at + F.length(x["text"]) + 2)))
    return let(clean, place)


def assembled_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "\n\n")


def covering(segments: Column, start: Column, end: Column) -> Column:
    """The segments whose characters overlap start..end."""
    return F.filter(segments, lambda s: (s["char_start"] < end) & (s["char_start"] + F.length(s["text"]) > start))


def without_thinking(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"^(?U)\s+|(?U)\s+$", "")


def cleaned_query(text: Column) -> Column:
    """First non-empty line of a rewritten query, without quotes or a label, 500 characters at most."""
    line = F.trim(F.regexp_extract(without_thinking(text), r"(?m)^[^\S\n]*(\S[^\n]*)$", 1))
    bare = F.trim(F.regexp_replace(line, r"""^(["'])(.*)\1$""", "$2"))
    unlabelled = F.trim(F.regexp_replace(bare, r"(?i)^(?:rewritten query|search query|query):", ""))
    return F.rtrim(F.substring(unlabelled, 1, 500))


def without_markers(text: Column) -> Column:
    """Context text without [n] markers, blanks closed up."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, CITATION, ""), r"[ \t]{2,}", " "))


def has_citation(text: Column) -> Column:
    return text.rlike(CITATION)


def cited_numbers(text: Column) -> Column:
    """Distinct citation numbers by first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int")))


def searchable(title: Column, section: Column, text: Column) -> Column:
    full = lambda c: F.when(F.length(c) > 0, c)
    return F.concat_ws("\n", full(title), full(section), full(without_markers(text)))


def page_label(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), F.lit(None).cast("string")).when(last.isNull() | (first == last), F.format_string("Page %d", first)).otherwise(F.format_string("Pages %d-%d", first, last))


def context_block(index: Column, title: Column, first: Column, last: Column, text: Column) -> Column:
    pages = F.when(first.isNull(), F.lit("")).when(last.isNull() | (first == last), F.format_string(", page %d", first)).otherwise(F.format_string(", pages %d-%d", first, last))
    return F.concat(F.format_string("[%d] ", index), title, pages, F.lit("\n"), without_markers(text))


def highlighted(text: Column, matched: Column) -> Column:
    """Words that begin with a matched term, marked."""
    parts = F.array_join(F.array_sort(F.filter(matched, lambda t: F.length(t) > 0)), "|")
    return F.when(F.length(parts) > 0, F.regexp_replace(text, F.concat(F.lit(r"(?iU)\b((?:"), parts, F.lit(r")\w*)")), F.lit("<mark>$1</mark>"))).otherwise(text)


def heat_bucket(share: Column) -> Column:
    return F.when(share <= 0, 0).when(share < 0.25, 1).when(share < 0.5, 2).when(share < 0.75, 3).otherwise(4)


def file_label(mime: Column, name: Column, source: Column) -> Column:
    lower = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(mime.contains("pdf") | lower.endswith(".pdf"), "PDF")
        .when(mime.contains("wordprocessingml") | lower.endswith(".docx"), "DOCX")
        .when((source == "web") | mime.contains("html"), "WEB")
        .otherwise("FILE")
    )


def short_title(title: Column, most: int = 18) -> Column:
    clean = F.trim(F.coalesce(title, F.lit("")))
    return F.when(F.length(clean) == 0, "Untitled").when(F.length(clean) > most, F.concat(F.rtrim(F.substring(clean, 1, most - 1)), F.lit("…"))).otherwise(clean)


def score_text(score: Column) -> Column:
    """Four decimals, or n/a where there is no score."""
    return F.when(score.isNull(), "n/a").otherwise(F.format_string("%.4f", score))


def latency_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%.0f ms", ms)).otherwise(F.format_string("%.2f s", ms / 1000))


def bar_width(value: Column, largest: Column) -> Column:
    """Per cent of the largest, 4 at least."""
    return F.greatest(F.lit(4.0), 100 * F.abs(value) / largest)


# What a reader is told when no answer is given.
ABSTENTIONS = {
    "no_context": "No indexed passage was found for this question.",
    "low_relevance": "The passages found are not relevant enough to answer.",
    "model_abstained": "The model found too little evidence to answer.",
    "citation_failure": "An answer was drafted, but its citations could not be verified.",
    "grounding_failure": "An answer was drafted, but the passages do not support it.",
}


def abstention_text(reason: Column) -> Column:
    out = F.when(reason.isNull(), F.lit(None).cast("string"))
    for name, said in ABSTENTIONS.items():
        out = out.when(reason == name, said)
    return out.otherwise("No answer could be given.")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i)https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def error_text(detail: object, fallback: str = "The request failed.") -> str:
    """One line for what a service says went wrong: a string, a list of entries with msg, or an object with message."""
    if isinstance(detail, dict):
        detail = detail.get("detail", detail.get("message"))
    if isinstance(detail, list):
        detail = "; ".join(str(x["msg"]) for x in detail if isinstance(x, dict) and x.get("msg"))
    return detail.strip() or fallback if isinstance(detail, str) else fallback
