"""Porter's stemmer, after M. F. Porter, "An algorithm for suffix stripping" (1980).

Runs on distinct words only: `stemmed` joins stems back to a vocabulary.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The paper's suffix tables of steps 2, 3 and 4, and words stemmed by hand.
STEP_2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log fulli:ful"
STEP_3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
IRREGULAR = {"sky": "sky", "skies": "sky", "inning": "inning", "outing": "outing", "canning": "canning", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "outings": "outing", "cannings": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}


def _table(said: str) -> list[tuple[str, str]]:
    pairs = [x.partition(":")[::2] for x in said.split()]
    return sorted(pairs, key=lambda p: -len(p[0]))


_TWO, _THREE, _FOUR = _table(STEP_2), _table(STEP_3), _table(STEP_4)


def _shape(stem: str) -> str:
    """v and c for each letter; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(stem):
        out += "v" if letter in "aeiou" or (letter == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _swap(word: str, table: list[tuple[str, str]], least: int) -> str:
    for old, new in table:
        if word.endswith(old):
            stem = word[: -len(old)]
            return stem + new if _measure(stem) >= least else word
    return word


def stem(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    # 1a
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b
    if word.endswith("ied"):
        word = word[:-1] if len(word) == 4 else word[:-2]
    elif word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    # 1c
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        word = word[:-1] + "i"
    word = _swap(word, _TWO, 1)
    word = _swap(word, _THREE, 1)
    # 4
    for end, _ in _FOUR:
        if word.endswith(end):
            left = word[: -len(end)]
            if _measure(left) > 1 and (end != "ion" or left[-1:] in ("s", "t")):
                word = left
            break
    # 5
    if word.endswith("e"):
        left = word[:-1]
        if _measure(left) > 1 or (_measure(left) == 1 and not _short(left)):
            word = left
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


@lru_cache(100_000)
def kept_stem(word: str) -> str:
    return stem(word)


def stems(spark: SparkSession, column: str = "term") -> Column:
    """Stems of a column's words where they stand; a worker keeps what it has seen."""
    from quarry.sources.work import python_ready

    python_ready(spark)

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(kept_stem)

    return run(column)


def stemmed(vocabulary: DataFrame, column: str = "term") -> DataFrame:
    """(term, stem) of a vocabulary's distinct terms: Python sees each word once, in Arrow batches."""
    from quarry.sources.work import python_ready

    python_ready(vocabulary.sparkSession)

    @F.pandas_udf("string")
    def run(words: pd.Series) -> pd.Series:
        return words.map(stem)

    return vocabulary.select(column).distinct().withColumn("stem", run(column))
