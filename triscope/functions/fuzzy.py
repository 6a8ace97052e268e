"""Words that are nearly equal: the ratio of matching blocks (Ratcliff and Obershelp), which no built-in function gives."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triscope.functions.lookalikes import LOOSE, loose_fold

#: Fixed values of the match: least ratio, greatest difference of lengths, least length of a word.
RATIO, LENGTHS, LEAST = 0.78, 3, 4


@lru_cache(200_000)
def ratio(a: str, b: str) -> float:
    """Twice the matching characters over all; kept by the worker, as words recur."""
    return SequenceMatcher(None, a, b).ratio()


def near(words: DataFrame, targets: list[str], least: float = RATIO) -> DataFrame:
    """word, target, ratio of the distinct words within reach of each stated target.

    The targets are a stated, short query set; each distinct word meets those of about its length. Words are compared as they
    are; those under four letters and nulls fall away.
    """
    by_length: dict[int, list[str]] = {}
    for t in dict.fromkeys(targets):
        for n in range(len(t) - LENGTHS, len(t) + LENGTHS + 1):
            by_length.setdefault(n, []).append(t)

    def run(frames):
        for f in frames:
            rows = []
            for w in f["word"]:
                for t in by_length.get(len(w), ()):
                    s = SequenceMatcher(None, w, t)
                    if s.real_quick_ratio() >= least and s.quick_ratio() >= least and (r := s.ratio()) >= least:
                        rows.append((w, t, r))
            yield pd.DataFrame(rows, columns=["word", "target", "ratio"])

    distinct = words.select("word").where(F.length("word") >= LEAST).distinct()
    return distinct.mapInPandas(run, "word string, target string, ratio double")


def is_near(a: str, b: str, least: float = RATIO) -> bool:
    return a == b or (abs(len(a) - len(b)) <= LENGTHS and ratio(a, b) >= least)


def phrase_at(words: list[str], targets: list[str], gap: int = 2, least: float = RATIO) -> bool:
    """Whether the targets stand in this order, nearly equal, with at most ``gap`` other words between one and the next.

    Of each target all places are kept that follow some place of the one before, so no occurrence is passed over.
    """
    ends: set[int] | None = None
    for t in targets:
        here = {i for i, w in enumerate(words) if (ends is None or any(i - d in ends for d in range(1, gap + 2))) and is_near(w, t, least)}
        if not here:
            return False
        ends = here
    return True


def has_phrase(texts: DataFrame, text: str, targets: list[str], gap: int = 2) -> DataFrame:
    """``texts`` with ``found``: whether a phrase stands in the text, nearly equal and in order. Null text: false."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: ws is not None and phrase_at(list(ws), targets, gap))

    words = F.regexp_extract_all(F.lower(text), F.lit("([а-яёa-z]{4,})"), F.lit(1))
    # a word of about the right length that starts like the first target is no condition, so every text is looked at
    return texts.withColumn("found", F.coalesce(F.pandas_udf(run, "boolean")(words), F.lit(False)))


def kinds_by_words(texts: DataFrame, text: str, rules: list[tuple[str, list[list[str]]]], name: str = "kind", other: str = "other") -> DataFrame:
    """``texts`` with the first kind of ``rules`` that fits: one of its sets of words is in the text as a whole, nearly equal.

    The rules are the caller's table. Letters that look alike count as one; words have four letters or more. No kind, and null
    text, give ``other``. Equal sets of words are judged once per batch, words that differ in length by too much aren't compared.
    """

    folded = [(kind, [[t.lower().translate(str.maketrans(LOOSE)) for t in way] for way in ways]) for kind, ways in rules]

    def kind_of(words: frozenset[str]) -> str:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)

        def there(target: str) -> bool:
            return target in words or any(is_near(w, target) for n in range(len(target) - LENGTHS, len(target) + LENGTHS + 1) for w in by_length.get(n, ()))

        return next((kind for kind, ways in folded if any(all(map(there, way)) for way in ways)), other)

    def run(s: pd.Series) -> pd.Series:
        sets = [frozenset(ws) if ws is not None else frozenset() for ws in s]
        known = {ws: kind_of(ws) for ws in set(sets)}
        return pd.Series([known[ws] for ws in sets], dtype="str")

    words = F.regexp_extract_all(loose_fold(F.col(text)), F.lit("([а-яёa-z]{4,})"), F.lit(1))
    return texts.withColumn(name, F.pandas_udf(run, "string")(words))
