"""Segmentation of concatenated pinyin into syllables: a constrained search, so an Arrow-backed pandas UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

#: Fixed value: ways that are kept for the rest of a text from one place with so many syllables to go.
WAYS = 200

_PLAIN = str.maketrans("".join(fixed.MARKED_VOWELS), fixed.PLAIN_VOWELS * 4)
_TONE_OF = {v: t for t, vowels in enumerate(fixed.MARKED_VOWELS, 1) for v in vowels}


def _letters(value: str) -> list[tuple[str, str]]:
    """(plain letters, original) of each character before the first slash and outside of parentheses."""
    value = value.split("/", 1)[0]
    out, at = [], 0
    while at < len(value):
        if value[at] == "(" and (end := value.find(")", at)) >= 0:
            at = end + 1
            continue
        ch = value[at]
        out.append(("".join(x for x in ch.lower().replace("ü", "v").translate(_PLAIN) if "a" <= x <= "z"), ch))
        at += 1
    return out


def normalized(value: str) -> tuple[str, set[int]]:
    """The letters, and the places where the text marks a boundary."""
    text, cuts = "", set()
    for plain, ch in _letters(value):
        if not plain and ch in fixed.BOUNDARY_MARKS:
            cuts.add(len(text))
        text += plain
    return text, cuts


def ordered_vocabulary(syllables: Iterable[str]) -> list[str]:
    """Longest first, then by letters."""
    return sorted(set(syllables), key=lambda s: (-len(s), s))


def _ways(text: str, cuts: set[int], n: int, vocabulary: list[str]) -> list[tuple[str, ...]]:
    """Up to WAYS ways to cover the text with n syllables, filled from its end: ways[k][p] covers text[p:] with k."""
    fits = [[s for s in vocabulary if text.startswith(s, p) and not any(p < c < p + len(s) for c in cuts)] for p in range(len(text))]
    below: dict[int, list[tuple[str, ...]]] = {len(text): [()]}
    for _ in range(n):
        level: dict[int, list[tuple[str, ...]]] = {}
        for p in range(len(text)):
            found = [(s, *rest) for s in fits[p] for rest in below.get(p + len(s), ())]
            if found:
                level[p] = found[:WAYS]
        below = level
    return below.get(0, [])


def _penalty(way: tuple[str, ...], cuts: set[int]) -> int:
    starts, at = [], 0
    for s in way:
        starts.append(at)
        at += len(s)
    bare = sum(s[0] in fixed.BARE_VOWELS and p not in cuts for s, p in zip(way[1:], starts[1:], strict=True))
    return 100 * bare + 5 * sum(s in fixed.RARE_SYLLABLES for s in way) - len(cuts.intersection(starts[1:]))


def segment(pinyin: str | None, n: int, vocabulary: list[str]) -> list[str] | None:
    """The n syllables of least penalty; None where there are none, or several of that penalty."""
    text, cuts = normalized(pinyin or "")
    if not text or n <= 0:
        return None
    ranked: dict[int, set[tuple[str, ...]]] = {}
    for way in _ways(text, cuts, n, vocabulary):
        ranked.setdefault(_penalty(way, cuts), set()).add(way)
    best = ranked[min(ranked)] if ranked else set()
    return list(next(iter(best))) if len(best) == 1 else None


def syllable_tones(pinyin: str | None, syllables: list[str] | None) -> list[int] | None:
    """Tones that the marks give each syllable (0 without one); None if the letters differ or one syllable has two tones."""
    text, tones = "", []
    for plain, ch in _letters(pinyin or ""):
        text += plain
        tones += [_TONE_OF.get(ch.lower(), 0)] * len(plain)
    parts = list(syllables if syllables is not None else [])
    if text != "".join(parts):
        return None
    out, at = [], 0
    for s in parts:
        marks = set(tones[at : at + len(s)]) - {0}
        if len(marks) > 1:
            return None
        out.append(marks.pop() if marks else 0)
        at += len(s)
    return out


def segment_column(vocabulary: Iterable[str]) -> Callable[[Column, Column], Column]:
    """A column function (pinyin, number of tones) -> syllables, null where undecided. The vocabulary is a few hundred syllables of the language."""
    known = ordered_vocabulary(vocabulary)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(pinyin: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([segment(p, 0 if pd.isna(k) else int(k), known) for p, k in zip(pinyin, n, strict=True)], dtype=object)

    return run


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def syllable_tones_column(pinyin: pd.Series, syllables: pd.Series) -> pd.Series:
    return pd.Series([syllable_tones(p, s) for p, s in zip(pinyin, syllables, strict=True)], dtype=object)
