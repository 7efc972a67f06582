"""Surface tones of a word: what connected speech does to lexical tones. Higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pinyin import cjk_chars


def _at(a: Column, i: Column) -> Column:
    """Element i from 0, or null outside."""
    return F.when(i >= 0, F.get(a, i))


def sandhi_surface(word: Column, tones: Column) -> Column:
    """struct(surface, tags, aligned): the surface tones, sorted distinct tags, and whether characters and tones are as many.

    A value is decided per place, from the lexical tones and characters around it; the rules are applied in this order:
    a 不 or 一 between equal characters is neutral; 不 before a fourth tone rises; 一 that is not last, not
    neutral and not after 第 rises before a fourth tone and falls before the others; all but the last of a run of third tones
    rise, whatever the rules before made of them. The first three need alignment, the last does not.
    """
    chars = cjk_chars(word)
    aligned = F.size(chars) == F.size(tones)
    places = F.when(F.size(tones) > 0, F.sequence(F.lit(0), F.size(tones) - 1)).otherwise(F.array().cast("array<int>"))
    c, t = lambda i: _at(chars, i), lambda i: _at(tones, i)
    yes = lambda x: F.coalesce(x, F.lit(False))

    def between(i: Column, char: str) -> Column:
        return yes(aligned & (c(i) == char) & (c(i - 1) == c(i + 1)))

    def neutral(i: Column) -> Column:
        return between(i, "不") | between(i, "一") | (t(i) == 0)

    def bu(i: Column) -> Column:
        return yes(aligned & (c(i) == "不") & ~neutral(i) & (t(i) == 4) & (t(i + 1) == 4))

    def yi(i: Column) -> Column:
        """The next lexical tone where the rule of 一 holds, else null."""
        free = yes(aligned & (c(i) == "一") & ~neutral(i) & (t(i) == 1)) & ~yes(c(i - 1) == "第")
        return F.when(free, t(i + 1))

    def rising(i: Column) -> Column:
        return yes((t(i) == 3) & (t(i + 1) == 3))

    def surface(i: Column) -> Column:
        return (
            F.when(rising(i), 2)
            .when(between(i, "不") | between(i, "一"), 0)
            .when(bu(i), 2)
            .when(yi(i) == 4, 2)
            .when(yi(i).isin(1, 2, 3), 4)
            .otherwise(t(i))
        )

    some = lambda f: F.exists(places, lambda i: yes(f(i)))
    tags = F.array(
        F.when(F.exists(tones, lambda x: x == 0), "neutral_tone"),
        F.when(some(lambda i: between(i, "不")), "bu_a_not_a"),
        F.when(some(lambda i: between(i, "一")), "yi_reduplication"),
        F.when(some(bu), "bu_before_t4"),
        F.when(some(lambda i: yi(i) == 4), "yi_before_t4"),
        F.when(some(lambda i: yi(i).isin(1, 2, 3)), "yi_before_non_t4"),
        F.when(some(rising), "third_tone_sandhi"),
        F.when(some(lambda i: rising(i) & rising(i + 1)), "third_tone_grouping_ambiguous"),
    )
    return F.struct(F.transform(places, surface).alias("surface"), F.array_sort(F.array_compact(tags)).alias("tags"), aligned.alias("aligned"))
