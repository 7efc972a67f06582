"""Vocabulary: from source rows to words with lexical and surface tones, syllables and definitions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, pinyin
from ..functions.sandhi import sandhi_surface
from ..functions.segment import segment_column


def _override(table: dict, kind: str) -> Column:
    """The table's value for the row's id, or null: a literal map of a few fixed rows."""
    parts = [x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))]
    return F.try_element_at(F.create_map(*parts), F.col("id")).cast(kind)


def tones_of(dictionary: Column, marked: Column) -> Column:
    """Tones of the dictionary's reading; where it has none, of the marks."""
    found = pinyin.cedict_tones(dictionary)
    return F.when(F.size(found) > 0, found).otherwise(pinyin.accent_tones(marked))


def build_words(source: DataFrame) -> DataFrame:
    """Source rows (schemas.HSK_CSV) to words. An id with an override has its value whatever the source says, an empty one too."""
    rows = source.select(
        F.coalesce("ID", F.lit("")).alias("id"),
        pinyin.first_alternative(F.col("Simplified")).alias("word"),
        pinyin.first_alternative(F.col("Traditional")).alias("traditional"),
        pinyin.first_alternative(F.col("Pinyin")).alias("own"),
        F.coalesce("POS", F.lit("")).alias("pos"),
        F.coalesce("Level", F.lit("")).alias("level"),
        F.col("CEDICT").alias("dictionary"),
    )
    rows = rows.withColumn("pinyin", F.coalesce(_override(fixed.PINYIN_OVERRIDES, "string"), "own"))
    rows = rows.withColumn("lexical_tones", F.coalesce(_override(fixed.TONE_OVERRIDES, "array<int>"), tones_of(F.col("dictionary"), F.col("pinyin"))))
    return with_surface(rows).select(
        "id", "word", "traditional", "pinyin", "pos", "level", "lexical_tones", pinyin.pattern(F.col("lexical_tones")).alias("lexical_pattern"),
        "default_surface_tones", pinyin.pattern(F.col("default_surface_tones")).alias("default_surface_pattern"),
        "sandhi_tags", "surface_label_needs_clip_review", F.concat(F.lit("https://forvo.com/word/"), "word", F.lit("/#zh")).alias("forvo_url"),
    )


def with_surface(rows: DataFrame) -> DataFrame:
    """Append default_surface_tones, sandhi_tags and surface_label_needs_clip_review. rows: id, word, lexical_tones.

    An overridden surface takes the derived one's place with the tag neutral_tone alone, before the need for review is told.
    """
    rows = rows.withColumn("_s", sandhi_surface(F.col("word"), F.col("lexical_tones"))).withColumn("_o", _override(fixed.SURFACE_OVERRIDES, "array<int>"))
    rows = rows.withColumns({
        "default_surface_tones": F.coalesce("_o", "_s.surface"),
        "sandhi_tags": F.when(F.col("_o").isNotNull(), F.array(F.lit("neutral_tone"))).otherwise(F.col("_s.tags")),
    })
    review = F.array_contains("sandhi_tags", "third_tone_grouping_ambiguous") | ~F.col("_s.aligned")
    return rows.withColumn("surface_label_needs_clip_review", review).drop("_s", "_o")


def counts(words: DataFrame) -> DataFrame:
    """One row: entries, those with tags, and those that need review."""
    return words.agg(F.count("*").alias("entries"), F.count_if(F.size("sandhi_tags") > 0).alias("tagged"), F.count_if("surface_label_needs_clip_review").alias("review"))


def syllable_vocabulary(names: DataFrame, at_least: int = 400, at_most: int = 10_000) -> list[str]:
    """Syllables of file names like cmn-ma1.mp3 (column ``name``), and r; jv is ju. A few hundred, by the language: gathered to the driver.

    Fewer than ``at_least`` is an error, and so are more than ``at_most``: then these are no syllables of a language.
    """
    form = r"^cmn-_?([a-zv]+)[1-5]\.mp3$"
    found = names.where(F.col("name").rlike(form)).select(F.regexp_extract("name", form, 1).alias("s")).distinct().limit(at_most + 1).collect()
    if len(found) > at_most:
        raise ValueError(f"more than {at_most} syllables")
    out = {"r"} | {"ju" if r["s"] == "jv" else r["s"] for r in found}
    if len(out) < at_least:
        raise ValueError(f"{len(out)} syllables where {at_least} are expected")
    return sorted(out, key=lambda s: (-len(s), s))


def add_syllables(words: DataFrame, vocabulary: Iterable[str]) -> DataFrame:
    """Append pinyin_syllables: empty where the segmentation is not decided."""
    cut = segment_column(vocabulary)(F.col("pinyin"), F.size("lexical_tones"))
    return words.withColumn("pinyin_syllables", F.coalesce(cut, F.array().cast("array<string>")))


def add_definitions(words: DataFrame, entries: DataFrame) -> DataFrame:
    """id, definition of the words that get one.

    A word with syllables takes entries of its reading; one without takes its only entry. Of those with a definition the
    best is that of the word's traditional form (else 5 worse) and without capitals in its reading (else 3 worse); ties go
    to the smaller text.

    Entries are reduced before they meet words: to the best of each form of a reading, of each reading, and of each word with one entry. So a
    word meets three rows at most, however many entries it has.
    """
    own = words.select("id", "word", F.col("traditional").alias("form"), pinyin.expected_reading(F.col("pinyin_syllables"), F.col("lexical_tones")).alias("expected"))
    text = F.array_join(pinyin.clean_definitions(F.col("definitions")), "; ")
    best = F.struct(F.when(F.col("pinyin").rlike(r"\p{Lu}"), 3).otherwise(0).alias("score"), text.alias("text"))
    forms = entries.groupBy("simplified", "reading", "traditional").agg(F.count("*").alias("n"), F.min(F.when(text != "", best)).alias("best"))
    own_form = forms.where("reading is not null and best is not null").select(F.col("simplified").alias("_w"), F.col("reading").alias("_r"), F.col("traditional").alias("_f"), F.col("best").alias("_same"))
    readings = own_form.groupBy("_w", "_r").agg(F.min("_same").alias("_any"))
    only = forms.groupBy(F.col("simplified").alias("_w")).agg(F.sum("n").alias("n"), F.min("best").alias("_any"), F.min("traditional").alias("_f")).where("n = 1 and _any is not null").drop("n")
    worse = F.struct((F.col("_any.score") + 5).alias("score"), F.col("_any.text").alias("text"))
    read = own.where(F.size("expected") > 0)
    read = read.join(readings, (F.col("word") == F.col("_w")) & (F.col("expected") == F.col("_r"))).drop("_w", "_r")
    read = read.join(own_form, (F.col("word") == F.col("_w")) & (F.col("expected") == F.col("_r")) & F.col("form").eqNullSafe(F.col("_f")), "left")
    alone = own.where(F.size("expected") == 0).join(only, F.col("word") == F.col("_w"))
    found = read.select("id", F.coalesce("_same", worse).alias("best")).union(alone.select("id", F.when(F.col("form").eqNullSafe(F.col("_f")), F.col("_any")).otherwise(worse)))
    return found.groupBy("id").agg(F.min("best")["text"].alias("definition"))


def attach_definitions(words: DataFrame, definitions: DataFrame) -> DataFrame:
    """Left join on id; an empty or missing definition falls back to the word's own, then to ''."""
    own = F.col("own_definition") if "definition" in words.columns else F.lit(None).cast("string")
    words = words.withColumnRenamed("definition", "own_definition")
    rows = words.join(definitions.select(F.col("id").alias("_id"), "definition"), F.col("id") == F.col("_id"), "left")
    return rows.withColumn("definition", F.coalesce(pinyin.falls_through(F.col("definition"), own), F.lit(""))).drop("_id", "own_definition")
