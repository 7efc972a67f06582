"""Which recording stands for a syllable, and which words can be practised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, pinyin

HUMAN, PUBLIC = "audio_cmn", "pinyin_public"


def bad(status: Column) -> Column:
    """Only an explicit 'bad' is bad; no review is healthy."""
    return status.eqNullSafe(F.lit("bad"))


def select_recording(keys: DataFrame, quality: DataFrame, public: DataFrame, preferred: Column | str = PUBLIC) -> DataFrame:
    """Append audio_path, enhanced, chosen_source: the recording of each ``key``, null where none may be used.

    quality: source, key and review fields; reviews with a null source count for the first corpus where it has none of its
    own. public: key, audio_path, source. ``preferred`` is a mode or a column of modes; all but 'audio_cmn' mean the default.
    The three lookups are left joins on the key; small tables are broadcast by the optimizer.
    """
    mode = F.lit(preferred) if isinstance(preferred, str) else preferred
    human = quality.where(F.coalesce("source", F.lit(HUMAN)) == HUMAN)
    first = Window.partitionBy("key").orderBy(F.col("source").isNull())
    human = human.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    human = human.select(F.col("key").alias("_hk"), F.col("status").alias("_hs"), F.col("replacement").alias("_hr"), pinyin.falls_through(F.col("replacement_audio_path")).alias("_hp"), pinyin.falls_through(F.col("replacement_source")).alias("_hq"))
    review = quality.where(F.col("source") == PUBLIC).select(F.col("key").alias("_pk"), F.col("status").alias("_ps"))
    found = public.select(F.col("key").alias("_rk"), pinyin.falls_through(F.col("audio_path")).alias("_rp"), F.col("source").alias("_rs"))
    rows = keys.join(human, F.col("key") == F.col("_hk"), "left").join(review, F.col("key") == F.col("_pk"), "left").join(found, F.col("key") == F.col("_rk"), "left")
    human_bad, missing = bad(F.col("_hs")), F.col("key").isin(*fixed.UNAVAILABLE_KEYS)
    public_ok = F.col("_rp").isNotNull() & ~bad(F.col("_ps"))
    named = F.col("key")
    for k, v in fixed.RENAMED_KEYS.items():
        named = F.when(F.col("key") == k, v).otherwise(named)
    choice = (
        F.when((mode == HUMAN) & human_bad & F.col("_hp").isNotNull(), "replacement")
        .when((mode == HUMAN) & human_bad & F.col("_hr").eqNullSafe(F.lit(PUBLIC)) & public_ok, "public")
        .when((mode == HUMAN) & human_bad, "none")
        .when((mode == HUMAN) & ~missing, "human")
        .when(public_ok, "public")
        .when(mode == HUMAN, "none")
        .when(human_bad & F.col("_hp").isNotNull(), "replacement")
        .when(human_bad | missing, "none")
        .otherwise("human")
    )
    rows = rows.withColumn("_choice", choice)
    is_ = lambda x: F.col("_choice") == x
    path = F.when(is_("public"), F.col("_rp")).when(is_("replacement"), F.col("_hp")).when(is_("human"), F.concat(F.lit("audio/audio_cmn/syllabs/cmn-"), named, F.lit(".mp3")))
    source = F.when(is_("public"), F.col("_rs")).when(is_("replacement"), F.coalesce("_hq", F.lit(HUMAN))).when(is_("human"), HUMAN)
    rows = rows.withColumns({"audio_path": path, "enhanced": F.when(~is_("none"), is_("public")), "chosen_source": source})
    return rows.select(*keys.columns, "audio_path", "enhanced", "chosen_source")


def required_keys(words: DataFrame, tones: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Distinct keys of every syllable with every tone."""
    each = words.select(F.explode("pinyin_syllables").alias("s")).distinct()
    each = each.select("s", F.explode(F.array(*map(F.lit, tones))).alias("t"))
    return each.select(pinyin.correction_key(F.col("s"), F.col("t")).alias("key")).distinct()


def ambiguous_words(words: DataFrame) -> DataFrame:
    """word, ambiguous: whether it has more than one reading."""
    key = pinyin.reading_key(F.col("pinyin"), F.col("pinyin_syllables"), F.col("lexical_pattern"))
    return words.groupBy("word").agg((F.count_distinct(key) > 1).alias("ambiguous"))


def native_recordings(recordings: DataFrame) -> DataFrame:
    """Recordings of the first corpus in Mandarin; a missing or empty language is Mandarin."""
    return recordings.where((F.col("source") == HUMAN) & (F.coalesce(pinyin.falls_through(F.col("language_code")), F.lit("zh")) == "zh"))


def eligible_recordings(words: DataFrame, recordings: DataFrame) -> DataFrame:
    """Pairs (id, audio_path and the recording's columns) of words with the recordings that may be asked for them."""
    words = words.join(ambiguous_words(words).withColumnRenamed("word", "_w"), F.col("word") == F.col("_w")).drop("_w")
    own = words.select("id", F.col("word").alias("_word"), pinyin.expected_pattern(F.col("default_surface_pattern"), F.col("lexical_pattern")).alias("expected"), "surface_label_needs_clip_review", "ambiguous")
    label, owner = pinyin.falls_through(F.col("surface_pattern")), pinyin.falls_through(F.col("hsk_id"))
    rows = native_recordings(recordings).where(~F.col("quiz_eligible").eqNullSafe(F.lit(False))).join(own, F.col("word") == F.col("_word"))
    labelled = ~F.coalesce("surface_label_needs_clip_review", F.lit(False)) | label.isNotNull()
    fits = F.when(owner.isNotNull(), owner == F.col("id")).when(label.isNotNull(), label.eqNullSafe(F.col("expected"))).otherwise(~F.col("ambiguous"))
    return rows.where(labelled & fits).select("id", *recordings.columns)


def aligned(words: DataFrame) -> DataFrame:
    """Words with as many syllables as tones in the expected pattern."""
    expected = F.coalesce(pinyin.expected_pattern(F.col("default_surface_pattern"), F.col("lexical_pattern")), F.lit(""))
    return words.where(F.col("pinyin_syllables").isNotNull() & (F.size("pinyin_syllables") == F.size(F.filter(F.split(expected, "-"), lambda t: t != ""))))


def unverified_ids(words: DataFrame, quality: DataFrame, public: DataFrame) -> DataFrame:
    """Ids of words with a syllable, not neutral, that no recording stands for."""
    expected = F.split(F.coalesce(pinyin.expected_pattern(F.col("default_surface_pattern"), F.col("lexical_pattern")), F.lit("")), "-")
    each = words.select("id", expected.alias("t"), F.posexplode("pinyin_syllables").alias("i", "s"))
    each = each.select("id", F.get("t", F.col("i")).alias("tone"), "s").where(~F.col("tone").eqNullSafe(F.lit("N")))
    each = each.withColumn("key", pinyin.correction_key(F.col("s"), F.coalesce("tone", F.lit("undefined"))))
    keys = select_recording(each.select("key").distinct(), quality, public).where("audio_path is null").select("key")
    return each.join(keys, "key", "left_semi").select("id").distinct()


def practice_pool(words: DataFrame, recordings: DataFrame, quality: DataFrame, public: DataFrame, syllables: str = "all", sandhi_only: bool = False) -> DataFrame:
    """Words that can be asked: of the wanted length, with a recording, aligned, and with every syllable's comparison available."""
    rows = aligned(words)
    if syllables in ("one", "two"):
        rows = rows.where(F.coalesce(F.size("lexical_tones"), F.lit(0)) == (1 if syllables == "one" else 2))
    if sandhi_only:
        rows = rows.where(F.size("sandhi_tags") > 0)
    rows = rows.join(eligible_recordings(words, recordings).select("id"), "id", "left_semi")
    return rows.join(unverified_ids(rows, quality, public), "id", "left_anti")


def choose(df: DataFrame, seed: int) -> DataFrame:
    """One row at random, decided by the seed: the smallest hash of the row, kept by a top-1."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(1)


def grade(attempts: DataFrame) -> DataFrame:
    """Append correct, and marks: per place, whether the chosen tone is right (as far as the longer pattern goes)."""
    chosen, right = F.split("selected_pattern", "-"), F.split("correct_pattern", "-")
    return attempts.withColumns({"correct": F.col("selected_pattern") == F.col("correct_pattern"), "marks": F.zip_with(chosen, right, lambda a, b: a.eqNullSafe(b))})


def progress(attempts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """attempts, correct, and the percentage rounded half up (null without attempts)."""
    out = attempts.groupBy(*(by or [])).agg(F.count("*").alias("attempts"), F.count_if("correct").alias("correct"))
    return out.withColumn("percent", F.when(F.col("attempts") > 0, F.floor(F.col("correct") * 100 / F.col("attempts") + 0.5).cast("long")))
