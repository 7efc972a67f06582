"""Whole plans: the vocabulary build, the practice pool and the audits, each one lineage without files between."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audits, selection, vocabulary


def build_vocabulary(source: DataFrame, entries: DataFrame, syllables: Iterable[str]) -> DataFrame:
    """Source rows and dictionary entries to words with tones, syllables and definitions (schemas.WORDS)."""
    words = vocabulary.add_syllables(vocabulary.build_words(source), syllables)
    return vocabulary.attach_definitions(words, vocabulary.add_definitions(words, entries))


def next_question(words: DataFrame, recordings: DataFrame, quality: DataFrame, public: DataFrame, seed: int, syllables: str = "all", sandhi_only: bool = False) -> DataFrame:
    """One word of the pool and one of its recordings, decided by the seed, with the pattern that is right for that recording."""
    pool = selection.practice_pool(words, recordings, quality, public, syllables, sandhi_only)
    word = selection.choose(pool.select("id", "word", "pinyin", "default_surface_pattern", "lexical_pattern"), seed)
    pairs = selection.eligible_recordings(words, recordings).select("id", "audio_path", "surface_pattern")
    one = selection.choose(word.join(pairs, "id"), seed + 1)
    right = F.coalesce(F.nullif("surface_pattern", F.lit("")), F.nullif("default_surface_pattern", F.lit("")), F.col("lexical_pattern"))
    return one.select("id", "word", "pinyin", "audio_path", right.alias("correct_pattern"))


def native_audit(recordings: DataFrame, words: DataFrame, transcripts: DataFrame, completed: DataFrame, model: str, shard: tuple[int, int] = (0, 1), limit: int | None = None) -> DataFrame:
    """Candidates that are not completed, of one shard, classified by their transcripts (audio_path, transcript, recognized_pinyin)."""
    todo = audits.take_shard(audits.pending(audits.native_candidates(recordings, words), completed), *shard, ["audio_path"])
    if limit is not None:
        todo = todo.orderBy("audio_path").limit(limit)
    rows = todo.join(transcripts, "audio_path")
    status = audits.native_status(F.col("recognized_pinyin"), F.col("expected"), F.col("transcript"), F.col("word"))
    return rows.select("audio_path", "word", "expected", "transcript", "recognized_pinyin", status.alias("status"), F.lit(model).alias("model"))


def identity_audit(files: DataFrame, transcripts: DataFrame, completed: DataFrame, model: str, shard: tuple[int, int] = (0, 1)) -> DataFrame:
    """files: source, key, base, audio_path. Those not completed, of one shard of what is left, by what was recognised (audio_path, transcript, recognized_bases)."""
    todo = audits.take_shard(audits.pending(files, completed), *shard, ["audio_path"])
    rows = todo.join(transcripts, "audio_path")
    status = audits.identity_status(F.col("base"), F.col("recognized_bases"))
    return rows.select("source", "key", "base", "audio_path", "transcript", "recognized_bases", status.alias("status"), F.lit(model).alias("model"))


def identity_confirmation(log: DataFrame, second: DataFrame, completed: DataFrame, shard: tuple[int, int] = (0, 1)) -> DataFrame:
    """Rows under review, of one shard of all of them, without completed ones: here the shard is taken before what is completed is left out."""
    reviews = log.where("status = 'review'")
    return audits.confirm(audits.pending(audits.take_shard(reviews, *shard, ["audio_path"]), completed), second)
