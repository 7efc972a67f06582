"""Command line: python -m cadenza COMMAND ...; paths may lie in any store that Spark reads."""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import audio
from .operators import audits, ingest, selection, vocabulary
from .plans import pipelines
from .sources import readers, schemas, sinks

COMMANDS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], DataFrame], list[str], dict[str, str]]] = {}


def command(needed: str, **optional: str) -> Callable:
    """Register a function under its name; needed and optional flags."""

    def add(f: Callable) -> Callable:
        COMMANDS[f.__name__.replace("_", "-")] = (f, needed.split(), optional)
        return f

    return add


def _words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.WORDS).json(path)


def _log(spark: SparkSession, path: str | None, schema: str = "audio_path string") -> DataFrame:
    return readers.read_log(spark, path, schema) if path else spark.createDataFrame([], schema)


@command("hsk dictionary syllables")
def build_vocabulary(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Words from a vocabulary CSV, a dictionary and a folder of syllable recordings."""
    names = readers.read_files(spark, a.syllables, "*.mp3").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    return pipelines.build_vocabulary(readers.read_vocabulary(spark, a.hsk), readers.read_dictionary(spark, a.dictionary), vocabulary.syllable_vocabulary(names, int(a.at_least)))


COMMANDS["build-vocabulary"][2]["at_least"] = "400"


@command("words dictionary")
def definitions(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """id and definition of the words that have one."""
    return vocabulary.add_definitions(_words(spark, a.words), readers.read_dictionary(spark, a.dictionary))


@command("imports", known="", audio_root="audio")
def import_audio(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Recordings of a folder source/word/file with sidecars, added to those that are known."""
    known = spark.read.schema(schemas.RECORDINGS).json(a.known) if a.known else spark.createDataFrame([], schemas.RECORDINGS)
    return ingest.index_recordings(readers.audio_tree(readers.read_files(spark, a.imports, recursive=True)), known, a.audio_root)


@command("tsv words clips")
def context(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Sentences by the words that they contain."""
    return ingest.context_clips(readers.read_sentences(spark, a.tsv), _words(spark, a.words), a.clips)


@command("words recordings quality public", syllables="all", sandhi_only="")
def practice_pool(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Words that can be practised."""
    recordings = spark.read.schema(schemas.RECORDINGS).json(a.recordings)
    return selection.practice_pool(_words(spark, a.words), recordings, readers.read_quality(spark, a.quality), readers.read_json_map(spark, a.public, schemas.PUBLIC), a.syllables, bool(a.sandhi_only))


@command("words quality public", preferred="pinyin_public")
def select_recordings(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The recording of every syllable and tone."""
    keys = selection.required_keys(_words(spark, a.words))
    return selection.select_recording(keys, readers.read_quality(spark, a.quality), readers.read_json_map(spark, a.public, schemas.PUBLIC), a.preferred)


@command("input quality", source="audio_cmn", prefix="cmn-")
def audit_duplicates(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Groups of recordings with one payload."""
    key = F.regexp_extract("path", r"([^/]+)\.mp3$", 1)
    key = F.when(key.startswith(a.prefix), F.substr(key, F.lit(len(a.prefix) + 1))).otherwise(key) if a.prefix else key
    files = readers.read_files(spark, a.input, "*.mp3").select(F.lit(a.source).alias("source"), key.alias("key"), audio.payload_hash(F.col("content")).alias("payload"))
    return audits.duplicate_groups(files, readers.read_quality(spark, a.quality))


@command("tracks words quality")
def audit_tones(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Pitch tracks (source, key, method, f0) that contradict their key's tone."""
    tracks = spark.read.schema("source string, key string, method string, f0 array<double>").json(a.tracks)
    points = tracks.withColumn("points", audio.contour_column(F.col("f0")))
    return audits.tone_flags(points, selection.required_keys(_words(spark, a.words)), readers.read_quality(spark, a.quality))


@command("waves quality", threshold="0.995")
def audit_similarity(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Samples (source, base, tone, samples) of one syllable's tones that are nearly equal."""
    waves = spark.read.schema("source string, base string, tone int, samples array<double>").json(a.waves)
    return audits.similar_tones(waves.withColumn("wave", audio.normalized_wave_column(F.col("samples"))), readers.read_quality(spark, a.quality), float(a.threshold))


@command("recordings words transcripts", completed="", model="", shard_index="0", shard_count="1")
def audit_readings(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Recordings by what was recognised in them (audio_path, transcript, recognized_pinyin)."""
    transcripts = spark.read.schema("audio_path string, transcript string, recognized_pinyin array<string>").json(a.transcripts)
    return pipelines.native_audit(spark.read.schema(schemas.RECORDINGS).json(a.recordings), _words(spark, a.words), transcripts, _log(spark, a.completed), a.model, (int(a.shard_index), int(a.shard_count)))


@command("files transcripts", completed="", model="", shard_index="0", shard_count="1")
def audit_identity(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Syllable recordings (source, key, base, audio_path) by what was recognised in them (audio_path, transcript, recognized_bases)."""
    files = spark.read.schema("source string, key string, base string, audio_path string").json(a.files)
    transcripts = spark.read.schema("audio_path string, transcript string, recognized_bases array<string>").json(a.transcripts)
    return pipelines.identity_audit(files, transcripts, _log(spark, a.completed), a.model, (int(a.shard_index), int(a.shard_count)))


@command("log second", completed="", shard_index="0", shard_count="1")
def confirm_identity(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Rows under review with a second transcriber's findings (audio_path, transcript, bases)."""
    second = spark.read.schema("audio_path string, transcript string, bases array<string>").json(a.second)
    log = readers.read_log(spark, a.log, schemas.IDENTITY_AUDIT, strict=True)
    return pipelines.identity_confirmation(log, second, _log(spark, a.completed), (int(a.shard_index), int(a.shard_count)))


def main(arguments: list[str] | None = None) -> int:
    """Run a command; --out gets its rows as JSON lines. With --fail-on COLUMN=VALUE, 1 if any row has that value."""
    parser = argparse.ArgumentParser(prog="cadenza")
    parsers = parser.add_subparsers(dest="command", required=True)
    for name, (f, needed, optional) in COMMANDS.items():
        p = parsers.add_parser(name, help=f.__doc__)
        for flag in needed:
            p.add_argument(f"--{flag.replace('_', '-')}", required=True)
        for flag, value in optional.items():
            p.add_argument(f"--{flag.replace('_', '-')}", default=value)
        p.add_argument("--out", required=True)
        p.add_argument("--fail-on", default="")
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"cadenza {a.command}").getOrCreate()
    rows = COMMANDS[a.command][0](spark, a)
    sinks.write_json(rows, a.out)
    if not a.fail_on:
        return 0
    column, _, value = a.fail_on.partition("=")
    return int(bool(spark.read.schema(rows.schema).json(a.out).where(F.col(column).cast("string") == value).limit(1).count()))


if __name__ == "__main__":
    raise SystemExit(main())
