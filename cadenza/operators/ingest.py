"""Ingest: index new recordings, find words in sentences, list what services hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pinyin
from ..sources import schemas

IDENTITY = ["source", "word", "filename"]
#: Needles that are sent to all machines: so many rows, of so many bytes in all.
FEW, FEW_BYTES = 100_000, 16 << 20

#: What a field is where the sidecar lacks it (not where it says null).
DEFAULTS = {"notes": "", "language_code": "zh", "language_status": "verified_mandarin", "recording_type": "isolated_word"}


def field(document: Column, name: str, default: Column | str | None = None) -> Column:
    """A top-level field of a JSON text as a string; the default only where the key is missing: an explicit null stays null."""
    kept = F.array_contains(F.coalesce(F.json_object_keys(document), F.array().cast("array<string>")), name)
    value = F.try_variant_get(F.try_parse_json(document), f"$.{name}", "string")
    fallback = F.lit(None).cast("string") if default is None else F.lit(default) if isinstance(default, str) else default
    return F.when(kept, value).otherwise(fallback)


def recordings_of(tree: DataFrame, audio_root: str = "audio") -> DataFrame:
    """Recordings (schemas.RECORDINGS) of an audio tree: source, word, filename, stem, sidecar. A damaged sidecar counts as missing."""
    side = F.col("sidecar")
    plain = ("sex", "country", "region", "rate", "surface_pattern", "source_url", "source_recording_id", "license")
    columns = {c: field(side, c) for c in plain} | {c: field(side, c, v) for c, v in DEFAULTS.items()} | {"speaker": field(side, "speaker", F.col("stem"))}
    path = F.concat(F.lit(audio_root.rstrip("/") + "/"), "source", F.lit("/"), "word", F.lit("/"), "filename")
    rows = tree.withColumns(columns | {"audio_path": path, "hsk_id": F.lit(None).cast("string"), "quiz_eligible": F.lit(None).cast("boolean")})
    return rows.select(*[x.strip().split(" ")[0] for x in schemas.RECORDINGS.split(",")])


def insert_absent(new: DataFrame, known: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """known and, of each key that it lacks, the first of the new rows; rows already known are never changed."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    held = known.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return known.unionByName(first.join(held, on, "left_anti"))


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def index_recordings(tree: DataFrame, known: DataFrame, audio_root: str = "audio") -> DataFrame:
    return insert_absent(recordings_of(tree, audio_root), known, IDENTITY, [F.col("audio_path")])


def _met(grams: DataFrame, known: DataFrame, texts: DataFrame, text: str, needle: str) -> DataFrame:
    """Texts with the needles that they contain, of candidates that share a gram. grams: _text (hash), _gram; known: needles with _needle_gram.

    Grams meet without their texts; each candidate meets its text once, and is then checked.
    """
    pairs = grams.join(known, F.col("_gram") == F.col("_needle_gram")).drop("_gram", "_needle_gram").distinct()
    return texts.join(pairs, F.xxhash64(F.col(text)) == F.col("_text")).where(F.contains(F.col(text), F.col(needle))).drop("_text")


def _grams(size: int, start: Column) -> Column:
    """The hash of so many characters of _chars from ``start``, counted from 0. Places of an array cost the same wherever they are, those of a text more the later they come."""
    return F.xxhash64(F.lit(size), *[F.get(F.col("_chars"), start + k) for k in range(size)])


def _windows(size: int) -> Column:
    """Hashes of the windows of so many characters of _chars; none for a shorter text."""
    places = F.sequence(F.lit(0), F.size("_chars") - size)
    return F.when(F.size("_chars") >= size, F.transform(places, lambda i: _grams(size, i))).otherwise(F.array().cast("array<bigint>"))


def contained(texts: DataFrame, text: str, needles: DataFrame, needle: str, sizes: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """Pairs of texts and the needles that they contain, as an equi-join and not a loop over all pairs.

    A needle is looked up by the hash of its first characters, as many as the largest of ``sizes`` that it has, which
    must be those of some window of the text: only needles of one character are looked up by one. Candidates are then checked. A needle that is shorter
    than all sizes, null or empty finds nothing here. Equal needles, and equal texts, stay apart if their other columns differ.

    Needles of up to ``FEW`` rows and ``FEW_BYTES``, counted first, go to where the texts are, which are read once and not shuffled; more are met by grams.
    """
    known = needles.where(F.char_length(needle) >= min(sizes)).withColumn("_chars", F.split(needle, ""))
    gram = None
    for size in sorted(sizes):
        own = _grams(size, F.lit(0))
        gram = own if gram is None else F.when(F.char_length(needle) >= size, own).otherwise(gram)
    known = known.withColumn("_needle_gram", gram).drop("_chars")
    cut = texts.where(F.char_length(text) >= min(sizes)).withColumn("_chars", F.split(text, ""))
    cut = cut.withColumn("_grams", F.array_distinct(F.concat(*map(_windows, sizes)))).drop("_chars")
    held = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(needle)), F.lit(0)).alias("size")).first()
    if held["n"] > FEW or held["size"] > FEW_BYTES:
        return _met(cut.select(F.xxhash64(F.col(text)).alias("_text"), F.explode_outer("_grams").alias("_gram")), known, texts, text, needle)
    # A needle has one gram, and a text has each gram once: no pair comes twice.
    met = cut.select(*texts.columns, F.explode_outer("_grams").alias("_gram")).join(F.broadcast(known), F.col("_gram") == F.col("_needle_gram"))
    return met.where(F.contains(F.col(text), F.col(needle))).drop("_gram", "_needle_gram")


def context_clips(sentences: DataFrame, words: DataFrame, clips: str) -> DataFrame:
    """Sentences by the words that they contain (schemas.CONTEXT). Words of one character are found as windows of one."""
    known = words.where("word <> ''").select(F.col("word").alias("hit")).distinct()
    rows = contained(sentences, "sentence", known, "hit")
    return rows.select(
        F.col("hit").alias("word"), F.lit("common_voice").alias("source"), F.lit("context").alias("kind"),
        F.concat(F.lit(clips.rstrip("/") + "/"), F.coalesce("path", F.lit(""))).alias("audio_path"), "sentence", F.col("client_id").alias("speaker"), "age", "gender",
        F.coalesce(pinyin.falls_through(F.col("accents")), F.col("accent")).alias("accent"), "locale",
    )


def longest_first(words: DataFrame, order: str = "word") -> DataFrame:
    """Distinct words: longer ones first, ties by where they come first in ``order`` (a column that holds the order of the input)."""
    rows = words.where("word <> ''").groupBy("word").agg(F.min(order).alias("_at"))
    return rows.orderBy(F.char_length("word").desc(), "_at").select("word")


def inventory(words: DataFrame, responses: DataFrame) -> DataFrame:
    """One row a word of what a pronunciation service answered: responses has word, items (array of structs) or error."""
    rows = words.select(F.col("id").alias("hsk_id"), "word").join(responses.withColumnRenamed("word", "_w"), F.col("word") == F.col("_w"), "left")
    items = F.when(F.col("error").isNull(), F.coalesce("items", F.array().cast(dict(responses.dtypes)["items"]))).otherwise(F.array().cast(dict(responses.dtypes)["items"]))
    return rows.select("hsk_id", "word", F.lit("zh").alias("language"), F.size(items).alias("count"), items.alias("pronunciations"), "error")


def page(df: DataFrame, order: list[str], start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows from ``start`` in order; no limit for None or 0."""
    out = df.orderBy(*order).offset(start)
    return out.limit(limit) if limit else out


def speech_requests(words: DataFrame, voices: DataFrame) -> DataFrame:
    """Every word in every voice. Both are short lists that a person writes."""
    return words.select("word").distinct().crossJoin(F.broadcast(voices.select("voice").distinct())).withColumn("filename", F.concat(pinyin.safe_word(F.col("word")), F.lit("-"), "voice", F.lit(".mp3")))


def contained_passages(texts: DataFrame, text: str, needles: DataFrame, needle: str, words: int = 3) -> DataFrame:
    """As ``contained``, for passages of many words: looked up by the hash of their second and following words.

    Inside a passage those words are bounded by white space, so they are whole words of any text that holds it, and a text
    is looked up by its shingles of ``words`` words. Passages of fewer than words + 2 words, if there are any, go the way of
    ``contained``. Null and empty passages find nothing.
    """
    cut = lambda c: F.split(F.col(c), r"\s+")
    shingles = F.transform(F.sequence(F.lit(1), F.size("_w") - words + 1), lambda i: F.xxhash64(F.array_join(F.slice(F.col("_w"), i, words), " ")))
    windows = texts.withColumn("_w", cut(text)).where(F.size("_w") >= words).select(F.xxhash64(F.col(text)).alias("_text"), F.explode(F.array_distinct(shingles)).alias("_gram"))
    known = needles.where(F.coalesce(F.col(needle), F.lit("")) != "").withColumn("_n", cut(needle))
    long = known.where(F.size("_n") >= words + 2).withColumn("_needle_gram", F.xxhash64(F.array_join(F.slice("_n", 2, words), " "))).drop("_n")
    out = _met(windows, long, texts, text, needle)
    short = known.where(F.size("_n") < words + 2).drop("_n")
    if short.limit(1).count():
        out = out.unionByName(contained(texts, text, short, needle))
    return out
