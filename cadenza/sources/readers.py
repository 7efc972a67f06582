"""Sources: delimited text, dictionaries, JSON in three shapes, audio trees and archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.pinyin import normalize_reading
from . import schemas

#: Files of archives that a Python worker hands on at a time, and their bytes (one file may have more).
MEMBERS, MEMBER_BYTES = 1000, 4 << 20
MEMBER_COLUMNS = ["archive", "place", "member", "sound", "content"]


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Named columns of a delimited file with a header, as strings. Byte-order mark, doubled quotes and quoted line ends are understood."""
    return spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def with_columns_of(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns, in its order; those that the file lacks are null."""
    kinds = df.sparkSession.createDataFrame([], schema).schema
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds])


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return with_columns_of(read_csv(spark, path), schemas.HSK_CSV)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    return with_columns_of(read_csv(spark, path, "\t"), schemas.COMMON_VOICE)


def dictionary_entries(lines: DataFrame) -> DataFrame:
    """value -> simplified, traditional, pinyin, reading, definitions; blank lines, comments and lines of another form are skipped."""
    form = r"^(\S+) (\S+) \[([^]]+)\] /(.+)/$"
    rows = lines.where(~F.col("value").startswith("#") & F.col("value").rlike(form))
    part = lambda i: F.regexp_extract("value", form, i)
    rows = rows.select(part(2).alias("simplified"), part(1).alias("traditional"), part(3).alias("pinyin"), F.split(part(4), "/").alias("definitions"))
    return rows.withColumn("reading", normalize_reading(F.col("pinyin")))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A text dictionary, gzip or not. Gzip can't be split: entries are dealt out after parsing, not before."""
    return dictionary_entries(spark.read.text(path))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A file that is one object with keys of its own: key, and the value's fields (or ``value`` for plain strings)."""
    kind = value if value.strip() == "string" else f"struct<{', '.join(f'{a}: {b}' for a, b in (x.strip().split(' ', 1) for x in value.split(', ')))}>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{kind}>", {"mode": "FAILFAST"})).alias("key", "value"))
    return rows if value.strip() == "string" else rows.select("key", "value.*")


def read_quality(spark: SparkSession, path: str) -> DataFrame:
    """Reviews, flattened: source, key and the review's fields."""
    kind = ", ".join(f"{a}: {b}" for a, b in (x.split(" ") for x in schemas.QUALITY.split(", ")))
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,map<string,struct<{kind}>>>", {"mode": "FAILFAST"})).alias("source", "keys"))
    return whole.select("source", F.explode("keys").alias("key", "review")).select("source", "key", "review.*")


def read_log(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A log of one object a line. Lenient: bad lines and rows without an audio_path are left out; strict: a bad line is an error."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return rows if strict else rows.where("audio_path is not null")


def read_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content of files under a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path)


def audio_tree(files: DataFrame) -> DataFrame:
    """Files at .../source/word/name, joined to the JSON file of the same stem: source, word, filename, stem, sidecar (text or null)."""
    form = r"([^/]+)/([^/]+)/([^/]+)$"
    part = lambda i: F.regexp_extract("path", form, i)
    rows = files.where(F.col("path").rlike(form)).select("path", "content", part(1).alias("source"), part(2).alias("word"), part(3).alias("filename"))
    rows = rows.withColumns({"stem": F.regexp_replace("filename", r"\.[^.]*$", ""), "ending": F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))})
    audio = rows.where(F.col("ending").isin(*fixed.AUDIO_ENDINGS)).select("source", "word", "filename", "stem", "path")
    side = rows.where("filename = concat(stem, '.json')").select("source", "word", "stem", F.decode("content", "UTF-8").alias("sidecar"))
    return audio.join(side, ["source", "word", "stem"], "left")


def tree_paths(listing: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Names between prefix and suffix of an object listing (schemas.TREE). A truncated listing is an error."""
    whole = listing.select(F.when(F.coalesce("truncated", F.lit(False)), F.raise_error(F.lit("the listing is truncated")).cast("array<struct<path:string,type:string,size:bigint>>")).otherwise(F.col("tree")).alias("tree"))
    rows = whole.select(F.explode("tree").alias("t")).select("t.*").where(F.col("path").startswith(prefix) & F.col("path").endswith(suffix))
    return rows.select(F.expr(f"substring(path, {len(prefix) + 1}, length(path) - {len(prefix) + len(suffix)})").alias("name"), "path", "size")


def archive_entries(archives: DataFrame) -> DataFrame:
    """archive, place, member, sound, content of every file in ZIP archives (binaryFile rows). sound: its checksum holds."""
    return archives.select("path", "content").mapInPandas(unpacked, "archive string, place int, member string, sound boolean, content binary")


def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The files of archives, ``MEMBERS`` or ``MEMBER_BYTES`` at a time: a table for each would cost far more than to read it."""
    held, size = [], 0
    for path, content in ((p, c) for b in batches for p, c in zip(b["path"], b["content"], strict=True)):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for place, entry in enumerate(z.infolist()):
                if entry.is_dir():
                    continue
                try:
                    data, sound = z.read(entry), True
                except zipfile.BadZipFile:
                    data, sound = b"", False
                held.append((path, place, entry.filename, sound, data))
                size += len(data)
                if len(held) >= MEMBERS or size >= MEMBER_BYTES:
                    yield pd.DataFrame(held, columns=MEMBER_COLUMNS)
                    held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=MEMBER_COLUMNS)


def archive_members(archives: DataFrame, form: str = r"([a-zv]+[1-4])\.mp3", folder: str = "mp3", at_least: int = 0) -> DataFrame:
    """key, member, content of the files in ZIP archives that lie in a folder of that name, itself in a folder, and have that form.

    A damaged archive, a member that is no MPEG audio, or under ``at_least`` members of an archive is an error. Of two members with one key
    the later one counts.
    """
    entries = archive_entries(archives)
    damaged = F.col("archive").isNotNull() & ~F.col("sound")
    checked = entries.withColumn("member", F.when(damaged, F.raise_error(F.concat("archive", F.lit(" is damaged"))).cast("string")).otherwise(F.col("member")))
    name = F.element_at(F.split("member", "/"), -1)
    rows = checked.where((F.size(F.split("member", "/")) >= 3) & (F.try_element_at(F.split("member", "/"), F.lit(-2)) == folder) & name.rlike(f"^(?:{form})$"))
    rows = rows.withColumn("key", F.regexp_extract(name, f"^(?:{form})$", 1))
    last = rows.groupBy("archive", "key").agg(F.max_by(F.struct("member", "content"), "place").alias("m"))
    counts = archives.select(F.col("path").alias("archive")).join(rows.groupBy("archive").agg(F.count_distinct("key").alias("n")), "archive", "left")
    short = counts.where(F.coalesce("n", F.lit(0)) < at_least) if at_least else None
    if short is not None and (found := short.limit(1).collect()):
        raise ValueError(f"{found[0]['archive']} has {found[0]['n'] or 0} members of {at_least}")
    audio = reduce(lambda a, m: a | F.startswith(F.col("m.content"), F.unhex(F.lit(m))), fixed.MP3_MAGIC, F.lit(False))
    content = F.when(audio, F.col("m.content")).otherwise(F.raise_error(F.concat("m.member", F.lit(" is no MPEG audio"))).cast("binary"))
    return last.select("key", "m.member", content.alias("content"))


def constants(spark: SparkSession, rows: dict[str, object], schema: str) -> DataFrame:
    """A table of a fixed dictionary."""
    return spark.createDataFrame(list(rows.items()), schema)
