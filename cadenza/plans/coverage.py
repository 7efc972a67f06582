"""Registered queries at the size of the driver's tables, second part: each calls the engine on rows that its tables give, and its SQL works out the answer by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio, fixed, pinyin, segment
from ..operators import audits, bundle, ingest, selection, vocabulary
from ..sources import readers, sinks
from ..sources.shared import Scratch
from ..streaming import jobs
from .queries import literal, query, table

PARTS = "part"


def pick(items: list, index: Column) -> Column:
    """The item at the index, from 0, of a short list of constants."""
    return F.element_at(F.array(*map(F.lit, items)), index.cast("int") + 1)


def listed(items: list) -> str:
    return f"[{', '.join(map(literal, items))}]"


# Vocabulary

_IDS = [*fixed.TONE_OVERRIDES, *fixed.PINYIN_OVERRIDES, *fixed.SURFACE_OVERRIDES]
_BRACKETS = ["[hao3 ren2]", "[Ma1 ma5] x [li4]", "[hao ren]", "", "[a6 b4]", None]
_MARKED = ["nǐ hǎo|x", "Māma", "xī·ān r", "ABC def", "", "yī-èr"]
_TONES_SQL = f"""
  SELECT *, list_filter(list_transform(string_split_regex(trim(regexp_extract(coalesce(d, ''), '\\[([^\\]]+)\\]', 1)), '\\s+'), lambda t: regexp_extract(t, '([1-5])$', 1)), lambda t: t <> '') AS digits,
    list_filter(string_split_regex(pin, '[\\s·\\-]+'), lambda c: c <> '') AS chunks
"""
_MARKS = "".join(fixed.MARKED_VOWELS)
_ACCENT_SQL = f"""flatten(list_transform(chunks, lambda c: CASE WHEN len(regexp_extract_all(c, '[{_MARKS}{_MARKS.upper()}]')) > 0
   THEN list_transform(regexp_extract_all(c, '[{_MARKS}{_MARKS.upper()}]'), lambda m: CAST(((strpos('{_MARKS}{_MARKS.upper()}', m) - 1) % 24) // 6 + 1 AS INTEGER))
   WHEN regexp_matches(c, '^[A-Za-züÜvV]+$') THEN [0] ELSE CAST([] AS INTEGER[]) END))"""


def _map(name: str, items: dict) -> str:
    rows = ", ".join(f"({literal(k)}, {v if isinstance(v, list) else literal(v)})" for k, v in items.items())
    return f"{name} AS (SELECT * FROM (VALUES {rows}) AS t(id, v))"


@query(f"""
WITH {_map('tones', fixed.TONE_OVERRIDES)}, {_map('pins', fixed.PINYIN_OVERRIDES)}, {_map('surfaces', fixed.SURFACE_OVERRIDES)},
s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'P' || p_partkey ELSE {listed(_IDS)}[CAST(p_partkey % {len(_IDS)} AS INTEGER) + 1] END AS id, {listed(_BRACKETS)}[CAST(p_size % {len(_BRACKETS)} AS INTEGER) + 1] AS d,
             trim(string_split({listed(_MARKED)}[CAST(p_partkey % {len(_MARKED)} AS INTEGER) + 1], '|')[1]) AS own, trim(string_split(p_name || ' | other', '|')[1]) AS word FROM part),
p AS (SELECT s.*, coalesce(pins.v, own) AS pin FROM s LEFT JOIN pins ON pins.id = s.id),
t AS ({_TONES_SQL} FROM p),
u AS (SELECT t.*, coalesce(tones.v, CASE WHEN len(digits) > 0 THEN list_transform(digits, lambda x: CAST(x AS INTEGER) % 5) ELSE {_ACCENT_SQL} END) AS found FROM t LEFT JOIN tones ON tones.id = t.id)
SELECT k, id, word, pin AS pinyin, coalesce(array_to_string(list_transform(found, lambda x: CASE WHEN x = 0 THEN 'N' ELSE CAST(x AS VARCHAR) END), '-'), '') AS lexical_pattern,
  array_to_string(list_transform(surfaces.v, lambda x: CASE WHEN x = 0 THEN 'N' ELSE CAST(x AS VARCHAR) END), '-') || '/neutral_tone' AS overridden FROM u LEFT JOIN surfaces USING (id)
""")
def sc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rows to words, with overrides of tones, pinyin and surface by id, and tones of brackets or marks."""
    parts = table(spark, sf_dir, PARTS)
    ids = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("P"), F.col("p_partkey").cast("string"))).otherwise(pick(_IDS, F.col("p_partkey") % len(_IDS)))
    source = parts.select(ids.alias("ID"), F.concat("p_name", F.lit(" | other")).alias("Simplified"), F.lit("").alias("Traditional"), pick(_MARKED, F.col("p_partkey") % len(_MARKED)).alias("Pinyin"), F.col("p_partkey").cast("string").alias("POS"), F.lit("1").alias("Level"), pick(_BRACKETS, F.col("p_size") % len(_BRACKETS)).alias("CEDICT"))
    overridden = F.when(F.col("id").isin(*fixed.SURFACE_OVERRIDES), F.concat("default_surface_pattern", F.lit("/"), F.array_join("sandhi_tags", ";")))
    return vocabulary.build_words(source).select(F.col("pos").cast("long").alias("k"), "id", "word", "pinyin", "lexical_pattern", overridden.alias("overridden"))


_CHARS = ["不", "一", "第", "好", "人"]


def _place(i: int) -> str:
    c, t = f"c[{i}]", f"t[{i}]"
    before, after, tone = f"c[{i - 1}]" if i > 1 else "NULL", f"c[{i + 1}]", f"t[{i + 1}]"
    between = f"coalesce(al AND {c} IN ('不', '一') AND {before} = {after}, false)"
    bu = f"coalesce(al AND {c} = '不' AND NOT {between} AND {t} = 4 AND {tone} = 4, false)"
    yi = f"coalesce(al AND {c} = '一' AND NOT {between} AND {t} = 1 AND {before} IS DISTINCT FROM '第', false)"
    rises = f"coalesce({t} = 3 AND {tone} = 3, false)"
    surface = f"CASE WHEN {rises} THEN 2 WHEN {between} THEN 0 WHEN {bu} THEN 2 WHEN {yi} AND {tone} = 4 THEN 2 WHEN {yi} AND {tone} IN (1, 2, 3) THEN 4 ELSE {t} END"
    return f"{surface} AS s{i}, {between} AND {c} = '不' AS bb{i}, {between} AND {c} = '一' AS by{i}, {bu} AS bu{i}, {yi} AND coalesce({tone} = 4, false) AS y4{i}, {yi} AND coalesce({tone} IN (1, 2, 3), false) AS yn{i}, {rises} AS r{i}"


def _any(name: str) -> str:
    return f"({name}1 OR {name}2 OR {name}3)"


@query(f"""
WITH w AS (SELECT p_partkey AS k, [{', '.join(f"{listed(_CHARS)}[CAST(p_partkey // {5**i} % 5 AS INTEGER) + 1]" for i in range(3))}] AS c,
       list_transform(range(CASE WHEN p_partkey % 11 = 0 THEN 2 ELSE 3 END), lambda i: CAST(p_partkey // CAST(pow(3, i) AS BIGINT) * 7 % 5 AS INTEGER)) AS t FROM part),
x AS (SELECT *, len(t) = 3 AS al FROM w),
y AS (SELECT *, {_place(1)}, {_place(2)}, {_place(3)} FROM x)
SELECT k, array_to_string(c, '') AS word, array_to_string(list_transform([s1, s2, s3][1:len(t)], lambda v: CASE WHEN v = 0 THEN 'N' ELSE CAST(v AS VARCHAR) END), '-') AS surface,
  concat_ws(';', CASE WHEN {_any('bb')} THEN 'bu_a_not_a' END, CASE WHEN {_any('bu')} THEN 'bu_before_t4' END, CASE WHEN list_contains(t, 0) THEN 'neutral_tone' END, CASE WHEN r1 AND r2 THEN 'third_tone_grouping_ambiguous' END,
    CASE WHEN {_any('r')} THEN 'third_tone_sandhi' END, CASE WHEN {_any('y4')} THEN 'yi_before_t4' END, CASE WHEN {_any('yn')} THEN 'yi_before_non_t4' END, CASE WHEN {_any('by')} THEN 'yi_reduplication' END) AS tags,
  (r1 AND r2) OR NOT al AS review, 3::BIGINT AS n_chars FROM y
""")
def sc_sandhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface tones, tags and need of review of words of three characters, some with a tone too few."""
    k = F.col("p_partkey")
    chars = [pick(_CHARS, F.floor(k / 5**i) % 5) for i in range(3)]
    tones = F.transform(F.sequence(F.lit(0), F.when(k % 11 == 0, 1).otherwise(2)), lambda i: (F.floor(k / F.pow(F.lit(3), i)) * 7 % 5).cast("int"))
    rows = table(spark, sf_dir, PARTS).select(k.alias("k"), F.lit("").alias("id"), F.concat(*chars).alias("word"), tones.alias("lexical_tones"))
    rows = vocabulary.with_surface(rows)
    order = ["bu_a_not_a", "bu_before_t4", "neutral_tone", "third_tone_grouping_ambiguous", "third_tone_sandhi", "yi_before_t4", "yi_before_non_t4", "yi_reduplication"]
    tags = F.array_join(F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains("sandhi_tags", x)), ";")
    return rows.select("k", "word", pinyin.pattern(F.col("default_surface_tones")).alias("surface"), tags.alias("tags"), F.col("surface_label_needs_clip_review").alias("review"), F.size(pinyin.cjk_chars(F.concat(F.lit("a。"), "word"))).cast("long").alias("n_chars"))


_SYLLABLES = ["xi", "an", "xian", "ke", "ken", "eng", "neng", "nia", "o", "fang", "gan", "fan"]
_WRITTEN = ["xī", "ān", "xiān", "kě", "kěn", "ēng", "néng", "nia", "ò", "fāng", "gàn", "fan"]


@query(f"""
WITH v AS (SELECT unnest({listed(_SYLLABLES)}) AS s),
w AS (SELECT p_partkey AS k, {listed(_SYLLABLES)}[CAST(p_partkey % 12 AS INTEGER) + 1] AS a, {listed(_SYLLABLES)}[CAST(p_partkey // 12 % 12 AS INTEGER) + 1] AS b, p_size % 4 = 0 AS cut FROM part),
g AS (SELECT k, x.s AS x, y.s AS y, cut AND len(x.s) = len(a) AS kept,
        100 * CASE WHEN left(y.s, 1) IN ('a', 'e', 'o') AND NOT (cut AND len(x.s) = len(a)) THEN 1 ELSE 0 END + 5 * (CASE WHEN x.s = 'nia' THEN 1 ELSE 0 END + CASE WHEN y.s = 'nia' THEN 1 ELSE 0 END) - CASE WHEN cut AND len(x.s) = len(a) THEN 1 ELSE 0 END AS cost
      FROM w, v x, v y WHERE x.s || y.s = a || b AND (NOT cut OR len(x.s) = len(a))),
best AS (SELECT k, x, y FROM g QUALIFY cost = min(cost) OVER (PARTITION BY k)),
one AS (SELECT k, min(x) AS x, min(y) AS y FROM best GROUP BY k HAVING count(*) = 1)
SELECT w.k, coalesce(x || ' ' || y, '') AS syllables FROM w LEFT JOIN one USING (k)
""")
def sc_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two written syllables in one text, with and without a mark between, cut again; undecided where several ways cost the same."""
    k = F.col("p_partkey")
    text = F.concat(pick(_WRITTEN, k % 12), F.when(F.col("p_size") % 4 == 0, "'").otherwise(""), pick(_WRITTEN, F.floor(k / 12) % 12))
    rows = table(spark, sf_dir, PARTS).select(k.alias("k"), text.alias("pinyin"), F.array(F.lit(1), F.lit(1)).alias("lexical_tones"))
    return vocabulary.add_syllables(rows, _SYLLABLES).select("k", F.array_join("pinyin_syllables", " ").alias("syllables"))


_PLAIN_OF = dict(zip(_WRITTEN, _SYLLABLES, strict=True))
_TONE_AT = [next((t for t, marks in enumerate(fixed.MARKED_VOWELS, 1) if any(m in w for m in marks)), 0) for w in _WRITTEN]


@query(f"""
SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN NULL ELSE {listed(_TONE_AT)}[CAST(p_partkey % 12 AS INTEGER) + 1] || ' ' || {listed(_TONE_AT)}[CAST(p_partkey // 12 % 12 AS INTEGER) + 1] END AS tones FROM part
""")
def sc_syllable_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the tones that a text's marks give its syllables; none where the letters differ."""
    k = F.col("p_partkey")
    plain = F.array(pick(_SYLLABLES, k % 12), F.concat(pick(_SYLLABLES, F.floor(k / 12) % 12), F.when(F.col("p_size") % 5 == 0, "x").otherwise("")))
    rows = table(spark, sf_dir, PARTS).select("p_partkey", F.concat(pick(_WRITTEN, k % 12), F.lit(" "), pick(_WRITTEN, F.floor(k / 12) % 12)).alias("pinyin"), plain.alias("s"))
    return rows.select(k.alias("k"), F.array_join(segment.syllable_tones_column(F.col("pinyin"), F.col("s")), " ").alias("tones"))


@query("""
WITH e AS (SELECT p_partkey, 'w' || p_partkey % 50 AS simp, 'w' || p_partkey % 50 || CASE WHEN p_size % 2 = 0 THEN 't' ELSE '' END AS trad, (CASE WHEN p_size % 3 = 0 THEN 'Ma' ELSE 'ma' END) || (p_size % 5 + 1) AS pin,
             array_to_string(list_filter(CASE WHEN p_size % 4 = 0 THEN ['CL:x'] ELSE [p_type, p_name] END, lambda d: d NOT LIKE 'CL:%'), '; ') AS txt FROM part),
n AS (SELECT simp, count(*) AS n FROM e GROUP BY simp),
w AS (SELECT s_suppkey AS id, 'w' || s_suppkey % 60 AS word, 'w' || s_suppkey % 60 || 't' AS trad, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'ma' || CASE s_suppkey % 5 WHEN 0 THEN 5 ELSE s_suppkey % 5 END END AS reading FROM supplier),
m AS (SELECT w.id, txt, (CASE WHEN e.trad = w.trad THEN 0 ELSE 5 END) + CASE WHEN regexp_matches(pin, '[A-Z]') THEN 3 ELSE 0 END AS score
      FROM w JOIN e ON e.simp = w.word JOIN n ON n.simp = e.simp WHERE txt <> '' AND (reading = lower(pin) OR reading IS NULL AND n = 1))
SELECT CAST(id AS VARCHAR) AS id, txt AS definition FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY score, txt) = 1
""")
def sc_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary lines of parts, and the best of each supplier's word."""
    n = F.col("p_size")
    simp = F.concat(F.lit("w"), (F.col("p_partkey") % 50).cast("string"))
    line = F.concat(simp, F.when(n % 2 == 0, "t").otherwise(""), F.lit(" "), simp, F.lit(" ["), F.when(n % 3 == 0, "Ma").otherwise("ma"), (n % 5 + 1).cast("string"), F.lit("] /"), F.when(n % 4 == 0, F.lit("CL:x")).otherwise(F.concat("p_type", F.lit("/"), "p_name")), F.lit("/"))
    entries = readers.dictionary_entries(table(spark, sf_dir, PARTS).select(line.alias("value")).union(spark.createDataFrame([("# a comment",), ("no entry",)], "value string")))
    s = F.col("s_suppkey")
    word = F.concat(F.lit("w"), (s % 60).cast("string"))
    none = s % 4 == 0
    words = table(spark, sf_dir, "supplier").select(s.cast("string").alias("id"), word.alias("word"), F.concat(word, F.lit("t")).alias("traditional"), F.when(none, F.array().cast("array<string>")).otherwise(F.array(F.lit("ma"))).alias("pinyin_syllables"), F.when(none, F.array().cast("array<int>")).otherwise(F.array((s % 5).cast("int"))).alias("lexical_tones"))
    return vocabulary.add_definitions(words, entries)


@query("""
SELECT s_suppkey AS k, coalesce(nullif(CASE WHEN p_size % 3 <> 0 THEN CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END END, ''), nullif(CASE WHEN s_nationkey % 2 = 0 THEN s_name ELSE '' END, ''), '') AS definition
FROM supplier LEFT JOIN part ON p_partkey = s_suppkey
""")
def sc_word_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left join definitions, with the word's own where that has none."""
    words = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")).otherwise("").alias("definition"))
    own = table(spark, sf_dir, PARTS).where("p_size % 3 <> 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")).alias("definition"))
    return vocabulary.attach_definitions(words, own).select(F.col("id").alias("k"), "definition")


@query("SELECT count(*) AS entries, count(*) FILTER (WHERE c_mktsegment LIKE '%U%') AS tagged, count(*) FILTER (WHERE c_nationkey % 3 = 0) AS review FROM customer")
def sc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: entries, tagged ones, and those that need review."""
    tags = F.when(F.col("c_mktsegment").contains("U"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return vocabulary.counts(table(spark, sf_dir, "customer").select(tags.alias("sandhi_tags"), (F.col("c_nationkey") % 3 == 0).alias("surface_label_needs_clip_review")))


@query("SELECT DISTINCT CASE lower(regexp_replace(p_name, '[^a-z]', '', 'g')) WHEN 'jv' THEN 'ju' ELSE lower(regexp_replace(p_name, '[^a-z]', '', 'g')) END AS syllable FROM part WHERE p_size BETWEEN 1 AND 30 UNION SELECT 'r' UNION SELECT 'ju'")
def sc_syllable_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the syllables that file names hold, and two that are named otherwise."""
    names = table(spark, sf_dir, PARTS).where(F.col("p_size").between(1, 40)).select(F.concat(F.lit("cmn-"), F.regexp_replace("p_name", "[^a-z]", ""), F.when(F.col("p_size") <= 30, (F.col("p_size") % 5 + 1).cast("string")).otherwise("x"), F.lit(".mp3")).alias("name"))
    names = names.union(spark.createDataFrame([("cmn-jv3.mp3",), ("cmn-MA1.mp3",), ("cmn-_ju2.mp3",)], "name string"))
    return spark.createDataFrame([(s,) for s in vocabulary.syllable_vocabulary(names, 3)], "syllable string")


# Strings


@query("""
SELECT page_id, lower(regexp_replace(url, '[^\\x{3400}-\\x{9fff}A-Za-z0-9]+', '', 'g')) AS txt, replace(replace(url, '/', '／'), '\\', '＼') AS safe,
  replace(replace(replace(replace(replace(left(html, 300), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
  coalesce(url, '') || '|' || page_id || '+x|' || length(html) AS reading, coalesce(nullif(CASE WHEN page_id % 2 = 0 THEN '' ELSE 's' END, ''), nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE 'l' END, '')) AS pattern,
  CASE page_id % 3 WHEN 0 THEN 'audio-cmn' WHEN 1 THEN 'public pinyin' ELSE 'forvo' END AS shown, CASE WHEN page_id % 2 = 0 THEN '../audio/' || page_id ELSE url END AS link,
  CASE WHEN page_id % 4 = 3 THEN '' ELSE 'lv' || page_id % 4 + 1 || ' nv' END AS syllables, CASE WHEN page_id % 4 = 3 THEN '' ELSE 'lv nv' END AS bases
FROM pages
""")
def sc_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, file names, escapes, keys of readings, patterns, shown sources, links and recognised syllables."""
    i, url = F.col("page_id"), F.col("url")
    heard = pinyin.normalized_syllables(F.array(F.concat(F.lit(" LÜ"), F.when(i % 4 == 3, F.lit("?")).otherwise((i % 4 + 1).cast("string"))), F.when(i % 4 == 3, "1").otherwise("nü")))
    return table(spark, sf_dir, "pages").select(
        "page_id", pinyin.normalized_text(url).alias("txt"), pinyin.safe_word(url).alias("safe"), pinyin.escape_html(F.substring("html", 1, 300)).alias("escaped"),
        pinyin.reading_key(url, F.array(i.cast("string"), F.lit("x")), F.length("html").cast("string")).alias("reading"),
        pinyin.expected_pattern(F.when(i % 2 == 0, "").otherwise("s"), F.when(i % 3 == 0, "").otherwise("l")).alias("pattern"),
        pinyin.source_name(pick(["audio_cmn", "mp3_chinese_pinyin_sound", "forvo"], i % 3)).alias("shown"), pinyin.audio_url(F.when(i % 2 == 0, F.concat(F.lit("audio/"), i.cast("string"))).otherwise(url)).alias("link"),
        F.array_join(heard, " ").alias("syllables"), F.array_join(pinyin.bases(heard), " ").alias("bases"),
    )


@query("""
SELECT event_id, a || '-' || b AS chosen, a = c AND b = d AND event_id % 7 <> 0 AS correct, CASE WHEN a = c THEN 'y' ELSE 'n' END || CASE WHEN b = d THEN 'y' ELSE 'n' END || CASE WHEN event_id % 7 = 0 THEN 'n' ELSE '' END AS marks
FROM (SELECT event_id, event_id % 4 + 1 AS a, user_id % 2 AS b, event_id // 4 % 4 + 1 AS c, user_id // 2 % 2 AS d FROM events)
""")
def sc_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answers against the right pattern, which is sometimes longer."""
    e, u = F.col("event_id"), F.col("user_id")
    two = lambda a, b: F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
    right = F.concat(two(F.floor(e / 4) % 4 + 1, F.floor(u / 2) % 2), F.when(e % 7 == 0, "-1").otherwise(""))
    rows = selection.grade(table(spark, sf_dir, "events").select("event_id", two(e % 4 + 1, u % 2).alias("selected_pattern"), right.alias("correct_pattern")))
    return rows.select("event_id", F.col("selected_pattern").alias("chosen"), "correct", F.array_join(F.transform("marks", lambda m: F.when(m, "y").otherwise("n")), "").alias("marks"))


@query("SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 40 OFFSET 25")
def sc_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of rows in order."""
    return ingest.page(table(spark, sf_dir, "events").select("event_id", "user_id"), ["event_id"], 25, 40)


@query("SELECT word, row_number() OVER (ORDER BY length(word) DESC, first_at) AS place FROM (SELECT p_name AS word, min(p_partkey) AS first_at FROM part GROUP BY p_name)")
def sc_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, O3: words by falling length, ties as they first came."""
    words = ingest.longest_first(table(spark, sf_dir, PARTS).select(F.col("p_name").alias("word"), "p_partkey"), "p_partkey")
    place = audits.numbered(words.join(table(spark, sf_dir, PARTS).groupBy(F.col("p_name").alias("word")).agg(F.min("p_partkey").alias("at")), "word").withColumn("short", -F.char_length("word")), ["short", "at"])
    return place.select("word", (F.col("_place") + 1).alias("place"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def sc_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key, in order."""
    return ingest.first_of_each(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1 OR doc_id % 9 = 0)")
def sc_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that neither of two logs has."""
    labels = table(spark, sf_dir, "labels")
    done = labels.where("quality = 0").select("doc_id").union(labels.where("toxic = 1 or doc_id % 9 = 0").select("doc_id")).union(spark.createDataFrame([(None,)], "doc_id long"))
    return audits.pending(table(spark, sf_dir, "documents").select("doc_id", "source"), done, "doc_id")


# Audits


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 1 THEN 'ID3' || doc_id % 1000 ELSE coalesce(text, '') END) AS payload, doc_id % 4 < 2 AS mp3 FROM documents")
def sc_payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of contents without their ID3 tag (a third has one, of 131 bytes; a third is too short to have one), and known first bytes."""
    k = F.col("doc_id")
    tag = F.concat(F.unhex(F.lit("494433040000")), F.unhex(F.lit("00000103")), F.repeat(F.lit("t"), 131).cast("binary"))  # 131 = 1 * 128 + 3
    text = F.coalesce("text", F.lit("")).cast("binary")
    content = F.when(k % 3 == 0, F.concat(tag, text)).when(k % 3 == 1, F.concat(F.lit("ID3"), (k % 1000).cast("string")).cast("binary")).otherwise(text)
    head = F.concat(F.unhex(pick(["494433", "FFFB", "52494646", "00"], k % 4)), F.lit("body").cast("binary"))
    return table(spark, sf_dir, "documents").select("doc_id", audio.payload_hash(content).alias("payload"), audio.valid_mp3(head).alias("mp3"))


@query("""
WITH f AS (SELECT coalesce(source, '') AS source, sha256(coalesce(text, '')) AS payload, d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT source, payload, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS keys, count(*) AS n_keys, count(*) FILTER (WHERE quality IS DISTINCT FROM 0) AS healthy,
  CASE WHEN count(*) FILTER (WHERE quality IS DISTINCT FROM 0) <= 1 THEN 'quarantined' ELSE 'unquarantined' END AS status FROM f GROUP BY source, payload HAVING count(*) > 1 AND count(*) <= 1000
""")
def sc_group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal payloads of one source with the list of their keys; groups whose list is cut are in sc_dup_groups."""
    files = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id").alias("key"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("payload"))
    reviews = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 0, "bad").otherwise("good").alias("status"))
    reviews = files.select("source", "key").join(reviews, "key").select("source", "key", "status")
    rows = audits.duplicate_groups(files, reviews).where(F.col("n_keys") <= audits.LISTED)
    return rows.select("source", "payload", F.array_join(F.col("keys").cast("array<string>"), ",").alias("keys"), "n_keys", "healthy", "status")


@query("""
WITH e AS (SELECT vec_id, k, list_transform(embedding, lambda x: (20 + 5 * k) * CAST(x AS DOUBLE)) AS v, len(embedding) AS n FROM embeddings, range(1, 4) r(k) WHERE len(embedding) >= 2 AND NOT (vec_id % 7 = 0 AND k = 3)),
p AS (SELECT vec_id, list_transform(range(9), lambda i: v[CAST(floor(i * (n - 1) / 8.0) AS INTEGER) + 1]
        + (i * (n - 1) / 8.0 - floor(i * (n - 1) / 8.0)) * (v[least(n, CAST(floor(i * (n - 1) / 8.0) AS INTEGER) + 2)] - v[CAST(floor(i * (n - 1) / 8.0) AS INTEGER) + 1])) AS q FROM e),
m AS (SELECT vec_id, vec_id % 4 + 1 AS tone, (q[7] + q[8]) / 2 - (q[2] + q[3]) / 2 AS delta, (q[7] + q[8]) / 2 - list_min(q[2:5]) AS rise, list_max(q[2:8]) - list_min(q[2:8]) AS span FROM p),
b AS (SELECT vec_id, tone, count(*) AS n, bool_and(abs(delta) > 3.5 AND span > 4) AS c1, bool_and(rise < 1.25 AND span < 2) AS c2, bool_and(-delta > 3 AND span > 4) AS c3, bool_and(-delta < 1.25 AND span < 2) AS c4, bool_and(delta > 3 AND span > 4) AS c5 FROM m GROUP BY vec_id, tone),
f AS (SELECT vec_id, CASE WHEN tone = 1 AND c1 THEN 'strongly non-level tone 1' WHEN tone = 2 AND c2 THEN 'flat tone-1-like tone 2' WHEN tone = 2 AND c3 THEN 'falling tone 2' WHEN tone = 4 AND c4 THEN 'flat tone-1-like tone 4' WHEN tone = 4 AND c5 THEN 'rising tone 4' END AS reason, tone FROM b WHERE n = 3)
SELECT 'k' || vec_id || '/' || tone AS key, reason, vec_id % 3 = 0 AS required, vec_id % 5 = 0 AS quarantined FROM f WHERE reason IS NOT NULL
""")
def sc_tone_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that all three trackers contradict (some keys have two), with what the policy says of them."""
    v = F.col("vec_id")
    each = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k")).where("not (vec_id % 7 = 0 and k = 3)")
    points = audio.interpolated(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (F.lit(20) + 5 * F.col("k"))))
    rows = each.select(F.lit("s").alias("source"), F.concat(F.lit("k"), v.cast("string"), F.lit("/"), (v % 4 + 1).cast("string")).alias("key"), pick(["pyin", "praat", "world"], F.col("k") - 1).alias("method"), points.alias("points"), "vec_id")
    quality = rows.select("source", "key", F.when(v % 5 == 0, "bad").otherwise("good").alias("status")).distinct()
    return audits.tone_flags(rows.drop("vec_id"), rows.where("vec_id % 3 = 0").select("key"), quality).select("key", "reason", "required", "quarantined")


@query("""
SELECT doc_id, lang AS base, CASE WHEN quality IS NULL THEN 'unrecognized' WHEN toxic = 0 THEN 'match' ELSE 'review' END AS status,
  CASE WHEN quality IS NULL OR toxic = 0 THEN NULL WHEN quality = 1 THEN 'match' ELSE 'unrecognized' END AS second
FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IS NOT NULL
""")
def sc_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a first and a second transcriber heard; labels stand for what they say."""
    docs = table(spark, sf_dir, "documents").where("lang is not null").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    heard = F.when(F.col("quality").isNotNull(), F.array(F.lit("zz"), F.when(F.col("toxic") == 0, F.col("lang")).otherwise(F.lit("yy"))))
    rows = docs.select(F.col("doc_id").alias("audio_path"), F.col("lang").alias("base"), audits.identity_status(F.col("lang"), heard).alias("status"), "quality")
    second = docs.select(F.col("doc_id").alias("audio_path"), F.lit("t").alias("transcript"), F.when(F.col("quality") == 1, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("bases"))
    sure = audits.confirm(rows, second).select("audio_path", F.col("paraformer_status").alias("second"))
    return rows.join(sure, "audio_path", "left").select(F.col("audio_path").alias("doc_id"), "base", "status", "second")


@query("""
WITH w AS (SELECT p_name AS word, CASE WHEN p_size % 4 = 0 THEN [] WHEN p_size % 4 = 1 THEN ['lü', 'an'] ELSE ['ke'] END AS s, CASE WHEN p_size % 6 < 2 THEN [p_size % 5, 4] WHEN p_size % 6 < 4 THEN [p_size % 5] ELSE [] END AS t FROM part),
x AS (SELECT word, array_to_string(list_transform(range(len(s)), lambda i: replace(s[i + 1], 'ü', 'v') || CASE WHEN t[i + 1] = 0 THEN 5 ELSE t[i + 1] END), ' ') AS r FROM w WHERE len(s) = len(t)),
e AS (SELECT word, string_agg(DISTINCT r, '|' ORDER BY r) AS expected FROM x GROUP BY word)
SELECT p_partkey AS k, p_name AS word, expected FROM part JOIN e ON word = p_name WHERE p_partkey % 2 = 0 AND p_partkey % 3 = 0
""")
def sc_audit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolated words of the first corpus with their expected readings: of entries with as many syllables as tones."""
    n, k = F.col("p_size"), F.col("p_partkey")
    parts = table(spark, sf_dir, PARTS)
    syllables = F.when(n % 4 == 0, F.array().cast("array<string>")).when(n % 4 == 1, F.array(F.lit("lü"), F.lit("an"))).otherwise(F.array(F.lit("ke")))
    tones = F.when(n % 6 < 2, F.array(n % 5, F.lit(4))).when(n % 6 < 4, F.array(n % 5)).otherwise(F.array().cast("array<int>"))
    words = parts.select(F.col("p_name").alias("word"), syllables.alias("pinyin_syllables"), tones.alias("lexical_tones"))
    recordings = parts.select(k.alias("k"), F.col("p_name").alias("word"), F.when(k % 2 == 0, "audio_cmn").otherwise("forvo").alias("source"), F.when(k % 3 == 0, "isolated_word").when(k % 3 == 1, "context").alias("recording_type"))
    rows = audits.native_candidates(recordings, words)
    text = F.array_sort(F.array_distinct(F.transform("expected", lambda e: F.array_join(e, " "))))
    return rows.select("k", "word", F.array_join(text, "|").alias("expected"))


@query("SELECT p_partkey AS k, left(p_name, 1) AS word FROM part WHERE left(p_name, 1) IN (SELECT left(p_name, 1) FROM part WHERE p_size < 20 GROUP BY 1 HAVING count(DISTINCT p_type) > 1)")
def sc_polyphonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single characters with several bases."""
    parts = table(spark, sf_dir, PARTS)
    readings = parts.where("p_size < 20").select(F.substring("p_name", 1, 1).alias("word"), F.col("p_type").alias("base")).union(parts.select("p_name", "p_type"))
    return audits.polyphonic(parts.select(F.col("p_partkey").alias("k"), F.substring("p_name", 1, 1).alias("word")), readings)


@query("SELECT 's' || p_size % 3 AS source, regexp_replace(p_name, '[^a-z]', '', 'g') AS base, string_agg(DISTINCT (p_size % 4 + 1) || '=' || p_brand, ' ' ORDER BY (p_size % 4 + 1) || '=' || p_brand) AS paths FROM (SELECT *, row_number() OVER (PARTITION BY p_size % 3, p_name, p_size % 4 ORDER BY p_partkey) AS n FROM part) WHERE n = 1 GROUP BY 1, 2")
def sc_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the tones of each base with their paths, as a map."""
    parts = ingest.first_of_each(table(spark, sf_dir, PARTS).withColumns({"s": F.col("p_size") % 3, "t": F.col("p_size") % 4 + 1}), ["s", "p_name", "t"], ["p_partkey"])
    files = parts.select(F.concat(F.lit("s"), F.col("s").cast("string")).alias("source"), F.concat(F.regexp_replace("p_name", "[^a-z]", ""), F.col("t").cast("string")).alias("key"), F.col("p_brand").alias("path"))
    rows = audits.family_paths(files.union(spark.createDataFrame([("s0", "x9", "p"), ("s0", "", "p")], "source string, key string, path string")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("paths")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return rows.select("source", "base", shown.alias("paths"))


@query("SELECT doc_id AS audio_path, least(coalesce(a, b), coalesce(b, a)) AS status FROM (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN coalesce(lang, '') END AS a, CASE WHEN doc_id % 2 = 0 THEN coalesce(source, '') END AS b FROM documents) WHERE a IS NOT NULL OR b IS NOT NULL")
def sc_merged_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs that share rows, one row a path."""
    docs = table(spark, sf_dir, "documents")
    logs = [docs.where(w).select(F.col("doc_id").alias("audio_path"), F.coalesce(c, F.lit("")).alias("status")) for w, c in (("doc_id % 3 <> 0", "lang"), ("doc_id % 2 = 0", "source"))]
    return audits.merge_shards(*logs)


@query("SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE event_type END AS status, count(*) AS n FROM events GROUP BY 1")
def sc_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes counted by what stands before the first colon."""
    state = F.when(F.col("event_type") == "error", F.concat(F.lit("failed: "), F.col("value").cast("string"), F.lit(": again"))).otherwise(F.col("event_type"))
    return audits.status_counts(table(spark, sf_dir, "events").select(state.alias("status")))


@query("""
WITH w AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || p_partkey // 2 % 40 AS word, p_type AS pin, CASE WHEN p_size % 6 = 0 THEN ['ma', 'ma'] WHEN p_size % 8 = 1 THEN ['r'] ELSE ['ma'] END AS s, CAST(p_size % 5 AS VARCHAR) AS lex,
             CASE p_size % 9 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'N' ELSE CAST(p_size % 4 + 1 AS VARCHAR) END AS surf, p_size % 7 = 0 AS review FROM part),
x AS (SELECT *, coalesce(nullif(surf, ''), nullif(lex, '')) AS expected, count(DISTINCT 1) AS one FROM w GROUP BY ALL),
amb AS (SELECT word, count(DISTINCT pin || '|' || array_to_string(s, '+') || '|' || lex) > 1 AS ambiguous FROM w GROUP BY word),
r AS (SELECT 'a' || p_partkey AS path, p_name || p_partkey // 2 % 40 AS word, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 5 = 1 THEN '' END AS owner,
             CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 4 + 1 AS VARCHAR) END AS label, CASE p_partkey % 11 WHEN 0 THEN false WHEN 1 THEN true END AS eligible, CASE p_partkey % 13 WHEN 0 THEN 'yue' WHEN 1 THEN '' WHEN 2 THEN 'zh' END AS lang FROM part WHERE p_partkey % 17 <> 0),
e AS (SELECT DISTINCT x.id FROM x JOIN amb USING (word) JOIN r ON r.word = x.word WHERE eligible IS DISTINCT FROM false AND coalesce(nullif(lang, ''), 'zh') = 'zh' AND (NOT review OR label IS NOT NULL)
        AND CASE WHEN nullif(owner, '') IS NOT NULL THEN owner = x.id WHEN label IS NOT NULL THEN label = expected ELSE NOT ambiguous END)
SELECT id FROM x WHERE id IN (SELECT id FROM e) AND len(s) = len(list_filter(string_split(coalesce(expected, ''), '-'), lambda t: t <> '')) AND NOT (s[1] = 'r' AND expected IN ('1', '2', '3', '4'))
""")
def sc_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that can be practised: with a recording of theirs, aligned, and with a comparison for every tone."""
    k, n = F.col("p_partkey"), F.col("p_size")
    parts, word = table(spark, sf_dir, PARTS), F.concat("p_name", (F.floor(k / 2) % 40).cast("string"))
    tone = (n % 4 + 1).cast("string")
    words = parts.select(
        k.cast("string").alias("id"), word.alias("word"), F.col("p_type").alias("pinyin"), F.when(n % 6 == 0, F.array(F.lit("ma"), F.lit("ma"))).when(n % 8 == 1, F.array(F.lit("r"))).otherwise(F.array(F.lit("ma"))).alias("pinyin_syllables"),
        (n % 5).cast("string").alias("lexical_pattern"), F.array(n % 5).alias("lexical_tones"), F.when(n % 9 == 0, "").when(n % 9 == 1, None).when(n % 9 == 2, "N").otherwise(tone).alias("default_surface_pattern"),
        (n % 7 == 0).alias("surface_label_needs_clip_review"), F.array().cast("array<string>").alias("sandhi_tags"),
    )
    recordings = parts.where(k % 17 != 0).select(
        F.concat(F.lit("a"), k.cast("string")).alias("audio_path"), word.alias("word"), F.lit("audio_cmn").alias("source"), F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, "").alias("hsk_id"), F.when(k % 3 == 0, tone).alias("surface_pattern"),
        F.when(k % 11 == 0, False).when(k % 11 == 1, True).alias("quiz_eligible"), F.when(k % 13 == 0, "yue").when(k % 13 == 1, "").when(k % 13 == 2, "zh").alias("language_code"),
    )
    reviews = spark.createDataFrame([], "source string, key string, status string, replacement string, replacement_audio_path string, replacement_source string")
    return selection.practice_pool(words, recordings, reviews, spark.createDataFrame([], "key string, audio_path string, source string")).select("id")


# Sound


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, len(embedding) AS n FROM embeddings WHERE len(embedding) >= 2),
c AS (SELECT vec_id, n, list_transform(v, lambda x: x - list_avg(v)) AS v FROM e), s AS (SELECT vec_id, n, v, list_max(list_transform(v, lambda x: abs(x))) AS peak FROM c),
w AS (SELECT vec_id, n, list_transform(v, lambda x: CASE WHEN peak > 0 THEN x / peak ELSE x END) AS v FROM s)
SELECT vec_id, round(list_aggregate(list_transform(range(8000), lambda i: v[CAST(floor(i * (n - 1) / 7999.0) AS INTEGER) + 1] + (i * (n - 1) / 7999.0 - floor(i * (n - 1) / 7999.0)) * (v[least(n, CAST(floor(i * (n - 1) / 7999.0) AS INTEGER) + 2)] - v[CAST(floor(i * (n - 1) / 7999.0) AS INTEGER) + 1])), 'sum') / 8000, 6) AS level,
  round(v[1], 6) AS begins, round(v[n], 6) AS ends FROM w
""")
def sc_normalized_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """each vector centred, scaled to its peak and brought to 8,000 samples."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 2).select("vec_id", audio.normalized_wave_column(F.col("embedding").cast("array<double>")).alias("w"))
    level = F.aggregate("w", F.lit(0.0), lambda s, x: s + x) / F.size("w")
    return rows.select("vec_id", F.round(level, 6).alias("level"), F.round(F.element_at("w", 1), 6).alias("begins"), F.round(F.element_at("w", -1), 6).alias("ends"))


@query("""
WITH n AS (SELECT n_nationkey AS k, list_transform(range(6000), lambda i: ((i * 7919 + n_nationkey * 104729) % 2001 - 1000) / 4000.0 + n_nationkey / 100.0) AS v FROM nation),
o AS (SELECT k, v, list_sum(v) / 6000 AS o FROM n), c AS (SELECT k, o, list_transform(v, lambda x: x - o) AS v FROM o),
a AS (SELECT k, o, v, list_filter(v, lambda x: abs(x) >= 0.01) AS t FROM c),
g AS (SELECT k, o, v, CASE WHEN len(t) > 0 THEN least(0.16 / sqrt(list_dot_product(t, t) / len(t)), 0.9 / list_max(list_transform(v, lambda x: abs(x))), 12) ELSE 1 END AS gain FROM a)
SELECT k, round(o, 6) AS off_set, round(gain, 6) AS gain, CAST(2 * 6000 + 1920 + 960 + 3200 AS BIGINT) AS n, round(v[1] * gain, 6) AS first, round(v[6000] * gain, 6) AS last FROM g
""")
def sc_long_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, F32: offset and gain of 6,000 samples, and two such clips put together."""
    k = F.col("n_nationkey")
    wave = F.transform(F.sequence(F.lit(0), F.lit(5999)), lambda i: ((i * 7919 + k * 104729) % 2001 - 1000) / 4000.0 + k / 100.0)
    rows = table(spark, sf_dir, "nation").select(k.alias("k"), F.array(wave).alias("c"))
    rows = rows.withColumn("all", audio.assemble(F.array("c", "c"), 16_000, F.array(F.lit(16_000), F.lit(16_000)))[0])
    return rows.select("k", F.round(audio.offsets(F.col("c"))[0], 6).alias("off_set"), F.round(audio.gain(F.col("c")), 6).alias("gain"), F.size("all").cast("long").alias("n"), F.round(F.element_at("all", 1921), 6).alias("first"), F.round(F.element_at("all", -3201), 6).alias("last"))


@query("""
WITH g AS (SELECT o_custkey, list(o_orderkey % 97 / 100.0 ORDER BY o_orderkey) AS s, list(o_orderkey % 97 / 100.0 + o_orderkey % 13 / 25.0 ORDER BY o_orderkey) AS e FROM orders GROUP BY o_custkey),
l AS (SELECT o_custkey, list_max(list_filter(list_transform(range(len(s)), lambda i: CASE WHEN s[i + 1] > 0.03 AND 1.5 - e[i + 1] > 0.03 THEN e[i + 1] - s[i + 1] END), lambda x: x IS NOT NULL)) AS m FROM g)
SELECT o_custkey, round(CASE WHEN m >= 0.18 THEN m END, 6) AS silence FROM l
""")
def sc_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the longest silence inside of a clip."""
    k = F.col("o_orderkey")
    start = k % 97 / 100.0
    each = F.array_sort(F.collect_list(F.struct(k.alias("k"), start.alias("s"), (start + k % 13 / 25.0).alias("e"))))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(each.alias("g"))
    return rows.select("o_custkey", F.round(audio.internal_silence(F.col("g.s"), F.col("g.e"), F.lit(1.5)), 6).alias("silence"))


@query("""
WITH e AS (SELECT vec_id, list_filter(list_transform(embedding, lambda x: CASE WHEN abs(CAST(x AS DOUBLE)) > 0.05 THEN 200 + 400 * CAST(x AS DOUBLE) END), lambda f: f IS NOT NULL AND f > 85) AS f FROM embeddings),
s AS (SELECT vec_id, list_filter(list_transform(f, lambda x: 12 * log2(x / list_median(f))), lambda x: abs(x) <= 12) AS v FROM e WHERE len(f) >= 5)
SELECT vec_id, round(v[1], 6) AS first, round(CASE WHEN len(v) % 2 = 1 THEN v[len(v) // 2 + 1] ELSE (v[len(v) // 2] + v[len(v) // 2 + 1]) / 2 END, 6) AS middle, round(v[len(v)], 6) AS last FROM s WHERE len(v) >= 5
""")
def sc_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nine points in semitones from the median of a pitch track with unvoiced frames."""
    track = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) > 0.05, 200 + 400 * x))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", audio.contour_column(track).alias("p")).where("p is not null")
    at = lambda i: F.round(F.element_at("p", i), 6)
    return rows.select("vec_id", at(1).alias("first"), at(5).alias("middle"), at(9).alias("last"))


# Sources and sinks


@query("SELECT p_partkey, p_name || '\"' AS word, CASE WHEN p_size % 2 = 0 THEN 'a;' || p_brand ELSE '' END AS tags, CASE WHEN p_size % 3 = 0 THEN 'True' ELSE 'False' END AS flag, p_type || chr(10) || 'x, y' AS note FROM part")
def sc_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited file with a byte-order mark, quotes and line ends, written over another one and read again."""
    path = f"{Scratch(spark, 'csv').root}/out"
    rows = table(spark, sf_dir, PARTS).select("p_partkey", F.concat("p_name", F.lit('"')).alias("word"), F.lit("left out").alias("more"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"), "p_brand")).otherwise(F.array().cast("array<string>")).alias("tags"), (F.col("p_size") % 3 == 0).alias("flag"), F.concat("p_type", F.lit("\nx, y")).alias("note"))
    sinks.write_csv(rows.limit(1), path)
    sinks.write_csv(rows, path, ("p_partkey", "word", "tags", "flag", "note"))
    got = readers.with_columns_of(readers.read_csv(spark, path), "p_partkey long, word string, tags string, flag string, note string")
    return got.withColumn("tags", F.coalesce("tags", F.lit("")))


@query("SELECT c_name AS client_id, c_mktsegment AS sentence, NULL::VARCHAR AS accents, CAST(c_nationkey AS VARCHAR) AS accent FROM customer")
def sc_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with tabs; a column that it lacks is null."""
    path = f"{Scratch(spark, 'tsv').root}/out"
    table(spark, sf_dir, "customer").select(F.col("c_name").alias("client_id"), F.col("c_mktsegment").alias("sentence"), F.col("c_nationkey").alias("accent")).write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_sentences(spark, path).select("client_id", "sentence", "accents", "accent")


@query("SELECT 's' || p_partkey AS simplified, 't' || p_size AS traditional, 'nv' || (p_size % 5 + 1) || CASE WHEN p_size % 2 = 0 THEN ' a1' ELSE '' END AS reading, p_name || '|' || p_type AS definitions FROM part WHERE p_partkey % 10 <> 0")
def sc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: a compressed text dictionary, with comments and lines of another form."""
    path = f"{Scratch(spark, 'dictionary').root}/out"
    k, n = F.col("p_partkey"), F.col("p_size")
    entry = F.concat(F.lit("t"), n.cast("string"), F.lit(" s"), k.cast("string"), F.lit(" ["), F.when(n % 3 == 0, "nu:").otherwise("Nü"), (n % 5 + 1).cast("string"), F.when(n % 2 == 0, " A1 b").otherwise(""), F.lit("] /"), "p_name", F.lit("/"), "p_type", F.lit("/"))
    line = F.when(k % 20 == 0, F.concat(F.lit("# "), entry)).when(k % 10 == 0, F.concat(F.lit("no "), "p_name")).otherwise(entry)
    table(spark, sf_dir, PARTS).select(line.alias("value")).write.option("compression", "gzip").text(path)
    return readers.read_dictionary(spark, path).select("simplified", "traditional", F.array_join("reading", " ").alias("reading"), F.array_join("definitions", "|").alias("definitions"))


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part UNION SELECT left(p_name, 2) FROM part UNION SELECT left(p_name, 1) FROM part), c AS (SELECT conv_id, turn, role, text FROM conversations)
SELECT word, 'clips/' || CASE WHEN turn % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE '' END AS audio_path, 'c' || conv_id || '/' || turn AS speaker, CASE WHEN turn % 3 = 0 THEN 'own' ELSE role END AS accent FROM c JOIN w ON contains(text, word) WHERE word <> ''
""")
def sc_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by the words that they contain, words of one character among them."""
    t = F.col("turn")
    talk = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), t.cast("string")).alias("client_id"), F.when(t % 2 == 0, F.col("conv_id").cast("string")).alias("path"), F.col("text").alias("sentence"), *[F.lit("").alias(c) for c in ("age", "gender", "locale")], F.when(t % 3 == 0, "own").otherwise("").alias("accents"), F.col("role").alias("accent"))
    parts = table(spark, sf_dir, PARTS)
    words = parts.select(F.explode(F.split("p_name", " ")).alias("word")).union(parts.select(F.substring("p_name", 1, 2))).union(parts.select(F.substring("p_name", 1, 1)))
    return ingest.context_clips(talk, words, "clips").select("word", "audio_path", "speaker", "accent")


@query("SELECT s_name AS word, s_nationkey % 2 = 0 AS quiz_eligible, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'p' || s_suppkey END AS audio_path FROM supplier")
def sc_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON array in one file, written and read again."""
    path = f"{Scratch(spark, 'array').root}/out"
    k = F.col("s_suppkey")
    sinks.write_document(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("word"), (F.col("s_nationkey") % 2 == 0).alias("quiz_eligible"), F.when(k % 3 != 0, F.concat(F.lit("p"), k.cast("string"))).alias("audio_path")), path, ["word"])
    return readers.read_json_array(spark, path, "word string, quiz_eligible boolean, audio_path string")


@query("SELECT 'k' || n_nationkey AS key, n_name AS audio_path, CASE WHEN n_regionkey = 0 THEN NULL ELSE 's' || n_regionkey END AS source FROM nation")
def sc_json_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object with keys of its own. The table of nations is a few rows: they are one file by nature."""
    path = f"{Scratch(spark, 'map').root}/out"
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("k"), F.struct(F.col("n_name").alias("audio_path"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("s"), F.col("n_regionkey").cast("string"))).alias("source")).alias("v"))
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value")).coalesce(1).write.text(path)
    return readers.read_json_map(spark, path, "audio_path string, source string")


@query("SELECT 'e' || event_id AS audio_path, event_type AS status FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def sc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that was appended to, with broken lines and rows without a path."""
    path = f"{Scratch(spark, 'log').root}/out"
    rows = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 >= 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("audio_path"), F.col("event_type").alias("status"), "event_id")
    sinks.append_log(rows.where("event_id % 2 = 0").drop("event_id"), path)
    sinks.append_log(rows.where("event_id % 2 = 1 and event_id % 3 = 0").drop("event_id"), path)
    sinks.append_log(rows.where("event_id % 7 = 0").select("status"), path)
    spark.createDataFrame([("broken {",), ('{"audio_path": 7',)], "value string").write.mode("append").text(path)
    return readers.read_log(spark, path, "audio_path string, status string")


@query("""
SELECT 'n' || n_regionkey AS folder, sha256(string_agg(n_name || chr(10), '' ORDER BY n_nationkey)) AS sha256, CAST(sum(length(n_name) + 1) AS BIGINT) AS length, false AS flat FROM nation GROUP BY n_regionkey
""")
def sc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of folders below a folder, found when looked for in depth and not when only the folder itself is."""
    root = f"{Scratch(spark, 'files').root}/out"
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("folder"), "n_nationkey", "n_name")
    rows.repartition("folder").sortWithinPartitions("folder", "n_nationkey").select("folder", F.col("n_name").alias("value")).write.partitionBy("folder").text(root)
    files = readers.read_files(spark, root, "*.txt", recursive=True)
    flat = readers.read_files(spark, root, "*.txt", recursive=False)
    flat = flat.where(~F.col("path").rlike("/folder=n[0-9]+/")).agg(F.count("*").alias("n"))  # one row: what lies in the folder itself
    folder = F.regexp_extract("path", "/folder=([^/]+)/", 1)
    return files.select(folder.alias("folder"), F.sha2("content", 256).alias("sha256"), "length").crossJoin(F.broadcast(flat)).select("folder", "sha256", "length", (F.col("n") > 0).alias("flat"))


@query("""
SELECT coalesce(source, 'none') AS source, coalesce(lang, 'none') AS word, doc_id || '.MP3' AS filename, 'audio/' || coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.MP3' AS audio_path,
  CASE WHEN doc_id % 2 = 0 THEN 'by ' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS speaker, CASE WHEN doc_id % 4 = 0 THEN 'yue' ELSE 'zh' END AS language_code, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'isolated_word' END AS recording_type
FROM documents
""")
def sc_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audio tree with sidecars for half of its files, and files that are neither."""
    d = F.col("doc_id").cast("string")
    root = F.concat(F.lit("file:/x/imports/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce("lang", F.lit("none")), F.lit("/"), d)
    docs = table(spark, sf_dir, "documents").select("doc_id", root.alias("root"), d.alias("d"))
    side = F.concat(F.lit('{"speaker": "by '), "d", F.lit('"'), F.when(F.col("doc_id") % 4 == 0, ', "language_code": "yue"').otherwise(""), F.when(F.col("doc_id") % 6 == 0, ', "recording_type": null').otherwise(""), F.lit("}"))
    name = lambda end, body, where: docs.where(where).select(F.concat("root", F.lit(end)).alias("path"), body.cast("binary").alias("content"))
    files = name(".MP3", F.lit("x"), "true").union(name(".json", side, "doc_id % 2 = 0")).union(name(".txt", F.lit("x"), "doc_id % 5 = 0"))
    return ingest.recordings_of(readers.audio_tree(files)).select("source", "word", "filename", "audio_path", "speaker", "language_code", "recording_type")


@query("SELECT p_name AS name, '64k/' || p_name || p_partkey || '.mp3' AS path, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size % 2 = 0".replace("p_name AS name", "p_name || p_partkey AS name"))
def sc_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of one prefix and suffix of a listing."""
    n = F.concat("p_name", F.col("p_partkey").cast("string"))
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("64k/"), n, F.lit(".mp3"))).when(F.col("p_size") % 3 == 0, F.concat(F.lit("64k/"), n, F.lit(".txt"))).otherwise(F.concat(F.lit("96k/"), n, F.lit(".mp3")))
    rows = table(spark, sf_dir, PARTS).groupBy((F.col("p_partkey") % 7).alias("g")).agg(F.collect_list(F.struct(path.alias("path"), F.lit("blob").alias("type"), F.col("p_size").cast("long").alias("size"))).alias("tree"))
    return readers.tree_paths(rows.select("tree", F.lit(False).alias("truncated")), "64k/", ".mp3")


@query("SELECT chr(97 + CAST(s_suppkey % 26 AS INTEGER)) || (s_suppkey // 26 % 4 + 1) AS key, max_by('ID3' || s_name, s_suppkey) AS content FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1, s_nationkey")
def sc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives (one for each nation) in a folder of one name, the later of two with one key."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pandas as pd

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, members in zip(b["path"], b["members"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    for m in members:
                        folder = "a/mp3" if m["k"] % 3 else "other"
                        z.writestr(f"{folder}/{m['key']}.mp3" if m["k"] % 3 else f"{folder}/{m['k']}.mp3", "ID3" + m["name"])
                        z.writestr(f"a/mp3/README{m['k']}", "x")
                yield pd.DataFrame({"path": [path], "content": [held.getvalue()]})

    k = F.col("s_suppkey")
    key = F.concat(F.chr((k % 26 + 97).cast("int")), (F.floor(k / 26) % 4 + 1).cast("string"))
    members = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), key.alias("key"), F.col("s_name").alias("name")))), lambda m: m)
    # Dealt by a number: rows of few bytes would else be packed, and unpacked, by one task.
    suppliers = table(spark, sf_dir, "supplier").withColumn("path", F.col("s_nationkey").cast("string")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    archives = suppliers.groupBy("path").agg(members.alias("members")).mapInPandas(packed, "path string, content binary")
    # Names with one key in an archive are met twice; the library warns of them and keeps both.
    return readers.archive_members(archives, "([a-z][1-4])\\.mp3").select("key", F.decode("content", "UTF-8").alias("content"))


@query("SELECT DISTINCT p_name AS word, v AS voice, replace(p_name, '/', '／') || '-' || v || '.mp3' AS filename FROM part, (VALUES ('x'), ('y')) AS t(v)")
def sc_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word in every voice."""
    return ingest.speech_requests(table(spark, sf_dir, PARTS).select(F.col("p_name").alias("word")), spark.createDataFrame([("x",), ("y",), ("x",)], "voice string"))


@query("SELECT s_suppkey AS hsk_id, s_name AS word, CASE WHEN s_suppkey % 4 = 0 THEN 0 WHEN s_suppkey % 4 = 1 THEN 0 ELSE CAST(s_suppkey % 4 AS INTEGER) END AS count, CASE WHEN s_suppkey % 4 = 1 THEN 'HTTP ' || s_nationkey END AS error FROM supplier")
def sc_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a service answered for each word: items, an error, or nothing."""
    k = F.col("s_suppkey")
    items = F.transform(F.sequence(F.lit(1), (k % 4).cast("int")), lambda i: F.struct(i.cast("string").alias("id")))
    answers = table(spark, sf_dir, "supplier").where(k % 4 != 0).select(F.col("s_name").alias("word"), items.alias("items"), F.when(k % 4 == 1, F.concat(F.lit("HTTP "), F.col("s_nationkey").cast("string"))).alias("error"))
    rows = ingest.inventory(table(spark, sf_dir, "supplier").select(k.alias("id"), F.col("s_name").alias("word")), answers)
    return rows.select("hsk_id", "word", "count", "error")


@query("SELECT 'p' || s_suppkey AS audio_path, s_name AS speaker, CASE WHEN s_nationkey % 2 = 0 THEN 'CC' END AS license FROM supplier")
def sc_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: the metadata of each recording, written as a table and read again."""
    path = f"{Scratch(spark, 'meta').root}/out"
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("audio_path"), F.col("s_name").alias("speaker"), F.when(F.col("s_nationkey") % 2 == 0, "CC").alias("license"), F.lit("w").alias("word"))
    sinks.write_sidecars(rows, path)
    side = F.from_json("sidecar", "speaker string, license string")
    return spark.read.parquet(path).select("audio_path", side["speaker"].alias("speaker"), side["license"].alias("license"))


@query("SELECT DISTINCT CASE s_suppkey % 5 WHEN 0 THEN '/etc/' || s_suppkey WHEN 1 THEN 'a/../../' || s_suppkey WHEN 2 THEN '..' END AS audio_path FROM supplier WHERE s_suppkey % 5 < 3")
def sc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that leave the root."""
    k = F.col("s_suppkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("/etc/"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("a/../../"), k.cast("string"))).when(k % 5 == 2, "..").when(k % 5 == 3, F.concat(F.lit("a/./../"), k.cast("string"))).otherwise("a//b")
    return bundle.unsafe_paths(table(spark, sf_dir, "supplier").select(path.alias("audio_path"))).distinct()


@query("""
WITH f AS (SELECT 'd/' || doc_id AS audio_path, strlen(text) AS length, 'www/d/' || doc_id AS target FROM documents WHERE doc_id % 2 = 0) SELECT audio_path, length, target FROM f WHERE CAST(substr(audio_path, 3) AS BIGINT) % 3 = 0
""")
def sc_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: which files are copied where."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("d/"), F.col("doc_id").cast("string"))
    wanted = docs.where("doc_id % 3 = 0").select(name.alias("audio_path"))
    files = docs.where("doc_id % 2 = 0").select(name.alias("path"), F.octet_length("text").cast("long").alias("length"))
    return sinks.copy_plan(wanted.union(wanted), files, "www/")


@query("""
WITH s AS (SELECT 'audio_cmn: selected exist' AS c, 'audio_cmn' AS m UNION ALL SELECT 'pinyin_public: selected exist', 'pinyin_public'), k AS (SELECT DISTINCT lower(n_name) || t AS key, n_nationkey AS n, t FROM nation, range(1, 5) r(t))
SELECT c AS "check", count(*) FILTER (WHERE CASE WHEN m = 'audio_cmn' THEN n % 3 <> 0 ELSE false END) = 0 AS ok FROM s, k GROUP BY c UNION ALL
SELECT 'audio_cmn: unavailable', count(*) FILTER (WHERE n % 3 = 0 AND n % 2 = 1) = 0 FROM k UNION ALL SELECT 'pinyin_public: unavailable', count(*) FILTER (WHERE n % 2 = 1 AND n % 3 = 0) = 0 FROM k
""")
def sc_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is chosen in both modes exists, and exactly the keys said to be unavailable are. Human files of bad keys are not there; every even nation is public."""
    nation = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("s"), F.col("n_nationkey").alias("n"))
    keys = selection.required_keys(nation.select(F.array("s").alias("pinyin_syllables")))
    each = nation.select("n", F.explode(F.transform(F.array(*map(F.lit, (1, 2, 3, 4))), lambda t: F.concat("s", t.cast("string")))).alias("key"))
    quality = each.where("n % 3 = 0").select(F.lit("audio_cmn").alias("source"), "key", F.lit("bad").alias("status"), F.lit("pinyin_public").alias("replacement"), F.lit(None).cast("string").alias("replacement_audio_path"), F.lit(None).cast("string").alias("replacement_source"))
    public = each.where("n % 2 = 0").select("key", F.concat(F.lit("public/"), "key").alias("audio_path"), F.lit("p").alias("source"))
    # Odd nations have human files, but for what is asked of even ones; the check of the first mode fails where a human file lacks.
    files = public.select("audio_path", F.lit(1).cast("long").alias("length")).union(each.where("n % 2 = 1").select(F.concat(F.lit("audio/audio_cmn/syllabs/cmn-"), "key", F.lit(".mp3")), F.lit(1).cast("long")))
    return bundle.selected_checks(keys, files, quality, public, ()).select("check", "ok")


# Streams


@query("SELECT event_type AS status, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY event_type")
def sc_stream_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in two runs, without those that another run has completed."""
    scratch, schema = Scratch(spark, "completed"), table(spark, sf_dir, "events").schema
    done = table(spark, sf_dir, "events").where("event_id % 5 = 0").select("event_id")
    for _ in range(2):
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        jobs.resumable(rows, lambda r: r.select("event_id", "event_type"), f"{scratch.root}/log", f"{scratch.root}/checkpoint", done, "event_id").awaitTermination()
    return audits.status_counts(spark.read.option("recursiveFileLookup", True).schema("event_id long, event_type string").json(f"{scratch.root}/log"), "event_type")


@query("SELECT DISTINCT user_id, event_type, CAST(event_id % 3 AS VARCHAR) AS filename FROM events")
def sc_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: recordings that are ingested twice are there once."""
    scratch, schema = Scratch(spark, "ingest"), table(spark, sf_dir, "events").schema
    for _ in range(2):
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        named = rows.select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("word"), (F.col("event_id") % 3).cast("string").alias("filename"))
        jobs.new_recordings(named, f"{scratch.root}/out", f"{scratch.root}/checkpoint").awaitTermination()
    got = spark.read.schema("source string, word string, filename string").json(f"{scratch.root}/out")
    return got.select(F.col("source").cast("long").alias("user_id"), F.col("word").alias("event_type"), "filename")


@query("SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'purchase') AS correct FROM events GROUP BY user_id")
def sc_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals of each user."""
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    scratch = Scratch(spark, "totals")
    name = "totals_" + scratch.root.rpartition("-")[2]
    jobs.running_progress(rows.select("user_id", (F.col("event_type") == "purchase").alias("correct")), name, ["user_id"]).awaitTermination()
    return spark.table(name)


@query("SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) AS last FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) <= 5) GROUP BY user_id")
def sc_stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five answers of each user as state of a stream."""
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    scratch = Scratch(spark, "history")
    name = "history_" + scratch.root.rpartition("-")[2]
    jobs.last_answers(rows.select("user_id", F.col("ts").alias("at"), F.col("event_id").cast("string").alias("row")), "user_id", 5, name).awaitTermination()
    return spark.table(name).select("user_id", F.array_join("rows", ",").alias("last"))
