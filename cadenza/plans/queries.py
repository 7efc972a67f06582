"""Registered queries: fixtures that show exact semantics, and the same functions at the size of the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio, pinyin
from ..operators import audits, bundle, history, ingest, selection
from ..sources.shared import Scratch
from ..streaming import jobs
from . import policy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool | int):
        return str(x)
    return "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


# Fixtures


_CHOICE = """
SELECT m.mode, k.key,
  CASE WHEN choice = 'public' THEN p.audio_path WHEN choice = 'replacement' THEN h.replacement_audio_path
       WHEN choice = 'human' THEN 'audio/audio_cmn/syllabs/cmn-' || CASE k.key WHEN 'ju4' THEN 'jv4' ELSE k.key END || '.mp3' END AS audio_path,
  CASE choice WHEN 'public' THEN true WHEN 'none' THEN NULL ELSE false END AS enhanced
FROM (
  SELECT m.mode, k.key, h.key AS hk, p.key AS pk,
    CASE WHEN m.mode = 'audio_cmn' AND h.status = 'bad' AND h.replacement_audio_path IS NOT NULL THEN 'replacement'
         WHEN m.mode = 'audio_cmn' AND h.status = 'bad' AND h.replacement = 'pinyin_public' AND p.key IS NOT NULL AND r.status IS DISTINCT FROM 'bad' THEN 'public'
         WHEN m.mode = 'audio_cmn' AND h.status = 'bad' THEN 'none'
         WHEN m.mode = 'audio_cmn' AND k.key NOT IN ('r1', 'r2', 'r3', 'r4') THEN 'human'
         WHEN p.key IS NOT NULL AND r.status IS DISTINCT FROM 'bad' THEN 'public'
         WHEN m.mode = 'audio_cmn' THEN 'none'
         WHEN h.status = 'bad' AND h.replacement_audio_path IS NOT NULL THEN 'replacement'
         WHEN h.status = 'bad' OR k.key IN ('r1', 'r2', 'r3', 'r4') THEN 'none' ELSE 'human' END AS choice
  FROM keys k CROSS JOIN (VALUES ('audio_cmn'), ('pinyin_public')) AS m(mode)
  LEFT JOIN quality h ON h.source = 'audio_cmn' AND h.key = k.key
  LEFT JOIN quality r ON r.source = 'pinyin_public' AND r.key = k.key
  LEFT JOIN public p ON p.key = k.key
) c JOIN (VALUES ('audio_cmn'), ('pinyin_public')) AS m(mode) ON m.mode = c.mode JOIN keys k ON k.key = c.key
LEFT JOIN quality h ON h.source = 'audio_cmn' AND h.key = k.key LEFT JOIN public p ON p.key = k.key
"""


def _modes(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.explode(F.array(F.lit("audio_cmn"), F.lit("pinyin_public"))).alias("mode"))


@query(
    f"WITH keys AS (SELECT * FROM {values([(k,) for k in policy.keys()], 'key')}), quality AS (SELECT * FROM {values(policy.quality_rows(), 'source, key, status, replacement, replacement_audio_path, replacement_source')}), "
    f"public AS (SELECT * FROM {values(policy.public_rows(), 'key, audio_path, source')}) {_CHOICE}"
)
def fx_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen recording of each key under the reviews, in both modes."""
    keys = _modes(spark.createDataFrame([(k,) for k in policy.keys()], "key string"))
    quality = spark.createDataFrame(policy.quality_rows(), policy.QUALITY)
    public = spark.createDataFrame(policy.public_rows(), "key string, audio_path string, source string")
    return selection.select_recording(keys, quality, public, F.col("mode")).select("mode", "key", "audio_path", "enhanced")


# At the size of the tables


@query("""
WITH d AS (SELECT sha256(coalesce(text, '')) AS payload, d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT payload, count(*) AS n_keys, min(doc_id) AS first_key, count(*) FILTER (WHERE quality IS DISTINCT FROM 0) AS healthy,
       CASE WHEN count(*) FILTER (WHERE quality IS DISTINCT FROM 0) <= 1 THEN 'quarantined' ELSE 'unquarantined' END AS status
FROM d GROUP BY payload HAVING count(*) > 1
""")
def sc_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal payloads of any size; labels are the reviews."""
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("payload"), F.col("doc_id").alias("key"))
    reviews = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 0, "bad").otherwise("good").alias("status"))
    return audits.duplicate_counts(docs, reviews)


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def sc_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return ingest.contained_passages(docs, "text", items, "passage").select("doc_id", "item_id")


@query("""
WITH e AS (SELECT user_id, event_type, CAST(date_trunc('day', ts) AS DATE) AS day, event_id FROM events),
known AS (SELECT * FROM e WHERE event_type = 'purchase'),
first AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY event_id) = 1)
SELECT * FROM known UNION ALL
SELECT f.* FROM first f WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.user_id = f.user_id AND k.event_type = f.event_type AND k.day = f.day)
""")
def sc_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are not known yet get their first row; purchases are known."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id")
    return ingest.insert_absent(rows, rows.where("event_type = 'purchase'"), ["user_id", "event_type", "day"], [F.col("event_id")])


@query("SELECT DISTINCT replace(lower(p_brand), 'ü', 'v') || t AS key FROM part, range(1, 5) r(t)")
def sc_required_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand with every tone."""
    return selection.required_keys(table(spark, sf_dir, "part").select(F.array("p_brand").alias("pinyin_syllables")))


@query(f"""
WITH parts AS (SELECT DISTINCT lower(p_brand) || '/' || p_size AS key, p_size FROM part),
keys AS (SELECT key FROM parts),
quality AS (
  SELECT 'audio_cmn' AS source, key, CASE WHEN p_size % 3 = 0 THEN 'bad' ELSE 'good' END AS status, CASE WHEN p_size % 2 = 0 THEN 'pinyin_public' END AS replacement,
         CASE WHEN p_size % 9 = 0 THEN 'r/' || key END AS replacement_audio_path FROM parts
  UNION ALL SELECT 'pinyin_public', key, CASE WHEN p_size % 5 = 0 THEN 'bad' ELSE 'good' END, NULL, NULL FROM parts),
public AS (SELECT key, CASE WHEN p_size % 7 <> 0 THEN 'p/' || key END AS audio_path FROM parts WHERE p_size % 7 <> 0)
{_CHOICE}
""")
def sc_prefer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of preferences over brands and sizes, with reviews that follow from the size."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lower("p_brand"), F.lit("/"), F.col("p_size").cast("string")).alias("key"), "p_size").distinct()
    state = lambda n: F.when(F.col("p_size") % n == 0, "bad").otherwise("good").alias("status")
    none = F.lit(None).cast("string")
    human = parts.select(F.lit("audio_cmn").alias("source"), "key", state(3), F.when(F.col("p_size") % 2 == 0, "pinyin_public").alias("replacement"), F.when(F.col("p_size") % 9 == 0, F.concat(F.lit("r/"), "key")).alias("replacement_audio_path"), none.alias("replacement_source"))
    review = parts.select(F.lit("pinyin_public").alias("source"), "key", state(5), none.alias("replacement"), none.alias("replacement_audio_path"), none.alias("replacement_source"))
    public = parts.where(F.col("p_size") % 7 != 0).select("key", F.concat(F.lit("p/"), "key").alias("audio_path"), F.lit("public").alias("source"))
    return selection.select_recording(_modes(parts), human.union(review), public, F.col("mode")).select("mode", "key", "audio_path", "enhanced")


@query("SELECT p_name AS word, count(DISTINCT (p_type, p_size)) > 1 AS ambiguous FROM part GROUP BY p_name")
def sc_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with several readings (type and size)."""
    words = table(spark, sf_dir, "part").select(F.col("p_name").alias("word"), F.col("p_type").alias("pinyin"), F.array(F.col("p_size").cast("string")).alias("pinyin_syllables"), F.lit("").alias("lexical_pattern"))
    return selection.ambiguous_words(words)


@query("SELECT s_nationkey, s_name, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_name) = 1")
def sc_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supplier of each nation by (balance, name); the best definition of a word is in sc_definition."""
    return ingest.first_of_each(table(spark, sf_dir, "supplier").select("s_nationkey", "s_name", "s_acctbal"), ["s_nationkey"], ["s_acctbal", "s_name"])


@query("""
SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY o_orderkey) AS text
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderpriority NOT LIKE '5%' AND o_orderkey % 7 <> 0) WHERE n <= 4 GROUP BY o_custkey
""")
def sc_topk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's first four priorities that are not blank and name no classifier, as one text."""
    p = F.when(F.col("o_orderkey") % 7 == 0, "  ").when(F.col("o_orderpriority").startswith("5"), F.concat(F.lit("CL:"), "o_orderpriority")).otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", p.alias("p")))).alias("o"))
    return rows.select("o_custkey", F.array_join(pinyin.clean_definitions(F.col("o.p")), "; ").alias("text")).where("text <> ''")


@query("""
WITH a AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, run) AS run_length,
       count(*) OVER (PARTITION BY user_id, run) >= 2 AND lead(run) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM run AS raised
FROM b
""")
def sc_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one type of event; all but the last of a run are raised."""
    rows = history.with_runs(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.select("event_id", "user_id", "event_type", "run_length", ((F.col("run_length") >= 2) & ~F.col("run_last")).alias("raised"))


@query("""
SELECT event_id, CASE WHEN event_type = 'click' AND following = 'purchase' THEN 'lead' WHEN event_type = 'view' AND previous = following THEN 'between' ELSE event_type END AS rewritten
FROM (SELECT *, lag(event_type) OVER w AS previous, lead(event_type) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
""")
def sc_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value rewritten by its neighbours."""
    rows = history.with_neighbours(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type")
    new = F.when((F.col("event_type") == "click") & (F.col("following") == "purchase"), "lead").when((F.col("event_type") == "view") & (F.col("previous") == F.col("following")), "between")
    return rows.select("event_id", new.otherwise(F.col("event_type")).alias("rewritten"))


@query("""
SELECT user_id, count(*) AS attempts, count(*) FILTER (WHERE event_type = 'purchase') AS correct,
       CAST(floor(count(*) FILTER (WHERE event_type = 'purchase') * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS percent FROM events GROUP BY user_id
""")
def sc_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts, right ones and the rounded percentage of each user."""
    return selection.progress(table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "purchase").alias("correct")), ["user_id"])


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders) WHERE place % 4 = 1")
def sc_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shard of four of all orders, by place in order."""
    return audits.take_shard(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 1, 4, ["o_orderkey"])


@query("""
SELECT CASE WHEN coalesce(d.text, '') <> '' AND regexp_replace(lower(d.text), '[^a-z0-9]+', '', 'g') = '' THEN 'text_match' WHEN l.doc_id IS NULL THEN 'unrecognized'
            WHEN l.quality = 1 AND l.toxic = 0 THEN 'exact' WHEN l.quality = 1 THEN 'base_match' ELSE 'review' END AS status, count(*) AS n
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1
""")
def sc_status_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a cascade of statuses; labels stand for what was recognised."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), (F.length(F.regexp_replace(F.lower(F.coalesce("text", F.lit("x"))), "[^a-z0-9]+", "")) == 0).alias("blank"), (F.coalesce("text", F.lit("")) != "").alias("some"))
    rows = docs.join(table(spark, sf_dir, "labels"), F.col("d") == F.col("doc_id"), "left")
    heard = F.when(F.col("doc_id").isNotNull(), F.array(F.concat(F.when(F.col("quality") == 1, "a").otherwise("b"), F.when(F.col("toxic") == 0, "1").otherwise("2"))))
    status = audits.native_status(heard, F.array(F.array(F.lit("a1"))), F.when(F.col("blank") & F.col("some"), "x"), F.lit("X"))
    return audits.status_counts(rows.select(status.alias("status")))


_LAG = "abs(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0))"


@query(f"""
WITH e AS (SELECT label, vec_id // 4 AS base, vec_id % 4 + 1 AS tone, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.label, a.base, a.tone AS l, b.tone AS r, a.v AS x, b.v AS y, len(a.v) AS n FROM e a JOIN e b ON a.label = b.label AND a.base = b.base AND a.tone < b.tone)
SELECT label AS source, base || '/' || l AS left_key, base || '/' || r AS right_key, round(similarity, 6) AS similarity
FROM (SELECT *, greatest({', '.join('coalesce(' + _LAG.format(a=f'x[{max(0, -k) + 1}:n - {max(0, k)}]', b=f'y[{max(0, k) + 1}:n - {max(0, -k)}]') + ', 0)' for k in range(-2, 3))}) AS similarity FROM p) WHERE similarity >= 0.2
""")
def sc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within families of four vectors that are similar at some small lag."""
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    waves = rows.select(F.col("label").alias("source"), F.concat(F.floor(F.col("vec_id") / 4).cast("string"), F.lit("/")).alias("base"), (F.col("vec_id") % 4 + 1).alias("tone"), F.col("embedding").cast("array<double>").alias("wave"))
    quality = spark.createDataFrame([], "source int, key string, status string")
    return audits.similar_tones(waves, quality, 0.2, 2).select("source", "left_key", "right_key", F.round("similarity", 6).alias("similarity"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (SELECT vec_id, v, coalesce(list_avg(v), 0) AS o FROM e),
c AS (SELECT vec_id, o, list_transform(v, lambda x: abs(x - o)) AS s FROM m), a AS (SELECT *, list_filter(s, lambda x: x >= 0.01) AS t FROM c)
SELECT vec_id, round(o, 6) AS off_set, round(CASE WHEN len(t) > 0 THEN least(0.16 / sqrt(list_dot_product(t, t) / len(t)), 0.9 / list_max(s), 12) ELSE 1 END, 6) AS gain FROM a
""")
def sc_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: offset and gain of each vector as one channel."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array("embedding").alias("channels"))
    return rows.select("vec_id", F.round(audio.offsets(F.col("channels"))[0], 6).alias("off_set"), F.round(audio.gain(F.col("channels")), 6).alias("gain"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: 12 * CAST(x AS DOUBLE)) AS v, len(embedding) AS n FROM embeddings WHERE len(embedding) >= 2),
p AS (SELECT vec_id, list_transform(range(9), lambda i: v[CAST(floor(i * (n - 1) / 8.0) AS INTEGER) + 1]
        + (i * (n - 1) / 8.0 - floor(i * (n - 1) / 8.0)) * (v[least(n, CAST(floor(i * (n - 1) / 8.0) AS INTEGER) + 2)] - v[CAST(floor(i * (n - 1) / 8.0) AS INTEGER) + 1])) AS q FROM e),
m AS (SELECT vec_id, (q[7] + q[8]) / 2 - (q[2] + q[3]) / 2 AS delta, (q[7] + q[8]) / 2 - list_min(q[2:5]) AS rise, list_max(q[2:8]) - list_min(q[2:8]) AS span FROM p)
SELECT vec_id, round(delta, 6) AS delta, round(rise, 6) AS rise, round(span, 6) AS span,
  CASE vec_id % 4 + 1 WHEN 1 THEN CASE WHEN abs(delta) > 3.5 AND span > 4 THEN 'strongly non-level tone 1' END
       WHEN 2 THEN CASE WHEN rise < 1.25 AND span < 2 THEN 'flat tone-1-like tone 2' WHEN -delta > 3 AND span > 4 THEN 'falling tone 2' END
       WHEN 4 THEN CASE WHEN -delta < 1.25 AND span < 2 THEN 'flat tone-1-like tone 4' WHEN delta > 3 AND span > 4 THEN 'rising tone 4' END END AS reason FROM m
""")
def sc_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20's tail, F21, F22: nine points of each vector, their metrics and what they contradict."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", audio.interpolated(F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 12)).alias("points")).where("points is not null")
    rows = rows.withColumn("m", audio.contour_metrics(F.col("points")))
    reason = F.coalesce(*[F.when(x, k) for k, x in audio.contradicts((F.col("vec_id") % 4 + 1).cast("string"), F.col("m")).items()])
    return rows.select("vec_id", F.round("m.delta", 6).alias("delta"), F.round("m.rise", 6).alias("rise"), F.round("m.range", 6).alias("span"), reason.alias("reason"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE len(embedding) >= 8),
l AS (SELECT vec_id, list_transform(range(len(v) // 8), lambda i: sqrt(list_dot_product(v[i * 8 + 1:i * 8 + 8], v[i * 8 + 1:i * 8 + 8]) / 8)) AS r FROM e),
t AS (SELECT vec_id, r, greatest(pow(10, -45 / 20.0), list_max(r) * pow(10, -28 / 20.0), 4 * list_sort(r)[greatest(1, len(r) // 5)]) AS least FROM l),
a AS (SELECT vec_id, len(r) AS n, list_filter(range(len(r)), lambda i: r[i + 1] >= least) AS on_ FROM t)
SELECT vec_id, CAST(on_[1] AS BIGINT) AS lead, CAST(n - 1 - on_[len(on_)] AS BIGINT) AS tail FROM a
""")
def sc_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet frames of eight values at both ends of each vector."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") >= 8).select("vec_id", audio.frame_levels(F.col("embedding"), 8, 1.0).alias("levels"))
    edges = audio.edge_frames(F.col("levels"))
    return rows.select("vec_id", edges["lead"].cast("long").alias("lead"), edges["tail"].cast("long").alias("tail"))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def sc_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 events of each user."""
    return history.latest(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "user_id")


@query("SELECT user_id, ts, event_id FROM (SELECT user_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) ORDER BY ts DESC, event_id DESC LIMIT 64")
def sc_resident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64 users whose last event is latest."""
    return history.resident(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"])


@query("""
WITH ids AS (SELECT DISTINCT id FROM (SELECT 'd/' || doc_id AS id FROM documents UNION ALL SELECT 'd/' || doc_id FROM labels UNION ALL SELECT 'p/' || page_id FROM pages)),
files AS (SELECT 'd/' || doc_id AS id, strlen(text) AS length FROM documents UNION ALL SELECT 'p/' || page_id, strlen(html) FROM pages)
SELECT count(*) AS files, CAST(coalesce(sum(length), 0) AS BIGINT) AS bytes, (SELECT count(*) FROM ids WHERE id NOT IN (SELECT id FROM files WHERE length > 0)) AS missing
FROM ids JOIN (SELECT DISTINCT * FROM files) f USING (id)
""")
def sc_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct paths of three sources, their bytes, and how many are missing."""
    docs, labels, pages = (table(spark, sf_dir, t) for t in ("documents", "labels", "pages"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("audio_path")
    paths = docs.select(name("d/", "doc_id")).union(labels.select(name("d/", "doc_id"))).union(pages.select(name("p/", "page_id"))).distinct()
    files = docs.select(name("d/", "doc_id"), F.octet_length("text").cast("long").alias("length")).union(pages.select(name("p/", "page_id"), F.octet_length("html").cast("long").alias("length")))
    return bundle.totals(paths, files).crossJoin(bundle.missing(paths, files).agg(F.count("*").alias("missing")))  # a row each


@query("""
SELECT event_id, CASE WHEN list_contains(json_keys(props), 'k') THEN json_extract_string(props, '$.k') ELSE 'none' END AS k,
       CASE WHEN list_contains(json_keys(props), 'lang') THEN json_extract_string(props, '$.lang') ELSE 'zh' END AS lang FROM events
""")
def sc_json_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and null fields: a default for the first alone."""
    return table(spark, sf_dir, "events").select("event_id", ingest.field(F.col("props"), "k", "none").alias("k"), ingest.field(F.col("props"), "lang", "zh").alias("lang"))


@query("""
SELECT 'orders have customers' AS "check", count(*) = 0 AS ok FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
SELECT 'lines have orders', count(*) = 0 FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL
SELECT 'lines have parts', count(*) = 0 FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL
SELECT 'nations and suppliers agree', NOT EXISTS ((SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier) UNION ALL (SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation)) UNION ALL
SELECT 'documents have texts', count(*) = 0 FROM documents WHERE coalesce(text, '') = '' UNION ALL
SELECT 'pages have urls', count(*) = 0 FROM pages WHERE coalesce(url, '') = '' UNION ALL
SELECT 'vectors have 64 components', count(*) = 0 FROM embeddings WHERE len(embedding) IS DISTINCT FROM 64 UNION ALL
SELECT 'turns alternate', count(*) = 0 FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE role = before
""")
def sc_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks over all tables as rows."""
    t = {n: table(spark, sf_dir, n) for n in "orders customer lineitem part nation supplier documents pages embeddings conversations".split()}
    lacks = lambda a, b, x, y: t[a].select(F.col(x).alias("k")).join(t[b].select(F.col(y).alias("k")), "k", "left_anti")
    agree = bundle.differing(t["nation"].select(F.col("n_nationkey").alias("k")), t["supplier"].select(F.col("s_nationkey").alias("k")))
    turns = history.with_neighbours(t["conversations"].select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role").where("role = previous")
    return bundle.checks(
        bundle.check("orders have customers", lacks("orders", "customer", "o_custkey", "c_custkey")),
        bundle.check("lines have orders", lacks("lineitem", "orders", "l_orderkey", "o_orderkey")),
        bundle.check("lines have parts", lacks("lineitem", "part", "l_partkey", "p_partkey")),
        bundle.check("nations and suppliers agree", agree),
        bundle.check("documents have texts", t["documents"].where("coalesce(text, '') = ''").select("doc_id")),
        bundle.check("pages have urls", t["pages"].where("coalesce(url, '') = ''").select("page_id")),
        bundle.check("vectors have 64 components", t["embeddings"].where("not size(embedding) <=> 64").select("vec_id")),
        bundle.check("turns alternate", turns),
    ).select("check", "ok")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def sc_stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a stream in two runs, of which the second finds nothing new."""
    scratch = Scratch(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    for _ in range(2):
        rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        jobs.resumable(rows, lambda r: r.select("event_id", "event_type"), f"{scratch.root}/log", f"{scratch.root}/checkpoint", key="event_id").awaitTermination()
    return audits.status_counts(spark.read.option("recursiveFileLookup", True).schema("event_id long, event_type string").json(f"{scratch.root}/log"), "event_type")
