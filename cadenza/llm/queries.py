"""The ten queries, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op01_template, op02_mpeg, op03_sharding, op04_quality, op05_dac, op06_embeddings, op07_simhash, op08_bpe, op09_mixing, op10_pst
from .common import Scratch

#: Files of public tokenizers; the library is asked for their place when a query runs.
JSON_FILE, RANKS_FILE, END_ID = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_template.extract(_table(spark, sf_dir, "pages"), Scratch(spark, "op1"))


def op2_mpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_mpeg.read(op02_mpeg.store(_table(spark, sf_dir, "documents"), Scratch(spark, "op2")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_sharding.shard(_table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    written = op05_dac.write(_table(spark, sf_dir, "documents"), Scratch(spark, "op5"), public_tokenizers.path(JSON_FILE), public_tokenizers.PATTERN, END_ID)
    return op05_dac.read(written)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), Scratch(spark, "op6"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_simhash.near_duplicates(_table(spark, sf_dir, "documents"), Scratch(spark, "op7"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op08_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS_FILE), public_tokenizers.PATTERN)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    mixed = op09_mixing.mix(docs, Scratch(spark, "op9"), keep=["doc_id", "lang", "source"])
    return mixed.select("doc_id", mixed["__domain"].alias("domain"), "lang", "source", mixed["__epoch"].alias("epoch"), mixed["__tokens"].alias("reckoned_tokens"))


def op10_pst_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_pst.lm_scores(_table(spark, sf_dir, "documents"), Scratch(spark, "op10"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html, op2_mpeg, op3_sharding, op4_quality, op5_dac, op6_embeddings, op7_simhash, op8_bpe, op9_mixing, op10_pst_lm)
}

OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT v.vec_id, (SELECT count(*) FROM pairs p WHERE p.x = v.vec_id) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM v JOIN least l ON l.x = v.vec_id
"""


def _filled(name: str, rows: str, parent: str, child: str) -> str:
    """SQL that gives each parent's amount to its children by weight, at most room to each."""
    over = f"PARTITION BY {parent} ORDER BY room / weight, {child} ROWS BETWEEN"
    return f"""{name}_a AS (
  SELECT *, amount - coalesce(sum(room) OVER ({over} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS unspent,
         sum(weight) OVER ({over} CURRENT ROW AND UNBOUNDED FOLLOWING) AS wanting FROM {rows}
), {name}_b AS (SELECT *, room <= unspent / wanting * weight AS filled FROM {name}_a
), {name}_c AS (
  SELECT *, max(CASE WHEN NOT filled THEN unspent / wanting END) OVER (PARTITION BY {parent}) AS level FROM {name}_b
), {name} AS (SELECT * EXCLUDE (unspent, wanting, filled, level), CASE WHEN filled THEN room::DOUBLE ELSE level * weight END AS given FROM {name}_c)"""


def _case(column: str, table: dict[str, int]) -> str:
    return f"(CASE {column} {' '.join(f"WHEN '{k}' THEN {w}" for k, w in table.items())} ELSE 1 END)::DOUBLE"


OP9_SQL = f"""
WITH docs AS (
  SELECT doc_id, lang, source, 'd' || (coalesce(TRY_CAST(right(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 9) AS INTEGER), 0) % {op09_mixing.DOMAINS})::VARCHAR AS domain,
         coalesce(lang, '') AS l, coalesce(source, '') AS s, coalesce(strlen(text), 0) // 4 + 1 AS n_tokens FROM documents
), leaves AS (SELECT domain, l, s, sum(n_tokens)::BIGINT AS supply, 2 * sum(n_tokens)::BIGINT AS room FROM docs GROUP BY ALL
), top AS (SELECT floor(sum(supply)::DOUBLE * 0.8) AS amount FROM leaves
), d_in AS (SELECT domain, sum(room)::BIGINT AS room, {_case("domain", op09_mixing.DOMAIN_WEIGHTS)} AS weight, any_value(top.amount) AS amount, 0 AS root FROM leaves, top GROUP BY domain
), {_filled("d", "d_in", "root", "domain")}
, l_in AS (SELECT a.domain, l, sum(a.room)::BIGINT AS room, {_case("l", op09_mixing.LANG_WEIGHTS)} AS weight, any_value(d.given) AS amount FROM leaves a JOIN d USING (domain) GROUP BY a.domain, l
), {_filled("g", "l_in", "domain", "l")}
, s_in AS (SELECT a.domain, a.l, a.s, a.supply, a.room, 1.0::DOUBLE AS weight, g.given AS amount FROM leaves a JOIN g ON a.domain = g.domain AND a.l = g.l
), {_filled("t", "s_in", "domain, l", "s")}
, plan AS (SELECT domain, l, s, supply, floor(given + 1e-6)::BIGINT // supply AS passes, floor(given + 1e-6)::BIGINT % supply AS rest FROM t
), keyed AS (
  SELECT docs.*, passes, rest, md5('1|' || passes || '|' || coalesce(doc_id::VARCHAR, '')) AS key FROM docs JOIN plan USING (domain, l, s)
), summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, l, s ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed
), copies AS (SELECT *, passes + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS times FROM summed)
SELECT doc_id, domain, lang, source, unnest(range(times))::INTEGER AS epoch, n_tokens AS reckoned_tokens FROM copies WHERE times > 0
"""

ORACLE_SQL: dict[str, str] = {"op6_embeddings": OP6_SQL, "op9_mixing": OP9_SQL}
