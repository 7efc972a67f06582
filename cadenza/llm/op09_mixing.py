"""Mixing sources to target weights (operator 9), in DataFrame operations only.

The tree is root, domain, language, source. A token budget is handed down from the root: a node's children get
it by their weights, but no child more than its leaves hold in ``epochs`` passes; what a child can't take goes to its
siblings by their weights, and a node gives budget back to its own siblings only when all of its children are
full. A leaf's budget is so many whole passes and the beginning of one more, in an order that the seed, the pass
and the doc_id decide. Documents with that order's key under the leaf's cut are in the last pass.

To find the cut, a leaf's tokens are summed by the first three digits of the key (4096 buckets); only the rows of
the bucket in which the budget ends are then summed one by one. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, utf8_size

#: Weights of the query's tree. Other domains and languages weigh 1, every source weighs 1 in its language.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}
DOMAINS = 4
LEAF = ["domain", "lang", "source"]
#: A plan of so many leaves (about 100 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_LEAVES = 10_000


def tokens(text: str = "text") -> Column:
    """Tokens of a text, reckoned as a quarter of its UTF-8 bytes, plus one."""
    return F.floor(utf8_size(text) / 4).cast("long") + 1


def domain(source: Column) -> Column:
    """The domain of a source: the number at its end modulo ``DOMAINS``; d0 without one."""
    digits = F.right(F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]+)$", 1), F.lit(9))
    return F.concat(F.lit("d"), F.coalesce(digits.try_cast("int") % DOMAINS, F.lit(0)).cast("string"))


def _weights(name: str, table: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, w in table.items():
        out = F.when(F.col(name) == k, w).otherwise(out)
    return out.cast("double")


def fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Give each parent's ``amount`` to its children by ``weight``, at most ``room`` to each; appends ``given``.

    Children are taken by rising room per weight: a child is full if its room is at most its share of what those before
    left; the others share the rest. The rows are nodes of the tree, not documents.
    """
    order = [F.col("room") / F.col("weight"), F.col(child)]
    before = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*parent).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    rows = children.withColumn("left", F.col("amount") - F.coalesce(F.sum("room").over(before), F.lit(0))).withColumn("wanting", F.sum("weight").over(after))
    rows = rows.withColumn("full", F.col("room") <= F.col("left") / F.col("wanting") * F.col("weight"))
    everyone = Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(~F.col("full"), F.col("left") / F.col("wanting")), ignorenulls=True).over(everyone)
    return rows.withColumn("given", F.when(F.col("full"), F.col("room").cast("double")).otherwise(level * F.col("weight"))).drop("left", "wanting", "full")


def budgets(leaves: DataFrame, share: float, epochs: int, domain_weights: dict[str, int], lang_weights: dict[str, int]) -> DataFrame:
    """leaves: domain, lang, source, supply. Appends budget, passes (whole ones) and rest (tokens of one more)."""
    leaves = leaves.withColumn("room", F.col("supply") * epochs)
    top = leaves.agg(F.floor(F.sum("supply") * F.lit(share)).cast("double").alias("amount"))
    domains = leaves.groupBy("domain").agg(F.sum("room").alias("room")).crossJoin(F.broadcast(top))  # top is one row
    domains = fill(domains.withColumns({"weight": _weights("domain", domain_weights), "root": F.lit(0)}), ["root"], "domain")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("room").alias("room")).join(domains.select("domain", F.col("given").alias("amount")), "domain")
    langs = fill(langs.withColumn("weight", _weights("lang", lang_weights)), ["domain"], "lang")
    own = leaves.join(langs.select("domain", "lang", F.col("given").alias("amount")), ["domain", "lang"])
    own = fill(own.withColumn("weight", F.lit(1.0)), ["domain", "lang"], "source")
    own = own.withColumn("budget", F.floor(F.col("given") + 1e-6).cast("long"))
    whole = F.expr("budget div greatest(supply, 1)")
    return own.select(*LEAF, "supply", "budget", whole.alias("passes"), (F.col("budget") - whole * F.col("supply")).alias("rest"))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def plan(rows: DataFrame, scratch: Scratch, share: float, epochs: int, seed: int, domain_weights: dict[str, int], lang_weights: dict[str, int]) -> DataFrame:
    """rows: id, domain, lang, source, tokens. One row per leaf: supply, budget, passes, rest and cut."""
    leaves = rows.groupBy(*LEAF).agg(F.sum("tokens").alias("supply"))
    leaves = scratch.keep(budgets(leaves, share, epochs, domain_weights, lang_weights), "leaves")
    small = leaves.count() <= BROADCAST_LEAVES
    side = lambda x: F.broadcast(x) if small else x
    keyed = rows.join(side(leaves.select(*LEAF, "passes", "rest")), LEAF).withColumn("key", order_key(seed, F.col("passes"), F.col("id")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEAF, "bucket", "rest").agg(F.sum("tokens").alias("in"))  # at most 4096 rows a leaf
    upto = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("upto", F.sum("in").over(upto)).where("upto > rest and upto - in <= rest")
    ends = ends.select(*LEAF, "bucket", (F.col("upto") - F.col("in")).alias("before"))  # one row a leaf
    inside = Window.partitionBy(*LEAF).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    last = keyed.join(side(ends), [*LEAF, "bucket"]).withColumn("sum", F.col("before") + F.sum("tokens").over(inside))
    cuts = last.where("sum > rest").groupBy(*LEAF).agg(F.min("key").alias("cut"))
    return scratch.keep(leaves.join(cuts, LEAF, "left"), "plan")


def mix(df: DataFrame, scratch: Scratch, share: float = 0.8, epochs: int = 2, seed: int = 1, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", domain_weights: dict[str, int] | None = None, lang_weights: dict[str, int] | None = None, keep: list[str] | None = None, count: str | None = None) -> DataFrame:
    """The rows of ``df`` that the mix takes, once for each pass: columns ``keep`` (all by default), then __domain, __epoch, __tokens.

    The budget is ``share`` of all tokens. ``count`` is a column with each row's tokens (null: none), for instance from one of the tokenizers; without it they
    are reckoned by ``tokens``. Null languages and sources are leaves of their own (named ''); a null text has one
    token; rows that repeat a doc_id are taken or left together; an empty table gives an empty one. No leaf gets more than
    ``epochs`` passes; what the tree can't hold is not handed out.
    """
    dw, lw = DOMAIN_WEIGHTS if domain_weights is None else domain_weights, LANG_WEIGHTS if lang_weights is None else lang_weights
    leaf = {"__domain": domain(F.col(source)), "__lang": F.coalesce(F.col(lang), F.lit("")), "__source": F.coalesce(F.col(source), F.lit("")), "__tokens": tokens(text) if count is None else F.coalesce(F.col(count).cast("long"), F.lit(0))}
    marked = df.withColumns(leaf)
    rows = scratch.keep(marked.select(F.col(doc_id).alias("id"), *[F.col(f"__{c}").alias(c) for c in (*LEAF, "tokens")]), "rows")
    made = plan(rows, scratch, share, epochs, seed, dw, lw)
    made = made.select(*[F.col(c).alias(f"__p_{c}") for c in made.columns])
    if made.count() <= BROADCAST_LEAVES:
        made = F.broadcast(made)
    on = (F.col("__domain") == F.col("__p_domain")) & (F.col("__lang") == F.col("__p_lang")) & (F.col("__source") == F.col("__p_source"))
    rows = marked.join(made, on)
    more = order_key(seed, F.col("__p_passes"), F.col(doc_id)) < F.col("__p_cut")
    times = F.col("__p_passes") + F.when(more, 1).otherwise(0)
    rows = rows.withColumn("__epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), (times - 1).cast("int"))).otherwise(F.array().cast("array<int>"))))
    return rows.select(*(df.columns if keep is None else keep), "__domain", "__epoch", "__tokens")
