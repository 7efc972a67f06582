"""HTML extraction by equivalence-class template deduction (operator 1).

A page is a sequence of tokens with roles: the start and end of a block element under its path, and a
block of text under its path. Tokens of a host that occur equally often on the same pages - that share an
occurrence vector - are an equivalence class. Vectors are never built: the exclusive or over a token's pages of a
hash of (page, count), with the number of pages and occurrences, stands for one. A class is large and
frequent enough if it has ``SUPPORT`` of the host's distinct pages and ``PAGES`` pages at least, and valid if its tokens
come in the same order on every page.

Valid classes nest by the elements that their tokens open: an element that a class holds once on every page of the class is a node of the
host's template, below the nearest such element around it, and the region of a node that no node below it takes is its
slot. Blocks of text that valid classes hold on ``CONSTANT`` of the pages are part of the template, in whatever slot they stand.
The slots' texts, added up over all pages of the host, decide which slots are the article: from the root down, the node that holds ``MAIN``
of what its parent holds, as far as there is one, with the headings beside it. What its slots hold is a page's text. Elements that are no text by the rules of
HTML (navigation, forms, scripts and the like) are never in a slot. Nodes below the article that are lists of links are left out, and so are elements whose class or id names
what stands around an article (readers' comments may well be longer than it), unless nothing else has a text.

Pages of hosts without a template, or without the article's node, are read by their elements alone: what an article or main element
holds, else all blocks but those that the same rules leave out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .html import APART, ARTICLE, HEADING, NAMED, ROOT, Page, read

SUPPORT = 0.5
CONSTANT = 0.8
PAGES = 4
LINKED = 0.8
MAIN = 0.6


def _hash(role: str, text: bool) -> int:
    """A role's token; the lowest bit says whether it is a block of text."""
    return ((xxhash.xxh64_intdigest(role) >> 1 << 1) | text) - (1 << 63)


def tokens_of(page: Page) -> list[int]:
    text = {k for k, _, _ in page.blocks}
    return [_hash(r, k in text) for k, r in enumerate(page.roles)]


def roles(df: DataFrame, url: str, html: str) -> DataFrame:
    """Each row's host, page (hash of the html), distinct tokens in order with their counts, and the page as a tree: sequence (place of each role's token), up, marks, and the blocks' places, characters and characters in links."""
    names = ["page", "tokens", "counts", "sequence", "up", "marks", "at", "chars", "links"]
    kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int8()), *[pa.list_(pa.int32())] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part, out = b.slice(s, 500), []
                for h in part.column(0).to_pylist():
                    page = read(h or "")
                    own = tokens_of(page)
                    distinct = list(dict.fromkeys(own))
                    place = {t: k for k, t in enumerate(distinct)}
                    counts = [0] * len(distinct)
                    for t in own:
                        counts[place[t]] += 1
                    out.append((_hash(h or "", False), distinct, counts, [place[t] for t in own], page.up, page.marks, [k for k, _, _ in page.blocks], [len(t) for _, t, _ in page.blocks], [round(len(t) * x) for _, t, x in page.blocks]))
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([part.column(1), *columns], names=["host", *names])

    fields = "page long, tokens array<long>, counts array<int>, sequence array<int>, up array<int>, marks array<tinyint>, at array<int>, chars array<int>, links array<int>"
    return df.select(F.col(html).alias("html"), host_of(url).alias("host")).mapInArrow(run, f"host string, {fields}")


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(found: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per host: its valid classes, each as (support, single: once a page, tokens in order). A host has at most 1 / SUPPORT times a page's tokens.

    Equal pages of a host count once.
    """
    found = found.select("host", "page", "tokens", "counts").dropDuplicates(["host", "page"])
    pages = scratch.keep(found.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= PAGES), "pages")
    each = found.select("host", "page", F.posexplode(F.arrays_zip("tokens", "counts")).alias("place", "t"))
    each = each.select("host", "page", "place", F.col("t.tokens").alias("token"), F.col("t.counts").alias("n"))
    vectors = each.groupBy("host", "token").agg(F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.count("*").alias("on"), F.sum("n").alias("times"))
    share = F.when(F.col("token").bitwiseAND(1) == 1, CONSTANT).otherwise(SUPPORT)
    vectors = vectors.join(pages, "host").where(F.col("on") >= F.greatest(F.lit(PAGES), F.col("pages") * share))
    classes = vectors.select("host", "token", F.xxhash64("vector", "on", "times").alias("class"), (F.col("on") / F.col("pages")).alias("support"), (F.col("on") == F.col("times")).alias("single"))
    of = classes.select(F.col("host").alias("_h"), F.col("token").alias("_t"), "class", "support", "single")
    member = each.join(of, (F.col("host") == F.col("_h")) & (F.col("token") == F.col("_t"))).select("host", "page", "class", "support", "single", "place", "token")
    order = member.groupBy("host", "class", "page").agg(F.max("support").alias("support"), F.max("single").alias("single"), F.array_sort(F.collect_list(F.struct("place", "token"))).alias("members"))
    order = order.select("host", "class", "support", "single", F.col("members.token").alias("members"))
    held = order.withColumn("mark", F.xxhash64("members")).groupBy("host", "class").agg(F.min("mark").alias("a"), F.max("mark").alias("b"), F.max("support").alias("support"), F.max("single").alias("single"), F.min("members").alias("members"))
    rows = held.where("a = b").groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("support")).alias("_s"), "single", "members"))).alias("classes"))
    return rows.select("host", F.transform("classes", lambda c: F.struct((-c["_s"]).alias("support"), c["single"].alias("single"), c["members"].alias("members"))).alias("classes"))


class Template:
    """The tokens of a host's valid classes: nodes (elements once a page) and constant texts."""

    def __init__(self, classes: list[dict] | None):
        self.classes = len(classes or [])
        self.all = {t for c in classes or [] for t in c["members"]}
        self.nodes = {t for c in classes or [] if c["single"] for t in c["members"] if not t & 1}
        self.texts = {t for t in self.all if t & 1}

    def node_of(self, tokens: list[int], up: list[int]) -> list[int]:
        """For each place, the place of the nearest node that it is or lies in; -1 for none. ``up`` points back."""
        out: list[int] = []
        for k, t in enumerate(tokens):
            out.append(k if t in self.nodes else out[up[k]] if up[k] >= 0 else -1)
        return out


def inherited(up: list[int], marks: list[int], mark: int) -> list[int]:
    """For each place, the outermost place with the mark that it is or lies in; -1 for none."""
    out: list[int] = []
    for k, m in enumerate(marks):
        above = out[up[k]] if up[k] >= 0 else -1
        out.append(above if above >= 0 else k if m == mark else -1)
    return out


def slots(found: DataFrame, made: DataFrame) -> DataFrame:
    """One row per host: its nodes as (node, parent, mark, chars, links), with what the slot of each holds on all pages."""
    names, kinds = ["host", "node", "parent", "mark", "chars", "links"], [pa.string(), *[pa.int64()] * 2, pa.int32(), *[pa.int64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(Template)
        for b in batches:
            total: dict[tuple, list[int]] = {}
            for r in range(b.num_rows):
                host, tokens, sequence, up, marks, at, chars, links, _ = (c[r].as_py() for c in b.columns)
                template = known.get(host, lambda r=r, b=b: b.column(8)[r].as_py())
                own = [tokens[i] for i in sequence]
                node, apart, named = template.node_of(own, up), inherited(up, marks, APART), inherited(up, marks, NAMED)
                for k, t in enumerate(own):  # nodes without a text have a row too
                    if node[k] == k:
                        parent = node[up[k]] if up[k] >= 0 else -1
                        total.setdefault((host, t, own[parent] if parent >= 0 else 0, marks[k]), [0, 0])
                for k, n, m in zip(at, chars, links, strict=True):
                    i = node[k]
                    if i < 0 or apart[k] >= 0 or own[k] in template.texts or named[k] >= 0 and own[named[k]] not in template.nodes:
                        continue
                    parent = node[up[i]] if up[i] >= 0 else -1
                    sums = total[host, own[i], own[parent] if parent >= 0 else 0, marks[i]]
                    sums[0] += n
                    sums[1] += m
            rows = [(*k, *v) for k, v in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=names)

    rows = found.select("host", "tokens", "sequence", "up", "marks", "at", "chars", "links").join(made.select(F.col("host").alias("_h"), "classes"), F.col("host") == F.col("_h")).drop("_h")
    sums = rows.mapInArrow(run, "host string, node long, parent long, mark int, chars long, links long")
    sums = sums.groupBy("host", "node", "parent", "mark").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    return sums.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("node", "parent", "mark", "chars", "links"))).alias("nodes"))


class _Known:
    """What was made of a host's row, for the hosts that a task has met last."""

    def __init__(self, make):
        self.make, self.held = make, {}

    def get(self, key, raw):
        if key not in self.held:
            if len(self.held) > 1000:
                self.held.clear()
            self.held[key] = self.make(raw())
        return self.held[key]


class Article(NamedTuple):
    """Which node is the article, whether it is the whole page, and the nodes below it that are left out."""

    node: int | None
    root: bool
    left_out: set[int]


def choose(nodes: list[dict] | None) -> Article:
    """The article's node by what the slots of a host hold."""
    below: dict[int, list[dict]] = {}
    for n in nodes or []:
        below.setdefault(n["parent"], []).append(n)
    order, todo = [], [0]
    while todo:  # parents before what is below them
        at = todo.pop()
        order.append(at)
        todo += [n["node"] for n in below.get(at, [])]
    own = {0: (0, 0)} | {n["node"]: (n["chars"], n["links"]) for n in nodes or []}
    total: dict[int, tuple[int, int]] = {}
    named = {n["node"] for n in nodes or [] if n["mark"] == NAMED}
    for at in reversed(order):
        more = [total[n["node"]] for n in below.get(at, []) if n["node"] not in named]
        total[at] = own[at][0] + sum(m[0] for m in more), own[at][1] + sum(m[1] for m in more)
    whole = total[0][0]
    if not whole:
        return Article(None, False, set())
    path: list[dict] = []
    at, holds = 0, whole
    while True:
        best = max((n for n in below.get(at, []) if n["node"] not in named), key=lambda n: (total[n["node"]][0], n["node"]), default=None)
        if best is None or total[best["node"]][0] < MAIN * holds or path and path[-1]["mark"] == ARTICLE:
            break
        path.append(best)
        at, holds = best["node"], total[best["node"]][0]
    if not path:
        return Article(None, False, set())
    while len(path) > 1 and path[-2]["mark"] != ROOT and any(n["mark"] == HEADING and n["chars"] for n in below[path[-2]["node"]]):
        path.pop()
    own = path[-1]
    left_out, todo = set(), [own["node"]]
    while todo:
        for n in below.get(todo.pop(), []):
            chars, links = total[n["node"]]
            if chars and links >= LINKED * chars or n["mark"] == NAMED:
                left_out.add(n["node"])
            else:
                todo.append(n["node"])
    return Article(own["node"], own["mark"] == ROOT, left_out)


def by_elements(page: Page, tokens: list[int], template: Template) -> list[str]:
    """The text of a page by its elements: that of an article, else of what isn't around one."""
    apart, named, article = (inherited(page.up, page.marks, m) for m in (APART, NAMED, ARTICLE))
    rows = [(k, t, x) for k, t, x in page.blocks if apart[k] < 0]
    inside = [(k, t) for k, t, _ in rows if article[k] >= 0 and (named[k] < 0 or named[k] < article[k])]
    if inside:
        return [t for _, t in inside]
    return [t for k, t, x in rows if named[k] < 0 and x < LINKED and tokens[k] not in template.texts]


def main_text(page: Page, template: Template, article: Article) -> str:
    """The page's slots below the article's node as lines."""
    tokens = tokens_of(page)
    if article.node not in tokens:
        return "\n".join(by_elements(page, tokens, template))
    apart, named = inherited(page.up, page.marks, APART), inherited(page.up, page.marks, NAMED)
    inside: list[bool] = []
    left_out: list[bool] = []
    for k, t in enumerate(tokens):
        above = page.up[k]
        inside.append(t == article.node or above >= 0 and inside[above])
        left_out.append(inside[k] and (t in article.left_out or above >= 0 and left_out[above]))
    rows = [(k, t) for k, t, x in page.blocks if inside[k] and not left_out[k] and apart[k] < 0 and not (article.root and x >= LINKED)]
    rows = [(k, t) for k, t in rows if named[k] < 0 or not inside[named[k]]] or rows
    own = [t for k, t in rows if tokens[k] not in template.texts]
    constant = sum(len(t) for k, t in rows if tokens[k] in template.texts)
    # Where the constant texts are the larger part, the host's pages are copies of each other.
    return "\n".join(own if constant <= sum(map(len, own)) else [t for _, t in rows])


def extract(df: DataFrame, scratch: Scratch, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, host, n_classes (valid classes of the host's template), n_slots (blocks of text not in it).

    A null html has no text; a null url, or one without a host, belongs to the host ''. A host of fewer than ``PAGES`` distinct pages
    has no template, and its pages are read by their elements alone. Repeated rows stay and change nothing for others, an empty table gives
    an empty one, and other columns, whatever their names, are not read.
    """
    found = scratch.keep(roles(df, url, html), "roles")
    made = scratch.keep(templates(found, scratch), "templates")
    held = scratch.keep(slots(found, made), "slots")
    made = made.join(held.select(F.col("host").alias("_s"), "nodes"), F.col("host") == F.col("_s"), "left").select(F.col("host").alias("_host"), "classes", "nodes")
    made = scratch.keep(made, "made")
    scratch.drop("roles")
    key, link = (df.select(c).schema[0].dataType.simpleString() for c in (page_id, url))
    rows = df.select(page_id, url, html, host_of(url).alias("_h")).join(made, F.col("_h") == F.col("_host"), "left").drop("_host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(lambda raw: (Template(raw[0]), choose(raw[1])))
        for b in batches:
            hosts = b.column(3).to_pylist()
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                texts, slots, classes = [], [], []
                for i, h in enumerate(part.column(2)):
                    template, article = known.get(hosts[s + i], lambda r=s + i, b=b: (b.column(4)[r].as_py(), b.column(5)[r].as_py()))
                    page = read(h.as_py() or "")
                    texts.append(main_text(page, template, article))
                    slots.append(sum(_hash(page.roles[k], True) not in template.texts for k, _, _ in page.blocks))
                    classes.append(template.classes)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), part.column(3), pa.array(classes, pa.int32()), pa.array(slots, pa.int32())], names=["page_id", "url", "text", "n_chars", "host", "n_classes", "n_slots"])

    out = rows.mapInArrow(run, f"page_id {key}, url {link}, text string, n_chars long, host string, n_classes int, n_slots int")
    return out.withColumnsRenamed({"page_id": page_id, "url": url})
