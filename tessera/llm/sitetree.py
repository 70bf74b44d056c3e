"""HTML main-text extraction by site style trees.

The pages of a host are merged into one tree: an element is known by its path of block tags with their classes. Two
entropies are kept over the host's distinct pages, each divided by the log of the number of its occurrences: for an element, that of
its presentation (the sequences of children it appears with); for a node that holds text, that of its content (the
texts). All hosts together form one more tree: a host's entropies count as if ``DOUBT`` occurrences had been seen with those of all
hosts, and those of all hosts as if ``DOUBT`` had been seen that never repeat. So a node that a host shows seldom leans on what
the same node is elsewhere, and a node that was seen nowhere else is kept.

A node's importance is ``CONTENT`` parts the entropy of its content and the rest that of its parent's presentation, more or less what
the page says about it: ``MARKED`` more inside an article, ``CLASSED`` more in an element of an article with a class of its own,
``NAMED`` less where tags, classes or roles name it noise (a menu, an advert, reader comments), and ``OUTSIDE`` less outside the
article of a page that has one. Below ``LEAST`` its texts are removed from each page; a branch goes if all its nodes go.

The trees are sums of counts that are aggregated before and after one shuffle, so a host with a third of all pages is
no hot group. Copies of one page count once. Only paths of low importance are sent to the tasks: as one broadcast
while they are at most ``BROADCAST_PATHS``, else by a join on the host, whose pages are dealt to ``SALTS`` places.

Null html and pages without text: empty text. Null or odd URLs share the nameless host. Repeated rows get equal texts.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, numbered, pick, session_of, ship

LEAST, CONTENT, DOUBT = 0.7, 0.8, 20
MARKED, CLASSED, NAMED, OUTSIDE = 0.7, 0.3, 0.4, 0.4
BROADCAST_PATHS, SALTS = 1 << 20, 16

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)|(\bhidden\b)""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Tags by their role in HTML, and names that tell what a branch is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED_TAGS = frozenset(
    "head script style title noscript template iframe object embed applet svg math canvas audio video form button select textarea input label fieldset nav aside footer dialog menu datalist xmp noembed noframes".split()
)
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"} | {"hr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer notice notices cookie cookies consent gdpr alert popup modal overlay comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search form toolbar widget copyright skip pagination pager".split()
)
OUTER_NAMES = frozenset("header masthead topbar".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())


def host_of(url: str | None) -> str:
    """Host of a URL, in lower case, without port and user."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].partition(":")[0].lower()


def number(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Element:
    __slots__ = ("tag", "path", "role", "kids", "dropped")

    def __init__(self, tag: str, path: str, role: int, dropped: bool):
        self.tag, self.path, self.role, self.dropped, self.kids = tag, path, role, dropped, []


def describe(tag: str, attributes: str) -> tuple[str, int]:
    """Class part of an element's name, and its role: 1 the article, -1 noise, -2 noise outside an article, 0 unknown."""
    role = 1 if tag in ("article", "main") else -1 if tag in DROPPED_TAGS else -2 if tag == "header" else 0
    if not attributes:
        return "", role
    own = ""
    for name, value, hidden in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if hidden or (name == "style" and re.search(r"display\s*:\s*none", value)) or (name == "aria-hidden" and value == "true"):
            return own, -1
        if name == "class":
            own = ".".join(sorted(value.split()))
        if tag in ("html", "body") or role == 1:
            continue
        if name == "role":
            role = 1 if value in ("main", "article") else -1 if value in NOISE_ROLES else role
        elif name in ("class", "id") and tag in BLOCKS | {"span", "a"}:
            words = {w.lower() for w in NAME.findall(value)}
            if words & NOISE_NAMES:
                role = -1
            elif role == 0 and words & OUTER_NAMES:
                role = -2
    return own, role


class Page:
    """Blocks of text in order with their element paths, and the elements with their children."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, Element, bool, bool]] = []  # text, element, inside an article, noise by name
        self.elements: list[Element] = []
        self.pieces: list[str] = []
        root = Element("#", "", 0, False)
        self.stack: list[Element] = [root]
        self.inside = 0
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self.close(tag)
                continue
            self.open(tag, m[3] or m[6] or "")
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
                self.close(tag)
        self.flush()

    def text(self, text: str) -> None:
        self.pieces.append(text)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(references.unescape("".join(self.pieces)).split())
            self.pieces = []
            if text:
                top = self.stack[-1]
                self.blocks.append((text, top, self.inside > 0, top.dropped))

    def pop(self) -> None:
        self.inside -= self.stack.pop().role == 1

    def open(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS or tag == "hr"
        own, role = describe(tag, attributes)
        if block:
            self.flush()
            if tag in CLOSES_P:
                self.up({"p"}, {"td", "th", "button", "table", "#"})
            if tag in SIBLINGS:
                self.up(SIBLINGS[tag], SCOPES[tag] | {"#"})
        elif role == -1 and tag not in VOID:
            self.flush()
        if tag == "br":
            self.pieces.append(" ")
        if tag in VOID or tag == "hr":
            return
        parent = self.stack[-1]
        if role == -2:
            role = 0 if self.inside else -1
        path = parent.path
        if block:
            path = f"{path}>{tag}.{own}" if own else f"{path}>{tag}"
            parent.kids.append(tag)
        dropped = parent.dropped or role == -1
        element = Element(tag, path, role, dropped)
        if block:
            self.elements.append(element)
        else:
            element.kids = parent.kids
        self.inside += role == 1
        self.stack.append(element)

    def up(self, tags: set, scope: set) -> None:
        """Close the nearest of some tags, if it is within a scope."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i].tag in scope:
                return

    def close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                if tag in BLOCKS or any(e.tag in BLOCKS or e.role == -1 for e in self.stack[i:]):
                    self.flush()
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i].tag in ("article", "main", "body") and tag not in BLOCKS:
                return


def parent(path: str) -> str:
    return path.rpartition(">")[0]


def statistics(url: str | None, source: str) -> list[tuple[int, int, int, int, int, int]]:
    """Host, path, its parent, kind (0 presentation, 1 content), value and page, as numbers."""
    host, page = number(host_of(url)), number(source)
    tree = Page(source)
    known: dict[str, tuple[int, int]] = {}

    def place(path: str) -> tuple[int, int]:
        if path not in known:
            known[path] = number(path), number(parent(path))
        return known[path]

    out = [(host, *place(e.path), 0, number(" ".join(e.kids)), page) for e in tree.elements]
    return out + [(host, *place(element.path), 1, number(text), page) for text, element, _, _ in tree.blocks]


def weight(path: str, inside: bool, dropped: bool, marked: bool) -> float:
    """What the page itself says for or against a node's importance."""
    if dropped:
        return -NAMED
    if not inside:
        return -OUTSIDE if marked else 0.0
    return CLASSED if "." in path.rpartition(">")[2] and below_article(path) else MARKED


def extract_text(source: str | None, importance) -> str:
    """Text of the kept blocks. importance: of a path's number, what the trees say of it."""
    if not source:
        return ""
    tree = Page(source)
    marked = any(inside and not dropped for _, _, inside, dropped in tree.blocks)
    known: dict[tuple, bool] = {}
    kept = []
    for text, element, inside, dropped in tree.blocks:
        if (at := (element.path, inside, dropped)) not in known:
            known[at] = importance(number(element.path)) + weight(*at, marked) >= LEAST
        if known[at]:
            kept.append(text)
    return "\n".join(kept)


def below_article(path: str) -> bool:
    return bool(re.search(r">(article|main)\b", parent(path)))


def entropies(counts: DataFrame, *keys: str) -> DataFrame:
    """keys, seen, h: how often a node was seen, and the entropy of its values, 1 if none repeats."""
    n = F.when(F.col("low") == F.col("high"), 1).otherwise(F.col("n"))
    sums = counts.groupBy(*keys).agg(F.sum(n).alias("seen"), F.sum(n * F.log(n)).alias("s"))
    h = F.when(F.col("seen") > 1, 1 - F.col("s") / (F.col("seen") * F.log("seen"))).otherwise(1.0)
    return sums.select(*keys, "seen", h.alias("h"))


def trees(pages: DataFrame, url: str, source: str, scratch: Scratch) -> DataFrame:
    """host, path, importance of every text node below the threshold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["host", "path", "parent", "kind", "value", "page"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            urls, sources = batch.column(0), batch.column(1)
            for i in range(0, batch.num_rows, 200):
                rows = [r for u, s in zip(urls[i : i + 200].to_pylist(), sources[i : i + 200].to_pylist()) if s for r in statistics(u, s)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    rows = pick(pages, url, source).mapInArrow(count, "host bigint, path bigint, parent bigint, kind int, value bigint, page bigint")
    node = ["path", "parent", "kind"]
    counts = rows.groupBy("host", *node, "value").agg(F.count("*").alias("n"), F.min("page").alias("low"), F.max("page").alias("high"))
    counts = scratch.keep(counts)  # so pages are read once for the trees
    everywhere = counts.groupBy(*node, "value").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    doubt = F.lit(float(DOUBT))
    everywhere = entropies(everywhere, *node).select(*node, ((F.col("seen") * F.col("h") + doubt) / (F.col("seen") + doubt)).alias("every"))
    own = scratch.keep(entropies(counts, "host", *node).withColumn("salt", F.pmod("host", F.lit(SALTS))))
    everywhere = own.select(*node, "salt").distinct().join(everywhere, node)
    both = own.join(everywhere, [*node, "salt"])
    both = scratch.keep(both.select("host", *node, ((F.col("seen") * F.col("h") + doubt * F.col("every")) / (F.col("seen") + doubt)).alias("h")))
    shown = both.filter("kind = 0").select("host", F.col("path").alias("parent"), F.col("h").alias("shown"))
    content = both.filter("kind = 1").join(shown, ["host", "parent"], "left")
    importance = CONTENT * F.col("h") + (1 - CONTENT) * F.coalesce("shown", "h")
    return content.select("host", "path", importance.alias("importance")).filter(F.col("importance") < LEAST)


def extract(pages: DataFrame, url: str = "url", source: str = "html", into: str = "main_text", most_paths: int = BROADCAST_PATHS) -> DataFrame:
    """Pages with a string column ``into``: the text of what is left of each page."""
    spark = session_of(pages)
    ship(spark)
    scratch = Scratch(spark)
    low = scratch.keep(trees(pages, url, source, scratch))
    if low.count() > most_paths:
        return _joined(pages, low, url, source, into)
    rows = low.orderBy("host").toArrow()
    shared = spark.sparkContext.broadcast([rows.column(c).to_numpy() for c in ("host", "path", "importance")])

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hosts, paths, values = shared.value
        by_host: dict[int, dict] = {}
        for urls, sources in batches:
            out = []
            for u, s in zip(urls.to_pylist(), sources.to_pylist()):
                if (h := number(host_of(u))) not in by_host:
                    a, b = np.searchsorted(hosts, h, "left"), np.searchsorted(hosts, h, "right")
                    by_host[h] = dict(zip(paths[a:b].tolist(), values[a:b].tolist()))
                own = by_host[h]
                out.append(extract_text(s, lambda path: own.get(path, 1.0)))
            yield pa.array(out, pa.string())

    own, (at_url, at_source) = numbered(pages, url, source)
    return own.withColumn(into, run(F.col(at_url), F.col(at_source))).toDF(*pages.columns, into)


def _joined(pages: DataFrame, low: DataFrame, url: str, source: str, into: str) -> DataFrame:
    """The same where the paths are too many for a broadcast: each page meets those of its host."""

    @F.arrow_udf("bigint")
    def host(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for urls in batches:
            yield pa.array([number(host_of(u)) for u in urls.to_pylist()], pa.int64())

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sources, lists in batches:
            out = []
            for s, found in zip(sources.to_pylist(), lists.to_pylist()):
                own = {r["path"]: r["importance"] for r in found or ()}
                out.append(extract_text(s, lambda path: own.get(path, 1.0)))
            yield pa.array(out, pa.string())

    lists = low.groupBy(F.col("host").alias("__host")).agg(F.collect_list(F.struct("path", "importance")).alias("__low"))
    own, (at_url, at_source) = numbered(pages, url, source)
    placed = own.withColumn("__host", host(F.col(at_url))).withColumn("__salt", F.pmod(F.xxhash64(at_url, at_source), F.lit(SALTS)))
    lists = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    found = placed.join(lists, ["__host", "__salt"], "left")
    return found.select(*own.columns, run(F.col(at_source), F.col("__low")).alias(into)).toDF(*pages.columns, into)


def op1_extract(spark, sf_dir: str) -> DataFrame:
    out = extract(pick(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html"), into="text")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
