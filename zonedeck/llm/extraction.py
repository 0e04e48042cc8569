"""HTML extraction with a site style tree.

Pages of a host are merged into one tree whose nodes are element paths (names with
their classes, numbers in those alike). For each node the tree counts its presentations (the sequence of its
children's names) and its contents (hashes of all text of its branch). A node's
importance is the larger of the two entropies, each over the log of the node's count:
what looks and reads alike on all pages is unimportant. A host with few pages leans on
the same statistics over all hosts: importance is the mean of the two, the corpus
weighing as PRIOR elements. Branches of less importance than THRESHOLD are removed
from each page, as are those whose element or class says what they are (navigation,
forms, adverts, comments, ...). Inside article and main the host's own statistics decide,
with INSIDE elements that are important: a branch there goes only if the host shows
often enough that it repeats. An article or main that repeats as a whole is left
as it is, and goes only if the page has another one with text.

Statistics are summed within each task and then by host and node, so a host that has
most pages stays spread out, and the pages themselves aren't dealt by host: up to
MAX_NODES removed nodes (of all hosts together) are sent to the tasks; beyond, pages meet
their host's removed nodes in a join that is salted by page.

Defined cases: null or empty html gives an empty text; a null or odd url belongs to
the host ''; unclosed and misnested elements are closed as browsers do for blocks; a tag
that never ends takes the rest of the page; character references are decoded once; equal
pages give equal texts; very long and very deep pages are read whole, in time that grows
with their length; other columns are not looked at.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

THRESHOLD = 0.4
PRIOR = 50.0
INSIDE = 10.0
#: Removed nodes up to which they are sent to the tasks, and the tasks over which the join deals a host's pages beyond.
MAX_NODES, SALTS = 200_000, 64

# Element names with a meaning of their own in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead"
    " title tr ul br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
DROPPED = frozenset("head nav header footer aside form menu script style noscript template iframe svg math object button select dialog textarea title".split())
#: Words in a class, id or role that name something beside the main text.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus"
    " footer gdpr header menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion related reply replies"
    " respond search share sharing sidebar sidebars side social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: What a start tag closes up to the nearest scope, besides an open paragraph.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside blockquote body div fieldset footer form header html main nav section table td th ul ol dl".split())

CLOSABLE = frozenset("p li dt dd tr td th option".split())

# Possessive, so that a tag is read once: a quoted value counts after "=" only, and one without its end is read as plain letters.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""")
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Node:
    """key: hash of the path from the root. inside: an article or main holds it. closable: nearest element of CLOSABLE that a start tag may close, itself included."""

    __slots__ = ("name", "key", "hinted", "inside", "closable", "children", "parent")

    def __init__(self, name: str, label: str, hinted: bool, parent: Node | None):
        self.name, self.hinted, self.parent = name, hinted, parent
        self.key = _signed(f"{parent.key}>{label}") if parent else 0
        self.inside = parent is not None and (parent.inside or parent.name in ("article", "main"))
        self.closable = self if name in CLOSABLE else None if name in SCOPES or parent is None else parent.closable
        self.children: list[Node | str] = []


def _signed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def tags(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "/" of an end tag, name, attributes) of each tag, and the text after the last one; comments and the like are left out."""
    at, n = 0, len(page)
    find, match = page.find, _TAG.match
    while (mark := find("<", at)) >= 0:
        if m := match(page, mark):
            end, name, attributes = m.groups()
            name = name.lower()
            yield page[at:mark], end, name, attributes
            at = m.end()
            if not end and name in RAW:
                # Its content isn't markup.
                raw = _raw_end(name).search(page, at)
                if name == "title":
                    yield page[at : raw.start() if raw else n], "", "", ""
                at = raw.end() if raw else n
            continue
        sign = page[mark + 1 : mark + 2]
        letter = page[mark + 2 : mark + 3] if sign == "/" else sign
        if letter.isascii() and letter.isalpha():  # a tag that never ends
            yield page[at:mark], "", "", ""
            at = n
        elif sign in ("!", "?", "/"):
            comment = page.startswith("<!--", mark)
            stop = find("-->" if comment else ">", mark + 2)
            yield page[at:mark], "", "", ""
            at = n if stop < 0 else stop + (3 if comment else 1)
        else:
            yield page[at : mark + 1], "", "", ""
            at = mark + 1
    yield page[at:], "", "", ""


@lru_cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\s*+>", re.I)


def parse(page: str) -> Node:
    """The tree of block elements; inline elements are read through, text blocks are strings."""
    root = Node("", "", False, None)
    node, text = root, []
    open_: Counter = Counter()  # elements by name that the current one lies in

    def flush() -> None:
        if text:
            block = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
            text.clear()
            if block:
                node.children.append(block)

    def leave(to: Node) -> Node:
        at = node
        while at is not to:
            open_[at.name] -= 1
            at = at.parent
        return to

    for before, end, name, attributes in tags(page):
        if before:
            text.append(before)
        if not name or name not in BLOCKS:
            continue
        if end:
            if name not in VOID and open_[name]:
                flush()
                up = node
                while up.name != name:
                    up = up.parent
                node = leave(up.parent)
            continue
        flush()
        if name in VOID or name == "title" or name in RAW:
            continue
        stop, up = CLOSES.get(name, ()), node.closable
        while up is not None:
            if up.name == "p" or up.name in stop:
                node = leave(up.parent)
            elif up.name in SCOPES:
                break
            up = up.parent.closable
        names = [v.strip("\"'").lower() for _, v in _NAMES.findall(attributes)] if attributes else []
        hinted = any(w in HINTS for v in names for w in _WORD.findall(v))
        child = Node(name, name + "".join("." + _DIGITS.sub("#", v) for v in names), hinted, node)
        node.children.append(child)
        open_[name] += 1
        node = child
    flush()
    return root


def beside(node: Node) -> bool:
    """Whether element or class say that it isn't main text; an article's own header is part of it."""
    if node.name == "header":
        return node.hinted or not node.inside
    return node.name in DROPPED or node.hinted and node.name not in ("html", "body")


def features(root: Node) -> Iterator[tuple[int, int, int]]:
    """(node, 0 presentation or 1 content, hash) of each element; content is all text of the branch."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    said: dict[int, int] = {}
    for node in reversed(order):  # children before their parents
        inner = [c for c in node.children if isinstance(c, Node)]
        parts = [xxhash.xxh64_intdigest(c) if isinstance(c, str) else said[id(c)] for c in node.children]
        said[id(node)] = content = xxhash.xxh64_intdigest(repr([x for x in parts if x])) if any(parts) else 0
        if node.parent:
            key = node.key
            yield key, 0, xxhash.xxh64_intdigest(",".join(dict.fromkeys(c.name for c in inner))) >> 1
            if content:
                yield key, 1, content >> 1


def main_text(root: Node, removed: frozenset[int] | set[int], inside: frozenset[int] | set[int]) -> str:
    """Blocks in page order that no removed branch holds; inside article and main the second set is what is removed."""
    blocks: list[tuple[str, int]] = []
    todo: list[tuple[Node | str, int]] = [(root, 0)]
    while todo:
        node, place = todo.pop()  # place: 0 outside, 1 in an article or main, 2 in one that repeats as a whole
        if isinstance(node, str):
            blocks.append((node, place))
            continue
        if beside(node):
            continue
        if not place and node.name in ("article", "main"):
            place = 2 if node.key in inside else 1
        elif node.parent and place < 2 and node.key in (inside if place else removed):
            continue
        todo += [(c, place) for c in reversed(node.children)]
    varied = any(place == 1 for _, place in blocks)
    return "\n".join(text for text, place in blocks if place < 2 or not varied)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def style_statistics(pages: DataFrame) -> DataFrame:
    """(host, node, kind, value, n), summed within each slice of pages already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "html"):
            counts: Counter = Counter()
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                host = host_of(url)
                counts.update((host, *f) for f in features(parse(page or "")))
            columns = list(zip(*((*k, n) for k, n in counts.items()))) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "node", "kind", "value", "n"])

    schema = "host string, node long, kind int, value long, n long"
    return pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, schema)


def _entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m and importance from keys, kind, value and n: the larger of both kinds' entropies over log m."""
    kinds = counts.groupBy(*keys, "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    share = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    return kinds.withColumn("e", share).groupBy(*keys).agg(F.max("m").alias("m"), F.max("e").alias("importance"))


def unimportant_nodes(pages: DataFrame, threshold: float = THRESHOLD, prior: float = PRIOR) -> DataFrame:
    """(host, node, outside, within): the nodes of each host's tree that fall short of the threshold, outside and within article and main."""
    counts = common.cut(style_statistics(pages).groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n")))
    own = _entropy(counts, ["host", "node"])
    everywhere = _entropy(counts.groupBy("node", "kind", "value").agg(F.sum("n").alias("n")), ["node"])
    everywhere = everywhere.select("node", F.col("importance").alias("overall"))
    joined = own.join(everywhere, "node")
    mean = (F.col("m") * F.col("importance") + F.lit(prior) * F.col("overall")) / (F.col("m") + F.lit(prior))
    sure = (F.col("m") * F.col("importance") + F.lit(INSIDE)) / (F.col("m") + F.lit(INSIDE))
    flags = joined.select("host", "node", (mean < threshold).alias("outside"), (sure < threshold).alias("within"))
    return flags.filter("outside OR within")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


TEXTS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
_NONE: tuple = (frozenset(), frozenset())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    nodes = common.cut(unimportant_nodes(pages))
    if nodes.count() > MAX_NODES:
        return _extract_joined(pages, nodes)
    trees: dict[str, tuple[set, set]] = {}
    for r in nodes.collect():  # MAX_NODES rows at most
        both = trees.setdefault(r["host"], (set(), set()))
        for k, name in enumerate(("outside", "within")):
            if r[name]:
                both[k].add(r["node"])
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "html"):
            urls = batch.column(1).to_pylist()
            texts = [main_text(parse(page or ""), *shared.value.get(host_of(url), _NONE)) for url, page in zip(urls, batch.column(2).to_pylist())]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=TEXTS.names)

    return pages.mapInArrow(run, TEXTS)


def _extract_joined(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """extract() by a join on host and salt: each host's nodes are there once a salt."""
    lists = nodes.groupBy("host").agg(*[F.collect_list(F.when(F.col(c), F.col("node"))).alias(c) for c in ("outside", "within")])
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("host", host(F.col("url"))).withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int"))
    joined = salted.join(lists, ["host", "salt"], "left").select("page_id", "url", "html", "outside", "within")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches, "html"):
            texts = [main_text(parse(page or ""), set(out or ()), set(within or ())) for page, out, within in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=TEXTS.names)

    return joined.mapInArrow(run, TEXTS)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
