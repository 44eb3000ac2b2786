"""Main text of web pages by a site style tree.

The pages of one host are merged into one tree of styles: a node stands for
all elements reached by the same path of tags and classes. A node's importance
is the entropy of how it looks (presentation) combined with how varied its
words, link targets and images are (content); branches of low importance are
boilerplate and are removed from each page. Marked-up boilerplate (menus,
footers, forms ...) goes anyway, so hosts of few pages are served too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import column, materialize

#: Share of a node's look against what is below it, per level (the style tree's gamma).
GAMMA = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg object canvas audio video".split())
#: Of these, the ones that hold the rest of the page where their end is missing.
ENDLESS = frozenset("script style textarea title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE = frozenset("nav footer aside form head menu dialog button select label fieldset option datalist".split())
#: Words in class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead comment comments respond disqus share sharing social "
    "newsletter subscribe signup login search related widget pagination pager toolbar contentinfo complementary dialog form alert".split()
)
#: Words that a marked class may hold besides; any other word says that the class is about something else (related-work).
PLAIN = frozenset(
    "box wrap wrapper block section container area list item items group inner outer content main primary secondary top bottom left right "
    "header head title bar side site page global reader user post posts article link links button icon text message overlay slot unit center".split()
)
#: Levels of a page that the style tree tells apart; what is deeper counts as its ancestor there.
DEPTH = 64
#: Children of an element that tell how it looks.
WIDTH = 64
#: What an opening tag closes: a paragraph ends where a block begins, an item where the next begins.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PART = re.compile(r"[^a-z0-9]+")


@lru_cache(65_536)
def node_key(parent: int, style: str) -> int:
    """A node of the style tree: its parent and its own tag and class."""
    return xxhash.xxh64_intdigest(style, seed=parent & (2**64 - 1)) - 2**63


@lru_cache(16_384)
def _attributes(source: str) -> tuple[str, frozenset[str], bool, bool, str]:
    """Class, words of class, id and role, whether one of these names marks boilerplate, whether the element is hidden, and its link or image."""
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), a or b or c)
    names = [set(_PART.split(x)) - {""} for n in ("class", "id", "role") for x in found.get(n, "").lower().split()]
    marked = any(words & MARKS and words <= MARKS | PLAIN for words in names)
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))
    return found.get("class", ""), frozenset().union(*names), marked, hidden, found.get("href") or found.get("src") or ""


@dataclass(slots=True)
class Element:
    tag: str
    key: int
    depth: int
    dropped: bool
    main: bool
    low: bool
    children: list[str] = field(default_factory=list)


@dataclass
class Page:
    """Blocks of text that no mark-up rules out (text, node, whether in a main part, whether in a branch of low importance), and what the style tree is made of."""

    blocks: list[tuple[str, int, bool, bool]] = field(default_factory=list)
    looks: list[tuple[int, int]] = field(default_factory=list)
    targets: list[tuple[int, str]] = field(default_factory=list)
    parents: dict[int, int] = field(default_factory=dict)

    def path(self, key: int) -> list[int]:
        out = []
        while key:
            out.append(key)
            key = self.parents[key]
        return out[::-1]


def parse(html: str, low: frozenset[int] = frozenset()) -> Page:
    """What a page holds. Broken mark-up is read as browsers do: missing ends are implied, stray ends ignored."""
    page = Page()
    stack = [Element("", 0, 0, False, False, False)]
    opened: Counter[str] = Counter()
    parts: list[str] = []
    owner = stack[0]

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                page.blocks.append((text, owner.key, owner.main, owner.low))
            parts.clear()

    def say(text: str) -> None:
        nonlocal owner
        if not stack[-1].dropped:
            if not parts:
                owner = stack[-1]
            parts.append(text)

    def close(depth: int) -> None:
        while len(stack) > depth:
            done = stack.pop()
            opened[done.tag] -= 1
            if done.tag in BLOCK:
                flush()
            if not done.dropped and done.children:
                page.looks.append((done.key, xxhash.xxh64_intdigest(" ".join(done.children)) - 2**63))

    def last(tags: set[str], within: set[str]) -> int:
        if not any(opened[t] for t in tags):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in within:
                return 0
        return 0

    at, length = 0, len(html)
    while at < length:
        found = _TOKEN.search(html, at)
        if not found:
            say(html[at:])
            break
        if found.start() > at:
            say(html[at : found.start()])
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            k = last({tag}, set() if tag in BLOCK else {"td", "th", "table", "article", "main", "body"})
            if k:
                close(k)
            elif tag in BLOCK:
                flush()
            continue
        if tag in RAW:
            if not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I).search(html, at)
                at = end.end() if end else length if tag in ENDLESS else at
            continue
        if tag in BLOCK:
            k = last({"p"}, {"table", "td", "th", "article", "section", "div", "li"})
            if k:
                close(k)
            flush()
        if tag in CLOSES:
            k = last(*CLOSES[tag])
            if k:
                close(k)
        if tag == "br":
            say(" ")
        up = stack[-1]
        css, words, marked, hidden, target = _attributes(found[3])
        if target and not up.dropped:
            page.targets.append((up.key, target))
        if tag in VOID:
            continue
        style = f"{tag}.{css}" if css else tag
        if len(up.children) < WIDTH and (not up.children or up.children[-1] != style):
            up.children.append(style)
        main = up.main or tag in ("article", "main") or "main" in words and tag == "div"
        keep = tag in ("html", "body", "article", "main")
        dropped = up.dropped or hidden or (not keep and (tag in BOILERPLATE or marked or not up.main and (tag == "header" or "header" in words)))
        if keep and tag == "article" and words & {"comment", "reply"}:
            dropped = True
        key = up.key
        if up.depth < DEPTH:
            key = node_key(up.key, style)
            page.parents[key] = up.key
        stack.append(Element(tag, key, up.depth + 1, dropped, main, up.low or key in low))
        opened[tag] += 1
    close(1)
    flush()
    if any(main for _, _, main, _ in page.blocks):
        page.blocks = [b for b in page.blocks if b[2]]
    return page


def main_text(html: str | None, low: frozenset[int] = frozenset()) -> str:
    """Blocks joined by line feeds, without branches of low importance; if those are all there is, with them."""
    blocks = parse(html or "", low).blocks
    return "\n".join([b[0] for b in blocks if not b[3]] or [b[0] for b in blocks])


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user, port and a leading www.; empty if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


LOOK, TEXT = 0, 1
SUMS = ("nlogn", "total", "logn", "features")
#: Features held by a task before they are counted; parts that a node's features are dealt to, by hash.
HELD, PARTS = 1_000_000, 16


class _Words(dict):
    """word -> feature; remembers a bounded number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) >> 16
        return value


def node_features(page: Page, words: _Words) -> Iterator[tuple[int, int, list[int]]]:
    """node, kind and different features of a page: looks of children; words, link targets and images."""
    looks: dict[int, set[int]] = {}
    for key, look in page.looks:
        looks.setdefault(key, set()).add(look & (2**48 - 1))
    texts: dict[int, set[str]] = {}
    for text, key, _, _ in page.blocks:
        texts.setdefault(key, set()).update(text.split())
    targets: dict[int, set[str]] = {}
    for key, target in page.targets:
        if key in texts:
            targets.setdefault(key, set()).add(target)
    for key, found in looks.items():
        yield key, LOOK, list(found)
    for key, found in texts.items():
        links = [xxhash.xxh64_intdigest(t, 1) >> 16 for t in targets.get(key, ())]
        yield key, TEXT, [*map(words.__getitem__, found), *links]


def page_features(page: Page) -> set[tuple[int, int, int]]:
    return {(key, kind, x) for key, kind, found in node_features(page, _Words()) for x in found}


def style_rows(pages: DataFrame) -> DataFrame:
    """host, node, kind, part, path, counts: what the pages of a task add to their hosts' trees.

    counts holds 64-bit words: a feature (48 bits of its hash) and on how many
    pages it was (16 bits; more are told by several words). A node's features
    are dealt to PARTS rows, so that nobody holds all of a large host's.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, int] = {}
        paths: dict[tuple[int, int], list[int]] = {}
        heads: list[tuple[int, int, int]] = []
        sizes: list[int] = []
        held: list[int] = []
        words_of = _Words()

        def made() -> pa.RecordBatch:
            rows = np.column_stack([np.repeat(np.array(heads, dtype=np.int64), sizes, axis=0), np.array(held, dtype=np.int64)])
            rows = rows[np.lexsort(rows.T[::-1])]
            new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
            n = np.diff(np.append(np.flatnonzero(new), len(rows)))
            rows, part = rows[new], (rows[new][:, 3] >> 44) % PARTS
            # words of 16 bits hold so many pages; HELD keeps counts below that for all but a few
            again = np.repeat(np.arange(len(n)), -(-n // 65_535))
            first = np.concatenate([[True], again[1:] != again[:-1]])
            words = rows[again, 3] << 16 | np.where(first, n[again] - 65_535 * (-(-n[again] // 65_535) - 1), 65_535)
            head = np.column_stack([rows[again, :3], part[again]])
            starts = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]).any(axis=1)]))
            names, head = list(hosts), head[starts]
            blobs = [x.tobytes() for x in np.split(words.astype("<i8"), starts[1:])]
            path = [paths[h, k] for h, k in head[:, :2].tolist()]
            arrays = [pa.array([names[h] for h in head[:, 0]], pa.string()), pa.array(head[:, 1]), pa.array(head[:, 2].astype(np.int32)), pa.array(head[:, 3].astype(np.int32)), pa.array(path, pa.list_(pa.int64())), pa.array(blobs, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["host", "node", "kind", "part", "path", "counts"])

        for batch in batches:
            for host, source in zip(column(batch, "host").to_pylist(), column(batch, "html")):
                page = parse(source.as_py() or "")
                h = hosts.setdefault(host, len(hosts))
                for node, kind, found in node_features(page, words_of):
                    if node:
                        if (h, node) not in paths:
                            paths[h, node] = page.path(node)
                        heads.append((h, node, kind))
                        sizes.append(len(found))
                        held += found
                if len(held) >= HELD:
                    yield made()
                    hosts, paths, heads, sizes, held = {}, {}, [], [], []
        if held:
            yield made()

    return pages.select("host", "html").mapInArrow(of, "host string, node long, kind int, part int, path array<long>, counts binary")


def feature_sums(rows: DataFrame) -> DataFrame:
    """host, node, kind, path and the sums of n log n, n, log n and 1 over the features of style_rows; n is on how many pages a feature was."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path, held = None, None, []

        def made() -> pa.RecordBatch:
            words = np.concatenate(held).view(np.uint64)
            words.sort()
            feature = words >> np.uint64(16)
            starts = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]]))
            n = np.add.reduceat((words & np.uint64(65_535)).astype(np.float64), starts)
            values = [now[0], now[1], now[2], path, float((n * np.log(n)).sum()), float(n.sum()), float(np.log(n).sum()), len(n)]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["host", "node", "kind", "path", *SUMS])

        for batch in batches:
            key = list(zip(*(column(batch, c).to_pylist() for c in ("host", "node", "kind", "part"))))
            for k, this in enumerate(key):
                if this != now:
                    if held:
                        yield made()
                    now, path, held = this, column(batch, "path")[k].as_py(), []
                held.append(np.frombuffer(column(batch, "counts")[k].as_py(), dtype="<i8"))
        if held:
            yield made()

    key = ["host", "node", "kind", "part"]
    parts = rows.repartition(*key).sortWithinPartitions(*key)
    parts = parts.mapInArrow(of, "host string, node long, kind int, path array<long>, nlogn double, total double, logn double, features long")
    return parts.groupBy("host", "node", "kind").agg(F.first("path").alias("path"), *[F.sum(c).alias(c) for c in SUMS])


def low_importance(pages: DataFrame, threshold: float = 0.3, least_pages: int = 4) -> DataFrame:
    """host, low: the nodes of a host's tree whose composite importance is under the threshold.

    Over a host's m pages, a word, link target or image found in a node on n of
    them has entropy log n / log m; a node's content importance is 1 less the
    mean of that over the different features in and below it. Its presentation importance is the entropy, to base m, of the looks of its
    children. With l looks they combine as (1 - gamma^l) of presentation and
    gamma^l of content. Hosts of fewer than least_pages pages have too little
    to tell and give no row.
    """
    sums = materialize(feature_sums(style_rows(pages)), "style-sums")
    below = sums.where(F.col("kind") == TEXT).select("host", F.explode("path").alias("node"), "logn", "features")
    below = below.groupBy("host", "node").agg(F.sum("logn").alias("logn"), F.sum("features").alias("features"))
    looks = sums.where(F.col("kind") == LOOK).withColumnRenamed("features", "l")
    sizes = pages.groupBy("host").agg(F.count("*").alias("m")).where(F.col("m") >= least_pages)
    base = F.log(F.col("m").cast("double"))
    below = below.join(sizes, "host").select("host", "node", "m", (1 - F.col("logn") / base / F.col("features")).alias("content"))
    # -sum p log p = log total - sum n log n / total
    looks = looks.select("host", "node", "l", (F.log("total") - F.col("nlogn") / F.col("total")).alias("spread"))
    both = below.join(looks, ["host", "node"], "left")
    weight = F.pow(F.lit(GAMMA), F.coalesce(F.col("l"), F.lit(0)))
    importance = (1 - weight) * F.coalesce(F.col("spread") / base, F.lit(0.0)) + weight * F.col("content")
    return both.where(importance < threshold).groupBy("host").agg(F.collect_set("node").alias("low"))


def op8_html(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html).

    Null html is empty and gives an empty text. Pages without a host share
    one tree. Repeated rows are pages of their own. Ids and URLs may be null.
    Extra columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    low = materialize(low_importance(rows), "style-low")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows = column(batch, "low")
            texts = [main_text(h.as_py(), frozenset(lows[k].as_py() or ())) for k, h in enumerate(column(batch, "html"))]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(low, "host", "left").select("page_id", "url", "html", "low")
    return joined.mapInArrow(of, "page_id long, url string, text string, n_chars long")
