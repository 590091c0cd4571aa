"""Extraction of the main text by the consensus of a host's pages.

Each page's containers are scored, and from the best one the article around it is climbed to; its generalised path
(tags, classes without digits) is the page's vote. Spark counts the votes of each host, and every page is extracted again with the path that won there;
a page without such a container falls back on its own best one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

#: Elements without content, elements whose content is not text, elements that start a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas head title".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never part of the article, and words in class, id or role that tell the same.
ASIDE = frozenset("nav header footer aside form menu dialog button select textarea input label fieldset".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|breadcrumbs?|comments?|commentlist|disqus|replies|cookies?|consent|gdpr|copyright|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notices?|alert|popup|modal|overlay|promo\w*|related|share|sharing|social|sidebar|side|skip|sponsor\w*|subscribe|toolbar|widget|complementary|contentinfo)(?:$|[\s_-])", re.I)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(/?)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")
#: A start tag of these ends an open element of the same group.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CONTAINERS = frozenset("article main section div td body html center".split())
#: An element around the best container is its article only if at most this share of its text is links.
LINKED = 0.3


_INLINE = frozenset("p b i em strong span a h1 h2 h3 h4 h5 h6 ul ol li blockquote pre font u small code".split())


class _Node:
    """An element. Sizes of texts are added to the nearest element that counts them, and to parents as elements close."""

    __slots__ = ("article", "bad", "begin", "counts", "end", "fits", "holder", "label", "linked", "links", "name", "own", "parent", "score_base", "text", "whole")

    def __init__(self, name: str, label: str, bad: bool, begin: int, base: float, parent: _Node | None, fits: int):
        self.name, self.label, self.bad, self.begin, self.score_base, self.parent = name, label, bad, begin, base, parent
        self.end, self.text, self.links, self.own, self.whole = -1, 0, 0, 0, 0
        #: how many labels of the wanted path it and those around it are, -1 if they differ
        self.fits = fits
        self.linked = name == "a" or parent is not None and parent.linked
        self.article = name in ("article", "main") or parent is not None and parent.article
        self.counts = self if parent is None or name not in _INLINE else parent.counts
        self.holder = self if self.holds_articles() else parent.holder if parent is not None else None

    def holds_articles(self) -> bool:
        """Whether the element says that it is an article or what articles are in."""
        return self.score_base > 0 and self.name in _CONTAINERS and self.name not in ("html", "body")

    @property
    def path(self) -> str:
        """The labels from the root on; made where it is asked for, so that deep pages need no long strings."""
        labels, x = [], self
        while x is not None and x.parent is not None:
            labels.append(x.label)
            x = x.parent
        return "".join(f"/{label}" for label in reversed(labels))


def parse(page: str, wanted: str | None = None) -> tuple[list[_Node], list[tuple[int, str, bool]]]:
    """The elements in page order, and the pieces: (offset, text or "" for a block's edge, whether it may count).

    Each text and tag takes a time that doesn't grow with the depth of the page. wanted is a path whose elements are
    told by fits.
    """
    target = wanted.split("/")[1:] if wanted else []
    nodes: list[_Node] = [_Node("", "", False, 0, 0.0, None, 0)]
    open_: list[_Node] = [nodes[0]]
    opened: Counter[str] = Counter()
    pieces: list[tuple[int, str, bool]] = []
    at, n = 0, len(page)

    def text(begin: int, end: int) -> None:
        raw = page[begin:end]
        if raw and not raw.isspace():
            top = open_[-1]
            pieces.append((begin, raw, not top.bad))
            if not top.bad:
                size = len(raw)
                top.text += size
                top.links += size if top.linked else 0
                top.counts.own += size
                if top.holder is not None and not top.linked:
                    top.holder.whole += size
        elif raw:
            pieces.append((begin, " ", not open_[-1].bad))

    def close(upto: int, end: int) -> None:
        while len(open_) > upto:
            x = open_.pop()
            x.end = end
            opened[x.name] -= 1
            if x.parent is not None:
                x.parent.text += x.text
                x.parent.links += x.links

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m.start() + 9, m.end() - 3)
            continue
        if m[1]:  # an end tag closes its element and all within; one without a start means nothing but a block's edge
            for k in range(len(open_) - 1, 0, -1) if opened[name] > 0 else ():
                if open_[k].name == name:
                    close(k, m.start())
                    break
                if open_[k].name in ("article", "main", "body") and name in ("p", "b", "i", "span", "a", "li"):
                    break
            if name in BLOCK:
                pieces.append((m.start(), "", True))
            continue
        if name in BLOCK:
            pieces.append((m.start(), "", True))
        if name in VOID:
            continue
        if (name == "p" or name in BLOCK and open_[-1].name == "p") and opened["p"] > 0:  # a paragraph ends where the next block starts
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name == "p":
                    close(k, m.start())
                    break
                if open_[k].name in BLOCK:
                    break
        if any(opened[x] > 0 for x in _ENDS.get(name, ())):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name in _ENDS[name]:
                    close(k, m.start())
                    break
                if open_[k].name in ("ul", "ol", "dl", "table", "tbody", "article", "div", "section"):
                    break
        if m[4] == "/" and name not in BLOCK:
            continue
        marks = {k.lower(): entities.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        said = " ".join(marks.get(k, "") for k in ("class", "id", "role"))
        top = open_[-1]
        bad = top.bad or name in ASIDE or name in SILENT or "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", "").lower() or bool(said.strip() and name not in ("html", "body", "article", "main") and NOISE.search(said))
        if name == "header" and not top.bad and top.article:
            bad = bool(NOISE.search(marks.get("class", "")))  # the heading of the article itself
        classes = ".".join(sorted({_DIGITS.sub("#", c.lower()).replace("/", "#") for c in marks.get("class", "").split()}))
        label = name + (f".{classes}" if classes else "")
        fits = top.fits + 1 if 0 <= top.fits < len(target) and target[top.fits] == label else -1
        node = _Node(name, label, bad, m.start(), 1.5 * (name in ("article", "main")) + 0.6 * bool(GOOD.search(said)), top, fits)
        nodes.append(node)
        open_.append(node)
        opened[name] += 1
        if name in SILENT:  # raw until the end tag
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            close(len(open_) - 1, end.start() if end else n)
            at = end.end() if end else n
    close(0, n)
    return nodes, pieces


def score(node: _Node) -> float:
    """Text that stands directly in the container's paragraphs counts, links count against it. For an element that
    holds articles, text of its parts counts too, unless they hold articles themselves."""
    counted = max(node.own, node.whole)
    if node.bad or not counted:
        return 0.0
    return (counted * (1 + node.score_base)) * (1 - min(1.0, node.links / node.text))


def article_around(node: _Node) -> _Node:
    """The outermost element around node that holds articles, up to the nearest article, as far as links stay few and
    it has more text than what it is around."""
    top, x = node, node
    while x.name != "article" and x.parent is not None:
        x = x.parent
        if x.holds_articles():
            if x.bad or x.links > LINKED * x.text:
                break
            if x.text > top.text:
                top = x
    return top


def best_container(nodes: list[_Node]) -> _Node | None:
    found = [(score(x), -x.begin, x) for x in nodes if x.name in _CONTAINERS or not x.name]
    top = max(found, key=lambda s: s[:2], default=None)
    return article_around(top[2]) if top and top[0] > 0 else None


def vote(page: str) -> tuple[str, float]:
    """The generalised path of the article around the page's best container and the weight of the vote; "" for a page without text."""
    best = best_container(parse(page)[0])
    return (best.path or "/", 1.0) if best else ("", 0.0)


def blocks(pieces: list[tuple[int, str, bool]], begin: int, end: int) -> list[str]:
    out, line = [], []

    def flush() -> None:
        if s := " ".join(entities.unescape("".join(line)).split()):
            out.append(s)
        line.clear()

    for at, raw, good in pieces:
        if begin <= at < end:
            if not raw:
                flush()
            elif good:
                line.append(raw)
    flush()
    return out


def extract(page: str, path: str | None) -> tuple[str, str]:
    """The main text by the host's path, and the path that was taken ("" if the page has no text)."""
    nodes, pieces = parse(page, path if path != "/" else None)
    chosen = [x for x in nodes if x.fits == path.count("/") and not x.bad and x.text] if path and path != "/" else []
    if not chosen:
        own = best_container(nodes)
        chosen = [own] if own else []
    if not chosen:
        return "", ""
    out: list[str] = []
    upto = -1
    for x in chosen:  # several of one path: in page order, none within another
        if x.begin >= upto:
            out += blocks(pieces, x.begin, x.end)
            upto = x.end
    return "\n".join(out), chosen[0].path or "/"


def host(url: Column) -> Column:
    """The host of an address, in small letters without `www.` and port; "" if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))


def host_paths(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes: the path that won at each host; ties go to the first by name.

    A hot host's votes are summed before they are exchanged, one row for each path and task.
    """
    small_batches(pages.sparkSession)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vote(p.as_py() or "")[0] for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["host", "path"])

    cast = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(votes, "host string, path string")
    counted = cast.where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("votes"))
    return counted.groupBy("host").agg(F.min_by(F.struct("path", "votes"), F.struct(-F.col("votes"), "path")).alias("w")).select("host", "w.path", "w.votes")


def extract_main_text(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with text, main_path and n_chars (columns of these names are replaced).

    Null or empty html, and pages whose only text is outside articles, give the empty text. Pages without a host
    vote among themselves. Repeated rows stay.
    """
    out = pages.drop("text", "main_path", "n_chars")
    names = out.columns
    # written, so that its size is known: Spark broadcasts it below its threshold and splits hot hosts beyond
    won = written(host_paths(out, url_col=url_col, html_col=html_col).select(F.struct("host", "path").alias("won")), "host-paths")
    # the caller's columns stay in a struct, so that none of their names can clash
    joined = out.select(F.struct(*names).alias("row"), host(F.col(url_col)).alias("host")).join(won, F.col("host") == F.col("won.host"), "left").select("row.*", F.col("won.path"))
    schema = T.StructType([*out.schema.fields, T.StructField("text", T.StringType()), T.StructField("main_path", T.StringType()), T.StructField("n_chars", T.LongType())])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(p.as_py() or "", w.as_py()) for p, w in zip(batch.column(names.index(html_col)), batch.column(len(names)), strict=True)]
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([len(x[0]) for x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=[*names, "text", "main_path", "n_chars"])

    return joined.mapInArrow(again, schema)
