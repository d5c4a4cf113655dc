"""Main text of web pages by site template removal.

Every page is read into a tree of block elements and runs of text with a hash of each subtree. Spark counts, per
host, on how many different pages a subtree occurs in its place, and what share of all subtrees in that place
recur. A subtree goes when it stands on half of the host's pages, or when it recurs and so does most of what
stands in its place: menus and adverts that rotate go, a paragraph that a few articles share stays. What the
markup itself says is no text to read goes too; marks in class names only count on what is small beside the rest.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import read, small_batches, written

#: A subtree recurs when it is on so many different pages of its host.
MIN_PAGES = 4
#: Shares beyond which a subtree is template: of the host's pages, and of the recurring subtrees of its place.
PAGE_SHARE = 0.5
PLACE_SHARE = 0.5
#: A template table of at most so many rows (16 bytes each) is broadcast; a larger one is joined in as many copies, so that
#: the template of a very large host is spread over as many tasks.
BROADCAST_ROWS = 200_000
SALTS = 16

# Names of HTML elements by their part in a page, and words of class and id that often mark what is not main text.
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("audio button canvas datalist iframe noframes noscript object option script select style svg template textarea title video".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
NEVER_MAIN = set("aside dialog footer form menu nav search".split())
MAIN = set("article main".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
MARKS = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
UNMARKED_BY = set("article body content disabled enabled entry has hide main no not page post text with without".split())
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
SCOPES = ("table", "td", "th", "caption")
P_UNTIL = ("button", "table", "td", "th", "caption")

SIMPLE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>\"']*+)>")
TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
ATTRIBUTE = re.compile(r"[\s/]*+(=?[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")
UNCLOSED = re.compile(r"[\s/]*+=?[^\s/>=]*+\s*+=\s*+[\"']")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}
PIECES = re.compile(r"[a-z]+")


def attributes(text: str, at: int, end: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on, the first of a name, and the place behind the tag's >; -1 where the page ends within the tag."""
    found: dict[str, str] = {}
    while at < end:
        if text[at] == ">":
            return found, at + 1
        m = ATTRIBUTE.match(text, at, end)
        name, *values = m.groups()
        if not any(v is not None for v in values) and UNCLOSED.match(text, at, end):
            return found, -1  # the quote is never closed
        if name:
            found.setdefault(name.lower(), entities.unescape(next((v for v in values if v is not None), "")))
        at = m.end() if m.end() > at else at + 1
    return found, -1


def marked(names: str) -> bool:
    """Whether a class or id is a mark: a word of the list alone, or at either end of a compound without one that turns its sense."""
    for name in names.lower().split():
        pieces = PIECES.findall(name)
        if pieces and (pieces[0] in MARKS or pieces[-1] in MARKS) and UNMARKED_BY.isdisjoint(pieces):
            return True
    return False


class Page:
    """Blocks (text, node) in page order, and of every node its parent, its place (a hash of the path of names,
    classes and ids) and the hash of its subtree in that place; 0 where the subtree around it says the same.

    Nodes are block elements and, where an element holds more than one part, runs of text; a node has a lower
    number than what it holds. ``never`` are nodes that by the markup are no main text, ``weak`` those with a mark
    in class or id, ``nested`` articles within an article, which are comments by the standard, ``main`` all articles. Markup is read as the HTML standard
    says, in one pass: bogus comments, unclosed quotes and open elements end with the page, nothing is an error."""

    def __init__(self, html: str):
        self.parents, self.places, self.hashes, self.blocks = [], [], [], []
        self.never, self.weak, self.nested, self.main = set(), set(), set(), set()
        self.buffer: list[str] = []
        self.stack: list[list] = []  # [tag, node, parts, runs of text, last child element]
        self.open: dict[str, list[int]] = {}  # of each name its places in the stack
        self._open("#page", {})
        self._read(html)
        while self.stack:
            self._close()

    def _read(self, text: str) -> None:
        at, end, skipped, inside = 0, len(text), [], Counter()  # skipped: open elements whose content is not seen
        while at < end:
            start = text.find("<", at)
            if start < 0:
                start = end
            if start > at and not skipped:
                part = text[at:start]
                self.buffer.append(entities.unescape(part) if "&" in part else part)
            if start >= end - 1:
                if start == end - 1 and not skipped:
                    self.buffer.append("<")
                return
            c = text[start + 1]
            m = SIMPLE_TAG.match(text, start)
            if m:
                slash, tag, rest = m.groups()
                at, tag = m.end(), tag.lower()
                told = None
            elif (m := TAG_NAME.match(text, start)) is not None:
                slash, tag = m.group(1), m.group(2).lower()
                told, at = attributes(text, m.end(), end)
                if at < 0:
                    return
                rest = ""
            elif c == "!" and text.startswith("--", start + 2):
                if text.startswith((">", "->"), start + 4):
                    at = text.find(">", start + 4) + 1
                    continue
                found = COMMENT_END.search(text, start + 4)
                if not found:
                    return
                at = found.end()
                continue
            elif c in "!?" or (c == "/" and start + 2 < end):
                at = text.find(">", start + 2) + 1
                if not at:
                    return
                continue
            else:
                if not skipped:
                    self.buffer.append("<")
                at = start + 1
                continue
            if skipped:
                if slash and inside[tag]:
                    while (last := skipped.pop()) != tag:
                        inside[last] -= 1
                    inside[tag] -= 1
                elif not slash and tag in RAW:
                    at = self._raw(text, tag, at, end)
                elif not slash and tag in UNSEEN:
                    skipped.append(tag)
                    inside[tag] += 1
                continue
            if slash:
                if tag in BLOCKS:
                    self._end(tag)
            elif tag in UNSEEN:
                if tag in RAW:
                    at = self._raw(text, tag, at, end)
                elif not rest.endswith("/") or tag != "svg":
                    skipped.append(tag)
                    inside[tag] += 1
            elif tag in BLOCKS:
                if told is None:
                    told = attributes(rest + ">", 0, len(rest) + 1)[0] if rest and not rest.isspace() else {}
                self._start(tag, told)
            elif tag == "br":
                self.buffer.append(" ")

    def _raw(self, text: str, tag: str, at: int, end: int) -> int:
        """Behind the end tag of an element whose content is no markup."""
        found = RAW_END[tag].search(text, at)
        if not found:
            return end
        return text.find(">", found.end()) + 1 or end

    def _flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            self.buffer.clear()
            if text:
                _, node, parts, runs, _ = self.stack[-1]
                runs.append((len(self.parents), text))
                parts.append(text)
                self.blocks.append((text, len(self.parents)))
                self._node(node, "#text")

    def _node(self, parent: int, name: str) -> int:
        self.parents.append(parent)
        self.places.append(xxhash.xxh64_intdigest(f"{self.places[parent] if parent >= 0 else 0}/{name}"))
        self.hashes.append(0)
        return len(self.parents) - 1

    def _open(self, tag: str, told: dict[str, str]) -> None:
        names = f"{told.get('class', '')} {told.get('id', '')}" if told else ""
        parent = self.stack[-1][1] if self.stack else -1
        node = self._node(parent, tag + "." + re.sub(r"\d+", "", names) if names else tag)
        within = any(map(self.open.get, MAIN))
        if tag in NEVER_MAIN or (tag == "header" and not within) or (told and ("hidden" in told or told.get("role", "").lower() in ROLES)):
            if tag not in ("body", "html"):
                self.never.add(node)
        if tag in MAIN:
            self.main.add(node)
        if tag == "article" and self.open.get("article"):
            self.nested.add(node)
        elif names and tag not in MAIN and tag not in ("body", "html") and marked(names):
            self.weak.add(node)
        if self.stack:
            self.stack[-1][4] = node
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append([tag, node, [], [], -1])

    def _close(self) -> None:
        self._flush()
        tag, node, parts, runs, child = self.stack.pop()
        self.open[tag].pop()
        if not parts:
            return
        digest = xxhash.xxh64_hexdigest(tag + "\x00" + "\x01".join(parts))
        if self.stack:
            self.stack[-1][2].append(digest)
            self.hashes[node] = self._hash(node, digest)
            if len(parts) == 1 and child >= 0:
                self.hashes[child] = 0  # says the same as the element around it
        if len(parts) > 1 or not self.stack:
            for n, text in runs:
                self.hashes[n] = self._hash(n, text)

    def _hash(self, node: int, content: str) -> int:
        return xxhash.xxh64_intdigest(f"{self.places[node]}\x00{content}") >> 1 or 1

    def _last(self, tags) -> int:
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=-1)

    def _close_from(self, place: int) -> None:
        while len(self.stack) > place:
            self._close()

    def _start(self, tag: str, told: dict[str, str]) -> None:
        if tag in ("html", "body") and self.open.get(tag):
            return
        self._flush()
        p = self._last(("p",))
        if p > self._last(P_UNTIL):
            self._close_from(p)
        if tag in CLOSED_BY:
            tags, until = CLOSED_BY[tag]
            if (at := self._last(tags)) > self._last(until):
                first = min(self.open[t][-1] for t in tags if self.open.get(t) and self.open[t][-1] > self._last(until))
                self._close_from(min(at, first))
        if tag not in VOID:
            self._open(tag, told)

    def _end(self, tag: str) -> None:
        at = self._last((tag,))
        if at > 0 and (tag in SCOPES or tag in ("tr", "tbody", "thead", "tfoot", "body", "html") or at > self._last(SCOPES)):
            self._flush()
            self._close_from(at)

    def identity(self) -> int:
        """What tells different pages of a host apart: the longest block outside of what the markup names, so that copies
        of an article with another menu or advert are one page."""
        gone = self._below(self.never)
        longest = max((t for t, n in self.blocks if not gone[n]), key=len, default="")
        return _number(longest)

    def _below(self, roots) -> list[bool]:
        out: list[bool] = []
        for node, up in enumerate(self.parents):
            out.append(node in roots or (up >= 0 and out[up]))
        return out

    def _sizes(self, gone: list[bool]) -> list[int]:
        """Letters of the blocks of each subtree that are not gone."""
        sizes = [0] * len(self.parents)
        for text, node in self.blocks:
            if not gone[node]:
                sizes[node] = len(text)
        for node in range(len(self.parents) - 1, 0, -1):
            sizes[self.parents[node]] += sizes[node]
        return sizes

    def text(self, template: set[int]) -> tuple[str, dict[str, int]]:
        """The main text, and how many blocks went by each rule.

        Template first; then what the markup names; then marked elements that are small: at most half of what is
        left, or beside a marked article outside of them; last what is outside the marked
        articles, if these hold at least half."""
        removed = {}
        gone = [False] * len(self.parents)

        def drop(rule: str, roots) -> None:
            nonlocal gone
            below = self._below(roots)
            removed[rule] = sum(below[n] and not gone[n] for _, n in self.blocks)
            gone = [a or b for a, b in zip(gone, below, strict=True)]

        drop("template", {n for n, h in enumerate(self.hashes) if h in template})
        drop("element", self.never)
        if self.weak or self.nested:
            sizes, marked_by = self._sizes(gone), self._below(self.weak | self.nested)
            anchors = {n for n in self.main if sizes[n] and not marked_by[n]}
            holding = self._above(anchors)
            small = {n for n in self.weak | self.nested if 2 * sizes[n] <= sizes[0]}
            drop("mark", small | {n for n in self.weak if anchors and n not in holding})
        if self.main:
            sizes, inside = self._sizes(gone), self._below(self.main)
            if 2 * sum(len(t) for t, n in self.blocks if inside[n] and not gone[n]) >= sizes[0] > 0:
                drop("outside", {n for _, n in self.blocks if not inside[n]})
        return "\n".join([t for t, n in self.blocks if not gone[n]]), removed

    def _above(self, nodes: set[int]) -> set[int]:
        """The nodes around these."""
        out = {-1}
        for n in nodes:
            while n not in out:
                out.add(n)
                n = self.parents[n]
        return out


PARSED = "key long, host long, body long, places array<long>, hashes array<long>"


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _number(text: str) -> int:
    """Hosts and blocks are counted by a 63-bit hash: rows of numbers shuffle at a third of the bytes."""
    return xxhash.xxh64_intdigest(text) >> 1


def _parse(batches):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for b in batches:
        rows = []
        for key, url, html in zip(*(b.column(c).to_pylist() for c in ("key", "url", "html")), strict=True):
            page = Page(html or "")
            seen = {h: p >> 1 for h, p in zip(page.hashes, page.places, strict=True) if h}
            rows.append((key, _number(host_of(url)), page.identity(), list(seen.values()), list(seen)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["key", "host", "body", "places", "hashes"])


def _assemble(batches):
    for b in batches:
        out = [Page(html or "").text(set(template or ()))[0] for html, template in zip(*(b.column(c).to_pylist() for c in ("html", "template")), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def templates(parsed: DataFrame, min_pages: int = MIN_PAGES, page_share: float = PAGE_SHARE, place_share: float = PLACE_SHARE) -> DataFrame:
    """(host, hash) of the subtrees that are template of their host; pages with the same longest block count once."""
    nodes = parsed.select("host", "body", F.inline(F.arrays_zip(F.col("places").alias("place"), F.col("hashes").alias("hash")))).distinct()
    counts = written(nodes.groupBy("host", "place", "hash").agg(F.count("*").alias("pages")), "subtree-counts")
    recurs = F.col("pages") >= min_pages
    of_place = counts.groupBy("host", "place").agg(F.sum("pages").alias("all"), F.sum(F.when(recurs, F.col("pages"))).alias("recurring")).where("recurring IS NOT NULL")
    of_host = parsed.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("host_pages")).where(F.col("host_pages") >= min_pages)
    judged = counts.where(recurs).join(of_place, ["host", "place"]).join(of_host, "host")
    return judged.where((F.col("recurring") >= place_share * F.col("all")) | (F.col("pages") >= page_share * F.col("host_pages"))).select("host", "hash")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    Null and empty html give an empty text. Pages without a host are one host, the empty one. Repeated rows
    and ids are all kept and extracted alike. An empty table gives no rows. Other columns are not read. Pages
    are read twice, for hashes and for the text: what is written between is numbers, not their trees.
    """
    small_batches(pages.sparkSession, 200)
    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    source = source.withColumn("key", F.xxhash64("page_id", "url", "html"))  # equal for repeated rows, which have one template anyway
    parsed = written(source.mapInArrow(_parse, PARSED), "parsed-pages")
    site = written(templates(parsed), "templates")
    own, keys = parsed.select("key", "host", F.explode("hashes").alias("hash")), ["host", "hash"]
    if site.count() <= BROADCAST_ROWS:
        own = own.join(F.broadcast(site), keys)
    else:
        site = site.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        own = own.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(site, [*keys, "salt"])
    found = own.groupBy("key").agg(F.collect_set("hash").alias("template"))  # at most a page's elements
    # a merge join at every size: what is found grows with the pages and is never broadcast
    out = source.join(written(found, "found").hint("merge"), "key", "left").mapInArrow(_assemble, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page. Null and empty html give an empty text, odd markup is read to its end, repeated rows and ids
    have a row each, null URLs are one host; an empty table gives no rows; other columns are not read."""
    return main_text(read(spark, sf_dir, "pages"))
