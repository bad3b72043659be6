"""Main-text extraction by paths that the pages of a host agree on.

A page is cut into blocks of text, each with the chain of containers around it.
Containers get the length of the text below them that is not in links, the
nearer the more, an article or main element the most. Each page votes for the
generalised path (tags and classes, digits folded; kept as a digest, however
deep) of its best container, or of the article or main element around it. The
votes are summed by host and path in Spark, and a page's text is then taken
from the most voted path of its host that it has. Outside of articles that
container is widened to those around it as long as they add text that is not
mostly links, so an article in several sibling containers is whole; but what is
added, and stands on many of the host's pages in the same words, is a notice, an
advert or the like and left out. Such blocks are counted by host as well. A page
that has none of the paths keeps its own best container, and a page without
containers all its blocks.

Menus, headers and footers of the page, sidebars, notices, adverts, forms,
scripts, styles and reader comments are left out wherever they stand; they are
known by their tags, roles and names: a class or id counts if it is made of such
words and of words for layout alone, so "comment-list" does and "social-history"
does not. Character references are
decoded, white space within a block becomes one space, blocks are trimmed and
joined by one space.

Defined cases: null and empty pages give an empty text. A null or odd url has
the empty host, whose pages vote together. Broken markup is read as browsers
do: tags left open end with their parent, a drawing (svg) left open ends at the
next element of text, a script, style or text field left open takes the rest, an
unfinished tag at the end is dropped. Ties of votes go to the first path in order. Repeated rows are extracted each. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Collection, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reachwell.llm.common import blocks, checkpointed, table

#: Paths of a host that count, and the least share of the first one's votes that another needs.
PATHS, LEAST_SHARE = 3, 0.2
#: Pages of a host, and their least share, on which a block beside the article stands if it isn't part of it.
REPEATED, REPEATED_SHARE = 3, 0.1
#: Bytes of hosts and paths up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_MARKUP = re.compile(r"""<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|[!?][^>]*>|[a-zA-Z/!?][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[a-z]+|\d+")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark math noscript q s samp small span svg template strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("html body div article section main td table tbody tr center blockquote".split())
#: Elements that a start tag of the same set ends, when no container has been opened since.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
#: Left out by tag; a header within an article or main element belongs to it.
LEFT_OUT = frozenset("head nav footer aside form button select option datalist dialog menu object audio video canvas header noscript template svg math".split())
#: Elements of text that end a drawing left open.
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em h1 h2 h3 h4 h5 h6 hr i img li ol p pre s small span strong sub sup table tt u ul var article section main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Left out by a word of class or id: always, or unless a word says that it is the content.
ALWAYS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors comment comments commentlist respond reply replies disqus cookie cookies consent gdpr newsletter subscribe response responses share sharing social related breadcrumb breadcrumbs pagination pager menu nav navbar navigation".split())
UNLESS = frozenset("header footer sidebar side aside rail masthead topbar toolbar notice notices alert banner popup modal overlay promo promotion promoted search login signup widget widgets recommended recommendations disclaimer".split())
CONTENT = frozenset("content main article post entry story body text".split())
#: Words for layout, which say nothing of what an element holds.
LAYOUT = frozenset("area bar block bottom box button buttons col column container count feed form group head icon icons inner item items left link links list main module outer page panel reader readers right row section site slot title top unit user users visitor visitors wrap wrapper zone js".split())


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class Page:
    """A page's blocks (containers around it, text, letters in links) and the containers' paths."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[tuple[int, ...], str, int]] = []
        self.paths: list[str] = []
        self.articles: set[int] = set()
        self.above: list[int] = []
        self._read(html or "")
        self.sums = [[0, 0] for _ in self.paths]  # letters of each container's text, and those in links
        for chain, block, linked in self.blocks:
            for c in chain:
                self.sums[c][0] += len(block)
                self.sums[c][1] += linked

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, container or -1, whether it is left out
        parts: list[str] = []
        linked = links = at = 0

        def text(to: int) -> None:
            nonlocal linked
            if to > at and not (stack and stack[-1][2]):
                parts.append(piece := unescape(html[at:to]))
                if links:
                    linked += len(piece)

        def flush() -> None:
            nonlocal linked
            if parts:
                if block := " ".join("".join(parts).split()):
                    self.blocks.append((tuple(c for _, c, _ in stack if c >= 0), block, linked))
                parts.clear()
            linked = 0

        def close(tags: set[str], until: frozenset[str] = frozenset()) -> None:
            nonlocal links
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in tags:
                    if any(t not in INLINE for t, _, _ in stack[i:]):
                        flush()
                    links = max(0, links - sum(t == "a" for t, _, _ in stack[i:]))
                    del stack[i:]
                    return
                if stack[i][0] in until:
                    return

        while found := _MARKUP.search(html, at):
            text(found.start())
            at = found.end()
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                if tag not in VOID:
                    close({tag}, frozenset() if tag in CONTAINERS or tag in LEFT_OUT else CONTAINERS)
                if tag not in INLINE:
                    flush()
                continue
            if tag in BREAKS and any(t == "svg" for t, _, _ in stack) and not any(t == "foreignobject" for t, _, _ in stack):
                close({"svg"})
            if tag not in INLINE:
                flush()
                if stack and stack[-1][0] == "head" and tag not in VOID | RAW:
                    stack.pop()
                close(ENDS.get(tag, {"p"}), CONTAINERS | {"ul", "ol", "dl", "select"} if tag not in ("tr", "td", "th") else frozenset({"table"}))
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
                continue
            attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(found[3])} if found[3].strip() else {}
            out = bool(stack and stack[-1][2]) or self._left_out(tag, attributes, stack)
            container = -1
            if tag in CONTAINERS and not out:
                container = len(self.paths)
                around = next((c for _, c, _ in reversed(stack) if c >= 0), -1)
                self.above.append(around)
                above = self.paths[around] if around >= 0 else ""
                own = ".".join([tag, *sorted(re.sub(r"\d+", "9", w) for w in attributes.get("class", "").lower().split())[:2]])
                self.paths.append(hashlib.blake2b(f"{above}>{own}".encode("utf-8", "replace"), digest_size=12).hexdigest())
                if tag in ("article", "main"):
                    self.articles.add(container)
            if not found[3].endswith("/") or tag in CONTAINERS:
                stack.append((tag, container, out))
                links += tag == "a"
        text(len(html))
        flush()

    @staticmethod
    def _left_out(tag: str, attributes: dict[str, str], stack: list[tuple[str, int, bool]]) -> bool:
        within = any(t in ("article", "main") for t, _, _ in stack)
        if tag in LEFT_OUT and not (tag == "header" and within):
            return True
        if not attributes or tag in ("html", "body"):
            return False
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in ROLES:
            return True
        if "display:none" in attributes.get("style", "").replace(" ", "").lower():
            return True
        named = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", f"{attributes.get('class') or ''} {attributes.get('id') or ''}").lower()
        names = [set(_TOKEN.findall(name)) for name in named.split()]
        if tag in ("article", "main"):
            return any(words & {"comment", "comments", "ad", "ads", "advert", "sponsored"} for words in names)
        content = any(words & CONTENT for words in names)
        for words in names:
            plain = {w for w in words if not w.isdigit()} - LAYOUT
            if plain & ALWAYS and plain <= ALWAYS | UNLESS | CONTENT or plain & UNLESS and plain <= ALWAYS | UNLESS and not content:
                return True
        return False

    def widened(self, container: int) -> int:
        """The container around this one, as far as it adds text that is not mostly links; an article or main element is not left."""
        while container not in self.articles and (above := self.above[container]) >= 0:
            n, linked = self.sums[above][0] - self.sums[container][0], self.sums[above][1] - self.sums[container][1]
            if n and 2 * linked >= n:
                break
            container = above
        return container

    def best(self) -> tuple[int, float]:
        """The best container, or the article around it, or -1, and its share of the page's scores."""
        scores: dict[int, float] = defaultdict(float)
        for chain, block, linked in self.blocks:
            n = max(0, len(block) - 2 * linked)
            for depth, c in enumerate(reversed(chain[-3:])):
                scores[c] += n * 0.5**depth
            article = next((c for c in chain if c in self.articles), None)
            if article is not None:
                scores[article] += 2 * n
        if not scores:
            return -1, 0.0
        best = max(sorted(scores), key=scores.get)
        share = scores[best] / (sum(scores.values()) or 1)
        wide = self.widened(best)
        return (wide if wide in self.articles else best), share

    def beside(self, container: int) -> set[int]:
        """Digests of the blocks that widening adds to a container."""
        wide = self.widened(container)
        if wide == container or wide in self.articles:
            return set()
        return {digest_of(block) for chain, block, _ in self.blocks if wide in chain and container not in chain}

    def text(self, paths: list[str], repeated: Collection[int] = ()) -> str:
        """The text below the first of the paths that has any, widened, without what is added and ``repeated`` on the host."""
        best = self.best()[0]
        for path in [*paths, self.paths[best] if best >= 0 else ""]:
            named = {c for c, p in enumerate(self.paths) if p == path and self.sums[c][0]}
            if named:
                own, gone = {self.widened(c) for c in named}, set(repeated)
                articles = own & self.articles
                return " ".join(block for chain, block, _ in self.blocks if not own.isdisjoint(chain) and not (gone and named.isdisjoint(chain) and articles.isdisjoint(chain) and digest_of(block) in gone))
        return " ".join(block for _, block, _ in self.blocks)


def digest_of(block: str) -> int:
    """A signed 64-bit digest of a block's text."""
    return int.from_bytes(hashlib.blake2b(block.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def votes(pages: DataFrame) -> DataFrame:
    """What each host's pages agree on: host, paths (most voted first), repeated (digests of blocks beside the article)."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            found: dict[tuple[str, str | None, int | None], list[float]] = defaultdict(lambda: [0.0, 0])
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page, host = Page(html), host_of(url)
                best, share = page.best()
                if best < 0:
                    continue
                for key, v in [((host, page.paths[best], None), share), *(((host, None, d), 0.0) for d in page.beside(best))]:
                    found[key][0] += v
                    found[key][1] += 1
            columns = [pa.array([k[i] for k in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([v[i] for v in found.values()], t) for i, t in enumerate((pa.float64(), pa.int64())))], ["host", "path", "beside", "share", "pages"])

    sums = pages.select("url", "html").mapInArrow(vote, "host string, path string, beside long, share double, pages long")
    sums = checkpointed(sums.groupBy("host", "path", "beside").agg(F.round(F.sum("share"), 6).alias("votes"), F.sum("pages").alias("pages")))
    best = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    top = sums.where("path is not null").withColumn("place", F.row_number().over(best)).withColumn("whole", F.sum("pages").over(Window.partitionBy("host"))).where(F.col("place") <= PATHS)
    ordered = F.array_sort(F.collect_list(F.struct("place", "votes", "path")))
    top = top.groupBy("host").agg(ordered.alias("top"), F.max("whole").alias("whole"))
    often = sums.where(f"beside is not null and pages >= {REPEATED}").join(top.select("host", "whole"), "host").where(F.col("pages") >= REPEATED_SHARE * F.col("whole"))
    often = often.groupBy("host").agg(F.array_sort(F.collect_list("beside")).alias("repeated"))  # each stands on a tenth of the pages
    top = top.select("host", F.expr(f"transform(filter(top, x -> x.votes >= {LEAST_SHARE} * top[0].votes), x -> x.path)").alias("paths"))
    return top.join(often, "host", "left")


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text. ``pages`` has page_id, url and html."""
    hosts = checkpointed(votes(pages))
    of_host = F.octet_length("host") + F.octet_length(F.concat_ws("", "paths")) + 8 * F.coalesce(F.size("repeated"), F.lit(0)) + 64
    size = hosts.agg(F.coalesce(F.sum(of_host), F.lit(0))).head()[0]
    own = pages.select("page_id", "url", "html").withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST.pattern, 1)))
    own = own.join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "html"):
            rows = zip(*(batch.column(c).to_pylist() for c in ("html", "paths", "repeated")), strict=True)
            texts = [Page(h).text(p or [], r or ()) for h, p, r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return own.select("page_id", "url", "html", "paths", "repeated").mapInArrow(take, f"page_id {kind}, url string, text string")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
