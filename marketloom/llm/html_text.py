"""Main text of web pages by site template removal.

Every container element of a page, inside or outside its article, is hashed with all below it, bottom-up in one pass.
Spark counts, per host, on how many different pages each hash occurs (pages of one text count once; inside articles
near copies, told by three minima of their word pairs, do too, so that they keep what they share); subtrees that recur on many pages of their host are
templates and are deleted. Slots whose content rotates are told by the same counts: a kind of element (tag, class, id,
role) is a template slot if enough of its occurrences, over all hosts, are templates. Blocks of running text
(headings, paragraphs, list items, ...) are content even where they recur. What no count can tell, because it differs
on each page by nature (forms, comments, related links, hidden parts, scripts), goes by what elements say of
themselves. Hosts with too few pages to count on are judged by that as well: all marks, and the article if there is one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, stored, table, tidy
from .near_dedup import WordHashes, mixed, shingles

#: A subtree is a template if it occurs on so many different pages of its host, however many the host has.
MIN_PAGES = 3
#: Different pages from which on a host's own counts decide; below, what elements say of themselves.
HOST_PAGES = 30
#: Share of the occurrences of a kind of element that must be templates to make it a template slot, and their least number.
SLOT_SHARE, SLOT_COUNT = 0.25, 30
PAIR = 2
#: Slots, and hosts, are broadcast up to this many (some 100 bytes each), else joined by a shuffle.
BROADCAST_SLOTS = 50_000
#: Multipliers of the three minima that tell copies of a page's text.
MINIMA = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math canvas object textarea select title".split())
#: Elements that aren't main text by their name.
DROPPED = frozenset("nav header footer aside form button dialog menu head".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are hashed as subtrees.
CONTAINERS = frozenset("aside details dialog div dl figure footer form header menu nav ol section table ul".split())
#: Of these the names that say nothing of a slot unless a class, id or role does.
BARE = frozenset("details div dl figure ol section table ul".split())
#: Elements that differ from page to page by nature and are never main text.
NEVER = frozenset("form button dialog head".split()) | RAW
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "body", "html", "legend"}
SCOPES = frozenset("html body article main section div aside nav header footer form table td th blockquote dialog fieldset li dd figure details".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Parts of a class or id that mark an element as something beside the main text.
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead toolbar comment comments disqus reply replies respond "
    "share sharing social related recommended newsletter subscribe subscription signup login paywall pagination pager widget skip".split()
)
#: Of these the parts that mark what differs from page to page by nature.
OWN_MARKS = frozenset("breadcrumb breadcrumbs comment comments disqus reply replies respond share sharing social related recommended login signup pagination pager modal popup overlay".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACES = re.compile(r"\s+")


def marked(tag: str, attrs: str, every: bool = True) -> bool:
    """Whether an element says that it isn't main text; every: by any mark, else by those of what differs from page to page by nature."""
    if tag in (DROPPED if every else NEVER):
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    marks = MARKS if every else OWN_MARKS
    for m in ATTR.finditer(attrs):
        name, raw = m[1].lower(), m[2] or m[3] or m[4] or ""
        value = raw.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in (ROLES if every else ("dialog", "alertdialog", "search", "form")):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and not marks.isdisjoint(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", raw).lower())):
            return True
    return False


def kind_of(tag: str, attrs: str) -> str:
    """Tag, class, id and role of an element; empty if these tell no slot from another."""
    said = {m[1].lower(): " ".join(sorted(set((m[2] or m[3] or m[4] or "").lower().split()))) for m in ATTR.finditer(attrs)} if attrs else {}
    said = {k: v for k, v in said.items() if k in ("class", "id", "role") and v}
    return "" if tag in BARE and not said else "|".join([tag, *(f"{k}={v}" for k, v in sorted(said.items()))])


class Page:
    """One pass over a page: events in order, with the span of each element."""

    def __init__(self, html: str):
        import xxhash

        #: (kind, ...) in page order: ("t", text), ("o", element number), ("c", element number), ("b",)
        self.events: list[tuple] = []
        #: [tag, attrs, first event, past its last event]
        self.elements: list[list] = []
        #: Hash of each element with all below it.
        self.hashes: list[int] = []
        stack: list[int] = []
        open_: dict[str, int] = {}  # open elements by tag
        inside: list = []  # of each open element what has been hashed of it so far
        at, n = 0, len(html)

        def close(depth: int) -> None:
            while len(stack) > depth:
                e = stack.pop()
                self.events.append(("c", e))
                self.elements[e][3] = len(self.events)
                open_[self.elements[e][0]] -= 1
                h = self.hashes[e] = inside.pop().intdigest()
                if inside:
                    inside[-1].update(h.to_bytes(8, "little"))

        def close_open(names: frozenset[str] | set[str], stop: frozenset[str]) -> None:
            for d in range(len(stack) - 1, -1, -1):
                tag = self.elements[stack[d]][0]
                if tag in names:
                    close(d)
                    return
                if tag in stop:
                    return

        while at < n:
            m = TAG.search(html, at)
            if m is None or m.start() > at:
                raw = html[at : m.start() if m else n]
                self.events.append(("t", raw))
                if inside and (words := raw.split()):
                    inside[-1].update(" ".join(words).encode("utf-8", "surrogatepass") + b"\0")
            if m is None:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if not open_.get(tag):
                    continue
                for d in range(len(stack) - 1, -1, -1):
                    if self.elements[stack[d]][0] == tag:
                        close(d)
                        break
                continue
            if tag == "br":
                self.events.append(("t", " "))
                continue
            if tag in CLOSES_P:
                close_open({"p"}, SCOPES)
            if tag in HEADINGS:
                close_open(HEADINGS, SCOPES)
            elif tag == "li":
                close_open({"li"}, frozenset(("ul", "ol", "menu")))
            elif tag in ("dt", "dd"):
                close_open({"dt", "dd"}, frozenset(("dl",)))
            elif tag in ("td", "th"):
                close_open({"td", "th"}, frozenset(("tr", "table")))
            elif tag == "tr":
                close_open({"tr"}, frozenset(("table",)))
            if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
                if tag in BLOCKS:
                    self.events.append(("b",))
                continue
            self.elements.append([tag, m[3], len(self.events), 0])
            self.hashes.append(0)
            open_[tag] = open_.get(tag, 0) + 1
            inside.append(xxhash.xxh64(f"{tag} {' '.join(m[3].split())}\0".encode("utf-8", "surrogatepass")))
            stack.append(len(self.elements) - 1)
            self.events.append(("o", len(self.elements) - 1))
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else n
                close(len(stack) - 1)
        close(0)

    def plain(self, first: int, end: int) -> str:
        return SPACES.sub(" ", "".join(e[1] for e in self.events[first:end] if e[0] == "t")).strip()

    def root(self) -> list[tuple[int, int]]:
        """Event spans of the main text's elements: the articles, else the main element, else all."""
        for name in ("article", "main"):
            spans, skip = [], -1  # elements come in page order, so one mark says what is inside a marked or found one
            for tag, attrs, a, b in self.elements:
                if a < skip:
                    continue
                if tag == name and not marked(tag, attrs):
                    spans.append((a, b))
                    skip = b
                elif marked(tag, attrs):
                    skip = b
            if spans:
                return spans
        return [(0, len(self.events))]

    def subtrees(self) -> Iterator[tuple[int, int, str, bool]]:
        """(element, hash, kind, whether inside an article) of the containers that hold no article or main element."""
        roots = self.root()
        roots = roots if roots != [(0, len(self.events))] else []
        at = 0
        holds = [0]
        for kind, *x in self.events:
            holds.append(holds[-1] + (kind == "o" and self.elements[x[0]][0] in ("article", "main")))
        for i, (tag, attrs, a, b) in enumerate(self.elements):
            if tag in CONTAINERS and holds[b] == holds[a]:
                while at < len(roots) and roots[at][1] <= a:  # both come in page order
                    at += 1
                yield i, self.hashes[i] - 2**63, kind_of(tag, attrs), at < len(roots) and roots[at][0] <= a

    def body(self, trees: list[tuple], known: WordHashes) -> tuple[list[int], list[int]]:
        """What tells pages of different main texts, three times; and what tells those that aren't near copies either: three minima of their word pairs."""
        import xxhash

        text = " ".join(" ".join(e[1] for e in self.events[a:b] if e[0] == "t") for a, b in self.root())
        own = [xxhash.xxh64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass")) - 2**63] * 3
        if not any(inside for *_, inside in trees):
            return own, own
        pairs = shingles(text, known, PAIR)
        with np.errstate(over="ignore"):
            return own, [int(mixed(pairs * np.uint64(k)).min()) - 2**63 if len(pairs) else 0 for k in MINIMA]

    def main_text(self, templates: set[int], slots: set[str], counted: bool) -> str:
        """Blocks of the main text, one a line, without templates, template slots and marked elements; counted: the host's counts decide."""
        import html

        gone = {e for e, h, k, _ in self.subtrees() if h in templates or k in slots} if templates or slots else set()
        out: list[str] = []
        for a, b in [(0, len(self.events))] if counted else self.root():
            block: list[str] = []

            def end_block(block: list[str] = block) -> None:
                if block:
                    s = SPACES.sub(" ", html.unescape("".join(block))).strip()
                    if s:
                        out.append(s)
                    block.clear()

            i = a
            while i < b:
                e = self.events[i]
                if e[0] == "t":
                    block.append(e[1])
                elif e[0] == "b":
                    end_block()
                else:
                    tag, attrs, _, end = self.elements[e[1]]
                    if e[0] == "o" and (i > a or counted) and (e[1] in gone or marked(tag, attrs, not counted)):
                        if tag in BLOCKS:
                            end_block()
                        i = end
                        continue
                    if tag in BLOCKS:
                        end_block()
                i += 1
            end_block()
        return "\n".join(out)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def occurrences(pages: DataFrame) -> DataFrame:
    """page_key, host, b1, b2, b3 (what tells the page from others), subtree, kind: the containers of every page, and one row without for the page itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [], [])
            for k, host, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                page = Page(html)
                trees = list(page.subtrees())
                body = page.body(trees, known)
                for subtree, kind, inside in {(None, None, False), *(x[1:] for x in trees)}:
                    for column, v in zip(rows, (k, host, *body[inside], subtree, kind), strict=True):
                        column.append(v)
            types = (pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["page_key", "host", "b1", "b2", "b3", "subtree", "kind"])

    return pages.select("page_key", "host", "html").mapInArrow(tidy(run), "page_key long, host string, b1 long, b2 long, b3 long, subtree long, kind string")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, host_pages: int = HOST_PAGES) -> DataFrame:
    """page_id, url, text of every page.

    Null or empty html: empty text. Null url: the host without a name. Repeated rows each get a row. Copies of a
    page (ties) count as one page of their host. Html without article or main: all of the body. Unclosed and stray
    tags are repaired as browsers do, broadly; the time is linear in the page, however deep it nests. Empty table:
    no rows. Extra columns, whatever their names, are not looked at and not returned.
    """
    key = F.xxhash64("page_id", "url", "html")
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"host": host_of(F.col("url")), "page_key": key})
    found = stored(occurrences(p), "page-subtrees")
    # Copies of one page are one row before anything is counted; a page's own row has no subtree.
    pages_of = found.groupBy("host", "subtree", "b1", "b2", "b3").agg(F.max("kind").alias("kind"), F.count("*").alias("n"))
    seen = pages_of.groupBy("host", "subtree").agg(F.least(*[F.count_distinct(b) for b in ("b1", "b2", "b3")]).alias("pages"), F.max("kind").alias("kind"), F.sum("n").alias("n"))
    seen = cut(seen)
    counted = seen.filter(F.col("subtree").isNull() & (F.col("pages") >= host_pages)).select(F.col("host").alias("c_host"))
    templates = seen.filter(F.col("subtree").isNotNull() & (F.col("pages") >= min_pages)).select("host", "subtree")
    is_template = (F.col("pages") >= min_pages).cast("long")
    slots = seen.filter("subtree is not null and kind <> ''").join(counted, F.col("host") == F.col("c_host"), "left_semi").groupBy("kind").agg(F.sum(F.col("n") * is_template).alias("t"), F.sum("n").alias("n"))
    slots = cut(slots.filter((F.col("t") >= SLOT_COUNT) & (F.col("t") >= SLOT_SHARE * F.col("n"))).select(F.col("kind").alias("slot")))
    slots = F.broadcast(slots) if slots.count() <= BROADCAST_SLOTS else slots
    few = F.broadcast(cut(counted)) if counted.count() <= BROADCAST_SLOTS else cut(counted)
    # Per page the hashes and kinds that go, and whether its host counts: a page has no more of them than elements.
    own = found.filter("subtree is not null").select("page_key", "host", "subtree", "kind")
    none = F.lit(None)
    by_hash = own.join(cut(templates), ["host", "subtree"]).select("page_key", "subtree", none.cast("string").alias("slot"), none.cast("boolean").alias("counted"))
    by_kind = own.join(slots, F.col("kind") == F.col("slot")).select("page_key", none.cast("long").alias("subtree"), "slot", none.cast("boolean").alias("counted"))
    by_host = found.filter("subtree is null").join(few, F.col("host") == F.col("c_host")).select("page_key", none.cast("long").alias("subtree"), none.cast("string").alias("slot"), F.lit(True).alias("counted"))
    hit = by_hash.unionAll(by_kind).unionAll(by_host).groupBy("page_key").agg(F.collect_set("subtree").alias("templates"), F.collect_set("slot").alias("slots"), F.max("counted").alias("counted"))
    hit = cut(hit)
    free(pages.sparkSession)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Page(html).main_text(set(t or ()), set(k or ()), bool(c)) for html, t, k, c in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    out = p.join(hit, "page_key", "left").select("page_id", "url", "html", "templates", "slots", "counted")
    return out.mapInArrow(tidy(texts), f"page_id {dict(pages.dtypes)['page_id']}, url string, text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
