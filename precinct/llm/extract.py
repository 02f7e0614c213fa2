"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a sequence of text blocks, each with the elements that it lies in. A classifier gives every block a cost for either
label: what its elements say (article or menu, by tag, role and words in class and id), its length, its links, its end sign. The costs are
capacities to the two terminals. Edges of smoothness join neighbouring blocks, stronger the fewer elements lie between them
in the document tree, and blocks of one parent that something else separates. The minimum cut, found by maximum flow, is the
labelling of least cost; where several are least, the one that keeps most. Capacities are whole numbers, so results are exact.

What elements say outweighs all edges a block can have; edges decide where elements say nothing.

Null html counts as empty; a page without content has empty text. Text keeps the page's order, has one space for white space
inside a block and an empty line between blocks. Every row is taken by itself: repeated rows, null ids and ties of any
kind give a row each, an empty table gives none. A page must fit in a task's memory.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from precinct.llm.common import ARROW_BYTES, map_batches

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page, or belongs to a control.
SILENT = set("script style title textarea select button datalist noscript template iframe object svg math canvas audio video".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Start tag: (open elements that it ends, elements beyond which it doesn't look).
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
PARAGRAPH, UNCLOSED = {"p"}, {"nav", "header", "footer"}
_SCOPE = {"td", "th", "caption", "table", "button", "object"}

# -- What an element says of what lies in it

AWAY, SOFT, NOTHING, KEEP = -2, -1, 0, 1
KEEP_TAGS, AWAY_TAGS, SOFT_TAGS = {"article", "main"}, {"nav", "footer", "aside", "menu", "dialog", "search"}, {"header", "form", "fieldset"}
KEEP_ROLES, AWAY_ROLES = {"main", "article"}, {"navigation", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "tablist"}
KEEP_WORDS = set("article articlebody story post entry content main maincontent bodytext".split())
HEAD_WORDS = set("header masthead banner topbar".split())
AWAY_WORDS = set(
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar aside ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin share sharing social "
    "related recommended recommendations teaser teasers comment comments commentlist disqus reply replies respond widget widgets pagination pager toolbar search searchform "
    "copyright legal disclaimer skip tags tagcloud".split()
)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LEGAL = re.compile(r"©|\ball rights reserved\b|\bcopyright\b|\bcookies\b|\bsubscribe\b|\bsign up\b|\blog ?in\b", re.I)


def says(tag: str, attrs: dict[str, str | None], outer: int) -> int:
    """What an element and those around it say: AWAY and KEEP hold for all inside, but an article in a form or a header counts."""
    if tag in ("html", "body"):
        return outer
    words = {x.lower() for c in ("class", "id") if c in attrs for x in _WORDS.findall(attrs[c] or "")}
    role = (attrs.get("role") or "").lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()
    if outer == AWAY or tag in AWAY_TAGS or role in AWAY_ROLES or hidden or words & AWAY_WORDS:
        return AWAY
    if tag in KEEP_TAGS or role in KEEP_ROLES or "articleBody" in (attrs.get("itemprop") or ""):
        return KEEP
    if tag in ("form", "fieldset"):
        return SOFT
    if outer != NOTHING:
        return outer
    if tag == "header" or role == "banner" or words & HEAD_WORDS:
        return SOFT
    return KEEP if words & KEEP_WORDS else NOTHING


class Blocks(HTMLParser):
    """blocks: (text, number of the innermost block element, what the elements say, that element's tag, characters in links). Element
    k lies in element parents[k], depths[k] levels deep; number 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int]] = []  # tag, number of the innermost block element, what all of them say
        self.count: Counter[str] = Counter()
        self.blocks: list[tuple[str, int, int, str, int]] = []
        self.tags, self.parents, self.depths = [""], [0], [0]
        self.parts: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                _, inner, said = self.open[-1] if self.open else ("", 0, NOTHING)
                self.blocks.append((text, inner, said, self.tags[inner], self.linked))
            self.parts = []
            self.linked = 0

    def _pop(self, to: int) -> None:
        """Close all open elements from number `to` of the stack on."""
        for tag, *_ in self.open[to:]:
            self.count[tag] -= 1
            self.count["*"] -= tag in SILENT
            if tag in BLOCK:
                self.flush()
        del self.open[to:]

    def _end(self, tags: set[str], beyond: set[str]) -> None:
        if any(self.count[t] for t in tags):
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] in tags:
                    return self._pop(k)
                if self.open[k][0] in beyond:
                    return None

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append("\n")
        if tag in BLOCK:
            self.flush()
            self._end(PARAGRAPH, _SCOPE)
            if tag in ENDS:
                self._end(*ENDS[tag])
            elif tag in HEADINGS:
                self._end(HEADINGS, BLOCK - HEADINGS)
            elif tag in KEEP_TAGS:
                self._end(UNCLOSED, KEEP_TAGS)
        if tag in VOID:
            return
        _, inner, said = self.open[-1] if self.open else ("", 0, NOTHING)
        if attrs or tag in BLOCK:
            said = says(tag, dict(attrs), said)
        if tag in BLOCK:
            self.tags.append(tag)
            self.parents.append(inner)
            self.depths.append(self.depths[inner] + 1)
            inner = len(self.tags) - 1
        self.open.append((tag, inner, said))
        self.count[tag] += 1
        self.count["*"] += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        if self.count[tag]:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    return self._pop(k)
                if tag not in BLOCK and self.open[k][0] in BLOCK:
                    return None

    def handle_data(self, data):
        if not self.count["*"]:
            self.parts.append(data)
            if self.count["a"]:
                self.linked += len(data)


def parsed(html: str) -> Blocks:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser


# -- Costs and edges

#: Cost of the other label by what the elements say, and the most that features add either way. What elements say, less FEATURES, is more than all edges of a block.
SAID = {AWAY: -900, SOFT: -900, KEEP: 900, NOTHING: 0}
FEATURES = 300
NEAR, SAME_PARENT = 240, 60


def cost(text: str, said: int, tag: str, linked: int) -> int:
    """Above 0: cost of calling the block boilerplate; below: of calling it content."""
    z = -110 + 8 * min(len(text.split()), 45) - 350 * min(linked, len(text)) // len(text)
    z += 50 * (text[-1] in ".!?…:;\"'”»)") + 60 * (tag in HEADINGS) - 40 * (tag in ("li", "td", "th", "dt", "dd", "")) - 200 * bool(len(text) < 300 and _LEGAL.search(text))
    return SAID[said] + max(-FEATURES, min(FEATURES, z))


def edges(at: list[int], parents: list[int], depths: list[int]) -> dict[tuple[int, int], int]:
    """(block, later block): capacity, for blocks in the elements `at`. Blocks in page order by the elements between them, blocks of
    one parent by that."""
    out: dict[tuple[int, int], int] = {}
    latest: dict[int, int] = {}
    for k, x in enumerate(at):
        if k:
            a, b, steps = at[k - 1], x, 0
            while a != b and steps <= NEAR:
                if depths[a] >= depths[b]:
                    a = parents[a]
                else:
                    b = parents[b]
                steps += 1
            if c := NEAR // max(2, steps):
                out[k - 1, k] = c
        parent = parents[x]
        if parent in latest and latest[parent] < k - 1:
            out[latest[parent], k] = SAME_PARENT
        latest[parent] = k
    return out


def minimum_cut(costs: list[int], between: dict[tuple[int, int], int]) -> list[bool]:
    """Whether each block is content in the least labelling: costs above 0 are capacities from the source, below to the sink."""
    n = len(costs)
    source, sink = n, n + 1
    head: list[int] = []
    left: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(head))
        head.append(b)
        left.append(there)
        out[b].append(len(head))
        head.append(a)
        left.append(back)

    for k, z in enumerate(costs):
        if z > 0:
            arc(source, k, z, 0)
        elif z < 0:
            arc(k, sink, -z, 0)
    for (a, b), c in between.items():
        arc(a, b, c, c)
    while True:  # a level graph, then a blocking flow in it
        level = {source: 0}
        line = deque([source])
        while line and sink not in level:
            u = line.popleft()
            for e in out[u]:
                if left[e] and head[e] not in level:
                    level[head[e]] = level[u] + 1
                    line.append(head[e])
        if sink not in level:
            break
        at = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                most = min(left[e] for e in path)
                for e in path:
                    left[e] -= most
                    left[e ^ 1] += most
                stop = next(k for k, e in enumerate(path) if not left[e])
                u = head[path[stop] ^ 1]
                del path[stop:]
            while at[u] < len(out[u]):
                e = out[u][at[u]]
                if left[e] and level.get(head[e]) == level[u] + 1:
                    break
                at[u] += 1
            else:
                if not path:
                    break
                u = head[path.pop() ^ 1]
                at[u] += 1
                continue
            path.append(e)
            u = head[e]
    # boilerplate is what can still reach the sink; all else is content
    reaching, line = {sink}, [sink]
    while line:
        u = line.pop()
        for e in out[u]:
            if left[e ^ 1] and head[e] not in reaching:
                reaching.add(head[e])
                line.append(head[e])
    return [k not in reaching for k in range(n)]


def main_blocks(html: str) -> list[str]:
    page = parsed(html)
    costs = [cost(text, said, tag, linked) for text, _, said, tag, linked in page.blocks]
    kept = minimum_cut(costs, edges([b[1] for b in page.blocks], page.parents, page.depths))
    return [b[0] for b, good in zip(page.blocks, kept, strict=True) if good]


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of pages but the html, and `text`, the main text, and `n_chars`, its code points. Columns of these names are
    replaced."""
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(F.struct(F.lit(0).alias("__any"), *[F.col(f"`{c}`") for c in others]).alias("__row"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("text"))
    schema = StructType([rows.schema["__row"], *_parse_datatype_string("text string")])
    made = map_batches(rows, lambda batch: {"__row": batch["__row"], "text": ["\n\n".join(main_blocks(x)) for x in batch["text"].to_pylist()]}, schema)
    return made.select(*[F.col(f"__row.`{c}`").alias(c) for c in others], "text", F.length("text").cast("long").alias("n_chars"))
