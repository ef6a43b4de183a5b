"""Main-text extraction by minimum cut.

A page's text falls into blocks at block-level tags. Each block gets a score from a small linear classifier (tags and
names of what it stands in, links, sentence marks), in proportion to its mass, so that a short block can't outvote a
long one; its positive part is the capacity from the source (content),
its negative part that to the sink (boilerplate). Blocks that are neighbours on the page, or in the same container, are
joined by smoothness edges. The maximum flow separates content from boilerplate; content blocks are joined in page order.
Text is content unless something near it says otherwise, so pages without an article element, of short paragraphs, or
within a form are kept; parts of lists and tables follow one another. One-word paragraphs lean to boilerplate by less
than an edge, and take the side of what they stand beside.

A page is read in one pass, in time that grows with its length whatever is left open or nested in it.

Defined cases: a null or empty page, or one without content, gives an empty text; tags that are never closed end with
what holds them or with the page; a script, style or comment that never ends takes the rest of the page; a "<" that
begins no tag, or one that no ">" ends, is text; where a quote in a tag is never closed, the tag ends at its first ">";
repeated rows give equal rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrymill.llm.shared import map_rows

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: What may end a tag: its ">", or the quote that opens a value.
TAG_END = re.compile(r""">|=\s*(["'])""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SENTENCE = re.compile(r"""[.!?…]["'”’)\]]*$""")

#: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select option title head".split())
#: Elements of which an open one ends when the tag begins.
CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form button menu dialog fieldset header".split())
#: Words of class, id and role that name what is not the article, and what is, and words that say nothing beside them.
BOILERPLATE_NAMES = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header masthead topbar toolbar comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register social share sharing related recommended recommendations widget widgets search searchform form pagination pager copyright legal disclaimer skip tags tagcloud trending teaser outbrain taboola contentinfo complementary".split()
)
CONTENT_NAMES = frozenset("article content post entry story body text main prose".split())
PLAIN_NAMES = frozenset("button buttons link links panel group title label icon icons form site page global box list item items wrap wrapper container inner outer slot unit area section block bar row col primary secondary top bottom left right".split())
#: Of an article element, the names that tell it from the main one.
OTHER_ARTICLES = frozenset("ad ads advert advertisement comment comments related reply replies sponsored teaser".split())

#: What says copyright at the beginning of a text, or anywhere in it.
RIGHTS = re.compile(r"^(?:©|\(c\)|copyright\b)|all rights reserved", re.I)

#: The classifier's weights, of a unit of a block's mass, which is the logarithm of its words: text is content unless
#: something says otherwise. NAMED_BAD is of a name that says boilerplate in all its parts, HINTED of one that has such a part.
TEXT, SENTENCES, PARAGRAPH, HEADING, LINKS, OWNED = 0.25, 0.4, 0.3, 0.3, -2.0, -1.5
BOILERPLATE, NAMED_BAD, HINTED, UNSEEN, ARTICLE, NAMED = -2.5, -2.0, -0.75, -20.0, 1.0, 0.5
MOST_MASS = 7.0
#: A paragraph of one or two words says nothing by itself: it leans this little to boilerplate, whatever it stands in.
FEW, LEAN = 2, -0.2
#: Smoothness: neighbours on the page, the next block in the same container, and the next part of a list or table.
ADJACENT, TOGETHER, FOLLOWING = 0.3, 1.5, 4.0
PARTS = frozenset("li dt dd tr td th caption figcaption pre blockquote".split())
#: A form with this share of the page's words out of links is the page, not a part of it.
WHOLE = 0.5


@dataclass(slots=True, eq=False)
class Element:
    tag: str
    parent: Element | None
    names: tuple[str, ...] = ()
    hidden: bool = False
    article: bool = False  # holds an article or main, or is one
    bad: float = 0.0  # cost of the worst boilerplate that it stands in
    inside: bool = False
    named: bool = False
    words: int = 0  # of its blocks, out of links
    whole: bool = False  # a form around the page

    def judge(self) -> None:
        """Sets what the element says of its blocks, from itself and from its parent, which is judged before."""
        above = self.parent
        own = 0.0
        if self.tag not in ("html", "body"):
            own = min((said(n, OTHER_ARTICLES if self.tag in ("article", "main") else BOILERPLATE_NAMES) for n in self.names), default=0.0)
        if self.tag in BOILERPLATE_TAGS and not (self.tag == "header" and above is not None and above.inside):
            own = BOILERPLATE
        if self.whole:
            own = 0.0
        if self.article and self.tag not in ("article", "main"):  # what holds the article isn't boilerplate
            own = 0.0
        if self.hidden:
            own = UNSEEN
        self.bad = min(own, above.bad if above else 0.0)
        self.inside = self.tag in ("article", "main") or (above is not None and above.inside)
        self.named = (above is not None and above.named) or any(not CONTENT_NAMES.isdisjoint(parts(n)) for n in self.names)

    def cost(self) -> float:
        """Of a unit of a block's mass."""
        return self.bad if self.bad <= NAMED_BAD else self.bad + ARTICLE * self.inside + NAMED * self.named


@dataclass(slots=True)
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def parts(name: str) -> list[str]:
    return [p.lower() for p in PART.findall(name)]


def said(name: str, words: frozenset[str]) -> float:
    """The cost of a class or id: full where it begins with a boilerplate word, or has only plain words before it."""
    own = parts(name)
    if words.isdisjoint(own):
        return 0.0
    known = next(p for p in own if p not in PLAIN_NAMES) in words
    return NAMED_BAD if known and all(p in words or p in PLAIN_NAMES or p in CONTENT_NAMES or p.isdigit() for p in own) else HINTED


class Reader:
    """A page and what is known not to come any more in it, so that no search for it is made twice."""

    def __init__(self, page: str):
        self.page, self.quoting = page, True
        self.last = page.rfind(">")
        self.never: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Where what comes next from at on, or -1."""
        if what in self.never:
            return -1
        if (found := self.page.find(what, at)) < 0:
            self.never.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the ">" of a tag is, whose name ends at at; -1 if there is none."""
        if at > self.last:
            return -1
        place = at
        while self.quoting and (found := TAG_END.search(self.page, place)):
            if found[1] is None:
                return found.start()
            closed = self.find(found[1], found.end())
            if closed < 0 or closed > self.last:
                self.quoting = False  # a quote was left open somewhere: from here on quotes don't hide a ">"
            place = closed + 1
        return self.page.find(">", at)

    def close(self, tag: str, at: int) -> int:
        """Behind the end tag that closes a raw element, or -1."""
        if tag in self.never:
            return -1
        found = re.compile(f"</{re.escape(tag)}(?![\\w-])", re.I).search(self.page, at)
        if found is None:
            self.never.add(tag)
            return -1
        return len(self.page) if found.end() > self.last else self.page.find(">", found.end()) + 1

    def tokens(self) -> Iterator[tuple[str, bool, str]]:
        """Text as ("", False, text), and tags as (name, whether it closes, the rest of the tag)."""
        page, at = self.page, 0
        while (begin := self.find("<", at)) >= 0:
            found = TAG.match(page, begin)
            if found is None:
                mark = page[begin + 1 : begin + 2]
                if mark and mark in "!?":
                    yield "", False, page[at:begin]
                    close = next((y for x, y in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(x, begin)), None)
                    end = self.find(close or ">", begin + 2)
                    if end < 0:
                        at = len(page) if close else begin + 2
                    else:
                        at = end + len(close or ">")
                else:
                    yield "", False, page[at : begin + 1]
                    at = begin + 1
                continue
            end = self.tag_end(found.end())
            if end < 0:
                yield "", False, page[at : found.end()]
                at = found.end()
                continue
            yield "", False, page[at:begin]
            at, tag = end + 1, found[1].lower()
            closes, rest = page[begin + 1] == "/", page[found.end() : end]
            yield tag, closes, rest
            if tag in RAW and not closes and not rest.endswith("/"):
                behind = self.close(tag, at)
                at = behind if behind >= 0 else at if tag in ("head", "option", "title") else len(page)
        yield "", False, page[at:]


def parse(page: str) -> list[Block]:
    root = Element("html", None)
    every, open_, count, link, blocks = [root], [root], Counter(), 0, [Block(root)]
    unseen: list[str] = []  # inline elements from a hidden one on

    def cut() -> None:
        unseen.clear()
        if blocks[-1].parts:
            blocks.append(Block(open_[-1]))
        else:
            blocks[-1].element = open_[-1]

    for tag, closes, rest in Reader(page).tokens():
        if not tag:
            if rest and not unseen:
                blocks[-1].parts.append(rest)
                blocks[-1].linked += link * len(rest.strip())
        elif tag in RAW:
            if not closes and tag not in ("svg", "math", "option"):
                cut()
        elif tag in INLINE:
            if tag == "a":
                link = 0 if closes else 1
            elif tag == "img":
                blocks[-1].parts.append(" ")
            if tag not in VOID and not rest.endswith("/"):
                if not closes:
                    if unseen or (rest and HIDDEN.search(rest)):
                        unseen.append(tag)
                elif tag in unseen:
                    while unseen.pop() != tag:
                        pass
        elif tag in VOID:
            cut() if tag == "hr" else blocks[-1].parts.append(" ")
        else:
            link = 0
            if closes:
                while count[tag]:
                    count[(gone := open_.pop()).tag] -= 1
                    if gone.tag == tag:
                        break
            else:
                names: tuple[str, ...] = ()
                if "=" in rest:
                    names = tuple(n for m in NAMES.finditer(rest) for n in (m[1] or m[2] or m[3] or "").split())
                if len(open_) > 1 and tag in CLOSED_BY.get(open_[-1].tag, ()):
                    count[open_.pop().tag] -= 1
                open_.append(Element(tag, open_[-1], names, bool(rest) and HIDDEN.search(rest) is not None))
                every.append(open_[-1])
                count[tag] += 1
                if tag in ("article", "main"):
                    e = open_[-1]
                    while e is not None and not e.article:
                        e.article, e = True, e.parent
            cut()
    kept = []
    for b in blocks:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
        if b.text:
            kept.append(b)
            if not b.linked:
                b.element.words += b.text.count(" ") + 1
    for e in reversed(every):  # parents come before what they hold
        if e.parent is not None:
            e.parent.words += e.words
    for e in every:
        e.whole = e.tag in ("form", "fieldset") and e.words >= WHOLE * root.words
        e.judge()
    return kept


def scores(blocks: list[Block]) -> list[float]:
    """The classifier: positive for content, negative for boilerplate."""
    out, few, few_before = [], [], -2
    for i, b in enumerate(blocks):
        words, tag = b.text.count(" ") + 1, b.element.tag
        unit = TEXT + LINKS * min(1.0, b.linked / len(b.text)) + b.element.cost()
        unit += SENTENCES * (SENTENCE.search(b.text, max(0, len(b.text) - 16)) is not None) + PARAGRAPH * (tag == "p") + HEADING * (tag in HEADINGS)
        unit += OWNED * (words <= 40 and RIGHTS.search(b.text[:400]) is not None)
        if unit > 0 and words <= FEW and tag not in PARTS and tag not in HEADINGS:
            few.append(i)
        out.append(float(unit * min(np.log2(words + 1), MOST_MASS)))
    if sum(s > 0 for s in out) > len(few):  # beside longer content; alone, they are the page
        for i in few:  # a run of them as a whole leans as one does
            out[i] = 0.0 if few_before == i - 1 else LEAN
            few_before = i
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges, last = [(i, i + 1, ADJACENT) for i in range(len(blocks) - 1)], {}
    for i, b in enumerate(blocks):
        holder = b.element.parent or b.element
        if holder in last:
            edges.append((last[holder], i, FOLLOWING if b.element.tag in PARTS else TOGETHER))
        last[holder] = i
    return edges


def minimum_cut(capacity: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: capacity is to the source if positive, else to the sink; edges go both ways.

    A node whose terminal capacity exceeds all its edges is on that side in every minimum cut; it is settled first, and
    its edges become terminal capacities of its neighbours. The maximum flow, by shortest paths found a level at a time
    (Dinic), decides about the rest.
    """
    n = len(capacity)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    own, side = list(capacity), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(own[i]) > sum(near[i].values()):
            side[i] = own[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                own[j] += w if side[i] else -w
                todo.append(j)
            near[i] = {}
    rest = [i for i in range(n) if side[i] is None]
    flow = {i: dict(near[i]) for i in rest}  # residual capacities
    source, sink, tiny = {i: max(own[i], 0.0) for i in rest}, {i: max(-own[i], 0.0) for i in rest}, 1e-9
    while True:
        level = {i: 0 for i in rest if source[i] > tiny}
        queue, found = deque(level), False
        while queue:
            i = queue.popleft()
            found = found or sink[i] > tiny
            for j, w in flow[i].items():
                if w > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not found:
            return [bool(s) if s is not None else i in level for i, s in enumerate(side)]
        onward = {i: iter(list(flow[i])) for i in level}
        for first in [i for i in level if level[i] == 0]:
            path = [first]
            while path and source[first] > tiny:
                i = path[-1]
                if sink[i] > tiny:
                    steps = list(zip(path, path[1:], strict=False))
                    push = min(source[first], sink[i], *(flow[a][b] for a, b in steps))
                    source[first] -= push
                    sink[i] -= push
                    for a, b in steps:
                        flow[a][b] -= push
                        flow[b][a] += push
                    full = next((k for k, (a, b) in enumerate(steps) if flow[a][b] <= tiny), None)
                    if full is not None:
                        del path[full + 1 :]
                    continue
                j = next((j for j in onward[i] if flow[i][j] > tiny and level.get(j) == level[i] + 1), None)
                if j is None:
                    path.pop()
                else:
                    path.append(j)


def main_text(page: str | None) -> str:
    blocks = parse(page or "")
    kept = minimum_cut(scores(blocks), edges_of(blocks))
    return " ".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """row (pages' columns) and main_text of every page."""

    def judge(texts: pa.Array) -> dict[str, pa.Array]:
        return {"main_text": pa.array([main_text(t) for t in texts.to_pylist()], pa.string())}

    return map_rows(pages, page, judge, "main_text string")
