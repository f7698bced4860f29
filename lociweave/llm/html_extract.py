"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each under the path of block elements from the root.  Text length outside
links and punctuation are aggregated per path, so that a short paragraph is judged with the long ones on its path
and a list of links has next to nothing; the two ratios are smoothed over the sequence and multiplied.  Names of
elements only lower a score.  Paths above a threshold are content; the element that holds their score is the
article, and what lies in it stays unless its own path fails.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from lociweave.llm.common import extended, slices, without

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<more>[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<more2>[^>]*)>""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.IGNORECASE)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Never text of a page: its head, controls and media.
OUTSIDE = frozenset("head button select option svg object applet audio video canvas map math".split()) | RAW
#: Elements whose name lowers the scores in them: much, or a little where the ratios of links decide anyway.
LOWERED = frozenset("header footer aside dialog form".split())
DOUBTED = frozenset("nav menu".split())
#: Whole tokens of class, id or role that lower scores as much; as a part of a token they lower them a little.
CLUTTER = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments feedback comentarios kommentare commentaires complementary consent contentinfo cookie cookies disclaimer discussion disqus dropdown footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond rail search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: What lowers scores as much as a part of a token too, unless another part says that it isn't there or only somewhere inside.
HEAVY = frozenset("ad ads advert adverts advertisement advertising comment comments consent cookie cookies feedback footer gdpr newsletter notice notices popup promo promoted recommended related sidebar sponsor sponsored subscribe subscription".split())
UNLESS = frozenset("no non not has have with without free enabled disabled open closed off layout page content".split())
#: Elements and tokens that are put round whole articles as well: their doubt falls by weight.
WRAPS, WRAP_NAMES = frozenset("modal overlay widget widgets menu navigation topbar search social masthead header".split()), frozenset("form header".split())
MUCH, LITTLE = 0.01, 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Block elements that hold a piece of an article and are never taken for all of it.
PIECES = HEADINGS | frozenset("p li dt dd pre blockquote figcaption figure caption ul ol dl table thead tbody tfoot tr details summary address".split())
_P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}
_SCOPES = frozenset("table ul ol dl body html article section div main select".split())

#: A path is content from this share of the highest score on.
THRESHOLD = 0.3
#: The element that holds this share of the content's score is the article; of one that is marked as such, MARKED is enough.
MASS, MARKED = 0.85, 0.6
#: A path with this share of its text in links is one of links.
LINKS = 0.6
KERNEL = (0.06, 0.24, 0.40, 0.24, 0.06)


@dataclass
class Block:
    text: str
    path: int  # number of the path, the same for all blocks under the same names
    element: int  # number of the innermost block element
    linked: int  # characters inside links


@dataclass
class Page:
    """Blocks in order and block elements by number, which grows in page order and inwards; 0 is the page."""

    blocks: list[Block] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    name: list[str] = field(default_factory=lambda: [""])
    marks: dict[int, str] = field(default_factory=dict)  # elements marked as "article" or "main"
    doubts: dict[int, float] = field(default_factory=dict)  # what the names of an element lower scores to
    wraps: set[int] = field(default_factory=set)  # those of them that may be put round an article

    def last(self) -> list[int]:
        """Of each element the number of the last one inside it."""
        out = list(range(len(self.parent)))
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] = max(out[self.parent[e]], out[e])
        return out

    def sums(self, values: list[float]) -> list[float]:
        """Of each element the values of the blocks in it."""
        out = [0.0] * len(self.parent)
        for b, value in zip(self.blocks, values, strict=True):
            out[b.element] += value
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out


def _attributes(more: str) -> dict[str, str]:
    if not more or not _TELLING.search(more):
        return {}
    return {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(more)}


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")


def _doubt(name: str, tokens: list[str]) -> float:
    if name in ("html", "body", "article", "main"):
        return 1.0
    if name in LOWERED or any(t in CLUTTER for t in tokens):
        return MUCH
    parts = [set(re.split(r"[^a-z]+", t)) for t in tokens]
    if any(p & HEAVY and not p & UNLESS for p in parts):
        return MUCH
    if name in DOUBTED or any(p & CLUTTER for p in parts):
        return LITTLE
    return 1.0


def _wraps(name: str, tokens: list[str], doubt: float) -> bool:
    """Whether nothing but wrappers' names is to be doubted about an element."""
    named = [t for t in tokens if t in CLUTTER]
    return doubt == LITTLE or name not in LOWERED - WRAP_NAMES and all(t in WRAPS for t in named) and (name in WRAP_NAMES or bool(named))


def parse(source: str) -> Page:
    """The visible text blocks of a page and its elements, in one pass over whatever markup there is."""
    page = Page()
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # name, block element, path, outside
    opened: Counter[str] = Counter()
    paths: dict[tuple[int, str], int] = {}
    parts: list[str] = []
    linked, at, end_of_page, last_tag = 0, 0, len(source), source.rfind(">")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.blocks.append(Block(text, stack[-1][2], stack[-1][1], linked))
            parts.clear()
        linked = 0

    def say(start: int, end: int) -> None:
        nonlocal linked
        if end > start and not stack[-1][3]:
            piece = source[start:end]
            parts.append(entities.unescape(piece) if "&" in piece else piece)
            if opened["a"]:
                linked += len(parts[-1].strip())

    def leave(k: int) -> None:
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    while at < end_of_page:
        m = _TAG.search(source, at) if at <= last_tag else None
        if m is None:
            rest = source.find("<!--", at)
            say(at, end_of_page if rest < 0 else rest)
            break
        say(at, m.start())
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        more = m["more"] or m["more2"] or ""
        if m["end"] or m["end2"]:
            if name == "br":
                parts.append(" ")
                continue
            if name not in INLINE:
                flush()
            if opened[name] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        leave(k)
                        break
                    if name in INLINE and stack[k][0] not in INLINE:
                        break
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                parts.append(" ")
            continue
        if name in RAW:
            if not more.endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(source, at)
                at = close.end() if close else end_of_page
            continue
        if name in INLINE:
            if not more.endswith("/"):
                stack.append((name, stack[-1][1], stack[-1][2], stack[-1][3] or _hidden(_attributes(more))))
                opened[name] += 1
            continue
        flush()
        ends = ("p",) if name in _P_ENDERS else _SAME_ENDS.get(name, ())
        if any(opened[x] > 0 for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ends:
                    leave(k)
                    break
                if stack[k][0] in _SCOPES:
                    break
        attributes = _attributes(more)
        tokens = " ".join(attributes.get(x, "") for x in ("class", "id", "role")).split()
        e = len(page.parent)
        page.parent.append(stack[-1][1])
        page.name.append(name)
        if name in ("article", "main") or attributes.get("role") == "main" or "articlebody" in (attributes.get("itemprop"), *tokens):
            page.marks[e] = "article" if name == "article" else "main"
        doubt = _doubt(name, tokens)
        if name == "header" and opened["article"] > 0:
            doubt = LITTLE  # an article's own header has its headline
        if doubt < 1:
            page.doubts[e] = doubt
            if _wraps(name, tokens, doubt):
                page.wraps.add(e)
        path = paths.setdefault((stack[-1][2], name), len(paths) + 1)
        stack.append((name, e, path, stack[-1][3] or name in OUTSIDE or _hidden(attributes)))
        opened[name] += 1
    flush()
    return page


def smoothed(x: list[float]) -> list[float]:
    n, reach = len(x), len(KERNEL) // 2
    out = []
    for i in range(n):
        near = [(w, x[i + d]) for d, w in zip(range(-reach, reach + 1), KERNEL, strict=True) if 0 <= i + d < n]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def path_scores(blocks: list[Block]) -> dict[int, float]:
    """Per path: characters outside links and punctuation per block, each smoothed over the sequence of blocks, multiplied."""
    total: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for b in blocks:
        t = total[b.path]
        t[0] += 1
        t[1] += max(0, len(b.text) - b.linked)
        t[2] += len(_PUNCTUATION.findall(b.text)) if b.linked < len(b.text) else 0
    length = smoothed([math.log1p(total[b.path][1] / total[b.path][0]) for b in blocks])
    points = smoothed([math.log1p(1 + total[b.path][2] / total[b.path][0]) for b in blocks])
    fused: dict[int, list[float]] = defaultdict(list)
    for b, a, c in zip(blocks, length, points, strict=True):
        fused[b.path].append(a * c)
    return {p: sum(v) / len(v) for p, v in fused.items()}


def lowering(page: Page, weights: list[float]) -> list[float]:
    """Of each element the factor of the scores in it: the least doubt of an element around it that stands.

    A doubt falls if the element holds the page's article or main, the one with the highest weight, or most of the
    weight of the page while no article or main elsewhere has any (for a small doubt, has a quarter of it).  That is
    not enough for a footer, a notice or the like, however long, while there is text that is in nothing doubted.
    """
    n, held, last = len(page.parent), page.sums(weights), page.last()
    inside, around, ended, begun = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * (n + 1)
    for e in page.marks:
        inside[e] = begun[e] = held[e]
        ended[last[e]] = max(ended[last[e]], held[e])
    for e in range(n - 1, 0, -1):
        inside[page.parent[e]] = max(inside[page.parent[e]], inside[e])
    for e in range(1, n):
        around[e] = max(around[page.parent[e]], held[page.parent[e]] if page.parent[e] in page.marks else 0.0)
    # nearest: the innermost doubted element around each; open_: the weight of what only doubts around an element lower
    nearest, own, open_ = [0] * n, [0.0] * n, [0.0] * n
    for e in range(1, n):
        nearest[e] = e if e in page.doubts else nearest[page.parent[e]]
    for b, w in zip(page.blocks, weights, strict=True):
        own[nearest[b.element]] += w
    open_[0] = own[0]
    for e in range(1, n):
        open_[e] = open_[page.parent[e]] + (own[e] if e in page.doubts else 0.0)
    before = list(accumulate(ended, max))
    after = list(accumulate(reversed(begun), max))[::-1]
    factor = [1.0] * n
    for e in range(1, n):
        factor[e] = factor[page.parent[e]]
        if e in page.doubts:
            apart = max(before[e - 1], after[last[e] + 1], around[e] - held[e])
            most = 2 * held[e] > held[0] and (apart == 0 if page.doubts[e] == MUCH else 4 * apart < held[0]) and (e in page.wraps or open_[page.parent[e]] == 0)
            if not (inside[e] and inside[e] >= apart) and not most:
                factor[e] = min(factor[e], page.doubts[e])
    return factor


def main_text(source: str | None) -> str:
    """The article's blocks, white space inside them as single blanks, joined by \\n; nothing if there are none."""
    page = parse(source or "")
    seen = page.blocks
    if not seen:
        return ""
    raw = path_scores(seen)
    factor = lowering(page, [raw[b.path] * max(0, len(b.text) - b.linked) for b in seen])
    scores = [raw[b.path] * factor[b.element] for b in seen]
    least = THRESHOLD * max(scores)
    content = [s >= least for s in scores]
    text, links = defaultdict(int), defaultdict(int)
    for b in seen:
        text[b.path] += len(b.text)
        links[b.path] += b.linked
    stays = [c or factor[b.element] == 1 and links[b.path] < LINKS * text[b.path] for b, c in zip(seen, content, strict=True)]
    last = page.last()
    root = _root(page, [s if c else 0.0 for s, c in zip(scores, content, strict=True)])
    if root:
        return "\n".join(b.text for b, s in zip(seen, stays, strict=True) if s and root <= b.element <= last[root])
    paths = {b.path for b, c in zip(seen, content, strict=True) if c}
    parents = {page.parent[b.element] for b, c in zip(seen, content, strict=True) if c}
    return "\n".join(b.text for b, s in zip(seen, stays, strict=True) if s and (b.path in paths or page.parent[b.element] in parents or page.name[b.element] in HEADINGS))


def _root(page: Page, weights: list[float]) -> int:
    """The element that is the article: the innermost with MASS of the weight, or a marked one with MARKED of it; 0 if that is all of the page."""
    held = page.sums(weights)
    marked = [e for e in page.marks if held[e] >= MARKED * held[0]]
    if marked:
        articles = [e for e in marked if page.marks[e] == "article"]
        root = max(articles or marked)
        if not articles or held[root] >= MASS * held[0] or sum(x == "article" for x in page.marks.values()) == 1:
            return root
    return max((e for e, x in enumerate(held) if e and x >= MASS * held[0] and page.name[e] not in PIECES and page.name[e] not in ("html", "body")), default=0)


def with_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text, the main text of the whole html, and n_chars, its code points.

    A null or empty html has an empty text.  Nothing is cut, however long or deep, and time and memory grow with the
    length of a page; rows are never grouped and nothing shuffles, so repeated rows give repeated results.  Columns
    named text or n_chars in pages are replaced, but for the one that html names, which is read first.
    """
    source = "__html"
    while source in pages.columns:
        source += "_"
    kept = without(pages, "text", "n_chars")
    rows = pages.select(*[f"`{c}`" for c in kept.columns], pages[f"`{html}`"].alias(source))
    schema = extended(kept, text="string", n_chars="long")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names)

    return rows.mapInArrow(extract, schema)
