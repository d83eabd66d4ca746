"""Main text of HTML pages by tag-path ratios.

A page is read once into text nodes, each with its root-to-leaf path of block elements (tag names with
class and id, as written; inline elements belong to their block's path). For each distinct path the
nodes' text length, punctuation and link text are added up; link text counts a tenth. Two ratios describe a path:
text length to nodes, and punctuation to nodes. The ratios along the page are smoothed over
neighbouring nodes and fused with each other, with the share of link text and with a weight from markup by multiplication;
paths whose fused ratio reaches a share of the page's mean over text are content, and their nodes, short
or long, are the main text. The weight is finite: it divides by BOILER_WEIGHT under elements that hold menus, page headers,
footers, sidebars, notices, adverts, forms or comments, by element, role, class or id; it multiplies by MARK_WEIGHT inside an
element that is marked as the article or main part, and divides by OUTSIDE outside of it, if such elements hold a good part of
the page's text; headings count a little more than what they head. Only code (scripts, styles, the head) is left out before ratios are looked at.

A null or empty page gives an empty text. Character references are decoded, white space inside a
block becomes one space, blocks are joined in page order by an empty line. Malformed markup is read
as browsers do, roughly: unclosed paragraphs and list items end where the next begins. Elements may be nested to any depth,
at a cost in proportion to the page. Equal pages give equal texts, repeated rows and rows without an id are kept; an empty table
gives no rows. Other columns are kept, those named like the results are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from granary.llm.batches import with_columns

FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

#: Fused ratio, as a share of the page's mean, that makes a path content.
SHARE = 0.25
#: Nodes on either side over which ratios are smoothed.
SMOOTH = 1
#: Share of a page's text, outside unwanted parts, that marked elements must hold for their marks to count.
MARKED = 0.3
BOILER_WEIGHT, MARK_WEIGHT, OUTSIDE, HEADING = 64.0, 64.0, 32.0, 4.0
#: What a character of link text counts.
LINK = 0.1

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CODE = frozenset("script style textarea title noscript template iframe noembed noframes head svg canvas audio video object".split())
UNWANTED = frozenset("nav header footer aside form button select option dialog menu input label fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Closing one of these is implied by opening one of those.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Words that name unwanted parts. A class or id counts if its last word is one of them, or its first one is and the last only names a container.
NOUNS = re.compile(
    r"(?:ads?|advert\w*|adbox|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|foot|footer|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay"
    r"|comments?|commentlist|disqus|respond|reply|replies|share|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login|search|widgets?|pager|pagination|paging|copyright|legal|disclaimer|tags|taglist|skiplink|hidden|sr)",
    re.I,
)
CONTAINERS = frozenset("list box block bar wrap wrapper container section area links link items item panel inner body content text form button left right top bottom main only unit slot thread column col".split())
MODIFIERS = frozenset("has no with without is not show hide".split())
HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"(?:^|[\s_-])(?:article-?body|post-?(?:content|body|text)|entry-?(?:content|body|text)|main-?(?:content|text)|story-?(?:body|content)|page-?content|content-?(?:body|main)|article-?(?:content|text))(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip status".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


class _Element:
    """An open element: its name, the number of its path, and what it says about the text inside."""

    __slots__ = ("content", "link", "name", "path", "weight")

    def __init__(self, name: str, path: int, weight: float, content: bool, link: bool) -> None:
        self.name, self.path, self.weight, self.content, self.link = name, path, weight, content, link


def _unwanted(own: str) -> bool:
    """Whether a class or id names an unwanted part."""
    for name in own.split():
        words = [w for w in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if w]
        while len(words) > 1 and words[-1].isdigit():
            words.pop()
        if not words or words[0].lower() in MODIFIERS:
            continue
        joined = "".join(words[-2:])  # side-bar, sign-up, skip-link
        if NOUNS.fullmatch(words[-1]) or NOUNS.fullmatch(joined) or (NOUNS.fullmatch(words[0]) and all(w.lower() in CONTAINERS for w in words[1:])):
            return True
    return False


def _open(name: str, attributes: str, above: _Element, paths: dict[tuple[int, str], int]) -> _Element:
    label, marked = name, name in ("article", "main")
    unwanted = name in UNWANTED and not (name == "header" and above.content)
    if attributes.strip():
        found = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)}
        own = " ".join(filter(None, (found.get("class"), found.get("id"))))
        role = found.get("role", "").lower()
        if own:
            label = f"{name}.{own}"
            if name not in ("html", "body") and not CONTENT.search(own):
                unwanted = unwanted or _unwanted(own) or (not above.content and bool(HEADER.search(own)))
        unwanted = unwanted or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
        marked = marked or role in ("main", "article") or bool(own and CONTENT.search(own)) or found.get("itemprop", "").lower() == "articlebody"
    weight = 0.0 if name in CODE else above.weight
    if unwanted:
        weight /= BOILER_WEIGHT
    if marked and not above.content:
        weight *= MARK_WEIGHT
    path = above.path if name in INLINE else paths.setdefault((above.path, label), len(paths) + 1)
    return _Element(name, path, weight, above.content or marked, above.link or name == "a")


class _Stack:
    """Open elements; where the innermost one of each name stands is known, so that no search walks the whole depth."""

    def __init__(self) -> None:
        self.open = [_Element("", 0, 1.0, False, False)]
        self.where: dict[str, list[int]] = defaultdict(list)
        self.solid = [0]  # places of elements that are not inline

    def push(self, e: _Element) -> None:
        self.where[e.name].append(len(self.open))
        if e.name not in INLINE:
            self.solid.append(len(self.open))
        self.open.append(e)

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names; 0 if there is none."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def close(self, place: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.open) > place:
            e = self.open.pop()
            self.where[e.name].pop()
            if self.solid[-1] == len(self.open):
                self.solid.pop()


def nodes(page: str) -> list[tuple[int, str, _Element]]:
    """(block, text, element) of every text node in page order, references decoded; nodes of one block share its number."""
    paths: dict[tuple[int, str], int] = {}
    stack, out, block, at = _Stack(), [], 0, 0
    end = len(page)
    while at < end:
        found = TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            out.append((block, html.unescape(page[at:stop]), stack.open[-1]))
        if not found:
            break
        at = found.end()
        if found[2] is None:
            if found[0].startswith("<![CDATA["):
                out.append((block, found[0][9:].removesuffix("]]>"), stack.open[-1]))
            continue
        name = found[2].lower()
        if name not in INLINE or name == "br":
            block += name != "br"
            if name == "br":
                out.append((block, " ", stack.open[-1]))
        if found[1]:
            place = stack.last((name,))
            if place and not (name in INLINE or name == "p") or place > stack.last(("article", "main", "section", "td", "table")):
                stack.close(place)
            continue
        if name in VOID or found[3].endswith("/") and name not in RAW | BLOCKS:
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        ending = ENDS.get(name)
        if ending:
            place = stack.last(ending)
            if place > stack.last(("ul", "ol", "dl", "table", "select")):
                stack.close(place)
        elif name in BLOCKS and stack.open[stack.solid[-1]].name == "p":
            stack.close(stack.solid[-1])
        stack.push(_open(name, found[3], stack.open[-1], paths))
    return out


def _smooth(values: list[float]) -> list[float]:
    return [sum(values[max(0, i - SMOOTH) : i + SMOOTH + 1]) / len(values[max(0, i - SMOOTH) : i + SMOOTH + 1]) for i in range(len(values))]


def content_paths(found: list[tuple[int, str, _Element]], share: float = SHARE) -> set[tuple[int, float]]:
    """(path, weight) whose smoothed, fused and weighted ratios reach share of the page's mean over text."""
    length: dict[tuple[int, float], float] = defaultdict(float)
    whole: dict[tuple[int, float], float] = defaultdict(float)
    marks: dict[tuple[int, float], float] = defaultdict(float)
    count: dict[tuple[int, float], int] = defaultdict(int)
    prior: dict[tuple[int, float], float] = {}
    real = []
    marked = plain = 0
    for _, text, e in found:
        text = text.strip()
        if not text or not e.weight:
            continue
        key = (e.path, e.weight)
        real.append(key)
        prior[key] = e.weight * (HEADING if e.name in HEADINGS else 1.0)
        count[key] += 1
        whole[key] += len(text)
        length[key] += len(text) * (LINK if e.link else 1.0)
        marks[key] += 0 if e.link else len(PUNCTUATION.findall(text))
        marked += len(text) * (e.weight >= MARK_WEIGHT)
        plain += len(text) * (e.weight == 1.0)
    if not real:
        return set()
    by_length = _smooth([length[key] / count[key] for key in real])
    by_marks = _smooth([marks[key] / count[key] + 1 for key in real])
    fused: dict[tuple[int, float], float] = defaultdict(float)
    for key, a, b in zip(real, by_length, by_marks, strict=True):
        fused[key] += math.sqrt(a * b) * length[key] / whole[key] / count[key]
    if marked >= MARKED * (marked + plain) and marked:
        prior = {key: p / (OUTSIDE if key[1] == 1.0 else 1.0) for key, p in prior.items()}
    mass = {key: prior[key] * length[key] for key in prior}
    least = share * sum(fused[key] * mass[key] for key in prior) / sum(mass.values())
    return {key for key in prior if fused[key] * prior[key] >= least}


def main_text(page: str | None, share: float = SHARE) -> str:
    """The main text of one page."""
    found = nodes(page or "")
    paths = content_paths(found, share)
    blocks: list[tuple[int, list[str]]] = []
    for block, text, e in found:
        if (e.path, e.weight) not in paths:
            continue
        if blocks and blocks[-1][0] == block:
            blocks[-1][1].append(text)
        else:
            blocks.append((block, [text]))
    lines = (" ".join("".join(parts).split()) for _, parts in blocks)
    return "\n\n".join(line for line in lines if line)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages with text and n_chars."""

    def work(rows: list[str | None]) -> list:
        texts = [main_text(r) for r in rows]
        return [texts, [len(t) for t in texts]]

    return with_columns(pages, html_col, FIELDS, lambda: work, keep)
