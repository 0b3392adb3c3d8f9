"""Main text of web pages by tag-path ratios.

Every text block of a page has the path of tags above it (`html/body/article/p`; a tag
with a class or id that names a page part carries that part: `div@advert`).  Blocks with
one path are judged together:

1. ratio      characters of visible text per block of the path, and punctuation marks
              per block; inline markup (b, a, span ...) is part of its block's text, and
              characters inside links do not count;
2. smooth     both are averaged over neighbouring blocks with a Gaussian, so that a short
              block between long ones is not torn out;
3. fuse       score = smoothed characters x (1 + smoothed punctuation), 0 on paths through
              navigation, adverts, forms, comments and other page parts;
4. threshold  paths over the page's mean score (weighted by block) are content paths.  The
              lowest element that holds most of their score is the article; its blocks on
              paths not ruled out are the main text, in page order.

A path, not a block, is kept or dropped, so short paragraphs stay with long ones.

Words in a class or id rule an element out where they are sure: outside `article`, and inside
it if a whole class or role is a word that names a page part and nothing else (`advert`).
Other words inside the article (`section id="legal-basis"`) only make an element suspect: it
goes if over half of its characters are links, or if it has fewer than `sparse` times the
punctuation marks per character of the article's other text.  Headings and paragraphs are
text, whatever they are named.
Everything happens within one page: one pass over the table, no shuffle.

Edge cases: null or empty html gives an empty text; unclosed tags are closed as browsers
do (a block ends an open paragraph); an unclosed comment or script runs to the end of the
page; a page without tags is one block; repeated rows are each answered; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object")
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption address nav header footer aside form fieldset details summary dialog hr br center "
    "hgroup menu search select option button label head".split()
)
ENDS_P = BLOCK - {"br", "button", "label", "option", "select", "caption", "td", "th", "tr", "thead", "tbody", "tfoot"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

# Elements and class or id words that mark parts of a page beside its article.
PART_TAGS = frozenset("nav footer aside form menu dialog select button fieldset search label input option".split())
PART_WORDS = re.compile(
    r"(?:^|[^a-z])(ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|promoted|banners?|nav|navbar|navigation|menus?|breadcrumbs?"
    r"|sidebars?|side|aside|footers?|foot|masthead|topbar|toolbar|header|comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|notices?"
    r"|notifications?|alerts?|popups?|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|pagination|pager"
    r"|widgets?|skip|print|hidden|copyright|legal|disclaimer)(?![a-z])"
)
# Whole classes that name nothing but such a part, also inside an article.
PART_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsored promo promos promoted banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars masthead topbar toolbar comments commentlist disqus cookies consent gdpr popup popups modal overlay "
    "newsletter subscribe signup login share sharing pagination pager widget widgets skip hidden".split()
)
NAMED_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p".split())
HOLDERS = frozenset(["html", "body", "article", "main"])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARKS = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")


@dataclass
class Element:
    tag: str
    path: str
    out: bool
    parent: "Element | None"
    suspect: bool = False
    score: float = 0.0


@dataclass
class Block:
    element: Element
    text: list[str] = field(default_factory=list)
    link: int = 0


def _opened(tag: str, attributes: str, parent: Element | None) -> Element:
    """A new element; `out` if it, or one above it, is a part beside the article."""
    in_article = parent is not None and "/article" in parent.path
    part, suspect = "", False
    if attributes:
        marks = [(m[0].lower(), re.sub(r"[_\s]+", " ", "".join(m[1:]).lower())) for m in _MARKS.findall(attributes)]
        words = " ".join(value for _, value in marks)
        if words and tag not in HOLDERS | NAMED_TEXT and (found := PART_WORDS.search(words)):
            sure = [w for name, value in marks if name != "id" for w in value.split() if w in PART_CLASSES]
            suspect = in_article and not sure
            part = "" if suspect else sure[0] if in_article else found[1]
        elif _HIDDEN.search(attributes):
            part = "hidden"
        if suspect and _HIDDEN.search(attributes):
            part, suspect = "hidden", False
    out = tag in PART_TAGS or bool(part) or tag == "head" or (tag == "header" and not in_article) or (parent is not None and parent.out)
    return Element(tag, f"{parent.path if parent else ''}/{tag}" + (f"@{part}" if part else ""), out, parent, suspect and not out)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, each with the element it lies in."""
    root = Element("", "", False, None)
    stack, found = [root], []
    block: Block | None = None
    links, at, size = 0, 0, len(page)

    def owner() -> Element:
        return next((e for e in reversed(stack) if e.tag in BLOCK or e.out), root)

    def text(piece: str) -> None:
        nonlocal block
        if not piece:
            return
        if block is None:
            block = Block(owner())
            found.append(block)
        block.text.append(piece)
        if links:
            block.link += len(piece.strip())

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                block = None
                continue
            if not any(e.tag == tag for e in stack):
                continue
            # An inline end tag does not reach over a block that was opened inside.
            while stack[-1].tag != tag:
                stack.pop()
            if stack.pop().tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                block = None
            continue
        if tag in RAW and not m[3].endswith("/"):
            shut = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = shut.end() if shut else size
            continue
        if tag in BLOCK:
            block = None
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    links = sum(e.tag == "a" for e in stack)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in SAME_ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SAME_ENDS[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in STOPS[tag]:
                    break
        if tag in VOID or m[3].endswith("/"):
            continue
        stack.append(_opened(tag, m[3], stack[-1]))
        links += tag == "a"
        if stack[-1].out and not stack[-2].out:
            block = None
    return found


def _smoothed(values: list[float], spread: float) -> list[float]:
    """Gaussian average over neighbours, `spread` blocks wide; the ends use what there is."""
    if len(values) < 2:
        return values
    reach = max(1, math.ceil(2 * spread))
    weights = [math.exp(-0.5 * (d / spread) ** 2) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, w in zip(range(i - reach, i + reach + 1), weights):
            if 0 <= d < len(values):
                total += w * values[d]
                weight += w
        out.append(total / weight)
    return out


def _suspects(element: Element) -> list[Element]:
    """The suspect elements that a block lies in."""
    found, e = [], element
    while e is not None:
        if e.suspect:
            found.append(e)
        e = e.parent
    return found


def _rule_out(blocks: list[Block], texts: list[str], sparse: float) -> None:
    """Marks the blocks of suspect elements that are mostly links or hardly punctuated as out."""
    sums: dict[int, list[int]] = {}
    usual, inside = [0, 0, 0], []
    for b, t in zip(blocks, texts):
        above = _suspects(b.element)
        inside.append(above)
        if not b.element.out:
            for total in [sums.setdefault(id(e), [0, 0, 0]) for e in above] or ([usual] if "/article" in b.element.path else []):
                total[0] += len(t)
                total[1] += b.link
                total[2] += len(_PUNCTUATION.findall(t))
    bad = {e for e, (size, link, marks) in sums.items() if 2 * link > size or marks * usual[0] < sparse * usual[2] * size}
    for b, above in zip(blocks, inside):
        if any(id(e) in bad for e in above):
            b.element = Element(b.element.tag, b.element.path + "@part", True, b.element.parent)


def main_text(page: str | None, spread: float = 1.0, share: float = 0.8, sparse: float = 0.25) -> str:
    """The article of one page.  `share` of the content score must lie below its element."""
    texts, blocks = [], []
    for b in blocks_of(page or ""):
        joined = " ".join(html.unescape("".join(b.text)).split())
        if joined:
            blocks.append(b)
            texts.append(joined)
    if not blocks:
        return ""
    _rule_out(blocks, texts, sparse)
    chars: dict[str, list[float]] = {}
    for b, t in zip(blocks, texts):
        ratio = chars.setdefault(b.element.path, [0, 0, 0])
        ratio[0] += max(0, len(t) - b.link)
        ratio[1] += len(_PUNCTUATION.findall(t))
        ratio[2] += 1
    length = _smoothed([chars[b.element.path][0] / chars[b.element.path][2] for b in blocks], spread)
    marks = _smoothed([chars[b.element.path][1] / chars[b.element.path][2] for b in blocks], spread)
    by_path: dict[str, list[float]] = {}
    for b, x, y in zip(blocks, length, marks):
        by_path.setdefault(b.element.path, []).append(0.0 if b.element.out else x * (1 + y))
    fused = {path: sum(v) / len(v) for path, v in by_path.items()}
    scores = [fused[b.element.path] for b in blocks]
    mean = sum(scores) / len(scores)
    content = [(b, len(t)) for b, t, s in zip(blocks, texts, scores) if s > 0 and s >= mean]
    if not content:
        return ""
    total = 0.0
    for b, n in content:
        total += (weight := fused[b.element.path] * n)
        e = b.element
        while e is not None:
            e.score += weight
            e = e.parent
    top = max(content, key=lambda c: fused[c[0].element.path] * c[1])[0].element
    while top.parent is not None and (top.score < share * total or top.tag not in HOLDERS | {"div", "section", "td", ""}):
        top = top.parent

    def below(e: Element | None) -> bool:
        while e is not None and e is not top:
            e = e.parent
        return e is top

    return "\n".join(t for b, t in zip(blocks, texts) if not b.element.out and below(b.element))


def extract_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text)."""

    @F.pandas_udf("string")
    def extract(htmls: pd.Series) -> pd.Series:
        return htmls.map(main_text, na_action=None)

    return pages.select("page_id", "url", extract(F.col(html_column)).alias("text"))
