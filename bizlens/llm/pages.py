"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Pass one decides blocks by link density, stop-word
density and length, and by the section they stand in (menus, headers, footers, sidebars, notices,
adverts, forms and comments are never text; inside an article only a high link density decides
against a block). Short blocks and blocks with middling stop-word density stay open. Pass two gives
an open block the label of its nearest decided neighbours in the same section.

Defined results: a null or empty page gives the empty text; an unclosed comment, script or tag
takes the rest of the page, as in a browser; repeated rows and null ids give rows like any other.
The rules look at one page at a time, so there is no shuffle and no state between rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from bizlens.llm.common import small_batches, table

# Tag names of HTML, words of class names, and function words of four languages.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl "
    "dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead title "
    "tr ul".split()
)
DROPPED_TAGS = frozenset(
    "script style template noscript iframe object embed applet svg math canvas audio video select "
    "textarea button title".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
ASIDE_TAGS = frozenset("nav footer aside form menu dialog head".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adblock banner breadcrumb breadcrumbs "
    "comment comments commentlist consent cookie cookies copyright disqus footer form gdpr header "
    "legal login masthead menu modal nav navbar navigation newsletter notice notification overlay "
    "pager pagination popup promo promotion promoted recommended related reply replies respond "
    "search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar "
    "topbar widget".split()
)
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have he in is it its not of on or she that the their "
    "there they this to was we were which will with you had but his her been who all one would "
    "der die das und ist nicht ein eine einer eines dem den des im in mit zu von auf für sich als "
    "auch es an werden aus er hat dass sie nach wird bei noch wie einem über so zum war haben nur "
    "oder aber vor zur bis mehr durch man sein wurde "
    "le la les de des du un une et est en que qui dans pour pas sur au aux par plus ne se ce il "
    "elle ils avec son sa ses mais ou où comme été nous vous leur sont cette "
    "el los las del y que en un una por con para es se no lo su al más como pero sus le ya o este "
    "sí porque esta entre cuando muy sin sobre también me hasta hay donde".split()
)
SHORT, LONG = 70, 200
LOW, HIGH = 0.10, 0.20
LINKS = 0.5

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARK = re.compile("[>\"']")
STRAY = re.compile(r"</?[a-zA-Z][^<>]*>?")  # tags whose quotes do not close
LABELS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
PARTS = re.compile(r"[a-z]+")


@dataclass
class Section:
    """An open element: what it is, and whether its blocks can be text."""

    tag: str
    aside: bool
    article: int


@dataclass
class Block:
    section: Section
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: str = ""


def is_aside(tag: str, attributes: str, above: Section) -> bool:
    if tag in ASIDE_TAGS or (tag == "header" and not above.article):
        return True
    if "=" not in attributes or tag in ("body", "html"):
        return False
    words = {
        w for m in LABELS.finditer(attributes) for w in PARTS.findall((m[1] or m[2] or m[3] or "").lower())
    }
    return bool(words & ASIDE_WORDS)


class Scanner:
    """The markup of a page, one item at a time, in linear time whatever is left open."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.dead: set[int] = set()  # places outside quotes from which no tag ends
        self.ahead: dict[str, tuple[int, int]] = {}  # what was looked for last: from where, and where it is

    def next(self, what: str, at: int) -> int:
        """The next ``what`` from ``at`` on, or the page's size; "any" is an end or a quote. The last
        answer holds for every place up to it."""
        start, found = self.ahead.get(what, (0, -1))
        if not start <= at <= found:
            if what == "any":
                m = MARK.search(self.page, at)
                found = m.start() if m else len(self.page)
            else:
                found = self.page.find(what, at)
                found = len(self.page) if found < 0 else found
            self.ahead[what] = at, found
        return found

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, quotes skipped; -1 if there is none."""
        passed = []
        while at not in self.dead:
            passed.append(at)
            mark = self.next("any", at)
            if mark == len(self.page):
                break
            if self.page[mark] == ">":
                return mark
            close = self.next(self.page[mark], mark + 1)
            if close == len(self.page):
                break
            at = close + 1
        self.dead.update(passed)
        return -1

    def items(self) -> Iterator[tuple[str, str | None, str, bool]]:
        """(text before, tag, attributes, whether it closes); without a tag for comments and the end."""
        page, size, at = self.page, len(self.page), 0
        while at < size:
            self.at = size
            open_ = page.find("<", at)
            while open_ >= 0:
                follow = page[open_ + 1 : open_ + 2]
                name = None
                if page.startswith("<!--", open_):
                    end = page.find("-->", open_ + 4)
                    self.at = size if end < 0 else end + 3
                    break
                if follow in ("!", "?"):
                    end = page.find(">", open_)
                    self.at = size if end < 0 else end + 1
                    break
                name = NAME.match(page, open_)
                end = self.tag_end(name.end()) if name else -1
                if end >= 0:
                    self.at = end + 1
                    break
                open_ = page.find("<", open_ + 1)
            if open_ < 0:
                yield page[at:], None, "", False
                return
            lead = page[at:open_]
            if name is None:
                yield lead, None, "", False
            else:
                yield lead, name[1].lower(), page[name.end() : self.at - 1], page[open_ + 1] == "/"
            at = self.at


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order; markup that is not closed takes the rest of the page."""
    stack = [Section("", False, 0)]
    open_tags: Counter[str] = Counter()
    found = [Block(stack[-1])]
    links = articles = 0
    scanner = Scanner(page)

    def put(text: str) -> None:
        if "<" in text:
            text = STRAY.sub(" ", text)
        if text:
            found[-1].pieces.append(text)
            if links:
                found[-1].linked += len("".join(text.split()))

    for lead, tag, attributes, closing in scanner.items():
        put(lead)
        if tag is None:
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag == "br":
            put(" ")
            continue
        if not closing and tag in DROPPED_TAGS:
            if tag != "embed" and not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, scanner.at)
                scanner.at = end.end() if end else len(page)
            put(" ")
            continue
        if tag not in BLOCK_TAGS:
            continue
        if closing:
            if open_tags[tag]:
                while True:
                    last = stack.pop().tag
                    open_tags[last] -= 1
                    if last == tag:
                        break
        elif tag not in VOID_TAGS:
            above = stack[-1]
            own = is_aside(tag, attributes, above)
            article = above.article
            if tag in ("article", "main") and not above.article and not own and not above.aside:
                articles += 1
                article = articles
            stack.append(Section(tag, own or above.aside, article))
            open_tags[tag] += 1
        links = 0
        found.append(Block(stack[-1]))
    for block in found:
        block.text = " ".join(unescape("".join(block.pieces)).split())
    return [b for b in found if b.text]


def first_pass(block: Block) -> str:
    """good, bad, near (probably good) or short."""
    if block.section.aside:
        return "bad"
    size = len(block.text)
    if block.linked > LINKS * len(block.text.replace(" ", "")):
        return "bad"
    if not block.section.article and ("\xa9" in block.text or "|" in block.text and size < SHORT):
        return "bad"
    words = [w.strip(".,;:!?()\"'").lower() for w in block.text.split()]
    density = sum(w in STOP_WORDS for w in words) / len(words)
    if size < SHORT:
        return "bad" if block.linked and not block.section.article else "short"
    if density >= HIGH:
        return "good" if size > LONG else "near"
    if density >= LOW or block.section.article:
        return "near"
    return "bad"


def second_pass(blocks: list[Block]) -> None:
    """Open blocks take the label of the nearest decided block of their section; with different
    neighbours equally near, or none, a block is text inside an article and near good prose."""
    labels = [b.label for b in blocks]
    sides_of = []
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        near: dict[int, int] = {}
        side: list[int | None] = [None] * len(blocks)
        for i in order:
            section = blocks[i].section
            side[i] = near.get(section.article)
            if labels[i] in ("good", "bad") and not section.aside:
                near[section.article] = i
        sides_of.append(side)
    for i, block in enumerate(blocks):
        if labels[i] in ("good", "bad"):
            continue
        back, ahead = sides_of[0][i], sides_of[1][i]
        sides = {j: labels[j] for j in (back, ahead) if j is not None}
        inclined = "good" if block.section.article or labels[i] == "near" else "bad"
        if len(set(sides.values())) == 1:
            block.label = next(iter(sides.values()))
        elif sides and i - back != ahead - i and labels[i] == "short":
            block.label = labels[back] if i - back < ahead - i else labels[ahead]
        else:
            block.label = inclined
        if block.section.article and block.label == "bad" and not block.linked:
            block.label = "good"


def main_text(page: str | None) -> str:
    """The text blocks of a page, joined by line feeds."""
    blocks = blocks_of(page or "")
    articles = {b.section.article for b in blocks if b.section.article and not b.section.aside}
    if articles:  # what stands outside the article is not its text
        blocks = [b for b in blocks if b.section.article]
    for block in blocks:
        block.label = first_pass(block)
    second_pass(blocks)
    return "\n".join(b.text for b in blocks if b.label == "good")


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {
                "page_id": batch.column("page_id").cast(pa.int64()),
                "url": batch.column("url").cast(pa.string()),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            }
        )


def extract(pages: DataFrame) -> DataFrame:
    small_batches(pages.sparkSession)
    part = pages.select("page_id", "url", "html")
    return part.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))
