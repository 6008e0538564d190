"""Main text of web pages by two passes over blocks: rules decide clear blocks, unclear ones follow their neighbours."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm import common

#: Blocks shorter than SHORT signs can't be decided alone; from LONG on, many stop words make a block good.
SHORT, LONG = 70, 200
#: Shares of stop words that suggest and that show running text, and the share of linked signs that shows navigation.
STOPS_LOW, STOPS_HIGH, LINKS = 0.10, 0.18, 0.3
#: Share of linked signs that makes an item of an article's list one of a menu.
MENU = 0.9
#: Share of stop words below which a page's language isn't a listed one.
STOPS_NONE = 0.02
#: A heading belongs to good text that follows within so many signs.
HEADING_REACH = 200

# Frequent function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her his
    how i if in into is it its just like made may me more most my no not now of on one only or other our out over she so
    some such than that the their them then there these they this to two up us was we were what when which who will with
    would you your
    aber alle als also am an auch auf aus bei beim bin bis da damit das dass dem den der des die doch du durch ein eine
    einem einen einer er es für hat hatte ich ihr im in ist ja kann man mehr mit nach nicht noch nur oder schon sein sich
    sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des du elle elles en est et être il ils je la le les leur lui mais même ne nous
    on ont ou où par pas plus pour qu que qui sa sans se ses si son sont sous sur tout un une vous y été
    al algo como con cuando de del desde donde el ella ellos en entre era es esta este esto ha hasta hay la las lo los más
    me mi muy ni no nos o para pero por porque que se ser si sin sobre son su sus también todo un una uno y ya
    che chi con da dal della di è gli ho il le lei lui ma nel non per più sono sua suo tra tutto
    ao com da das do dos ele ela em essa foi isso mas na nas nos não os pela pelo são sem seu sua um uma
    aan dat de die een en er het hij ik is maar met niet nog of om ook op te uit van voor was wat ze zijn
    """.split()
)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre
    search section select summary table tbody td textarea tfoot th thead title tr ul
    """.split()
)
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select annotation annotation-xml".split())
_PLACES = frozenset("nav footer aside dialog menu button fieldset head search".split())
_CONTENT = frozenset(("article", "main"))
# A class, id or role names a part that isn't the article if it consists of such names alone: words that may stand before a
# mark, marks, and words that may follow one. So "cookie-notice" and "site-footer" do, "has-sidebar" and "share-price" don't.
_MARK = r"""ads?|adverts?|advertisements?|advertising|alert|alertdialog|auto-placed|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|
    cookies?|dialog|disqus|footer|gdpr|hidden|login|masthead|menu|menubar|modal|more-(?:articles|from|news|posts|reading|stories)|most-read|nav|navbar|
    navigation|newsletter|notices?|notifications?|pager|pagination|popup|promos?|promotions?|read-next|recommendations?|recommended|related|replies|
    respond|responses?|search|share|sharing|sidebar|signin|signup|social|sponsor|sponsored|sponsors|subscribe|teasers?|toolbar|trending|up-next|widgets?"""
#: Marks of what readers wrote and of other articles, which are never a page's main text.
_REMARK = re.compile(r"\b(?:comments?|disqus|more|most-read|read-next|recommendations?|recommended|related|replies|respond|responses?|teasers?|trending|up-next)\b")
#: Marks that say too little of a part of an article.
_WEAK = frozenset(("widget", "widgets"))
_BEFORE = "article|blog|bottom|desktop|entry|fixed|floating|footer|global|google|header|inline|js|left|main|mobile|page|post|primary|reader|right|secondary|site|sticky|story|sub|the|top|user|wp"
_AFTER = (
    "actions|area|articles?|bar|block|body|bottom|box|buttons?|col|column|container|content|feed|form|group|header|heading|icons?|inner|items?|"
    "info|law|left|links?|list|media|module|outer|overlay|panel|policy|posts?|primary|reply|right|row|secondary|section|settings|slot|stories|text|thread|title|tools|top|unit|wrap|wrapper|[0-9]+"
)
_MARKS = re.compile(rf"(?:(?:{_BEFORE})-+)*(?:{_MARK})(?:-+(?:{_MARK}|{_AFTER}))*", re.VERBOSE)
#: Names of a page's header; inside an article they hold its title.
_HEADERS = re.compile(r"(?:(?:global|main|site|top)-+)?header(?:-+(?:bar|container|inner|wrap|wrapper))?")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|_+")
_WORD = re.compile(r"\w+")

GOOD, NEAR, UNCLEAR, BAD = "good", "near", "unclear", "bad"


class Block:
    """Text between two block tags. place: number of the enclosing article or main element, 0 outside; barred: in a part
    that tags or attributes mark as no article; within: so marked by what lies inside the article; formed: by a form alone;
    remark: in a part of readers' comments or of other articles; listed: in an item of a list."""

    __slots__ = ("barred", "formed", "heading", "label", "linked", "listed", "place", "remark", "text", "within")

    def __init__(self, text: str, linked: int, heading: bool, frame: Frame):
        self.text, self.linked, self.heading = text, linked, heading
        self.place, self.barred, self.within, self.formed, self.listed = frame.place, frame.barred or frame.form, frame.within or frame.form, frame.form and not frame.barred, frame.listed
        self.remark, self.label = frame.remark, UNCLEAR


class Frame(NamedTuple):
    """An open block element and what holds inside it."""

    name: str = ""
    place: int = 0
    barred: bool = False
    within: bool = False
    form: bool = False
    listed: bool = False
    remark: bool = False
    quoted: bool = False


def marked(attributes: str, place: int, element: str = "div") -> tuple[bool, bool]:
    """Whether attributes hide an element or name it as a part that isn't the article, and whether they name it a remark.

    Ids of headings are made from their words, and inside an article those of sections are too; they say nothing.
    """
    heading = element[0] == "h" and element[1:].isdigit()
    bars = remark = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _INVISIBLE.search(value):
            bars = True
        if name == "itemprop" and value.lower() == "comment":
            bars = remark = True
        if name in ("class", "role") or name == "id" and not heading and not (place and element == "section"):
            for token in value.split():
                token = _CAMEL.sub("-", token).strip("-").lower()
                if place and token in _WEAK:
                    continue
                if _MARKS.fullmatch(token) or not place and _HEADERS.fullmatch(token):
                    bars = True
                    remark = remark or _REMARK.search(token) is not None
    return bars, remark


def blocks(html: str) -> list[Block]:
    """The page's blocks in order, with character references decoded and white space made single blanks."""
    found: list[Block] = []
    stack = [Frame()]  # open block elements
    parts: list[str] = []
    linked = links = places = 0
    heading = False

    def close() -> None:
        nonlocal linked, heading
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, min(linked, len(text)), heading, stack[-1]))
        parts.clear()
        linked, heading = 0, False

    def add(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(" ".join(text.split()))

    at = 0
    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in _RAW and not ends and not (name == "math" and stack[-1].place):  # an article's formulas are text
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
            if name in _BLOCK:
                close()
            continue
        if name == "a":
            links = max(0, links - 1) if ends else 1
        if name == "br" or name == "img":
            parts.append(" ")
        if name not in _BLOCK or name == "button" and stack[-1].place and stack[-1].name == "p":  # a button in a sentence
            continue
        close()
        if ends:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), None)
            if depth is not None:
                del stack[depth:]
            links = 0
        elif name not in _VOID:
            if name == "p" or name == "li" or name[0] == "h" and name[1:].isdigit():
                while stack[-1].name in ("p", name) and len(stack) > 1:  # their end tags may be left out
                    stack.pop()
            frame = stack[-1]
            bars = name in _PLACES or name == "header" and not frame.place
            bars = bars and not (name == "footer" and frame.quoted)  # who is quoted
            named = remark = False
            if attributes and name not in ("html", "body"):
                named, remark = marked(attributes, frame.place, name)
            bars, remark = bars or named, frame.remark or remark
            form, quoted = frame.form or name == "form", bool(frame.place) and (frame.quoted or name == "blockquote")
            if name in _CONTENT:
                places += 1
                # what marks the article itself, or lies around it, isn't inside it
                frame = Frame(name, places, frame.barred or bars or form, False, False, False, remark)
            else:
                frame = Frame(name, frame.place, frame.barred or bars, frame.within or bars, form, frame.listed or name == "li", remark, quoted)
            stack.append(frame)
            heading = name[0] == "h" and name[1:].isdigit()
    close()
    return found


def unlisted(found: list[Block]) -> bool:
    """Whether the page as a whole has hardly any stop word, as in a language that isn't listed."""
    words = [w for b in found if not b.barred for w in _WORD.findall(b.text.lower())]
    return sum(w in STOP_WORDS for w in words) < STOPS_NONE * len(words)


def judge(block: Block, foreign: bool = False) -> str:
    """First pass: the label that the block's own length, stop words and links give it; of a foreign page, without stop words.

    Links speak against a block outside articles, and inside them against items of lists that are hardly more than links.
    """
    n = len(block.text)
    if block.barred or block.linked > (LINKS * n if not block.place else MENU * n if block.listed else n):
        return BAD
    if n < SHORT:
        if block.place:
            return UNCLEAR if block.heading or block.listed else NEAR
        return BAD if block.linked else UNCLEAR
    if foreign:
        return GOOD if n > LONG else NEAR
    words = _WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if stops >= STOPS_HIGH:
        return GOOD if n > LONG else NEAR
    if stops >= STOPS_LOW:
        return NEAR
    return UNCLEAR if block.place else BAD  # tables, lists and code of an article have few stop words


def sources(found: list[Block]) -> None:
    """Lists of links inside an article that text of the same article leads up to with a colon or goes on after are text."""
    k = 0
    while k < len(found):
        first, end = found[k], k
        while end < len(found) and found[end].listed and found[end].label == BAD and not found[end].barred and found[end].place == first.place:
            end += 1
        if end > k and first.place:
            before = found[k - 1] if k else None
            after = next((b for b in found[end:] if b.place == first.place and not b.barred and not b.listed and not b.heading), None)
            if before is not None and before.place == first.place and before.text.endswith(":") or after is not None and after.label in (GOOD, NEAR):
                for b in found[k:end]:
                    b.label = GOOD
        k = max(end, k + 1)


def classify(found: list[Block]) -> None:
    """Second pass: undecided blocks take the label of the nearest decided blocks of the same article, or of the page.

    Where both sides agree they set the label. Where they don't, text that is nearly good is good, a heading follows what
    comes after it, and a short block follows the nearer side, the one before if both are as near. Inside an article
    without a decided block, all are good; outside, all are bad.
    """
    foreign = unlisted(found)
    for b in found:
        b.label = judge(b, foreign)
    sources(found)
    groups: dict[int, list[Block]] = {}
    for b in found:
        if not (b.place and b.barred):
            groups.setdefault(b.place, []).append(b)
    for place, own in groups.items():
        first = [b.label for b in own]
        end, starts = 0, []
        for b in own:
            starts.append(end)
            end += len(b.text)
        before: list[int | None] = []
        last = None
        for k, label in enumerate(first):
            before.append(last)
            last = k if label in (GOOD, BAD) else last
        after: list[int | None] = [None] * len(own)
        last = None
        for k in range(len(own) - 1, -1, -1):
            after[k] = last
            last = k if first[k] in (GOOD, BAD) else last
        for k, b in enumerate(own):
            if first[k] in (GOOD, BAD):
                continue
            p, q = before[k], after[k]
            sides = {first[i] for i in (p, q) if i is not None}
            if not sides:
                b.label = GOOD if place or first[k] == NEAR else BAD
            elif len(sides) == 1:
                only = sides.pop()
                b.label = GOOD if first[k] == NEAR and (place or p is None or q is None) else only
                if place and only == BAD and first[k] == UNCLEAR and GOOD not in first:
                    b.label = GOOD  # an article of short blocks and links
            elif first[k] == NEAR:
                b.label = GOOD
            else:
                ahead = starts[q] - starts[k] - len(b.text)
                behind = starts[k] - starts[p] - len(own[p].text)
                if b.heading and first[q] == GOOD and ahead <= HEADING_REACH:
                    b.label = GOOD
                else:
                    b.label = first[p] if behind <= ahead else first[q]


def main_text(html: str) -> str:
    """Good blocks in page order, a line each; empty if there is none.

    A page without a good block is judged again: articles that are barred from outside, or by their own attributes, are taken
    for what they are, then parts that only a form around them bars; but never comments or teasers of other articles.
    """
    found = blocks(html)
    classify(found)
    if not any(b.label == GOOD for b in found):
        articles = [b for b in found if b.place and not b.within and not b.remark]
        for b in articles or [b for b in found if b.formed and not b.remark]:
            b.barred = False
        classify(found)
    return "\n".join(b.text for b in found if b.label == GOOD)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    A null or empty page has an empty text; null ids and urls stay null; repeated rows are each done; an empty table gives
    no rows; further columns are ignored. The whole page is read, of any length. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return common.arrow_map(rows, run, "page_id long, url string, text string, n_chars long")
