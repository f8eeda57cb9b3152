"""HTML extraction by two-pass block rules.

A page is cut into blocks at block-level tags. First pass: a block inside a part that its tag, role or
class names as no article (navigation, header, footer, sidebar, notice, advert, form, comments) is bad; of the others, stop-word
density, length and link density decide: many links are bad, enough stop words or length without links good, short ones and
headings undecided. Second pass: an undecided block takes the label of the nearest decided block, of two equally near ones a heading that of the
later, others the good one; a block of an article element looks at its own article only. Where nothing is decided, the element does, and on a page
without any article the longest run of undecided blocks is it. Scripts without spaces count two signs as a word.

Names are a hint that text can outvote: a part that is bad only by its class or as a form, and that holds nearly all running
text of the page, is the article. A class that only says what a part has (``has-comments``) names nothing, and one that is the article's altogether (``post-content``)
outweighs others that are bad in part (``share-buttons-below``).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most common words of the languages in the corpus.
STOP_WORDS = frozenset(
    "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your "
    "le la les de des du un une et est que qui dans pour pas sur au avec ce il elle ne se plus par son sont mais ou comme "
    "der die das und ist von den dem mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach bei "
    "el los las del y en que es por con para una su al lo como más pero sus o este sí porque entre cuando muy sin sobre".split()
)
#: Blocks shorter than SHORT words are undecided unless links decide; from LONG words on, length alone makes a block good.
SHORT, LONG = 6, 20
LINK_DENSITY, STOP_DENSITY = 0.5, 0.12
#: Scripts without spaces between words, of whose signs some two make a word, and their most common signs.
SPACELESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
STOP_SIGNS = frozenset("のはをにがでとたてもいるすしなれかっ的是了在和有不这我他们也就人都一上說它")
#: A part that only its name makes bad is the article if it holds this share of the page's running text, in so many blocks.
OUTVOTES, OUTVOTING_BLOCKS = 0.8, 2
#: Where nothing is decided, the longest run of undecided blocks is the article if it has so many words.
LONE_RUN = 12

#: Tags that start and end blocks, that hold no text, and that have no end.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
HIDDEN = frozenset("script style noscript template svg math iframe object canvas audio video map select textarea button head title".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Parts that aren't the article: by tag, by ARIA role, and by a word of the class or id.
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead "
    "cookie cookies consent notice alert popup modal overlay newsletter subscribe signup login comment comments respond reply replies disqus "
    "related share sharing social widget toolbar pagination pager search form toc copyright legal disclaimer feedback responses discussion talkback guestbook".split())
#: Of these, those that text can't outvote, and tags of which text may.
FIRM_WORDS = frozenset("comment comments respond reply replies disqus feedback responses talkback footer cookie cookies consent nav navbar navigation menu".split())
SOFT_TAGS = frozenset("form fieldset dialog".split())
#: Words of a class that only tell a state of the part.
STATES = frozenset("has no with without is enabled disabled open closed allow show hide".split())
#: Blocks that only mark an advert.
NOTICES = frozenset("ad ads advert advertisement advertising sponsored anzeige werbung publicité publicidad anuncio".split())
#: How short blocks outside of any article element begin or what they hold that are the page's rights or its word on cookies.
RIGHTS = re.compile(r"^(?:©|\(c\) |copyright (?:©|\(c\)|[0-9]{4}))|\bwe use cookies\b|\bthis (?:web)?site uses cookies\b|\bnous utilisons des cookies\b|\bwir verwenden cookies\b|\butilizamos cookies\b", re.I)
RIGHTS_WORDS = 30
ARTICLE_TAGS = frozenset("article main".split())
ARTICLE_WORDS = frozenset("article content post entry story main".split())
#: What may stand beside these in a name that is the article's altogether.
BESIDE = ARTICLE_WORDS | frozenset("body text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)(?:>|$)", re.S)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SPACE = re.compile(r"\s+")
GOOD, BAD, UNDECIDED = 1, -1, 0
#: Bad by its name only, which text can outvote.
DOUBTFUL = -2


def _part(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element starts a part that isn't the article (BAD, DOUBTFUL), the article (GOOD), or neither."""
    if tag in BAD_TAGS and tag not in SOFT_TAGS or tag == "header" and not inside:
        return BAD
    part = DOUBTFUL if tag in SOFT_TAGS else GOOD if tag in ARTICLE_TAGS else UNDECIDED
    if attributes:
        for m in _NAMES.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return BAD
            if name == "role" and value.lower() in BAD_ROLES:
                return BAD
            if name == "role" and value.lower() in ("main", "article"):
                part = GOOD
            if name in ("class", "id") and tag not in ("body", "html"):
                named = [{w.lower() for w in _PARTS.findall(token)} for token in value.split()]
                # A name that is the article's altogether outweighs names that are bad only in part.
                sure = any(one & ARTICLE_WORDS and one <= BESIDE for one in named)
                words = {w for one in named if not one & STATES and not (sure and one & BAD_WORDS and not one <= BAD_WORDS and not one & FIRM_WORDS) for w in one}
                if part != GOOD and words & BAD_WORDS:
                    if words & FIRM_WORDS:
                        return BAD
                    part = DOUBTFUL
                elif words & ARTICLE_WORDS and part != DOUBTFUL:
                    part = GOOD
    return part


def blocks(page: str) -> Iterator[tuple[str, int, int, int, int]]:
    """The blocks of a page in order: text, characters inside links, the part (BAD, GOOD or UNDECIDED), 1 for a heading, and the number of the outermost doubtful part."""
    stack: list[tuple[str, int, bool, int]] = []  # open elements: tag, part inside, hidden, doubtful part
    opened: dict[str, int] = {}  # how many elements of each tag are open
    doubts = doubt = 0
    text: list[str] = []
    linked = links = at = heading = 0
    part, hidden = UNDECIDED, False

    def ended() -> tuple[str, int, int, int, int] | None:
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        return (joined, linked, part, heading, doubt) if joined else None

    def close(i: int) -> None:
        for one in stack[i:]:
            opened[one[0]] -= 1
        del stack[i:]

    size = len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at and not hidden:
            run = page[at:end]
            text.append(run)
            if links:
                linked += len(_SPACE.sub(" ", html.unescape(run)).strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK or tag in BAD_TAGS:
            block = ended()
            if block:
                yield block
            text, linked, heading = [], 0, 0
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if opened.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
        else:
            ends = any(opened.get(x) for x in _CLOSES.get(tag, ()))
            for i in range(len(stack) - 1, -1, -1) if ends else ():
                if stack[i][0] in _CLOSES.get(tag, ()):
                    close(i)
                    break
                if stack[i][0] not in ("b", "i", "a", "em", "strong", "span", "td", "th") or tag in ("p", "li") and stack[i][0] in ("td", "th"):
                    break
            if tag == "p" and links:
                links = 0
            if tag in RAW and not m[0].endswith("/>"):
                end_tag = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
                at = end_tag.end() if end_tag else size
                continue
            if tag not in VOID and not m[3].endswith("/"):
                own = _part(tag, m[3], bool(stack) and stack[-1][1] == GOOD)
                if own == DOUBTFUL:
                    if doubt:  # inside a doubtful part the name counts
                        own = BAD
                    else:
                        own, doubts = part, doubts + 1
                        doubt = doubts
                if part == BAD:
                    own = BAD
                elif own == UNDECIDED:
                    own = part
                stack.append((tag, own, hidden or tag in HIDDEN, doubt))
                opened[tag] = opened.get(tag, 0) + 1
                if tag == "a":
                    links += 1
                if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                    heading = 1
        part, hidden, doubt = stack[-1][1:] if stack else (UNDECIDED, False, 0)
    block = ended()
    if block:
        yield block


def _first(text: str, linked: int, part: int, heading: int) -> int:
    """The label of a block by itself."""
    words, count = text.split(" "), length(text)
    if part == BAD or count < SHORT and text.strip(".:!- ").lower() in NOTICES or part != GOOD and count < RIGHTS_WORDS and RIGHTS.search(text):
        return BAD
    if heading:
        return UNDECIDED
    if linked / len(text) > LINK_DENSITY:
        return BAD
    if count < SHORT:
        return UNDECIDED
    stop = sum(w.strip(".,;:!?\"'()*#$%&|").lower() in STOP_WORDS for w in words)
    if count > len(words):
        stop += sum(c in STOP_SIGNS for c in text) / 2
    return GOOD if stop / count >= STOP_DENSITY or count >= LONG else UNDECIDED


def length(text: str) -> int:
    """Words of a text; where a script has no spaces, two signs are a word."""
    signs = 0 if text.isascii() else len(SPACELESS.findall(text))
    return max(text.count(" ") + 1, signs // 2)


def _nearest(labels: list[int], marks: list[bool]) -> list[tuple[int, int]]:
    """For each place the distance to the last decided one before it (far, if there is none) and its label; only marked places count."""
    out, far, label = [], 1 << 30, UNDECIDED
    for one, mark in zip(labels, marks, strict=True):
        out.append((far, label))
        if mark and one:
            far, label = 0, one
        far += 1
    return out


def classify(found: list[tuple[str, int, int, int, int]]) -> list[int]:
    """A label for each block: GOOD or BAD."""
    labels = [_first(*block[:4]) for block in found]
    prose: dict[int, list[int]] = {}  # characters and blocks of running text by doubtful part
    for (text, _, _, _, doubt), label in zip(found, labels, strict=True):
        if label == GOOD:
            one = prose.setdefault(doubt, [0, 0])
            one[0] += len(text)
            one[1] += 1
    total = sum(x for x, _ in prose.values())
    outvoted = {d for d, (chars, n) in prose.items() if d and n >= OUTVOTING_BLOCKS and chars >= OUTVOTES * total}
    # Adverts inside an article are nobody's neighbours.
    notices = [text.strip(".:!- ").lower() in NOTICES for text, *_ in found]
    for i, block in enumerate(found):
        if block[4] and block[4] not in outvoted:
            labels[i] = BAD
    inside = [block[2] == GOOD and (not block[4] or block[4] in outvoted) for block in found]
    everywhere = [not x for x in notices]
    article = [a and b for a, b in zip(inside, everywhere, strict=True)]
    both = [(_nearest(labels, marks), _nearest(labels[::-1], marks[::-1])[::-1]) for marks in (everywhere, article)]
    out = []
    for i, label in enumerate(labels):
        if label == UNDECIDED:
            (near, before), (far, after) = (x[i] for x in both[inside[i]])
            if before == after:
                label = before
            elif near == far:
                label = after if found[i][3] else GOOD
            else:
                label = before if near < far else after
            label = label or (GOOD if inside[i] else BAD)
        out.append(label)
    if GOOD not in out and GOOD not in labels:
        out = _lone_run(found, labels, out)
    return out


def _lone_run(found: list[tuple[str, int, int, int, int]], labels: list[int], out: list[int]) -> list[int]:
    """``out`` with the longest run of undecided blocks as the article, if it is long enough."""
    best, at = (0, 0, 0), 0
    while at < len(labels):
        end = at
        while end < len(labels) and labels[end] == UNDECIDED:
            end += 1
        best = max(best, (sum(length(block[0]) for block in found[at:end]), -at, -end))
        at = end + 1
    words, start, end = best
    return [GOOD if words >= LONE_RUN and -start <= i < -end else label for i, label in enumerate(out)]


def extract(page: str | None) -> str:
    """The main text of a page: its good blocks joined by line ends; empty if there is none."""
    found = list(blocks(page or ""))
    return "\n".join(block[0] for block, label in zip(found, classify(found), strict=True) if label == GOOD)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column("html")
        for at in range(0, batch.num_rows, 64):
            texts = [extract(x.as_py()) for x in pages.slice(at, 64)]
            part = batch.slice(at, 64)
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages(page_id, url, html)``: page_id, url, text, n_chars (code points).

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
    order by one line end. Null and empty pages, and pages without an article, have an empty text; an empty table gives no rows; repeated
    rows are each read; null ids and urls stay; other columns are ignored; broken markup ends with the page.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")
