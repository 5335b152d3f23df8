"""HTML main text: two-pass block rules on stop-word density, length and link density."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of the block rules: characters, share of stop words, share of characters in links.
SHORT, LONG, FEW_STOPS, MANY_STOPS, MOST_LINKS = 70, 200, 0.15, 0.25, 0.25
#: Share of links above which a list in an article is a menu; share of stop words below which a page is in another
#: language; times its good text by which what stands outside a marked article makes the mark wrong.
MOST_LINKED, FOREIGN, WRONG_MARKS = 0.9, 0.05, 2.0
STOP_WORDS = frozenset(
    (
        "a an and are as at be but by for from had has have he her his i if in is it its not of on or our she that the their they this to was we were which will with you "
        "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour que qui sa se ses son sont sur un une vous "
        "aber als am auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so über um und uns von war wie wir zu zum zur "
        "al como con cuando de del desde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por porque que se si sin sobre su sus también un una y ya"
    ).split()
)
_OPEN = re.compile(r"[A-Za-z][^\s/>]*")
#: One attribute and what stands before it: a name, and a value in quotes or up to white space or the tag's end.
_ATTR = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(?![\"'])([^\s>]*)|([\"'])))?)")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*>?", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "select", "noframes", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_OUTSIDE = frozenset("nav footer aside form dialog menu head button label".split())
_LISTS = frozenset("ul ol menu dir".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Pieces of a class, id or role that mark what isn't the article, and pieces that may stand beside them. A name counts
#: only if it is made of both alone: "comment-list" isn't the article, "notice-of-rights" may be.
_MARKS = frozenset(
    (
        "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promos promotion banner banners sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs "
        "footer cookie cookies consent notice notices popup popups modal overlay share sharing social comment comments disqus reply replies related recommend recommended recommendations newsletter subscribe "
        "subscription widget widgets toolbar pagination pager contentinfo complementary alert alerts gdpr login signup"
    ).split()
)
_BESIDE = frozenset(
    (
        "main top bottom left right side bar box boxes block container wrapper wrap inner outer section area list item items link links button buttons form icon icons header head body footer page site global "
        "primary secondary mobile desktop sticky fixed float slot unit zone space region row col column content text the js"
    ).split()
)
_COMMENTS = frozenset("comment comments reply replies".split())
_HEADS = frozenset("header masthead topbar title".split())
_PIECES = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")


def _marks(names: str, of: frozenset) -> bool:
    """Whether one of the names is made of pieces of `of`, of pieces that may stand beside them and of numbers."""
    for name in names.split():
        pieces = [p.lower() for p in _PIECES.split(name) if p and not p.isdigit()]
        if any(p in of for p in pieces) and all(p in of or p in _BESIDE for p in pieces) or "".join(pieces) in of:
            return True
    return False


_LETTERS = re.compile(r"[^\W\d_]+")


class _Blocks:
    """Blocks of a page in order: text, characters in links, whether what holds it can't be an article, whether an
    article holds it, whether it is a heading, whether a list holds it."""

    def __init__(self, page: str):
        self.found: list[tuple[str, int, bool, bool, bool, bool]] = []
        self.stack: list[tuple[str, bool, bool, bool]] = []  # tag, outside, article, in a list
        self.parts: list[str] = []
        self.linked = 0
        self.links = 0
        self.heading = False
        self.open: Counter = Counter()  # how many of each tag are on the stack
        at, n = 0, len(page)
        while at < n:
            end = page.find("<", at)
            self.text(page[at : end if end >= 0 else n])
            if end < 0:
                break
            at = self.markup(page, end)
        self.flush()

    def markup(self, page: str, at: int) -> int:
        """What begins at a <; returns where it ends. Every character is looked at a bounded number of times."""
        upto = lambda mark, start: found + len(mark) if (found := page.find(mark, start)) >= 0 else len(page)
        if page.startswith("<!--", at):
            return upto("-->", at + 4) if not page.startswith(("<!-->", "<!--->"), at) else upto(">", at)
        if page.startswith("<![CDATA[", at):
            return upto("]]>", at)
        if page.startswith(("<!", "<?"), at):
            return upto(">", at)
        closes = page.startswith("</", at)
        m = _OPEN.match(page, at + 1 + closes)
        if closes:
            end = upto(">", at)
            return self.tag(m[0].lower(), True, {}, end, page) if m else end
        if not m:
            self.text("<")
            return at + 1
        at, attrs = m.end(), {}
        while at < len(page):
            a = _ATTR.match(page, at)
            if not a:  # white space up to the end of the page
                at = len(page)
                break
            at = a.end()
            if a[1]:
                return self.tag(m[0].lower(), False, attrs, at, page)
            if a[6]:  # a quote that never closes
                at = len(page)
                break
            attrs.setdefault(a[2].lower(), next((v for v in (a[3], a[4], a[5]) if v is not None), ""))
        return at  # a tag that the page's end cuts off is no tag

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(raw)
            if self.links:
                self.linked += len(html.unescape(raw).strip())

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            _, outside, article, listed = self.stack[-1] if self.stack else ("", False, False, False)
            self.found.append((text, min(self.linked, len(text)), outside, article, self.heading, listed))
        self.parts, self.linked = [], 0

    def tag(self, name: str, closes: bool, attrs: dict[str, str], at: int, page: str) -> int:
        if name in _RAW and not closes:
            if page[at - 2] == "/" and name in ("svg", "math"):
                return at
            end = _RAW[name].search(page, at)
            self.parts.append(" ")
            return end.end() if end else len(page)
        if name == "a":
            self.links = 0 if closes else 1
            return at
        if name == "br":
            self.parts.append(" ")
            return at
        if name in _VOID and name != "hr":
            return at
        if name not in _BLOCK and name not in _OUTSIDE:
            return at
        self.flush()
        if name == "hr":
            return at
        if closes:
            if self.open[name]:
                while self.pop() != name:
                    pass
            self.heading = False
            return at
        if name == "p" or name in _HEADINGS or name == "li":
            # an open paragraph, heading or item ends where the next of its kind begins
            while self.stack and self.stack[-1][0] in ("p", *_HEADINGS, *(("li",) if name == "li" else ())):
                self.pop()
        _, outside, article, listed = self.stack[-1] if self.stack else ("", False, False, False)
        names = " ".join(html.unescape(attrs[c]) for c in ("class", "id", "role") if attrs.get(c))
        if name in ("article", "main"):
            article = True
        if name not in ("html", "body", "article", "main"):
            outside = outside or name in _OUTSIDE or (name == "header" and not article) or bool(names and (_marks(names, _MARKS) or (not article and _marks(names, _HEADS))))
        elif name == "article" and _marks(names, _COMMENTS):
            outside = True
        style = "".join(attrs.get("style", "").lower().split())
        outside = outside or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in style
        self.heading = name in _HEADINGS
        self.stack.append((name, outside, article, listed or name in _LISTS))
        self.open[name] += 1
        return at

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.open[name] -= 1
        return name


def _first_pass(blocks: list[tuple], has_article: bool) -> list[str]:
    """A label for each block by itself: out (what holds it can't be the article), bad, good, near or short."""
    counted = []
    for text, *_ in blocks:
        words = _LETTERS.findall(text.lower())
        counted.append((len(words), sum(w in STOP_WORDS for w in words)))
    held = [c for c, b in zip(counted, blocks, strict=True) if not b[2]]
    # in a language of none of the stop words they say nothing: length and links decide
    known = sum(s for _, s in held) >= FOREIGN * sum(n for n, _ in held)
    labels = []
    for (text, linked, outside, article, _, listed), (n, s) in zip(blocks, counted, strict=True):
        stops, links = (s / n if n else 0.0) if known else MANY_STOPS, linked / len(text)
        if outside or (has_article and not article):
            labels.append("out")
        elif has_article and links > MOST_LINKED and listed:
            labels.append("bad")  # of a marked article only lists of links go
        elif has_article:
            labels.append("good" if len(text) > SHORT and stops >= FEW_STOPS else "near")
        elif links > MOST_LINKS:
            labels.append("bad")
        elif len(text) < SHORT:
            labels.append("bad" if links > 0 else "short")
        elif stops >= MANY_STOPS:
            labels.append("good" if len(text) > LONG else "near")
        else:
            labels.append("near" if stops >= FEW_STOPS else "bad")
    return labels


def main_text(page: str | None) -> str:
    """The main text of one page; blocks joined by a line end."""
    blocks = _Blocks(page or "").found
    inside = lambda b: b[3] and not b[2]
    has_article = any(map(inside, blocks))
    first = _first_pass(blocks, has_article)
    if has_article:
        # marks may be wrong: teasers marked as articles hold less good text than what stands beside them
        plain = _first_pass(blocks, False)
        size = lambda own: sum(len(b[0]) for b, c in zip(blocks, plain, strict=True) if c == "good" and inside(b) == own)
        if size(False) > WRONG_MARKS * size(True):
            has_article, first = False, plain
    # inside a marked article what surrounds a menu or advert says nothing of the text beside it
    decided = [{"good": "good", "bad": "bad", "out": "" if has_article else "bad"}.get(c, "") for c in first]
    # what stands before all else and heads nothing is page furniture; the last lines of a text may well be short
    before, after = ["" if has_article else "bad"] * len(first), [""] * len(first)
    for k in range(1, len(first)):
        before[k] = decided[k - 1] or before[k - 1]
    for k in range(len(first) - 2, -1, -1):
        after[k] = decided[k + 1] or after[k + 1]
    sure = "good" in first
    out = []
    for k, c in enumerate(first):
        around = {before[k], after[k]} - {""}
        heads = blocks[k][4] and after[k] == "good"
        # where nothing is good, what isn't bad is all the text there is
        if c == "good" or (c == "near" and (around != {"bad"} or not sure)) or (c == "short" and (heads or around == {"good"} or not sure)):
            out.append(blocks[k][0])
    return "\n".join(out)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    First pass: a block inside a menu, header, footer, sidebar, notice, advert, form or comment list is out, one full of
    links is bad; of the rest long blocks with many stop words are good, short ones undecided. Where the page is in a
    language of none of the stop words, length and links alone decide. Second pass: undecided blocks take the label of
    the nearest decided neighbours: inside a marked article they go only between lists of links, elsewhere short ones
    stay only between good ones, after the last one or as the heading of one; where a page has no good block at all, they stay. A page of
    which most good text stands outside what it marks as its article is judged as if it had no mark. Null or empty html
    gives the empty text; html may be broken and may end anywhere, time grows with its length. An empty table gives no
    rows; repeated rows repeat; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
