"""Main text of web pages by tree scoring.

Every paragraph passes points, for its length and its commas, to the elements around
it; an element's sum is discounted by its share of link text. The best container, or the one
around it that tag, role, class or id call the article, is kept. Without such a tag or
role, so are those of its siblings that hold more text than links. Menus, notices,
adverts, forms and reader comments among them are not.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tollgate.llm.common import map_batches, texts

# Comments and declarations, or a tag with its attributes; possessive, so linear.
_MARKUP = re.compile(
    r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*+>|
    (/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+|[^>]*+)>)""",
    re.S | re.X,
)
# Behind the last tag only what need not be closed; groups as above.
_OPEN_COMMENT = re.compile(r"<!(?:--.*|\[CDATA\[.*)()(?:\Z)(?:(x)|)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names of HTML.
RAW = frozenset("script style noscript template title textarea iframe svg math canvas object audio video".split())
# Without an end tag these hold nothing that is not text of the page.
MAY_BE_OPEN = RAW - frozenset("script style title textarea".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset(
    """
    a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter
    output progress q ruby rt rp s samp small span strike strong sub sup time tt u var wbr
    input meta link base source track param area embed col basefont nobr center
    """.split()
)
VOID = frozenset("br hr input img meta link base source track param area embed col wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p td th pre li dd dt blockquote figcaption address".split()) | HEADINGS
LEFT_OUT = frozenset("nav footer aside dialog menu button select fieldset form head datalist".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar".split())
# An open element of the second kind ends where one of the first begins, up to the third.
ENDS = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "tr": ("tr td th", ("table",)),
    "tbody": ("thead tbody tr td th", ("table",)),
    "option": ("option", ("select",)),
}
# Words that begin or end the class or id of what is not the article.
BOILERPLATE = frozenset(
    """
    nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidenav footer masthead banner
    cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter
    subscribe subscription signup login share sharing social advert adverts advertisement
    advertising ad ads sponsor sponsored promo promotion related recommended comment comments
    disqus reply replies respond widget widgets pagination pager toolbar search skip
    """.split()
)
ARTICLE = frozenset("article content post entry main story body text".split())
NOT_ITSELF = frozenset("has with no without".split())
# Whatever they are named for, these lay out the page.
LAYOUT = frozenset("layout wrapper wrap container grid page columns row outer inner".split())
# Named so, an element is left out however much of the page it holds.
COMMENTS = frozenset("comment comments disqus reply replies respond".split())

LEAST_POINTS_LENGTH = 25
LEVELS = 5
# A link in the text is longer than one in a menu.
MENU_LINK_LENGTH = 25
# Shares of a page's markup and paragraphs from which a form is the page.
WHOLE_FORM = 0.5
# An element left out by its name that holds this many times the other text is the article.
WHOLE_PAGE = 2
# Wrappers around each other that are looked through for it.
MOST_SPARED = 4
_FORM_ENDS = re.compile(r"</form", re.I | re.A)
_TEXT_TAGS = re.compile(r"<(?:p|h[1-6]|article|main)[\s>]", re.I | re.A)
_RAW_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
# From this share of link text on, an element beside the article does not read like text.
MOSTLY_LINKS = 0.5


class _Page:
    """The block elements of a page, their text blocks and link shares."""

    def __init__(self, html: str, spared: frozenset[int] = frozenset()):
        self.spared = spared  # elements, by number, that are kept in spite of their names
        self.source = 0  # the element, by number, whose name leaves out what is read
        self.lost: dict[int, int] = {}
        self.tag, self.parent, self.out, self.named = ["#root"], [-1], [""], [False]
        self.main, self.worded = [False], [False]
        self.blocks: list[tuple[int, str]] = []
        self.length, self.linked, self.links = [0], [0], [0]
        self.stack = [0]
        self.where: dict[str, list[int]] = {}
        self.unclosed: set[str] = set()
        self.forms: tuple[list[int], list[int]] | None = None
        self.html = html
        self.text: list[str] = []
        self.link_length, self.link_open = 0, 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        last = html.rfind(">") + 1  # tags end here at the latest: none is sought behind it
        while at < size:
            found = _MARKUP.search(html, at, last) if at < last else None
            found = found or _OPEN_COMMENT.search(html, max(at, last))
            if found is None:
                self._add(html[at:])
                break
            self._add(html[at : found.start()])
            at, tag = found.end(), found[2]
            if tag is None:
                if at == last and found[0].startswith("<!--") and not found[0].endswith(("-->", "--!>")):
                    break  # never closed
                if found[0].startswith("<![CDATA["):
                    self._add(found[0][9:].removesuffix("]]>"), plain=True)
                continue
            tag = tag.lower()
            if found[1]:
                self._end(tag)
            elif tag in RAW:
                at = self._behind(tag, found[3], at)
            else:
                self._start(tag, found[3], at)
        self._flush()

    def _behind(self, tag: str, attributes: str, at: int) -> int:
        """Where the text goes on after a start tag whose content is no text of the page."""
        if tag in FOREIGN and attributes.rstrip().endswith("/"):
            return at
        close = None if tag in self.unclosed else _RAW_ENDS[tag].search(self.html, at)
        if close is not None:
            return close.start()
        self.unclosed.add(tag)  # none follows: it need not be sought again
        return at if tag in MAY_BE_OPEN else len(self.html)

    def _whole_form(self, at: int) -> bool:
        """Whether the form that begins here is the page: it holds most of its markup and text."""
        if self.forms is None:
            ends = [m.start() for m in _FORM_ENDS.finditer(self.html)]
            self.forms = ends, [m.start() for m in _TEXT_TAGS.finditer(self.html)]
        ends, tags = self.forms
        next_ = bisect_left(ends, at)
        end = ends[next_] if next_ < len(ends) else len(self.html)
        held = bisect_left(tags, end) - bisect_left(tags, at)
        return held > WHOLE_FORM * len(tags) and end - at > WHOLE_FORM * len(self.html)

    def _add(self, raw: str, plain: bool = False) -> None:
        if raw and self.source:
            self.lost[self.source] = self.lost.get(self.source, 0) + (0 if self.link_open else len(raw.strip()))
        if raw and not self.out[self.stack[-1]]:
            text = raw if plain or "&" not in raw else unescape(raw)
            self.text.append(text)
            if self.link_open:
                self.link_length += len(text.strip())

    def _flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            node = self.stack[-1]
            if text:
                self.blocks.append((node, text))
                self.length[node] += len(text)
                self.linked[node] += min(self.link_length, len(text))
            self.text, self.link_length = [], 0

    def _start(self, tag: str, attributes: str, at: int) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag == "a":
            self.link_open = int("href" in attributes.lower())
            self.links[self.stack[-1]] += self.link_open
            return
        if tag in INLINE:
            return
        self._flush()
        if tag == "hr":
            return
        if tag in ("body", "html"):
            tag = "body"
        self._close_before(tag)
        parent, known = self.stack[-1], self._attributes(attributes) if attributes.strip("/ \n\t") else {}
        inside = self.named[parent]
        out, main = self.out[parent], tag in ("article", "main") or known.get("role", "").strip().lower() in ("article", "main")
        if main and out in ("form", "header", "nav"):  # wraps the page, or was never closed
            out = ""
        if not out and not (tag == "form" and self._whole_form(at)):
            out = self._left_out(tag, known, inside, main)
            if out == "name":
                number = len(self.tag)
                if number in self.spared:
                    out = ""
                else:
                    self.source = number
        self.where.setdefault(tag, []).append(len(self.stack))
        self.tag.append(tag)
        self.parent.append(parent)
        self.out.append(out)
        self.named.append(inside or (main and not out))
        self.main.append(main and not out)
        self.worded.append(tag != "body" and not out and self._worded(known))
        for counts in (self.length, self.linked, self.links):
            counts.append(0)
        self.stack.append(len(self.tag) - 1)

    def _close_before(self, tag: str) -> None:
        if self.tag[self.stack[-1]] == "p":
            self._pop(len(self.stack) - 1)
        if self.tag[self.stack[-1]] in HEADINGS and tag in PARAGRAPHS:
            self._pop(len(self.stack) - 1)
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            bound = max((self.where[b][-1] for b in bounds if self.where.get(b)), default=0)
            above = [w[bisect_right(w, bound)] for w in map(self.where.get, ended.split()) if w and w[-1] > bound]
            if above:
                self._pop(min(above))

    def _pop(self, i: int) -> None:
        for node in self.stack[i:]:
            self.where[self.tag[node]].pop()
            if node == self.source:
                self.source = 0
        del self.stack[i:]
        self.link_open = 0

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.link_open = 0
        if tag in INLINE or tag in VOID:
            return
        if tag in ("body", "html"):
            self._flush()
            return
        if self.where.get(tag):
            self._flush()
            self._pop(self.where[tag][-1])

    @staticmethod
    def _attributes(text: str) -> dict[str, str]:
        return {k.lower(): unescape(v.strip("\"'")) if v else "" for k, v in _ATTRIBUTE.findall(text)}

    def _left_out(self, tag: str, known: dict[str, str], inside: bool, main: bool) -> str:
        """Why an element is not part of the article, or the empty string."""
        if tag in LEFT_OUT:
            return tag
        if tag == "header" and not inside:
            return tag
        if not known or tag == "body":
            return ""
        if "hidden" in known or known.get("aria-hidden") == "true" or known.get("role", "").lower() in LEFT_OUT_ROLES:
            return "role"
        if "display:none" in known.get("style", "").replace(" ", "").lower():
            return "hidden"
        for name in (*known.get("class", "").split(), known.get("id", "")):
            words = [w.lower() for w in _NAME.findall(name)]
            if not words or NOT_ITSELF.intersection(words) or words[-1] in LAYOUT:
                continue
            ends = {words[0], words[-1]}
            if main:
                ends &= {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related"}
            if ends & COMMENTS:
                return "comments"
            if ends & BOILERPLATE or ("header" in ends and not inside and words[0] not in ARTICLE):
                return "name"
        return ""

    @staticmethod
    def _worded(known: dict[str, str]) -> bool:
        """Whether class or id begin or end with a word for the article; looks begin with text and body."""
        for name in (*known.get("class", "").split(), known.get("id", "")):
            words = [w.lower() for w in _NAME.findall(name)]
            if words and not NOT_ITSELF.intersection(words):
                if words[-1] in ARTICLE or words[0] in ARTICLE - {"text", "body"}:
                    return True
        return False

    def _sums(self) -> None:
        for i in range(len(self.tag) - 1, 0, -1):
            for counts in (self.length, self.linked, self.links):
                counts[self.parent[i]] += counts[i]

    def _density(self, i: int) -> float:
        return self.linked[i] / self.length[i] if self.length[i] else 0.0

    def _scores(self) -> list[float]:
        scores = [0.0] * len(self.tag)
        for node, text in self.blocks:
            if len(text) < LEAST_POINTS_LENGTH or self.tag[node] in HEADINGS:
                continue
            commas = sum(map(text.count, ",，、،"))
            points = 1 + commas + min(len(text) / 100, 3)
            taker = self.parent[node] if self.tag[node] in PARAGRAPHS else node
            for level in range(LEVELS):
                if taker < 0:
                    break
                scores[taker] += points / (1, 2, 6, 9, 12)[level]
                taker = self.parent[taker]
        return [s * (1 - self._density(i)) for i, s in enumerate(scores)]

    def _kept(self) -> set[int]:
        """Nodes whose text is the article."""
        self._sums()
        scores = self._scores()
        best = max(range(len(scores)), key=lambda i: (scores[i], -i))
        if not scores[best]:
            named = [i for i, n in enumerate(self.named) if n and self.length[i] and not self.named[self.parent[i]]]
            return {max(named, key=lambda i: self.length[i]) if named else 0}
        above = [best]
        while above[-1] > 0:
            above.append(self.parent[above[-1]])
        for up in above:
            if self.main[up]:
                return {up}
        if best == 0:
            return {0}
        bar = 0.2 * scores[best]
        best = max((i for i in above if self.worded[i] and self._density(i) < MOSTLY_LINKS), key=lambda i: -i, default=best)
        kept = {best}
        for i, parent in enumerate(self.parent):
            if parent == self.parent[best] and i != best and self.length[i]:
                if scores[i] >= bar or self._density(i) < MOSTLY_LINKS:
                    kept.add(i)
        return kept

    def _menu(self, i: int, below_heading: bool) -> bool:
        """A list or table of short links in the midst of the text; under a heading it is part of the text."""
        if self.tag[i] not in ("ul", "ol", "table", "dl") or self.links[i] < 3 or self._density(i) <= 0.75:
            return False
        return not below_heading and self.length[i] < MENU_LINK_LENGTH * self.links[i]

    def _below_heading(self) -> set[int]:
        """Lists and tables in an article whose text follows a heading at once."""
        found: set[int] = set()
        for (before, _), (node, _) in zip(self.blocks, self.blocks[1:]):
            if self.tag[before] in HEADINGS and self.named[node]:
                while node > before and node not in found:
                    found.add(node)
                    node = self.parent[node]
        return found

    def main_text(self) -> str:
        if not self.blocks:
            return ""
        kept, headed = self._kept(), self._below_heading()
        inside = [False] * len(self.tag)
        for i in range(len(self.tag)):
            above = self.parent[i] >= 0 and inside[self.parent[i]]
            inside[i] = (i in kept or above) and not self._menu(i, i in headed)
        return "\n\n".join(text for node, text in self.blocks if inside[node])


def main_text(html: str) -> str:
    """Blocks of a page's main text in page order, joined by two line feeds."""
    page, spared = _Page(html), frozenset()
    while page.lost:
        # a wrapper that is only named like a notice or a side bar holds nearly all the text
        most = max(page.lost, key=lambda i: (page.lost[i], -i))
        kept = sum(len(text) for _, text in page.blocks)
        if any(page.main[node] or page.named[node] for node, _ in page.blocks):
            break  # the page says itself which element the article is
        if page.lost[most] <= WHOLE_PAGE * kept or len(spared) == MOST_SPARED:
            break
        spared |= {most}
        page = _Page(html, spared)
    return page.main_text()


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of ``pages(page_id, url, html)``.

    One row per row, one pass, no shuffle. A null or empty page, and one without text of
    its own, has the empty text. Character references are decoded, white space inside a
    block is one blank. Other columns are not looked at.
    """

    def extract(batch: pa.RecordBatch) -> dict:
        found = [main_text(html) for html in texts(batch, "html")]
        return {
            "page_id": batch.column("page_id"),
            "url": batch.column("url"),
            "text": pa.array(found, pa.string()),
            "n_chars": pa.array([len(t) for t in found], pa.int64()),
        }

    schema = "page_id long, url string, text string, n_chars long"
    return map_batches(pages.select(F.col("page_id").cast("long"), "url", "html"), schema, extract)
