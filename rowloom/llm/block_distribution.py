"""Main text of HTML pages by line-block distribution.

Markup is stripped so that every block of the page becomes a line. Lines that structure marks as
boilerplate (menus, forms, notices, adverts, reader comments ...) are taken out and leave blank lines
where they stand between different parts of the page, but none between lines of the same part. Over the lengths of the lines, links not counted, a
window of three lines is summed. Where the sum rises from zero is a surge point, where it falls back to
zero a dive point; text between a surge and its dive is kept if the sum reaches a threshold on the way.

The threshold is 86 characters, or the page's highest sum if that is less, so the main text of a page of
short lines is kept as well. What a page marks as its article (article, main) is judged apart from the rest:
each of its lines weighs 43 characters more, so that two lines of it are enough; of the lines outside, those
between surge and dive points whose sum reaches three thresholds are kept, if together they are longer than all
that is marked: a marked teaser does not hide the text beside it. Without such marks the result is the same
wherever the main text is longer than that.

Defined results: null and empty pages have empty text; unclosed and misnested tags are closed where a
parent closes; a tag ends at its first > outside quotes, or at its first > if there is none within 4,096
characters; text of any length is processed in one pass, in time proportional to it; repeated rows get a row
each; an empty table gives no rows; other columns of the input do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._store import arrow_map, with_fields

WINDOW = 3
THRESHOLD = 86
#: What a line weighs more if the page marks it as its article.
MARK = 43

#: Element names by what they do to lines.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD = frozenset("nav aside footer form menu dialog template svg math canvas object audio video select button fieldset datalist label figure-menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset("td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li dt dd tr".split())
MAIN = frozenset("article main".split())
#: An open element of the key is closed by a new element of the value.
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "tr": frozenset(["tr"])}

#: Words of class, id and role that mark boilerplate, alone or at the end of a compound.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation topnav subnav menu menus menubar submenu breadcrumb breadcrumbs sidebar sidebars aside complementary footer footers footnav masthead toolbar cookie cookies consent gdpr ccpa notice notices popup popups modal modals overlay newsletter subscribe subscription signup login signin register share shares sharing social comment comments commentlist commentary disqus reply replies respond discussion related recommended recommendations widget widgets pagination pager paging skip skiplink search searchbox searchform contentinfo copyright alert alerts paywall teaser teasers trending popular hidden invisible".split()
)
BAD_ENDS = tuple("navbar navigation sidebar footer menu breadcrumb breadcrumbs advert advertisement banner popup cookie cookies consent newsletter comments commentlist".split())
HEADER_WORDS = frozenset("header topbar siteheader pageheader".split())
#: Words that mark the article itself and outweigh the others on the same element.
GOOD_WORDS = frozenset("article articlebody entry post content story maincontent main".split())

#: Characters within which the end of a tag is looked for outside quotes.
LONGEST = 4096
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\"<>]++|\"[^\"]*+\"|'[^']*+')*+)>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PARTS = re.compile(r"[^A-Za-z]+")


def finder(text: str, what: str) -> Callable[[int], int]:
    """Where `what` is next, -1 if nowhere, for places that only go forward: the text is searched once in all."""
    at = -2

    def after(place: int) -> int:
        nonlocal at
        if at != -1 and at < place:
            at = text.find(what, place)
        return at

    return after


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, value, attributes): text, open and close with the element's name, cdata. Comments and raw elements are left out."""
    at = place = 0  # text from at on has not been handed on; markup is looked for from place on
    close, comment, bang, section = (finder(html, x) for x in (">", "-->", "--!>", "]]>"))
    n = len(html)
    while True:
        place = html.find("<", place)
        if place < 0:
            break
        after = html[place + 1 : place + 2]
        if html.startswith("<!--", place):
            ends = [e + len(x) for e, x in ((comment(place + 2), "-->"), (bang(place + 2), "--!>")) if e >= 0]
            kind, value, attrs, end = "", "", "", min(ends, default=n)
        elif html.startswith("<![CDATA[", place):
            end = section(place)
            kind, value, attrs, end = "cdata", html[place + 9 : end if end >= 0 else n], "", end + 3 if end >= 0 else n
        elif not (after in ("/", "!", "?") or after.isascii() and after.isalpha()):
            place += 1
            continue
        elif (stop := close(place)) < 0:
            place = html.find("<!--", place)  # nothing but a comment can follow
            if place < 0:
                break
            continue
        elif m := TAG.match(html, place, place + LONGEST):
            kind, value, attrs, end = "close" if m[1] else "open", m[2].lower(), m[3], m.end()
        elif m := NAME.match(html, place, stop):
            kind, value, attrs, end = "close" if after == "/" else "open", m[1].lower(), html[m.end() : stop], stop + 1
        else:
            kind, value, attrs, end = "", "", "", stop + 1
        if at < place:
            yield "text", html[at:place], ""
        if kind == "open" and value in RAW:
            m = RAW_END[value].search(html, end)
            kind, end = "", m.end() if m else n
        if kind:
            yield kind, value, attrs
        at = place = end
    if at < n:
        yield "text", html[at:], ""


def role(name: str, attrs: str) -> str:
    """What an element is: bad, header, main, or nothing known."""
    return usual_role(name, attrs) if len(attrs) < 300 else usual_role.__wrapped__(name, attrs)


@lru_cache(maxsize=20_000)
def usual_role(name: str, attrs: str) -> str:
    if name in BAD:
        return "bad"
    if name == "header":
        return "header"
    if name in ("html", "body"):
        return ""
    found = {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attrs)} if attrs and not attrs.isspace() else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return "bad"
    duty = found.get("role", "").lower()
    if duty in ("main", "article") or "articleBody" in found.get("itemprop", ""):
        return "main"
    if duty in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"):
        return "bad"
    if duty == "presentation" or not (found.get("class") or found.get("id") or duty):
        return "main" if name in MAIN else ""
    names = " ".join((found.get("class", ""), found.get("id", "")))
    words = {w.lower() for part in names.split() for w in (*PARTS.split(CAMEL.sub(" ", part)), part)}
    bad = bool(words & BAD_WORDS) or any(w.endswith(BAD_ENDS) for w in words)
    if bad and not (words & GOOD_WORDS and words & BAD_WORDS <= {"main", "hidden"}):
        return "bad"
    if words & HEADER_WORDS and not words & GOOD_WORDS:
        return "header"
    body = name in ("div", "section") and ("article" in words or "articlebody" in words or {"body", "content"} & words and {"post", "entry", "story"} & words)
    return "main" if name in MAIN or body else ""


class Place:
    """An element that holds others: when it was opened and closed."""

    __slots__ = ("start", "stop")

    def __init__(self, start: float, stop: float = float("inf")):
        self.start, self.stop = start, stop

    def holds(self, other: Place) -> bool:
        return self is other or self.start < other.start < self.stop


ROOT = Place(-1)


class Lines:
    """The lines of a page: text, weight and whether the page marks them as its article."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.weight: list[int] = []
        self.marked: list[bool] = []
        self._run: list[str] = []
        self._plain = 0
        self._place = self._last = ROOT
        self._cut = False

    def add(self, text: str, linked: bool, place: Place = ROOT) -> None:
        """place: the innermost element around the text that holds others."""
        if not self._run:
            self._place = place
        self._run.append(text)
        if not linked:
            self._plain += len(text)

    def end(self, marked: bool) -> None:
        """The block ends: white space inside becomes one space."""
        if self._run:
            line = " ".join(unescape("".join(self._run)).split())
            if line:
                if self._cut and not self._last.holds(self._place) and not self._place.holds(self._last):
                    self.text += [""] * WINDOW
                    self.weight += [0] * WINDOW
                    self.marked += [False] * WINDOW
                self._cut, self._last = False, self._place
                linked = sum(map(len, self._run)) - self._plain
                self.text.append(line)
                self.weight.append(0 if linked > self._plain and not marked else len(line))
                self.marked.append(marked)
            self._run, self._plain = [], 0

    def gap(self) -> None:
        """Something was taken out here; blank lines follow if the next line belongs to another part."""
        self._cut = True


class Open:
    """The open elements of a page, and how many of each name and role they are."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, Place, bool]] = []
        self.names: Counter[str] = Counter()
        self.roles: Counter[str] = Counter()
        self.headings = self.clock = 0

    def place(self) -> Place:
        return self.stack[-1][2] if self.stack else ROOT

    def push(self, name: str, kind: str) -> None:
        self.clock += 1
        own = name not in LEAVES
        self.stack.append((name, kind, Place(self.clock) if own else self.place(), own))
        self.names[name] += 1
        self.roles[kind] += 1
        self.headings += name in HEADINGS

    def pop(self) -> None:
        name, kind, place, own = self.stack.pop()
        self.clock += 1
        if own:
            place.stop = self.clock
        self.names[name] -= 1
        self.roles[kind] -= 1
        self.headings -= name in HEADINGS

    def close(self, name: str) -> None:
        """Close the innermost element of the name and what is in it; nothing, if none is open."""
        if self.names[name]:
            while self.stack[-1][0] != name:
                self.pop()
            self.pop()


def lines_of(html: str) -> Lines:
    out, opened, link = Lines(), Open(), 0
    skip, depth = "", 0  # the boilerplate element that is open, and how many of its name
    roles = opened.roles

    for token, name, attrs in tokens(html):
        if token == "text":
            if not skip and not (roles["header"] and not (roles["main"] and opened.headings)):
                out.add(name, link > 0, opened.place())
            continue
        if token == "cdata":
            if not skip:
                out.add(name.replace("&", "&amp;"), link > 0, opened.place())
            continue
        closing = token == "close"
        if skip:
            if name == skip:
                depth += -1 if closing else 1
                if closing and depth == 0 or skip in ("p", "li") and not closing:
                    skip = ""
                    if closing:
                        continue
                else:
                    continue
            elif skip == "p" and name in BLOCKS or closing and name in ("body", "html") or not closing and name in MAIN and not roles["main"] and skip not in MAIN:
                skip = ""
            elif closing and name in MAIN and opened.names[name] and skip not in ("div", "section"):
                skip = ""
            else:
                continue
        if name == "a":
            link = 0 if closing else 1
            if closing or role(name, attrs) != "bad":
                continue
        if name in BLOCKS or name == "br":
            link = 0
            out.end(roles["main"] > 0)
        elif name in CELLS:
            out.add(" ", True, opened.place())
        if closing:
            opened.close(name)
            continue
        if name in VOID:
            continue
        if name in BLOCKS or name in CELLS:
            while opened.stack and name in CLOSED_BY.get(opened.stack[-1][0], ()):
                opened.pop()
        kind = role(name, attrs)
        if kind == "bad" and not attrs.rstrip().endswith("/"):
            skip, depth = name, 1
            link = 0
            if not roles["main"] and name in BLOCKS:
                out.end(False)
                out.gap()
            continue
        if name in BLOCKS or kind:
            opened.push(name, kind)
            if kind == "header" and not roles["main"]:
                out.gap()
    out.end(roles["main"] > 0)
    return out


def runs(weight: list[int], least: int, window: int) -> list[int]:
    """The lines between surge and dive points of runs whose windowed sum reaches least."""
    total = [0, *accumulate(weight)]
    n = len(weight)
    blocks = [total[min(n, i + window)] - total[i] for i in range(n)]
    out, i = [], 0
    while i < n:
        if not blocks[i]:
            i += 1
            continue
        dive = i
        while dive < n and blocks[dive]:
            dive += 1
        if max(blocks[i:dive]) >= least:
            out += range(next(k for k in range(i, dive) if weight[k]), dive)
        i = dive
    return out


def highest(weight: list[int], window: int) -> int:
    total = [0, *accumulate(weight)]
    return max((total[min(len(weight), i + window)] - total[i] for i in range(len(weight))), default=0)


def main_lines(page: Lines, window: int = WINDOW, threshold: int = THRESHOLD) -> list[str]:
    """Lines between surge and dive points of the windowed lengths."""
    inside = [w + MARK if m and w else 0 for w, m in zip(page.weight, page.marked, strict=True)]
    rest = [0 if m else w for w, m in zip(page.weight, page.marked, strict=True)]
    if any(page.marked):
        kept = [k for k in runs(inside, min(threshold, highest(inside, window)), window) if page.marked[k]]
        others = [k for k in runs(rest, window * threshold, window) if page.text[k] and not page.marked[k]]
        if sum(rest[k] for k in others) > sum(w for w, m in zip(page.weight, page.marked, strict=True) if m):
            kept += others
    else:
        kept = [k for k in runs(rest, min(threshold, highest(rest, window)), window) if page.text[k]]
    return [page.text[k] for k in sorted(kept)]


def main_text(html: str | None) -> str:
    return "\n".join(main_lines(lines_of(html))) if html else ""


def extracted(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, text and n_chars (code points) of each page."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [*keys, "text", "n_chars"])

    schema = with_fields(pages.select(*keys).schema, text=T.StringType(), n_chars=T.LongType())
    return arrow_map(pages.select(*keys, html), each, schema)


def op1_block_distribution(pages: DataFrame) -> DataFrame:
    return extracted(pages, ["page_id", "url"])
