"""Text blocks of an HTML page, and the blocks that two pages share."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Elements whose text is no part of an article.
SKIPPED = frozenset(
    "nav footer aside form script style head title template noscript iframe object svg canvas "
    "button select textarea menu dialog audio video map".split()
)
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noscript"))
MAIN = frozenset(("article", "main"))
#: Elements that hold others and are closed; only these are kept on the stack.
CONTAINERS = SKIPPED | MAIN | frozenset("div section header body html ul ol table center".split())
#: Elements that begin and end a block of text.
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 li dl dt dd tr td th thead tbody tfoot caption blockquote pre hr "
    "address figure figcaption details summary fieldset legend br".split()
)
#: What may stand in a head; all else ends it.
HEAD_PARTS = frozenset("head title meta link script style base noscript template".split())
#: Elements that end what is left open of a paragraph, and those that repeat side by side.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 address summary figcaption legend".split())
ITEMS = frozenset("li dt dd tr td th caption tbody thead tfoot".split())
#: Elements whose articles are teasers or comments, if they are closed behind them.
AROUND = frozenset("aside nav footer form dialog menu".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: Words in class, id or role of what surrounds an article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo|banner|cookies?"
    r"|consent|notice|menu|nav|navbar|navigation|breadcrumbs?|sidebar|footer|comments?|disqus"
    r"|replies|share|sharing|social|related|newsletter|subscribe|popup|modal|complementary"
    r"|contentinfo|search)(?:$|[\s_-])",
    re.I,
)
#: What readers' comments are called inside an article.
COMMENTS = re.compile(
    r"comments?[_-](?:list|section|thread|area|body|form|box|wrap|wrapper|container|item|items|replies)", re.I
)
#: A quoted value may hold any sign, but is at most so long: what has no second quote is no value
#: to its page's end, and reading stays linear.
QUOTED = 10_000
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*)"
    rf"((?:[^>\"'<]|\"[^\"]{{0,{QUOTED}}}\"|'[^']{{0,{QUOTED}}}'|[\"'])*+)>",
    re.S,
)
#: Name and value of an attribute; a quoted text without a name gives neither.
ATTRIBUTE = re.compile(
    r"\"[^\"]*\"|'[^']*'|([^\s\"'=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'][^\s]*)))?"
)
NAMED = frozenset(("class", "id", "role"))


@dataclass
class Blocks:
    """Blocks that nothing rules out, in page order, and whether an article or main holds each."""

    lines: list[str] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)

    @property
    def main(self) -> list[str]:
        return [x for x, own in zip(self.lines, self.marked, strict=True) if own]

    @property
    def outside(self) -> list[str]:
        return [x for x, own in zip(self.lines, self.marked, strict=True) if not own]


def _ruled_out(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element's attributes say that it is hidden, or that it surrounds articles.

    Articles and what is in them need a whole word (``related``, not ``related-work``); the
    page as a whole surrounds nothing.
    """
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key == "hidden":
            return True
        if key not in NAMED or name in ("html", "body"):
            continue
        value = a or b or c
        if inside or name in MAIN:
            if any(MARKED.fullmatch(word) or COMMENTS.fullmatch(word) for word in value.split()):
                return True
        elif MARKED.search(value):
            return True
    return False


@dataclass(frozen=True)
class _Open:
    """An element that isn't closed yet, and what holds inside it."""

    name: str
    start: int
    skipped: bool = False
    inside: bool = False
    #: Whether it keeps even articles out, if it is closed behind them.
    around: bool = False


class _Closings:
    """Where elements are closed, found for a name when it is asked for."""

    def __init__(self, page: str):
        self.page = page
        self.found: dict[str, dict[int, int]] = {}

    def of(self, element: _Open) -> int:
        """Where ``element`` is closed, -1 if it never is."""
        if element.name not in self.found:
            ends, waiting = self.found.setdefault(element.name, {}), []
            for tag in re.finditer(rf"<(/?){element.name}(?=[\s/>])", self.page, re.I):
                if not tag[1]:
                    waiting.append(tag.start())
                elif waiting:
                    ends[waiting.pop()] = tag.start()
        return self.found[element.name].get(element.start, -1)


def _unwind(stack: list[_Open], name: str, ends: bool) -> None:
    """Leave what a tag ends: elements that only hold text, and the element of an end tag."""
    while stack and stack[-1].name not in CONTAINERS:
        top = stack[-1].name
        closed = ends and top == name
        if not closed and (top in ITEMS and top != name or name not in BLOCKS):
            break
        stack.pop()
        if closed:
            return
    if not ends:
        if stack and stack[-1].name == "head" and name not in HEAD_PARTS:
            stack.pop()
        return
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].name == name:
            del stack[k:]
            return
        if name not in CONTAINERS and stack[k].name in CONTAINERS:
            return


def blocks_of(page: str) -> Blocks:
    """The blocks of a page in order, character references decoded, white space collapsed."""
    found, text = Blocks(), []
    stack: list[_Open] = []
    closings = _Closings(page)
    skipped = inside = False
    at = 0

    def close_block() -> None:
        if text:
            block = " ".join("".join(text).split())
            text.clear()
            if block:
                found.lines.append(block)
                found.marked.append(inside)

    while True:
        match = TAG.search(page, at)
        if not skipped:
            piece = page[at : match.start() if match else len(page)]
            if piece:
                text.append(html.unescape(piece) if "&" in piece else piece)
        if match is None:
            break
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            close_block()
        if stack:
            _unwind(stack, name, bool(match[1]))
        if not match[1] and name not in VOID:
            if name in RAW:
                raw_end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = raw_end.end() if raw_end else len(page)
            else:
                opened = _opened(name, match, stack, closings)
                if opened:
                    stack.append(opened)
        top = stack[-1] if stack else None
        skipped, inside = (top.skipped, top.inside) if top else (False, False)
    close_block()
    return found


def _opened(name: str, tag: re.Match, stack: list[_Open], closings: _Closings) -> _Open | None:
    """What a start tag opens; None for what holds text alone and isn't ruled out."""
    skipped, inside = (stack[-1].skipped, stack[-1].inside) if stack else (False, False)
    start = tag.start()
    if name not in CONTAINERS:
        if skipped or not _ruled_out(name, tag[3], True):
            return None
        return _Open(name, start, True, inside)
    out = name in SKIPPED or name == "header" and not inside or _ruled_out(name, tag[3], inside)
    begins = name in MAIN and not out
    if begins and skipped:
        # An article ends whatever was left open before it, but not what surrounds it.
        begins = not any(e.around and closings.of(e) > start for e in stack)
    around = out and (name in AROUND or name in ("section", "div") and _ruled_out(name, tag[3], True))
    return _Open(name, start, out or skipped and not begins, inside or begins, around)


def common(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    ids: dict = {}
    x = [ids.setdefault(s, len(ids)) for s in a]
    y = [ids.setdefault(s, len(ids)) for s in b]
    marks: set[int] = set()
    _align(x, 0, len(x), y, 0, len(y), marks)
    return marks


#: Cells of an alignment that are kept at a time, one bit each.
CELLS = 1 << 25


def _align(
    x: list[int], x0: int, x1: int, y: list[int], y0: int, y1: int, marks: set[int]
) -> None:
    while x0 < x1 and y0 < y1 and x[x0] == y[y0]:
        marks.add(x0)
        x0, y0 = x0 + 1, y0 + 1
    while x0 < x1 and y0 < y1 and x[x1 - 1] == y[y1 - 1]:
        x1, y1 = x1 - 1, y1 - 1
        marks.add(x1)
    if x0 == x1 or y0 == y1:
        return
    if (x1 - x0) * (y1 - y0) > CELLS and x1 - x0 > 1:
        middle = (x0 + x1) // 2
        ahead = _lengths(x[x0:middle], y[y0:y1])
        behind = _lengths(x[middle:x1][::-1], y[y0:y1][::-1])
        n = y1 - y0
        cut = max(range(n + 1), key=lambda k: ahead[k] + behind[n - k])
        _align(x, x0, middle, y, y0, y0 + cut, marks)
        _align(x, middle, x1, y, y0 + cut, y1, marks)
        return
    rows = list(_rows(x[x0:x1], y[y0:y1]))
    i, j = x1 - x0, y1 - y0
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                marks.add(x0 + i)
                j -= 1


def _rows(x: list[int], y: list[int]):
    """After each of ``x``: an integer whose zero bits are where the common length rises."""
    places: dict[int, int] = {}
    for k, value in enumerate(y):
        places[value] = places.get(value, 0) | 1 << k
    ones = (1 << len(y)) - 1
    row = ones
    for value in x:
        hit = row & places.get(value, 0)
        row = (row + hit | row - hit) & ones
        yield row


def _lengths(x: list[int], y: list[int]) -> list[int]:
    """The common length of ``x`` with every beginning of ``y``."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):
        pass
    lengths = [0]
    for k in range(len(y)):
        lengths.append(lengths[-1] + (not row >> k & 1))
    return lengths
