"""HTML extraction (operator 1): layout-aware rendering of the visible text of pages.

A page becomes a tree, with the tags that HTML leaves out (html, head, body, tbody, tr, ends of p, li, td and so on), and
the tree is laid out: white space collapses as a browser's does, blocks stand on lines of their own with
blank lines where their margins are, list items get markers and indents, and the cells of a table line up.

What is hidden is left out: the head, scripts, styles, templates, comments, and elements that an attribute, a style of their own
or the page's style sheets hide, by the cascade of ``styles``.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimmer.llm.shared import slices, small_batches
from skimmer.llm.styles import INLINE, KEYWORDS, Sheet, shows_on_screen

# Element names by their part in parsing and layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title datalist rp param source track audio video canvas object embed area base link meta col colgroup".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split())
BLOCKS = CLOSE_P | frozenset("html body caption legend optgroup option tr tbody thead tfoot td th".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl menu dir pre figure table hr fieldset".split())
TABLE_PARTS = frozenset("caption col colgroup tbody td tfoot th thead tr".split())
LISTS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag ends if it is open, and where looking for it stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "td": ({"td", "th", "caption"}, {"table"}),
    "th": ({"td", "th", "caption"}, {"table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup", "tbody"}, {"table"}),
}

_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([^\s/=>\"'][^\s/=>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str]
    children: list = field(default_factory=list)
    # set when the tree is whole: where an element stands, among all of its parent's and among those of its name
    parent: Node | None = None
    elements: list | None = None
    kinds: dict[str, int] | None = None
    place: int = 0
    kin: int = 0


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c) if a or b or c else "")
    return out


class Builder:
    """Builds the tree of one page; ``styles`` are the texts of its style sheets."""

    def __init__(self):
        self.root = Node("html", {})
        self.stack = [self.root]
        self.names = ["html"]
        self.places = defaultdict(list, html=[0])  # of each name, where its open elements stand in the stack
        self.styles: list[str] = []

    def tree(self) -> Node:
        """The root, with every element's place in the tree."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            node.elements, node.kinds = [x for x in node.children if not isinstance(x, str)], {}
            for k, child in enumerate(node.elements):
                child.parent, child.place, child.kin = node, k, node.kinds.get(child.tag, 0)
                node.kinds[child.tag] = child.kin + 1
            stack += node.elements
        return self.root

    def _push(self, node: Node) -> None:
        self._place().append(node)
        self._enter(node)

    def _enter(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)
        self.names.append(node.tag)

    def _pop_to(self, at: int) -> None:
        for name in self.names[at:]:
            self.places[name].pop()
        del self.stack[at:], self.names[at:]

    def _find(self, wanted: frozenset | set, stop: frozenset | set) -> int:
        """Where the innermost open element of ``wanted`` is, or 0."""
        found = max((self.places[tag][-1] for tag in wanted if self.places[tag]), default=0)
        return 0 if any(self.places[tag] and self.places[tag][-1] > found for tag in stop) else found

    def _place(self, fits: bool = True) -> list:
        """Where the next child goes; what does not fit between a table's cells goes before the table."""
        if fits or self.names[-1] not in ("table", "tbody", "thead", "tfoot", "tr"):
            return self.stack[-1].children
        if not self.places["table"]:
            return self.stack[-1].children
        k = self.places["table"][-1]
        above = self.stack[k - 1].children
        before = next((i for i in range(len(above) - 1, -1, -1) if above[i] is self.stack[k]), len(above))
        holder = Node("span", {})
        above.insert(before, holder)
        return holder.children

    def body(self) -> None:
        """Opens the body, if a page did not say so."""
        if len(self.names) < 2 or self.names[1] != "body":
            self._pop_to(1)
            old = next((x for x in self.root.children if isinstance(x, Node) and x.tag == "body"), None)
            if old is not None:  # text after its end belongs to it all the same
                self._enter(old)
            else:
                self._push(Node("body", {}))

    def text(self, s: str) -> None:
        if not s:
            return
        blank = not s.strip(" \t\n\f\r")
        if len(self.names) < 2 or self.names[-1] == "head":
            if blank:
                return
            self.body()
        elif self.names[-1] == "colgroup" and not blank:
            self._pop_to(len(self.names) - 1)
        self._place(blank).append(html.unescape(s) if "&" in s else s)

    def open(self, tag: str, raw: str) -> str:
        """Adds an element; returns its name if its content is raw text."""
        names = self.names
        if tag in ("html", "body", "head"):
            own = _attributes(raw)
            if tag == "html":
                self.root.attributes = own | self.root.attributes
            elif tag == "head":
                if len(names) == 1 and not self.root.children:
                    self._push(Node("head", own))
            else:
                self.body()
                self.stack[1].attributes = own | self.stack[1].attributes
            return ""
        if tag in TABLE_PARTS and not self.places["table"]:
            return ""
        if names[-1] == "head" or len(names) < 2:
            if tag not in HEAD_ONLY:
                self.body()
            elif len(names) < 2 and not any(isinstance(x, Node) and x.tag == "body" for x in self.root.children):
                if self.root.children and self.root.children[-1].tag == "head":
                    self._enter(self.root.children[-1])
                else:
                    self._push(Node("head", {}))
            elif len(names) < 2:
                self.body()
        if tag in CLOSE_P and self.places["p"]:
            k = self._find({"p"}, {"table", "td", "th", "caption", "button", "object", "template"})
            if k:
                self._pop_to(k)
        if tag in ENDS:
            closes, stop = ENDS[tag]
            while k := self._find(closes, stop):
                self._pop_to(k)
        if tag in HEADINGS and names[-1] in HEADINGS:
            self._pop_to(len(names) - 1)
        if tag == "a" and (k := self._find({"a"}, {"table", "td", "th", "caption", "button", "object", "template"})):
            self._pop_to(k)
        fits = True
        if names[-1] in ("table", "tbody", "thead", "tfoot", "tr"):
            if tag in ("td", "th"):
                if names[-1] == "table":
                    self._push(Node("tbody", {}))
                if self.names[-1] != "tr":
                    self._push(Node("tr", {}))
            elif tag == "tr":
                if names[-1] == "table":
                    self._push(Node("tbody", {}))
            else:
                fits = tag in ("tbody", "thead", "tfoot", "caption", "colgroup", "col", "script", "style", "template", "form", "table") or tag == "input" and "hidden" in raw
        elif tag == "tr" and self._find({"table"}, {"td", "th", "caption"}):
            while names[-1] not in ("tbody", "thead", "tfoot", "table"):
                self._pop_to(len(names) - 1)
            if names[-1] == "table":
                self._push(Node("tbody", {}))
        elif tag in ("td", "th") and self._find({"tr"}, {"table", "td", "th", "caption"}):
            while names[-1] != "tr":
                self._pop_to(len(names) - 1)
        node = Node(tag, _attributes(raw) if raw.strip("/ \t\n\f\r") else {})
        if tag in VOID:
            self._place(fits).append(node)
            return ""
        if fits:
            self._push(node)
        else:
            self._place(False).append(node)
            self._enter(node)
        return tag if tag in RAW or tag in RCDATA else ""

    def close(self, tag: str) -> None:
        names = self.names
        if tag == "br":
            self._place(False).append(Node("br", {}))
        elif tag == "head":
            if self.places["head"]:
                self._pop_to(self.places["head"][0])
        elif tag not in ("html", "body"):  # what comes after their end tags belongs to the body
            stop = set() if tag in ("table", "td", "th", "tr", "tbody", "thead", "tfoot", "caption") else {"table", "td", "th", "caption"}
            if tag in HEADINGS:
                k = self._find(HEADINGS, stop)
            elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
                k = self._find({tag}, {"table"})
            else:
                k = self._find({tag}, stop - {tag})
            if k:
                self._pop_to(k)


def parse(page: str) -> Builder:
    """The tree of a page. Any text is a page: tags that are never closed, cut off or out of place are mended as browsers do."""
    tree = Builder()
    end = page.rfind(">") + 1
    at = 0
    while at < end:
        m = _TOKEN.search(page, at, end)
        if m is None:
            break
        tree.text(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith(">"):
            return tree  # a comment without end hides the rest
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            tree.close(tag)
        elif raw := tree.open(tag, m[3] or ""):
            stop = re.compile(rf"</{re.escape(raw)}[\s/>]", re.I).search(page, at)
            inside = page[at : stop.start() if stop else len(page)]
            if len(tree.stack) > 1 and tree.stack[-1].tag == raw:
                if raw in RCDATA:
                    inside = html.unescape(inside)
                if raw == "style":
                    if shows_on_screen(tree.stack[-1].attributes.get("media") or "all"):
                        tree.styles.append(inside)
                elif inside:
                    tree.stack[-1].children.append(inside)
            if stop is None:
                return tree
            at = stop.start()
    rest = page[at:]
    if rest:  # an unfinished tag or comment at the end is dropped
        cut = re.search(r"<[A-Za-z/!?]", rest)
        tree.text(rest[: cut.start()] if cut else rest)
    return tree


class Hidden:
    """What shows of an element: its style sheets' say, and above all what a browser never shows."""

    def __init__(self, styles: list[str]):
        self.sheet = Sheet(styles)

    def of(self, node: Node) -> tuple[str, dict[str, str]]:
        """('none', 'hidden', 'visible' or '', what its styles say)."""
        tag, own = node.tag, node.attributes
        if tag in UNSEEN or tag == "input" and own.get("type", "").lower() == "hidden":
            return "none", {}
        says = self.sheet.of(node) if self.sheet.by or "style" in own else {}
        display = says.get("display", "")
        if display == "none" or (not display or display == "revert") and ("hidden" in own or tag == "dialog" and "open" not in own):
            return "none", says
        seen = says.get("visibility", "")
        return "hidden" if seen in ("hidden", "collapse") else "visible" if seen in ("visible", "initial") else "", says


def width(s: str) -> int:
    """Columns that a line takes: wide characters two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _number(raw: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", raw or "")
    return int(m[1]) if m else default


def marker(kind: str, n: int) -> str:
    """The marker of the n-th item of a list of the kind that its type attribute names."""
    if kind in ("a", "A") and n > 0:
        s = ""
        while n:
            n, r = divmod(n - 1, 26)
            s = chr(97 + r) + s
        return (s.upper() if kind == "A" else s) + "."
    if kind in ("i", "I") and 0 < n < 4000:
        s, n = "m" * (n // 1000), n % 1000
        for value, signs in ((100, "cdm"), (10, "xlc"), (1, "ivx")):
            d, n = divmod(n, value)
            one, five, ten = signs
            s += one + ten if d == 9 else one + five if d == 4 else five * (d >= 5) + one * (d % 5)
        return (s.upper() if kind == "I" else s) + "."
    return f"{n}."


class Flow:
    """Lines of one block context. ``gap``: line ends that are due before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0

    def word(self, s: str) -> None:
        """Text that is collapsed as white space asks; ``s`` has single spaces only."""
        if not s:
            return
        if s[0] == " ":
            self.space, s = True, s[1:]
            if not s:
                return
        if self.gap:
            self._end()
        if self.space and self.now:
            self.now.append(" ")
        self.space = s[-1] == " "
        self.now.append(s[:-1] if self.space else s)

    def _end(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        if self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap, self.space = 0, False

    def block(self, blank: bool) -> None:
        """A block begins or ends: the next text stands on a new line, after a blank one if asked for."""
        if self.now or self.lines:
            self.gap = max(self.gap, 2 if blank else 1)
        self.space = False

    def line(self) -> None:
        """A forced line end."""
        if self.gap:
            self._end()
        self.lines.append("".join(self.now).rstrip(" "))
        self.now, self.space = [], False

    def put(self, lines: list[str]) -> None:
        """Whole lines."""
        if lines:
            self.gap = max(self.gap, 1) if self.now else self.gap
            self._end()
            self.lines += lines[:-1]
            self.now = [lines[-1]]
            self.gap = 1

    def end(self) -> list[str]:
        self.gap = 1 if self.now else 0
        self._end()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        k = 0
        while k < len(lines) and not lines[k]:
            k += 1
        return lines[k:]


Steps = Generator["Steps", list[str], list[str] | None]


def walked(first: Steps) -> list[str] | None:
    """What ``first`` returns. The steps that a step yields are run on a stack of their own, so that elements may be nested at will."""
    stack, made = [first], None
    while stack:
        try:
            step = stack[-1].send(made)
        except StopIteration as end:
            stack.pop()
            made = end.value
        else:
            stack.append(step)
            made = None
    return made


class Renderer:
    """Lays out a tree; its methods are steps for ``walked``."""

    def __init__(self, hidden: Hidden):
        self.hidden = hidden
        self.lists = 0  # around the present element: lists in lists have no margins

    def block(self, node: Node, seen: bool, kept: bool) -> Steps:
        flow = Flow()
        yield self.inside(node, flow, seen, kept)
        return flow.end()

    def inside(self, node: Node, flow: Flow, seen: bool, kept: bool) -> Steps:
        """``seen``: whether text shows; ``kept``: whether white space is kept."""
        for child in node.children:
            if isinstance(child, str):
                if not seen:
                    continue
                if kept:
                    first, *more = child.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                    for k, s in enumerate([first, *more]):
                        if k:
                            flow.line()
                        if s:
                            if flow.gap:
                                flow._end()
                            flow.now.append(s)
                else:
                    flow.word(_SPACE.sub(" ", child))
            else:
                yield self.element(child, flow, seen, kept)

    def element(self, node: Node, flow: Flow, seen: bool, kept: bool) -> Steps:
        tag = node.tag
        how, says = self.hidden.of(node)
        if how == "none":
            return
        seen = how == "visible" or seen and how != "hidden"
        if tag == "br":
            if seen:
                flow.line()
            return
        if tag == "input":
            if seen and node.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                flow.word(_SPACE.sub(" ", node.attributes.get("value", "")))
            return
        if tag == "details" and "open" not in node.attributes:
            node = Node(tag, node.attributes, [x for x in node.children if isinstance(x, Node) and x.tag == "summary"][:1])
        space, display = says.get("white-space", ""), says.get("display", "")
        kept = space in ("pre", "pre-wrap", "pre-line", "break-spaces") if space not in ("", "inherit", "unset") else kept or tag in ("pre", "textarea", "xmp")
        if display in KEYWORDS["display"] and display not in INLINE and display not in ("initial", "inherit", "unset", "revert") and tag not in BLOCKS:
            flow.block(False)
            yield self.inside(node, flow, seen, kept)
            flow.block(False)
            return
        if tag not in BLOCKS or display in INLINE and tag not in LISTS and tag != "table":
            yield self.inside(node, flow, seen, kept)
            return
        spaced = tag in SPACED and not (tag in LISTS and self.lists)
        flow.block(spaced)
        if tag in LISTS:
            self.lists += 1
            yield self.items(node, flow, seen, kept)
            self.lists -= 1
        elif tag == "table":
            flow.put((yield self.table(node, seen, kept)))
        elif tag in ("blockquote", "dd"):
            flow.put([f"  {x}" if x else x for x in (yield self.block(node, seen, kept))])
        elif tag in ("pre", "xmp"):
            if node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                node = Node(tag, node.attributes, [node.children[0][1:], *node.children[1:]])
            flow.put((yield self.block(node, seen, kept)))
        else:
            yield self.inside(node, flow, seen, kept)
        flow.block(spaced)

    def items(self, node: Node, flow: Flow, seen: bool, kept: bool) -> Steps:
        """Each item after its marker, its further lines under its first."""
        own = [x for x in node.children if isinstance(x, Node) and x.tag == "li"]
        down = "reversed" in node.attributes
        n = _number(node.attributes.get("start"), len(own) if down else 1)
        for child in node.children:
            if isinstance(child, str):
                if seen:
                    flow.word(_SPACE.sub(" ", child))
                continue
            how, _ = self.hidden.of(child)
            if child.tag != "li" or how == "none":
                yield self.element(child, flow, seen, kept)
                continue
            n = _number(child.attributes.get("value"), n)
            mark = marker(child.attributes.get("type", node.attributes.get("type", "1")), n) if node.tag == "ol" else "-"
            n += -1 if down else 1
            shows = how == "visible" or seen and how != "hidden"
            lines = yield self.block(child, shows, kept)
            if lines:
                flow.block(False)
                flow.put([f"{mark} {lines[0]}" if shows else lines[0], *(f"{' ' * (len(mark) + 1)}{x}" if x else x for x in lines[1:])])
                flow.block(False)

    def table(self, node: Node, seen: bool, kept: bool) -> Steps:
        """Captions, then the rows: cells of a column begin at the same place. Rows that a cell spans keep its column free."""
        lines: list[str] = []
        heads: list[tuple] = []
        bodies: list[tuple] = []
        feet: list[tuple] = []

        def rows(of: Node, seen: bool, into: list[tuple]) -> Steps:
            for child in of.children:
                if isinstance(child, str):
                    if seen and child.strip():
                        into.append((None, [_SPACE.sub(" ", child).strip()], seen))
                    continue
                how, _ = self.hidden.of(child)
                if how == "none":
                    continue
                shows = how == "visible" or seen and how != "hidden"
                if child.tag == "tr":
                    into.append((child, None, shows))
                elif child.tag in ("tbody", "thead", "tfoot"):
                    yield rows(child, shows, {"thead": heads, "tfoot": feet}.get(child.tag, bodies))
                elif child.tag == "caption":
                    lines.extend((yield self.block(child, shows, kept)))
                else:
                    flow = Flow()
                    yield self.element(child, flow, shows, kept)
                    if own := flow.end():
                        into.append((None, own, shows))

        yield rows(node, seen, bodies)
        laid: list[list[tuple[int, int, list[str]]] | list[str]] = []
        busy: dict[int, int] = {}  # column: rows for which a cell above still spans it
        widths: dict[int, int] = {}
        for row, own, shows in heads + bodies + feet:
            if row is None:
                laid.append(own)
                continue
            cells, at = [], 0
            for cell in row.children:
                if isinstance(cell, str):
                    if shows and cell.strip():
                        cells.append((at, 1, [_SPACE.sub(" ", cell).strip()]))
                        at += 1
                    continue
                how, _ = self.hidden.of(cell)
                if how == "none":
                    continue
                while busy.get(at, 0) > 0:
                    at += 1
                span = min(max(1, _number(cell.attributes.get("colspan"), 1)), 1000)
                down = _number(cell.attributes.get("rowspan"), 1)
                text = yield self.block(cell, how == "visible" or shows and how != "hidden", kept)
                cells.append((at, span, text))
                for k in range(at, at + span) if down != 1 else ():
                    busy[k] = down if down > 0 else 1 << 30  # 0: all rows that follow
                at += span
            for k in list(busy):
                busy[k] -= 1
                if busy[k] <= 0:
                    del busy[k]
            laid.append(cells)
            for c, span, text in cells:
                w = max((width(x) for x in text), default=0)
                if span == 1:
                    widths[c] = max(widths.get(c, 0), w)
                else:
                    widths.setdefault(c, 0)
        places, x = {}, 0
        for c in sorted(widths):
            places[c] = x
            x += widths[c] + 2 if widths[c] else 0
        for row in laid:
            if row and isinstance(row[0], str):
                lines += row
                continue
            high = max((len(text) for _, _, text in row), default=0)
            for k in range(high):
                out, used = [], 0
                for c, _, text in row:
                    s = text[k] if k < len(text) else ""
                    if s:
                        pad = max(places[c] - used, 2 if used else 0)
                        out.append(" " * pad + s)
                        used += pad + width(s)
                lines.append("".join(out).rstrip(" "))
        return lines


def render(page: str | None) -> str | None:
    """The visible text of a page, lines apart by line ends. Null for null; an empty page, or one that shows nothing, gives ''.

    Elements may be nested at will. A column is as wide as its widest cell, so the lines of a table may be longer than its texts: memory is in proportion to what is laid out.
    """
    if page is None:
        return None
    tree = parse(page)
    flow = Flow()
    walked(Renderer(Hidden(tree.styles)).element(tree.tree(), flow, True, False))
    return "\n".join(flow.end()).replace("\x00", "�")


def extract_text(pages: DataFrame, html_column: str = "html", text_column: str = "text") -> DataFrame:
    """``pages`` with ``text_column``, the visible text of ``html_column``; a column of that name is replaced.

    Each page is rendered by itself, whole. Repeated rows stay. A null page has a null text. An empty table gives an empty result.
    """

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages_ in batches:
            yield pa.array([render(p.as_py()) for part in slices(pages_) for p in part], pa.string())

    small_batches(pages.sparkSession)

    return pages.withColumn(text_column, text(F.col(html_column).cast("string")))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return extract_text(pages).select("page_id", "text", F.char_length("text").cast("long").alias("n_chars"))
