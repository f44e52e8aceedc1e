"""Papers published as HTML, read in one pass over their tags.

Elements are followed on a stack, so sections may hold sections and elements may lack their end: an end tag closes what was opened after its
partner, a paragraph ends where the next paragraph, heading or section begins. What is picked (title, authors, abstract, headings and paragraphs of
sections) is gathered as it comes; time is in proportion to the page, whatever is left open.
"""

from __future__ import annotations

import re

# Class names of the page format, and the entities in the order in which they are decoded.
CLASSES = {"title": "ltx_title_document", "authors": "ltx_authors", "abstract": "ltx_abstract", "navbar": "ltx_page_navbar", "toc": "ltx_TOC", "pages": "ltx_pagination", "bibliography": "ltx_bibliography", "entry": "ltx_bibitem"}
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")]

#: Elements whose content is no markup.
RAW = {"script", "style", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {f"h{k}" for k in range(1, 7)}
_TOKEN = re.compile(r"<!--|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>|<[!?/][^<>]*>")
_ATTRIBUTE = re.compile(r"""([A-Za-z:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def plain(parts: list[str]) -> str:
    """Text without tags: entities decoded, the ampersand first, runs of white space one space."""
    text = "".join(parts)
    if "&" in text:
        for name, sign in ENTITIES:
            text = text.replace(name, sign)
    return _SPACE.sub(" ", text).strip(" ")


class Section:
    """A section's heading and what follows it, sections in it included."""

    def __init__(self):
        self.heading: str | None = None
        self.items: list[str | Section] = []

    def blocks(self) -> list[str]:
        out, open_ = [], [iter([self])]
        while open_:
            item = next(open_[-1], None)
            if item is None:
                open_.pop()
            elif isinstance(item, Section):
                out += [item.heading] if item.heading else []
                open_.append(iter(item.items))
            else:
                out.append(item)
        return out


class Paper:
    """What one pass over a page picks: ``title``, ``authors``, ``abstract`` (texts, or None) and ``sections``."""

    def __init__(self, page: str, no_references: bool = False):
        self.title = self.authors = self.abstract = None
        self.sections = Section()
        self.no_references = no_references
        self._open: list[tuple[str, str | None]] = []  # (tag, part that it is)
        self._count: dict[str, int] = {}
        self._own: list[Section] = [self.sections]
        self._gathered: dict[str, list[str]] = {}
        self._dropped = 0
        self._formula: list[str] | None = None
        self._tex: str | None = None
        self._note: list[str] | None = None
        self._read(page)
        while self._open:
            self._close()

    def _read(self, page: str) -> None:
        at, ends = 0, {}  # ends: closing marks that don't come any more
        while m := _TOKEN.search(page, at):
            self._text(page[at : m.start()])
            at = m.end()
            if m[0] == "<!--":
                end = -1 if "-->" in ends else page.find("-->", at)
                if end < 0:
                    ends["-->"] = True
                    self._text(m[0])
                else:
                    at = end + 3
            elif not m[2]:
                self._text(" ")
            elif m[1]:
                self._end(m[2].lower())
            else:
                tag = m[2].lower()
                if tag in RAW:  # with its content, if it has an end; else it is a mark like others
                    close = ends.get(tag) or re.compile(rf"</{tag}\s*>", re.I)
                    found = close.search(page, at) if ends.get(tag) is not False else None
                    ends[tag] = close if found else False
                    at = found.end() if found else at
                    self._text("" if found else " ")
                else:
                    self._start(tag, m[3])
        self._text(page[at:])

    def _text(self, text: str) -> None:
        if not text or self._dropped:
            return
        if self._note is not None:
            self._note.append(text)
        if self._formula is not None:
            self._formula.append(text)
            return
        for parts in self._gathered.values():
            parts.append(text)

    def _part(self, tag: str, attributes: str) -> str | None:
        """What an element is to this reading."""
        own = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        css = own.get("class", "")
        if tag == "footer" or (tag == "nav" and (CLASSES["navbar"] in css or CLASSES["toc"] in css)) or (tag == "div" and CLASSES["pages"] in css):
            return "dropped"
        if self.no_references and ((tag == "section" and CLASSES["bibliography"] in css) or (tag in ("div", "li") and CLASSES["entry"] in css) or (tag == "a" and own.get("href", "").startswith("#bib"))):
            return "dropped"
        if self._dropped:
            return None
        if tag == "math":
            return "math" if self._formula is None else None
        if tag == "annotation":
            return "tex" if self._formula is not None and self._tex is None and self._note is None and own.get("encoding") == "application/x-tex" else None
        if tag == "section":
            return "section"
        for part, tags in (("title", None), ("authors", ("div",)), ("abstract", ("div",))):
            if CLASSES[part] in css and (tags is None or tag in tags) and getattr(self, part) is None and part not in self._gathered:
                return part
        if len(self._own) > 1:
            if tag in HEADINGS and self._own[-1].heading is None and "heading" not in self._gathered:
                return "heading"
            if tag == "p":
                return "paragraph"
        return None

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("p", "section") or tag in HEADINGS:
            if self._count.get("p"):
                self._end("p")
        if tag in VOID or attributes.endswith("/"):
            self._text(" ")
            return
        part = self._part(tag, attributes)
        if part != "math":
            self._text(" ")
        if part == "dropped":
            self._dropped += 1
        elif part == "math":
            self._formula, self._tex = [], None
        elif part == "tex":
            self._note = []
        elif part == "section":
            new = Section()
            self._own[-1].items.append(new)
            self._own.append(new)
        elif part:
            self._gathered[part] = []
        self._open.append((tag, part))
        self._count[tag] = self._count.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        """Closes the innermost open element of this tag, and what was opened after it; an end without a beginning is a mark like others."""
        if not self._count.get(tag):
            self._text(" ")
            return
        while self._close() != tag:
            pass

    def _close(self) -> str:
        tag, part = self._open.pop()
        self._count[tag] -= 1
        if part == "dropped":
            self._dropped -= 1
        elif part == "math":
            shown, self._formula = self._formula if self._tex is None else [f"${self._tex}$"], None
            self._text("".join(shown))
        elif part == "tex":
            self._tex, self._note = "".join(self._note).strip(), None
        elif part == "section":
            self._own.pop()
        elif part == "heading":
            self._own[-1].heading = plain(self._gathered.pop(part))
        elif part == "paragraph":
            if text := plain(self._gathered.pop(part)):
                self._own[-1].items.append(text)
        elif part:
            setattr(self, part, plain(self._gathered.pop(part)))
        if part != "math":
            self._text(" ")
        return tag

    def names(self) -> str:
        """Authors, joined by ', '; pieces of 80 bytes or more or with an address go."""
        pieces = [x.strip(" ") for x in re.split(", | and ", self.authors or "")]
        return ", ".join(x for x in pieces if x and len(x.encode()) < 80 and "@" not in x)

    def text(self) -> str:
        """Title, authors, abstract and the sections' blocks, with blank lines between."""
        names = self.names()
        head = [self.title, names and f"Authors: {names}", self.abstract and f"Abstract\n{self.abstract}"]
        return "\n\n".join([x for x in head if x] + self.sections.blocks())
