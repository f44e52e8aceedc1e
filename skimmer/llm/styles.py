"""Style sheets as far as they decide what shows (for operator 1): display, visibility and white-space of an element.

Rules are matched and weighed as the cascade says: importance, then specificity, then order; a style attribute stands above
rules, what the browser itself hides below them. The page is shown on a screen of fixed size, without a pointer.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The window, in pixels, and the pixels of an em.
WIDTH, HEIGHT, EM = 1280.0, 800.0, 16.0

# Keywords of the three properties, and at-rules by what they hold.
KEYWORDS = {
    "display": frozenset("none contents inline inline-block inline-flex inline-grid inline-table block flow-root flex grid list-item table table-row table-cell table-row-group table-header-group table-footer-group table-caption ruby initial inherit unset revert".split()),
    "visibility": frozenset("visible hidden collapse initial inherit unset revert".split()),
    "white-space": frozenset("normal nowrap pre pre-wrap pre-line break-spaces initial inherit unset revert".split()),
}
NESTED = frozenset("media supports layer container scope document".split())
INLINE = frozenset("inline inline-block inline-flex inline-grid inline-table contents ruby".split())

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_STRING = r"\"[^\"\n]*\"|'[^'\n]*'"
_PIECE = re.compile(rf"(?:{_STRING}|[^\"'{{}};])+|[{{}};]|[\"']")
_SIMPLE = re.compile(rf"(?P<tag>[a-z*][\w-]*)|#(?P<id>(?:[\w-]|[^\x00-\x7f]|\\.)+)|\.(?P<cls>(?:[\w-]|[^\x00-\x7f]|\\.)+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<val>{_STRING}|[^\]\s]+)\s*(?P<flag>[is]\s*)?)?\]|:(?P<pseudo>:?[\w-]+)(?:\((?P<arg>[^()]*(?:\([^()]*\)[^()]*)*)\))?", re.I)
_FEATURE = re.compile(r"\(\s*(min|max)-(?:device-)?(width|height)\s*:\s*([\d.]+)\s*(px|em|rem)?\s*\)")
_DECLARATION = re.compile(rf"\s*([\w-]+)\s*:((?:{_STRING}|[^;\"'])*)")


def declarations(body: str) -> dict[str, tuple[str, bool]]:
    """property: (keyword, important) of the properties that matter; what is no keyword of a property does not count."""
    out: dict[str, tuple[str, bool]] = {}
    for name, value in _DECLARATION.findall(body):
        name, value = name.lower(), value.strip().lower()
        if name in KEYWORDS:
            important = value.endswith("important") and value.removesuffix("important").rstrip().endswith("!")
            value = value.split("!")[0].strip()
            if value in KEYWORDS[name] and (important or not out.get(name, ("", False))[1]):
                out[name] = (value, important)
    return out


def shows_on_screen(condition: str) -> bool:
    """Whether a list of media queries holds for a screen of the fixed size."""
    for query in condition.lower().split(","):
        words = query.split("(")[0].split()
        negated = "not" in words
        kind = next((w for w in words if w not in ("not", "only", "and")), "all")
        holds = kind in ("all", "screen")
        for feature in re.findall(r"\([^()]*\)", query):
            m = _FEATURE.match(feature)
            if m:
                have = WIDTH if m[2] == "width" else HEIGHT
                size = float(m[3]) * (EM if m[4] in ("em", "rem") else 1) if m[3].count(".") < 2 else 0.0
                holds &= have >= size if m[1] == "min" else have <= size
            else:
                holds &= bool(re.match(r"\(\s*(?:color|grid\s*:\s*0|scripting\s*:\s*none|orientation\s*:\s*landscape|hover\s*:\s*none|prefers-color-scheme\s*:\s*light|prefers-reduced-motion\s*:\s*no-preference)\s*\)", feature))
        if holds != negated:
            return True
    return False


@dataclass(slots=True)
class Compound:
    """Simple selectors of one element. ``link``: how it stands to the compound before it (' ', '>', '+', '~')."""

    link: str
    tests: list[tuple]


@dataclass(slots=True)
class Rule:
    compounds: list[Compound]
    weight: tuple[int, int, int]
    place: int
    says: dict[str, tuple[str, bool]]


def selector(raw: str) -> tuple[list[Compound], tuple[int, int, int]] | None:
    """The compounds of a selector, left to right, and its specificity; None if it names what no element of a still page is."""
    compounds, a, b, c = [Compound(" ", [])], 0, 0, 0
    at, raw = 0, raw.strip()
    while at < len(raw):
        gap = re.compile(r"\s*([>+~])\s*|\s+").match(raw, at)
        if gap:
            if not compounds[-1].tests:
                return None
            compounds.append(Compound(gap[1] or " ", []))
            at = gap.end()
            continue
        m = _SIMPLE.match(raw, at)
        if not m:
            return None
        at = m.end()
        own = compounds[-1].tests
        plain = lambda s: re.sub(r"\\(.)", r"\1", s)
        if m["tag"]:
            if own:
                return None
            own.append(("tag", m["tag"].lower()))
            c += m["tag"] != "*"
        elif m["id"]:
            own.append(("id", plain(m["id"])))
            a += 1
        elif m["cls"]:
            own.append(("class", plain(m["cls"])))
            b += 1
        elif m["attr"]:
            value = m["val"] or ""
            own.append(("attr", m["attr"].lower(), m["op"], value[1:-1] if value[:1] in "\"'" and value else value, bool(m["flag"]) and m["flag"].strip().lower() == "i"))
            b += 1
        else:
            name = m["pseudo"].lower()
            if name in ("not", "is", "where", "matches"):
                inner = [selector(x) for x in _split(m["arg"] or "")]
                if name == "not" and None in inner:
                    inner = [x for x in inner if x]  # what matches nothing is excluded nowhere
                inner = [x for x in inner if x]
                if not inner and name != "not":
                    return None
                own.append((name == "not" and "not" or "is", [x[0] for x in inner]))
                if name != "where" and inner:
                    most = max(x[1] for x in inner)
                    a, b, c = a + most[0], b + most[1], c + most[2]
            elif name in ("root", "first-child", "last-child", "only-child", "empty", "first-of-type", "last-of-type", "link", "any-link", "enabled", "checked", "disabled"):
                own.append((name,))
                b += 1
            elif name == "nth-child" and (n := re.fullmatch(r"\s*(?:(odd|even)|(\d+)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?)\s*", (m["arg"] or "").lower())):
                step, first = (2, 1) if n[1] == "odd" else (2, 0) if n[1] == "even" else (0, int(n[2])) if n[2] else (int(n[3] + "1" if n[3] in ("", "+", "-") else n[3]), int((n[4] or "+") + (n[5] or "0")))
                own.append(("nth", step, first))
                b += 1
            else:
                return None  # states of a pointer or an input, and parts that are no element
    return (compounds, (a, b, c)) if compounds[-1].tests else None


def _split(raw: str) -> list[str]:
    """The parts between commas, but for commas in brackets and strings."""
    return re.findall(rf"(?:{_STRING}|\([^()]*(?:\([^()]*\)[^()]*)*\)|\[[^\]]*\]|[^,\"'(\[])+", raw)


#: Letters of a nested rule's selectors when written out; they multiply with each list in a list, and none that is meant for readers comes near.
WRITTEN_OUT = 1 << 16


def within(outer: str, inner: str) -> str | None:
    """The selectors of a rule within a rule, written out: its own stand below the outer ones, or hold them where they say ``&``. None if it does not count."""
    at = re.match(r"\s*@(?:-\w+-)?([\w-]+)(.*)", inner, re.S)
    if at:  # a condition within a rule keeps its selectors
        return outer if at[1].lower() in NESTED and (at[1].lower() != "media" or shows_on_screen(at[2])) else None
    if len(inner) * len(outer) >= WRITTEN_OUT:
        return None
    parent = f":is({outer.strip()})"
    first = outer.strip() if len(_split(outer)) == 1 else parent  # one selector in front is itself
    parts = [first + x[1:].replace("&", parent) if x[:1] == "&" else x.replace("&", parent) if "&" in x else f"{first} {x}" for x in map(str.strip, _split(inner))]
    return ", ".join(parts) if 0 < sum(map(len, parts)) < WRITTEN_OUT else None


class Sheet:
    """The rules of a page's style sheets that bear on what shows."""

    def __init__(self, sheets: list[str]):
        self.by: dict[str, list[Rule]] = {}
        self.n = 0
        for sheet in sheets:
            if any(x in sheet for x in ("display", "visibility", "white-space", "DISPLAY", "VISIBILITY", "Display", "Visibility")):
                self._read(_COMMENT.sub(" ", sheet))

    def _read(self, sheet: str) -> None:
        """One pass over the pieces between braces and semicolons. ``open_``: whether each open block counts, or None within declarations."""
        open_: list[bool] = []
        rules: list[tuple[str, list[str]]] = []  # open rules, each within the one before it, with what was read of its declarations
        head, skipped = "", 0
        for piece in _PIECE.findall(sheet):
            if skipped:
                skipped += (piece == "{") - (piece == "}")
            elif rules:
                of, body = rules[-1]
                if piece == "}":
                    self._rule(of, "".join(body))
                    rules.pop()
                elif piece == "{":
                    k = next((k for k in range(len(body), 0, -1) if body[k - 1] == ";"), 0)
                    inner = within(of, "".join(body[k:]))
                    self._rule(of, "".join(body[:k]))
                    body.clear()
                    if inner is None:
                        skipped = 1
                    else:
                        rules.append((inner, []))
                else:
                    body.append(piece)
            elif piece == "{":
                at = re.match(r"\s*@(?:-\w+-)?([\w-]+)(.*)", head, re.S)
                if not at:
                    if all(open_):
                        rules.append((head, []))
                    else:
                        skipped = 1
                elif at[1].lower() in NESTED:
                    open_.append(at[1].lower() != "media" or shows_on_screen(at[2]))
                else:
                    skipped = 1
                head = ""
            elif piece == "}":
                if open_:
                    open_.pop()
                head = ""
            elif piece == ";":
                head = ""
            else:
                head += piece
        while rules:
            of, body = rules.pop()
            self._rule(of, "".join(body))

    def _rule(self, head: str, body: str) -> None:
        says = declarations(body)
        if not says:
            return
        found = [selector(s) for s in _split(head)]
        if None in found and not all(re.search(r":", s) for s, f in zip(_split(head), found) if f is None):
            return  # a list with what is no selector does not count
        for x in found:
            if x:
                self.n += 1
                last = {t[0]: t[1] for t in x[0][-1].tests if t[0] in ("tag", "id", "class")}
                key = f"#{last['id']}" if "id" in last else f".{last['class']}" if "class" in last else last.get("tag", "*")
                self.by.setdefault(key, []).append(Rule(x[0], x[1], self.n, says))

    def of(self, node) -> dict[str, str]:
        """What rules and the style attribute say about an element, by property."""
        own = node.attributes
        best: dict[str, tuple] = {}
        if self.by:
            keys = [node.tag, "*", *(f".{x}" for x in set(own.get("class", "").split())), f"#{own['id']}" if own.get("id") else ""]
            for rule in (r for k in keys if k in self.by for r in self.by[k]):
                news = {p: ((i, False, rule.weight, rule.place), v) for p, (v, i) in rule.says.items()}
                if any(p not in best or x > best[p] for p, x in news.items()) and matches(rule.compounds, node):
                    for p, x in news.items():
                        best[p] = max(best.get(p, x), x)
        for p, (v, i) in (declarations(own["style"]) if own.get("style") else {}).items():
            x = ((i, True, (0, 0, 0), 0), v)
            best[p] = max(best.get(p, x), x)
        return {p: v for p, (_, v) in best.items()}


def matches(compounds: list[Compound], node, known: dict | None = None) -> bool:
    """Whether an element is the last compound's, with the others where their links say. Each compound looks at an element once."""
    known = {} if known is None else known
    key = (len(compounds), id(node))
    if key not in known:
        known[key] = _is(compounds[-1].tests, node) and (len(compounds) == 1 or _stands(compounds, node, known))
    return known[key]


def _stands(compounds: list[Compound], node, known: dict) -> bool:
    rest, link, up = compounds[:-1], compounds[-1].link, node.parent
    if up is None:
        return False
    if link == ">":
        return matches(rest, up, known)
    if link == "+":
        return node.place > 0 and matches(rest, up.elements[node.place - 1], known)
    if link == "~":
        return any(matches(rest, x, known) for x in up.elements[: node.place])
    while up is not None:
        if matches(rest, up, known):
            return True
        up = up.parent
    return False


def _is(tests: list[tuple], node) -> bool:
    own = node.attributes
    for t in tests:
        kind = t[0]
        if kind == "tag":
            ok = t[1] in ("*", node.tag)
        elif kind == "id":
            ok = own.get("id") == t[1]
        elif kind == "class":
            ok = t[1] in own.get("class", "").split()
        elif kind == "attr":
            have, (_, name, op, value, fold) = own.get(t[1]), t
            if have is not None and fold:
                have, value = have.lower(), value.lower()
            ok = have is not None and (
                op is None or op == "=" and have == value or op == "~=" and value in have.split() or op == "|=" and (have == value or have.startswith(value + "-"))
                or bool(value) and (op == "^=" and have.startswith(value) or op == "$=" and have.endswith(value) or op == "*=" and value in have)
            )
        elif kind == "not":
            ok = not any(matches(x, node) for x in t[1])
        elif kind == "is":
            ok = any(matches(x, node) for x in t[1])
        elif kind == "root":
            ok = node.parent is None
        elif kind == "empty":
            ok = not node.children
        elif kind in ("link", "any-link"):
            ok = node.tag in ("a", "area") and "href" in own
        elif kind in ("checked", "disabled"):
            ok = kind in own
        elif kind == "enabled":
            ok = node.tag in ("input", "button", "select", "textarea", "option") and "disabled" not in own
        else:
            k, n = (node.place, len(node.parent.elements)) if node.parent is not None else (0, 1)
            if kind.endswith("of-type"):
                k, n = (node.kin, node.parent.kinds[node.tag]) if node.parent is not None else (0, 1)
            if kind == "nth":
                step, first = t[1], t[2]
                ok = k + 1 == first if not step else (k + 1 - first) % step == 0 and (k + 1 - first) // step >= 0
            else:
                ok = (k == 0 or not kind.startswith(("first", "only"))) and (k == n - 1 or not kind.startswith(("last", "only")))
        if not ok:
            return False
    return True
