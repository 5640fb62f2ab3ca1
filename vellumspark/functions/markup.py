"""Markup that may be broken as a stream of tokens, as a tree with spans, and as a list of edits to write back.

Everything else that needs a parser is a consumer of these: blocks, stray closers, duplicate ids, watermarks, packages.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
#: What is no element, by how it begins and ends; the longer openers first.
_SPECIAL = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>"), ("<!", ">"))
_NAME = re.compile(r"<(/?)([A-Za-z][\w:.-]*)")
_REST = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")
#: A document type to its end: quotes, and the internal subset with its comments, instructions and quotes, hide a `>`.
_DOCTYPE = re.compile(r"""<!DOCTYPE(?:[^"'<>\[]|"[^"]*"|'[^']*')*+(?:\[(?:<!--.*?-->|<\?.*?\?>|[^\]"'<]|<|"[^"]*"|'[^']*')*+\]\s*)?>""", re.I | re.S)
_ATTRIBUTE = re.compile(r"""\s+([A-Za-z_][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


@dataclass(slots=True)
class Token:
    """kind: open, empty (an open that closes itself or is void), close, text, raw (inside script or style) or special."""

    kind: str
    name: str
    start: int
    end: int


def tokens(source: str, at: int = 0) -> Iterator[Token]:
    """Tokens in order from a place on, without gaps; a construct that never ends is text to the end of the source."""
    raw = ""
    while at < len(source):
        start = re.compile(rf"</{raw}\b", re.I).search(source, at) if raw else None
        lt = (start.start() if start else -1) if raw else source.find("<", at)
        if lt != at:
            end = lt if lt >= 0 else len(source)
            yield Token("raw" if raw else "text", raw, at, end)
            at = end
            raw = "" if lt >= 0 else raw
            continue
        raw = ""
        special = next((p for p in _SPECIAL if source.startswith(p[0], at)), None) if source[at + 1 : at + 2] in ("!", "?") else None
        name = None if special else _NAME.match(source, at)
        if special:
            declared = _DOCTYPE.match(source, at) if special[0] == "<!" else None
            found = declared.end() - 1 if declared else source.find(special[1], at + len(special[0]))
            end = found + len(special[1]) if found >= 0 else -1
        elif name:
            rest = _REST.match(source, name.end())
            end = rest.end() if rest else source.find(">", name.end()) + 1 or -1
        else:
            yield Token("text", "", at, at + 1)  # a lone <
            at += 1
            continue
        if end < 0:
            yield Token("text", "", at, len(source))
            return
        if special:
            yield Token("special", special[0], at, end)
        else:
            low = name[2].lower()
            kind = "close" if name[1] else "empty" if source[end - 2] == "/" or low in VOID else "open"
            yield Token(kind, low, at, end)
            raw = low if kind == "open" and low in RAW else ""
        at = end


def attributes(source: str, start: int, end: int) -> list[tuple[str, str, int, int, int]]:
    """(name, value, start of the attribute with the space before it, start and end of the value) in a start tag."""
    out = []
    for m in _ATTRIBUTE.finditer(source, start, end):
        which = 2 if m[2] is not None else 3
        out.append((m[1], m[which], m.start(), m.start(which), m.end(which)))
    return out


@dataclass(slots=True)
class Element:
    """An element with the spans of its tags; close and end are -1 where it is never closed."""

    name: str
    start: int
    inner: int
    parent: int
    close: int = -1
    end: int = -1
    texts: list[tuple[int, int]] = field(default_factory=list)


def tree(source: str) -> list[Element]:
    """Elements in document order; texts are the spans of an element's own text. A close tag ends the nearest open
    element of its name, and those inside that are still open stay without an end."""
    found: list[Element] = []
    path: list[int] = []
    for t in tokens(source):
        if t.kind in ("open", "empty"):
            found.append(Element(t.name, t.start, t.end, path[-1] if path else -1))
            if t.kind == "empty":
                found[-1].close = found[-1].end = t.end
            else:
                path.append(len(found) - 1)
        elif t.kind == "close":
            depth = next((k for k in range(len(path) - 1, -1, -1) if found[path[k]].name == t.name), None)
            if depth is not None:
                found[path[depth]].close, found[path[depth]].end = t.start, t.end
                del path[depth:]
        elif t.kind in ("text", "raw") and path:
            found[path[-1]].texts.append((t.start, t.end))
    return found


def ancestors(elements: list[Element], at: int) -> list[int]:
    """From the outermost to the parent."""
    out = []
    while (at := elements[at].parent) >= 0:
        out.append(at)
    return out[::-1]


def cut(source: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """The source with spans replaced; a span that begins inside an earlier one is void."""
    out, at = [], 0
    for start, end, by in sorted(spans):
        if start >= at:
            out += [source[at:start], by]
            at = end
    return "".join([*out, source[at:]])


def escaped(value: str) -> str:
    return value.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")


def edited(source: str, edits: list[tuple[int, str, str | None, str | None]]) -> str:
    """The source after edits (number of an element in document order, action, name, value), byte for byte elsewhere.

    Actions: set and unset an attribute, drop the element with its content, splice it (its tags and what comes before its
    first child of a name in `name`, a list with spaces, go; the children stay), append markup before its end tag.
    """
    elements, spans = tree(source), []
    for at, action, name, value in edits:
        e = elements[at]
        own = {a[0]: a for a in attributes(source, e.start, e.inner)}
        if action == "set" and name in own:
            spans.append((*own[name][3:], escaped(value)))
        elif action == "set":
            head = e.inner - (2 if source[e.inner - 2] == "/" else 1)
            spans.append((head, head, f' {name}="{escaped(value)}"'))
        elif action == "unset" and name in own:
            spans.append((own[name][2], own[name][4] + 1, ""))
        elif action == "drop":
            spans.append((e.start, e.end if e.end >= 0 else e.inner, ""))
        elif action == "splice":
            family = set(name.split())
            first = next((c.start for c in elements[at + 1 :] if c.start < e.close and local(c.name) in family), e.close)
            spans += [(e.start, first, ""), (e.close, e.end, "")]
        elif action == "append" and e.close >= 0:
            spans.append((e.close, e.close, value))
    return cut(source, spans)


def local(name: str) -> str:
    """A name without its prefix, lower case."""
    return name.rpartition(":")[2].lower()
