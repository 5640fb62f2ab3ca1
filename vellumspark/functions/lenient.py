"""A document that no XML parser takes, read as a browser would and written as XHTML.

The tree is built from the tokens that everything else uses: implied end tags, elements that are never closed, inline
elements that are closed out of order, void and raw elements. It is the last resort, as it writes the whole document anew;
one that parses, that has no <html>, or whose text would come out otherwise stays as it is.
"""

from __future__ import annotations

import html
import re

from vellumspark.functions import markup
from vellumspark.functions.kernels import is_well_formed

XHTML = "http://www.w3.org/1999/xhtml"
#: What ends an open <p>; inline elements that go on inside the next block; elements that belong in a head.
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul dt dd".split())
INLINE = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEAD = frozenset("base link meta noscript script style template title".split())
#: An element that starts ends an open one of these, unless one of those stands between.
ENDS = {
    "li": (("li",), ("ol", "ul")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tr", "td", "th", "tbody", "thead"), ("table",)), "body": (("head",), ()),
}
_LOOSE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>`]+))?""")
_NAME = re.compile(r"[A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?")
_ILLEGAL = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def escaped(text: str) -> str:
    return _ILLEGAL.sub("", text).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def start_tag(source: str, t: markup.Token, name: str, declared: frozenset[str]) -> str:
    """The tag with every attribute once, quoted; one that is no XML name, or whose prefix nothing declares, goes."""
    seen: dict[str, str] = {}
    for m in _LOOSE.finditer(source, t.start + 1 + len(t.name), t.end - 1):
        own, value = m[1], m[2] if m[2] is not None else m[1]
        prefix, colon, _ = own.partition(":")
        if _NAME.fullmatch(own) and own not in seen and (not colon or prefix in declared) and not (own == "xmlns" and name == "html"):
            seen[own] = html.unescape(value[1:-1] if value[:1] in "\"'" and len(value) > 1 else value)
    if name == "html":
        seen = {"xmlns": XHTML} | seen
    return f"<{name}" + "".join(f' {k}="{escaped(v)}"'.replace("\n", " ") if '"' not in v else f" {k}='{escaped(v)}'" if "'" not in v else f' {k}="{escaped(v).replace(chr(34), "&quot;")}"' for k, v in seen.items()) + ">"


class Builder:
    """Open elements and what is written so far; every element that is opened is closed."""

    def __init__(self, source: str):
        self.source, self.out = source, []
        self.open: list[tuple[str, str]] = []  # name, start tag
        self.declared = frozenset(("xml", "xmlns", *re.findall(r"xmlns:([\w.-]+)\s*=", source)))
        self.root, self.headed, self.bodied = "", False, False

    def names(self) -> list[str]:
        return [n for n, _ in self.open]

    def push(self, name: str, tag: str) -> None:
        self.open.append((name, tag))
        self.out.append(tag)

    def pop_to(self, at: int) -> None:
        while len(self.open) > at:
            self.out.append(f"</{self.open.pop()[0]}>")

    def ready(self, name: str) -> None:
        """html, and head or body around what comes."""
        if not self.open:
            self.push("html", self.root or f'<html xmlns="{XHTML}">')
        if name in ("head", "body"):
            return
        if name in HEAD and not self.bodied:
            if not self.headed:
                self.headed = True
                self.push("head", "<head>")
        elif not self.bodied:
            self.pop_to(1)
            if not self.headed:
                self.out.append("<head></head>")
            self.headed = self.bodied = True
            self.push("body", "<body>")

    def start(self, t: markup.Token) -> None:
        # A prefixed name, and one inside a drawing or a formula, keeps its case.
        name = t.name if not {"svg", "math"} & {*self.names()} else self.source[t.start + 1 : t.start + 1 + len(t.name)]
        tag = start_tag(self.source, t, name, self.declared)
        if ":" in name and name.partition(":")[0] not in self.declared:
            return
        if t.name == "html":
            if not self.open:
                self.root = tag
                self.push("html", tag)
            return
        if t.name in ("head", "body"):
            self.ready(t.name)
            if (t.name == "head" and self.headed) or (t.name == "body" and self.bodied):
                return
            if t.name == "body" and not self.headed:
                self.out.append("<head></head>")
            self.pop_to(1)
            self.headed, self.bodied = True, self.bodied or t.name == "body"
            if t.kind != "empty":
                self.push(t.name, tag)
            return
        self.ready(t.name)
        ended, barrier = ENDS.get(t.name, ((), ()))
        for at in range(len(self.open) - 1, 1, -1):
            own = self.open[at][0]
            if own in barrier or (own in BLOCKS - {"p"} and own not in ended and t.name not in ENDS):
                break
            if own in ended or (own == "p" and t.name in BLOCKS):
                self.pop_to(at)
        if t.kind == "empty":
            self.out.append(tag[:-1] + "/>")
        else:
            self.push(name, tag)

    def end(self, t: markup.Token) -> None:
        names = [n.lower() for n in self.names()]
        if t.name in ("html", "body") or t.name not in names:
            return
        at = len(names) - 1 - names[::-1].index(t.name)
        if t.name == "head":
            self.pop_to(at)
            return
        inside = self.open[at + 1 :]
        if t.name in INLINE and any(n in BLOCKS for n, _ in inside):
            # The block goes on; what is inline ends before it and isn't opened again.
            return
        self.pop_to(at)
        for name, tag in inside:
            if name in INLINE and t.name in INLINE:
                self.push(name, tag)

    def text(self, text: str) -> None:
        if not text.strip() and not self.bodied:
            if self.open:
                self.out.append(text)
            return
        if not (self.open and self.open[-1][0] in HEAD):
            self.ready("")
        self.out.append(escaped(text))


def pseudo(t: markup.Token) -> bool:
    """Whether what looks like a tag is text, such as std::string in angle brackets."""
    return t.kind in ("open", "empty", "close") and "::" in t.name


def letters(source: str, written: bool = False) -> str:
    """All text of a document, without white space; in one that is written as XML, scripts and styles are escaped as well."""
    parts = (source[t.start : t.end] if pseudo(t) or (t.kind == "raw" and not written) else html.unescape(source[t.start : t.end]) for t in markup.tokens(source) if t.kind in ("text", "raw") or pseudo(t))
    return "".join(_ILLEGAL.sub("", "".join(parts)).split())


def reserialized(source: str) -> tuple[str, int]:
    if is_well_formed(source) or not re.search(r"<html[\s>]", source, re.I):
        return source, 0
    build = Builder(source)
    for t in markup.tokens(source):
        piece = source[t.start : t.end]
        if pseudo(t):
            build.text(piece)
        elif t.kind in ("open", "empty"):
            build.start(t)
        elif t.kind == "close":
            build.end(t)
        elif t.kind == "raw":
            build.text(piece)
        elif t.kind == "text":
            build.text(html.unescape(piece))
        elif t.name == "<!--" and build.open:
            build.out.append(f"<!--{_ILLEGAL.sub('', piece[4:-3]).replace('--', '- -').rstrip('-')}-->")
    build.ready("")
    build.pop_to(0)
    new = f'<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n{"".join(build.out)}'
    return (new, 1) if letters(new, True) == letters(source) and is_well_formed(new) else (source, 0)
