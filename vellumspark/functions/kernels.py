"""Row kernels that need a parser, a stack or Unicode tables: plain Python functions, shipped as Arrow functions.

All of a document's kernels run in one crossing to Python.
"""

from __future__ import annotations

import bisect
import html
import itertools
import posixpath
import re
from typing import NamedTuple
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.functions import markup
from vellumspark.functions import text as X

#: Elements that hold a rendered block of text.
BLOCK_TAGS = frozenset("p div h1 h2 h3 h4 h5 h6 li td th blockquote section caption figcaption".split())
BLOCKS = "array<struct<tag:string,text:string,img_before:boolean,in_quote:boolean>>"
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:|//")


def norm_path(path: str) -> str:
    """An archive path for comparison: percent-decoded and normalised."""
    return posixpath.normpath(unquote(path))


def decode_numeric_refs(text: str) -> str:
    def one(m: re.Match) -> str:
        code = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
        # A surrogate is no character, and no encoder takes one.
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    return re.sub(r"&#(\d+|x[0-9a-fA-F]+);", one, text) if "&#" in text else text


def resolve_href(base: str, href: str | None) -> str | None:
    """The archive path that an attribute value names, or None for a scheme or nothing but a fragment."""
    if href is None:
        return None
    plain = href
    if "&" in plain:
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            plain = plain.replace(name, char)
        plain = decode_numeric_refs(plain)
    target = plain.split("#", 1)[0]
    return None if not target or _SCHEME.match(plain) else norm_path(posixpath.join(base, target))


def visible_text(source: str) -> str:
    """As the column form, with every entity that HTML knows."""
    bare = re.sub(r"<(script|style)\b.*?</\1>", " ", source, flags=re.I | re.S)
    return re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", bare))).strip()


def html_blocks(source: str) -> list[tuple[str, str, bool, bool]]:
    """(tag, text, img_before, in_quote) of each rendered block; script, style and title text counts as text.

    Text is dealt into runs between the tags of block elements. A block is a run of visible text, named after the
    innermost block element that is open; img_before: an image stands between it and the last visible text before it.
    """
    path: list[str] = []
    runs: list[tuple[int, str, bool, str, bool]] = []  # number of the run, element, in quote, text, image before
    number, image = 0, False
    for t in markup.tokens(source):
        if t.kind in ("text", "raw"):
            text = source[t.start : t.end] if t.kind == "raw" else html.unescape(source[t.start : t.end])
            runs.append((number, path[-1] if path else "?", "blockquote" in path, text, image))
            image = image and not text.strip()
        elif t.kind in ("open", "empty") and t.name in ("img", "image", "svg"):
            image = True
        elif t.name in BLOCK_TAGS and t.kind != "special":
            number += 1
            if t.kind == "open":
                path.append(t.name)
            elif t.kind == "close" and t.name in path:
                path.pop(len(path) - 1 - path[::-1].index(t.name))
    found = []
    for _, group in itertools.groupby(runs, lambda r: r[0]):
        parts = list(group)
        if text := "".join(r[3] for r in parts).strip():
            first = next(r for r in parts if r[3].strip())
            found.append((first[1], text, first[4], first[2]))
    return found


def is_well_formed(source: str) -> bool:
    try:
        ElementTree.fromstring(source)
    except (ElementTree.ParseError, ValueError):
        return False
    return True


def fix_stray_close(source: str) -> tuple[str, int]:
    """Drop end tags of a name that no open element has; what is merely misnested stays as it is.

    Only an end tag that names the innermost open element closes it; any other leaves all open that are.
    """
    path: list[str] = []
    stray = []
    for t in markup.tokens(source):
        if t.kind == "open":
            path.append(t.name)
        elif t.kind == "close" and t.name not in path:
            stray.append((t.start, t.end, ""))
        elif t.kind == "close" and path[-1] == t.name:
            path.pop()
    return markup.cut(source, stray), len(stray)


def fix_duplicate_ids(source: str) -> tuple[str, int]:
    """The first id of a value stays; later ones get `_2`, `_3`, ... that no other id has."""
    spans = [(value, start, end) for t in markup.tokens(source) if t.kind in ("open", "empty") for name, value, _, start, end in markup.attributes(source, t.start, t.end) if name.lower() == "id"]
    taken, seen, changes = {v for v, _, _ in spans}, set(), []
    for value, start, end in spans:
        if value in seen:
            new = next(x for k in itertools.count(2) if (x := f"{value}_{k}") not in taken)
            taken.add(new)
            changes.append((start, end, new))
        seen.add(value)
    return markup.cut(source, changes), len(changes)


def fill_empty_body(source: str) -> tuple[str, int]:
    """A body of white space alone gets a paragraph."""
    filled, last = [], []
    for t in markup.tokens(source):
        if t.kind == "text" and not source[t.start : t.end].strip():
            continue
        if t.kind == "close" and t.name == "body" and last == ["open", "body"]:
            filled.append((t.start, t.start, "<p>&#160;</p>"))
        last = [t.kind, t.name]
    return markup.cut(source, filled), len(filled)


#: Blocks that may not stand in a span; inline elements that get crossed.
SPANNED, CROSSED = frozenset(("div", "p", "blockquote")), frozenset(("i", "b", "em", "strong"))
MOST_CROSSED, MOST_BETWEEN = 64, 8


def unwrap_spans(source: str) -> tuple[str, int]:
    """A span that holds nothing but blocks goes, and so does one around such a span; its content stays."""
    elements = markup.tree(source)
    inside: dict[int, list[int]] = {}
    for at, e in enumerate(elements):
        inside.setdefault(e.parent, []).append(at)
    hollow: set[int] = set()
    for at in range(len(elements) - 1, -1, -1):  # children before their parents
        e, own = elements[at], inside.get(at, [])
        if e.name != "span" or e.close < 0 or not own or any(elements[c].end < 0 for c in own):
            continue
        edges = [e.inner, *(x for c in own for x in (elements[c].start, elements[c].end)), e.close]
        alone = not any(source[a:b].strip() for a, b in zip(edges[::2], edges[1::2], strict=True))
        if alone and all(c in hollow or elements[c].name in SPANNED for c in own):
            hollow.add(at)
    gone = []
    for at in hollow:
        e, own = elements[at], inside[at]
        gone += [(e.start, elements[own[0]].start, ""), (elements[own[-1]].end, e.end, "")]
    return markup.cut(source, gone), len(hollow)


_VALUE = re.compile(r"""\s[\w:.-]+\s*=\s*\"""")


def open_value(source: str, tag: markup.Token) -> int:
    """Where the quote is missing in a tag one of whose values runs to the tag's end; -1 where none does.

    What follows the tag then is markup before any other quote, or nothing; a value that holds `>` is closed before that.
    """
    at = tag.start
    while value := _VALUE.search(source, at, tag.end):
        stop, quote = source.find(">", value.end()), source.find('"', value.end())
        if quote < 0 or 0 <= stop < quote:
            markup_, head = source.find("<", stop), source[value.end() : stop]
            if stop >= 0 and head and not re.search(r"[\s<]", head) and (quote < 0 or 0 <= markup_ < quote):
                return stop
        at = quote + 1 if quote >= 0 else tag.end
    return -1


def close_values(source: str) -> tuple[str, int]:
    """An attribute's value that is left open to the end of its tag is closed there."""
    missing, at = [], 0
    while at >= 0:
        stops = (open_value(source, t) for t in markup.tokens(source, at) if t.kind in ("open", "empty"))
        stop = next((s for s in stops if s >= 0), -1)
        if stop >= 0:
            missing.append((stop, stop, '"'))
        # What the open value has swallowed is read again.
        at = stop + 1 if stop >= 0 else -1
    return markup.cut(source, missing), len(missing)


def uncross(source: str) -> tuple[str, int]:
    """Two inline elements around a few words, closed in the order in which they were opened: the inner one ends first,
    and what stood between the two end tags (a mark or two) follows both."""
    found = list(markup.tokens(source))
    bare = lambda t: t.name in CROSSED and t.end - t.start == len(t.name) + (3 if t.kind == "close" else 2)
    changes, at = [], 0
    while at + 4 < len(found):
        outer, inner, words, first, *rest = found[at : at + 6]
        between = rest[0] if rest[0].kind == "text" else None
        last = rest[1] if between and len(rest) > 1 else rest[0]
        crossed = (
            [t.kind for t in (outer, inner, words, first, last)] == ["open", "open", "text", "close", "close"]
            and all(map(bare, (outer, inner, first, last)))
            and (outer.name, inner.name) == (first.name, last.name) and outer.name != inner.name
            and words.end - words.start <= MOST_CROSSED
            and (between is None or (between.end - between.start <= MOST_BETWEEN and not re.search(r"\w", source[between.start : between.end])))
        )
        if crossed:
            marks = source[between.start : between.end] if between else ""
            changes.append((first.start, last.end, source[last.start : last.end] + source[first.start : first.end] + marks))
        at += 5 if crossed else 1
    return markup.cut(source, changes), len(changes)


_DECLARED = re.compile(r"""xmlns:([\w.-]+)\s*=""")
_VOCABULARY = re.compile(r"""prefix\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_ODD_ATTRIBUTE = re.compile(r"""\s+([^\s=<>"'/]+)\s*=\s*(?:"[^"]*"|'[^']*')""")
#: Names that need no declaration; namespaces of packages and of Dublin Core.
PREBOUND = frozenset(("xml", "xmlns"))
OPF_NS, DC_NS = "http://www.idpf.org/2007/opf", "http://purl.org/dc/elements/1.1/"


def strip_bad_attributes(source: str) -> tuple[str, int]:
    """Drop attributes that no XML parser takes: a name that begins with a digit, or a prefix declared nowhere."""
    declared = PREBOUND | set(_DECLARED.findall(source)) | {name for m in _VOCABULARY.finditer(source) for name in re.findall(r"([\w.-]+):\s", m[1] or m[2] or "")}
    bad = []
    for t in markup.tokens(source):
        if t.kind in ("open", "empty"):
            for m in _ODD_ATTRIBUTE.finditer(source, t.start, t.end):
                prefix, colon, _ = m[1].partition(":")
                if m[1][0].isdigit() or (colon and prefix not in declared):
                    bad.append((*m.span(), ""))
    return markup.cut(source, bad), len(bad)


def bind_prefixes(source: str) -> tuple[str, int]:
    """Declare an unbound prefix of a package file on the element that uses it, if what it stands for is evident.

    Evident is the one namespace that the file binds it to elsewhere; or, in a package of the OPF namespace, Dublin Core for
    an element dc:..., and OPF for an attribute of such an element. One prefix without evidence leaves the file as it is.
    """
    elements = markup.tree(source)
    attrs = [markup.attributes(source, e.start, e.inner) for e in elements]
    names = [source[e.start + 1 : e.start + 1 + len(e.name)] for e in elements]
    own = [{a[0][6:]: a[1] for a in found if a[0].startswith("xmlns:")} for found in attrs]
    bound: dict[str, set[str]] = {}
    for known in own:
        for prefix, uri in known.items():
            bound.setdefault(prefix, set()).add(uri)
    package = next((k for k, e in enumerate(elements) if markup.local(e.name) == "package"), None)
    is_opf = package is not None and OPF_NS in {*own[package].values(), *(a[1] for a in attrs[package] if a[0] == "xmlns")}
    changes = []
    for k, e in enumerate(elements):
        scope = {p: uri for up in (*markup.ancestors(elements, k), k) for p, uri in own[up].items()}
        prefix = names[k].partition(":")[0] if ":" in names[k] else ""
        dublin = is_opf and scope.get(prefix, DC_NS if prefix == "dc" else "") == DC_NS
        uses = {prefix: DC_NS if is_opf and prefix == "dc" else ""} if prefix else {}
        for a in attrs[k]:
            if ":" in a[0]:
                uses.setdefault(a[0].partition(":")[0], OPF_NS if dublin else "")
        for wanted, fallback in uses.items():
            if wanted in scope or wanted in PREBOUND:
                continue
            evidence = bound.get(wanted, {fallback} - {""})
            if len(evidence) != 1:
                return source, 0
            at = e.start + 1 + len(e.name)
            changes.append((at, at, f' xmlns:{wanted}="{min(evidence)}"'))
    return markup.cut(source, changes), len(changes)


def rename_ids(source: str) -> tuple[str, int]:
    """Ids that are no XML names get one, and references to them within the document follow; the ids renamed are counted."""
    changes, n = [], 0
    for t in markup.tokens(source):
        if t.kind not in ("open", "empty"):
            continue
        for name, value, _, start, end in markup.attributes(source, t.start, t.end):
            internal = name.lower() in ("href", "src", "xlink:href") and "#" in value and not _SCHEME.match(value) and not re.search("[%&]", value)
            if name.lower() == "id" and X.invalid_name(value):
                changes.append((start, end, X.valid_name(value)))
                n += 1
            elif internal and X.invalid_name(fragment := value.partition("#")[2]) and fragment:
                changes.append((start, end, value.partition("#")[0] + "#" + X.valid_name(fragment)))
    return markup.cut(source, changes), n


class Stamp(NamedTuple):
    """A producer's watermark: what a link to it holds, what its text holds, and all of its text once."""

    name: str
    link: str | None
    sign: str
    phrase: str


#: The producers whose stamps are known; a new one is one more entry.
WATERMARKS = (
    Stamp("OceanofPDF", "oceanofpdf", "oceanofpdf.com", r"oceanofpdf\.com"),
    Stamp("ABC Amber LIT Converter", "processtext", "processtext.com/abclit", r"(?:generated by )?abc amber lit converter,?\s*https?://(?:www\.)?processtext\.com/abclit\.html"),
)
#: Elements that may go with the stamp they hold, and those that make an element real content.
WRAPPERS = frozenset("div p span h1 h2 h3 h4 h5 h6 b i em strong".split())
MEDIA = frozenset("img image svg video audio picture iframe table object".split())
MOST_STAMP = 120


def stamped(source: str, stamp: Stamp) -> tuple[list[tuple[int, int, str]], int]:
    """Spans that are nothing but the stamp, and how many links to it are in the way of real text (refused)."""
    if stamp.sign not in source.lower() and (not stamp.link or stamp.link not in source.lower()):
        return [], 0
    elements = markup.tree(source)
    pure = re.compile(rf"(?:{stamp.phrase}\s*)+", re.I)

    starts = [x.start for x in elements]

    def inside(e: markup.Element) -> list[markup.Element]:
        """Elements stand in document order, so those inside of one follow each other."""
        return elements[bisect.bisect_left(starts, e.inner) : bisect.bisect_left(starts, e.close)]

    def words(e: markup.Element) -> str:
        texts = sorted(span for x in [e, *inside(e)] for span in x.texts if e.inner <= span[0] < e.close)
        return " ".join(html.unescape("".join(source[a:b] for a, b in texts)).replace("\xa0", " ").split()).lower()

    def wrapper(at: int, own: bool) -> markup.Element | None:
        """The outermost element around it (or itself) that holds the stamp only."""
        around = [elements[k] for k in (*markup.ancestors(elements, at), *([at] if own else []))]
        return next((e for e in around if e.name in WRAPPERS and e.close >= 0 and not any(x.name in MEDIA for x in inside(e)) and pure.fullmatch(words(e))), None)

    spans, refused = [], 0
    for at, e in enumerate(elements):
        if stamp.link and e.name == "a" and stamp.link in source[e.start : e.inner].lower():
            if found := wrapper(at, False):
                spans.append((found.start, found.end, ""))
            # Without a wrapper the link goes alone if it holds the stamp, or a few words and no markup.
            elif e.close >= 0 and not any(x.name == "a" for x in inside(e)) and (pure.fullmatch(words(e)) or (not inside(e) and len(words(e)) <= MOST_STAMP)):
                spans.append((e.start, e.end, ""))
            else:
                refused += 1
        elif any(stamp.sign in source[a:b].lower() for a, b in e.texts) and (found := wrapper(at, True)):
            spans.append((found.start, found.end, ""))
    return sorted(set(spans)), refused


def strip_watermarks(source: str, stamps: tuple[Stamp, ...] = WATERMARKS) -> tuple[str, int, int]:
    """(text, removed, refused): an element goes only if all it shows is a stamp, so prose that names one stays."""
    removed = refused = 0
    for stamp in stamps:
        spans, kept = stamped(source, stamp)
        outer = [s for s in spans if not any(o[0] <= s[0] and s[1] <= o[1] and o != s for o in spans)]
        source, removed, refused = markup.cut(source, outer), removed + len(outer), refused + kept
    return source, removed, refused


def blocks_column(source: Column) -> Column:
    @F.pandas_udf(BLOCKS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [dict(zip(("tag", "text", "img_before", "in_quote"), b, strict=True)) for b in html_blocks(x or "")])

    return run(source)


def well_formed_column(source: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: is_well_formed(x or ""))

    return run(source)


def edits_column(source: Column, stamps: tuple[Stamp, ...] = (), tags: bool = True) -> Column:
    """struct(html, stray, ids, marks, refused): stray closers and duplicate ids (if tags) and watermarks in one crossing."""

    @F.pandas_udf("html string, stray long, ids long, marks long, refused long")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            text, stray = fix_stray_close(x or "") if tags else (x or "", 0)
            text, ids = fix_duplicate_ids(text) if tags else (text, 0)
            rows.append((*(found := strip_watermarks(text, stamps))[:1], stray, ids, *found[1:]))
        return pd.DataFrame(rows, columns=["html", "stray", "ids", "marks", "refused"])

    return run(source)


#: Kernels of one text each, by the name of their flag; `fix-svg-dup-ids` is the same kernel on .svg files.
ROW_KERNELS = {"strip-bad-attrs": strip_bad_attributes, "fix-unbound-prefix": bind_prefixes, "fix-id-colons": rename_ids, "fix-stray-close": fix_stray_close, "fix-duplicate-ids": fix_duplicate_ids, "fix-svg-dup-ids": fix_duplicate_ids}


def kernel_column(source: Column, flags: tuple[str, ...]) -> Column:
    """struct(html, fixes: a map of counts) after the kernels of these flags, in their order, in one crossing."""

    @F.pandas_udf("html string, fixes map<string,bigint>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            out, counts = x or "", {}
            for flag in flags:
                out, n = ROW_KERNELS[flag](out)
                if n:
                    counts[flag] = n
            rows.append((out, counts))
        return pd.DataFrame(rows, columns=["html", "fixes"])

    return run(source)
