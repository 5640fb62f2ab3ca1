"""Row kernels, archives and the census stream on hand-made cases."""

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tables import SF
from vellumspark.functions import text as X
from vellumspark.functions import kernels, lenient, markup
from vellumspark.operators import census, repair
from vellumspark.operators import package_files as P
from vellumspark.plans import audit, catalogue
from vellumspark.sources import archive
from vellumspark.streaming import census as stream

OPF = """<package xmlns="http://www.idpf.org/2007/opf" version="2.0"><manifest><item id="a" href="c%201.xhtml" media-type="application/xhtml+xml"/><item id="b" href="gone.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="z"/></spine></package>"""


@pytest.mark.parametrize(
    ("base", "href", "want"),
    [("", "a.html#x", "a.html"), ("t", "../b%20c.html", "b c.html"), ("", "http://x/y", None), ("", "#top", None), ("t", "R&amp;D.html", "t/R&D.html"), ("", "&#x41;.html", "A.html"), ("", None, None)],
)
def test_hrefs(base, href, want):
    assert kernels.resolve_href(base, href) == want


def test_blocks():
    got = kernels.html_blocks("<title>T</title><div>a<p>b</p><blockquote><p>c</p></blockquote><img><p>d</p></div></li>e")
    assert got == [("?", "T", False, False), ("div", "a", False, False), ("p", "b", False, False), ("p", "c", False, True), ("p", "d", True, False), ("?", "e", False, False)]


@pytest.mark.parametrize(
    ("text", "want", "n"),
    [("<p>a</p></div>", "<p>a</p>", 1), ("<div><span></div></span>", "<div><span></div></span>", 0), ("<script>'</b>'</script></b>", "<script>'</b>'</script>", 1), ("<br></br>", "<br>", 1), ("<!-- </x> </p>", "<!-- </x> </p>", 0), ("<!-- c --></x>", "<!-- c -->", 1)],
)
def test_stray_close(text, want, n):
    assert kernels.fix_stray_close(text) == (want, n) and kernels.fix_stray_close(want)[1] == 0


def test_duplicate_ids():
    text = '<a id="x"><b id="x"><c id="x_2"><!-- <d id="x"> --><e id="x">'
    fixed, n = kernels.fix_duplicate_ids(text)
    assert n == 2 and fixed == '<a id="x"><b id="x_3"><c id="x_2"><!-- <d id="x"> --><e id="x_4">' and kernels.fix_duplicate_ids(fixed)[1] == 0


def test_bad_attributes():
    text = '<p 31="" v:shapes="x" xml:lang="en" class="a">b</p><svg xmlns:xlink="u" xlink:href="#a"/><!-- <p 3="x"> -->'
    want = '<p xml:lang="en" class="a">b</p><svg xmlns:xlink="u" xlink:href="#a"/><!-- <p 3="x"> -->'
    assert kernels.strip_bad_attributes(text) == (want, 2) and kernels.strip_bad_attributes(want) == (want, 0)
    assert kernels.strip_bad_attributes("<html prefix='foo: http://x/ bar: y'><p foo:a='1'/></html>")[1] == 0


PACKAGE = '<package xmlns="http://www.idpf.org/2007/opf">{}</package>'


@pytest.mark.parametrize(
    ("inner", "want", "n"),
    [
        ('<dc:date>x</dc:date>', '<dc:date xmlns:dc="http://purl.org/dc/elements/1.1/">x</dc:date>', 1),
        ('<a xmlns:q="u"/><b q:x="1"/>', '<a xmlns:q="u"/><b xmlns:q="u" q:x="1"/>', 1),
        ('<a xmlns:q="u"/><c xmlns:q="v"/><b q:x="1"/>', None, 0),
        ('<b q:x="1"/>', None, 0),
        ('<dc:creator xmlns:dc="http://purl.org/dc/elements/1.1/" opf:role="aut"/>', '<dc:creator xmlns:opf="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" opf:role="aut"/>', 1),
        ('<m xmlns:q="u"><q:n/></m><!-- <z:a/> -->', None, 0),
    ],
)
def test_prefixes_are_bound_by_evidence(inner, want, n):
    text = PACKAGE.format(inner)
    assert kernels.bind_prefixes(text) == (PACKAGE.format(want or inner), n)


def test_ids_and_their_references_become_names(spark):
    text = '<a id="1:x" data-id="2"/><a href="#1:x">r</a><a href="http://y/#1:x">s</a><a href="b.html#9">t</a><a id="ok"/>'
    want = '<a id="id_1_x" data-id="2"/><a href="#id_1_x">r</a><a href="http://y/#1:x">s</a><a href="b.html#id_9">t</a><a id="ok"/>'
    assert kernels.rename_ids(text) == (want, 1) and kernels.rename_ids(want) == (want, 0)
    row = spark.createDataFrame([(text + "</p>",)], "html string").select(kernels.kernel_column(F.col("html"), ("fix-id-colons", "fix-stray-close")).alias("k")).first().k
    assert row.html == want and row.fixes == {"fix-id-colons": 1, "fix-stray-close": 1}


AMBER = "http://www.processtext.com/abclit.html"


@pytest.mark.parametrize(
    ("text", "want", "removed", "refused"),
    [
        ('<div>x</div><p><b><a href="http://oceanofpdf.com">OceanofPDF.com</a></b></p><p>y</p>', "<div>x</div><p>y</p>", 1, 0),
        ("<p>She said oceanofpdf.com was where he found it, and wept.</p>", None, 0, 0),
        (f'<b>Generated by ABC Amber LIT Conv<a href="{AMBER}">erter, {AMBER}</a></b>x', "x", 1, 0),
        (f'<div type="FOOTER"><p><span>ABC Amber LIT Converter {AMBER}</span></p></div>', "", 1, 0),
        ('<p>Read on <a href="http://oceanofpdf.com">OceanofPDF.com</a> today</p>', "<p>Read on  today</p>", 1, 0),
        ('<p><a href="http://oceanofpdf.com">OceanofPDF.com<p>real prose <a href="x">y</a></p>', None, 0, 1),
        ('<p><a href="http://oceanofpdf.com"><i>a very long story</i> of things</a></p>', None, 0, 1),
        ("<p>OceanofPDF.com&nbsp; oceanofpdf.com</p>", "", 1, 0),
        ("<p>oceanofpdf.com<img src='x'/></p>", None, 0, 0),
    ],
)
def test_watermarks(text, want, removed, refused):
    assert kernels.strip_watermarks(text) == (text if want is None else want, removed, refused)


def repaired(spark, name, text):
    frame = spark.createDataFrame([(text,)], "html string")
    row = repair.applied(frame, (repair.CORE | repair.OPTIONAL)[name]).first()
    again = repair.applied(spark.createDataFrame([(row.html,)], "html string"), (repair.CORE | repair.OPTIONAL)[name]).first()
    assert again.n == 0 and again.html == row.html
    return row.html, row.n


@pytest.mark.parametrize(
    ("name", "text", "want", "n"),
    [
        ("escape_bare_amp", "a & b &amp; &#12; <!-- & -->", "a &amp; b &amp; &#12; <!-- & -->", 1),
        ("fix_named_entities", "&nbsp;&lt;&NotEqualTilde;&zork;", "&#160;&lt;&#8770;&#824;&zork;", 2),
        ("self_close_void", '<br><hr class="a>b"/><colgroup><img src=x></br>', '<br/><hr class="a>b"/><colgroup><img src=x/>', 3),
        ("strip_prolog_junk", "﻿  <?xml version='1.0'?><a/>", "<?xml version='1.0'?><a/>", 1),
        ("strip_prolog_junk", "\n <!DOCTYPE html><p/>", "\n <!DOCTYPE html><p/>", 0),
        ("drop_duplicate_xmlns", '<html xmlns="a" lang="x" xmlns="b"><p xmlns="c">', '<html xmlns="a" lang="x"><p xmlns="c">', 1),
        ("add-img-alt", '<img src="a"><img alt="x"/><!-- <img> -->', '<img src="a" alt=""><img alt="x"/><!-- <img> -->', 1),
        ("fix-misnested-inline", "<i><b>X</i>,</b><i><i>y</i></i>", "<i><b>X</b></i>,<i><i>y</i></i>", 1),
        ("unwrap-illegal-tags", "<style>w{x:y}</style><w>a</w><o>b</o>", "<style>w{x:y}</style><w>a</w>b", 2),
        ("fix-comment-double-hyphen", "a--b <!-- c--d -->", "a--b <!-- c–d -->", 1),
        ("fix-missing-title", "<head><title/></head>", "<head><title>Unknown</title></head>", 1),
        ("drop_duplicate_xmlns", '<!-- <html xmlns="a" xmlns="b"> --><html xmlns="c" xmlns="d">', '<!-- <html xmlns="a" xmlns="b"> --><html xmlns="c">', 1),
        ("strip-invalid-value", '<li class="a" value="3">x</li><input value="4">', '<li  class="a" >x</li><input value="4">', 1),
        ("strip-broken-tags", "a/p&gt;b&lt;/div&gt;c</p&gt;&lt;/xyz&gt;", "abc</p&gt;&lt;/xyz&gt;", 2),
        ("fix-unterminated-attr", '<p class="x>a</p><p title="a>b">', '<p class="x">a</p><p title="a>b">', 1),
        ("unwrap-block-in-inline", '<span class="q"> <div>x</div> </span><span>a<p>b</p></span><span><span><p>1</p><p>2</p></span></span>', '<div>x</div><span>a<p>b</p></span><p>1</p><p>2</p>', 3),
        ("fix-empty-body", "<!-- <body></body> --><body id='b'> \n</body>", "<!-- <body></body> --><body id='b'> \n<p>&#160;</p></body>", 1),
        ("fix-unterminated-attr", '<li class="x>a</li><!-- <p class="y>c --><li class="z>b', '<li class="x">a</li><!-- <p class="y>c --><li class="z">b', 2),
        ("escape-unknown-entities", '<!DOCTYPE html PUBLIC "a [b" "c>d"><p>&zork;</p>', '<!DOCTYPE html PUBLIC "a [b" "c>d"><p>&amp;zork;</p>', 1),
        ("escape-unknown-entities", '<!DOCTYPE html [ <!ENTITY zork "]>"> ]><p>&zork;</p>', '<!DOCTYPE html [ <!ENTITY zork "]>"> ]><p>&zork;</p>', 0),
        ("escape-unknown-entities", "<!-- <!DOCTYPE x [ ]> --><!DOCTYPE html><p>&zork;</p>", "<!-- <!DOCTYPE x [ ]> --><!DOCTYPE html><p>&amp;zork;</p>", 1),
        ("encode-url-spaces", '<a href="a b.htm" data-href="a b">href="a b"</a>', '<a href="a%20b.htm" data-href="a b">href="a b"</a>', 1),
    ],
)
def test_repairs(spark, name, text, want, n):
    assert repaired(spark, name, text) == (want, n)


@pytest.mark.parametrize(
    ("source", "body"),
    [
        ("<html><head><title>t</title></head><body><p>one<p>two <b>x <i>y</b> z</i></body></html>", "<p>one</p><p>two <b>x <i>y</i></b><i> z</i></p>"),
        ("<html><body><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><br>1 < 2 &nbsp;&eacute;", "<ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table><br/>1 &lt; 2 \xa0é"),
        ("<html><p class=a class=b 1x=y hidden z:q='1'>text<div>block</p></div></span>", '<p class="a" hidden="hidden">text</p><div>block</div>'),
        ("<html><body><dl><dt>a<dd>b</dl><!-- a -- b --><script>if (a < b && c) x('&lt;')</script>", "<dl><dt>a</dt><dd>b</dd></dl><!-- a - - b --><script>if (a &lt; b &amp;&amp; c) x('&amp;lt;')</script>"),
        ("<html><body><p>a <std::map>b<o:p>c</o:p>", "<p>a &lt;std::map&gt;bc</p>"),
        ("<html><body><svg><linearGradient id='g'></svg><a href='q?a=1&b=2'>z", '<svg><linearGradient id="g"></linearGradient></svg><a href="q?a=1&amp;b=2">z</a>'),
    ],
)
def test_lenient_reading(source, body):
    new, n = lenient.reserialized(source)
    assert n == 1 and new.endswith(f"<body>{body}</body></html>") and kernels.is_well_formed(new) and lenient.reserialized(new) == (new, 0)


def test_lenient_reading_is_refused():
    for source in ("<page><p>open</page>", "<html><body><p>well</p></body></html>", "", "<htmlx><p></htmlx>"):
        assert lenient.reserialized(source) == (source, 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<i x=1>", "</i>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<br>", "a ", "&amp;", "<", "<head>", "<body>", "</body>", "<td>", "<table>", "</table>", "<tr>", "<title>t</title>", "<!--x-->"]), max_size=25))
def test_lenient_reading_never_loses_text(parts):
    source = "<html>" + "".join(parts)
    new, n = lenient.reserialized(source)
    assert lenient.letters(new, n > 0) == lenient.letters(source) and (kernels.is_well_formed(new) or n == 0)


def test_document_types(spark):
    """Quotes hide brackets, comments hide declarations, a subset or a declaration that never ends stays."""
    new = "<!DOCTYPE html>"
    cases = {'<!DOCTYPE html PUBLIC "[x]" "y>">': new, "<!DOCTYPE html [<!ENTITY a 'b'>]>": None, "<!-- <!DOCTYPE a> --><!DOCTYPE b>": "<!-- <!DOCTYPE a> -->" + new, "<!DOCTYPE b <html>": None, "<?xml version='1.0'?>\n<!doctype\n html>": "<?xml version='1.0'?>\n" + new, "<p><!DOCTYPE b>": None}
    frame = spark.createDataFrame([(k + "<x/>", 3) for k in cases], "html string, major int")
    got = repair.applied(frame, [repair.Whole(repair.doctype(F.col("major")))]).collect()
    assert [r.html for r in got] == [(v or k) + "<x/>" for k, v in cases.items()]
    tokens = [(t.kind, t.name) for t in markup.tokens("<!DOCTYPE a [<!-- ] ' --><!ENTITY b '>]'>]><p>")]
    assert tokens == [("special", "<!"), ("open", "p")]


def test_numbers_that_are_no_characters(spark):
    assert kernels.decode_numeric_refs("&#xD800;&#233;&#57343;&#xE000;") == "&#xD800;é&#57343;\ue000"
    docs = spark.createDataFrame([("b", "a.xhtml", '<a href="x&#xD800;.htm">&#55296;</a>')], "book_id string, path string, text string")
    assert P.elements(docs).count() == 1


def package(path, files):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in files:
            z.writestr(name, data)


def test_archives_are_read_repaired_and_written(spark, tmp_path):
    package(tmp_path / "a.epub", [("content.opf", OPF), ("c 1.xhtml", "<p>a & b<br></p>"), ("mimetype", "application/epub+zip"), ("img.bin", b"\xff\xfe")])
    (tmp_path / "b.epub").write_bytes(b"no zip")
    (tmp_path / ".caltrash").mkdir()
    package(tmp_path / ".caltrash" / "c.epub", [("x", "y")])
    files = archive.archives(spark, f"file://{tmp_path}")
    entry = archive.entries(files).cache()
    assert entry.select("book_id").distinct().count() == 2 and entry.where("read_ok and not is_utf8").first().name == "img.bin"
    assert "BadZipFile" in entry.where("ordinal = -1").first().err
    places = archive.spine(archive.manifest(archive.packages(entry)), entry)
    assert {(r.pos, r.path, r.found) for r in places.collect()} == {(0, "c 1.xhtml", True), (1, "gone.xhtml", False), (2, None, False)}
    assert tuple(archive.spine_resolution(places).first())[1:] == (3, 1, 2)
    fixed = repair.repaired(archive.documents(places, entry))
    row = fixed.first()
    assert row.html == "<p>a &amp; b<br/></p>" and row.fixes == {"escape_bare_amp": 1, "self_close_void": 1}
    changed = fixed.select("book_id", F.col("path").alias("name"), F.encode("html", "UTF-8").alias("new_bytes"))
    one, two = (archive.rezipped(files, changed).first().content for _ in range(2))
    assert one == two
    with zipfile.ZipFile(io.BytesIO(one)) as z:
        assert z.namelist()[0] == "mimetype" and z.read("c 1.xhtml") == b"<p>a &amp; b<br/></p>" and z.read("img.bin") == b"\xff\xfe"


def test_what_cannot_be_read_is_carried(spark, tmp_path, monkeypatch):
    """An entry over the bound, a damaged one and one that isn't UTF-8 come out of a repair byte for byte."""
    big, latin = b"x" * (33 << 20), "<p>caf\u00e9 & b</p>".encode("latin-1")
    opf = OPF.replace("gone.xhtml", "latin.xhtml").replace('<itemref idref="z"/>', "")
    package(tmp_path / "a.EPUB", [("content.opf", opf), ("c 1.xhtml", "<p>a & b</p>"), ("big.bin", big), ("bad.bin", b"good bytes" * 50), ("latin.xhtml", latin), ("x/", b"")])
    data = (tmp_path / "a.EPUB").read_bytes()
    at = data.index(b"good bytes")
    data = data[:at] + b"BAD" + data[at + 3 :]
    (tmp_path / "a.EPUB").write_bytes(data)
    files = archive.archives(spark, f"file://{tmp_path}")
    entry = archive.entries(files).cache()
    items = archive.manifest(archive.packages(entry))
    places = archive.spine(items, entry)
    docs = archive.documents(places, entry)
    assert [r.path for r in docs.collect()] == ["c 1.xhtml"] and archive.unreadable_documents(places, entry).first().non_utf8_docs_skipped == 1
    facts = archive.archive_facts(entry, spark.createDataFrame([], "book_id string, target string, drm boolean"), places, items).first()
    assert (facts.corrupt, facts.encrypted, facts.spine, facts.missing, facts.duplicates, facts.unreadable) == (1, 0, 2, 0, 0, None)
    fixed = repair.repaired(docs)
    row = archive.rezipped(files, fixed.select("book_id", F.col("path").alias("name"), F.encode("html", "UTF-8").alias("new_bytes"))).first()
    assert row.err is None and row.mimetype == "added"
    with zipfile.ZipFile(io.BytesIO(row.content)) as z, zipfile.ZipFile(io.BytesIO(data)) as old:
        assert z.namelist() == ["mimetype", "content.opf", "c 1.xhtml", "big.bin", "bad.bin", "latin.xhtml", "x/"]
        assert z.read("big.bin") == big and z.read("latin.xhtml") == latin and z.read("c 1.xhtml") == b"<p>a &amp; b</p>"
        assert b"BADd bytes" in row.content and z.getinfo("bad.bin").CRC == old.getinfo("bad.bin").CRC
        with pytest.raises(zipfile.BadZipFile):
            z.read("bad.bin")


def test_facts_of_encrypted_and_delimited_packages(spark, tmp_path):
    opf = OPF.replace("gone.xhtml", "B#1.xhtml")
    package(tmp_path / "a.epub", [("content.opf", opf), ("c 1.xhtml", "x"), ("B%231.xhtml", "y"), ("f.otf", "z"), ("extra.htm", "e" * 10), ("more.html", "m" * 10)])
    files = archive.archives(spark, f"file://{tmp_path}")
    entry = archive.entries(files).withColumn("norm_name", F.when(F.col("name") == "B%231.xhtml", "B#1.xhtml").otherwise(F.col("norm_name"))).cache()
    items = archive.manifest(archive.packages(entry))
    places = archive.spine(items, entry)
    declared = entry.where("name = 'f.otf'").select("book_id", F.lit("f.otf").alias("target"), F.lit(False).alias("drm"))
    facts = archive.archive_facts(entry, declared, places, items).first()
    assert (facts.obfuscated, facts.encrypted, facts.drm, facts.missing, facts.delim) == (1, 0, 0, 2, 1)
    assert {r.path for r in archive.off_spine(places, entry, cap=12).collect()} == {"B#1.xhtml", "extra.htm"}


def test_census_lines(spark):
    lines = ["1,3,0 ||| RSC-005:3:104,RSC-012:1:1 ||| /lib/a.epub", "-1,-1,-1 |||  ||| /lib/b.epub", "0,0,2 ||| HTM-004,BAD:x:1 ||| /lib/c ||| d.epub", "nonsense"]
    got = {r.path: r for r in census.parsed(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert set(got) == {"/lib/a.epub", "/lib/b.epub", "/lib/c ||| d.epub"}
    assert [tuple(c) for c in got["/lib/a.epub"].codes] == [("RSC-005", 3, 104), ("RSC-012", 1, 1)] and got["/lib/b.epub"].unreadable and got["/lib/b.epub"].fatals == 0
    assert [tuple(c) for c in got["/lib/c ||| d.epub"].codes] == [("HTM-004", 1, None)]


def test_census_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text(f"0,{k},0 ||| A:1:1 ||| /b{k}\n")
        stream.append_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["/b0", "/b1"]


def test_audit_plans_only_what_is_asked(spark):
    docs = spark.createDataFrame([("a", 1, "<p>short</p>"), ("b", 1, "<p>" + "long text " * 3000 + "</p>")], "book_id string, pos long, html string")
    facts = spark.createDataFrame([("a", 1, 0, 0, 0, 1, 3, 0), ("b", 0, 0, 0, 0, 5, 0, 0)], "book_id string, corrupt int, encrypted int, drm int, obfuscated int, spine int, missing int, delim int")
    failed = spark.createDataFrame([("c", "truncated")], "book_id string, reason string")
    found = audit.audit(docs, audit.Package(facts=facts, failed=failed)).collect()
    got = {(r.book_id, r.analyzer): (r.problem, r.status) for r in found}
    assert ("a", "emptytext") not in got and ("a", "completeness") not in got and got["b", "emptytext"] == (False, "OK") and got["a", "archive"] == (True, "CORRUPT") and got["a", "shell"] == (False, "SHELL")
    assert got["c", "load"] == (True, "ERROR") and {a for _, a in got} == {*audit.ALL, "load"} - {"cover", "tocdrift", "contamination", "spine"}
    reports = audit.report(audit.audit(docs, audit.Package(failed=failed), only=("emptytext",)))
    assert {r.book_id: r.status for r in reports.collect()} == {"a": "problem", "b": "clean", "c": "error"}
    assert tuple(audit.summary(reports).first()) == (3, 1, 1)


def test_whole_audit(spark):
    """Every analyzer on a book that gives it something to say, and on one that doesn't."""
    prose = "It was a fine day for all of them and the sea was calm, as it had been before. " * 8
    toc_page = "".join(f'<p><a href="c{k}.html">Chapter {k}</a></p>' for k in range(6))
    bad = [(0, "ch1.html", f"<head><title>Other Saga Volume 5</title></head><p>{prose}</p><p>visit jnovels</p><p>5 of 9 people found this helpful</p>"), (1, "ch3.html", f"<p>{prose}</p>"), (2, "toc.html", toc_page)]
    docs = spark.createDataFrame([("bad", *r) for r in bad] + [("good", k, f"ch{k}.html", f"<p>{prose * 9}</p>") for k in range(4)], "book_id string, pos long, path string, html string")
    own = spark.createDataFrame([("bad", ["fine days"]), ("good", ["jnovels"])], "book_id string, own array<string>")
    facts = spark.createDataFrame([("bad", 0, 0, 0, 1, 3, 0, 1), ("good", 0, 0, 0, 0, 4, 0, 0)], "book_id string, corrupt int, encrypted int, drm int, obfuscated int, spine int, missing int, delim int")
    names = docs.select("book_id", "path")
    refs = spark.createDataFrame([("bad", "gone.html"), ("good", "ch1.html")], "book_id string, path string")
    entry = lambda b, label, target: (b, 0, label, target)
    ncx = spark.createDataFrame([entry("bad", "One", "ch1.html"), entry("good", "One", "ch1.html")], "book_id string, idx int, label string, target string")
    nav = spark.createDataFrame([entry("bad", "Eins", "ch1.html"), entry("good", "One", "ch1.html")], "book_id string, idx int, label string, target string")
    items = spark.createDataFrame([("bad", 0, "x", "ch1.html", []), ("good", 0, "c", "ch1.html", ["cover-image"])], "book_id string, ord int, id string, resolved string, properties array<string>")
    metas = spark.createDataFrame([("bad", 0, "nope")], "book_id string, ord int, content string")
    found = {(r.book_id, r.analyzer): r for r in audit.audit(docs, audit.Package(facts=facts, refs=refs, names=names, ncx=ncx, nav=nav, own=own, items=items, metas=metas)).collect()}
    want = {"content": ("OK", "OK"), "pagenumbers": ("OK", "OK"), "emptytext": ("EMPTY", "OK"), "ocr": ("OK", "OK"), "monolithic": ("OK", "OK"), "completeness": ("ADVISORY", "OK"), "cover": ("ADVISORY", "OK"), "tocdrift": ("ADVISORY", "OK"), "contamination": ("ADVISORY", "OK"), "shell": ("ADVISORY", "OK"), "archive": ("OBFUSCATED", "OK"), "spine": ("ADVISORY", "OK")}
    got = {a: (found["bad", a].status, found["good", a].status) for a in audit.ALL}
    got["emptytext"] = (got["emptytext"][0], got["emptytext"][1].replace("THIN", "OK"))
    assert got == want | {"emptytext": (got["emptytext"][0], "OK")} and got["emptytext"][0] in ("EMPTY", "THIN")
    assert len(found["bad", "contamination"].details) == 3 and "at the end: 2" in found["bad", "completeness"].details[1]
    assert found["bad", "spine"].details == ["unknown: 1 of 1 references name nothing"]


def test_epub3_repairs_ask_for_the_version(spark):
    docs = spark.createDataFrame([(1, 2, '<p role="x">a</p>'), (2, 3, '<p role="x">a</p>'), (3, None, '<p role="x">a</p>')], "k int, major int, html string")
    got = {r.k: (r.html, r.fixes) for r in repair.repaired(docs, ("strip-epub3-attrs",)).collect()}
    assert got == {1: ("<p>a</p>", {"strip-epub3-attrs": 1}), 2: ('<p role="x">a</p>', {}), 3: ('<p role="x">a</p>', {})}
    with pytest.raises(ValueError, match="major"):
        repair.repaired(docs.drop("major"), ("strip-epub3-attrs",))


def test_entities_are_decoded_once(spark):
    texts = ["&eacute;t&eacute; &amp;eacute; &#233;&#x1F600; &notanentity; &AMP; &lt;b&gt;", "plain & text", "&NotEqualTilde;"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.visible_text(F.col("t")).alias("v")).collect()]
    assert got == ["été &eacute; é\U0001F600 &notanentity; & <b>", "plain & text", "\u2242\u0338"]


@pytest.mark.parametrize("name", ["html_blocks", "unwell_formed_pages", "stack_repairs", "audit_report"])
def test_rows_only_queries_run(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
