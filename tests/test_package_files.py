"""Repairs of package files on small packages: decisions as tables, files written back byte for byte elsewhere."""

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import package_files as P

OPF = """<?xml version="1.0"?>
<package version="2.0" unique-identifier="uid"><metadata><dc:identifier>urn:1</dc:identifier><meta name="cover" content="1cov"/></metadata>
<manifest>
<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/>
<item id="1cov" href="c%20v.jpg" media-type="image/png" fallback="f"/>
<item id="f" href="font.ttf" media-type="font/ttf"/>
<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>
</manifest><spine toc="ncx" page-map="m"><itemref idref="a"/><itemref idref="gone"/></spine>
<guide><reference type="cover" href="c%20v.jpg"/><reference type="toc" href="a.xhtml#no"/><reference href="http://x/y"/></guide></package>"""
NCX = """<ncx><head><meta name="dtb:uid" content="old"/></head><navMap>
<navPoint id="1" playOrder="1"><navLabel><text>One</text></navLabel><content src="a.xhtml"/></navPoint>
<navPoint id="p2" playOrder="3"><navLabel><text>Two</text></navLabel><content src="gone.xhtml"/><navPoint id="p3" playOrder="4"><navLabel><text>In</text></navLabel><content src="a.xhtml#x"/></navPoint></navPoint>
<navPoint id="p4" playOrder="5"><navLabel><text>Dead</text></navLabel><content src="gone.xhtml#y"/></navPoint></navMap><pageList><pageTarget><content src="a.xhtml"/></pageTarget></pageList></ncx>"""
NAMES = ["a.xhtml", "c v.jpg", "toc.ncx", "img/new.png"]


@pytest.fixture()
def opf(spark):
    return spark.createDataFrame([("b", "content.opf", OPF)], "book_id string, path string, text string")


@pytest.fixture()
def ncx(spark):
    return spark.createDataFrame([("b", "toc.ncx", NCX)], "book_id string, path string, text string")


@pytest.fixture()
def names(spark):
    return spark.createDataFrame([("b", n) for n in NAMES], "book_id string, path string")


def run(files, *changes):
    row = P.written(files, P.all_of(list(changes))).first()
    return row.text, dict(row.fixes)


def test_elements_know_where_they_are(opf):
    rows = {r.ord: r for r in P.elements(opf).collect()}
    item = next(r for r in rows.values() if r.attrs.get("id") == "1cov")
    assert (item.target, rows[item.parent].name, [rows[k].name for k in item.above]) == ("c v.jpg", "manifest", ["package", "manifest"])
    assert next(r.text for r in rows.values() if r.name == "identifier") == "urn:1"


def test_missing_items_go_with_the_edges_to_them(opf, names):
    text, fixes = run(opf, P.prune_missing(P.elements(opf), names))
    assert fixes == {"manifest_items_pruned": 1, "prune_edges_rewritten": 1}
    assert text == OPF.replace('<item id="f" href="font.ttf" media-type="font/ttf"/>', "").replace(' fallback="f"', "")
    # The item of a reading position stays though its file is missing.
    text, fixes = run(opf, P.prune_missing(P.elements(opf), names.where("path <> 'a.xhtml'")))
    assert fixes["manifest_items_pruned"] == 1 and 'id="a"' in text


def test_references_are_declared(spark, opf, names):
    refs = spark.createDataFrame([("b", "img/new.png", "img/new.png"), ("b", "img/new.png", "img/new.png"), ("b", "no.png", "no.png"), ("b", "a.xhtml", "a.xhtml")], "book_id string, target string, href string")
    text, fixes = run(opf, P.declare_missing(P.elements(opf), refs, names))
    assert fixes == {"manifest_items_declared": 1} and '<item id="declared-d1" href="img/new.png" media-type="image/png"/>\n</manifest>' in text


def test_ids_are_renamed_everywhere(opf, ncx):
    text, fixes = run(opf, P.manifest_ids(P.elements(opf)))
    assert fixes == {"fix_manifest_ids": 1} and text == OPF.replace('"1cov"', '"id_1cov"')
    text, fixes = run(ncx, P.ncx_ids(P.elements(ncx)))
    assert fixes == {"fix_ncx_ids": 1} and text == NCX.replace('id="1"', 'id="id_1"')


def test_identifiers(opf, ncx):
    text, fixes = run(opf, P.unique_identifier(P.elements(opf)))
    assert fixes == {"unique_identifier_wired": 1} and text == OPF.replace("<dc:identifier>", '<dc:identifier id="uid">')
    wired = opf.withColumn("text", F.lit(text))
    assert P.unique_identifier(P.elements(wired)).count() == 0
    assert P.ncx_uid_mismatch(P.elements(ncx), P.elements(wired)).count() == 1 and P.ncx_uid_mismatch(P.elements(ncx), P.elements(opf)).count() == 0
    assert run(ncx, P.ncx_uid(P.elements(ncx), P.elements(wired))) == (NCX.replace("old", "urn:1"), {"ncx_uid_synced": 1})


def test_covers(opf, names):
    assert P.cover_meta(P.elements(opf)).count() == 0
    lost = opf.withColumn("text", F.replace("text", F.lit('content="1cov"'), F.lit('content="zz"')))
    assert run(lost, P.cover_meta(P.elements(lost))) == (OPF, {"cover_meta_repointed": 1})
    blind = opf.withColumn("text", F.lit(OPF.replace('content="1cov"', 'content="zz"').replace('type="cover"', 'type="x"')))
    text, fixes = run(blind, P.cover_meta(P.elements(blind)))
    assert fixes == {"cover_meta_removed": 1} and "<meta " not in text


def test_guides_properties_types_and_page_maps(spark, opf):
    rows = P.elements(opf)
    text, fixes = run(opf, P.guide_refs(rows))
    assert fixes == {"invalid_guide_refs_pruned": 1} and 'type="cover"' not in text
    docs = spark.createDataFrame([("b", "a.xhtml", "<form/><svg/><img src='https://x'/>")], "book_id string, path string, html string")
    assert P.item_properties(rows, docs).count() == 0
    modern = opf.withColumn("text", F.replace("text", F.lit('version="2.0"'), F.lit('version="3.0"')))
    text, fixes = run(modern, P.item_properties(P.elements(modern), docs))
    assert fixes == {"item_properties_added": 1} and 'media-type="application/xhtml+xml" properties="remote-resources scripted svg"/>' in text
    heads = spark.createDataFrame([("b", "c v.jpg", b"\xff\xd8\xff\xe0")], "book_id string, path string, head binary")
    assert run(opf, P.media_types(rows, heads)) == (OPF.replace('media-type="image/png"', 'media-type="image/jpeg"'), {"media_types_normalized": 1})
    assert run(opf, P.page_map(rows)) == (OPF.replace(' page-map="m"', ""), {"page_map_stripped": 1})


def test_dead_spines_go_only_from_shells(opf, names):
    rows = P.elements(opf)
    assert P.dead_spine(rows, names).count() == 0
    text, fixes = run(opf, P.dead_spine(rows, names.where("path <> 'a.xhtml'")))
    assert fixes == {"dead_spine_items_pruned": 1} and '"a"' not in text
    raw = opf.withColumn("text", F.replace("text", F.lit('href="a.xhtml"'), F.lit('href="B#1.xhtml"')))
    coded = names.withColumn("path", F.when(F.col("path") == "a.xhtml", "B#1.xhtml").otherwise(F.col("path")))
    assert P.dead_spine(P.elements(raw), coded).count() == 0


def test_dangling_points_go_or_are_spliced(ncx, names):
    rows = P.elements(ncx)
    assert {(r.label, r.target, r.fragment) for r in P.points(rows).collect()} == {("One", "a.xhtml", None), ("Two", "gone.xhtml", None), ("In", "a.xhtml", "x"), ("Dead", "gone.xhtml", "y"), (None, "a.xhtml", None)}
    text, fixes = run(ncx, P.dangling_points(rows, names))
    assert fixes == {"ncx_dangling_targets_pruned": 2} and "Dead" not in text and "Two" not in text and "In" in text and text.count("navPoint") == 4
    assert P.dangling_points(rows, names.where("path <> 'a.xhtml'")).count() == 0


def test_play_order_and_page_lists(ncx):
    text, fixes = run(ncx, P.play_order(P.elements(ncx)), P.page_list_class(P.elements(ncx)))
    assert fixes == {"fix_ncx_playorder": 3, "pagelist_class_added": 1}
    assert [x.split('"')[0] for x in text.split('playOrder="')[1:]] == ["1", "2", "3", "4"] and '<pageList class="pages" id="page-list">' in text or 'id="page-list"' in text
    again = ncx.withColumn("text", F.lit(text))
    assert P.play_order(P.elements(again)).count() == 0 and P.page_list_class(P.elements(again)).count() == 0


def test_broken_fragments_fall_back_to_their_document(spark, opf, ncx):
    ids = spark.createDataFrame([("b", "a.xhtml", "y"), ("b", "a.xhtml", None)], "book_id string, target string, id string")
    parts = P.broken_fragments(P.elements(ncx), P.elements(opf), ids)
    assert run(ncx, parts.where("path = 'toc.ncx'")) == (NCX.replace("a.xhtml#x", "a.xhtml"), {"ncx_fragments_stripped": 1})
    assert run(opf, parts.where("path = 'content.opf'")) == (OPF.replace("a.xhtml#no", "a.xhtml"), {"guide_fragments_stripped": 1})
    coded = spark.createDataFrame([("b", "a.xhtml", "x"), ("b", "a.xhtml", "n%6F")], "book_id string, target string, id string")
    assert P.broken_fragments(P.elements(ncx), P.elements(opf), coded).count() == 0


def test_references_are_encoded_and_follow_renames(spark):
    html = '<p><a href="B#1.htm">x</a><img src="t[1].png"/><a href="a b.htm#f">y</a><a href="a.htm#z">w</a></p>'
    files = spark.createDataFrame([("b", "t/d.htm", html)], "book_id string, path string, text string")
    names = spark.createDataFrame([("b", n) for n in ("t/B#1.htm", "t/t[1].png", "t/a b.htm", "t/a.htm")], "book_id string, path string")
    rows = P.elements(files)
    text, fixes = run(files, P.encoded_references(rows, names))
    assert fixes == {"refs_delim_encoded": 1, "bracket_refs_encoded": 1} and 'href="B%231.htm"' in text and 'src="t%5B1%5D.png"' in text
    renames = P.rename_map(names)
    assert [tuple(r)[1:] for r in renames.collect()] == [("t/a b.htm", "t/a_b.htm")]
    text, fixes = run(files, P.renamed_references(rows, renames))
    assert fixes == {"renamed_refs_rewritten": 1} and 'href="a_b.htm#f"' in text


def test_containers_and_encryption(spark):
    assert 'full-path="T &amp; J.opf"' in spark.range(1).select(P.container(F.lit("T & J.opf")).alias("c")).first().c
    one = lambda uri, algo: f'<enc:EncryptedData><enc:EncryptionMethod Algorithm="{algo}"/><enc:CipherData><enc:CipherReference URI="{uri}"/></enc:CipherData></enc:EncryptedData>'
    text = f'<encryption xmlns="x">{one("f%201.otf", P.OBFUSCATION[0])}{one("c1.xhtml", "http://drm")}</encryption>'
    files = spark.createDataFrame([("b", "META-INF/encryption.xml", text)], "book_id string, path string, text string")
    assert {(r.target, r.drm) for r in P.encrypted(files).collect()} == {("f 1.otf", False), ("c1.xhtml", True)}


def test_stub_documents_go_everywhere(spark, opf, ncx):
    nav = spark.createDataFrame([("b", "nav.xhtml", '<nav><ol><li><a href="a.xhtml">One</a><ol><li><a href="b.xhtml">Two</a></li></ol></li><li><a href="c.xhtml">Three</a></li></ol></nav>')], "book_id string, path string, text string")
    stubs = spark.createDataFrame([("b", "b.xhtml"), ("b", "gone.xhtml"), ("b", "a.xhtml")], "book_id string, path string")
    changes = P.stub_documents(P.elements(opf), P.elements(ncx), P.elements(nav), stubs.where("path <> 'a.xhtml'"))
    text, fixes = run(nav, changes.where("path = 'nav.xhtml'"))
    assert fixes == {"stub_nav_items_dropped": 1} and "Two" not in text and "One" in text and "Three" in text
    text, fixes = run(ncx, changes.where("path = 'toc.ncx'"))
    assert fixes == {"stub_navpoints_dropped": 2} and "Dead" not in text
    text, fixes = run(opf, P.stub_documents(P.elements(opf), P.elements(ncx), P.elements(nav), stubs).where("path = 'content.opf'"))
    assert fixes == {"stub_manifest_items_dropped": 1, "stub_itemrefs_dropped": 1} and '"a"' not in text
