"""Repairs of package files (manifests, tables of contents) as decisions over a table of their elements.

`elements` reads XML files into rows; each repair is a DataFrame of edits (EDIT) that joins and groups find; `written`
applies all edits of a file in one go, so what isn't edited stays byte for byte. Files are keyed by (book_id, path). As
repairs look at elements more than once, keep them as a table (or persisted) when several repairs share them.
"""

from __future__ import annotations

import posixpath
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import markup
from vellumspark.functions import text as X
from vellumspark.functions.kernels import norm_path, resolve_href

ELEMENTS = "array<struct<ord:int,parent:int,above:array<int>,name:string,attrs:map<string,string>,text:string,href:string,target:string,fragment:string>>"
#: The same as Arrow has them.
ELEMENT_LISTS = pa.list_(pa.struct([("ord", pa.int32()), ("parent", pa.int32()), ("above", pa.list_(pa.int32())), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("href", pa.string()), ("target", pa.string()), ("fragment", pa.string())]))
EDIT = ("book_id", "path", "ord", "action", "name", "value", "fix")
#: Media types of content documents, of what may be declared by extension, and the properties of documents.
CONTENT_TYPES = ("application/xhtml+xml", "text/html", "application/x-dtbook+xml")
CONTENT_SUFFIX = "(?i)\\.(?:xhtml|html|htm)$"
DECLARED_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "css": "text/css",
    "xhtml": "application/xhtml+xml", "html": "application/xhtml+xml", "htm": "application/xhtml+xml", "ncx": "application/x-dtbncx+xml",
    "otf": "font/otf", "ttf": "font/ttf", "woff": "font/woff", "woff2": "font/woff2", "xpgt": "application/vnd.adobe-page-template+xml",
}
PROPERTIES = {"remote-resources": "(?is)\\ssrc\\s*=\\s*[\"']https?://|<link\\b[^>]*?\\shref\\s*=\\s*[\"']https?://|url\\(\\s*[\"']?https?://", "scripted": "(?i)<(?:script|form)\\b", "svg": "(?i)<svg\\b"}
#: Attributes that hold the id of a manifest item.
EDGES = ("toc", "fallback", "media-overlay")
POINTS = ("navpoint", "navtarget", "pagetarget")


def parsed(path: Column, text: Column) -> Column:
    """The elements of a file as an array; null for a null text."""

    def one(path: str, source: str) -> list[dict]:
        base, rows, lines = posixpath.dirname(path), [], []
        for at, e in enumerate(markup.tree(source)):
            # The ancestors of an element are those of its parent and the parent.
            lines.append([*lines[e.parent], e.parent] if e.parent >= 0 else [])
            attrs = {a[0]: a[1] for a in markup.attributes(source, e.start, e.inner)}
            href = attrs.get("href", attrs.get("src"))
            own = "".join(source[a:b] for a, b in e.texts).strip()
            rows.append({"ord": at, "parent": e.parent, "above": lines[-1], "name": markup.local(e.name), "attrs": [*attrs.items()], "text": own, "href": href, "target": resolve_href(base, href), "fragment": href.partition("#")[2] if href and "#" in href else None})
        return rows

    @F.arrow_udf(ELEMENTS)
    def run(paths: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([None if source is None else one(path or "", source) for path, source in zip(paths.to_pylist(), texts.to_pylist(), strict=True)], ELEMENT_LISTS)

    return run(path, text)


def elements(files: DataFrame) -> DataFrame:
    """One row an element of files (book_id, path, text): ord in document order, parent, above (its ancestors), name
    (without prefix, lower case), attrs, text of its own, href (or src), target (the archive path it names), fragment."""
    own = dict(files.dtypes)
    schema = f"book_id {own['book_id']}, path string, ord int, parent int, above array<int>, name string, attrs map<string,string>, text string, href string, target string, fragment string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, ord_, parent, name, text, href, target, fragment = ([] for _ in range(8))
            above, above_ends, keys, values, attr_ends = [], [0], [], [], [0]
            paths, texts = batch.column("path").to_pylist(), batch.column("text").to_pylist()
            for k, (path, source) in enumerate(zip(paths, texts, strict=True)):
                base, lines = posixpath.dirname(path or ""), []
                for at, e in enumerate(markup.tree(source or "")):
                    # The ancestors of an element are those of its parent and the parent.
                    lines.append([*lines[e.parent], e.parent] if e.parent >= 0 else [])
                    attrs = {a[0]: a[1] for a in markup.attributes(source, e.start, e.inner)}
                    link = attrs.get("href", attrs.get("src"))
                    of.append(k), ord_.append(at), parent.append(e.parent), name.append(markup.local(e.name)), href.append(link)
                    text.append("".join(source[a:b] for a, b in e.texts).strip())
                    target.append(resolve_href(base, link)), fragment.append(link.partition("#")[2] if link and "#" in link else None)
                    above += lines[-1]
                    keys += attrs
                    values += attrs.values()
                    above_ends.append(len(above)), attr_ends.append(len(keys))
            if not of:
                continue
            strings = lambda x: pa.array(x, pa.string())
            ints = lambda x: pa.array(x, pa.int32())
            taken = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("book_id").take(taken), batch.column("path").take(taken), ints(ord_), ints(parent), pa.ListArray.from_arrays(ints(above_ends), ints(above)), strings(name),
                 pa.MapArray.from_arrays(ints(attr_ends), strings(keys), strings(values)), strings(text), strings(href), strings(target), strings(fragment)],
                [c.split()[0] for c in schema.split(", ")],
            )

    return files.select("book_id", "path", "text").mapInArrow(run, schema)


def edits(rows: DataFrame, fix: str, action: str, name: Column | None = None, value: Column | None = None) -> DataFrame:
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return rows.select("book_id", "path", "ord", F.lit(action).alias("action"), text(name).alias("name"), text(value).alias("value"), F.lit(fix).alias("fix"))


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def written(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files (book_id, path, text) after the changes, `fixes`, a map of how many there were of each kind, and `edited`."""
    # Edits of one file: as many as it has elements, not more.
    own = changes.groupBy("book_id", "path").agg(F.array_sort(F.collect_list(F.struct("ord", "action", "name", "value", "fix"))).alias("edits"))

    def one(text: str, made: list[dict]) -> tuple[str, list[tuple[str, int]]]:
        counts = Counter(x["fix"] for x in made if x["fix"] is not None)
        return markup.edited(text, [(x["ord"], x["action"], x["name"], x["value"]) for x in made]), list(counts.items())

    @F.arrow_udf("text string, fixes map<string,bigint>")
    def apply(texts: pa.Array, lists: pa.Array) -> pa.Array:
        rows = [one(text, made) if made else (text, []) for text, made in zip(texts.to_pylist(), lists.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.map_(pa.string(), pa.int64()))], ["text", "fixes"])

    joined = files.join(own, ["book_id", "path"], "left").withColumn("done", apply(F.col("text"), F.col("edits")))
    return joined.withColumns({"text": F.col("done.text"), "fixes": F.col("done.fixes"), "edited": F.col("edits").isNotNull()}).drop("edits", "done")


def attr(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def items(opf: DataFrame) -> DataFrame:
    return opf.where("name = 'item'").select("book_id", "path", "ord", "attrs", attr("id").alias("id"), "href", "target", attr("media-type").alias("media_type"), F.filter(F.split(F.coalesce(attr("properties"), F.lit("")), "\\s+"), lambda p: p != "").alias("properties"))


def _known(names: DataFrame) -> DataFrame:
    return names.select("book_id", F.col("path").alias("target"), F.lit(True).alias("there")).distinct()


def _spine_ids(opf: DataFrame) -> DataFrame:
    return opf.where("name = 'itemref'").select("book_id", attr("idref").alias("id")).distinct()


# Manifests


def edges_to(opf: DataFrame, gone: DataFrame, fix: str) -> DataFrame:
    """Attributes and cover metas that name ids which are gone (book_id, id)."""
    holders = opf.where(F.col("name").isin("spine", "item", "itemref"))
    named = holders.select("book_id", "path", "ord", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), attr(a).alias("id")) for a in EDGES])).alias("x")).select("book_id", "path", "ord", "x.a", "x.id")
    cover = opf.where((F.col("name") == "meta") & (F.lower(attr("name")) == "cover")).select("book_id", "path", "ord", attr("content").alias("id"))
    return all_of([edits(named.join(gone, ["book_id", "id"], "left_semi"), fix, "unset", F.col("a")), edits(cover.join(gone, ["book_id", "id"], "left_semi"), fix, "drop")])


def missing_items(declared: DataFrame, names: DataFrame, spine: DataFrame) -> DataFrame:
    """Items (book_id, id, target) whose file the archive (names: book_id, path) lacks and that no reading position (spine:
    book_id, id) names."""
    return declared.where("target is not null").join(_known(names), ["book_id", "target"], "left_anti").join(spine, ["book_id", "id"], "left_anti")


def undeclared(refs: DataFrame, names: DataFrame, declared: DataFrame) -> DataFrame:
    """book_id, target, n: files that are referred to and there, but not declared, numbered in the order of their paths."""
    wanted = refs.select("book_id", "target").distinct().join(_known(names), ["book_id", "target"], "left_semi").join(declared.select("book_id", "target"), ["book_id", "target"], "left_anti")
    return wanted.withColumn("n", F.row_number().over(Window.partitionBy("book_id").orderBy("target")))


def numbered_ids(ids: DataFrame) -> DataFrame:
    """ids (doc, pos, id) with new_id: the first of a value keeps it, later ones get `_2`, `_3`, ..."""
    k = F.row_number().over(Window.partitionBy("doc", "id").orderBy("pos"))
    return ids.withColumn("k", k).withColumn("new_id", F.when(F.col("k") > 1, F.concat("id", F.lit("_"), F.col("k").cast("string"))).otherwise(F.col("id"))).drop("k")


def prune_missing(opf: DataFrame, names: DataFrame) -> DataFrame:
    """Missing items go, with the edges to them; reading positions stay."""
    dead = missing_items(items(opf), names, _spine_ids(opf))
    edges = edges_to(opf, dead.select("book_id", "id").where("id is not null").distinct(), "prune_edges_rewritten")
    # An edge of an item that goes itself goes with it.
    return all_of([edits(dead, "manifest_items_pruned", "drop"), edges.join(dead.select("book_id", "path", "ord"), ["book_id", "path", "ord"], "left_anti")])


def declare_missing(opf: DataFrame, refs: DataFrame, names: DataFrame) -> DataFrame:
    """One item for each file that is referred to (refs: book_id, target, href), is there and isn't declared.

    Ids are numbered in the order of paths; a reference with a fragment, a space or a scheme is no evidence.
    """
    wanted = undeclared(refs.where(F.col("target").isNotNull() & ~F.col("href").rlike("[# ]")), names, items(opf))
    kinds = F.create_map(*[F.lit(x) for pair in DECLARED_TYPES.items() for x in pair])
    taken = opf.where(attr("id").isNotNull()).groupBy("book_id").agg(F.collect_set(attr("id")).alias("ids"))
    place = opf.where("name = 'manifest'").select("book_id", "path", "ord")
    found = wanted.join(place, "book_id").join(taken, "book_id", "left")
    found = found.withColumn("type", F.try_element_at(kinds, F.lower(F.regexp_extract("target", "\\.([^./]+)$", 1)))).where("type is not null")
    plain_id = F.concat(F.lit("declared-d"), F.col("n").cast("string"))
    # As many underscores as it takes: the ids that end like it and have only underscores before that are tried from the shortest.
    longer = F.filter(F.coalesce("ids", F.array().cast("array<string>")), lambda i: F.regexp_replace(i, "^_+", "") == plain_id)
    free = F.aggregate(F.array_sort(F.transform(longer, F.length)), plain_id, lambda own, size: F.when(F.length(own) == size, F.concat(F.lit("_"), own)).otherwise(own))

    @F.pandas_udf("string")
    def item(own: pd.Series, path: pd.Series, target: pd.Series, kind: pd.Series) -> pd.Series:
        rel = [posixpath.relpath(t, posixpath.dirname(p) or ".") for p, t in zip(path, target, strict=True)]
        return pd.Series([f'<item id="{i}" href="{markup.escaped(h)}" media-type="{k}"/>\n' for i, h, k in zip(own, rel, kind, strict=True)])

    return edits(found.withColumn("own", free), "manifest_items_declared", "append", value=item(F.col("own"), F.col("path"), F.col("target"), F.col("type")))


def dead_spine(opf: DataFrame, names: DataFrame, share: float = 0.5) -> DataFrame:
    """In a package of which half of the content items or more have no file, those items go with their reading positions.

    An item that would be found with its delimiters encoded is damaged, not dead.
    """
    content = items(opf).where(F.col("id").isNotNull() & F.col("href").rlike(CONTENT_SUFFIX))
    content = content.withColumn("variant", delimiter_variant(F.col("path"), F.col("href")))
    there = _known(names)
    content = content.join(there, ["book_id", "target"], "left").join(there.select("book_id", F.col("target").alias("variant"), F.lit(True).alias("encoded")), ["book_id", "variant"], "left")
    dead = content.withColumn("dead", F.col("there").isNull() & F.col("encoded").isNull())
    shells = dead.groupBy("book_id").agg(F.avg(F.col("dead").cast("int")).alias("dead_share")).where(F.col("dead_share") >= share)
    gone = dead.where("dead").join(shells, "book_id", "left_semi")
    places = opf.where("name = 'itemref'").withColumn("id", attr("idref")).join(gone.select("book_id", "id").distinct(), ["book_id", "id"], "left_semi")
    return all_of([edits(gone, "dead_spine_items_pruned", "drop"), edits(places, "dead_spine_items_pruned", "drop").withColumn("fix", F.lit(None).cast("string"))])


def cover_meta(opf: DataFrame) -> DataFrame:
    """A cover meta that names no item is pointed at the one item with the file that the guide calls the cover, or goes."""
    ids = items(opf).select("book_id", F.col("id").alias("content")).where("content is not null").distinct()
    metas = opf.where((F.col("name") == "meta") & (F.lower(attr("name")) == "cover")).withColumn("content", attr("content")).where("content <> ''").join(ids, ["book_id", "content"], "left_anti")
    guide = opf.where((F.col("name") == "reference") & (F.lower(attr("type")) == "cover") & F.col("href").isNotNull()).groupBy("book_id").agg(F.min_by("target", "ord").alias("target"))
    one = items(opf).where("id is not null").join(guide, ["book_id", "target"]).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    found = metas.join(one, "book_id", "left")
    return all_of([edits(found.where("id is not null"), "cover_meta_repointed", "set", F.lit("content"), F.col("id")), edits(found.where("id is null"), "cover_meta_removed", "drop")])


def guide_refs(opf: DataFrame) -> DataFrame:
    """Guide references to files that are declared as something else than a content document."""
    types = items(opf).where("target is not null and media_type is not null").groupBy("book_id", "target").agg(F.max_by("media_type", "ord").alias("type"))
    return edits(opf.where("name = 'reference'").join(types, ["book_id", "target"]).where(~F.col("type").isin(*CONTENT_TYPES)), "invalid_guide_refs_pruned", "drop")


def document_properties(html: Column) -> Column:
    """The EPUB 3 properties that a document's markup demands, sorted."""
    return F.array_sort(F.array_compact(F.array(*[F.when(html.rlike(p), F.lit(name)) for name, p in PROPERTIES.items()])))


def item_properties(opf: DataFrame, docs: DataFrame) -> DataFrame:
    """Items of EPUB 3 packages whose properties lack what their document (docs: book_id, path, html) demands."""
    modern = opf.where((F.col("name") == "package") & (X.package_major(attr("version")) >= 3)).select("book_id").distinct()
    needed = docs.select("book_id", F.col("path").alias("target"), document_properties(F.col("html")).alias("needed")).where(F.size("needed") > 0)
    found = items(opf).join(modern, "book_id", "left_semi").join(needed, ["book_id", "target"]).where(F.size(F.array_except("needed", "properties")) > 0)
    return edits(found, "item_properties_added", "set", F.lit("properties"), F.array_join(F.array_sort(F.array_union("properties", "needed")), " "))


def media_types(opf: DataFrame, heads: DataFrame) -> DataFrame:
    """Items whose extension and first bytes agree on another type than the declared one."""
    from vellumspark.operators.package import wrong_media_types

    files = items(opf).select("book_id", F.col("path").alias("opf_path"), "ord", F.col("target").alias("path"), "media_type").where("path is not null")
    wrong = wrong_media_types(files, heads).withColumn("path", F.col("opf_path"))
    return edits(wrong, "media_types_normalized", "set", F.lit("media-type"), F.col("expected"))


def page_map(opf: DataFrame) -> DataFrame:
    return edits(opf.where((F.col("name") == "spine") & attr("page-map").isNotNull()), "page_map_stripped", "unset", F.lit("page-map"))


# Identifiers


def planned_renames(ids: Column) -> Column:
    """A map from each id that is no XML name to a new one, given a file's distinct ids; in the order of the old ones."""

    @F.pandas_udf("map<string,string>")
    def run(lists: pd.Series) -> pd.Series:
        out = []
        for own in lists:
            taken, plan = set(own), {}
            for old in sorted(own):
                if X.invalid_name(old):
                    new = "id_" + X.sanitised(old)
                    while new in taken:
                        new = "_" + new
                    taken.add(new)
                    plan[old] = new
            out.append(plan)
        return pd.Series(out)

    return run(ids)


def _renamed(rows: DataFrame, plans: DataFrame, fix: str, names: tuple[str, ...]) -> DataFrame:
    """Edits of the named attributes of rows (with `old`, the attribute and value in question) by the plans."""
    each = rows.select("book_id", "path", "ord", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), attr(a).alias("old")) for a in names])).alias("x")).select("book_id", "path", "ord", "x.a", "x.old")
    found = each.join(plans, "book_id").withColumn("new", F.try_element_at("plan", F.col("old"))).where("new is not null")
    return edits(found, fix, "set", F.col("a"), F.col("new"))


def manifest_ids(opf: DataFrame) -> DataFrame:
    """Item ids that are no XML names, with everything in the package that names them."""
    plans = items(opf).where("id is not null").groupBy("book_id").agg(F.array_sort(F.collect_set("id")).alias("ids")).select("book_id", planned_renames(F.col("ids")).alias("plan"))
    quiet = lambda d: d.withColumn("fix", F.lit(None).cast("string"))
    cover = opf.where((F.col("name") == "meta") & (F.lower(attr("name")) == "cover"))
    parts = [_renamed(opf.where("name = 'item'"), plans, "fix_manifest_ids", ("id",)), quiet(_renamed(opf.where("name = 'item'"), plans, "", ("fallback", "media-overlay"))), quiet(_renamed(opf.where("name = 'itemref'"), plans, "", ("idref",))), quiet(_renamed(opf.where("name = 'spine'"), plans, "", ("toc",))), quiet(_renamed(cover, plans, "", ("content",)))]
    return all_of(parts)


def ncx_ids(ncx: DataFrame) -> DataFrame:
    """Ids in a table of contents that are no XML names; nothing else refers to them."""
    own = ncx.where(attr("id").isNotNull())
    plans = own.groupBy("book_id").agg(F.array_sort(F.collect_set(attr("id"))).alias("ids")).select("book_id", planned_renames(F.col("ids")).alias("plan"))
    return _renamed(own, plans, "fix_ncx_ids", ("id",))


def package_uid(opf: DataFrame) -> DataFrame:
    """book_id, uid: the text of the element that the package's unique-identifier names."""
    named = opf.where("name = 'package'").groupBy("book_id").agg(F.min_by(attr("unique-identifier"), "ord").alias("id"))
    values = opf.withColumn("id", attr("id")).where("id is not null and text <> ''").join(named, ["book_id", "id"])
    return values.groupBy("book_id").agg(F.min_by("text", "ord").alias("uid"))


def _dtb_uid(ncx: DataFrame) -> DataFrame:
    return ncx.where((F.col("name") == "meta") & (F.lower(attr("name")) == "dtb:uid") & attr("content").isNotNull())


def ncx_uid(ncx: DataFrame, opf: DataFrame) -> DataFrame:
    """The table of contents takes the package's identifier."""
    found = _dtb_uid(ncx).join(package_uid(opf), "book_id").where(attr("content") != F.col("uid"))
    return edits(found, "ncx_uid_synced", "set", F.lit("content"), F.col("uid"))


def ncx_uid_mismatch(ncx: DataFrame, opf: DataFrame) -> DataFrame:
    """book_id of packages whose two identifiers differ: the candidates of a repair of tables of contents."""
    return ncx_uid(ncx, opf).select("book_id").distinct()


def unique_identifier(opf: DataFrame) -> DataFrame:
    """The id that the package names goes onto the first dc:identifier, unless anything about that is a guess: the name
    is absent or no XML name, something has it already, or the first identifier has an id of its own."""
    named = opf.where("name = 'package'").groupBy("book_id").agg(F.min_by(attr("unique-identifier"), "ord").alias("uid"))
    first = opf.where("name = 'identifier'").groupBy("book_id", "path").agg(F.min(F.struct("ord", attr("id").alias("id"))).alias("f")).select("book_id", "path", "f.ord", "f.id")
    has = opf.select("book_id", attr("id").alias("uid")).where("uid is not null").distinct()
    found = first.where("id is null").join(named, "book_id").where(~X.is_invalid_ncname(F.col("uid"))).join(has, ["book_id", "uid"], "left_anti")
    return edits(found, "unique_identifier_wired", "set", F.lit("id"), F.col("uid"))


# Tables of contents and fragments


def points(ncx: DataFrame) -> DataFrame:
    """Points of a table of contents: ord, above, kind, label, src, target, fragment, play_order.

    The label and the target are those of its own navLabel and content, not of points inside.
    """
    own = ncx.where(F.col("name").isin(*POINTS)).select("book_id", "path", "ord", "above", "parent", F.col("name").alias("kind"), attr("playOrder").alias("play_order"))
    content = ncx.where("name = 'content'").groupBy("book_id", "path", F.col("parent").alias("ord")).agg(F.min_by(F.struct("href", "target", "fragment", F.col("ord").alias("content_ord")), "ord").alias("c"))
    texts = ncx.where("name = 'text'").select("book_id", "path", F.col("parent").alias("label_ord"), "text")
    labels = ncx.where("name = 'navlabel'").select("book_id", "path", F.col("ord").alias("label_ord"), F.col("parent").alias("ord")).join(texts, ["book_id", "path", "label_ord"])
    labels = labels.groupBy("book_id", "path", "ord").agg(F.min_by("text", "label_ord").alias("label"))
    keys = ["book_id", "path", "ord"]
    out = own.join(content, keys, "left").join(labels, keys, "left")
    return out.select(*keys, "above", "parent", "kind", "label", F.col("c.href").alias("src"), F.col("c.target").alias("target"), F.col("c.fragment").alias("fragment"), F.col("c.content_ord").alias("content_ord"), "play_order")


def toc_references(ncx: DataFrame, nav: DataFrame) -> DataFrame:
    """book_id, path (null for fragments alone and schemes) of each reference of both tables of contents (their elements)."""
    navs = nav.where("name = 'nav'").select("book_id", "path", F.col("ord").alias("up"))
    links = nav.where("name = 'a' and href is not null").select("book_id", "path", "target", F.explode("above").alias("up")).join(navs, ["book_id", "path", "up"], "left_semi")
    return points(ncx).where("src is not null").select("book_id", F.col("target").alias("path")).union(links.select("book_id", "target"))


def broken_fragments(ncx: DataFrame, opf: DataFrame, ids: DataFrame) -> DataFrame:
    """References of tables of contents and guides to a document that is there (ids: book_id, target, id) but lacks the
    fragment: the fragment goes, the document stays."""
    docs = ids.select("book_id", "target").distinct()
    own = ids.where("id is not null").select("book_id", "target", F.col("id").alias("fragment"))
    have = own.union(own.withColumn("fragment", norm_fragment(F.col("fragment")))).distinct()

    def lost(refs: DataFrame) -> DataFrame:
        named = refs.where("target is not null and fragment is not null").join(docs, ["book_id", "target"], "left_semi")
        plain = named.withColumn("plain", norm_fragment(F.col("fragment")))
        return plain.join(have, ["book_id", "target", "fragment"], "left_anti").join(have.withColumnRenamed("fragment", "plain"), ["book_id", "target", "plain"], "left_anti")

    whole = F.regexp_replace("href", "#.*$", "")
    return all_of([
        edits(lost(ncx.where("name = 'content'")), "ncx_fragments_stripped", "set", F.lit("src"), whole),
        edits(lost(opf.where("name = 'reference'")), "guide_fragments_stripped", "set", F.lit("href"), whole),
    ])


def dangling_points(ncx: DataFrame, names: DataFrame) -> DataFrame:
    """Points whose own document isn't in the archive: they go, or are spliced where a point inside lives on.

    A table whose points would all go is left alone, as it must not be empty.
    """
    found = points(ncx).join(_known(names), ["book_id", "target"], "left")
    return _without_points(ncx, found.withColumn("dead", F.col("target").isNotNull() & F.col("there").isNull()), "ncx_dangling_targets_pruned")


def _without_points(ncx: DataFrame, found: DataFrame, fix: str) -> DataFrame:
    keys = ["book_id", "path", "ord"]
    alive = found.where("not dead").select("book_id", "path", F.explode(F.concat("above", F.array("ord"))).alias("ord")).distinct().withColumn("lives", F.lit(True))
    # Containers that hold points, but none that lives on.
    holders = found.select("book_id", "path", F.col("parent").alias("ord")).distinct().join(ncx.where("name in ('navmap', 'pagelist')").select(*keys), keys, "left_semi")
    emptied = holders.join(alive, keys, "left_anti").select("book_id", "path").distinct()
    dead = found.where("dead").join(alive, keys, "left").join(emptied, ["book_id", "path"], "left_anti")
    gone = dead.where("lives is null")
    # What goes inside of what goes is one edit.
    inside = gone.select(*keys, F.explode("above").alias("over")).join(gone.select("book_id", "path", F.col("ord").alias("over")), ["book_id", "path", "over"], "left_semi").select(*keys).distinct()
    return all_of([edits(gone.join(inside, keys, "left_anti"), fix, "drop"), edits(dead.where("lives"), fix, "splice", F.lit(" ".join(POINTS)))])


def stub_documents(opf: DataFrame, ncx: DataFrame, nav: DataFrame, stubs: DataFrame) -> DataFrame:
    """Everything that names a stub document (stubs: book_id, path): items, reading positions, edges, points of the table
    of contents and list items of navigation documents (nav: their elements). The documents themselves are the caller's."""
    gone = stubs.select("book_id", F.col("path").alias("target"), F.lit(True).alias("stub")).distinct()
    dead = items(opf).join(gone, ["book_id", "target"], "left_semi")
    ids = dead.select("book_id", "id").where("id is not null").distinct()
    places = opf.where("name = 'itemref'").withColumn("id", attr("idref")).join(ids, ["book_id", "id"], "left_semi")
    edges = edges_to(opf, ids, "stub_edges_rewritten").join(dead.select("book_id", "path", "ord"), ["book_id", "path", "ord"], "left_anti")
    marked = points(ncx).join(gone, ["book_id", "target"], "left").withColumn("dead", F.coalesce("stub", F.lit(False)))
    links = nav.where("name = 'a'").join(gone, ["book_id", "target"], "left_semi").select("book_id", "path", F.explode("above").alias("ord"))
    entries = nav.where("name = 'li'").join(links.distinct(), ["book_id", "path", "ord"], "left_semi")
    # Only the innermost list item of a link: one that holds another such item stays.
    holders = entries.select("book_id", "path", F.explode("above").alias("ord")).distinct()
    return all_of([edits(dead, "stub_manifest_items_dropped", "drop"), edits(places, "stub_itemrefs_dropped", "drop"), edges, _without_points(ncx, marked, "stub_navpoints_dropped"), edits(entries.join(holders, ["book_id", "path", "ord"], "left_anti"), "stub_nav_items_dropped", "drop")])


def play_order(ncx: DataFrame, force: bool = False) -> DataFrame:
    """playOrder of files where it isn't one number for each target, apart and without gaps: by first appearance."""
    found = points(ncx).where("play_order is not null").withColumn("place", F.coalesce(F.concat_ws("#", "target", "fragment"), F.col("src"), F.col("ord").cast("string")))
    found = found.withColumn("n", F.col("play_order").try_cast("long"))
    groups = found.groupBy("book_id", "path", "place").agg(F.min("ord").alias("first"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.count_if(F.col("n").isNull()).alias("bad"))
    one = (F.sum("bad") == 0) & F.bool_and(F.col("lo") == F.col("hi")) & (F.count_distinct("lo") == F.count(F.lit(1))) & (F.max("lo") - F.min("lo") + 1 == F.count(F.lit(1)))
    wrong = groups.groupBy("book_id", "path").agg(one.alias("good")).where(F.lit(True) if force else ~F.col("good"))
    new = groups.join(wrong, ["book_id", "path"], "left_semi").withColumn("new", F.dense_rank().over(Window.partitionBy("book_id", "path").orderBy("first")).cast("string"))
    changed = found.join(new.select("book_id", "path", "place", "new"), ["book_id", "path", "place"]).where("play_order <> new")
    return edits(changed, "fix_ncx_playorder", "set", F.lit("playOrder"), F.col("new"))


def page_list_class(ncx: DataFrame) -> DataFrame:
    """pageList without a class gets one, and an id that nothing else has."""
    lists = ncx.where((F.col("name") == "pagelist") & attr("class").isNull())
    ids = ncx.where(attr("id").isNotNull()).groupBy("book_id", "path").agg(F.collect_set(attr("id")).alias("ids"))
    found = lists.join(ids, ["book_id", "path"], "left").withColumn("n", F.row_number().over(Window.partitionBy("book_id", "path").orderBy("ord")))
    taken = F.coalesce("ids", F.array().cast("array<string>"))
    number = lambda k: F.when(k == 1, "page-list").otherwise(F.concat(F.lit("page-list-"), k.cast("string")))
    free = F.filter(F.transform(F.sequence(F.lit(1), F.size(taken) + F.col("n")), number), lambda i: ~F.array_contains(taken, i))
    no_id = found.where(attr("id").isNull())
    return all_of([edits(found, "pagelist_class_added", "set", F.lit("class"), F.lit("pages")), edits(no_id, "", "set", F.lit("id"), F.get(free, F.col("n") - 1)).withColumn("fix", F.lit(None).cast("string"))])


# References


def norm_fragment(fragment: Column) -> Column:
    """A fragment as an id is spelled: percent-decoded, as far as it is UTF-8."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else X.percent_decoded(x))

    return run(fragment)


def delimiter_variant(path: Column, href: Column) -> Column:
    """The archive path that an href names if its `#` and `?` belong to the file name; null where they can't."""

    @F.pandas_udf("string")
    def run(paths: pd.Series, hrefs: pd.Series) -> pd.Series:
        out = []
        for p, h in zip(paths, hrefs, strict=True):
            odd = h is None or not ("#" in h or "?" in h) or h[:1] in "#?" or "&#" in h
            found = None if odd else resolve_href(posixpath.dirname(p), h.replace("#", "%23").replace("?", "%3F"))
            out.append(found)
        return pd.Series(out)

    return run(path, href)


def encoded_brackets(href: Column) -> Column:
    """`[` and `]` of an href's path as percent codes; what follows its first `#` or `?` stays."""
    path = F.regexp_extract(href, "(?s)^([^#?]*)", 1)
    return F.concat(F.replace(F.replace(path, F.lit("["), F.lit("%5B")), F.lit("]"), F.lit("%5D")), F.substring(href, F.length(path) + 1, F.length(href)))


def encoded_references(refs: DataFrame, names: DataFrame) -> DataFrame:
    """Edits of references (elements with href) whose brackets, or whose raw `#` and `?`, must be encoded to name a file
    that is there: brackets where the target is, delimiters where it isn't but its variant is."""
    there = _known(names)
    known = refs.where("href is not null").withColumn("a", F.when(attr("href").isNotNull(), "href").otherwise("src"))
    found = known.join(there, ["book_id", "target"], "left").withColumn("variant", delimiter_variant(F.col("path"), F.col("href")))
    found = found.join(there.select("book_id", F.col("target").alias("variant"), F.lit(True).alias("v")), ["book_id", "variant"], "left")
    brackets = found.where(F.col("there") & (encoded_brackets(F.col("href")) != F.col("href")))
    delims = found.where(F.col("there").isNull() & F.col("v"))
    coded = F.replace(F.replace("href", F.lit("#"), F.lit("%23")), F.lit("?"), F.lit("%3F"))
    return all_of([edits(brackets, "bracket_refs_encoded", "set", F.col("a"), encoded_brackets(F.col("href"))), edits(delims, "refs_delim_encoded", "set", F.col("a"), coded)])


def rename_map(names: DataFrame) -> DataFrame:
    """book_id, path, new_path: entries with spaces get underscores, unless another entry has or would get that name."""
    whole = names.withColumn("new_path", F.replace("path", F.lit(" "), F.lit("_"))).groupBy("book_id", "new_path").agg(F.count(F.lit(1)).alias("k"), F.min("path").alias("path"))
    return whole.where((F.col("k") == 1) & F.contains("path", F.lit(" "))).select("book_id", "path", "new_path")


def renamed_references(refs: DataFrame, renames: DataFrame) -> DataFrame:
    """References to renamed entries (renames: book_id, path, new_path), with the new name in place of the old, seen from
    where their own file will be, and their fragment kept."""
    own = renames.select("book_id", "path", F.col("new_path").alias("own_path"))
    found = refs.join(renames.select("book_id", F.col("path").alias("target"), "new_path"), ["book_id", "target"]).join(own, ["book_id", "path"], "left")
    found = found.withColumn("a", F.when(attr("href").isNotNull(), "href").otherwise("src"))

    @F.pandas_udf("string")
    def relative(path: pd.Series, new: pd.Series, href: pd.Series) -> pd.Series:
        named = [posixpath.relpath(n, posixpath.dirname(p) or ".").replace("[", "%5B").replace("]", "%5D") for p, n in zip(path, new, strict=True)]
        return pd.Series([r + (f"#{h.partition('#')[2]}" if "#" in h else "") for r, h in zip(named, href, strict=True)])

    return edits(found, "renamed_refs_rewritten", "set", F.col("a"), relative(F.coalesce("own_path", "path"), F.col("new_path"), F.col("href")))


def with_delimiters(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Elements whose href names nothing as it stands, but a file with its delimiters encoded, with that file as target."""
    there = _known(names)
    odd = rows.where("href is not null").select("book_id", "path", "ord", "target", delimiter_variant(F.col("path"), F.col("href")).alias("variant")).where("variant is not null")
    odd = odd.join(there, ["book_id", "target"], "left_anti").join(there.select("book_id", F.col("target").alias("variant")), ["book_id", "variant"], "left_semi")
    out = rows.join(odd.select("book_id", "path", "ord", "variant"), ["book_id", "path", "ord"], "left")
    return out.withColumn("target", F.coalesce("variant", "target")).select(*rows.columns)


# Containers and encryption


def container(opf_path: Column) -> Column:
    """META-INF/container.xml for a package at that path."""
    safe = F.replace(F.replace(F.replace(opf_path, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">\n  <rootfiles>\n    <rootfile full-path="'),
        safe, F.lit('" media-type="application/oebps-package+xml"/>\n  </rootfiles>\n</container>\n'),
    )


#: Algorithms that obfuscate fonts and protect nothing.
OBFUSCATION = ("http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC", "http://www.adobe.com/2005/pdf/enc#RC")


def encrypted(files: DataFrame) -> DataFrame:
    """book_id, target, algorithm, drm of each file that an encryption declaration (files: META-INF/encryption.xml) names."""
    rows = elements(files)
    whole = rows.where("name = 'encrypteddata'").select("book_id", F.col("ord").alias("of"))
    inner = lambda name, value, out: rows.where(F.col("name") == name).select("book_id", F.explode("above").alias("of"), F.col(value).alias(out) if isinstance(value, str) else value.alias(out))
    algorithm = inner("encryptionmethod", attr("Algorithm"), "algorithm").join(whole, ["book_id", "of"], "left_semi").groupBy("book_id", "of").agg(F.min("algorithm").alias("algorithm"))
    uris = inner("cipherreference", attr("URI"), "uri").join(whole, ["book_id", "of"], "left_semi")

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else norm_path(x))

    out = uris.join(algorithm, ["book_id", "of"], "left").select("book_id", normal(F.col("uri")).alias("target"), "algorithm")
    return out.withColumn("drm", ~F.coalesce(F.col("algorithm").isin(*OBFUSCATION), F.lit(False)))
