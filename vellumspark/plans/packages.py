"""Queries over package files and over runs, with independent SQL. A book is an order, its lines are items, points or books.

Where a query is about writing, the package's text is built from the lines, read, repaired and written back, and SQL states
the text that must come out; where it is about a decision, elements are rows right away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.operators import package_files as P
from vellumspark.operators import runs, toc
from vellumspark.plans.catalogue import HOST, NAV, PATH, query
from vellumspark.sources.tables import page_docs, settled, table


def text(*parts) -> Column:
    """Literals and columns (by {name}) as one string."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def joined(rows: DataFrame, what: Column, key: str = "book_id", order: str = "k") -> DataFrame:
    """One string for each key: the pieces in their order (a handful of lines of an order)."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, what.alias("x")))).alias("l")).select(key, F.array_join(F.transform("l", lambda s: s["x"]), "").alias("s"))


def rows_of(base: DataFrame, ord_: Column, name: str, attrs: dict[str, Column | str], parent: Column | None = None, above: Column | None = None, content: Column | None = None, target: Column | None = None, fragment: Column | None = None, path: str = "content.opf", own: Column | None = None) -> DataFrame:
    """Element rows, as P.elements would read them."""
    none = lambda c, kind="string": (F.lit(None) if c is None else c).cast(kind)
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(v))]
    attributes = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return base.select(
        "book_id", F.lit(path).alias("path"), ord_.cast("int").alias("ord"), none(parent, "int").alias("parent"), (F.array().cast("array<int>") if above is None else above.cast("array<int>")).alias("above"), F.lit(name).alias("name"),
        attributes.alias("attrs"), F.coalesce(none(own), F.lit("")).alias("text"), none(content).alias("href"), none(target).alias("target"), none(fragment).alias("fragment"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of orders, numbered from 1 within each."""
    cols = {"book_id": "l_orderkey", "part": "l_partkey", "supp": "l_suppkey", "flag": "l_returnflag"}
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return table(spark, sf_dir, "lineitem").withColumn("k", F.row_number().over(order)).select("k", *[F.col(c).alias(n) for n, c in cols.items()])


L = "select l_orderkey book_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) k, l_partkey part, l_suppkey supp, l_returnflag flag from lineitem"
#: Points that stand above point x in a heap, itself included.
HEAP = "{a}.k in ({x}.k, {x}.k // 2, {x}.k // 4, {x}.k // 8, {x}.k // 16)"


def fixes(out: DataFrame, *names: str) -> list[Column]:
    return [F.coalesce(F.try_element_at("fixes", F.lit(n)), F.lit(0)).cast("long").alias(n) for n in names]


# Written package files

PRUNED = (
    f"with i as (select *, 'i' || k id, 'f' || (part % 50) || '.jpg' f, 'i' || (k % 7 + 1) fb from ({L})), e as (select distinct book_id, 'f' || (supp % 50) || '.jpg' f from ({L})), d as (select * from i where flag = 'R' and not exists (select 1 from e where e.book_id = i.book_id and e.f = i.f)), "
    "s as (select *, exists (select 1 from d where d.book_id = i.book_id and d.id = i.fb) cut from i where not exists (select 1 from d where d.book_id = i.book_id and d.id = i.id)), "
    "m as (select book_id, string_agg('<item id=\"' || id || '\" href=\"' || f || '\"' || case when cut then '' else ' fallback=\"' || fb || '\"' end || '/>', '' order by k) t, count(*) filter (cut) n from s group by all), r as (select book_id, string_agg('<itemref idref=\"' || id || '\"/>', '' order by k) t from i where flag <> 'R' group by all), "
    "b as (select book_id, exists (select 1 from d where d.book_id = x.book_id and d.id = 'i1') toc_dead, (select count(*) from d where d.book_id = x.book_id) pruned from (select distinct book_id from i) x) "
)


@query(
    PRUNED
    + "select b.book_id, md5('<package><manifest>' || coalesce(m.t, '') || '</manifest><spine' || case when toc_dead then '' else ' toc=\"i1\"' end || '>' || coalesce(r.t, '') || '</spine></package>') as digest, pruned as manifest_items_pruned, coalesce(m.n, 0) + toc_dead::integer as prune_edges_rewritten from b left join m using (book_id) left join r using (book_id)"
)
def package_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    item = text('<item id="i', F.col("k"), '" href="f', F.col("part") % 50, '.jpg" fallback="i', F.col("k") % 7 + 1, '"/>')
    refs = joined(rows.where("flag <> 'R'"), text('<itemref idref="i', F.col("k"), '"/>')).withColumnRenamed("s", "r")
    files = joined(rows, item).join(refs, "book_id", "left").select("book_id", F.lit("content.opf").alias("path"), text("<package><manifest>", F.col("s"), '</manifest><spine toc="i1">', F.coalesce("r", F.lit("")), "</spine></package>").alias("text"))
    names = rows.select("book_id", text("f", F.col("supp") % 50, ".jpg").alias("path"))
    out = P.written(files, P.prune_missing(settled(P.elements(files), "elements"), names))
    return out.select("book_id", F.md5("text").alias("digest"), *fixes(out, "manifest_items_pruned", "prune_edges_rewritten"))


@query(
    f"with r as (select distinct book_id, 'img/f' || (part % 20) || case when part % 3 = 0 then '.png' else '.txt' end f from ({L})), e as (select distinct book_id, 'img/f' || (supp % 20) || case when supp % 2 = 0 then '.png' else '.txt' end f from ({L})), w as (select r.*, row_number() over (partition by book_id order by f) n from r join e using (book_id, f) where f <> 'img/f1.png'), "
    f"t as (select book_id, string_agg('<item id=\"declared-d' || n || '\" href=\"' || f || '\" media-type=\"image/png\"/>' || chr(10), '' order by f) s, count(*) n from w where f like '%.png' group by all) "
    f"select b.book_id, md5('<package><manifest><item id=\"a\" href=\"img/f1.png\"/>' || coalesce(s, '') || '</manifest></package>') as digest, coalesce(n, 0) as manifest_items_declared from (select distinct book_id from ({L})) b left join t using (book_id)"
)
def package_declare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    file = lambda key, every: text("img/f", key % 20, F.when(key % every == 0, ".png").otherwise(".txt"))
    files = rows.select("book_id").distinct().select("book_id", F.lit("content.opf").alias("path"), F.lit('<package><manifest><item id="a" href="img/f1.png"/></manifest></package>').alias("text"))
    refs = rows.select("book_id", file(F.col("part"), 3).alias("target")).withColumn("href", F.col("target"))
    out = P.written(files, P.declare_missing(settled(P.elements(files), "elements"), refs, rows.select("book_id", file(F.col("supp"), 2).alias("path"))))
    return out.select("book_id", F.md5("text").alias("digest"), *fixes(out, "manifest_items_declared"))


@query(
    "with p as (select p_partkey, case p_size % 4 when 0 then p_size || ':' || p_partkey when 1 then 'a b' when 2 then 'ok' else '' end id, p_size from part), q as (select *, case p_size % 4 when 0 then 'id_' || p_size || '_' || p_partkey when 1 then 'id_a_b' when 2 then 'ok' else 'id_' end new_id from p) "
    "select p_partkey as book_id, '<package unique-identifier=\"' || case when p_size % 3 = 0 then 'u' else '9u' end || '\"><dc:identifier' || case when p_size % 3 = 0 and p_size % 5 <> 0 then ' id=\"u\"' when p_size % 5 = 0 then ' id=\"own\"' else '' end || '>x</dc:identifier><meta name=\"cover\" content=\"' || new_id || '\"/><manifest><item id=\"' || new_id || '\"/></manifest><spine><itemref idref=\"' || new_id || '\"/></spine></package>' as text, "
    "(p_size % 4 <> 2)::integer::bigint as fix_manifest_ids, (p_size % 3 = 0 and p_size % 5 <> 0)::integer::bigint as unique_identifier_wired from q"
)
def package_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    own = F.when(size % 4 == 0, text(size, ":", F.col("p_partkey"))).when(size % 4 == 1, "a b").when(size % 4 == 2, "ok").otherwise("")
    body = text('<package unique-identifier="', F.when(size % 3 == 0, "u").otherwise("9u"), '"><dc:identifier', F.when(size % 5 == 0, ' id="own"').otherwise(""), '>x</dc:identifier><meta name="cover" content="', own, '"/><manifest><item id="', own, '"/></manifest><spine><itemref idref="', own, '"/></spine></package>')
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("book_id"), F.lit("content.opf").alias("path"), body.alias("text"))
    opf = settled(P.elements(files), "elements")
    out = P.written(files, P.all_of([P.manifest_ids(opf), P.unique_identifier(opf)]))
    return out.select("book_id", "text", *fixes(out, "fix_manifest_ids", "unique_identifier_wired"))


@query(
    "with c as (select c_custkey k, c_custkey % 3 m from customer) select k as book_id, '<ncx><head><meta content=\"' || case when m = 0 then 'urn:' || k when m = 1 then 'same' else 'old' end || '\" name=\"dtb:uid\"/></head><pageList id=\"page-list\"/><pageList id=\"page-list-2\" class=\"pages\"/></ncx>' as text, (m = 0)::integer::bigint as ncx_uid_synced, 1::bigint as pagelist_class_added from c"
)
def ncx_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    books = table(spark, sf_dir, "customer").select(key.alias("book_id"), (key % 3).alias("m"))
    opf = books.where("m < 2").select("book_id", F.lit("content.opf").alias("path"), text('<package unique-identifier="u"><dc:identifier id="u">', F.when(F.col("m") == 0, text("urn:", F.col("book_id"))).otherwise("same"), "</dc:identifier></package>").alias("text"))
    ncx = books.select("book_id", F.lit("toc.ncx").alias("path"), text('<ncx><head><meta content="', F.when(F.col("m") == 1, "same").otherwise("old"), '" name="dtb:uid"/></head><pageList/><pageList id="page-list-2" class="pages"/></ncx>').alias("text"))
    rows = settled(P.elements(ncx), "elements")
    out = P.written(ncx, P.all_of([P.ncx_uid(rows, P.elements(opf)), P.page_list_class(rows)]))
    # The new class stands before the new id; SQL names them in the order of the tag above.
    plain = F.replace("text", F.lit('<pageList class="pages" id="page-list"/>'), F.lit('<pageList id="page-list"/>'))
    return out.select("book_id", plain.alias("text"), *fixes(out, "ncx_uid_synced", "pagelist_class_added"))


# Decisions over elements


@query(
    f"with p as (select *, 'f' || (part % 3) t from ({L})), e as (select distinct book_id, 'f' || (supp % 4) t from ({L})), d as (select p.*, not exists (select 1 from e where e.book_id = p.book_id and e.t = p.t) dead from p), v as (select a.book_id, a.k from d a join d x on x.book_id = a.book_id and not x.dead and " + HEAP.format(a="a", x="x") + " group by all), "
    "w as (select d.*, exists (select 1 from v where v.book_id = d.book_id and v.k = d.k) lives from d where exists (select 1 from v where v.book_id = d.book_id)) "
    "select book_id, (k * 10)::integer as ord, case when lives then 'splice' else 'drop' end as action from w a where dead and (lives or not exists (select 1 from w b where b.book_id = a.book_id and b.dead and not b.lives and b.k <> a.k and " + HEAP.format(a="b", x="a") + "))"
)
def ncx_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points nested as a heap: the parent of point k is k // 2."""
    rows, k = lines(spark, sf_dir), F.col("k")
    half = F.floor(k / 2).cast("int")
    above = F.concat(F.array(F.lit(0)), F.filter(F.array(*[F.floor(k / n).cast("int") * 10 for n in (16, 8, 4, 2)]), lambda x: x > 0))
    target = text("f", F.col("part") % 3)
    ncx = P.all_of([
        rows_of(rows.select("book_id").distinct(), F.lit(0), "navmap", {}, F.lit(-1), path="toc.ncx"),
        rows_of(rows, k * 10, "navpoint", {"playOrder": k}, half * 10, above, path="toc.ncx"),
        rows_of(rows, k * 10 + 1, "content", {"src": target}, k * 10, F.concat(above, F.array(k * 10)), target, target, path="toc.ncx"),
    ])
    return P.dangling_points(ncx, rows.select("book_id", text("f", F.col("supp") % 4).alias("path"))).select("book_id", "ord", "action")


@query(
    f"with x as (select *, 't' || (part % 3) target, supp % 5 + 1 play from ({L})), g as (select book_id, target, min(k) f, count(distinct play) v, min(play) lo from x group by all), c as (select book_id, bool_and(v = 1) one, count(distinct lo) = count(*) apart, max(lo) - min(lo) + 1 = count(*) dense from g group by all), "
    "r as (select book_id, target, dense_rank() over (partition by book_id order by f) n from g) select x.book_id, (k * 10)::integer as ord, n::varchar as value from x join c using (book_id) join r using (book_id, target) where not (one and apart and dense) and play <> n"
)
def ncx_play_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = lines(spark, sf_dir), F.col("k")
    target = text("t", F.col("part") % 3)
    ncx = P.all_of([rows_of(rows, k * 10, "navpoint", {"playOrder": F.col("supp") % 5 + 1}, F.lit(0), path="toc.ncx"), rows_of(rows, k * 10 + 1, "content", {"src": target}, k * 10, content=target, target=target, path="toc.ncx")])
    return P.play_order(ncx).select("book_id", "ord", "value")


@query(
    f"with i as (select book_id, k, 'i' || k id, 'f' || (part % 9) f from ({L})), m as (select o_orderkey book_id, case when o_orderkey % 4 = 0 then 'i1' when o_orderkey % 4 = 1 then '' else 'zz' end content, 'f' || (o_custkey % 9) g from orders), n as (select m.*, (select case when count(*) = 1 then min(id) end from i where i.book_id = m.book_id and i.f = m.g) one from m) "
    "select book_id, case when one is null then 'drop' else 'set' end as action, one as value from n where content = 'zz' or (content = 'i1' and not exists (select 1 from i where i.book_id = n.book_id and i.id = 'i1'))"
)
def cover_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, orders = lines(spark, sf_dir), table(spark, sf_dir, "orders").withColumn("book_id", F.col("o_orderkey"))
    file, guide = text("f", F.col("part") % 9), text("f", F.col("o_custkey") % 9)
    content = F.when(F.col("book_id") % 4 == 0, "i1").when(F.col("book_id") % 4 == 1, "").otherwise("zz")
    opf = P.all_of([rows_of(orders, F.lit(1), "meta", {"name": "cover", "content": content}), rows_of(rows, F.col("k") + 1, "item", {"id": text("i", F.col("k")), "href": file}, content=file, target=file), rows_of(orders, F.lit(99), "reference", {"type": "cover", "href": guide}, content=guide, target=guide)])
    return P.cover_meta(opf).select("book_id", "action", "value")


@query(
    f"with i as (select book_id, k, 'f' || (part % 9) f, ['image/png', 'application/xhtml+xml', 'text/css'][supp % 3 + 1] t from ({L})), t as (select book_id, f, arg_max(t, k) t from i group by all), r as (select o_orderkey book_id, 'f' || (o_custkey % 9) f from orders) select book_id, t as declared from r join t using (book_id, f) where t <> 'application/xhtml+xml'"
)
def guide_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, orders = lines(spark, sf_dir), table(spark, sf_dir, "orders").withColumn("book_id", F.col("o_orderkey"))
    file, guide = text("f", F.col("part") % 9), text("f", F.col("o_custkey") % 9)
    kind = F.get(F.array(F.lit("image/png"), F.lit("application/xhtml+xml"), F.lit("text/css")), (F.col("supp") % 3).cast("int"))
    opf = P.all_of([rows_of(rows, F.col("k"), "item", {"href": file, "media-type": kind}, content=file, target=file), rows_of(orders, F.lit(99), "reference", {"href": guide}, content=guide, target=guide)])
    types = P.items(opf).select("book_id", "target", "media_type", "ord").groupBy("book_id", "target").agg(F.max_by("media_type", "ord").alias("declared"))
    gone = P.guide_refs(opf).join(opf.where("name = 'reference'").select("book_id", "ord", "target"), ["book_id", "ord"])
    return gone.join(types, ["book_id", "target"]).select("book_id", "declared")


@query(
    f"with i as (select *, 'd' || (part % 6) || '.htm' f from ({L})), e as (select distinct book_id, 'd' || (supp % 6) || '.htm' f from ({L})), d as (select i.*, not exists (select 1 from e where e.book_id = i.book_id and e.f = i.f) dead from i), s as (select book_id from d group by book_id having avg(dead::integer) >= 0.5) "
    "select book_id, k::integer as ord, 'drop' as action from d where dead and book_id in (select book_id from s) union all select book_id, (k + 100)::integer, 'drop' from d where dead and book_id in (select book_id from s)"
)
def dead_spines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, own = lines(spark, sf_dir), text("i", F.col("k"))
    file = text("d", F.col("part") % 6, ".htm")
    opf = P.all_of([rows_of(rows, F.col("k"), "item", {"id": own, "href": file}, content=file, target=file), rows_of(rows, F.col("k") + 100, "itemref", {"idref": own})])
    return P.dead_spine(opf, rows.select("book_id", text("d", F.col("supp") % 6, ".htm").alias("path"))).select("book_id", "ord", "action")


@query(
    f"with r as (select *, 'd' || (part % 4) t, 's' || (supp % 5) f from ({L})), d as (select book_id, 'd' || (supp % 4) t, case when k % 3 > 0 then 's' || (part % 5) end id from ({L})) select book_id, k::integer as ord, t as value from r where exists (select 1 from d where d.book_id = r.book_id and d.t = r.t) and not exists (select 1 from d where d.book_id = r.book_id and d.t = r.t and d.id = r.f)"
)
def broken_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    target, fragment = text("d", F.col("part") % 4), text("s", F.col("supp") % 5)
    src = text(target, "#", fragment)
    ncx = rows_of(rows, F.col("k"), "content", {"src": src}, content=src, target=target, fragment=fragment, path="toc.ncx")
    ids = rows.select("book_id", text("d", F.col("supp") % 4).alias("target"), F.when(F.col("k") % 3 > 0, text("s", F.col("part") % 5)).alias("id"))
    return P.broken_fragments(ncx, ncx.limit(0), ids).select("book_id", "ord", "value")


@query("select page_id, array_to_string(list_filter([case when regexp_matches(h, '(?i)\\ssrc\\s*=\\s*[\"'']https?://') then 'remote-resources' end, case when regexp_matches(h, '(?i)<(script|form)\\b') then 'scripted' end, case when page_id % 3 = 0 then 'svg' end], lambda x: x is not null), ' ') as properties from (select page_id, case when page_id % 2 = 0 then replace(html, '<h1>', '<img src=\"http://x/y.png\"/><h1>') else html end h from pages)")
def page_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    html = F.when(page % 2 == 0, F.replace("html", F.lit("<h1>"), F.lit('<img src="http://x/y.png"/><h1>'))).otherwise(F.col("html"))
    html = F.when(page % 3 == 0, F.concat(html, F.lit("<SVG></SVG>"))).otherwise(html)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(P.document_properties(html), " ").alias("properties"))


@query(
    f"with r as (select book_id, k, ['a[1].htm', 'b#' || (part % 3) || '.htm', 'c.htm#x'][part % 3 + 1] h, part % 3 m, part, supp from ({L})), e as (select distinct book_id, unnest(['a[1].htm', 'b#' || (supp % 3) || '.htm', 'b']) f from ({L}) where supp % 4 > 0) "
    "select book_id, k::integer as ord, case when m = 0 then 'a%5B1%5D.htm' else replace(h, '#', '%23') end as value from r where (m = 0 and exists (select 1 from e where e.book_id = r.book_id and e.f = r.h)) or (m = 1 and not exists (select 1 from e where e.book_id = r.book_id and e.f = 'b') and exists (select 1 from e where e.book_id = r.book_id and e.f = r.h))"
)
def encoded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, kind = lines(spark, sf_dir), F.col("part") % 3
    href = F.when(kind == 0, "a[1].htm").when(kind == 1, text("b#", kind, ".htm")).otherwise("c.htm#x")
    target = F.when(kind == 0, "a[1].htm").when(kind == 1, "b").otherwise("c.htm")
    refs = rows_of(rows, F.col("k"), "a", {"href": href}, content=href, target=target, path="d.htm")
    there = rows.where("supp % 4 > 0").select("book_id", F.explode(F.array(F.lit("a[1].htm"), text("b#", F.col("supp") % 3, ".htm"), F.lit("b"))).alias("path"))
    return P.encoded_references(refs, there).select("book_id", "ord", "value")


# Runs

OUTCOME = "select l_orderkey * 10 + l_linenumber path, case when l_partkey % 17 = 0 then 'boom' end err, l_partkey % 5 fixes, l_suppkey % 6 > 0 validated, ['accept', 'reject', 'partial', 'equal'][l_suppkey % 4 + 1] verdict, l_quantity > 45 watermarked, (l_partkey % 29 = 0)::integer refusals from lineitem"
STATED = f"select *, case when err is not null then 'error' when fixes = 0 then 'nochange' when not validated then 'unvalidated' else verdict end status, path % 3 = 0 applied from ({OUTCOME})"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    verdict = F.get(F.array(*[F.lit(x) for x in ("accept", "reject", "partial", "equal")]), (supp % 4).cast("int"))
    path = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    stated = runs.status(part % 5, supp % 6 > 0, verdict, F.when(part % 17 == 0, "boom"))
    return table(spark, sf_dir, "lineitem").select(path.alias("path"), stated.alias("status"), F.when(part % 17 == 0, "boom").alias("reason"), (path % 3 == 0).alias("applied"), (F.col("l_quantity") > 45).alias("watermarked"), (part % 29 == 0).cast("int").alias("refusals"))


@query(f"select count(*) as candidates, count(*) filter (status = 'accept') as accepted, count(*) filter (status = 'partial') as partial, count(*) filter (status = 'nochange') as nochange, count(*) filter (status = 'equal') as equal, count(*) filter (status = 'unvalidated') as unvalidated, count(*) filter (status = 'error') as errors, count(*) filter (status = 'unreadable') as unreadable, count(*) filter (status = 'reject') as rejected, count(*) filter (applied) as applied, case when count(*) filter (status in ('reject', 'error', 'partial')) > 0 then 2 else 0 end as code from ({STATED})")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outcomes(spark, sf_dir)
    return runs.run_counts(found).crossJoin(F.broadcast(runs.exit_code(found)))


@query(f"select path from ({STATED}) where status not in ('accept', 'unvalidated')")
def manual_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.manual_list(outcomes(spark, sf_dir))


@query(f"select coalesce(err, '') as reason, count(*) as books from ({STATED}) where status = 'error' group by all")
def error_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.error_reasons(outcomes(spark, sf_dir))


@query(
    f"with d as (select path, unnest(case when ((status = 'accept' and not applied) or watermarked) and refusals > 0 then ['apply_lossy', 'manual_watermark_repair'] when (status = 'accept' and not applied) or watermarked then ['apply_lossy'] when refusals > 0 then ['manual_watermark_repair'] else [] end) decision from ({STATED})) "
    "select decision, count(distinct path) as n, min(path) as least, md5(string_agg(path::varchar, ',' order by path)) as digest from (select distinct * from d) group by all"
)
def run_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.decisions(outcomes(spark, sf_dir))
    return found.select("decision", F.size("books").cast("long").alias("n"), F.get("books", F.lit(0)).alias("least"), F.md5(F.array_join("books", ",")).alias("digest"))


@query(
    "with a as (select o_orderkey path from orders), s as (select l_orderkey path, sum(l_linenumber)::bigint fatals, count(*) errors, 0 warnings from lineitem where l_orderkey % 2 = 0 group by all) select a.path, fatals as before_fatals, errors as before_errors, warnings as before_warnings from a left join s using (path)"
)
def sweep_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("path")).agg(F.sum("l_linenumber").alias("fatals"), F.count(F.lit(1)).alias("errors"), F.first(F.lit(0)).alias("warnings"))
    return runs.with_sweep(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path")), measured)


@query(
    "select c_custkey as id, '/lib/' || c_name || '/' || lower(c_name) || '.epub' as path, array_to_string(list_sort(list_distinct([n_name])), ',') as languages, case when c_custkey % 2 = 0 then c_mktsegment else '' end as tags from customer join nation on c_nationkey = n_nationkey where c_custkey % 5 <> 0"
)
def catalogue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    files = customers.select("id", F.lower("c_name").alias("name"), F.when(F.col("id") % 5 == 0, "MOBI").otherwise("epub").alias("format"))
    named = customers.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("id", F.col("n_name").alias("language"))
    books = customers.select("id", text("/lib/", F.col("c_name")).alias("folder"))
    found = runs.catalogue_books(books, files, named.union(named), customers.where("id % 2 = 0").select("id", F.col("c_mktsegment").alias("tag")))
    return found.select("id", "path", F.array_join("languages", ",").alias("languages"), F.array_join("tags", ",").alias("tags"))


@query("select s_suppkey as k, (select min(c_custkey) from customer where lower(c_name) = lower('customer#' || lpad(s_suppkey::varchar, 9, '0'))) as id from supplier")
def catalogue_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), text("CUSTOMER#", F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("path"))
    return runs.catalogue_ids(paths, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("path"))).select("k", "id")


@query("select book_id, n, value from (select c_nationkey book_id, c_custkey value, row_number() over (partition by c_nationkey order by c_custkey)::integer n from customer) where n <= 8")
def first_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("book_id"), F.col("c_custkey").alias("value"))
    return runs.examples(hits, ["value"]).select("book_id", "n", "value")


@query("select o_orderkey as book_id, o_totalprice as max_doc from orders order by o_totalprice desc, o_orderkey limit 100")
def worst_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-100 report, the worst first."""
    return runs.by_worst(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"), F.col("o_totalprice").alias("max_doc")), "max_doc", first=100)


@query("select user_id::varchar as path, count(*) as n, case when user_id % 3 = 0 then 'accept' end as preview from events group by user_id")
def census_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    census = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    dry = table(spark, sf_dir, "events").where("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("path"), F.lit("accept").alias("status")).distinct()
    return runs.preview(census, dry)


@query("select distinct l_orderkey as book_id from lineitem where l_returnflag = 'R'")
def flagged_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flagged(lines(spark, sf_dir).select("book_id", (F.col("flag") == "R").alias("problem")))


@query(NAV + f", f as (select {HOST} book_id, {PATH} path from pages) select book_id, count(*) as refs, count(*) filter (regexp_replace(href, '[#?].*$', '') not in (select path from f where f.book_id = l.book_id)) as absent from l where regexp_replace(href, '[#?].*$', '') <> '' group by all")
def page_link_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages read as elements: those inside nav, by their targets."""
    docs = page_docs(table(spark, sf_dir, "pages"))
    links = toc.nav_links(docs).select("book_id", toc.target(F.col("href")).alias("path"))
    return toc.accounting(links, docs).select("book_id", F.col("toc_refs").alias("refs"), F.col("toc_absent").alias("absent"))
