"""Relations between tables of contents, references, archive entries and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as X

#: Signatures of ads and of pasted reviews.
ADS = {
    "jnovels": "(?i)\\bjnovels\\b",
    "kokoro connect": "(?i)\\bkokoro\\s+connect\\b",
    "zerobooks": "(?i)\\bzerobooks\\b",
    "light-novel plug": "(?i)\\bdownload\\s+(?:all\\s+)?(?:your\\s+)?favou?rite\\s+(?:light\\s+)?novels\\b",
}
REVIEW_STRONG = {
    "helpful count": "(?i)\\b\\d+\\s+of\\s+\\d+\\s+people\\s+found\\s+(?:this|the following(?:\\s+review)?)\\s+helpful\\b",
    "helpful prompt": "(?i)\\bwas this review helpful\\b",
    "star rating": "(?i)\\bout of\\s+5\\s+stars\\b",
    "verified purchase": "(?i)\\bverified purchase\\b",
}
REVIEW_WEAK = {"reviewer byline": "(?i)\\breviewer\\s*:", "reviews header": "(?i)\\b(?:top\\s+|customer\\s+)reviews\\b", "star row": "[★☆]{3}"}
FURNITURE = "contents table cover title page copyright toc chapter index glossary about navigation colophon dedication part book volume section appendix notes footnotes introduction foreword afterword the of and a illustration"


def nav_links(docs: DataFrame) -> DataFrame:
    """book_id, pos, idx, href, label of the links inside <nav> of docs (book_id, pos, html)."""
    nav = F.regexp_extract("html", "(?is)<nav\\b[^>]*>(.*?)</nav>", 1)
    link = '(?is)<a\\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    pairs = F.arrays_zip(F.regexp_extract_all(nav, F.lit(link), F.lit(1)).alias("href"), F.regexp_extract_all(nav, F.lit(link), F.lit(2)).alias("label"))
    return docs.select("book_id", "pos", F.posexplode(pairs).alias("idx", "l")).select("book_id", "pos", "idx", F.col("l.href").alias("href"), X.visible_text(F.col("l.label")).alias("label"))


def target(href):
    """The path that an in-archive reference names; null for fragments alone and for schemes."""
    bare = F.regexp_replace(href, "[#?].*$", "")
    return F.when((bare != "") & ~href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), bare)


def accounting(refs: DataFrame, names: DataFrame) -> DataFrame:
    """toc_refs and toc_absent of each book: references (book_id, path) against what is there (book_id, path)."""
    there = names.select("book_id", "path").distinct().withColumn("there", F.lit(1))
    return refs.where("path is not null").join(there, ["book_id", "path"], "left").groupBy("book_id").agg(F.count(F.lit(1)).alias("toc_refs"), F.count_if(F.col("there").isNull()).alias("toc_absent"))


def dead_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """Links (book_id, href, ...) whose target isn't there (names: book_id, path)."""
    named = links.withColumn("path", target(F.col("href"))).where("path is not null")
    return named.join(names.select("book_id", "path").distinct(), ["book_id", "path"], "left_anti")


def broken_anchors(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """book_id, target, frag, n of references to a fragment that the target lacks (ids: book_id, target, frag); equal
    references are counted first."""
    return refs.groupBy("book_id", "target", "frag").agg(F.count(F.lit(1)).alias("n")).join(ids.distinct(), ["book_id", "target", "frag"], "left_anti")


def chapter_numbers(docs: DataFrame) -> DataFrame:
    """spine_n, unnumbered, low, high, distinct of the last integers in the base names of each book's documents."""
    number = F.regexp_extract(F.element_at(F.split("path", "/"), -1), "([0-9]+)[^0-9]*$", 1)
    known = docs.select("book_id", F.when(number != "", number.cast("long")).alias("n"))
    return known.groupBy("book_id").agg(F.count(F.lit(1)).alias("spine_n"), F.count_if(F.col("n").isNull()).alias("unnumbered"), F.min("n").alias("low"), F.max("n").alias("high"), F.count_distinct("n").alias("distinct"))


def drift(ncx: DataFrame, nav: DataFrame) -> DataFrame:
    """Entries (book_id, idx, label, target) of two tables of contents that differ: kind, target, ncx_label, nav_label."""
    first = lambda t, name: t.groupBy("book_id", "target").agg(F.min_by("label", "idx").alias(name))
    both = first(ncx, "ncx_label").join(first(nav, "nav_label"), ["book_id", "target"], "full_outer")
    kind = F.when(F.col("nav_label").isNull(), "missing_in_nav").when(F.col("ncx_label").isNull(), "missing_in_ncx").when(F.col("ncx_label") != F.col("nav_label"), "label_mismatch")
    sides = ncx.select("book_id").distinct().join(nav.select("book_id").distinct(), "book_id")
    return both.join(sides, "book_id", "left_semi").withColumn("kind", kind).where(F.col("kind").isNotNull())


def repeated_titles(docs: DataFrame, own: DataFrame, repeat: int = 3, furniture: bool = False) -> DataFrame:
    """Head titles (book_id, pos, html) that don't belong to the book: marked ones, or those that `repeat` documents share.

    Of the latter, only with furniture those that are made of FURNITURE's words alone or have fewer than four letters.
    """
    title = X.visible_text(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    heads = docs.select("book_id", "pos", title.alias("title")).withColumn("norm", X.norm_key(F.col("title"))).where((F.col("norm") != "") & F.length("title").between(3, 100))
    counted = heads.groupBy("book_id", "norm").agg(F.count(F.lit(1)).alias("n"), F.min_by("title", "pos").alias("title"), F.min("pos").alias("first_pos")).join(own, "book_id")
    plain = F.size(F.array_except(F.split("norm", " "), F.array(*[F.lit(w) for w in FURNITURE.split()]))) == 0
    worthy = F.lit(True) if furniture else ~plain & (F.regexp_count("norm", F.lit("[a-z]")) >= 4)
    names = F.col("own")
    found = counted.where(X.marked_foreign_title(F.col("title"), names) | ((F.col("n") >= repeat) & worthy & X.is_foreign(F.col("title"), names)))
    return found.select("book_id", "norm", "title", "n", "first_pos")


def ranked_titles(titles: DataFrame) -> DataFrame:
    """Titles of repeated_titles with their rank in the book: the most repeated first, then in reading order."""
    return titles.withColumn("rank", F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("n"), "first_pos")))


def signature_hits(docs: DataFrame, signatures: dict[str, str]) -> DataFrame:
    """book_id, pos, name of each signature in each text: a fixed list of patterns, tried in one pass over the rows."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(name)) for name, p in signatures.items()]))
    return docs.select("book_id", "pos", F.explode(hits).alias("name"))


def foreign_signatures(docs: DataFrame, own: DataFrame, signatures: dict[str, str]) -> DataFrame:
    """signature_hits without those that are a phrase of the book's own names (own: book_id, own)."""
    name = X.norm_key(F.col("name"))
    mine = F.exists("own", lambda o: (F.length(o) >= 4) & (F.contains(o, name) | F.contains(name, o)))
    return signature_hits(docs, signatures).join(own, "book_id").where(~mine).select("book_id", "pos", "name")


def review_verdicts(docs: DataFrame, first: int = 5) -> DataFrame:
    """book_id, pos, strong, weak of the documents among each book's first five that look like pasted reviews.

    A rank of at most five is kept before rows move, so a book is never ranked whole; texts follow the few ranks.
    """
    rank = F.row_number().over(Window.partitionBy("book_id").orderBy("pos"))
    wanted = docs.select("book_id", "pos").withColumn("rank", rank).where(F.col("rank") <= first).drop("rank")
    count = lambda signatures: sum((F.col("text").rlike(p).cast("int") for p in signatures.values()), F.lit(0))
    scored = docs.join(wanted, ["book_id", "pos"]).select("book_id", "pos", count(REVIEW_STRONG).alias("strong"), count(REVIEW_WEAK).alias("weak"))
    return scored.where("strong >= 1 or weak >= 2")


def cover_wiring(items: DataFrame, metas: DataFrame, names: DataFrame) -> DataFrame:
    """book_id, epub2_meta, dangling, epub3_item, cover_file, absent from items (book_id, ord, id, href, properties), metas (book_id, ord, content) and names (book_id, path)."""
    cover = items.where(F.array_contains("properties", "cover-image")).groupBy("book_id").agg(F.max_by(F.struct("id", "resolved"), "ord").alias("c"))
    meta = metas.groupBy("book_id").agg(F.min_by("content", "ord").alias("epub2_meta"))
    books = items.select("book_id").union(metas.select("book_id")).distinct()
    named = items.groupBy("book_id", "id").agg(F.max_by("resolved", "ord").alias("meta_file"))
    out = books.join(meta, "book_id", "left").join(cover, "book_id", "left").join(named.withColumnRenamed("id", "epub2_meta"), ["book_id", "epub2_meta"], "left")
    out = out.withColumn("epub2_dangling", F.coalesce((F.col("epub2_meta") != "") & F.col("meta_file").isNull(), F.lit(False)))
    out = out.withColumn("cover_file", F.coalesce("c.resolved", "meta_file"))
    there = names.select("book_id", F.col("path").alias("cover_file"), F.lit(True).alias("there")).distinct()
    out = out.join(there, ["book_id", "cover_file"], "left")
    return out.select("book_id", "epub2_meta", "epub2_dangling", F.col("c.id").alias("epub3_item"), "cover_file", (F.col("cover_file").isNotNull() & F.col("there").isNull()).alias("cover_absent"))
