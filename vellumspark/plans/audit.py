"""One plan for a whole audit: documents of books in, one verdict a book and analyzer out, with details and error rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import text as X
from vellumspark.functions.kernels import blocks_column
from vellumspark.operators import analyzers, blocks, toc

ALL = ("content", "pagenumbers", "emptytext", "ocr", "monolithic", "completeness", "cover", "tocdrift", "contamination", "shell", "archive", "spine")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


@dataclass
class Package:
    """What is known of packages besides their documents; an analyzer without its tables has no verdict.

    facts: book_id, corrupt, encrypted, drm, obfuscated, spine, missing, delim (counts). refs: book_id, path of references
    in tables of contents; names: book_id, path of archive entries. ncx, nav: book_id, idx, label, target. own: book_id,
    own (normalised names of the book itself). items, metas: as toc.cover_wiring takes them. extra: documents off the
    reading order (book_id, pos, path, html). failed: book_id, reason of archives that couldn't be read.
    """

    facts: DataFrame | None = None
    refs: DataFrame | None = None
    names: DataFrame | None = None
    ncx: DataFrame | None = None
    nav: DataFrame | None = None
    own: DataFrame | None = None
    items: DataFrame | None = None
    metas: DataFrame | None = None
    extra: DataFrame | None = None
    failed: DataFrame | None = None


def block_rows(docs: DataFrame) -> DataFrame:
    """book_id, pos, idx, tag, text, img_before, in_quote of docs (book_id, pos, html)."""
    rows = docs.withColumn("b", blocks_column(F.col("html"))).select("book_id", "pos", F.posexplode("b").alias("idx", "b"))
    return rows.select("book_id", "pos", "idx", "b.*")


def verdict(frame: DataFrame, name: str, problem: Column, status: Column, *details: Column) -> DataFrame:
    """A row a book; details that are null are left out."""
    lines = F.array_compact(F.array(*details)) if details else F.array().cast("array<string>")
    return frame.select("book_id", F.lit(name).alias("analyzer"), F.coalesce(problem, F.lit(False)).alias("problem"), status.alias("status"), lines.alias("details"))


def content(texts: DataFrame) -> DataFrame:
    """Scripts and stopword votes over the sampled documents of each book, taken together."""
    clean = X.content_clean(F.col("html"))
    sized = texts.withColumn("clean", clean)
    kept = analyzers.content_sample(sized.select("book_id", "pos", F.col("clean").alias("text"))).select("book_id", "pos")
    sample = sized.join(kept, ["book_id", "pos"]).select("book_id", "pos", "clean")
    sums = analyzers.content_counts(sample)
    ratio = {c: F.when(F.col("nwords") > 0, F.col(f"hits_{c}") / F.col("nwords")).otherwise(0.0) for c in analyzers.LANGUAGES}
    best = F.greatest(*ratio.values())
    vote = F.struct(F.coalesce(*[F.when(r == best, F.lit(c)) for c, r in ratio.items()]).alias("best"), "nwords", best.alias("ratio"), ratio["en"].alias("ratio_en"))
    out = sums.withColumn("vote", vote)
    out = out.withColumn("s", analyzers.content_findings(F.col("vote"), F.col("nonlatin"), F.col("letters"), F.col("sign")))
    line = F.format_string("%s: best language %s, %d of %d letters not Latin", "s", "vote.best", "nonlatin", "letters")
    return verdict(out, "content", F.col("s") != "", F.when(F.col("s") != "", "REVIEW").otherwise("OK"), F.when(F.col("s") != "", line))


def completeness(docs: DataFrame, texts: DataFrame, facts: DataFrame | None) -> DataFrame:
    """Advisory: does a book reach its end? A table of contents at its end isn't prose."""
    last = docs.groupBy("book_id").agg(F.max_by(F.struct("pos", "html"), "pos").alias("l"), F.count(F.lit(1)).alias("n"))
    trailing = last.where((F.col("n") >= 2) & analyzers.trailing_toc(F.col("l.html"))).select("book_id", F.col("l.pos").alias("pos"), F.lit(True).alias("toc"))
    marked = texts.select("book_id", "pos", F.length("text").alias("chars")).join(trailing, ["book_id", "pos"], "left")
    counts = marked.groupBy("book_id").agg(F.count(F.lit(1)).alias("docs"), F.count_if((F.col("chars") >= analyzers.PROSE_DOC) & F.col("toc").isNull()).alias("prose"), F.count_if(F.col("chars") == 0).alias("blank"), F.max(F.when(F.col("toc"), F.col("pos"))).alias("toc"))
    lost = counts.withColumn("lost", F.lit(0)) if facts is None else counts.join(facts.select("book_id", F.col("missing").alias("lost")), "book_id", "left").na.fill(0, ["lost"])
    share = F.col("lost") / (F.col("docs") + F.col("lost"))
    status = F.when(F.col("toc").isNotNull() | (share >= analyzers.UNREADABLE_SHARE), "ADVISORY").otherwise("OK")
    lines = (F.format_string("prose %d of %d documents, %d unreadable", "prose", "docs", "lost"), F.when(F.col("toc").isNotNull(), F.format_string("table of contents at the end: %s", F.col("toc").cast("string"))), F.when(F.col("blank") > 0, F.format_string("%d documents are there, but blank", "blank")))
    return verdict(lost, "completeness", F.lit(False), status, *lines)


def contamination(docs: DataFrame, extra: DataFrame | None, rows: DataFrame, own: DataFrame, furniture: bool = False) -> DataFrame:
    """Advisory: other books' titles in heads, headings and repeated short blocks; advertisements; pasted reviews.

    rows: the blocks of all documents; furniture: see toc.repeated_titles. A book without names of its own (own) can't be
    judged.
    """
    every = docs.select("book_id", "pos", "html") if extra is None else docs.select("book_id", "pos", "html").unionByName(extra.select("book_id", "pos", "html"))
    heads = toc.repeated_titles(every, own, furniture=furniture).select("book_id", "title", "n")
    short = rows.where(F.length("text") <= 100).join(own, "book_id")
    marked = short.where(X.marked_foreign_title(F.col("text"), F.col("own"))).withColumn("norm", X.norm_key(F.col("text"))).withColumn("heading", F.col("tag").isin(*HEADINGS))
    counted = marked.groupBy("book_id", "norm", "heading").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", F.struct("pos", "idx")).alias("title")).where(F.col("heading") | (F.col("n") >= 3))
    titles = heads.union(counted.select("book_id", "title", "n")).groupBy("book_id").agg(F.count(F.lit(1)).alias("titles"), F.max_by("title", F.struct("n", "title")).alias("title"))
    texts = every.select("book_id", "pos", X.visible_text(F.col("html")).alias("text"))
    ads = toc.foreign_signatures(texts, own, toc.ADS).groupBy("book_id").agg(F.count_distinct("name").alias("ads"), F.min("name").alias("ad"))
    reviews = toc.review_verdicts(texts).groupBy("book_id").agg(F.count(F.lit(1)).alias("reviews"))
    out = own.select("book_id").distinct().join(titles, "book_id", "left").join(ads, "book_id", "left").join(reviews, "book_id", "left").na.fill(0, ["titles", "ads", "reviews"])
    found = (F.col("titles") > 0) | (F.col("ads") > 0) | (F.col("reviews") > 0)
    lines = (F.when(F.col("titles") > 0, F.format_string("%d foreign titles, such as %s", "titles", "title")), F.when(F.col("ads") > 0, F.format_string("%d advertisement signatures, such as %s", "ads", "ad")), F.when(F.col("reviews") > 0, F.format_string("%d documents look like pasted reviews", "reviews")))
    return verdict(out, "contamination", F.lit(False), F.when(found, "ADVISORY").otherwise("OK"), *lines)


def audit(docs: DataFrame, package: Package | None = None, only: tuple[str, ...] = ALL, furniture: bool = False) -> DataFrame:
    """verdicts (book_id, analyzer, problem, status, details) of docs (book_id, pos, html, and path and nav where known).

    Only the analyzers named, and of those the ones whose tables are there, are planned; furniture: see contamination. A
    book whose archive owns its body text has no emptytext or completeness verdict; one that couldn't be read has an error
    row and nothing else.
    """
    package = package or Package()
    facts, have = package.facts, lambda *tables: all(t is not None for t in tables)
    texts = docs.withColumns({"text": X.visible_text(F.col("html")), "body": X.body_visible_text(F.col("html"))})
    texts = texts.withColumn("carrier", X.is_image_carrier(F.col("html"), F.col("body")))
    out: list[DataFrame] = []

    def owned(frame: DataFrame) -> DataFrame:
        if facts is None:
            return frame
        return frame.join(facts.where(analyzers.archive_owns_body(F.col("corrupt"), F.col("drm"))).select("book_id"), "book_id", "left_anti")

    if "content" in only:
        out.append(content(texts))
    if "emptytext" in only:
        found = owned(analyzers.emptytext(texts))
        out.append(verdict(found, "emptytext", ~F.col("status").isin("OK", "THIN"), F.col("status"), F.format_string("%d characters in %d documents", "chars", "spine_docs"), F.when(F.col("stub_docs") >= analyzers.STUB_REPEAT, F.format_string("%d documents hold the same few words", "stub_docs"))))
    if "monolithic" in only:
        out.append(verdict(analyzers.monolithic(texts), "monolithic", F.col("flag"), F.when(F.col("flag"), "FLAG").otherwise("OK"), F.when(F.col("flag"), F.format_string("document %s has %d characters", F.col("doc").cast("string"), "max_doc"))))
    if "completeness" in only:
        out.append(owned(completeness(docs, texts, facts)))
    judged = have(package.own) and "contamination" in only
    if judged or {"pagenumbers", "ocr"} & {*only}:
        rows = block_rows(docs)
        paged = rows if "nav" not in docs.columns else rows.join(docs.select("book_id", "pos", "nav"), ["book_id", "pos"])
        if "pagenumbers" in only:
            found = blocks.pagenumbers(paged)
            out.append(verdict(found, "pagenumbers", F.col("flag"), F.when(F.col("flag"), "REVIEW").otherwise("OK"), F.when(F.col("n_hits") > 0, F.format_string("%d numbers in the text, the longest run %d", "n_hits", "run"))))
        if "ocr" in only:
            found = blocks.ocr(rows)
            out.append(verdict(found, "ocr", F.col("flag"), F.when(F.col("flag"), "REVIEW").otherwise("OK"), F.when(F.col("splits") > 0, F.format_string("%d of %d paragraphs split in mid-sentence", "splits", "paras"))))
        if judged:
            out.append(contamination(docs, package.extra, rows, package.own, furniture))
    if "cover" in only and have(package.items, package.metas, package.names):
        found = toc.cover_wiring(package.items, package.metas, package.names)
        wired = F.col("cover_file").isNotNull() & ~F.col("epub2_dangling") & ~F.col("cover_absent")
        reason = F.when(F.col("epub2_dangling"), "the cover meta names no item").when(F.col("cover_absent"), "the cover's file is missing").when(F.col("cover_file").isNull(), "no cover is declared")
        out.append(verdict(found, "cover", F.lit(False), F.when(wired, "OK").otherwise("ADVISORY"), reason))
    if "tocdrift" in only and have(package.ncx, package.nav):
        kinds = toc.drift(package.ncx, package.nav).groupBy("book_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("missing_in_nav", "missing_in_ncx", "label_mismatch")])
        both = docs.select("book_id").distinct().join(kinds, "book_id", "left").na.fill(0)
        drifts = F.col("missing_in_nav") + F.col("missing_in_ncx") + F.col("label_mismatch") > 0
        out.append(verdict(both, "tocdrift", F.lit(False), F.when(drifts, "ADVISORY").otherwise("OK"), F.when(drifts, F.format_string("%d targets missing in nav, %d in ncx, %d labels differ", "missing_in_nav", "missing_in_ncx", "label_mismatch"))))
    if facts is not None and "archive" in only:
        status = analyzers.archive_verdict(*[F.col(c) for c in ("corrupt", "encrypted", "drm", "obfuscated")])
        out.append(verdict(facts.withColumn("s", status), "archive", F.col("s").isin("CORRUPT", "ENCRYPTED"), F.col("s"), F.when(F.col("s") != "OK", F.format_string("%d corrupt, %d encrypted, %d obfuscated entries", *[F.col(c).cast("long") for c in ("corrupt", "encrypted", "obfuscated")]))))
    if facts is not None and "shell" in only:
        status = analyzers.shell_verdict(F.col("spine"), F.col("missing"), F.col("delim"))
        out.append(verdict(facts.withColumn("s", status), "shell", F.lit(False), F.col("s"), F.when(F.col("s") != "OK", F.format_string("%d of %d reading positions missing, %d for their delimiters", F.col("missing").cast("long"), (F.col("spine") + F.col("missing")).cast("long"), F.col("delim").cast("long")))))
    if "spine" in only and have(package.refs, package.names) and "path" in docs.columns:
        joined = toc.chapter_numbers(docs.select("book_id", "path")).join(toc.accounting(package.refs, package.names), "book_id", "left").na.fill(0, ["toc_refs", "toc_absent"])
        kind = analyzers.spine_class(*[F.col(c) for c in ("toc_refs", "toc_absent", "spine_n", "unnumbered", "low", "high", "distinct")])
        found = joined.withColumn("s", kind)
        out.append(verdict(found, "spine", F.col("s") == "fragment", F.when(F.col("s") == "fragment", "FRAGMENT").when(F.col("s") == "ok", "OK").otherwise("ADVISORY"), F.when(F.col("s") != "ok", F.format_string("%s: %d of %d references name nothing", "s", "toc_absent", "toc_refs"))))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    if package.failed is not None:
        errors = verdict(package.failed, "load", F.lit(True), F.lit("ERROR"), F.col("reason"))
        whole = whole.join(package.failed.select("book_id"), "book_id", "left_anti").unionByName(errors)
    return whole


def report(verdicts: DataFrame) -> DataFrame:
    """book_id, status (error, problem or clean), verdicts (a map by analyzer) of each book."""
    entry = F.struct("analyzer", F.struct("problem", "status", "details").alias("v"))
    books = verdicts.groupBy("book_id").agg(F.bool_or(F.col("status") == "ERROR").alias("error"), F.bool_or("problem").alias("problem"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("verdicts"))
    return books.select("book_id", F.when(F.col("error"), "error").when(F.col("problem"), "problem").otherwise("clean").alias("status"), "verdicts")


def summary(reports: DataFrame) -> DataFrame:
    """scanned, problems, errors of a report, in one row."""
    return reports.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("status") == "problem").alias("problems"), F.count_if(F.col("status") == "error").alias("errors"))
