"""A measured repair as one plan: archives are looked at before and after, and only those that got better come out.

What is measured is a table (book_id, fatals, errors, warnings). `probe` is the engine's own: files that no parser takes,
and references, anchors, items and ids that are wrong; findings of an external validator can be put in its place. Reading
orders are compared besides, as a repair that orphans live documents can lower every count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import text as X
from vellumspark.functions.kernels import well_formed_column
from vellumspark.operators import gate, runs
from vellumspark.operators import package_files as P
from vellumspark.operators import references as B
from vellumspark.plans.repair_run import CONTENT, kept, repair_archives, text_entries
from vellumspark.sources import archive

Measure = Callable[[DataFrame, str], DataFrame]


def probe(entry: DataFrame, work: str) -> DataFrame:
    """book_id, fatals, errors, warnings of books, from their text entries (repair_run.text_entries); work: a folder.

    fatals: documents, package files and tables of contents that aren't well-formed. errors: references to files that
    aren't there, anchors that their document lacks, items and points without a file, ids that stand twice in a document.
    warnings: names with spaces. A text file that isn't UTF-8 is measured by nobody.
    """
    names = entry.where("name is not null").select("book_id", F.col("norm_name").alias("path")).distinct()
    texts = archive.text_files(entry, (*CONTENT, "\\.opf", "\\.ncx"))
    docs = archive.text_files(entry, CONTENT)
    rows = kept(B.documents(docs), work, "probe-rows")
    packages = kept(P.elements(archive.text_files(entry, ("\\.opf", "\\.ncx"))), work, "probe-packages")
    refs = B.resolved(rows, names, ()).withColumn("action", F.lit(None).cast("string"))
    ids = rows.where("kind = 'id'").select("book_id", "path", F.col("value").alias("id"), "attribute")
    twice = ids.where("attribute = 'id'").groupBy("book_id", "path", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lost = packages.where("name in ('item', 'content') and target is not null").join(names.select("book_id", F.col("path").alias("target")), ["book_id", "target"], "left_anti")
    count = lambda df, n=None: df.groupBy("book_id").agg((F.count(F.lit(1)) if n is None else F.sum(n)).cast("long").alias("n"))
    wrong = P.all_of([count(refs.where("missing")), count(B.broken(refs, ids, docs)), count(lost), count(twice.withColumn("more", F.col("n") - 1), "more")])
    found = {
        "fatals": count(texts.where(~well_formed_column(F.col("text")))),
        "errors": count(wrong, "n"),
        "warnings": count(entry.where(F.contains("name", F.lit(" ")))),
    }
    out = names.select("book_id").distinct()
    for name, counts in found.items():
        out = out.join(counts.withColumnRenamed("n", name), "book_id", "left")
    return out.na.fill(0, [*found])


def reading_orders(entry: DataFrame) -> DataFrame:
    """book_id, resolved, dangles of each book's reading positions; a book without a readable package has no row."""
    return archive.spine_resolution(archive.spine(archive.manifest(archive.packages(entry)), entry)).select("book_id", "resolved", "dangles")


def measured_repair(files: DataFrame, work: str, flags: tuple[str, ...] = (), measure: Measure = probe) -> tuple[DataFrame, DataFrame]:
    """(book_id, content) of the archives that are accepted, and one outcome for each archive: path, status, reason, applied,
    fixes, before_ and after_ fatals, errors and warnings, dangles and resolved before and after, refusals, skipped (text
    files that aren't UTF-8), watermarked, ncx_mismatch.

    Statuses are unreadable (with the reason), nochange, error (not measured, or not repacked), and the gate's verdicts.
    """
    before = kept(text_entries(files), work, "before")
    made, fixes = repair_archives(files, f"{work}/run", flags)
    after = kept(text_entries(made.where("content is not null").select(F.col("book_id").alias("path"), "content")), work, "after")
    fixes = kept(fixes.groupBy("book_id", "fix").agg(F.sum("n").alias("n")), work, "fixes")
    sums = fixes.groupBy("book_id").agg(
        F.coalesce(F.sum(F.when(~F.col("fix").isin("watermark_refusals", "non_utf8_docs_skipped"), F.col("n"))), F.lit(0)).alias("fixes"),
        *[F.coalesce(F.bool_or(F.col("fix").isin(*names)), F.lit(False)).alias(name) for name, names in {"unseen": gate.UNSEEN, "delimiters": ("refs_delim_encoded",), "spine_pruned": ("dead_spine_items_pruned",), "watermarked": ("stripped_watermarks", "dropped_marker")}.items()],
        *[F.coalesce(F.sum(F.when(F.col("fix") == fix, F.col("n"))), F.lit(0)).alias(name) for name, fix in {"refusals": "watermark_refusals", "skipped": "non_utf8_docs_skipped"}.items()],
    )
    mismatch = P.ncx_uid_mismatch(P.elements(archive.text_files(before, ("\\.ncx",))), P.elements(archive.text_files(before, ("\\.opf",)))).withColumn("ncx_mismatch", F.lit(True))
    out = before.groupBy("book_id").agg(F.max(F.when(F.col("ordinal") < 0, F.col("err"))).alias("unreadable"))
    out = out.join(made.select("book_id", F.col("err").alias("failed"), F.lit(True).alias("changed")), "book_id", "left").join(sums, "book_id", "left").join(mismatch, "book_id", "left")
    for name, entry in (("before", before), ("after", after)):
        own = measure(entry, f"{work}/{name}-probe")
        out = out.join(own.select("book_id", *[F.col(c).alias(f"{name}_{c}") for c in ("fatals", "errors", "warnings")]), "book_id", "left")
        out = out.join(reading_orders(entry).select("book_id", F.col("resolved").alias(f"resolved_{name}"), F.col("dangles").alias(f"dangles_{name}")), "book_id", "left")
    out = out.na.fill(0, ["fixes", "refusals", "skipped"]).na.fill(False, ["unseen", "delimiters", "spine_pruned", "watermarked", "changed", "ncx_mismatch"])
    four = [F.col(c) for c in ("before_fatals", "before_errors", "after_fatals", "after_errors")]
    verdict = gate.verdict(*four, *[F.col(c) for c in ("unseen", "delimiters", "dangles_before", "dangles_after", "resolved_before", "resolved_after", "spine_pruned")])
    judged = F.when(F.col("unreadable").isNotNull(), "unreadable").otherwise(runs.status(F.when(F.col("changed"), F.greatest("fixes", F.lit(1))).otherwise(0), F.lit(True), verdict, F.col("failed")))
    out = out.withColumn("status", judged).withColumns({"reason": F.when(F.col("unreadable").isNotNull(), X.unreadable_reason(F.col("unreadable"))).otherwise(F.col("failed")), "applied": F.col("status") == "accept"})
    outcomes = kept(out.withColumnRenamed("book_id", "path").drop("unreadable", "failed", "changed", "unseen", "delimiters", "spine_pruned"), work, "outcomes")
    accepted = made.join(outcomes.where("applied").select(F.col("path").alias("book_id")), "book_id", "left_semi").select("book_id", "content")
    return accepted, outcomes
