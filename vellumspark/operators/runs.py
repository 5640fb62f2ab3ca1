"""What a run over a library keeps account of: candidates, outcomes, decisions, reports and artifacts."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumspark.operators import gate

#: Statuses that leave a book to its owner, and verdicts that advise but don't tag.
MANUAL = ("nochange", "equal", "partial", "reject", "error", "unreadable")
TROUBLE = ("reject", "error", "unreadable", "partial")
ADVISORY_ANALYZERS = ("completeness", "cover", "tocdrift", "contamination", "shell")
COUNTED = {"accepted": "accept", "partial": "partial", "nochange": "nochange", "equal": "equal", "unvalidated": "unvalidated", "errors": "error", "unreadable": "unreadable", "rejected": "reject"}


# What goes in


def audit_csv(spark: SparkSession, path: str) -> DataFrame:
    """fatals, errors, warnings, path of a CSV of an earlier audit; its header and lines that can't be read are skipped."""
    return spark.read.csv(path, schema="fatals int, errors int, warnings int, path string", mode="DROPMALFORMED").where("path is not null")


def candidates(paths: DataFrame, limit: int | None = None) -> DataFrame:
    """Books to be looked at: all, or the first in the order of their path."""
    return paths if limit is None else paths.orderBy("path").limit(limit)


def with_sweep(books: DataFrame, sweep: DataFrame) -> DataFrame:
    """books with what a sweep (path, fatals, errors, warnings) has measured already; null where it hasn't."""
    return books.join(sweep.select("path", *[F.col(c).alias(f"before_{c}") for c in ("fatals", "errors", "warnings")]), "path", "left")


def catalogue_books(books: DataFrame, files: DataFrame, languages: DataFrame, tags: DataFrame) -> DataFrame:
    """id, path, languages, tags of a catalogue's books (id, folder) with a file (id, name, format)."""
    epubs = files.where(F.upper("format") == "EPUB").select("id", F.concat("name", F.lit(".epub")).alias("file"))
    many = lambda t, c, out: t.groupBy("id").agg(F.array_sort(F.collect_set(c)).alias(out))
    out = books.join(epubs, "id").join(many(languages, "language", "languages"), "id", "left").join(many(tags, "tag", "tags"), "id", "left")
    none = F.array().cast("array<string>")
    return out.select("id", F.concat("folder", F.lit("/"), "file").alias("path"), F.coalesce("languages", none).alias("languages"), F.coalesce("tags", none).alias("tags"))


def scoped(books: DataFrame, ids: str) -> DataFrame:
    """The books (id, ...) that a list of ids with commas names: repeats once, words and unknown ids skipped."""
    wanted = books.sparkSession.range(1).select(F.explode(F.split(F.lit(ids), ",")).alias("w")).select(F.trim("w").try_cast("long").alias("id")).where("id is not null").distinct()
    return books.join(F.broadcast(wanted), "id", "left_semi")


def catalogue_ids(paths: DataFrame, books: DataFrame) -> DataFrame:
    """paths with the id of the catalogue's book (id, path) of that path, in any case."""
    known = books.select(F.lower("path").alias("__path"), "id").groupBy("__path").agg(F.min("id").alias("id"))
    return paths.join(known, F.lower("path") == F.col("__path"), "left").drop("__path")


# What comes out


def status(fixes: Column, validated: Column, verdict: Column, error: Column) -> Column:
    """unreadable reasons aside: error, nochange (nothing to fix), unvalidated, or the gate's verdict."""
    return F.when(error.isNotNull(), "error").when(F.coalesce(fixes, F.lit(0)) == 0, "nochange").when(~validated, "unvalidated").otherwise(verdict)


def run_counts(outcomes: DataFrame) -> DataFrame:
    """One row: books of each status among outcomes (status, applied), and how many were applied."""
    return outcomes.agg(F.count(F.lit(1)).alias("candidates"), *[F.count_if(F.col("status") == s).alias(name) for name, s in COUNTED.items()], F.count_if("applied").alias("applied"))


def exit_code(outcomes: DataFrame) -> DataFrame:
    """code: 2 if any book is in trouble, else 0."""
    return outcomes.agg(F.when(F.count_if(F.col("status").isin(*TROUBLE)) > 0, 2).otherwise(0).alias("code"))


def manual_list(outcomes: DataFrame) -> DataFrame:
    """path of the books that a run couldn't or didn't repair."""
    return outcomes.where(F.col("status").isin(*MANUAL)).select("path")


def error_reasons(outcomes: DataFrame) -> DataFrame:
    """reason, books of outcomes (status, reason) that are errors or unreadable."""
    return outcomes.where(F.col("status").isin("error", "unreadable")).groupBy("reason").agg(F.count(F.lit(1)).alias("books"))


def decisions(outcomes: DataFrame) -> DataFrame:
    """decision, books (sorted): what a run asks its owner, from outcomes (path, status, applied, watermarked, refusals)."""
    pending = (F.col("status") == "accept") & ~F.col("applied")
    asked = F.array_compact(F.array(F.when(pending | F.col("watermarked"), "apply_lossy"), F.when(F.col("refusals") > 0, "manual_watermark_repair")))
    each = outcomes.select("path", F.explode(asked).alias("decision")).distinct()
    return each.groupBy("decision").agg(F.array_sort(F.collect_list("path")).alias("books"))


def preview(census: DataFrame, dry_run: DataFrame) -> DataFrame:
    """A census with the outcome (path, status) that a dry run foresees for each book."""
    return census.join(dry_run.select("path", F.col("status").alias("preview")), "path", "left")


def phase3(outcomes: DataFrame) -> DataFrame:
    """The totals before, after and projected, and the trouble count, in one row."""
    return gate.pre_post(outcomes).crossJoin(F.broadcast(outcomes.agg(F.count_if(F.col("status").isin(*TROUBLE)).alias("trouble"))))


def corpus(spine: DataFrame, extra: DataFrame) -> DataFrame:
    """Documents of the reading order, then those off it, with their rank: pos within each."""
    ranked = [part.withColumn("rank", F.struct(F.lit(k).alias("off_spine"), "pos")) for k, part in enumerate((spine, extra))]
    return ranked[0].unionByName(ranked[1], allowMissingColumns=True)


# Verdicts


def tags(verdicts: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """book_id, tags (sorted): analyzers whose verdict is a problem that isn't expected of the book.

    verdicts: book_id, analyzer, status; expected: book_id, analyzer. Thin and advisory verdicts don't tag.
    """
    found = verdicts.where(~F.col("status").isin("OK", "THIN", "ADVISORY") & ~F.col("analyzer").isin(*ADVISORY_ANALYZERS))
    found = found if expected is None else found.join(expected.select("book_id", "analyzer").distinct(), ["book_id", "analyzer"], "left_anti")
    return found.groupBy("book_id").agg(F.array_sort(F.collect_set("analyzer")).alias("tags"))


def flagged(verdicts: DataFrame) -> DataFrame:
    """book_id of every book that any analyzer calls a problem, once each."""
    return verdicts.where("problem").select("book_id").distinct()


def expectation(flag: Column, expected: Column) -> Column:
    """clean, expected (a finding that the book's declared languages or tags explain) or flag."""
    return F.when(~flag, "clean").when(F.coalesce(expected, F.lit(False)), "expected").otherwise("flag")


def by_worst(found: DataFrame, measure: str, ascending: bool = False, first: int | None = None) -> DataFrame:
    """A report sorted by its measure, ties by book; only so many rows if asked."""
    out = found.orderBy(F.col(measure).asc() if ascending else F.col(measure).desc(), "book_id")
    return out if first is None else out.limit(first)


def examples(hits: DataFrame, order: list[str], most: int = 8) -> DataFrame:
    """The first hits of each book in that order: at most so many a task and book are kept before they move."""
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("book_id").orderBy(*order))).where(F.col("n") <= most)


def bucket_order(bucket: Column) -> Column:
    """The key that sorts severity buckets: plain numbers and short ranges before long ones, then as text."""
    return F.struct(F.length(bucket) > 3, bucket)


def checked_output(out: str, root: str) -> str:
    """The path of an artifact, refused inside the library that is scanned."""
    plain = [posixpath.normpath(p.removeprefix("file://")) for p in (out, root)]
    if posixpath.commonpath(plain) == plain[1]:
        raise ValueError(f"{out} is inside {root}, which is scanned")
    return out


def artifact(mode: str, root: str, summary: DataFrame, settings: dict | None = None) -> str:
    """A run's JSON artifact from a summary of one row; books are written as a table of their own."""
    return json.dumps({"mode": mode, "root": root, **(settings or {}), "summary": summary.first().asDict()}, indent=2, sort_keys=True)


def written_report(books: DataFrame, out: str, root: str) -> None:
    """One JSON line a book, in parts, outside the library."""
    books.write.mode("error").json(checked_output(out, root))
