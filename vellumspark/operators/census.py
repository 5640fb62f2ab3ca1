"""Census of validator findings: parse, tabulate, trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import text as X


def parsed(lines: DataFrame) -> DataFrame:
    """path, fatals, errors, warnings, unreadable, codes (code, messages, occurrences) of lines (value) that can be read.

    `f,e,w ||| CODE:messages:occurrences,... ||| path`: a bare code is one message with unknown occurrences, a token
    with a bad count is skipped, and -1,-1,-1 means that the package was unreadable.
    """
    part = F.split("value", " \\|\\|\\| ", 3)
    tokens = F.filter(F.split(F.get(part, 1), ","), lambda t: t != "")
    one = lambda t: F.split(t, ":", 3)
    number = lambda x: F.trim(x).try_cast("long")
    code = lambda t: F.struct(
        F.get(one(t), 0).alias("code"), F.when(F.size(one(t)) == 1, 1).otherwise(number(F.get(one(t), 1))).cast("long").alias("messages"), number(F.get(one(t), 2)).alias("occurrences")
    )
    counts = F.transform(F.split(F.get(part, 0), ","), lambda x: F.trim(x).try_cast("int"))
    rows = lines.where(F.size(part) == 3).select(F.get(part, 2).alias("path"), counts.alias("n"), F.filter(F.transform(tokens, code), lambda c: c["messages"].isNotNull()).alias("codes"))
    at = lambda k: F.get("n", F.lit(k))
    unreadable = (at(0) == -1) & (at(1) == -1) & (at(2) == -1)
    return rows.select("path", *[F.greatest(at(k), F.lit(0)).alias(name) for k, name in enumerate(("fatals", "errors", "warnings"))], unreadable.alias("unreadable"), "codes")


def completed(census: DataFrame, paths: DataFrame) -> DataFrame:
    """census with an unreadable row for each path that has no answer."""
    silent = paths.select("path").join(census.select("path"), "path", "left_anti")
    zero = [F.lit(0).alias(c) for c in ("fatals", "errors", "warnings")]
    return census.unionByName(silent.select("path", *zero, F.lit(True).alias("unreadable")), allowMissingColumns=True)


def findings():
    return ~F.col("unreadable") & ((F.col("fatals") > 0) | (F.col("errors") > 0) | (F.col("warnings") > 0))


def totals(census: DataFrame) -> DataFrame:
    return census.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("unreadable") & ~findings()).alias("clean"),
        F.count_if(findings()).alias("with_findings"),
        F.count_if("unreadable").alias("unreadable"),
        F.count_if(findings() & (F.col("fatals") > 0)).alias("fatal_books"),
        F.count_if(findings() & (F.col("fatals") == 0) & (F.col("errors") == 0)).alias("warnings_only"),
        F.coalesce(F.sum("errors"), F.lit(0)).cast("long").alias("error_mass"),
    )


def histogram(census: DataFrame) -> DataFrame:
    """bucket, books, over readable books with errors."""
    return census.where(findings() & (F.col("errors") > 0)).groupBy(X.severity_bucket(F.col("errors")).alias("bucket")).agg(F.count(F.lit(1)).alias("books"))


def code_profile(codes: DataFrame) -> DataFrame:
    """code, messages, occurrences, books of rows (path, code, messages, occurrences).

    One row a book and code first, so that a book counts once and a hot code is summed map-side.
    """
    each = codes.groupBy("path", "code").agg(F.sum("messages").alias("messages"), F.sum("occurrences").alias("occurrences"))
    return each.where("messages > 0").groupBy("code").agg(F.sum("messages").alias("messages"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.count(F.lit(1)).alias("books"))


def top_codes(profile: DataFrame, n: int = 10) -> DataFrame:
    """The n codes of most messages, ties by code."""
    return profile.orderBy(F.col("messages").desc(), "code").limit(n)


def worst(census: DataFrame, n: int = 25) -> DataFrame:
    return census.where(findings()).orderBy((F.col("errors") + F.col("fatals")).desc(), F.col("path").desc()).limit(n)


def trend(before: DataFrame, after: DataFrame) -> DataFrame:
    """code, books_before, books_after, change of the codes (code, books) whose number of books changed."""
    both = before.select("code", F.col("books").alias("b")).join(after.select("code", F.col("books").alias("a")), "code", "full_outer")
    both = both.select("code", F.coalesce("b", F.lit(0)).alias("books_before"), F.coalesce("a", F.lit(0)).alias("books_after")).where("books_before <> books_after")
    return both.withColumn("change", F.when(F.col("books_before") == 0, "new").when(F.col("books_after") == 0, "resolved").otherwise("changed"))
