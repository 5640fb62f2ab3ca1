"""Accepting or vetoing a repair from measurements before and after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Repairs whose gain a validator doesn't see, so that they only have to do no harm.
UNSEEN = ("stripped_pagination", "stripped_broken_tags", "stripped_watermarks", "dropped_marker", "stub_docs_dropped", "cover_meta_repointed", "cover_meta_removed", "media_types_normalized", "entries_renamed")


def gate(bf: Column, be: Column, af: Column, ae: Column) -> Column:
    """reject, accept, partial or noop from fatals and errors before and after."""
    started_fatal = F.when(af == 0, "accept").when(af < bf, "partial").otherwise("noop")
    clean_start = F.when(ae > be, "reject").when(ae < be, "accept").otherwise("noop")
    return F.when(af > bf, "reject").when(bf > 0, started_fatal).otherwise(clean_start)


def no_worse(bf: Column, be: Column, af: Column, ae: Column) -> Column:
    return ~((af > bf) | ((bf == 0) & (ae > be)))


def verdict(bf: Column, be: Column, af: Column, ae: Column, unseen: Column, delimiters: Column, dangles_before: Column, dangles_after: Column, resolved_before: Column, resolved_after: Column, spine_pruned: Column) -> Column:
    """The gate with its promotions and vetoes, the later ones overriding; null measurements are errors, null probes veto nothing."""
    first = gate(bf, be, af, ae)
    first = F.when((first == "noop") & (bf > 0), "partial").otherwise(first)
    open_now = F.when(af > 0, "partial").otherwise("accept")
    bar = F.when(unseen, F.when(~no_worse(bf, be, af, ae), "reject").otherwise(open_now)).otherwise(first)
    bar = F.when(delimiters, F.when(af > bf, "reject").otherwise(open_now)).otherwise(bar)
    collapsed = F.coalesce(dangles_after > dangles_before, F.lit(False))
    halved = F.coalesce(spine_pruned & (resolved_after * 2 < resolved_before), F.lit(False))
    out = F.when(collapsed | halved, "reject").otherwise(bar)
    missing = bf.isNull() | be.isNull() | af.isNull() | ae.isNull()
    return F.when(missing, "error").when(out == "noop", "equal").otherwise(out)


def selected(books: DataFrame, only: str, audited: bool) -> DataFrame:
    """Candidates among books (path, fatals, errors, warnings; null where not measured, ncx_mismatch)."""
    f, e, w = F.col("fatals"), F.col("errors"), F.col("warnings")
    if only == "ncx":
        return books.where("ncx_mismatch")
    if only == "fatals":
        return books.where(f.isNotNull() & (f > 0) if audited else f.isNull() | (f > 0))
    return books.where(f.isNull() | ~((f == 0) & (e == 0) & (w == 0)))


def phase1(audit: DataFrame, repair: DataFrame) -> DataFrame:
    """path, status of books that an audit (path, audit_status) or a repair (path, repair_status) knows."""
    both = audit.join(repair, "path", "full_outer")
    a, r = F.coalesce("audit_status", F.lit("")), F.coalesce("repair_status", F.lit(""))
    status = F.when((a == "error") | (r == "error"), "error").when(r.isin("reject", "partial") | (a == "problem"), "problem").otherwise("clean")
    return both.withColumn("status", status)


def pre_post(outcomes: DataFrame) -> DataFrame:
    """Totals before, after (a book that wasn't applied keeps its before) and projected (what rejected ones would be)."""
    kinds = ("fatals", "errors", "warnings")
    total = lambda name, value: F.coalesce(F.sum(value), F.lit(0)).cast("long").alias(name)
    return outcomes.agg(
        *[total(f"before_{k}", F.col(f"before_{k}")) for k in kinds],
        *[total(f"after_{k}", F.when(F.col("applied"), F.col(f"after_{k}")).otherwise(F.col(f"before_{k}"))) for k in kinds],
        *[total(f"projected_{k}", F.when(~F.col("applied") & F.col("status").isin("reject", "partial"), F.col(f"after_{k}"))) for k in kinds],
    )
