"""Order-dependent analyzers over text blocks (book_id, pos, idx, text, and tag, img_before, in_quote where known).

Neighbours across documents are found in two levels: within a document by a window of that document, and at its ends by
a window over one row a document, so that a book with a third of all blocks isn't one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as X

PROSE_MIN, RUNHEAD_MAX, RUNHEAD_REPEAT = 120, 60, 8
MIN_HITS, MIN_SPAN, MIN_RUN = 5, 0.10, 1
OCR_PARAS, OCR_SPLITS, OCR_RATE, OCR_FUNC = 50, 10, 0.010, 0.25
#: Words on which a damaged line breaks, but an author's paragraph doesn't end.
FUNCTION_WORDS = (
    "the a an and or but of to in on at by with for from as that this these those his her their its my your our was were is are be been being had has have "
    "he she they it we you i not no so if when than then who whom which into onto over under between through during before after above below up down out off "
    "very more most some any each every either neither"
)


def lower_end(text: Column) -> Column:
    return text.rlike("[\\p{Ll},]$")


def lower_start(text: Column) -> Column:
    return text.rlike("^\\p{Ll}")


def paragraphs(html: Column) -> Column:
    """The <p> elements of a document as they stand."""
    return F.regexp_extract_all(html, F.lit("(?is)<p\\b[^>]*>.*?</p>"), F.lit(0))


def running_heads(blocks: DataFrame, repeat: int = RUNHEAD_REPEAT) -> DataFrame:
    """book_id, text, n of short texts that aren't numbers and stand `repeat` times or more in a book."""
    short = blocks.where((F.length("text") <= RUNHEAD_MAX) & (F.col("text") != "") & X.number_value(F.col("text")).isNull())
    return short.groupBy("book_id", "text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= repeat)


SLICES = 64


def sliced(docs: DataFrame, keys: list[str], order: str = "pos", slices: int = SLICES) -> DataFrame:
    """docs with `slice`, ranges of the order within the keys: what is ordered over a whole book is ordered within
    slices first, then over one row a slice."""
    span = docs.groupBy(*keys).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
    at = F.floor((F.col(order) - F.col("__lo")) * slices / (F.col("__hi") - F.col("__lo") + 1))
    return docs.join(span, keys).withColumn("slice", F.least(F.lit(slices - 1), at).cast("int")).drop("__lo", "__hi")


def neighbours(blocks: DataFrame, columns: tuple[str, ...], size: str) -> DataFrame:
    """blocks with prev and next (structs of the columns) and offset (the sum of `size` before them) in the order of
    (pos, idx) of the whole book: within documents, then over one row a document in slices, then over slices."""
    what = F.struct(*columns)
    inside = Window.partitionBy("book_id", "pos").orderBy("idx")
    before = Window.unboundedPreceding, -1
    near = blocks.withColumns({"prev": F.lag(what).over(inside), "next": F.lead(what).over(inside), "own": F.coalesce(F.sum(size).over(inside.rowsBetween(*before)), F.lit(0))})
    docs = sliced(blocks.groupBy("book_id", "pos").agg(F.min_by(what, "idx").alias("first"), F.max_by(what, "idx").alias("last"), F.sum(size).alias("chars")), ["book_id"])
    row, part = Window.partitionBy("book_id", "slice").orderBy("pos"), Window.partitionBy("book_id").orderBy("slice")
    ends = docs.groupBy("book_id", "slice").agg(F.min_by("first", "pos").alias("first"), F.max_by("last", "pos").alias("last"), F.sum("chars").alias("chars"))
    ends = ends.select("book_id", "slice", F.lag("last").over(part).alias("slice_before"), F.lead("first").over(part).alias("slice_after"), F.coalesce(F.sum("chars").over(part.rowsBetween(*before)), F.lit(0)).alias("slice_offset"))
    docs = docs.withColumns({"before": F.lag("last").over(row), "after": F.lead("first").over(row), "doc_offset": F.coalesce(F.sum("chars").over(row.rowsBetween(*before)), F.lit(0))}).join(ends, ["book_id", "slice"])
    docs = docs.select("book_id", "pos", "slice", F.coalesce("before", "slice_before").alias("before"), F.coalesce("after", "slice_after").alias("after"), (F.col("doc_offset") + F.col("slice_offset")).alias("doc_offset"))
    joined = near.join(docs, ["book_id", "pos"])
    return joined.withColumns({"prev": F.coalesce("prev", "before"), "next": F.coalesce("next", "after"), "offset": F.col("own") + F.col("doc_offset")}).drop("before", "after", "own", "doc_offset")


def body_blocks(blocks: DataFrame) -> DataFrame:
    """blocks with `paragraph`, without documents that are navigation (nav, if known) or mostly list items (tag, if known)."""
    out = blocks if "nav" not in blocks.columns else blocks.where(~F.coalesce("nav", F.lit(False)))
    if "tag" not in blocks.columns:
        return out.withColumn("paragraph", F.lit(True))
    items = F.avg((F.col("tag") == "li").cast("int")).over(Window.partitionBy("book_id", "pos"))
    return out.withColumn("__li", items).where("__li <= 0.5").drop("__li").withColumn("paragraph", F.col("tag").isin("p", "div"))


def marked_blocks(blocks: DataFrame) -> DataFrame:
    """What the page number rules ask of each block of a body: its length, its number, how it begins and ends, whether it
    is a running head. Texts are left behind here, so what is ordered and moved after this is small."""
    known = body_blocks(blocks)
    text = F.col("text")
    facts = known.select(
        "book_id", "pos", "idx", F.length(text).alias("chars"), (F.col("paragraph") & (F.length(text) > PROSE_MIN)).alias("prose"),
        F.when(F.col("paragraph"), X.number_value(text)).alias("number"), text.rlike("\\p{L}-$").alias("split"), lower_end(text).alias("open_end"), lower_start(text).alias("low_start"),
        F.when((F.length(text) <= RUNHEAD_MAX) & X.number_value(text).isNull(), text).alias("short"),
    )
    heads = facts.where("short <> ''").groupBy("book_id", "short").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RUNHEAD_REPEAT).select("book_id", "short", F.lit(True).alias("head"))
    return facts.join(heads, ["book_id", "short"], "left").withColumn("head", F.coalesce("head", F.lit(False)))


def baked_blocks(marked: DataFrame) -> DataFrame:
    """book_id, pos, idx, slice, offset, chars, value, baked of marked blocks: whether a block is a page number wedged into
    the text.

    A number that isn't a year, next to a paragraph of prose, where a word is split before it, or the text goes on in
    lower case after it, or an unfinished paragraph meets prose or a running head, or it stands between running heads.
    """
    near = neighbours(marked, ("prose", "split", "open_end", "low_start", "head"), "chars")
    p, n = (lambda c, side=side: F.coalesce(F.col(f"{side}.{c}"), F.lit(False)) for side in ("prev", "next"))
    unfinished = p("prose") & p("open_end")
    baked = p("split") | n("low_start") | (unfinished & (n("prose") | n("head"))) | (p("head") & n("head"))
    page = F.col("number").isNotNull() & ~F.col("number").between(1500, 2099)
    return near.select("book_id", "pos", "idx", "slice", "offset", "chars", F.col("number").alias("value"), F.coalesce(page & (p("prose") | n("prose")) & baked, F.lit(False)).alias("baked"))


def longest_run(hits: DataFrame) -> DataFrame:
    """book_id, run: the longest chain of hits whose values rise by 1 or 2.

    Chains within a slice are islands of a running sum of breaks; those of slices are joined where one goes on in the next.
    """
    goes_on = lambda a, b: F.coalesce((b - a).isin(1, 2), F.lit(False))
    order = Window.partitionBy("book_id", "slice").orderBy("pos", "idx")
    marked = hits.withColumn("brk", F.when(goes_on(F.lag("value").over(order), F.col("value")), 0).otherwise(1)).withColumn("island", F.sum("brk").over(order))
    islands = marked.groupBy("book_id", "slice", "island").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", F.struct("pos", "idx")).alias("low"), F.max_by("value", F.struct("pos", "idx")).alias("high"))
    parts = islands.groupBy("book_id", "slice").agg(F.count(F.lit(1)).alias("islands"), F.max("n").alias("best"), F.min_by("n", "island").alias("head"), F.max_by("n", "island").alias("tail"), F.min_by("low", "island").alias("low"), F.max_by("high", "island").alias("high"))
    # One entry a slice.
    rows = parts.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("slice", "islands", "best", "head", "tail", "low", "high"))).alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("best"), F.lit(0).cast("long").alias("tail"), F.lit(None).cast("int").alias("high"))

    def joined(a: Column, x: Column) -> Column:
        met = F.when(goes_on(a["high"], x["low"]), a["tail"] + x["head"]).otherwise(x["head"])
        return F.struct(F.greatest(a["best"], x["best"], met).alias("best"), F.when(x["islands"] == 1, met).otherwise(x["tail"]).alias("tail"), x["high"].cast("int").alias("high"))

    return rows.select("book_id", F.aggregate("parts", start, joined)["best"].alias("run"))


def pagenumbers(blocks: DataFrame) -> DataFrame:
    """book_id, n_hits, span, run, flag of each book from blocks (book_id, pos, idx, text; tag and nav where known)."""
    known = baked_blocks(marked_blocks(blocks))
    at = F.when(F.col("baked"), F.col("offset"))
    sums = known.groupBy("book_id").agg(F.sum("chars").alias("chars"), F.count(at).alias("n_hits"), F.min(at).alias("lo"), F.max(at).alias("hi"))
    out = blocks.select("book_id").distinct().join(sums, "book_id", "left").join(longest_run(known.where("baked")), "book_id", "left")
    out = out.select("book_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce((F.col("hi") - F.col("lo")) / F.greatest("chars", F.lit(1)), F.lit(0.0)).alias("span"), F.coalesce("run", F.lit(0)).alias("run"))
    return out.withColumn("flag", (F.col("n_hits") >= MIN_HITS) & (F.col("span") >= MIN_SPAN) & (F.col("run") >= MIN_RUN))


def page_layer(blocks: DataFrame) -> DataFrame:
    """book_id, arabic, confident, layer: whether a book has a printed-page layer (20 numbers, 3 sure interruptions).

    Neighbours are those within a document: the nearest block that isn't empty, the nearest that is prose.
    """
    kinds = blocks.withColumn("num", X.number_value(F.col("text"), years=False))
    heads = running_heads(blocks).select("book_id", "text", F.lit(True).alias("head"))
    kinds = kinds.join(heads, ["book_id", "text"], "left")
    kind = F.when(F.col("num").isNotNull(), "number").when(F.col("text") == "", "empty").when(F.col("head"), "runhead").otherwise("prose")
    kinds = kinds.withColumn("kind", kind)
    order = Window.partitionBy("book_id", "pos").orderBy("idx")
    back, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    prose = F.when(F.col("kind") == "prose", F.col("text"))
    solid = F.when(F.col("kind") != "empty", F.struct("kind", "text"))
    seen = kinds.withColumn("pp", F.last(prose, True).over(back)).withColumn("np", F.first(prose, True).over(on)).withColumn("nn", F.first(solid, True).over(on))
    near = (F.length("pp") > PROSE_MIN) | (F.length("np") > PROSE_MIN)
    sure = F.col("pp").rlike("-$") | ((F.col("nn.kind") == "prose") & lower_start(F.col("nn.text")))
    numbers = seen.where("kind = 'number'").select("book_id", F.col("text").rlike("^[0-9]+$").alias("digits"), (F.coalesce(near, F.lit(False)) & F.coalesce(sure, F.lit(False))).alias("confident"))
    out = numbers.groupBy("book_id").agg(F.count_if("digits").alias("arabic"), F.count_if("confident").alias("confident"))
    return out.withColumn("layer", (F.col("arabic") >= 20) & (F.col("confident") >= 3))


def ocr(blocks: DataFrame) -> DataFrame:
    """book_id, paras, splits, split_rate, func_frac, flag: paragraphs split in mid-sentence, within a document only.

    img_before and in_quote are taken as false where a block source doesn't know them.
    """
    have = set(blocks.columns)
    known = blocks
    for name in ("img_before", "in_quote"):
        if name not in have:
            known = known.withColumn(name, F.lit(False))
    if "tag" not in have:
        known = known.withColumn("tag", F.lit("p"))
    order = Window.partitionBy("book_id", "pos").orderBy("idx")
    doc = Window.partitionBy("book_id", "pos")
    body = known.withColumn("li", F.avg(F.when(F.col("tag") == "li", 1.0).otherwise(0.0)).over(doc)).withColumn("also", F.count_if(F.col("text").rlike("\\bSee also\\b")).over(doc))
    body = body.where("li <= 0.5 and also < 3").withColumn("nx", F.lead(F.struct("text", "tag", "img_before", "in_quote")).over(order))
    prev, nxt = F.col("text"), F.col("nx.text")
    paragraph = F.col("tag").isin("p", "div")
    whole = (F.length(nxt) >= 40) | nxt.rlike("[.!?\"'’”…)]$")
    letters = F.least(X.alpha_density(prev), X.alpha_density(nxt)) >= 0.5
    split = paragraph & F.col("nx.tag").isin("p", "div") & ~F.col("nx.img_before") & ~F.col("in_quote") & ~F.col("nx.in_quote") & whole & letters & lower_end(prev) & lower_start(nxt) & ((F.length(prev) > PROSE_MIN) | (F.length(nxt) > PROSE_MIN))
    last = F.lower(F.regexp_extract(prev, "(\\S*?),*$", 1))
    counted = body.select("book_id", paragraph.alias("para"), (F.coalesce(split, F.lit(False)) & (last != "that")).alias("split"), last.isin(FUNCTION_WORDS.split()).alias("func"))
    out = counted.groupBy("book_id").agg(F.count_if("para").alias("paras"), F.count_if("split").alias("splits"), F.count_if(F.col("split") & F.col("func")).alias("func_splits"))
    rate, frac = F.when(F.col("paras") > 0, F.col("splits") / F.col("paras")).otherwise(0.0), F.when(F.col("splits") > 0, F.col("func_splits") / F.col("splits")).otherwise(0.0)
    out = out.select("book_id", "paras", "splits", rate.alias("split_rate"), frac.alias("func_frac"))
    return out.withColumn("flag", (F.col("paras") >= OCR_PARAS) & (F.col("splits") >= OCR_SPLITS) & (F.col("split_rate") >= OCR_RATE) & (F.col("func_frac") >= OCR_FUNC))


def ocr_side_signals(text: Column) -> dict[str, Column]:
    """En-dash words and doubled quotes in a text, and its camel-case words whose hyphenated form it has too."""
    camel = F.array_distinct(F.regexp_extract_all(text, F.lit("\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b"), F.lit(0)))
    glued = F.filter(camel, lambda w: F.contains(text, X.replaced(w, "(?<=[a-z])(?=[A-Z])", "-")))
    return {
        "en_dash_words": F.regexp_count(text, F.lit("[A-Za-z]–[A-Za-z]")),
        "doubled_quotes": F.regexp_count(text, F.lit("(?U)(?<=\\s)['‘]\\s+['‘’]\\w")),
        "glued": F.size(glued),
    }
