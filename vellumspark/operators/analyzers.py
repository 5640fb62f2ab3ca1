"""Analyzers over documents of books; thresholds are the contract's, overridable as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions import text as X
from vellumspark.operators.blocks import sliced

MIN_CHARS, THIN_CHARS, MAX_DOC_CHARS = 2_000, 20_000, 300_000
STUB_MIN, STUB_MAX, STUB_REPEAT, STUB_SHARE = 12, 600, 3, 0.30
PROSE_DOC, SPOT, UNREADABLE_SHARE = 400, 120, 0.10
SAMPLE_CHARS, SAMPLE_LETTERS, SAMPLE_WORDS = 400_000, 250_000, 5_000
#: What a placeholder or an injected text says.
PLACEHOLDER = "(?i)bookshout|something went wrong loading|failed to load|(content|page|book)\\s+(is\\s+)?(not available|unavailable|could not be loaded)"
SIGNATURE = "(?i)importknig|книжный импорт|knizhny"
#: Distinctive words of each language, in the order that breaks ties.
STOPWORDS = {
    "en": "the of and to a in that is was for it with as his on be at by he this had not are but from or have an they which one you were her all she there would their",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um",
    "fr": "le la les de des un une et en dans que qui pour pas sur au avec ce il ne se plus par je nous vous est son ses aux",
    "es": "el la los las de un una y en que no se con por para es su lo como más pero sus le ya o este sí porque esta entre",
    "it": "il lo la i gli le di un uno una e che non per con su come più ma anche da sono mi si nel alla dei delle",
    "pt": "o a os as de um uma e que do da em não se com por para mais mas como ao dos das na no à seu",
    "nl": "de het een en van te dat die in is op ik niet met zijn er maar om ook als voor naar dan zou hij heeft",
}
LANGUAGES = tuple(STOPWORDS)


def empty_class(chars: Column, placeholder: Column, corrupt: Column | None = None, min_chars: int = MIN_CHARS, thin_chars: int = THIN_CHARS) -> Column:
    """CORRUPT, EMPTY, PARTIAL, THIN or OK, in that order."""
    out = F.when(corrupt > 0, "CORRUPT") if corrupt is not None else F.when(F.lit(False), "")
    return out.when(chars <= min_chars, "EMPTY").when(placeholder, "PARTIAL").when(chars < thin_chars, "THIN").otherwise("OK")


def emptytext(docs: DataFrame, min_chars: int = MIN_CHARS, thin_chars: int = THIN_CHARS, share: float = STUB_SHARE) -> DataFrame:
    """One row a book from docs (book_id, text, body, carrier): chars, spine_docs, placeholder_sig, stub_docs, status.

    Bodies are counted by book and text first, so that a text that a third of a book's documents repeat is one row.
    """
    stub = F.when(~F.col("carrier") & F.length("body").between(STUB_MIN, STUB_MAX), F.col("body"))
    pooled = docs.withColumn("stub", stub).groupBy("book_id", "stub").agg(
        F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n"), F.max(F.col("text").rlike(PLACEHOLDER)).alias("sig")
    )
    books = pooled.groupBy("book_id").agg(
        F.sum("chars").alias("chars"), F.sum("n").alias("spine_docs"), F.max("sig").alias("placeholder_sig"), F.coalesce(F.max(F.when(F.col("stub").isNotNull(), F.col("n"))), F.lit(0)).alias("stub_docs")
    )
    repeated = (F.col("stub_docs") >= STUB_REPEAT) & (F.col("stub_docs") / F.col("spine_docs") >= share)
    return books.withColumn("status", empty_class(F.col("chars"), F.col("placeholder_sig") | repeated, None, min_chars, thin_chars))


#: How images are named, and what one store leaves in its archives.
IMAGES, BOOKMATE = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"), ("bookmate.css", "calibre_bookmarks.txt")


def entry_signals(names: DataFrame) -> DataFrame:
    """book_id, images, bookmate: how many entries (names: book_id, path) are images, and whether any is such a marker."""
    name = F.lower("path")
    ends = lambda many, test: F.exists(F.array(*[F.lit(x) for x in many]), lambda x: test(name, x))
    return names.groupBy("book_id").agg(F.count_if(ends(IMAGES, F.endswith)).alias("images"), F.bool_or(ends(BOOKMATE, F.contains)).alias("bookmate"))


def stub_class(docs: DataFrame, repeat: int = STUB_REPEAT, share: float = STUB_SHARE) -> DataFrame:
    """The most repeated short text of each book (first in reading order among equals) if it is a stub class.

    A class that is the whole book is refused: nothing would be left.
    """
    short = docs.where(F.length("text").between(STUB_MIN, STUB_MAX)).groupBy("book_id", "text").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    totals = docs.groupBy("book_id").agg(F.count(F.lit(1)).alias("spine_docs"))
    best = short.groupBy("book_id").agg(F.max_by(F.struct("text", "n", "first_pos"), F.struct("n", -F.col("first_pos"))).alias("b"))
    found = best.join(totals, "book_id").select("book_id", "b.text", F.col("b.n").alias("stub_docs"), F.col("b.first_pos").alias("first_pos"), "spine_docs")
    return found.where((F.col("stub_docs") >= repeat) & (F.col("stub_docs") / F.col("spine_docs") >= share) & (F.col("stub_docs") < F.col("spine_docs")))


def monolithic(docs: DataFrame, limit: int = MAX_DOC_CHARS) -> DataFrame:
    """The longest document of each book (docs: book_id, pos, text), the first of equals."""
    sized = docs.select("book_id", "pos", F.length("text").cast("long").alias("chars"))
    best = sized.groupBy("book_id").agg(F.max(F.struct("chars", (-F.col("pos")).alias("back"))).alias("b"))
    return best.select("book_id", F.col("b.chars").alias("max_doc"), (-F.col("b.back")).alias("doc"), (F.col("b.chars") >= limit).alias("flag"))


def doc_ranks(docs: DataFrame, keys: list[str], slices: int = 64) -> DataFrame:
    """docs with `rank` (from 0) in the order of pos within the keys, and `total`; a hot book is spread over slices.

    Slices are ranges of pos: a book's rows before a slice are counted on one row a slice, so no task sees a whole book.
    """
    span = docs.groupBy(*keys).agg(F.min("pos").alias("__lo"), F.max("pos").alias("__hi"), F.count(F.lit(1)).alias("total"))
    cut = docs.join(span, keys).withColumn("__s", F.least(F.lit(slices - 1), F.floor((F.col("pos") - F.col("__lo")) * slices / (F.col("__hi") - F.col("__lo") + 1))).cast("int"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__n")).select(*keys, "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy(*keys, "__s").orderBy("pos"))
    return cut.withColumn("__r", inner).join(offsets, [*keys, "__s"]).withColumn("rank", F.col("__before") + F.col("__r") - 1).drop("__lo", "__hi", "__s", "__r", "__before")


def completeness(docs: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """spine_docs, prose_docs, blank_docs and excerpts of the first, middle and last prose document of each book."""
    shape = docs.groupBy("book_id").agg(F.count(F.lit(1)).alias("spine_docs"), F.count_if(F.length("text") >= PROSE_DOC).alias("prose_docs"), F.count_if(F.col("text") == "").alias("blank_docs"))
    # Keys are ranked; three texts of each book are fetched.
    prose = doc_ranks(docs.where(F.length("text") >= PROSE_DOC).select("book_id", "pos"), ["book_id"])
    spots = prose.where((F.col("rank") == 0) | (F.col("rank") == F.floor(F.col("total") / 2)) | (F.col("rank") == F.col("total") - 1))
    cut = docs.select("book_id", "pos", "text").join(spots.select("book_id", "pos"), ["book_id", "pos"]).select("book_id", "pos", F.length("text").cast("long").alias("chars"), F.substring("text", 1, SPOT).alias("opens"), F.right("text", F.lit(SPOT)).alias("ends"))
    out = cut.join(shape, "book_id", "right")
    if missing is not None:
        out = out.join(missing, "book_id", "left").withColumn("unreadable_frac", F.coalesce(F.col("missing"), F.lit(0)) / (F.col("spine_docs") + F.coalesce(F.col("missing"), F.lit(0))))
    return out


def trailing_toc(html: Column) -> Column:
    """A chapter list: 4 blocks or more, three quarters of them short, none long, half as many links as blocks."""
    bare = X.without_scripts(html)
    blocks = F.filter(F.transform(F.split(bare, "(?i)</(?:p|div|li|h[1-6]|td)>", -1), X.visible_text), lambda b: b != "")
    short = F.size(F.filter(blocks, lambda b: F.length(b) <= 100))
    return (F.size(blocks) >= 4) & (short / F.size(blocks) >= 0.75) & ~F.exists(blocks, lambda b: F.length(b) > 400) & (F.regexp_count(bare, F.lit("(?i)<a[\\s>]")) >= F.size(blocks) * 0.5)


def content_sample(docs: DataFrame, cap: int = SAMPLE_CHARS) -> DataFrame:
    """The documents of each book that the content signal reads: from the start until `cap` characters, and the last.

    Sums run over slices of a book first, so that no task sees all of its documents.
    """
    sized = sliced(docs.select("book_id", "pos", F.length("text").cast("long").alias("chars")), ["book_id"])
    part = Window.partitionBy("book_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("book_id", "slice").agg(F.sum("chars").alias("sum"), F.max("pos").alias("top"))
    sums = sums.select("book_id", "slice", F.coalesce(F.sum("sum").over(part), F.lit(0)).alias("start"), F.max("top").over(Window.partitionBy("book_id")).alias("top"))
    row = Window.partitionBy("book_id", "slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = sized.withColumn("own", F.coalesce(F.sum("chars").over(row), F.lit(0))).join(sums, ["book_id", "slice"])
    out = out.withColumns({"before": F.col("own") + F.col("start"), "last": F.col("pos") == F.col("top")})
    return out.where((F.col("before") < cap) | F.col("last")).select("book_id", "pos", "chars", "before", "last")


def content_counts(sample: DataFrame, most_words: int = SAMPLE_WORDS, most_letters: int = SAMPLE_LETTERS) -> DataFrame:
    """book_id, nwords, hits_<language>, letters, nonlatin, sign of a sample (book_id, pos, clean): of the joined texts the
    first 5,000 words and 250,000 letters count, so a document in which a bound falls is read up to it.

    What the windows see are numbers of a sample, which content_sample has bounded; texts stay where they are.
    """
    sized = sample.select("book_id", "pos", F.least(F.lit(most_words), F.regexp_count(F.lower("clean"), F.lit(X.WORD))).alias("words"), F.length(X.replaced(F.col("clean"), "[^\\p{L}]+", "")).alias("own_letters"))
    before = Window.partitionBy("book_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    left = lambda most, own: F.least(F.col(own), F.greatest(F.lit(0), F.lit(most) - F.coalesce(F.sum(own).over(before), F.lit(0)))).cast("int")
    shares = sized.select("book_id", "pos", left(most_words, "words").alias("words"), left(most_letters, "own_letters").alias("letters"))
    read = sample.join(shares, ["book_id", "pos"]).withColumn("head", F.left(X.replaced(F.col("clean"), "[^\\p{L}]+", ""), F.col("letters")))
    voted = language_hits(read, F.col("clean"), F.col("words"))
    return voted.groupBy("book_id").agg(
        F.sum("nwords").alias("nwords"), *[F.sum(c).alias(f"hits_{c}") for c in LANGUAGES], F.sum("letters").cast("long").alias("letters"),
        F.sum(sum(X.script_counts(F.col("head")).values(), F.lit(0))).cast("long").alias("nonlatin"), F.max(F.regexp_extract("clean", SIGNATURE, 0)).alias("sign"),
    )


def language_hits(docs: DataFrame, text: Column, most: int | Column = SAMPLE_WORDS) -> DataFrame:
    """docs with nwords and, by language, how many of the first words (`most` of them) are its stopwords: one pass over the words.

    A word's languages are bits of a number, which a map has; the numbers are counted by their bits.
    """
    bits: dict[str, int] = {}
    for k, own in enumerate(STOPWORDS.values()):
        for w in set(own.split()):
            bits[w] = bits.get(w, 0) | 1 << k
    known = F.create_map(*[F.lit(x) for pair in sorted(bits.items()) for x in pair])
    words = F.filter(F.col("__w"), lambda w: w.isin(*sorted(bits)))
    out = docs.withColumn("__w", X.words(text, most)).withColumn("nwords", F.size("__w").cast("long")).withColumn("__b", F.transform(words, lambda w: F.element_at(known, w)))
    hit = lambda k: F.size(F.filter("__b", lambda b: b.bitwiseAND(1 << k) > 0)).cast("long")
    return out.withColumns({code: hit(k) for k, code in enumerate(LANGUAGES)}).drop("__w", "__b")


def language_votes(docs: DataFrame, text: Column, name: str = "v") -> DataFrame:
    """docs with struct(best, nwords, ratio, ratio_en): the share of stopwords among the first 5000 words, by language."""
    docs = language_hits(docs, text)
    docs = docs.withColumns({f"__{code}": F.when(F.col("nwords") > 0, F.col(code) / F.col("nwords")).otherwise(0.0) for code in LANGUAGES}).drop(*LANGUAGES)
    docs = docs.withColumn("__best", F.greatest(*[f"__{code}" for code in LANGUAGES]))
    best = F.coalesce(*[F.when(F.col(f"__{code}") == F.col("__best"), F.lit(code)) for code in LANGUAGES])
    vote = F.struct(best.alias("best"), F.col("nwords").cast("int").alias("nwords"), F.col("__best").alias("ratio"), F.col("__en").alias("ratio_en"))
    return docs.withColumn(name, vote).drop("nwords", "__best", *[f"__{code}" for code in LANGUAGES])


def content_findings(vote: Column, nonlatin: Column, letters: Column, text: Column) -> Column:
    """The categories that apply, in order, joined by '; '."""
    script = F.when((nonlatin >= 150) & (nonlatin / F.greatest(letters, F.lit(1)) > 0.02), "NON-LATIN SCRIPT")
    latin = F.when((vote["best"] != "en") & (vote["nwords"] >= 400) & (vote["ratio"] > 0.06) & (vote["ratio"] > 1.3 * vote["ratio_en"]), "LATIN-SCRIPT FOREIGN")
    return F.concat_ws("; ", script, latin, F.when(text.rlike(SIGNATURE), "INJECTION SIGNATURE"))


def spine_class(refs: Column, absent: Column, spine_n: Column, unnumbered: Column, low: Column, high: Column, distinct: Column) -> Column:
    """ok, convention, fragment or unknown, from reference counts and the chapter numbers of present documents."""
    broken = high - low + 1 != distinct
    return (
        F.when(absent == 0, "ok")
        .when((spine_n == 0) | (unnumbered > 0), "unknown")
        .when((refs >= 20) & (absent >= refs * 0.9) & ~broken, "convention")
        .when(broken, "fragment")
        .otherwise("unknown")
    )


def shell_verdict(spine: Column, missing: Column, delim: Column) -> Column:
    """SHELL if half of the manifest's hrefs or more are missing for real; ADVISORY if delimiters alone defeat some."""
    total, genuine = spine + missing, F.greatest(missing - delim, F.lit(0))
    return F.when((spine > 0) & (genuine / F.greatest(total, F.lit(1)) >= 0.5), "SHELL").when(delim > 0, "ADVISORY").otherwise("OK")


def archive_verdict(corrupt: Column, encrypted: Column, drm: Column, obfuscated: Column) -> Column:
    return (
        F.when((encrypted > 0) & (drm == 0), "CORRUPT")
        .when(encrypted > 0, F.when(corrupt > 0, "CORRUPT").otherwise("ENCRYPTED"))
        .when(corrupt > 0, "CORRUPT")
        .when(obfuscated > 0, "OBFUSCATED")
        .otherwise("OK")
    )


def archive_owns_body(corrupt: Column, drm: Column) -> Column:
    return (corrupt > 0) | (drm > 0)
