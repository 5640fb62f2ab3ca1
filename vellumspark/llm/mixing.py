"""Mixing sources to target weights by a time-varying curriculum (operator 9), in DataFrame operations only.

Each source has a weight schedule over training time t in [0, 1]: its rate starts at `1 + tilt` and ends at `1 - tilt`
times its mean. Tilts run from +TILT for the first source to -TILT for the last, less their mean weighted by target, so
that the rates of all sources add up to the same at any time and t is the share of the mix's tokens. The schedule's
integral is the source's token demand up to t, `target * (t + tilt * t * (1 - t))`; it is inverted in closed form to give
each copy of a document the time at which its first word is due. Documents are sorted by range of their first such time.

Targets share the total size by weight; none exceeds `most` times its source's size, the excess is reshared by weight.
Within a source documents are taken in the order of a hash of id and text: whole rounds, then one more copy up to the
remaining budget; the document in which the budget ends is cut there. Where rows repeat that document, what is left is
dealt among them, so that some of them take one word more: a source takes its target to the word.

Defined results: a null or empty text has size 0 and takes 0; a null source is a source of its own, last in order; a
source without words has target 0; rows that repeat (same id, text and source) take alike but for that word, and are due alike; rows that share an
id, or have none, but differ in text are planned each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm.common import WORD, shuffle_partitions, written

TILT = 0.5


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """rows with the sums of columns over all rows before them, in that order: of each range of rows, then within it.

    No task sees all rows: the first level has one row for each range.
    """
    parts = shuffle_partitions(rows.sparkSession)
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()), name)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("__range").agg(*[F.sum(c).alias(c) for c in sums.values()])
    starts = ranges.select("__range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{out}") for out, c in sums.items()])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({out: F.coalesce(F.sum(c).over(within), F.lit(0)) for out, c in sums.items()}).join(starts, "__range")
    return own.withColumns({out: F.col(out) + F.col(f"__{out}") for out in sums}).drop("__range", *[f"__{out}" for out in sums])


def source_targets(sized: DataFrame, most: float = 3.0) -> DataFrame:
    """source, source_size, target, tilt from rows of (source, size): water-filling over the sorted caps."""
    # A hot source is summed map-side; what is left has one row for each source.
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    named = running(totals, [F.col("source").asc_nulls_last()], {"n": "one"}, "sources")
    weighed = named.withColumns({"weight": F.pmod("n", F.lit(3)) + 1, "cap": most * F.col("source_size")})
    # In the order of cap / weight, a source is capped if the rest of the total, dealt by the weights from it on, is above its cap.
    order = F.col("cap") / F.col("weight")
    filled = written(running(weighed, [order, F.col("n")], {"caps": "cap", "weights": "weight"}, "caps"), "filled")
    whole = filled.agg(F.sum("source_size"), F.sum("weight"), F.count(F.lit(1))).first()
    level = (F.lit(float(whole[0] or 0)) - F.col("caps")) / (F.lit(whole[1] or 1) - F.col("weights"))
    capped = level * F.col("weight") >= F.col("cap")
    # All that are not capped share the level of the first of them.
    shared = filled.where(~capped).agg(F.min_by(level, F.struct(order, "n"))).first()[0]
    target = F.when(capped, F.col("cap")).otherwise(F.lit(shared) * F.col("weight"))
    tilt = F.lit(TILT) * (1 - 2 * F.col("n") / (whole[2] - 1)) if whole[2] > 1 else F.lit(0.0)
    planned = filled.select("source", "source_size", target.alias("target"), tilt.alias("tilt"))
    mean = planned.agg(F.try_divide(F.sum(F.col("target") * F.col("tilt")), F.sum("target"))).first()[0] or 0.0
    # Rounded, so that the order in which a rerun adds doesn't show.
    return planned.withColumn("tilt", F.round(F.col("tilt") - F.lit(round(mean, 9)), 9))


def due(share: Column, tilt: Column) -> Column:
    """The time t at which the integrated schedule t + tilt * t * (1 - t) reaches this share of the demand."""
    b = 1 + tilt
    exact = (b - F.sqrt(F.greatest(b * b - 4 * tilt * share, F.lit(0.0)))) / (2 * tilt)
    return F.when(F.abs(tilt) < 1e-9, share).otherwise(exact)


def planned(docs: DataFrame, most: float = 3.0, words: str = WORD) -> DataFrame:
    """One row for each different document (doc_id, source, text_key) with copies (how many rows it has), size,
    source_size, target, taken by each row and positions: the time in [0, 1] at which each of its copies is due; `more` of
    its rows have taken_more and positions_more instead."""
    parts = shuffle_partitions(docs.sparkSession)
    # The order within a source: 60 bits of a hash that SQL engines have in common.
    text_key = F.md5(F.coalesce("text", F.lit("")))
    digits = F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("text_key"))), 1, 15)
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(words)), F.lit(0)).cast("long").alias("size"), text_key.alias("text_key"))
    # The texts are read and counted once, and repeated rows are summed map-side; what follows reads ids and sizes.
    sized = sized.groupBy("doc_id", "source", "text_key").agg(F.max("size").alias("own_size"), F.count(F.lit(1)).alias("copies"))
    sized = written(sized.withColumn("size", F.col("own_size") * F.col("copies")), "sizes")
    targets = source_targets(sized.select("source", "size"), most)
    # Prefix sums within a source, in two levels so that a hot source is dealt over all tasks: hash slices, then rows in a slice.
    keyed = sized.withColumn("rank", F.conv(digits, 16, 10).cast("long")).withColumn("slice", F.floor(F.col("rank") / float(1 << 60) * (4 * parts)).cast("int"))
    slices = keyed.select("source", "size", "slice").groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    # Rows of (source, slice) at most; the window of a source has 4 * shuffle partitions of them.
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select("source", "slice", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)).alias("offset"))
    plan = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "slice", "offset", "source_size", "target", "tilt")
    within = Window.partitionBy("source", "slice").orderBy("rank", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("d")
    placed = placed.join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.slice") == F.col("p.slice")))
    budget = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    out = placed.select("doc_id", F.col("d.source").alias("source"), "text_key", "copies", F.col("own_size").alias("size"), "source_size", "target", "tilt", budget.alias("budget"), rounds.alias("rounds"), (F.col("before") + F.col("offset")).alias("start"))
    rest = F.greatest(F.lit(0), F.least(F.col("size") * F.col("copies"), F.col("budget") - F.col("rounds") * F.col("source_size") - F.col("start")))
    out = out.withColumn("rest", rest.cast("long")).withColumns({"more": F.pmod("rest", "copies"), "rest": F.floor(F.col("rest") / F.col("copies"))})

    def copies_with(own: Column) -> tuple[Column, Column]:
        taken = F.least((F.col("rounds") * F.col("size") + own).cast("long"), (most * F.col("size")).cast("long"))
        times = F.col("rounds") + F.when(own > 0, 1).otherwise(0)
        each = F.transform(F.sequence(F.lit(0), times.cast("int") - 1), lambda k: due(F.least(F.lit(1.0), (F.col("start") + k * F.col("source_size")) / F.greatest("target", F.lit(1.0))), F.col("tilt")))
        return taken, F.when(taken > 0, each).otherwise(F.array().cast("array<double>"))

    (taken, positions), (taken_more, positions_more) = copies_with(F.col("rest")), copies_with(F.col("rest") + 1)
    out = out.withColumns({"taken": taken, "positions": positions, "taken_more": taken_more, "positions_more": positions_more})
    return out.drop("tilt", "budget", "rounds", "start", "rest")


def chosen(plan: DataFrame, number: Column) -> DataFrame:
    """plan with taken, positions and position of the row of that number (from 1) among a document's repeats."""
    extra = number <= F.col("more")
    plan = plan.withColumns({"taken": F.when(extra, F.col("taken_more")).otherwise(F.col("taken")), "positions": F.when(extra, F.col("positions_more")).otherwise(F.col("positions"))})
    return plan.withColumn("position", F.get("positions", F.lit(0))).drop("more", "taken_more", "positions_more")


def mix(docs: DataFrame, most: float = 3.0, words: str = WORD) -> DataFrame:
    """doc_id, size, source_size, target, taken, position, positions, source of each row of docs, by position.

    positions: when each copy is due; position: the first of them, null where nothing of the document is taken.
    """
    plan = planned(docs, most, words).withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rows = chosen(plan, F.col("__row")).select("doc_id", "size", "source_size", "target", "taken", "position", "positions", "source")
    return rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "position", "doc_id").sortWithinPartitions("position", "doc_id")


def mixed_documents(docs: DataFrame, most: float = 3.0) -> DataFrame:
    """The columns of docs with size, source_size, target, taken, position and positions of what the mix takes, in its order.

    The mix is planned on ids and sizes; texts are moved once to meet it and once into its order.
    """
    named = ("size", "source_size", "target", "taken", "positions", "position")
    plan = planned(docs, most).where("taken > 0 or more > 0").withColumn("at", F.monotonically_increasing_id())
    plan = written(plan.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_key").alias("__text"), "at", *named[:-1], "more", "taken_more", "positions_more"), "mix")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("__text"))
    rows = docs.drop(*named, "at", "more").withColumn("__row", F.monotonically_increasing_id()).join(plan, same).drop("__id", "__source", "__text")
    # One document of a source at most ends inside its repeats: their numbers are counted in ranges, by row alone, and only
    # their texts move again.
    some = running(rows.where("more > 0").select("__row", "at").withColumn("one", F.lit(1).cast("long")), [F.col("at"), F.col("__row")], {"before": "one"}, "repeats")
    first = some.groupBy("at").agg(F.min("before").alias("least"))
    numbers = written(some.join(first, "at").select("__row", (F.col("before") - F.col("least") + 1).alias("number")), "numbers")
    ends = chosen(rows.where("more > 0").join(numbers, "__row"), F.col("number")).drop("number")
    rows = chosen(rows.where("more = 0"), F.lit(1)).unionByName(ends).where("taken > 0").drop("__row", "at")
    parts = shuffle_partitions(docs.sparkSession)
    return rows.repartitionByRange(parts, "position", "doc_id").sortWithinPartitions("position", "doc_id")
