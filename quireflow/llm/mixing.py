"""Mixing sources to target weights: Efraimidis-Spirakis keys in each source, prefix sums to token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.sources.scratch import materialize

_WORD, _NOT_LETTER, _SPACE = r"[^\x20\x09-\x0D]+", r"[^\p{L}]+", r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of other than white space; null has none. Each run becomes one letter, so no list of words is built."""
    runs = F.regexp_replace(F.regexp_replace(text, _WORD, "x"), _SPACE, "")
    return F.coalesce(F.length(runs), F.lit(0)).cast("long")


def prose_weight(text: Column, size: Column) -> Column:
    """Quality of a text in (0, 1]: its share of letters among all characters, less for texts of under 50 words."""
    letters = F.length(F.regexp_replace(text, _NOT_LETTER, "")) / F.length(text)
    share = F.when(F.length(text) > 0, letters).otherwise(0.0)
    return (0.1 + 0.9 * share) * (0.25 + 0.75 * F.least(F.lit(1.0), size / 50))


def exponential_key(key: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of an md5 of seed and key: the smallest keys are a weighted sample without replacement.

    Without a weight above 0 the key is infinite, so such rows come last.
    """
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10)
    u = (digits.cast("long") + 0.5) / float(1 << 52)
    return F.when((weight > 0) & ~F.isnan(weight), -F.log(u) / weight).otherwise(float("inf"))


def _ordered(rows: DataFrame, *order: str) -> DataFrame:
    """rows sorted over all partitions and written, with __part (of the sort) and __id (rising in the order)."""
    placed = rows.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    return materialize(placed, "ordered").withColumn("__part", F.shiftright("__id", 33))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """__source, source_size (sizes, one row for each source), with target (double), epochs and budget (words beyond them).

    Sources in order take the weights in turn, repeating, and share share[0]/share[1] of all
    sizes. A source above `most` times its size stops there and the excess goes to the others by
    weight, until none is above; each round is one aggregate that adds up what has stopped, in
    whole numbers.
    """
    up, down = share
    placed = _ordered(sizes, "__source")
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # one row for each partition of the sort
    parts = parts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__id")) + F.col("before") - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    listed = materialize(placed.join(parts, "__part").select("__source", "source_size", weight.cast("long").alias("w")), "sources")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    total = listed.agg(F.sum(exact("source_size"))).first()[0]
    total, pool, over, stopped, last = int(total or 0), 0, 1, F.lit(False), None
    while True:
        done, left = listed.agg(F.sum(F.when(stopped, exact("source_size"))), F.sum(F.when(~stopped, F.col("w")))).first()
        if (done, left) == last or not left:
            break
        last = (done, left)
        pool, over = up * total - down * most * int(done or 0), down * int(left)  # an open source gets w * pool / over
        stopped = exact("w") * F.lit(pool).cast("decimal(38,0)") > exact("source_size") * F.lit(most * over).cast("decimal(38,0)")
    whole = F.col("source_size") * most
    part = exact("w") * F.lit(pool).cast("decimal(38,0)")
    found = listed.select(
        "__source",
        "source_size",
        F.when(stopped, whole.cast("double")).otherwise(part.cast("double") / F.lit(float(over))).alias("target"),
        F.when(stopped, whole).otherwise(F.call_function("div", part, F.lit(over).cast("decimal(38,0)"))).cast("long").alias("__words"),
    )
    epochs = F.when(F.col("source_size") > 0, F.expr("__words div source_size")).otherwise(F.lit(0))
    return found.withColumn("epochs", epochs.cast("long")).withColumn("budget", F.col("__words") - F.col("epochs") * F.col("source_size")).drop("__words")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: tuple[int, int] = (3, 2),
    most: int = 2,
    quality: Column | None = None,
    seed: int = 13,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """How many words of each row a mix of the sources takes: key, source, size, source_size, target, epochs, taken.

    A source's target is met by complete epochs first: every row `epochs` times. The rest of the
    budget goes to a weighted sample without replacement: rows in the order of their
    Efraimidis-Spirakis keys (quality weights, by default prose_weight) are taken until the prefix
    sum of sizes reaches it, and the row at the border gives its first words only, so that a
    source's words are its target rounded down.

    The texts are scanned once, for sizes and keys. Those rows are sorted by source and key over
    all partitions and added up in each (source, partition), so no task holds a source. Sources
    are ordered by code point, null last, and null and the empty string are different sources. Null texts
    have size 0. Rows with equal keys are ordered by key column and size; rows equal in these
    count one by one, and which of them is taken shows nowhere. An empty table gives an empty
    result; further columns are not carried.
    """
    named = F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source)))
    sized = docs.select(F.col(key).alias("__key"), named.alias("__source"), n_words(F.col(text)).alias("size"), (quality if quality is not None else F.lit(None)).alias("__given"), F.col(text).alias("__text"))
    weight = F.col("__given").cast("double") if quality is not None else prose_weight(F.col("__text"), F.col("size"))
    drawn = sized.select("__key", "__source", "size", exponential_key(F.col("__key"), weight, seed).alias("__draw"))
    placed = _ordered(drawn, "__source", "__draw", "__key", "size")
    parts = materialize(placed.groupBy("__source", "__part").agg(F.sum("size").alias("words")), "parts")
    targets = source_targets(parts.groupBy("__source").agg(F.sum("words").alias("source_size")), weights, share, most)
    before = F.sum("words").over(Window.partitionBy("__source").orderBy("__part")) - F.col("words")  # a row for each partition of the sort
    asked = parts.select("__source", "__part", before.alias("before")).join(targets, "__source")
    within = F.sum("size").over(Window.partitionBy("__source", "__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, 0))
    rows = placed.join(asked, ["__source", "__part"]).withColumn("__left", F.col("budget") - F.col("before") - within + F.col("size"))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("__left"), F.col("size")))
    return rows.select(F.col("__key").alias(key), F.when(F.col("__source") != "1", F.substring("__source", 2, 1 << 30)).alias(source), "size", "source_size", "target", "epochs", taken.alias("taken"))
