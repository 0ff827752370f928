"""Trees given by parents: reading order, descendants, and references numbered along them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.sources.scratch import materialize


def closure(edges: DataFrame, child: str = "id", parent: str = "parent") -> DataFrame:
    """ancestor, descendant of all pairs with a path of parents between them, a node of a cycle being its own descendant.

    Each round goes one generation on from the pairs that the last one found and leaves out those
    that are known, so a cycle ends; rounds are as many as the longest path.
    """
    links = materialize(edges.where(F.col(parent).isNotNull()).select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).distinct(), "links")
    step = links.toDF("descendant", "next")
    known = frontier = links
    while not frontier.isEmpty():
        grown = frontier.join(step, "descendant").select("ancestor", F.col("next").alias("descendant")).distinct()
        frontier = materialize(grown.join(known, ["ancestor", "descendant"], "left_anti"), "frontier")
        known = materialize(known.union(frontier), "closure")
    return known


def reading_order(nodes: DataFrame, doc: str, node: str, parent: str, order: str) -> DataFrame:
    """Add path: an array of (order, node) from the root down, whose order is depth first; one round for each level.

    Nodes whose parents don't lead to a root (cycles, missing parents) have no path and are left out.
    """
    place = F.struct(F.col(order).cast("long").alias("o"), F.col(node).alias("n"))
    level = materialize(nodes.where(F.col(parent).isNull()).withColumn("path", F.array(place)), "level")
    levels = [level]
    while not level.isEmpty():
        above = level.select(F.col(doc), F.col(node).alias(parent), F.col("path").alias("__above"))
        level = materialize(nodes.join(above, [doc, parent]).select(*nodes.columns, F.array_append("__above", place).alias("path")), "level")
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def number_references(chapters: DataFrame, known: DataFrame, doc: str, text: str = "text", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Chapters with [@id] rewritten to [n], and doc, n, id, title of the references.

    Ids are numbered by document in the order of their first occurrence, chapters by path; ids are
    trimmed, and blank ones become [0]. A reference without a row in known (id, title) keeps a
    placeholder. Texts are cut at their marks, joined with the numbers, and put together again, so
    a document of any number of chapters or references is spread over tasks.
    """
    marks = F.regexp_extract_all(text, F.lit(r"\[@([^\]]+)\]"), F.lit(1))
    pieces = F.split(text, r"\[@[^\]]+\]", -1)
    keyed = chapters.withColumn("__marks", F.transform(marks, lambda m: F.trim(m))).withColumn("__pieces", pieces)
    cited = materialize(keyed.select(doc, path, F.posexplode("__marks").alias("at", "id")), "cited")
    first = cited.where("id <> ''").groupBy(doc, "id").agg(F.min(F.struct(F.col(path).alias("p"), "at")).alias("first"))
    numbers = materialize(first.select(doc, "id", F.row_number().over(Window.partitionBy(doc).orderBy("first")).cast("long").alias("n")), "numbers")
    told = cited.join(numbers, [doc, "id"], "left").groupBy(doc, path).agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("__numbers"))
    both = keyed.join(told, [doc, path], "left")

    def joined(pieces: Column, found: Column) -> Column:
        rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x, i: F.concat(F.lit("["), F.get(found, i)["n"].cast("string"), F.lit("]"), x))
        return F.concat(pieces[0], F.array_join(rest, ""))

    rewritten = both.withColumn(text, joined(F.col("__pieces"), F.col("__numbers"))).select(*chapters.columns)
    listed = numbers.join(known.select("id", "title"), "id", "left")
    title = F.coalesce("title", F.concat(F.lit("[not found: "), "id", F.lit("]")))
    return rewritten, listed.select(doc, "n", "id", title.alias("title"))
