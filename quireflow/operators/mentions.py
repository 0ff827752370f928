"""Mentions of many titles, and of first authors with years, found in one scan of the texts for each shard of targets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.sources.scratch import materialize

#: Bytes of titles in one automaton.
SHARD = 16 << 20
LEAST_CHARS, LEAST_WORDS = 10, 2
_NAME = r"(?<![^\W_])[^\W\d_](?:[^\W_]|['’-](?=[^\W_]))*"
#: Author et al. (2020); Author (2020); Author, 2020
_YEARS = re.compile(rf"({_NAME})(?:\s+et\s+al\.\s*\(\s*(\d{{4}})\s*\)|\s*\(\s*(\d{{4}})\s*\)|\s*,\s*\(?\s*(\d{{4}})(?:\s*\))?)", re.IGNORECASE)


def lowered(text: str) -> str:
    """Lower case, each character for itself, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


class Targets:
    """The targets of a shard: an automaton over the titles and a table of surnames with years."""

    def __init__(self, rows: list[tuple]):
        self.titles, self.authors = ahocorasick.Automaton(), {}
        by_title: dict[str, list[int]] = {}
        for key, title, surname, year in rows:
            low = lowered(title or "")
            if len(low) >= LEAST_CHARS and len(low.split()) >= LEAST_WORDS:
                by_title.setdefault(low, []).append(key)
            if surname and len(surname) > 1 and year:
                self.authors.setdefault((lowered(surname), year), []).append(key)
        for low, keys in by_title.items():
            self.titles.add_word(low, (len(low), keys))
        self.titles.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """Target and place of each mention."""
        if len(self.titles):
            for last, (size, keys) in self.titles.iter(lowered(text)):
                at = last - size + 1
                if not (at and text[at - 1].isalnum()) and not (last + 1 < len(text) and text[last + 1].isalnum()):
                    yield from ((key, at) for key in keys)
        for m in _YEARS.finditer(text) if self.authors else ():
            year = int(next(g for g in m.groups()[1:] if g))
            for start in (0, *(k.end() for k in re.finditer("['’-]", m[1]))):  # a name that begins within another
                yield from ((key, m.start() + start) for key in self.authors.get((lowered(m[1][start:]), year), ()))


def dealt(rows: DataFrame, key: str, size: Column, shard: int) -> list[Broadcast]:
    """The rows in shards of about `shard` bytes, by hash of the key, each broadcast on its own."""
    spark = rows.sparkSession
    shards = -(-int(rows.agg(F.sum(size)).first()[0] or 0) // shard) or 1
    placed = materialize(rows.withColumn("__shard", F.pmod(F.xxhash64(key), F.lit(shards))), "shards")
    return [spark.sparkContext.broadcast([tuple(r) for r in placed.where(F.col("__shard") == k).drop("__shard").collect()]) for k in range(shards)]  # one shard at a time


def containing_any(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """term, key: each of the lower-case terms that a row's lower-cased text contains, in one scan for each shard of terms."""
    src = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())

    def scan(own: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = ahocorasick.Automaton()
            for (term,) in own.value:
                found.add_word(term, term)
            found.make_automaton()
            for batch in batches:
                hits = [(term, doc) for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for term in sorted({w for _, w in found.iter(t.lower())})] if len(found) else []
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.int64())], names=["term", "__key"])

        return src.mapInArrow(run, "term string, __key long")

    parts = dealt(terms.select("term").where("term <> ''").distinct(), "term", F.octet_length("term") + 16, shard)
    return reduce(DataFrame.unionByName, map(scan, parts)).select("term", F.col("__key").alias(key))


def mentions(docs: DataFrame, targets: DataFrame, window: int = 400, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """target, key, pos (from 1), context: every place where a text mentions a target, with `window` characters to both sides.

    Targets (target, title, surname, year) are dealt by hash to shards of about `shard` bytes, each
    of which is broadcast for a scan of its own; texts aren't shuffled. A title counts with ten
    characters and two words or more, in any case, where no letter or digit adjoins it; a surname of
    two letters or more counts before its year. Of a text's equal contexts for a target the first
    stays. Keys are whole numbers; null texts mention nothing.
    """
    src = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())

    def scan(own: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Targets(own.value)
            for batch in batches:
                for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hits = [(target, doc, at + 1, t[max(0, at - window) : at + window]) for target, at in sorted(set(found.find(t)), key=lambda x: x[1])]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*hits, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["target", "__key", "pos", "context"])

        return src.mapInArrow(run, "target long, __key long, pos long, context string")

    size = F.octet_length(F.coalesce("title", F.lit(""))) + F.octet_length(F.coalesce("surname", F.lit(""))) + 16
    parts = dealt(targets.select("target", "title", "surname", F.col("year").cast("int").alias("year")), "target", size, shard)
    found = reduce(DataFrame.unionByName, map(scan, parts))
    first = F.row_number().over(Window.partitionBy("target", "__key", "__digest").orderBy("pos"))
    kept = found.withColumn("__digest", F.xxhash64("context", F.sha2("context", 256))).withColumn("__k", first).where("__k = 1")
    return kept.select("target", F.col("__key").alias(key), "pos", "context")
