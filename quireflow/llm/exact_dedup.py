"""Exact deduplication against a persistent digest index."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.arrow import whole_keys
from quireflow.sources.scratch import materialize, scratch_path


def digest(text: str | Column = "text") -> Column:
    """SHA-256 of the text in UTF-8, lowercase hex; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


class DigestIndex:
    """Digests seen so far with the id that stands for each, as Parquet bucketed and sorted by digest.

    Each append writes one more bucketed table below `root` and never rewrites what is there. New
    digests are found by a sort-merge anti-join, and what is stored of some digests by a sort-merge
    join; the stored side is bucketed and sorted already and isn't shuffled. The files are the
    index: attach() registers them again in a new session, detach() ends that, and compact() puts
    all batches into one at another root.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.batches: list[str] = []

    def _name(self, k: int) -> str:
        return "digests_" + re.sub(r"\W+", "_", self.root)[-60:] + f"_{k}"

    def attach(self, n_batches: int) -> DigestIndex:
        """Register the batches that an earlier session has written."""
        for k in range(n_batches):
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._name(k)} (digest STRING, keep_id BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.root}/batch{k}'"
            )
            self.batches.append(self._name(k))
        return self

    def detach(self) -> None:
        """Forget the tables; the files stay."""
        for name in self.batches:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.batches = []

    def compact(self, root: str, buckets: int | None = None) -> DigestIndex:
        """An index at `root` with all that is stored here in one batch; a digest is in one batch only, so nothing is compared."""
        made = DigestIndex(self.spark, root, buckets or self.buckets)
        rows = [self.spark.table(name) for name in self.batches]
        made._write(reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], "digest string, keep_id bigint"))
        return made

    def stored(self, digests: DataFrame, since: int = 0) -> DataFrame:
        """Rows of digests (one for each digest) that are stored, with keep_id and fresh (stored by batch `since` or a later one)."""
        found = [self.spark.table(name).hint("merge").join(digests, "digest").withColumn("fresh", F.lit(k >= since)) for k, name in enumerate(self.batches)]
        return reduce(DataFrame.unionByName, found)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """Rows of digests (one row for each digest) that no stored batch has."""
        for name in self.batches:
            digests = digests.hint("merge").join(self.spark.table(name).select("digest"), "digest", "left_anti")
        return digests

    def append(self, digests: DataFrame) -> None:
        """Store those rows of digests (digest, keep_id) that are new."""
        self._write(self.unseen(digests))

    def _write(self, rows: DataFrame) -> None:
        k = len(self.batches)
        (
            rows.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", f"{self.root}/batch{k}")
            .saveAsTable(self._name(k))
        )
        self.batches.append(self._name(k))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """For every row of docs, the row that stays of those with equal text.

    docs enter the index in `batches` key ranges, largest keys first: each range is aggregated by
    digest, anti-joined with what is stored, and the rest is appended with its largest key. So
    the largest key of equal texts stays, unless `index` held the text before the call; then all
    its rows are dropped in favour of the stored id. Returns key, keep_id, group_size (rows of
    docs with that text), kept, text_sha256.

    A new index has a bucket for each quarter of a million rows, 16 to 8192. Null text is the empty
    text. Keys are whole numbers (others raise). A null key loses to any other key; rows repeated
    with the same key and text are all marked kept. Digests are aggregated before each shuffle, and the join
    back to the rows is one that adaptive execution can split, so a group of copies of any size
    is spread over tasks. An empty table gives an empty result; further columns are not carried.
    """
    spark = docs.sparkSession
    whole_keys(docs, key)
    marked = materialize(docs.select(F.col(key).alias("__key"), digest(text).alias("digest")), "marked")
    own = index is None
    index = index or DigestIndex(spark, scratch_path(spark, "digests"), min(max(16, marked.count() // 250_000), 8192))
    since = len(index.batches)
    steps = [k / batches for k in range(batches - 1, 0, -1)]
    cuts = marked.select(F.percentile_approx("__key", steps, 1000) if steps else F.lit(None)).first()[0] or []
    above = None
    for cut in [*cuts, None]:
        part = marked.where(F.lit(True) if cut is None else F.col("__key") >= cut)
        part = part if above is None else part.where(F.col("__key").isNull() | (F.col("__key") < above))
        index.append(part.groupBy("digest").agg(F.max("__key").alias("keep_id")))
        above = cut
    sizes = marked.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    stays = materialize(index.stored(sizes, since), "stays")
    if own:
        index.detach()
    return marked.join(stays, "digest").select(
        F.col("__key").alias(key),
        "keep_id",
        "group_size",
        (F.col("fresh") & F.col("__key").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with their columns; of rows repeated with key and text one stays."""
    place = ["__key", "__none", "__digest"]  # what rows are exchanged by, once, for the join and for repeated rows
    of = lambda d: [F.coalesce(F.col(key), F.lit(0)).alias("__key"), F.col(key).isNull().alias("__none"), d.alias("__digest")]
    stays = exact_dedup(docs, text, key).where("kept").select(*of(F.col("text_sha256"))).distinct()
    return docs.select("*", *of(digest(text))).join(stays, place, "left_semi").dropDuplicates(place).select(*docs.columns)
