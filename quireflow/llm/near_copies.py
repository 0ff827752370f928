"""Near copies by the Jaccard similarity of five-word runs: SimHash fingerprints, then MinHash buckets give candidates, and each is verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.arrow import raw, slices, whole_keys
from quireflow.llm.simhash import fingerprints, near_fingerprints
from quireflow.llm.substring import _mix, word_hashes
from quireflow.operators.components import connected_components
from quireflow.sources.scratch import materialize

#: Texts link at so much Jaccard similarity of their sets of WIDTH-word runs.
WIDTH, LEAST = 5, 0.8
#: A bucket is a band of ROWS minima. A pair at .8 shares none of BANDS buckets with a chance of (1 - .8**6)**40 = 5e-6.
BANDS, ROWS = 40, 6
#: Members of a bucket outside its largest component, from which on pairs are made by prefixes and not all.
CROWD = 8
#: Counters of grams, by which those rows' grams are put in order.
CELLS = 1 << 18
_FACTORS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def grams(docs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's runs of `width` words, ASCII lower-cased, and their number; fewer words make one run, no words too."""
    docs = [d.lower() for d in docs]
    gram, counts = word_hashes(docs)
    doc = np.repeat(np.arange(len(counts)), counts)
    k = 1
    while k < width and len(gram) > 1:
        step = min(k, width - k)
        gram = _mix(gram[:-step] * np.uint64(3) + (gram[step:] ^ (gram[step:] >> np.uint64(17))))
        k += step
    n = max(len(doc) - width + 1, 0)
    whole = counts >= width
    sizes = np.where(whole, counts - width + 1, 1)
    out = np.empty(int(sizes.sum()), np.uint64)
    long = np.repeat(whole, sizes)
    out[long] = gram[:n][doc[:n] == doc[len(doc) - n :]]
    out[~long] = [xxhash.xxh64_intdigest(b" ".join(docs[i].split()), width) for i in np.flatnonzero(~whole)]
    return out, sizes


def buckets(rows: DataFrame, width: int) -> DataFrame:
    """__key and bucket, BANDS rows for each row of __key and __text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1 << 20):
            gram, sizes = grams(raw(batch, "__text"), width)
            starts = np.cumsum(sizes) - sizes
            key = batch.column("__key")
            for b in range(BANDS):
                bucket = np.full(len(sizes), b, np.uint64)
                for factor in _FACTORS[b * ROWS : (b + 1) * ROWS]:
                    bucket = _mix(bucket * np.uint64(3) + np.minimum.reduceat(gram * factor, starts))
                yield pa.RecordBatch.from_arrays([key, pa.array(bucket.view(np.int64))], names=["__key", "bucket"])

    return rows.mapInArrow(run, f"__key {rows.schema['__key'].dataType.simpleString()}, bucket long")


def gram_sets(rows: DataFrame, width: int) -> DataFrame:
    """__key, n and grams, the distinct hashes of the row's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 1 << 20):
            gram, sizes = grams(raw(batch, "__text"), width)
            own = [np.unique(g) for g in np.split(gram, np.cumsum(sizes)[:-1])]
            n = np.array([len(g) for g in own], np.int32)
            ends = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
            sets = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(n), sets], names=["__key", "n", "grams"])

    return rows.mapInArrow(run, f"__key {rows.schema['__key'].dataType.simpleString()}, n int, grams array<long>")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs u, v whose sets have a Jaccard similarity of `least` or more; sizes that rule it out go first."""
    size = lambda c: sets.select(F.col("__key").alias(c), F.col("n").alias(f"n{c}"))
    own = lambda c: sets.select(F.col("__key").alias(c), F.col("n").alias(f"n{c}"), F.col("grams").alias(f"g{c}"))
    fit = pairs.join(size("u"), "u").join(size("v"), "v").where(F.least("nu", "nv") / F.greatest("nu", "nv") >= least)
    fit = materialize(fit.select("u", "v").distinct(), "fit")
    both = fit.join(own("u"), "u").join(own("v"), "v")
    k = F.size(F.array_intersect("gu", "gv"))
    return both.where(k / (F.col("nu") + F.col("nv") - k) >= least).select("u", "v").distinct()


def _pairs(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def crowd_pairs(sets: DataFrame, least: float) -> DataFrame:
    """u, v: all pairs of different components that can be similar enough, by prefixes and positions, without loss.

    A row's grams are put in an order that is the same for all rows. The first gram that two
    rows share stands at places i and j, so they share at most min(n_i - i, n_j - j) of them; a
    similarity of `least` takes least / (1 + least) of both sizes, so only a prefix of each row is
    joined. Any order is exact; this one puts rare grams first, by counts of CELLS hashed cells
    (a fixed size, sent to all tasks). In a large group of texts with edits of their own the edits
    come first, so that texts with too many of them make no pair.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("grams").flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["cell", "n"])

    found = sets.select("grams").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(CELLS, np.int64)
    often[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    often = sets.sparkSession.sparkContext.broadcast(often)

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("grams")
            gram, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((gram, often.value[gram & (CELLS - 1)], row))
            place = np.arange(len(gram)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = place <= sizes[row] * (1 - least) + 1e-9
            own = pa.array(row[kept])
            cols = [batch.column(c).take(own) for c in ("__key", "component", "n")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gram[order][kept]), pa.array(place[kept].astype(np.int32))], names=["__key", "component", "n", "g", "i"])

    kind = sets.schema["__key"].dataType.simpleString()
    head = sets.select("__key", "component", "n", "grams").mapInArrow(prefix, f"__key {kind}, component {sets.schema['component'].dataType.simpleString()}, n int, g long, i int")
    head = materialize(head, "prefixes")
    a, b = (head.select("g", *(F.col(c).alias(f"{c}_{s}") for c in ("__key", "component", "n", "i"))) for s in ("a", "b"))
    most = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    fits = (F.col("component_a") < F.col("component_b")) & (most >= least / (1 + least) * (F.col("n_a") + F.col("n_b")) - 1e-9)
    return a.join(b, (a["g"] == b["g"]) & fits).select(*_pairs("__key_a", "__key_b")).distinct()


def near_copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """key and component_id (the smallest key reachable): texts link at a Jaccard similarity of `least` of their runs of `width` words.

    SimHash fingerprints of the runs link at 3 or fewer differing bits, by an inverted index over
    byte positions with count filtering, and every link is verified. A fingerprint of texts at .8
    differs in about 10 bits, so MinHash buckets add the pairs that it leaves. Every pair that
    shares a bucket is verified, except within what is linked already: first each
    member of a bucket against the member that shares most buckets, so that a large group of
    copies takes one pair a member; then all pairs of a bucket that are in different components,
    where over CROWD members are outside the largest one those that crowd_pairs leaves.
    Word-less texts count as equal. Keys are whole numbers (others raise); rows with a null key are left out,
    and rows that repeat a key count as one, which links as any of them.
    """
    whole_keys(docs, key)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    near = materialize(near_fingerprints(materialize(fingerprints(rows, "__key", "__text", width), "fingerprints")), "near")
    placed = materialize(buckets(rows, width), "buckets")
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("__key").alias("lo"), F.max("__key").alias("hi"))
    members = materialize(placed.join(shared.where("lo <> hi").select("bucket", "size"), "bucket"), "members")
    score = materialize(members.groupBy("__key").agg(F.sum("size").alias("score")), "score")
    asked = score.select("__key").union(near.select("u")).union(near.select("v")).distinct()
    sets = materialize(gram_sets(rows.join(asked, "__key", "left_semi"), width), "sets")
    hubs = members.join(score, "__key").groupBy("bucket").agg(F.max(F.struct("score", "__key")).alias("top"))
    hubs = materialize(hubs.select("bucket", F.col("top.__key").alias("hub")), "hubs")
    tried = materialize(members.join(hubs, "bucket").where("__key <> hub").select(*_pairs("__key", "hub")).union(near).distinct(), "tried")
    links = materialize(verified(tried, sets, least), "links")

    comp = materialize(connected_components(links), "components")
    labelled = members.join(comp, F.col("__key") == F.col("node"), "left").select("bucket", "__key", F.coalesce("component", "__key").alias("component"))
    parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    main = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all"))
    main = main.where("parts > 1").select("bucket", F.col("top.component").alias("main"), (F.col("all") - F.col("top.size") > CROWD).alias("crowded"))
    apart = materialize(labelled.join(main, "bucket"), "apart")
    few = apart.where("not crowded")
    outer = few.where("component <> main").select("bucket", F.col("__key").alias("a"), F.col("component").alias("of_a"))
    inner = few.select("bucket", F.col("__key").alias("b"), F.col("component").alias("of_b"))
    open_pairs = outer.join(inner, "bucket").where("of_a <> of_b").select(*_pairs("a", "b"))
    crowd = apart.where("crowded").select("__key", "component").distinct()
    open_pairs = open_pairs.union(crowd_pairs(materialize(sets.join(crowd, "__key"), "crowd"), least)).distinct()
    rest = materialize(verified(open_pairs.join(tried, ["u", "v"], "left_anti"), sets, least), "rest")
    if not rest.isEmpty():
        comp = connected_components(links.union(rest))
    return rows.select("__key").distinct().join(comp, F.col("__key") == F.col("node"), "left").select(F.col("__key").alias(key), F.coalesce("component", "__key").alias("component_id"))


def keep_one_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near copies the row with the smallest key, with its columns; rows with a null key stay, of repeated rows one stays."""
    gone = near_copy_groups(docs, key, text).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__gone"))
    return docs.join(gone, docs[key] == gone["__gone"], "left_anti").dropDuplicates([key, text])
