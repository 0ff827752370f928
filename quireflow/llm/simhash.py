"""SimHash near-duplicates by an inverted index over byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.arrow import raw, slices
from quireflow.operators.components import connected_components
from quireflow.sources.scratch import materialize

#: Fingerprints link at so many differing bits at most, so they share at least 5 of 8 positional bytes.
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
#: Of any 5 byte positions, 3 lie in one half: postings are keyed by 3 positions of a half.
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
#: The positions beside a triple and their pairs; a linked pair in a triple's posting shares one of these pairs too.
PAIRS = [list(combinations([p for p in range(8) if p not in t], 2)) for t in TRIPLES]
SUB = 1 << 60
#: Where a posting's key has the number of its fingerprint, if texts have several.
SERIES = 50
_SHIFTS = np.arange(8, dtype=np.int64) * 256
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> list[int]:
    """XXH64 of each run of `width` words, ASCII lower-cased and joined by one space; fewer words make one run."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return [h(joined, seed)]
    starts = [0, *(e + 1 for e in ends)]
    return [h(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def fingerprint(hashes: list[int]) -> int:
    """Bit i is 1 if over half of the hashes have it; zero without hashes."""
    if not hashes:
        return 0
    octets = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _SHIFTS).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits((2 * counts.ravel() > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """key and fp (the 64 bits as a signed long) of every row; texts are read whole in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            fps = np.array([fingerprint(shingle_hashes(t, width)) for t in raw(batch, "__text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(fps.view(np.int64))], names=["__key", "fp"])

    src = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return src.mapInArrow(run, f"__key {src.schema['__key'].dataType.simpleString()}, fp long")


def _packed(positions: tuple[int, ...], head: int) -> Column:
    out = F.lit(head)
    for p in positions:
        out = out * 256 + F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255)
    return out


def postings(distinct: DataFrame, split_above: int) -> DataFrame:
    """(key, fp) for 8 keys of a fingerprint (series, fp); keys with more than split_above fingerprints are split by two more positions, exactly."""
    spark = distinct.sparkSession
    series = F.col("series").cast("long") * (1 << SERIES)
    keyed = distinct.select("fp", F.posexplode(F.array(*[series + _packed(t, k) for k, t in enumerate(TRIPLES)])).alias("t", "key"))
    large = materialize(keyed.groupBy("key").count().where(F.col("count") > split_above).select("key"), "large")
    rows = ", ".join(f"({k}, {16 * k + j}, {a}, {b})" for k in range(8) for j, (a, b) in enumerate(PAIRS[k]))
    pairs = spark.sql(f"SELECT * FROM VALUES {rows} AS p(t, head, a, b)")  # 80 rows
    octet = lambda c: F.expr(f"shiftrightunsigned(fp, 8 * {c}) & 255")
    triple = F.col("key").bitwiseAND((1 << 24) - 1)
    finer = keyed.join(large, "key", "left_semi").join(F.broadcast(pairs), "t")
    series = F.shiftright("key", SERIES) * (1 << SERIES)
    finer = finer.select((series + (F.col("head").cast("long") * (1 << 40)) + triple * 65536 + octet("a") * 256 + octet("b") + F.lit(SUB)).alias("key"), "fp")
    return keyed.join(large, "key", "left_anti").select("key", "fp").union(finer)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tally shared positional bytes, keep those with enough, verify the bits."""
    x = a ^ b
    shared = (x.reshape(-1, 1).view(np.uint8) == 0).sum(axis=1).reshape(x.shape)
    return (shared >= MIN_SHARED) & (np.bitwise_count(x) <= MAX_BITS)


def _by_pairs(fps: np.ndarray) -> np.ndarray:
    """Least index that each fingerprint reaches; rows of the pair table are made in blocks."""
    m = len(fps)
    step = max(1, (1 << 20) // m)
    near = np.vstack([_near(fps[i : i + step, None], fps[None, :]) for i in range(0, m, step)])
    label = np.arange(m)
    while True:
        low = np.array([label[row].min() for row in near])
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _by_masks(fps: np.ndarray, key: int) -> np.ndarray:
    """The same for a split key: 3 bytes are free, so every neighbour is found in a table of 2**24 cells."""
    k, j = divmod((key & ((1 << SERIES) - 1)) >> 40, 16)
    free = [p for p in range(8) if p not in (*TRIPLES[k], *PAIRS[k][j])]
    rest = sum(((fps >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64) << (8 * i) for i, p in enumerate(free))
    cells = np.full(1 << 24, -1, dtype=np.int32)
    cells[rest] = np.arange(len(fps), dtype=np.int32)
    masks = [sum(1 << b for b in c) for n in range(1, MAX_BITS + 1) for c in combinations(range(24), n)]
    label = np.arange(len(fps))
    while True:
        low = label.copy()
        for mask in masks:
            other = cells[rest ^ mask]
            low = np.where(other >= 0, np.minimum(low, label[other]), low)
        low = np.minimum(low, low[low])
        if (low == label).all():
            return label
        label = low


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of a key arrive together; each gives at most one link, to the first that it reaches there."""
    limit = 4096
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def ready(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        two = two[_near(fps[two], fps[two + 1])] if len(two) else two
        hi, lo, of = [fps[two + 1]], [fps[two]], [keys[two]]
        for s, m in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            own = fps[s : s + m]
            label = _by_masks(own, int(keys[s])) if m > limit and keys[s] >= SUB else _by_pairs(own)
            moved = label != np.arange(m)
            hi.append(own[moved])
            lo.append(own[label[moved]])
            of.append(np.full(int(moved.sum()), keys[s]))
        series = (np.concatenate(of) & (SUB - 1)) >> SERIES
        cols = [pa.array(series.astype(np.int32)), *(pa.array(np.concatenate(x).view(np.int64)) for x in (hi, lo))]
        return pa.RecordBatch.from_arrays(cols, names=["series", "u", "v"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy()])
        fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
        if len(keys) and keys[0] != keys[-1]:
            last = int(np.searchsorted(keys, keys[-1]))
            yield ready(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield ready(keys, fps)


def _linked(distinct: DataFrame, split_above: int) -> DataFrame:
    """series, u, v: links between fingerprints at MAX_BITS or fewer differing bits; what links directly is linked by a path in its posting."""
    return postings(distinct, split_above).repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links, "series int, u long, v long")


def near_fingerprints(marked: DataFrame, split_above: int = 4096) -> DataFrame:
    """u, v (u > v): rows of marked (__key, fp), each of equal fingerprints with the least of these, and the least ones of fingerprints that the index links."""
    distinct = materialize(marked.groupBy("fp").agg(F.min("__key").alias("first_key")), "distinct")
    equal = marked.join(distinct, "fp").where(F.col("__key") > F.col("first_key")).select(F.col("__key").alias("u"), F.col("first_key").alias("v"))
    links = materialize(_linked(distinct.select("fp", F.lit(0).alias("series")), split_above), "links")
    for c in "uv":
        links = links.join(distinct.toDF(c, f"key_{c}"), c)
    return equal.union(links.select(F.greatest("key_u", "key_v"), F.least("key_u", "key_v"))).distinct()


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, split_above: int = 4096) -> DataFrame:
    """Fingerprint and component of every row; fingerprints link at 3 or fewer differing bits.

    Returns key, fingerprint (16 hex digits), component_id (the smallest key reachable). Work is
    on distinct fingerprints, so copies cost nothing; postings hold at most split_above
    fingerprints, or are split into ones with at most 2**24; a posting emits at most one link
    per member, and no pair that links is missed. Null and word-less texts have fingerprint zero
    and link as any other. Null keys never are the smallest key, unless all of a component are
    null. Repeated rows are returned as often as they come; an empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs, key, text, width), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("__key").alias("first_key")), "distinct")
    comp = connected_components(_linked(distinct.select("fp", F.lit(0).alias("series")), split_above))
    rooted = distinct.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "first_key", F.coalesce("component", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first_key").alias("component_id")), "least")
    labels = materialize(rooted.join(least, "root").select("fp", "component_id"), "labels")
    return marked.join(labels, "fp").select(F.col("__key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
