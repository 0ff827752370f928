"""Token-id files: an adaptive context-mixing range coder over independently reset, checksummed blocks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireflow.llm.arrow import slices, texts, whole_keys
from quireflow.llm.words import encoder
from quireflow.sources.scratch import materialize, scratch_path

#: Ids of a block; blocks of a segment are coded side by side, as lanes of the same arrays.
BLOCK = 512
#: Ids after which a segment (a row of the file) is closed, with its last document whole.
SEGMENT = 1 << 21
#: Slots of a block's order-1 and order-2 tables.
SLOTS = 256
#: Order-0 classes of a segment, more where a class would have over 2**13 ids; a segment has 2**20 different ids at most.
CLASSES, CLASS_IDS, IDS = 16, 1 << 13, 1 << 20
#: Bits of the chance of a candidate, of the classes' adaptive shares, and of an id's share of its class.
CHANCE, SHARE, WITHIN = 12, 15, 14
_LOW32 = np.uint64(0xFFFFFFFF)
_LOW16 = np.uint64(0xFFFF)
_WORD = np.uint64(32)
_MASK = (1 << CHANCE) - 1


class Prior:
    """What every block of a segment starts from: its ids by falling frequency, cut into classes of about equal weight.

    A class' share is equal at a block's start and adapts within the block; an id's share of its class is that of the segment.
    """

    def __init__(self, ids: np.ndarray, freq: np.ndarray, starts: np.ndarray):
        self.ids, self.freq, self.starts = ids, freq.astype(np.int64), starts.astype(np.int64)
        self.of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ids)]))
        self.cum = np.cumsum(self.freq) - self.freq - (self.of << WITHIN)  # shares of a class sum up to 2**WITHIN

    @classmethod
    def count(cls, ids: np.ndarray) -> Prior:
        n = np.bincount(ids)
        own = np.flatnonzero(n)
        if len(own) > IDS:
            raise ValueError(f"a segment with {len(own)} different ids; at most {IDS} are coded")
        own = own[np.argsort(-n[own], kind="stable")]
        n = n[own]
        level = np.minimum((np.cumsum(n) - n) * CLASSES // n.sum(), CLASSES - 1)
        inside = np.arange(len(own)) - np.searchsorted(level, level)
        starts = np.flatnonzero(np.r_[True, level[1:] != level[:-1]] | (inside % CLASS_IDS == 0))
        sizes = np.diff(np.r_[starts, len(own)])
        room = np.repeat((1 << WITHIN) - sizes, sizes)
        freq = 1 + n * room // np.repeat(np.add.reduceat(n, starts), sizes)
        freq[starts] += (1 << WITHIN) - np.add.reduceat(freq, starts)
        return cls(own, freq, starts)

    def index(self, ids: np.ndarray) -> np.ndarray:
        place = np.zeros(int(self.ids.max()) + 1, dtype=np.int32)
        place[self.ids] = np.arange(len(self.ids))
        return place[ids]

    def places(self) -> np.ndarray:
        """Class, cumulated share and share of each index in one number."""
        return (self.of << 32 | self.cum << 16 | self.freq).astype(np.uint64)

    def pack(self) -> bytes:
        return zlib.compress(np.r_[len(self.ids), len(self.starts), self.ids, self.freq, self.starts].astype("<u4").tobytes(), 1)

    @classmethod
    def unpack(cls, data: bytes) -> Prior:
        raw = np.frombuffer(zlib.decompress(data), dtype="<u4").astype(np.int64)
        n = int(raw[0])
        return cls(raw[2 : n + 2], raw[n + 2 : 2 * n + 2], raw[2 * n + 2 :])


class Mixer:
    """The adaptive model of every lane, reset at each block.

    Orders 1 and 2 keep, for a context (the last id, the last two), the id that followed and the
    chance that it follows again, both in a slot (index << CHANCE) + chance; a hit raises the
    chance, a miss lowers it, a low one gives the slot to the id that came. Where both name the
    same id their chances are mixed by a weight that follows the better one, else order 2 goes
    before. What is left of the range is order 0's: the classes' shares, which follow the ids of
    the block so far.
    """

    FRESH, LOWEST, TOP = 1 << CHANCE - 2, 1 << CHANCE - 3, (1 << CHANCE) - (1 << CHANCE - 5)

    def __init__(self, lanes: int, classes: int):
        self.lanes, self.lane, self.row = lanes, np.arange(lanes), np.arange(2 * lanes).reshape(2, lanes) * SLOTS
        self.slots = np.zeros(2 * lanes * SLOTS, dtype=np.uint32)
        self.weight = np.full(lanes, 128, dtype=np.int32)
        self.context = np.zeros((2, lanes), dtype=np.int64)
        least = min(1 << 7, (1 << SHARE - 1) // classes)  # of a class' share
        edge = np.arange(1, classes, dtype=np.int32)[:, None]
        self.number, self.low = edge.astype(np.int16), (edge * least).astype(np.int16)
        self.rise = np.int16((1 << SHARE) - classes * least - 1)
        self.shares = np.zeros((classes + 1, lanes), dtype=np.int16)
        self.shares[1:-1] = (edge << SHARE) // classes
        self.shares[-1] = (1 << SHARE) - 1
        self.inner, self.flat = self.shares[1:-1], self.shares.ravel()

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidate's index plus one (0: none) and the chance, of 2**CHANCE, that it is right."""
        self.at = (self.context & SLOTS - 1) + self.row
        self.slot = self.slots[self.at]
        self.c, self.p = self.slot >> np.uint32(CHANCE), (self.slot & np.uint32(_MASK)).view(np.int32)
        (c1, c2), (p1, p2) = self.c, self.p
        self.agree, first = c1 == c2, c2 == 0
        cand, chance = c2.copy(), p2 + ((p1 - p2) * (self.weight * self.agree) >> 8)
        np.copyto(cand, c1, where=first)
        np.copyto(chance, p1, where=first)
        return cand, chance.astype(np.uint64) * (cand > 0)

    def learn(self, came: np.ndarray, group: np.ndarray) -> None:
        """came: the index plus one of the id that came; group: its class."""
        now, p = came.astype(np.uint32), self.p
        hit = self.c == now
        self.slot += ((hit * np.int32(self.TOP) - p) >> 2).view(np.uint32)
        np.copyto(self.slot, (now << np.uint32(CHANCE)) + np.uint32(self.FRESH), where=~hit & (p <= self.LOWEST))
        self.slots[self.at] = self.slot
        toward = ((p[0] > p[1]) == hit[0]) * np.int32(2) - np.int32(1)
        self.weight = np.minimum(np.maximum(self.weight + toward * self.agree, 0), 256)
        mixed = came * 40507 >> 6
        np.add(mixed, self.context[0] * 3, out=self.context[1])
        self.context[0] = mixed
        self.inner += ((self.number > group) * self.rise + self.low - self.inner) >> 5

    def share(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the classes' shares begin and how large they are; group as 64-bit numbers."""
        at = group * self.lanes + self.lane
        low = self.flat[at]
        return low.astype(np.uint64), (self.flat[at + self.lanes] - low).astype(np.uint64)

    def group(self, value: np.ndarray) -> np.ndarray:
        """The classes that hold the values."""
        return np.add.reduce((self.inner <= value).view(np.int8), axis=0, dtype=np.int16)


def _settle(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose range is under 2**32, and the high words of their low ends; a range across a word's border is cut there, so no carry arises."""
    few = np.flatnonzero(span < np.uint64(1 << 32))
    lo, sp = low[few], span[few]
    word = lo >> _WORD
    sp = np.where(word != ((lo + sp) >> _WORD), (~lo + np.uint64(1)) & _LOW32, sp)
    low[few], span[few] = lo << _WORD, sp << _WORD
    return few, word


def encode_blocks(index: np.ndarray, prior: Prior) -> list[bytes]:
    """index: (blocks, BLOCK) order-0 indices. Each block becomes a run of 32-bit words."""
    lanes, steps = index.shape
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out, at = np.zeros((lanes, steps + 2), np.uint32), np.zeros(lanes, np.int64)
    places, mixer = prior.places(), Mixer(lanes, len(prior.starts))
    for column in np.ascontiguousarray(index.T):
        now = column.astype(np.int64)
        place = places[now]
        group = (place >> np.uint64(32)).view(np.int64)
        cand, chance = mixer.predict()
        part = (span >> np.uint64(CHANCE)) * chance
        first, size = mixer.share(group)
        rest = (span - part) >> np.uint64(SHARE)
        piece = rest * size >> np.uint64(WITHIN)
        now += 1
        miss = cand != now
        low += (part + rest * first + piece * (place >> np.uint64(16) & _LOW16)) * miss
        np.copyto(part, piece * (place & _LOW16), where=miss)
        span = part
        few, word = _settle(low, span)
        out[few, at[few]] = word
        at[few] += 1
        mixer.learn(now, group.astype(np.int16))
    out[np.arange(lanes), at] = low >> _WORD
    out[np.arange(lanes), at + 1] = low & _LOW32
    return [row[: n + 2].astype("<u4").tobytes() for row, n in zip(out, at.tolist(), strict=True)]


def decode_blocks(blocks: list[bytes], prior: Prior) -> np.ndarray:
    """The order-0 indices of every block, as encode_blocks was given them."""
    lanes = len(blocks)
    words = np.zeros((lanes, max(map(len, blocks)) // 4 + 2), np.uint64)
    for i, b in enumerate(blocks):
        words[i, : len(b) // 4] = np.frombuffer(b, dtype="<u4")
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    code, at = words[:, 0] << _WORD | words[:, 1], np.full(lanes, 2, np.int64)
    places, mixer = prior.places(), Mixer(lanes, len(prior.starts))
    symbol = np.repeat(np.arange(len(prior.freq)), prior.freq)
    out = np.empty((BLOCK, lanes), dtype=np.int32)
    most, inside = np.uint64((1 << SHARE) - 2), np.uint64((1 << WITHIN) - 1)
    for t in range(BLOCK):
        cand, chance = mixer.predict()
        ahead = code - low
        part = (span >> np.uint64(CHANCE)) * chance
        miss = ahead >= part
        over = (ahead - part) * miss
        rest = (span - part) >> np.uint64(SHARE)
        group = mixer.group(np.minimum(over // rest, most).astype(np.int16)).astype(np.int64)
        first, size = mixer.share(group)
        piece = rest * size >> np.uint64(WITHIN)
        begin = rest * first
        value = np.minimum((over - begin) // piece, inside).view(np.int64)
        now = symbol[(group << WITHIN) + value]
        np.copyto(now, cand.astype(np.int64) - 1, where=~miss)
        place = places[now]
        low += (part + begin + piece * (place >> np.uint64(16) & _LOW16)) * miss
        np.copyto(part, piece * (place & _LOW16), where=miss)
        span = part
        few, _ = _settle(low, span)
        code[few] = code[few] << _WORD | words[few, at[few]]
        at[few] += 1
        out[t] = now
        now += 1
        mixer.learn(now, (place >> np.uint64(32)).astype(np.int16))
    return out.T


def encode_segment(ids: np.ndarray) -> tuple[bytes, list[bytes], list[int]]:
    """Header, coded blocks, and a crc32 of each block that goes on from the header's, so that it covers both."""
    if not len(ids):
        return b"", [], []
    prior = Prior.count(ids)
    lanes = -(-len(ids) // BLOCK)
    grid = np.full(lanes * BLOCK, 0, dtype=np.int32)  # the most frequent id fills the last block
    grid[: len(ids)] = prior.index(ids)
    blocks = encode_blocks(grid.reshape(lanes, BLOCK), prior)
    header = prior.pack()
    start = zlib.crc32(header)
    return header, blocks, [zlib.crc32(b, start) for b in blocks]


def decode_segment(header: bytes, blocks: list[bytes], sums: list[int], n: int) -> np.ndarray:
    """The first n ids of consecutive blocks, all of a segment or some; a block whose checksum fails, or a damaged header, raises."""
    if not n:
        return np.zeros(0, np.uint32)
    start = zlib.crc32(header)
    bad = [i for i, (b, s) in enumerate(zip(blocks, sums, strict=True)) if zlib.crc32(b, start) != s]
    if bad:
        raise ValueError(f"checksum of block {bad[0]} fails")
    prior = Prior.unpack(header)
    return prior.ids[decode_blocks(blocks, prior).ravel()[:n]].astype(np.uint32)


FILE = "part int, segment int, first long, doc_ids array<long>, counts array<long>, n_ids long, header binary, blocks array<binary>, sums array<long>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents, in ascending key order, below path.

    A file holds the segments of one key range, a row each: whole documents' keys and lengths, the
    header that its blocks start from, coded blocks and their checksums. part and segment give the
    order; first is the number of the part's ids before the segment. Null and empty texts have end_id alone; null keys come first; rows with equal keys follow
    by a hash of the text and then by their place in the input, so that a key with many rows is split
    between ranges. Rows are exchanged once, by key range; a task holds one segment at a time. Keys
    are whole numbers (others raise); further columns are not carried.
    """
    whole_keys(docs, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, False)
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        counts: list[int] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal segment, first
            ids = np.concatenate(held)
            header, blocks, sums = encode_segment(ids)
            row = ([part], [segment], [first], [list(keys)], [list(counts)], [len(ids)], [header], [blocks], [sums])
            segment, first = segment + 1, first + len(ids)
            for x in (keys, counts, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in slices(batches, "__text", 4 << 20):
            ids, sizes = enc.encode(texts(batch, "__text"))
            ends = np.cumsum(sizes)
            held.append(np.insert(ids, ends, np.uint32(end_id)))
            keys += batch.column("__key").to_pylist()
            counts += (sizes + 1).tolist()
            if sum(map(len, held)) >= SEGMENT:
                yield close()
        if keys:
            yield close()

    names = ["part", "segment", "first", "doc_ids", "counts", "n_ids", "header", "blocks", "sums"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    src = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"), F.xxhash64(text).alias("__hash"), F.monotonically_increasing_id().alias("__place"))
    order = ["__key", "__hash", "__place"]
    src.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, FILE).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32-bit) of every document in the files."""
    rows = spark.read.schema(FILE).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    parts = materialize(parts, "parts")  # its size is known then, and Spark broadcasts it or not

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in ("part", "first", "doc_ids", "counts", "n_ids", "header", "blocks", "sums")}
                ids = decode_segment(r["header"], r["blocks"], r["sums"], r["n_ids"]).astype("<u4")
                n = np.array(r["counts"], dtype=np.int64)
                ends = np.cumsum(n)
                for a in range(0, len(n), 1000):  # rows of a batch
                    own = slice(a, a + 1000)
                    data = [ids[e - k : e].tobytes() for e, k in zip(ends[own].tolist(), n[own].tolist(), strict=True)]
                    m = len(data)
                    cols = [pa.array([r["part"]] * m, pa.int32()), pa.array(r["doc_ids"][own], pa.int64()), pa.array(r["first"] + ends[own] - n[own]), pa.array(n[own]), pa.array(data, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["part", "__key", "within", "n_tokens", "ids"])

    docs = rows.mapInArrow(run, "part int, __key long, within long, n_tokens long, ids binary")
    return docs.join(parts, "part").select(F.col("__key").alias(key), (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids")


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write docs as token files below path (by default the shared folder) and read them back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
