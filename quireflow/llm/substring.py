"""Substring deduplication: a count-min prefilter in joined partitions, then exact grouping of the windows it passes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.arrow import raw, slices, whole_keys

#: Bytes of text that are hashed, asked for and stripped together; a longer text is alone.
SLICE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, SLICE + (SLICE >> 3))
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            _powers[name] = np.cumprod(np.r_[np.uint64(1), np.full(size, b, dtype=np.uint64)], dtype=np.uint64)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span, whose place doesn't matter."""
    up, down = _power(len(data))
    total = np.r_[np.uint64(0), np.cumsum((data + np.uint64(1)) * up[: len(data)], dtype=np.uint64)]
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every document, and each document's number of words."""
    data = np.frombuffer(b"\n".join([*docs, b""]), dtype=np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    hashes = span_hashes(data, starts, ends)
    bounds = np.r_[0, np.cumsum([len(d) + 1 for d in docs])]
    return hashes, np.diff(np.searchsorted(starts, bounds))


def gram_words(width: int) -> int:
    """Words of an anchor: 12 for windows of 20, which have 9 of them and are counted by the least."""
    return max(width * 3 // 5, 1)


def anchors(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: whether it lies in one document, and hash and position of its least gram, the leftmost of equal ones."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gram, k, words = hashes, 1, gram_words(width)
    while k < words:
        step = min(k, words - k)
        gram = _mix(gram[:-step] * np.uint64(3) + (gram[step:] ^ (gram[step:] >> np.uint64(17))))
        k += step
    low, at, span, want = gram, np.arange(len(gram)), 1, width - words + 1
    while span < want:
        step = min(span, want - span)
        left = low[:-step] <= low[step:]
        low, at, span = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:]), span + step
    doc = np.repeat(np.arange(len(counts)), counts)
    return doc[:n] == doc[width - 1 :], low[:n], at[:n]


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a task's rows, each with a number of its own that a task run again gives again."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    for n, batch in enumerate(slices(batches, "text", SLICE)):
        seed = xxhash.xxh3_64_intdigest(f"{part}:{n}:{batch.num_rows}".encode())
        yield xxhash.xxh3_64_intdigest(b"".join(t[:64] for t in raw(batch, "text")), seed) - (1 << 63), batch


def count_min(src: DataFrame, width: int, sketch_bits: int) -> DataFrame:
    """For every slice the counters, of those its anchors fall on, that reached 2 over the corpus: rid, cells (64-bit numbers).

    A slice sends the counters it touches (once, with a mark for twice) to the partitions of the
    sketch, which add up what all slices send and answer those that passed. Neither the sketch
    nor an answer is gathered anywhere: a partition holds what was sent for one chunk of
    counters, of which there are more as the sketch grows. Each slice gets at least one row.
    """
    chunk_bits = min(max(sketch_bits - 10, 12), 22)
    mask = np.uint64((1 << sketch_bits) - 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, batch in labelled(batches):
            inside, low, at = anchors(*word_hashes(raw(batch, "text")), width)
            low, at = low[inside], at[inside]
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1]
            cell, n = np.unique((low[new] & mask).astype(np.int64), return_counts=True)
            code = ((cell & ((1 << chunk_bits) - 1)) << 1 | (n > 1)).astype(np.uint32)
            chunk = cell >> chunk_bits
            starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]][: len(chunk)])
            ends = pa.array(np.r_[4 * starts, 4 * len(code)].astype(np.int32))
            codes = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends.buffers()[1], pa.py_buffer(code.tobytes())])
            there = pa.array([-1 - rid % 4096], pa.int64())
            cols = [pa.concat_arrays([pa.array(chunk[starts]), there]), pa.array(np.full(len(starts) + 1, rid)), pa.concat_arrays([codes, pa.array([b""], pa.binary())])]
            yield pa.RecordBatch.from_arrays(cols, names=["chunk", "rid", "codes"])

    def answered(chunk: int, rids: list[int], codes: list[bytes]) -> pa.RecordBatch:
        code = np.frombuffer(b"".join(codes), dtype=np.uint32)
        cell = code >> np.uint32(1)
        distinct, back, n = np.unique(cell, return_inverse=True, return_counts=True)
        n = n + np.bincount(back, code & np.uint32(1), minlength=len(distinct)).astype(np.int64)
        passed = n[back] > 1
        cells = (np.int64(chunk << chunk_bits) + cell[passed]).astype(np.int64)
        sizes = np.add.reduceat(passed, np.cumsum([0, *(len(c) >> 2 for c in codes[:-1])]), dtype=np.int64)
        some = np.flatnonzero(sizes)
        ends = pa.array(np.r_[0, 8 * np.cumsum(sizes[some])].astype(np.int32))
        found = pa.Array.from_buffers(pa.binary(), len(some), [None, ends.buffers()[1], pa.py_buffer(cells.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(np.array(rids, dtype=np.int64)[some]), found], names=["rid", "cells"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rids, codes = None, [], []
        for batch in batches:
            for chunk, rid, code in zip(*(batch.column(c).to_pylist() for c in ("chunk", "rid", "codes")), strict=True):
                if chunk != now and rids:
                    yield answered(now, rids, codes)
                    rids, codes = [], []
                now = chunk
                if chunk >= 0:
                    rids.append(rid)
                    codes.append(code)
            there = batch.filter(pc.less(batch.column("chunk"), 0))
            yield pa.RecordBatch.from_arrays([there.column("rid"), there.column("codes")], names=["rid", "cells"])
        if rids:
            yield answered(now, rids, codes)

    sent = src.mapInArrow(ask, "chunk long, rid long, codes binary")
    return sent.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(answer, "rid long, cells binary")


def passing(docs: list[bytes], width: int, cells: np.ndarray, sketch_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows estimated repeated: document and start within it, and each document's number of words. cells: sorted counters that passed."""
    hashes, counts = word_hashes(docs)
    inside, low, _ = anchors(hashes, counts, width)
    cell = (low & np.uint64((1 << sketch_bits) - 1)).astype(np.int64)
    at = np.minimum(np.searchsorted(cells, cell), max(len(cells) - 1, 0))
    found = np.flatnonzero(inside & (cells[at] == cell)) if len(cells) else np.zeros(0, np.int64)
    first = np.r_[0, np.cumsum(counts)]
    doc = np.searchsorted(first, found, side="right") - 1
    return doc, found - first[doc], counts


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 20, sketch_bits: int | None = None) -> DataFrame:
    """Remove the words of every window of `width` words whose words start earlier elsewhere.

    Earlier: a smaller key, or the same key and a smaller start. Returns key, n_words, n_removed,
    kept_text (kept words joined by one space). Windows are judged on the input.

    A window is counted by the least 12-word gram in it (three fifths of the width), which occurs
    at least as often as the window, and counters only overestimate, so no repeated window is
    lost. The sketch is a row of 2**sketch_bits counters, by default as many as the corpus has
    bytes (about 30 for each counted gram); its partitions are joined with the texts' slices, not
    broadcast. Texts are exchanged once, in slices of about a megabyte, where the answers of the
    sketch meet them. The 128-bit digests of the windows estimated repeated are then grouped
    exactly: only the earliest position of each is kept, aggregated before the shuffle, so a
    passage of any frequency costs one row for each task. Those earliest positions go back to
    the slices; a passing window that isn't among them is removed.

    Null texts have no words. A null key comes before all others; rows that repeat a key count
    as the same document, and equal positions of them are the same occurrence. Keys are whole
    numbers (others raise); further columns are not carried. An empty table gives an empty
    result. Rows must come in the same order when a task is run again, as those of files do; where
    a slice isn't found again the job fails.
    """
    kind = whole_keys(docs, key)
    base, none, shift, size = _packing(docs, key, text)
    sketch_bits = sketch_bits or max(size.bit_length(), 17)
    src = docs.select(F.coalesce(F.col(key).cast("long") - base, F.lit(none)).alias("__key"), F.col(text).alias("text"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, batch in labelled(batches):
            yield batch.append_column("rid", pa.array(np.full(batch.num_rows, rid)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, batch in labelled(batches):
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(np.full(batch.num_rows, rid))], names=["__key", "rid"])

    def found(left: pa.Table, right: pa.Table) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        answers = right.column("cells").drop_null()
        if not left.num_rows or not len(answers):
            raise RuntimeError("a slice of the texts was not found again: rows must come in the same order")
        own = raw(left, "text")
        return own, *passing(own, width, np.sort(np.frombuffer(b"".join(answers.to_pylist()), dtype=np.int64)), sketch_bits)

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        own, doc, start, _ = found(left, right)
        digests = []
        for d, at in zip(*_grouped(doc, start), strict=True):
            words = own[d].split()
            joined = b" ".join(words)
            ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
            heads = [0, *(e + 1 for e in ends)]
            digests.append(b"".join([xxhash.xxh3_128_digest(joined[heads[i] : ends[i + width - 1]]) for i in at.tolist()]))
        code = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        keys = left.column("__key").to_numpy()[doc]
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in (code[:, 0], code[:, 1], keys, start.astype(np.int32))], names=["k1", "k2", "__key", "start"])

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        own, doc, start, counts = found(left, right)
        placed = right.filter(pc.is_valid(right.column("firsts")))
        firsts = dict(zip(placed.column("__key").to_pylist(), placed.column("firsts").to_pylist(), strict=True))
        keys = left.column("__key").to_pylist()
        kept, removed = [b" ".join(t.split()) for t in own], np.zeros(len(own), dtype=np.int64)
        for d, at in zip(*_grouped(doc, start), strict=True):
            gone = np.setdiff1d(at, np.array(firsts.get(keys[d], []), dtype=np.int64))
            if len(gone):
                edge = np.zeros(counts[d] + 1, dtype=np.int64)
                edge[gone] += 1
                edge[gone + width] -= 1
                covered = np.cumsum(edge[:-1]) > 0
                removed[d] = covered.sum()
                kept[d] = b" ".join(w for w, c in zip(own[d].split(), covered.tolist(), strict=True) if not c)
        cols = [left.column("__key"), pa.array(counts, pa.int64()), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())]
        return pa.table(cols, names=["__key", "n_words", "n_removed", "kept_text"])

    answers = count_min(src, width, sketch_bits).select("rid", "cells", F.lit(None).cast("long").alias("__key"), F.lit(None).cast("array<int>").alias("firsts"))
    texts = src.mapInArrow(label, "__key long, text string, rid long").groupBy("rid")
    windows = texts.cogroup(answers.groupBy("rid")).applyInArrow(emit, "k1 long, k2 long, __key long, start int")
    if shift:  # one long: a hash aggregate with short rows
        place = windows.groupBy("k1", "k2").agg(F.min(F.shiftleft("__key", shift).bitwiseOR(F.col("start"))).alias("at"))
        firsts = place.select(F.shiftright("at", shift).alias("__key"), F.col("at").bitwiseAND((1 << shift) - 1).cast("int").alias("start"))
    else:
        firsts = windows.groupBy("k1", "k2").agg(F.min(F.struct("__key", "start")).alias("f")).select("f.*")
    firsts = firsts.groupBy("__key").agg(F.collect_list("start").alias("firsts"))
    sent = src.mapInArrow(places, "__key long, rid long").distinct().join(firsts, "__key").select("rid", F.lit(None).cast("binary").alias("cells"), "__key", "firsts")
    marks = answers.unionByName(sent).groupBy("rid")
    out = texts.cogroup(marks).applyInArrow(strip, "__key long, n_words long, n_removed long, kept_text string")
    return out.select(F.when(F.col("__key") != none, F.col("__key") + base).cast(kind).alias(key), "n_words", "n_removed", "kept_text")


def _packing(docs: DataFrame, key: str, text: str) -> tuple[int, int, int, int]:
    """What is taken from keys, the value of a null key, the bits of a start, or 0 where key and start don't fit in 63 bits, and the bytes of all texts."""
    number, length = F.col(key).cast("long"), F.octet_length(text)
    low, high, longest, size = docs.agg(F.min(number), F.max(number), F.max(length), F.sum(length)).first()
    shift = max(((longest or 0) // 2 + 1).bit_length(), 1)
    if low is None:
        return 0, 0, shift, size or 0
    if low > -(1 << 63) and (high - low + 1).bit_length() + shift <= 63:
        return low - 1, 0, shift, size or 0
    return 0, -(1 << 63), 0, size or 0


def _grouped(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Documents that have windows, each with its starts."""
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
    return doc[at], np.split(start, at[1:]) if len(at) else []
