"""Hierarchical multi-length packing of tokenized documents."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.arrow import slices, texts, whole_keys
from quireflow.llm.words import encoder

#: Context sizes, longest first.
TIERS = (2048, 1024, 512, 256)
#: Tokens packed together; what doesn't fill a window goes on to the next block.
BLOCK = 1 << 20
#: Tokens of a step group, whatever its tier.
STEP = 16 * TIERS[0]

Item = tuple[int, int, int, int]  # length, running number, document in the block, start


def tier_of(n: int) -> int:
    """The shortest context that holds n tokens."""
    return min(t for t in TIERS if t >= n)


def fill(items: list[Item], serial: Iterator[int]) -> tuple[list[tuple[int, list[Item]]], list[Item]]:
    """Pack items of at most TIERS[0] tokens into windows that are exactly full; the rest is returned.

    The longest item opens a window of its tier, so long windows come first. Its gap takes the
    longest item that fits, mostly of a shorter tier; where none fits, the next longer one is cut.
    """
    pool = sorted(items)
    windows: list[tuple[int, list[Item]]] = []
    while pool:
        window = [pool.pop()]
        size = tier_of(window[0][0])
        gap = size - window[0][0]
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62, 0, 0))
            if at:
                item = pool.pop(at - 1)
            else:
                n, _, doc, start = pool.pop(0)
                item = (gap, next(serial), doc, start)
                insort(pool, (n - gap, next(serial), doc, start + gap))
            window.append(item)
            gap -= item[0]
        if gap:
            return windows, window
        windows.append((size, window))
    return windows, []


def tail(items: list[Item], serial: Iterator[int]) -> list[tuple[int, list[Item]]]:
    """The last items of a task: windows of shorter tiers as long as they are filled, then one window with padding."""
    windows, total = [], sum(i[0] for i in items)
    todo = list(reversed(items))
    for size in TIERS[1:]:
        while total >= size:
            window, room = [], size
            while room:
                n, _, doc, start = todo.pop()
                k = min(n, room)
                window.append((k, next(serial), doc, start))
                if n > k:
                    todo.append((n - k, next(serial), doc, start + k))
                room -= k
            total -= size
            windows.append((size, window))
    return [*windows, (TIERS[0], todo[::-1])] if todo else windows


def step_groups(windows: list[tuple[int, list[Item]]], first: int) -> tuple[list[int], int]:
    """A group number for each window: groups have one tier and STEP tokens, and attention cost is dealt evenly, back and forth."""
    groups = [0] * len(windows)
    for size in TIERS:
        own = [i for i, (s, _) in enumerate(windows) if s == size]
        if not own:
            continue
        n = -(-len(own) * size // STEP)
        own.sort(key=lambda i: -sum(p[0] ** 2 for p in windows[i][1]))
        for k, i in enumerate(own):
            turn, at = divmod(k, n)
            groups[i] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return groups, first


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1, keep_space: bool = True) -> DataFrame:
    """Tokenize whole texts, end each with end_id and pack them into sequences of at most 2048 tokens.

    Documents over 2048 tokens first give full windows; every rest is routed to the shortest tier
    (2048, 1024, 512, 256) that holds it. Windows are filled exactly, long ones from shorter tiers'
    documents, and documents are cut only where none fits whole. A task packs what it reads, in
    blocks of about a million tokens: nothing is shuffled, its memory is bounded by a block and
    the longest text, and it leaves at most one sequence with padding. Within a block, sequences
    of a tier are dealt to step groups of 32768 tokens with even attention cost.

    Returns a row for each piece: key, start, length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset, tier, step_group. Keys are strings or whole numbers (others
    raise), also null. Null and empty texts give end_id alone; repeated rows are packed each; an
    empty table gives none; further columns are not carried. Numbers derive from the scan's
    partitions, so that a task run again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keep_space)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        sequence, group, held = part << 32, part << 32, 0
        serial = iter(range(1 << 62))
        keys: list = []
        tokens: list[np.ndarray] = []
        items: list[Item] = []
        full: list[tuple[int, list[Item]]] = []

        def emit(windows: list[tuple[int, list[Item]]]) -> pa.RecordBatch:
            nonlocal sequence, group
            groups, group = step_groups(windows, group)
            rows: list[tuple] = []
            for g, (size, window) in zip(groups, windows, strict=True):
                offset = 0
                for n, _, doc, start in window:
                    rows.append((keys[doc], start, n, tokens[doc][start : start + n].tobytes(), len(tokens[doc]), sequence, offset, size, g))
                    offset += n
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in slices(batches, "__text", 2 << 20):
            ids, counts = enc.encode(texts(batch, "__text"))
            for k, own in zip(batch.column("__key").to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                doc, own = len(keys), np.r_[own, np.uint32(end_id)].astype("<u4")
                keys.append(k)
                tokens.append(own)
                cut = len(own) // TIERS[0] * TIERS[0]
                full += [(TIERS[0], [(TIERS[0], next(serial), doc, s)]) for s in range(0, cut, TIERS[0])]
                if len(own) > cut:
                    items.append((len(own) - cut, next(serial), doc, cut))
                held += len(own)
            if held >= BLOCK:
                windows, items = fill(items, serial)
                if full or windows:
                    yield emit(full + windows)
                left = sorted({i[2] for i in items})
                place = {d: k for k, d in enumerate(left)}
                keys, tokens = [keys[d] for d in left], [tokens[d] for d in left]
                items, full, held = [(n, s, place[d], start) for n, s, d, start in items], [], 0
        windows, items = fill(items, serial)
        windows = full + windows + tail(items, serial)
        if windows:
            yield emit(windows)

    kind = docs.schema[key].dataType.simpleString()
    inner = "string" if kind == "string" else "bigint" if whole_keys(docs, key) else None
    src = docs.select(F.col(key).cast(inner).alias("__key"), F.col(text).alias("__text"))
    names = ["__key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    types = [pa.string() if inner == "string" else pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    ddl = f"__key {inner}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return src.mapInArrow(run, ddl).withColumn("__key", F.col("__key").cast(kind)).withColumnRenamed("__key", key)
