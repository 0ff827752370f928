"""Alignment of two tokenizers: each distinct text is tokenised and aligned once, pair counts are weighted by its copies."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.arrow import slices
from quireflow.llm.words import PieceMemory, byte_alphabet, encoder, gather
from quireflow.sources.scratch import materialize

#: Bytes of text that are aligned together; a longer text is aligned in parts.
SLICE = 2 << 20
_MEASURES = ("n", "n_a", "n_b", "n_groups", "n_links")
_ALIGNED = "digest binary, " + ", ".join(f"{m} long" for m in _MEASURES) + ", groups_sha256 string, slice long, owners array<binary>, pairs binary, weights binary, owner binary, place binary, times binary"
_NAMES = ["digest", *_MEASURES, "groups_sha256", "slice", "owners", "pairs", "weights", "owner", "place", "times"]


class UnitEncoder(PieceMemory):
    """Ids of texts by a sentencepiece model that marks spaces at the start of words, through distinct units.

    A unit is a run of spaces with what follows up to the next space. No piece of the model has a
    space after another character (else it is refused), so nothing is merged across units and
    each can be encoded on its own; the model adds the space that a unit starts with.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("pieces that go on past a space can't be encoded in units")
        self.letters = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.blank = self.model.piece_to_id("▁")
        super().__init__(self._encode)

    def _encode(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode([u[1:].decode() for u in units], num_threads=1)
        found = [x or [self.blank] for x in found]  # one space alone
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def encode(self, data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after another in data, each with a space before it, and each one's number of ids."""
        b = np.frombuffer(data, dtype=np.uint8)
        start = np.empty(len(b), bool)
        start[:1] = True
        start[1:] = (b[1:] == 32) & (b[:-1] != 32)
        bounds = np.r_[0, np.cumsum(sizes)]
        start[bounds[:-1]] = True
        at = np.flatnonzero(start)
        offsets = np.r_[at, len(b)].astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        return self._ids(cut.dictionary.to_pylist(), cut.indices.to_numpy(), np.diff(np.searchsorted(at, bounds)))


def _letters(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(tokens), dtype=np.uint8), np.array([len(t) for t in tokens], dtype=np.int64)


class Aligner:
    """Tokens of a byte-level BPE (A) and a sentencepiece model (B) over the same bytes."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = encoder(path_a, True, plain=True), UnitEncoder(path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, tokens = byte_alphabet(), {}
        for token, i in spec["model"]["vocab"].items():
            tokens[i] = bytes(alphabet[ch] for ch in token) if all(ch in alphabet for ch in token) else token.encode()
        self.letters_a, self.letters_b = _letters([tokens.get(i, b"") for i in range(max(tokens) + 1)]), _letters(self.b.letters)
        top = max(len(self.letters_a[1]), len(self.letters_b[1]))
        digits = len(str(top)) + 1
        listed = b"".join(f"{i}{mark}".encode().ljust(digits, b"\0") for i in range(top) for mark in ",|;")
        self.decimal = np.frombuffer(listed, dtype=np.uint8).reshape(-1, digits)

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each text's tokens spell it on both sides, and ids and counts of A and B without the tokens of those that don't."""
        whole = [b" " + t for t in texts]
        data, sizes = b"".join(whole), np.array([len(t) for t in whole], dtype=np.int64)
        ends = np.cumsum(sizes)
        sides = [self.a.encode([t.decode() for t in whole]), self.b.encode(data, sizes)]
        good, owners, spelled = sizes > 1, [], []
        for (ids, counts), (_, widths) in zip(sides, (self.letters_a, self.letters_b), strict=True):
            owners.append(np.repeat(np.arange(len(texts)), counts))
            spelled.append(np.bincount(owners[-1], widths[ids], minlength=len(texts)).astype(np.int64))
            good &= spelled[-1] == sizes
        real = np.frombuffer(data, dtype=np.uint8)
        mine = real[np.repeat(good, sizes)]
        for k, (letters, widths) in enumerate((self.letters_a, self.letters_b)):
            wrong = gather(letters, widths, sides[k][0][good[owners[k]]]) != mine
            if wrong.any():
                at = np.flatnonzero(np.repeat(good, sizes))[wrong]
                good[np.searchsorted(ends, at, side="right")] = False
                mine = real[np.repeat(good, sizes)]
        return good, [x for (ids, counts), owner in zip(sides, owners, strict=True) for x in (ids[good[owner]].astype(np.int64), np.where(good, counts, 0))]

    def align(self, texts: list[bytes]) -> dict:
        """Measures of each text, the groups written out (with bounds), and each link's text and ids."""
        good, (a, count_a, b, count_b) = self.tokens(texts)
        ends_a, ends_b = np.cumsum(self.letters_a[1][a]), np.cumsum(self.letters_b[1][b])
        mark = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, np.uint8)
        mark[ends_a] = 1
        mark[ends_b] += 1
        shared_a, shared_b = mark[ends_a] == 2, mark[ends_b] == 2
        last_a, last_b = np.flatnonzero(shared_a), np.flatnonzero(shared_b)
        group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.r_[0, last_b + 1][group_a]] = a * 3 + shared_a
        code[np.arange(len(b)) + (last_a + 1)[group_b]] = b * 3 + 2 * shared_b
        cells = self.decimal[code]
        filled = cells != 0
        bytes_of = np.r_[0, np.cumsum(filled.sum(axis=1))]
        owner = np.repeat(np.arange(len(texts)), count_a)[last_a]
        links = np.bincount(owner, minlength=len(texts))
        bounds = bytes_of[np.r_[0, np.cumsum(count_a + count_b)]]
        return {"good": good, "n_a": count_a, "n_b": count_b, "n_links": links, "written": cells[filled].tobytes(), "bounds": bounds, "owner": owner, "pair": b[last_b] << 32 | a[last_a]}


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each pair of files and worker process."""
    return _aligners.get((path_a, path_b)) or _aligners.setdefault((path_a, path_b), Aligner(path_a, path_b))


def parts(text: bytes, size: int) -> list[bytes]:
    """A long text in parts of about `size` bytes, cut where both tokenizers begin a token: at a space between ASCII letters.

    The space is left out, as each part is read with a space before it. Where no such place is
    found a part goes on.
    """
    b = np.frombuffer(text, dtype=np.uint8)
    letter = ((b | 32) >= 97) & ((b | 32) <= 122)
    safe = np.flatnonzero(letter[:-2] & (b[1:-1] == 32) & letter[2:]) + 1
    cuts, at = [-1], size
    while len(safe) and at < len(text) and (k := np.searchsorted(safe, at)) < len(safe):
        cuts.append(int(safe[k]))
        at = cuts[-1] + size
    return [text[i + 1 : j] for i, j in pairwise([*cuts, len(text)])]


def _slice_row(owners: list[bytes], copies: np.ndarray, owner: np.ndarray, pair: np.ndarray) -> list:
    """What one slice keeps of its links: distinct pairs with weights, and how often each text has each."""
    pairs, back = np.unique(pair, return_inverse=True)
    weights = np.zeros(len(pairs), np.int64)
    np.add.at(weights, back, copies[owner])
    own, times = np.unique(owner * len(pairs) + back, return_counts=True)
    packed = [pairs, weights, *(x.astype(np.int32) for x in (own // len(pairs), own % len(pairs), times))]
    return [int.from_bytes(os.urandom(8), "little", signed=True), owners, *(x.tobytes() for x in packed)]


def _record(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.binary(), *[pa.int64()] * len(_MEASURES), pa.string(), pa.int64(), pa.list_(pa.binary()), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def align_texts(counted: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For distinct texts (text, n) a row of measures each, and rows of slices with their links; other columns are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in slices(batches, "text", SLICE):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            copies = batch.column("n").to_numpy()
            digests = [hashlib.sha256(t).digest() for t in texts]
            pieces = parts(texts[0], SLICE) if len(texts) == 1 else []
            if len(pieces) < 2:
                yield _slice(both, texts, digests, copies)
            else:
                yield from _long(both, pieces, digests, copies)

    return counted.mapInArrow(run, _ALIGNED)


def _slice(both: Aligner, texts: list[bytes], digests: list[bytes], copies: np.ndarray) -> pa.RecordBatch:
    r = both.align(texts)
    view, bounds = memoryview(r["written"]), r["bounds"].tolist()
    hashed = [hashlib.sha256(view[i : j - 1]).hexdigest() if ok else "" for (i, j), ok in zip(pairwise(bounds), r["good"].tolist(), strict=True)]
    links = r["n_links"].tolist()
    rows = [[*row, *[None] * 7] for row in zip(digests, copies.tolist(), r["n_a"].tolist(), r["n_b"].tolist(), links, links, hashed, strict=True)]
    if len(r["pair"]):
        rows.append([None] * 7 + _slice_row(digests, copies, r["owner"], r["pair"]))
    return _record(rows)


def _long(both: Aligner, pieces: list[bytes], digests: list[bytes], copies: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A text in parts: first whether all parts are spelled by their tokens, then the parts one after another."""
    sums, hashed, sep = np.zeros(4, np.int64), hashlib.sha256(), b""
    good = all(both.tokens([p])[0][0] for p in pieces)
    for p in pieces if good else []:
        r = both.align([p])
        sums += [r["n_a"][0], r["n_b"][0], len(r["pair"]), len(r["pair"])]
        hashed.update(sep)
        hashed.update(memoryview(r["written"])[:-1])
        sep = b";"
        yield _record([[None] * 7 + _slice_row(digests, copies, r["owner"], r["pair"])])
    yield _record([[digests[0], int(copies[0]), *sums.tolist(), hashed.hexdigest() if good else "", *[None] * 7]])


def _unpacked(rows: DataFrame, *, weighted: bool) -> DataFrame:
    """pair with weight, or pair with slice and place, one row for each distinct pair of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                pairs = np.frombuffer(batch.column("pairs")[row].as_buffer(), dtype=np.int64)
                if weighted:
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.frombuffer(batch.column("weights")[row].as_buffer(), dtype=np.int64))], names=["pair", "weight"])
                else:
                    at = pa.array(np.full(len(pairs), batch.column("slice")[row].as_py()))
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), at, pa.array(np.arange(len(pairs), dtype=np.int32))], names=["pair", "slice", "place"])

    if weighted:
        return rows.select("pairs", "weights").mapInArrow(run, "pair long, weight long")
    return rows.select("pairs", "slice").mapInArrow(run, "pair long, slice long, place int")


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of one slice: for each of its texts the links that are best and the sum of counts."""
    order = np.argsort(right.column("place").to_numpy())
    count, best = (right.column(c).to_numpy()[order] for c in ("total", "best"))
    owner, place, times = (np.frombuffer(left.column(c)[0].as_buffer(), dtype=np.int32).astype(np.int64) for c in ("owner", "place", "times"))
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    owners = left.column("owners")[0].as_py()
    cols = [pa.array([owners[k] for k in owner[first].tolist()], pa.binary()), *(pa.array(np.add.reduceat(x, first)) for x in (best[place] * times, count[place] * times))]
    return pa.table(cols, names=["digest", "n_best", "count_sum"])


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of two tokenizers over space + text.

    A is a byte-level BPE of the tokenizers library, B a sentencepiece model that adds the space.
    Byte offsets at which tokens of both end cut them into groups, and the two tokens that end
    there are linked. An id pair counts the links of all rows; a link is best if no pair of its
    B id counts more.

    Rows are counted by full text (added up before the shuffle), and each distinct text is
    tokenised and aligned once, in slices of SLICE bytes that are written once with their
    distinct pairs. Pairs are added up, weighted by copies, and their counts joined back to the slices that
    have them; measures go to the rows by a join on the texts' sha256, which adaptive execution
    splits where many rows have one text. Nothing is broadcast by hand or collected.

    Null and empty texts, and texts that tokens of A or B don't spell, have zeros and the empty
    string. Rows that repeat a key stand for themselves. A text of over SLICE bytes is aligned in
    parts, cut at spaces between ASCII letters. An empty table gives an empty result;
    further columns are not carried.
    """
    src = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = src.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    aligned = materialize(align_texts(counted, path_a, path_b), "aligned")
    sliced = aligned.where(F.col("slice").isNotNull())
    totals = materialize(_unpacked(sliced, weighted=True).groupBy("pair").agg(F.sum("weight").alias("total")), "pairs").withColumn("b", F.shiftright("pair", 32))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    ranked = totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    answers = _unpacked(sliced, weighted=False).join(ranked, "pair").select("slice", "place", "total", "best")
    sent = sliced.select("slice", "owners", "owner", "place", "times")
    scored = sent.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_scored, "digest binary, n_best long, count_sum long")
    measured = aligned.where(F.col("slice").isNull()).select("digest", *_MEASURES[1:], "groups_sha256", *(F.lit(0).cast("long").alias(c) for c in ("n_best", "count_sum")))
    blank = [F.lit(0).cast("long").alias(c) for c in _MEASURES[1:]]
    both = measured.unionByName(scored.select("digest", *blank, F.lit("").alias("groups_sha256"), "n_best", "count_sum"))
    numbers = [*_MEASURES[1:], "n_best", "count_sum"]
    per_text = materialize(both.groupBy("digest").agg(*(F.sum(c).alias(c) for c in numbers), F.max("groups_sha256").alias("groups_sha256")), "texts")
    rows = src.select("__key", F.unhex(F.sha2("text", 256)).alias("digest"))
    return rows.join(per_text, "digest").select(F.col("__key").alias(key), *numbers, "groups_sha256")
