"""BPE encoding by speculation: greedy longest match, vectorised checks of adjacent pairs, exact merging where one fails."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.arrow import slices, texts
from quireflow.llm.words import PieceLibrary, byte_alphabet, encoder, gather, library

_BASE = 0x9E3779B97F4A7C15
#: Longer pieces aren't speculated on; they are merged exactly at once.
LONGEST = 64


class Speculator:
    """Encodes pieces of a word-final BPE vocabulary ('</w>' marks a piece's last token)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.exact = PieceLibrary(library(path), False)
        alphabet = byte_alphabet()
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[tuple[int, int]]] = {}
        letters = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            final = token.endswith(end) and len(token) > len(end)
            chars = token[: -len(end)] if final else token
            data = letters[i] = bytes(alphabet[ch] for ch in chars)
            if len(data) <= LONGEST:
                by_length.setdefault(len(data), []).append((self._code(data, final), i))
        for n, rows in by_length.items():
            rows.sort()
            self.tables[n] = (np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows], dtype=np.int64))
        self.lengths = sorted(self.tables, reverse=True)
        self.letters, self.widths = np.frombuffer(b"".join(letters), dtype=np.uint8), np.array([len(x) for x in letters], dtype=np.int64)
        self._spines(vocab, model["merges"])
        self.checked = np.zeros(0, np.int64), np.zeros(0, bool)

    @staticmethod
    def _code(data: bytes, final: bool) -> int:
        h = 0
        for k, b in enumerate(data):
            h += (b + 1) * pow(_BASE, k, 1 << 64)
        return (h * 2 + final) % (1 << 64)

    def _spines(self, vocab: dict[str, int], merges: list) -> None:
        """For each token the nodes on the left and the right edge of its merge tree, each with the rank at which the next one up is made."""
        never = len(merges)
        pairs = [(vocab[a], vocab[b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in merges)]
        made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        keys = np.array([a << 20 | b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int64)
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, (token, (a, b)) in enumerate(zip(made, pairs, strict=True)):
            parts.setdefault(token, (a, b, rank))
        size = max(vocab.values()) + 1

        def edge(side: int) -> tuple[np.ndarray, np.ndarray]:
            rows: list[list[tuple[int, int]]] = [[] for _ in range(size)]
            for token in vocab.values():
                at, above = token, never
                while True:
                    rows[token].append((at, above))
                    if at not in parts:
                        break
                    at, above = parts[at][side], parts[at][2]
            deep = max(map(len, rows))
            nodes, ranks = np.full((size, deep), -1, dtype=np.int64), np.full((size, deep), -1, dtype=np.int64)
            for t, row in enumerate(rows):
                for k, (node, above) in enumerate(row):
                    nodes[t, k], ranks[t, k] = node, above
            return nodes, ranks

        self.left, self.right = edge(0), edge(1)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging never crosses the border between tokens a and b.

        Merging goes by rising rank, so a node on the edge of a token's tree stands from its own
        rank to that of the node above it. The border is crossed if the two nodes at it have a
        merge while both stand; of equal ranks the left one comes first.
        """
        codes, back = np.unique(a << 20 | b, return_inverse=True)
        known, verdicts = self.checked
        at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
        hit = known[at] == codes if len(known) else np.zeros(len(codes), bool)
        ok = np.ones(len(codes), bool)
        ok[hit] = verdicts[at[hit]]
        new = codes[~hit]
        if len(new):
            good = self._uncrossed(new >> 20, new & ((1 << 20) - 1))
            ok[~hit] = good
            if len(known) > 1 << 20:
                known, verdicts = known[:0], verdicts[:0]
            both, flags = np.r_[known, new], np.r_[verdicts, good]
            order = np.argsort(both)
            self.checked = both[order], flags[order]
        return ok[back]

    def _uncrossed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        (rn, rr), (ln, lr) = self.right, self.left
        for i in range(rn.shape[1]):
            x, above_x = rn[a, i], rr[a, i]
            if (x < 0).all():
                break
            for j in range(ln.shape[1]):
                y, above_y = ln[b, j], lr[b, j]
                live = np.flatnonzero((x >= 0) & (y >= 0) & ok)
                if not len(live):
                    break
                key = x[live] << 20 | y[live]
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                rank = self.pair_ranks[at]
                ok[live[(self.pair_keys[at] == key) & (rank < above_x[live]) & (rank <= above_y[live])]] = False
        return ok

    def greedy(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest match from the left for all pieces at once: ids, and the piece of each."""
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(sizes)
        up = np.cumprod(np.r_[np.uint64(1), np.full(len(data), _BASE, dtype=np.uint64)], dtype=np.uint64)
        down = np.cumprod(np.r_[np.uint64(1), np.full(len(data), pow(_BASE, -1, 1 << 64), dtype=np.uint64)], dtype=np.uint64)
        total = np.r_[np.uint64(0), np.cumsum((data + np.uint64(1)) * up[:-1], dtype=np.uint64)]
        at, live, ids, owners = ends - sizes, np.arange(len(pieces)), [], []
        while len(live):
            pos, stop = at[live], ends[live]
            token, step = np.full(len(live), -1, dtype=np.int64), np.zeros(len(live), dtype=np.int64)
            open_ = np.arange(len(live))
            for n in self.lengths:
                fit = open_[pos[open_] + n <= stop[open_]]
                if not len(fit):
                    continue
                s = pos[fit]
                code = (total[s + n] - total[s]) * down[s] * np.uint64(2) + (s + n == stop[fit]).astype(np.uint64)
                keys, values = self.tables[n]
                k = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
                hit = keys[k] == code
                token[fit[hit]], step[fit[hit]] = values[k[hit]], n
                open_ = open_[token[open_] < 0]
                if not len(open_):
                    break
            ids.append(token)
            owners.append(live)
            at[live] += step
            live = live[at[live] < ends[live]]
        ids, owners = np.concatenate(ids), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return ids[order], owners[order]

    def _spelled(self, ids: np.ndarray, owner: np.ndarray, pieces: list[bytes]) -> np.ndarray:
        """Whether each piece's tokens spell its bytes, as a token is found by a hash."""
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ok = np.bincount(owner, self.widths[ids], minlength=len(pieces)) == sizes
        data = np.frombuffer(b"".join([p for p, good in zip(pieces, ok.tolist(), strict=True) if good]), dtype=np.uint8)
        wrong = gather(self.letters, self.widths, ids[ok[owner]]) != data
        ok[np.repeat(np.flatnonzero(ok), sizes[ok])[wrong]] = False
        return ok

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after another, and each one's number of ids."""
        short = [i for i, p in enumerate(pieces) if 0 < len(p) <= LONGEST]
        runs, sizes, order = [], np.zeros(len(pieces), np.int64), []
        todo = np.ones(len(pieces), bool)
        if short:
            own = [pieces[i] for i in short]
            ids, owner = self.greedy(own)
            good = np.ones(len(short), bool)
            good[owner[ids < 0]] = False
            ids, owner = ids[good[owner]], owner[good[owner]]
            good &= self._spelled(ids, owner, own)
            same = owner[1:] == owner[:-1]
            good[owner[1:][same][~self.compatible(ids[:-1][same], ids[1:][same])]] = False
            done = np.array(short)[good]
            runs.append(ids[good[owner]].astype(np.uint32))
            sizes[done] = np.bincount(owner, minlength=len(short))[good]
            order += done.tolist()
            todo[done] = False
        rest = np.flatnonzero(todo)
        ids, sizes[rest] = self.exact([pieces[i] for i in rest.tolist()])
        order += rest.tolist()
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return gather(np.concatenate([*runs, ids]), sizes[order], back), sizes


def speculator(path: str) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    return Speculator(path)


def bpe_encode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids (array) and decoded (the tokens' strings joined by one space) of every row's whole text.

    As the library encodes with add_special_tokens=False and decodes without a decoder. Null and
    empty texts have no ids and the empty string. Rows are independent; nothing is shuffled. A
    very long text is a slice of its own; a long piece is merged exactly at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, False, speculator)
        size = enc.lib.get_vocab_size(with_added_tokens=True)
        strings = pa.array([(enc.lib.id_to_token(i) or "") + " " for i in range(size)], pa.large_string())
        for batch in slices(batches, "__text", 2 << 20):
            ids, counts = enc.encode(texts(batch, "__text"))
            ends = np.r_[0, np.cumsum(counts)]
            spelled = pc.take(strings, pa.array(ids.astype(np.int64)))
            places = np.frombuffer(spelled.buffers()[1], dtype=np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
            whole = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(places[ends].copy()), spelled.buffers()[2]])
            decoded = pc.binary_slice(whole, 0, -1).cast(pa.large_string()).cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), lists, decoded], names=["__key", "ids", "decoded"])

    src = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    out = src.mapInArrow(run, f"__key {src.schema['__key'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("__key", key)
