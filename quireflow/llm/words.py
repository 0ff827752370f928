"""Whole texts to token ids through each batch's distinct pieces.

Tokenizers cut a text into pieces by a pattern and encode each piece on its own. Here the cut is
made for a batch at once with numpy, distinct pieces are found with Arrow, and only pieces not
met before are encoded; the ids of a text are then gathered. Texts with characters for which the
cut isn't proven to agree with the library's are cut by the library itself; those with special
tokens go to it whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

#: Characters that the fast cut doesn't handle: NUL (used between texts), three letters whose lower case leaves the range, all beyond Latin but for common punctuation.
_OTHER = re.compile("[\0İȺȾ̀-‏ -\U0010ffff]")
_LETTER, _NUMBER, _SPACE, _END = 1, 2, 3, 4
_WHITE = {*range(9, 14), 0x20, 0x85, 0xA0}


def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x2028)], dtype=np.uint8)
    table[[*_WHITE]] = _SPACE
    table[0] = _END
    return table


_CLASS = _classes()
_ASCII = bytes([*_CLASS[:128].tolist(), *[0] * 128])


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


#: UTF-8 of each byte's character in that alphabet (0: none); blanks and line ends stand for themselves.
_SPELLED = np.zeros((256, 2), dtype=np.uint8)
for _ch, _b in byte_alphabet().items():
    _SPELLED[_b, : len(_ch.encode())] = [*_ch.encode()]
_SPELLED[[10, 32]] = [[10, 0], [32, 0]]

_TO_LATIN = {ord(ch): chr(b) for ch, b in byte_alphabet().items()}


def library(path: str, plain: bool = False) -> Tokenizer:
    """The tokenizer file as it stands, without truncation and padding, on one thread; plain takes special tokens' strings for ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = plain
    tok.no_truncation()
    tok.no_padding()
    return tok


def _contractions(b: np.ndarray, c: np.ndarray, start: np.ndarray, joined_space: bool) -> None:
    """An apostrophe alone before s, t, m, d, re, ve or ll makes one piece with it."""
    q = np.flatnonzero(b[:-2] == 39)
    q = q[(c[q + 1] == _LETTER) & ((q == 0) | (c[q - 1] != 0))]
    if joined_space:
        q = q[(q == 0) | (b[q - 1] != 32)]
    one = np.isin(b[q + 1], [ord(x) for x in "stmd"])
    two = np.zeros(len(q), bool)
    for x, y in ("re", "ve", "ll"):
        two |= (b[q + 1] == ord(x)) & (b[q + 2] == ord(y))
    for found, k in ((q[one], 1), (q[two & ~one], 2)):
        start[found + 1] = False
        rest = found + 1 + k
        start[rest[c[rest] == _LETTER]] = True


def cut(texts: list[str], keep_space: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pieces, the piece at each place, and each text's number of pieces.

    With keep_space a piece takes one space before it and other white space makes pieces of its
    own; without, white space is dropped and each digit is a piece. The cut is made on the bytes:
    every byte of a character has the character's class.
    """
    joined = ("\0".join(texts) + "\0\0").encode()
    b = np.frombuffer(joined, dtype=np.uint8)
    c = np.frombuffer(bytearray(joined.translate(_ASCII)), dtype=np.uint8)
    lead = np.flatnonzero(b >= 0xC0)
    point = (b[lead] & np.uint8(31)).astype(np.int32) << 6 | b[lead + 1] & 63
    three = b[lead] >= 0xE0
    long = lead[three]
    point[three] = (b[long] & np.uint8(15)).astype(np.int32) << 12 | (b[long + 1] & np.uint8(63)).astype(np.int32) << 6 | b[long + 2] & 63
    kind = _CLASS[point]
    c[lead] = c[lead + 1] = kind
    c[long + 2] = kind[three]
    start = np.empty(len(b), bool)
    start[0] = True
    np.not_equal(c[1:], c[:-1], out=start[1:])
    start |= c == _END
    if keep_space:
        last = np.flatnonzero((c[:-1] == _SPACE) & start[1:] & (c[1:] != _END))
        start[last - (b[last] >= 0x80)] = True
        start[last[b[last] == 32] + 1] = False
    else:
        start |= c == _NUMBER
    _contractions(b, c, start, keep_space)
    start[lead + 1] = start[long + 2] = False
    at = np.flatnonzero(start)
    kind = c[at]
    offsets = np.r_[at, len(b)].astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
    real = kind != _END if keep_space else (kind != _END) & (kind != _SPACE)
    text = np.cumsum(kind == _END)[real]
    index = pieces.indices.to_numpy()[real]
    ends, data = np.frombuffer(pieces.dictionary.buffers()[1], dtype=np.int32)[: len(pieces.dictionary) + 1].tolist(), pieces.dictionary.buffers()[2].to_pybytes()
    return [data[i:j] for i, j in pairwise(ends)], index, np.bincount(text, minlength=len(texts) + 1)[: len(texts)]


def gather(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Concatenate the runs of flat (of the given sizes) in the order of index."""
    starts = np.cumsum(sizes) - sizes
    take = sizes[index]
    ends = np.cumsum(take)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - (ends - take), take)]


class PieceMemory:
    """Ids of pieces, each encoded when it is first met.

    encode_pieces maps new pieces to their ids, one after another, and each one's number of ids.
    At most `memory` pieces are remembered (then all are forgotten), which bounds a worker's
    memory and changes no result.
    """

    def __init__(self, encode_pieces: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], memory: int = 1 << 19):
        self.encode_pieces, self.memory = encode_pieces, memory
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, pieces: list[bytes], index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that consist of the pieces at index, and each text's number of ids."""
        if len(self.known) > self.memory:
            self._forget()
        used = np.zeros(len(pieces), bool)
        used[index] = True
        place = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        unknown = np.flatnonzero(used & (place < 0))
        if len(unknown):
            unknown = np.array(sorted(unknown.tolist(), key=pieces.__getitem__))  # like pieces after one another: the library finds their merges in the cache
            new = [pieces[i] for i in unknown.tolist()]
            ids, sizes = self.encode_pieces(new)
            place[unknown] = np.arange(len(self.starts), len(self.starts) + len(new))
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
            self.flat, self.sizes = np.r_[self.flat, ids], np.r_[self.sizes, sizes]
            self.known.update(zip(new, place[unknown].tolist(), strict=True))
        row = place[index]
        take = self.sizes[row]
        ends = np.r_[0, np.cumsum(take)]
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.starts[row] - ends[:-1], take)]
        return ids, np.diff(ends[np.r_[0, np.cumsum(counts)]])


class TextEncoder(PieceMemory):
    """Ids of whole texts as the library gives them with add_special_tokens=False; pieces go to encode_pieces, by default the library."""

    def __init__(self, path: str, keep_space: bool, encode_pieces: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]] | None = None, memory: int = 1 << 19, plain: bool = False):
        self.lib, self.keep_space = library(path, plain), keep_space
        self.speculates = encode_pieces is not None
        self.special = [] if plain else [t.content for t in self.lib.get_added_tokens_decoder().values()]
        super().__init__(encode_pieces or PieceLibrary(self.lib, keep_space), memory)

    def _fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._ids(*cut(texts if self.keep_space else [t.lower() for t in texts], self.keep_space))

    def _slow(self, text: str) -> np.ndarray:
        """A text outside the fast cut: the library cuts it and its pieces go the same way; with special tokens, or where nothing is speculated, the library does all."""
        if not self.speculates or any(s in text for s in self.special):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        cuts = self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text))
        pieces = [p.translate(_TO_LATIN).encode("latin-1") for p, _ in cuts]
        return self._ids(pieces, np.arange(len(pieces)), np.array([len(pieces)]))[0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids after one another, and each text's number of ids."""
        slow = {i for i, t in enumerate(texts) if "\0" in t or not t.isascii() and _OTHER.search(t) or any(s in t for s in self.special)}
        if not slow:
            return self._fast(texts) if texts else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        ids, counts = self._fast(["" if i in slow else t for i, t in enumerate(texts)])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i in slow:
            parts[i] = self._slow(texts[i])
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)


class PieceLibrary:
    """Ids of pieces by the library, many to a call.

    Pieces are joined to short texts that the library cuts at the same places again; the first or
    the last token of a piece is told by its string. Without keep_space pieces hold no white space,
    so they go, spelled in the byte alphabet, to the library's model past its normalizer and
    cutting, which they have behind them. Pieces for which that isn't so (white space,
    or no space before them where a space starts a piece) are encoded one by one, and so is a
    text that doesn't come back as so many pieces.
    """

    JOINED = 64

    def __init__(self, lib: Tokenizer, keep_space: bool):
        self.lib, self.keep_space = lib, keep_space
        names = [lib.id_to_token(i) or "" for i in range(lib.get_vocab_size(with_added_tokens=True))]
        self.model = lib if keep_space else Tokenizer(lib.model)
        if not keep_space:
            self.model.pre_tokenizer = WhitespaceSplit()
        self.edge = np.array([n.startswith("\u0120") if keep_space else n.endswith("</w>") for n in names])

    def __call__(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        together = [len(p) > 1 and p[0] == 32 and p[1] > 32 and not p.startswith((b" \xc2\x85", b" \xc2\xa0")) for p in pieces] if self.keep_space else [True] * len(pieces)
        joined = [i for i, t in enumerate(together) if t]
        alone = [i for i, t in enumerate(together) if not t]
        groups = [joined[k : k + self.JOINED] for k in range(0, len(joined), self.JOINED)]
        if self.keep_space:
            spelled = [b"".join([pieces[i] for i in g]).decode() for g in groups]
        else:
            both = _SPELLED[np.frombuffer(b"\n".join([b" ".join([pieces[i] for i in g]) for g in groups]), dtype=np.uint8)]
            spelled = both[both > 0].tobytes().decode().split("\n")
        runs: list[np.ndarray] = []
        sizes = np.zeros(len(pieces), np.int64)
        order: list[int] = []
        for own, e in zip(groups, self.model.encode_batch_fast(spelled if groups else [], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(own):
                alone += own
                continue
            sizes[own] = np.diff(np.r_[edges, len(ids)]) if self.keep_space else np.diff(np.r_[-1, edges])
            runs.append(ids)
            order += own
        for i, e in zip(alone, self.lib.encode_batch_fast([pieces[i].decode() for i in alone], add_special_tokens=False), strict=True):
            runs.append(np.array(e.ids, dtype=np.uint32))
            sizes[i] = len(runs[-1])
            order.append(i)
        if not order:
            return np.zeros(0, np.uint32), sizes
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return gather(np.concatenate(runs), sizes[order], back), sizes


_encoders: dict[tuple, TextEncoder] = {}


def encoder(path: str, keep_space: bool, make: Callable[[str], Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]] | None = None, plain: bool = False) -> TextEncoder:
    """One encoder for each file and worker process; it outlives a task."""
    name = (path, keep_space, make and make.__name__, plain)
    if name not in _encoders:
        _encoders[name] = TextEncoder(path, keep_space, make and make(path), plain=plain)
    return _encoders[name]
