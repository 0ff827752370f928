"""Phrase collocations from a weighted de Bruijn graph: four-word edges between three-word nodes, unary paths compacted, shorter counts by flow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.llm.arrow import raw, slices
from quireflow.llm.substring import span_hashes
from quireflow.sources.scratch import materialize

#: Bytes of text that are counted together before they are sent; a longer text is alone.
SLICE = 1 << 20
#: Most bits of the map of frequent pairs of words (16 MB), whatever the size of the corpus.
MOST_BITS = 27
_END, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_END[[ord(ch) for ch in ".,;:!?"] + [*range(0x0A, 0x0E)]] = True
_SPACE[[0x20, 0x09]] = True
_BLANK = bytes(0x20 if _END[b] or _SPACE[b] else b for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 18


class Words:
    """The words of a slice of texts: where each stands in `flat` (words with one space between), whether the next follows in its piece, its text, and a hash of language and word."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        data = b"\n".join([*texts, b""]).translate(_LOWER)
        b = np.frombuffer(data, dtype=np.uint8)
        end = _END[b]
        inner = ~(end | _SPACE[b])
        starts = np.flatnonzero(inner & np.r_[True, ~inner[:-1]])
        ends = np.flatnonzero(~inner & np.r_[False, inner[:-1]])
        piece = np.cumsum(end)[starts] if len(starts) else starts
        self.joined = np.r_[piece[1:] == piece[:-1], False][: len(starts)]
        bounds = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
        self.doc = np.searchsorted(bounds, starts, side="right") - 1
        keep = inner.copy()
        keep[ends] = True
        flat = np.frombuffer(data.translate(_BLANK), dtype=np.uint8)[keep]
        sizes = ends - starts + 1
        self.to = np.cumsum(sizes) - 1
        self.at = self.to - sizes + 1
        self.flat = flat.tobytes()
        self.langs = langs
        self.lang = pc.index_in(pa.array(langs), pc.unique(pa.array(langs))).to_numpy(zero_copy_only=False).astype(np.int64) if langs else np.zeros(0, np.int64)
        seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs] or [0], dtype=np.uint64)
        self.hash = (span_hashes(flat, self.at, self.to) * np.uint64(0x9E3779B97F4A7C15) ^ seeds[self.doc]) >> np.uint64(32)

    def ids(self) -> np.ndarray:
        """A number for each word, equal for equal words of a language."""
        offsets = pa.py_buffer(np.r_[self.at, len(self.flat)].astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(self.at), [None, offsets, pa.py_buffer(self.flat)]).dictionary_encode()
        return _ranks(self.lang[self.doc], words.indices.to_numpy().astype(np.int64))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that another follows, and a key of each such pair: 32 bits for each word."""
        at = np.flatnonzero(self.joined)
        return at, (self.hash[at] << np.uint64(32) | self.hash[at + 1]).astype(np.int64)


def _slot(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64)


def _bit(data: bytes, slot: np.ndarray) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    return (b[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in slices(batches, "text", SLICE):
        yield Words(raw(batch, "text"), batch.column("lang").to_pylist())


def frequent_pairs(src: DataFrame, least: int) -> tuple[Broadcast, Broadcast, int]:
    """Bit maps that hold every pair of words counted `least` times, and every word of such a pair, and their bits.

    Pairs are counted by hashes; a shared hash or bit only lets more pairs pass. The maps have
    about 32 bits for each frequent pair, but at most 2**MOST_BITS: beyond it more pass, and more
    edges are sent than needed, but none is missing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _words(batches):
            key, n = np.unique(w.pairs()[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    counted = src.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    often = materialize(counted.where(F.col("n") >= least).select("pair"), "often")
    bits = min(max((32 * often.count()).bit_length(), 16), MOST_BITS)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("pair").to_numpy().astype(np.uint64)
            both = np.r_[_slot(key, bits), (1 << bits) + np.unique(_slot(np.r_[key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)], bits))]
            yield pa.RecordBatch.from_arrays([pa.array(both // _CHUNK), pa.array(both % _CHUNK)], names=["chunk", "slot"])

    def chunk_bits(rows: pa.Table) -> pa.Table:
        on = np.zeros(_CHUNK, np.uint8)
        on[rows.column("slot").to_numpy()] = 1
        return pa.table([rows.column("chunk").slice(0, 1), pa.array([np.packbits(on, bitorder="little").tobytes()])], names=["chunk", "bits"])

    chunks = often.mapInArrow(slots, "chunk long, slot long").distinct().groupBy("chunk").applyInArrow(chunk_bits, "chunk long, bits binary")
    size = (1 << bits) >> 3
    whole = bytearray(max(2 * size, _CHUNK >> 3))
    for row in chunks.toLocalIterator():  # 2**(MOST_BITS - 2) bytes at most
        whole[row["chunk"] * (_CHUNK >> 3) : (row["chunk"] + 1) * (_CHUNK >> 3)] = row["bits"]
    sc = src.sparkSession.sparkContext
    return sc.broadcast(bytes(whole[:size])), sc.broadcast(bytes(whole[size : 2 * size])), bits


def graph_rows(src: DataFrame, pairs: Broadcast, members: Broadcast, bits: int) -> DataFrame:
    """lang, gram, k (words of the gram), n: four-word edges, and the last three, two and one words of every chain; k 0 counts all words.

    A chain is a run of words of a piece whose neighbours are frequent pairs, so that every
    frequent phrase lies within chains. Single words that are in no frequent pair are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _words(batches):
            at, key = w.pairs()
            chained = np.zeros(len(w.at), bool)
            chained[at[_bit(pairs.value, _slot(key, bits))]] = True
            lang, grams, ks, ns = [], [], [], []
            total = np.bincount(w.lang[w.doc], minlength=int(w.lang.max()) + 1 if len(w.lang) else 0)
            first = {int(k): w.langs[i] for i, k in reversed([*enumerate(w.lang.tolist())])}
            for k, n in enumerate(total.tolist()):
                lang, grams, ks, ns = [*lang, first[k]], [*grams, b""], [*ks, 0], [*ns, n]
            tail = np.flatnonzero(~chained)  # the last word of each chain
            run_of = np.arange(len(chained)) - np.r_[-1, tail][np.searchsorted(tail, np.arange(len(chained)))]  # words of the chain up to here
            word = w.ids()
            pair = _ranks(word[:-1], word[1:])
            edges = np.flatnonzero(run_of >= 4) - 3
            by_length = [(4, edges, pair[edges] << 32 | pair[edges + 2])]
            for k in (3, 2, 1):
                own = tail[run_of[tail] >= k] - (k - 1)
                if k == 1:
                    own = own[_bit(members.value, _slot(w.hash[own], bits))]
                code = pair[own] << 32 | word[own + 2] if k == 3 else pair[own] if k == 2 else word[own]
                by_length.append((k, own, code))
            for k, own, code in by_length:
                _, where, n = np.unique(code, return_index=True, return_counts=True)
                place = own[where]
                grams += [w.flat[i:j] for i, j in zip(w.at[place].tolist(), w.to[place + k - 1].tolist(), strict=True)]
                lang += [w.langs[d] for d in w.doc[place].tolist()]
                ks += [k] * len(n)
                ns += n.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(grams, pa.binary()).cast(pa.string()), pa.array(ks, pa.int32()), pa.array(ns, pa.int64())], names=["lang", "gram", "k", "n"])

    return src.mapInArrow(run, "lang string, gram string, k int, n long").groupBy("lang", "gram", "k").agg(F.sum("n").alias("n"))


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers below 2**31, equal for equal pairs; both are below the count of rows."""
    return np.unique(a << 31 | b, return_inverse=True)[1].astype(np.int64)


def _head(gram: str, k: int) -> Column:
    return F.substring_index(gram, " ", k)


def _rest(gram: str) -> Column:
    """The gram without its first word."""
    return F.expr(f"substring({gram}, instr({gram}, ' ') + 1)")


def nodes_of(rows: DataFrame, least: int) -> DataFrame:
    """lang, node (three words), flow (its count), linked (an edge of `least` or more enters or leaves), and, if it is unary, the only edges in and out.

    What leaves a node is its edges and the chains that end in it. A node is unary if one frequent
    edge enters, one leaves, they count the same, and nothing else leaves: so all that enters goes on.
    """
    edges = rows.where("k = 4")
    often = F.col("n") >= least
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    leave = edges.select("lang", _head("gram", 3).alias("node"), F.col("n").alias("flow"), F.when(often, F.col("gram")).alias("out"), F.when(often, F.col("n")).otherwise(0).alias("out_n"), none.alias("into"), zero.alias("in_n"))
    enter = edges.where(often).select("lang", _rest("gram").alias("node"), zero.alias("flow"), none.alias("out"), zero.alias("out_n"), F.col("gram").alias("into"), F.col("n").alias("in_n"))
    ends = rows.where("k = 3").select("lang", F.col("gram").alias("node"), F.col("n").alias("flow"), none.alias("out"), zero.alias("out_n"), none.alias("into"), zero.alias("in_n"))
    summed = leave.unionByName(enter).unionByName(ends).groupBy("lang", "node").agg(
        F.sum("flow").alias("flow"), F.sum("out_n").alias("out_n"), F.sum("in_n").alias("in_n"), F.count("out").alias("n_out"), F.count("into").alias("n_in"), F.max("out").alias("out"), F.max("into").alias("into")
    )
    unary = (F.col("n_in") == 1) & (F.col("n_out") == 1) & (F.col("in_n") == F.col("out_n")) & (F.col("out_n") == F.col("flow"))
    return summed.select("lang", "node", "flow", *(F.when(unary, F.col(c)).alias(c) for c in ("into", "out")))


def compact_paths(rows: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """lang, path (words), n, head_flow, tail_flow: frequent edges, joined to one row along unary nodes.

    All edges of a path count n, and so do its inner nodes; head_flow and tail_flow count its first
    and last three words. Pointers to the edge before are doubled until they reach a path's head:
    rounds grow with the logarithm of the longest path. No path closes on itself, as chains end.
    """
    links = materialize(nodes.where(F.col("out").isNotNull()).select("lang", F.col("out").alias("gram"), F.col("into").alias("head"), F.lit(1).cast("long").alias("steps")), "links")
    while True:
        ahead = links.select("lang", F.col("gram").alias("head"), F.col("head").alias("__head"), F.col("steps").alias("__steps"))
        moved = links.join(ahead, ["lang", "head"], "left")
        links = materialize(
            moved.select("lang", "gram", F.coalesce("__head", "head").alias("head"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), F.col("__head").isNotNull().alias("open")), "links"
        )
        if not links.agg(F.max("open")).first()[0]:
            break
    edges = rows.where((F.col("k") == 4) & (F.col("n") >= least)).join(links, ["lang", "gram"], "left")
    placed = edges.select("lang", F.coalesce("head", "gram").alias("head"), F.coalesce("steps", F.lit(0)).alias("steps"), F.substring_index("gram", " ", -1).alias("word"), "gram", "n")
    paths = placed.groupBy("lang", "head").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("steps", "word"))).alias("tail"), F.max(F.struct("steps", "gram"))["gram"].alias("last"))
    words = F.concat(F.split("head", " "), F.transform(F.slice("tail", 2, 1 << 30), lambda t: t["word"]))
    ends = [nodes.select("lang", F.col("node").alias(f"__{side}"), F.col("flow").alias(f"{side}_flow")) for side in ("head", "tail")]
    found = paths.select("lang", words.alias("path"), "n", _head("head", 3).alias("__head"), _rest("last").alias("__tail"))
    return found.join(ends[0], ["lang", "__head"]).join(ends[1], ["lang", "__tail"]).select("lang", "path", "n", "head_flow", "tail_flow")


def _scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates (lang, m words, phrase, a, head_flow, tail_flow) with l, r and score of their lowest cut; counts: lang, gram, f of one and two words."""
    last = F.substring_index("phrase", " ", -1)
    sides = F.array(
        F.struct(F.lit(1).alias("side"), _head("phrase", 1).alias("gram")),
        F.struct(F.lit(2).alias("side"), last.alias("gram")),
        F.when(F.col("m") > 2, F.struct(F.lit(3).alias("side"), _head("phrase", 2).alias("gram"))),
        F.when(F.col("m") > 2, F.struct(F.lit(4).alias("side"), F.substring_index("phrase", " ", -2).alias("gram"))),
    )
    keys = ["lang", "phrase", "m", "a", "head_flow", "tail_flow"]
    asked = found.select(*keys, F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s")).select(*keys, "s.*")
    got = asked.join(counts, ["lang", "gram"]).groupBy(*keys).agg(*(F.max(F.when(F.col("side") == s, F.col("f"))).alias(c) for s, c in enumerate(("head1", "tail1", "head2", "tail2"), 1)))

    def cut(k: int, left: str, right: str) -> Column:
        whole = F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(8,0)")
        score = F.call_function("div", whole, (F.col(left) + F.col(right)).cast("decimal(20,0)"))
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    lowest = (
        F.when(F.col("m") == 2, cut(1, "head1", "tail1"))
        .when(F.col("m") == 3, F.least(cut(1, "head1", "tail2"), cut(2, "head2", "tail1")))
        .otherwise(F.least(cut(1, "head1", "tail_flow"), cut(2, "head2", "tail2"), cut(3, "head_flow", "tail1")))
    )
    return got.select("lang", "phrase", "a", lowest.alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, covered: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """The best `top` phrases of two to four words of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut to pieces at [.,;:!?] and line ends and to words at spaces and tabs.
    a counts a phrase within pieces, l and r the two parts of the cut with the lowest score
    floor(2000000 a / (l + r)), n all words of the language. Phrases counted under `least` aren't
    candidates; a candidate in a longer one that counts `covered` percent of it or more is dropped.

    Four-word edges are added up over the corpus and with them the ends of chains (runs of
    frequent pairs within a piece). Three-word nodes count what leaves them: edges and ends; two
    words count their nodes and ends, and single words likewise. Edges along unary nodes become
    paths, whose windows are the longest candidates; the inner nodes of a path are dropped
    unscored, as a longer candidate counts the same. All is counted over whole texts and exact; the bit
    maps of frequent pairs are bounded and only spare work.

    Null texts are empty, null languages are `und`, and rows count one by one. A very long text is
    one slice. Products are decimals of 38 digits. An empty table gives an empty result; further
    columns aren't carried.
    """
    src = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pairs, members, bits = frequent_pairs(src, least)
    rows = materialize(graph_rows(src, pairs, members, bits), "edges")
    nodes = materialize(nodes_of(rows, least), "nodes")
    flows = nodes.select("lang", _head("node", 2).alias("gram"), F.col("flow").alias("n")).unionByName(rows.where("k = 2").select("lang", "gram", "n"))
    two = materialize(flows.groupBy("lang", "gram").agg(F.sum("n").alias("f")), "pairs")
    flows = two.select("lang", _head("gram", 1).alias("gram"), F.col("f").alias("n")).unionByName(rows.where("k = 1").select("lang", "gram", "n"))
    one = flows.groupBy("lang", "gram").agg(F.sum("n").alias("f"))
    counts = materialize(one.unionByName(two).where(F.col("f") >= least), "counts")
    paths = materialize(compact_paths(rows, nodes, least), "paths")
    at = paths.select("lang", "path", "n", "head_flow", "tail_flow", F.explode(F.sequence(F.lit(1), F.size("path") - 3)).alias("i"))
    inner = lambda side, edge: F.when(F.col("i") == edge, F.col(side)).otherwise(F.col("n")).alias(side)
    four = at.select("lang", F.array_join(F.slice("path", F.col("i"), F.lit(4)), " ").alias("phrase"), F.lit(4).alias("m"), F.col("n").alias("a"), inner("head_flow", F.lit(1)), inner("tail_flow", F.size("path") - 3))
    blank = [F.lit(None).cast("long").alias(c) for c in ("head_flow", "tail_flow")]
    three = nodes.where((F.col("flow") >= least) & F.col("out").isNull()).select("lang", F.col("node").alias("phrase"), F.lit(3).alias("m"), F.col("flow").alias("a"), *blank)
    pair = two.where(F.col("f") >= least).select("lang", F.col("gram").alias("phrase"), F.lit(2).alias("m"), F.col("f").alias("a"), *blank)
    candidates = materialize(four.unionByName(three).unionByName(pair), "candidates")
    word = F.split("phrase", " ")
    runs = lambda k: F.transform(F.sequence(F.lit(1), F.col("m") - k + 1), lambda i: F.array_join(F.slice(word, i, F.lit(k)), " "))
    within = candidates.where("m > 2").select("lang", F.explode(F.when(F.col("m") == 4, F.concat(runs(2), runs(3))).otherwise(runs(2))).alias("phrase"), F.col("a").alias("longer"))
    most = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))).drop("longer")
    sizes = rows.where("k = 0").select("lang", "n")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = _scored(kept, counts).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
