"""Quality classifier: a weak-label model over heuristic labellers, whose posteriors train a hashed linear scorer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm.arrow import raw, slices
from quireflow.llm.substring import _BASE, _SPACE, _mix, _power
from quireflow.sources.scratch import materialize

#: Two tasks, each with labellers that vote 1 (bad), 0 (good) or abstain; a table of labels is one more labeller.
TASKS = ("junk", "toxic")
#: Insults, in two lists of which each makes a labeller; both abstain on texts that aren't English.
INSULTS = (
    ("idiot", "stupid", "scum", "trash", "worthless", "imbecile", "vermin", "dumbass"),
    ("moron", "loser", "pathetic", "disgusting", "clown", "filthy", "retard", "degenerate"),
)
_INSULT = [re.compile(rb"\b(?:" + b"|".join(w.encode() for w in words) + rb")s?\b") for words in INSULTS]
#: Weights of a task's scorer: hashed words and their first 5 and 7 bytes, and hashed levels of the text's statistics.
BITS = 20
_PREFIXES = (5, 7)
ABSTAIN = -1
#: Bytes of text that are described together; each takes several numbers a byte.
SLICE = 1 << 19

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*|!<>{}[]=~^_\\@+/"]] = True


def statistics(docs: list[bytes]) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, ...]]:
    """Ratios of each text that the labellers look at, and the words' bounds, hashes and owners."""
    data = np.frombuffer(b"\n".join([*docs, b""]), dtype=np.uint8)
    bounds = np.r_[0, np.cumsum([len(d) + 1 for d in docs])]
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(space & np.r_[False, ~space[:-1]])
    counts = np.diff(np.searchsorted(starts, bounds))
    lower = data + (_UPPER[data].astype(np.uint8) << 5)
    up, down = _power(len(data))
    total = np.r_[np.uint64(0), np.cumsum((lower + np.uint64(1)) * up[: len(data)], dtype=np.uint64)]
    hashes = _mix((total[ends] - total[starts]) * down[starts])
    owner = np.repeat(np.arange(len(docs)), counts)
    n_docs, words = len(docs), np.maximum(counts, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        inside = np.r_[0, np.cumsum(mask, dtype=np.int64)]
        return (inside[bounds[1:]] - inside[bounds[:-1]]) / np.maximum(np.diff(bounds) - 1, 1)

    odd = np.r_[0, np.cumsum(~_LETTER[data], dtype=np.int64)]
    marked = (odd[ends] - odd[starts]) >= 2
    twice = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])] if len(hashes) else np.zeros(0, bool)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])] if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    runs = np.diff(np.r_[first, len(h)])
    most = np.zeros(n_docs, dtype=np.int64)
    np.maximum.at(most, o[first], runs)
    stats = {
        "n_words": counts,
        "symbols": share(_SYMBOL[data]),
        "upper": share(_UPPER[data]),
        "marked": np.bincount(owner[marked], minlength=n_docs) / words,
        "adjacent": np.bincount(owner[twice], minlength=n_docs) / words,
        "distinct": np.bincount(o[first], minlength=n_docs) / words,
        "most": most / words,
    }
    kept = order[first]
    return stats, (starts[kept], ends[kept], hashes[kept], owner[kept], total, down)


#: Junk labellers: statistic, whether high values are bad, bound for a good vote, bound for a bad vote, words needed.
RULES = (
    ("symbols", True, 0.01, 0.05, 3),
    ("upper", True, 0.10, 0.30, 3),
    ("marked", True, 0.10, 0.40, 5),
    ("adjacent", True, 0.05, 0.20, 8),
    ("distinct", False, 0.40, 0.25, 40),
    ("most", True, 0.20, 0.35, 20),
)


def junk_votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """A column for each of RULES."""
    out = np.full((len(stats["n_words"]), len(RULES)), ABSTAIN, dtype=np.int8)
    for k, (name, high, good, bad, least) in enumerate(RULES):
        x, able = stats[name], stats["n_words"] >= least
        out[able & ((x < good) if high else (x > good)), k] = 0
        out[able & ((x > bad) if high else (x < bad)), k] = 1
    return out


def toxic_votes(docs: list[bytes], english: list[bool]) -> np.ndarray:
    """A column for each list of insults and one for how many there are; they abstain on other languages."""
    out = np.full((len(docs), 3), ABSTAIN, dtype=np.int8)
    for i, (text, speaks) in enumerate(zip(docs, english, strict=True)):
        if speaks:
            text = text.lower()
            n = [len(p.findall(text)) for p in _INSULT]
            out[i] = (n[0] > 0, n[1] > 0, 1 if sum(n) >= 2 else 0 if sum(n) == 0 else ABSTAIN)
    return out


def weak_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Chance that each vote pattern means bad, and each labeller's accuracy, by expectation-maximisation.

    Labellers are taken as independent given the class; how often each is right in either class
    is estimated along with the classes' shares. Abstaining says nothing (it follows the
    language, not the class). Starts from the votes' mean.
    """
    said = patterns != ABSTAIN
    bad = np.where(said.any(axis=1), (patterns == 1).sum(axis=1) / np.maximum(said.sum(axis=1), 1), 0.1)
    bad = np.clip(bad, 0.02, 0.98)
    n = np.maximum(counts, 0).astype(float)
    votes = np.stack([patterns == v for v in (0, 1)])
    for _ in range(rounds):
        weight = np.stack([(1 - bad) * n, bad * n])
        share = (weight.sum(axis=1) + 1) / (n.sum() + 2)
        table = np.einsum("yp,vpl->ylv", weight, votes) + np.array([[9.0, 1.0], [1.0, 9.0]])[:, None, :]  # a weak belief that votes are mostly right
        table /= table.sum(axis=2, keepdims=True)
        logp = np.log(share)[:, None] + np.einsum("ylv,vpl->yp", np.log(table), votes.astype(float))
        now = 1 / (1 + np.exp(np.clip(logp[0] - logp[1], -50, 50)))
        if np.abs(now - bad).max() < 1e-6:
            break
        bad = now
    right = (np.einsum("p,pl->l", n * bad, patterns == 1) + np.einsum("p,pl->l", n * (1 - bad), patterns == 0)) / np.maximum(np.einsum("p,pl->l", n, said), 1e-9)
    return bad, right


def features(stats: dict[str, np.ndarray], words: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, ordered by text, and how many each text has."""
    starts, ends, hashes, owner, total, down = words
    parts, owners = [hashes], [owner]
    for k in _PREFIXES:
        long = ends - starts > k
        s = starts[long]
        parts.append(_mix((total[s + k] - total[s]) * down[s] + np.uint64(k)))
        owners.append(owner[long])
    n = len(stats["n_words"])
    for j, (name, values) in enumerate(stats.items()):
        level = np.minimum(np.log2(values + 1), 15).astype(np.int64) if name == "n_words" else np.minimum((values * 20).astype(np.int64), 20)
        parts.append(_mix((level + 1000 * (j + 1)).astype(np.uint64) * np.uint64(_BASE)))
        owners.append(np.arange(n))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(parts)[order] >> np.uint64(64 - BITS)).astype(np.int64), np.bincount(owner, minlength=n)


def margins(weights: np.ndarray, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's weights; the last weight is the bias."""
    ends = np.r_[0.0, np.cumsum(weights[index], dtype=np.float64)]
    at = np.r_[0, np.cumsum(counts)]
    return ends[at[1:]] - ends[at[:-1]] + weights[-1]


def train(index: np.ndarray, at: np.ndarray, used: np.ndarray, target: np.ndarray, epochs: int = 6, rate: float = 0.15, batch: int = 32) -> np.ndarray:
    """Logistic regression on soft targets by AdaGrad; rows come in a fixed pseudo-random order. Row r has index[at[r]:at[r + 1]]; the rows in `used` train."""
    weights, grown = np.zeros((1 << BITS) + 1), np.full((1 << BITS) + 1, 1e-2)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(used))
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            own = used[rows]
            idx = np.concatenate([index[at[r] : at[r + 1]] for r in own])
            n = at[own + 1] - at[own]
            p = 1 / (1 + np.exp(-np.clip(margins(weights, idx, n), -30, 30)))
            error = p - target[rows]
            g = np.repeat(error, n)
            cell, back = np.unique(idx, return_inverse=True)
            step = np.bincount(back, weights=g)
            grown[cell] += step**2
            weights[cell] -= rate * step / np.sqrt(grown[cell])
            grown[-1] += error.sum() ** 2
            weights[-1] -= rate * error.sum() / np.sqrt(grown[-1])
    return weights.astype(np.float32)


def score_quality(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 30_000, seed: int = 11) -> DataFrame:
    """key, weak_junk, weak_toxic (posteriors), p_junk, p_toxic (scorer) and kept of every row.

    1. Labellers vote on every text. labels (key, quality, toxic), if given, adds one labeller to
       each task; it abstains where it has no row.
    2. Vote patterns are counted (at most 3**7 of them, whatever the corpus) and the weak-label
       model runs on these counts.
    3. About `sample` rows (a bound, by hash of key and text) with a vote train a linear scorer for
       each task on their posteriors; rows that repeat key and text count once; where every
       labeller of a task abstains, a row isn't used. For this task size one Python task suffices.
    4. All texts are scored whole. kept: neither chance exceeds one half.

    Null and empty texts have no votes and are scored by their statistics alone; null keys have no
    label; of repeated label rows the worst counts. A missing lang column counts as English.
    An empty table gives an empty result. Columns of docs beside key, text and lang are not used.
    """
    spark = docs.sparkSession
    speaks = F.coalesce(F.col(lang), F.lit("en")) == "en" if lang in docs.columns else F.lit(True)
    src = docs.select(F.col(key).alias("__key"), F.xxhash64(key, text).alias("__id"), F.col(text).alias("__text"), speaks.alias("__english"))
    kind = src.schema["__key"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lambda votes: pa.array(["".join("a01"[v + 1] for v in row) for row in votes.tolist()])
        for batch in slices(batches, "__text", SLICE):
            own = raw(batch, "__text")
            stats, _ = statistics(own)
            cols = [batch.column("__key"), batch.column("__id"), code(junk_votes(stats)), code(toxic_votes(own, batch.column("__english").to_pylist()))]
            yield pa.RecordBatch.from_arrays(cols, names=["__key", "__id", "junk", "toxic"])

    votes = src.mapInArrow(vote, f"__key {kind}, __id long, junk string, toxic string")
    if labels is not None:
        gold = labels.groupBy(F.col(key).alias("__key")).agg((1 - F.min("quality")).alias("g_junk"), F.max("toxic").alias("g_toxic"))
        votes = votes.join(gold, "__key", "left")
        for task in TASKS:
            votes = votes.withColumn(task, F.concat(task, F.coalesce(F.col(f"g_{task}").cast("int").cast("string"), F.lit("a"))))
    votes = materialize(votes.select("__id", *TASKS), "votes")
    total = votes.count()
    for task in TASKS:
        rows = votes.groupBy(task).count().collect()
        patterns = np.array([["a01".index(c) - 1 for c in r[task]] for r in rows] or np.zeros((0, 1)))
        bad, _ = weak_label_model(patterns, np.array([r["count"] for r in rows])) if rows else (np.zeros(0), None)
        spoke = [bool((p != ABSTAIN).any()) for p in patterns]
        values = ", ".join(f"('{r[task]}', {b!r}D, {str(s).lower()})" for r, b, s in zip(rows, bad.tolist(), spoke, strict=True)) or "('', 0.0D, false)"
        votes = votes.join(F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS p({task}, weak_{task}, spoke_{task})")), task, "left")
    share = min(1.0, sample / max(total, 1))
    drawn = F.pmod(F.xxhash64(F.lit(seed), "__id"), F.lit(1 << 32)) < int(share * (1 << 32))
    chosen = votes.where(drawn & (F.col("spoke_junk") | F.col("spoke_toxic")))
    chosen = chosen.groupBy("__id").agg(*(F.max(f"{p}_{t}").alias(f"{p}_{t}") for p in ("weak", "spoke") for t in TASKS))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE):
            index, counts = features(*statistics(raw(batch, "__text")))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(index.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, *(batch.column(c) for c in kept)], names=["index", *kept])

    kept = [f"{p}_{t}" for t in TASKS for p in ("weak", "spoke")]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sizes, marks = [], [], []
        for batch in batches:  # kept as arrays, once
            lists = batch.column("index")
            parts.append(lists.flatten().to_numpy().copy())
            sizes.append(np.diff(lists.offsets.to_numpy()))
            marks.append(batch.select(kept))
        if not parts:
            return
        index, at, rows = np.concatenate(parts), np.r_[0, np.cumsum(np.concatenate(sizes))], pa.Table.from_batches(marks)
        parts.clear()
        for task in TASKS:
            used = np.flatnonzero(rows.column(f"spoke_{task}").to_numpy(zero_copy_only=False))
            weights = train(index, at, used, rows.column(f"weak_{task}").to_numpy()[used])
            yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([weights.tobytes()])], names=["task", "weights"])

    sampled = src.where(drawn).dropDuplicates(["__id"]).join(chosen, "__id").select("__text", *kept)
    described = materialize(sampled.mapInArrow(describe, "index array<int>, weak_junk double, spoke_junk boolean, weak_toxic double, spoke_toxic boolean"), "sample")
    trained = {r["task"]: np.frombuffer(r["weights"], np.float32) for r in described.coalesce(1).mapInArrow(fit, "task string, weights binary").collect()}
    scorers = spark.sparkContext.broadcast([trained.get(t, np.zeros((1 << BITS) + 1, np.float32)) for t in TASKS])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE):
            index, counts = features(*statistics(raw(batch, "__text")))
            chances = [1 / (1 + np.exp(-np.clip(margins(w, index, counts), -30, 30))) for w in scorers.value]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__id"), *map(pa.array, chances)], names=["__key", "__id", "p_junk", "p_toxic"])

    scored = src.mapInArrow(score, f"__key {kind}, __id long, p_junk double, p_toxic double")
    weak = votes.groupBy("__id").agg(F.max("weak_junk").alias("weak_junk"), F.max("weak_toxic").alias("weak_toxic"))
    out = scored.join(weak, "__id", "left")
    good = (F.col("p_junk") <= 0.5) & (F.col("p_toxic") <= 0.5)
    return out.select(F.col("__key").alias(key), "weak_junk", "weak_toxic", "p_junk", "p_toxic", good.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that score_quality keeps, with their columns; rows that repeat a key share its worst score."""
    bad = score_quality(docs, labels, key, text).where(~F.col("kept")).select(F.col(key).alias("__bad")).distinct()
    return docs.join(bad, docs[key].eqNullSafe(bad["__bad"]), "left_anti")
