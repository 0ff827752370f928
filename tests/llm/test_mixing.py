"""Mixing against a plain sequential mix, the contract's bounds, and the law of the weighted sample."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from quireflow.llm import mixing, queries

_rng = random.Random(13)


def rows(n=300):
    made = [(None, "no key at all", "a"), (None, "no key at all", "a"), (7, None, None), (7, "", None), (8, "x" * 400, ""), (9, " \t\n\x0b words\xa0joined ", None)]
    for k in range(n):
        source = "hot" if k % 2 else _rng.choice(["a", "b", "é", "日", None, "z"])
        made.append((k, " ".join(_rng.choice(("word", "Zahl", "12", "...", "é")) for _ in range(_rng.randrange(60))), source))
    return [*made, (500, "tiny", "small"), (501, "", "void"), (502, " ".join(["long"] * 3000), "hot")]


def plain(data, weights, share, most, seed):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = defaultdict(int)
    for _, t, s in data:
        totals[s] += size(t)
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(totals.values()), set()
    while True:
        left = Fraction(*share) * total - sum(most * totals[s] for s in held)
        target = {s: Fraction(most * totals[s]) if s in held else left * w[s] / sum(w[x] for x in order if x not in held) for s in order}
        above = {s for s in order if target[s] > most * totals[s]}
        if not above:
            break
        held |= above
    taken = {}
    for s in order:
        words = int(target[s])
        epochs = words // totals[s] if totals[s] else 0
        room, drawn = words - epochs * totals[s], []
        for k, t, x in data:
            if x == s:
                n, u = size(t), (int(hashlib.md5(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                letters = sum(ch.isalpha() for ch in t or "") / len(t) if t else 0.0
                drawn.append((-math.log(u) / ((0.1 + 0.9 * letters) * (0.25 + 0.75 * min(1.0, n / 50))), k is not None, k or 0, n))
        for _, has, k, n in sorted(drawn):
            part = max(0, min(room, n))
            room -= n
            taken.setdefault((k if has else None, s), []).append((n, totals[s], float(target[s]), epochs * n + part))
    return Counter((k, s, *v) for (k, s), vs in taken.items() for v in vs)


def frame(spark, data):
    return spark.createDataFrame([(*r, "mine", "mine") for r in data], "doc_id long, text string, source string, size string, target string").repartition(5)


def found(df):
    return Counter((r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in df.collect())


def test_mix_sources(spark):
    data = rows()
    for weights, share, most in (((5, 2, 1), (3, 2), 2), ((1, 3), (1, 2), 3), ((1,), (5, 1), 4)):
        got = found(mixing.mix_sources(frame(spark, data), weights, share, most))
        assert got == plain(data, weights, share, most, 13)
        for (k, s, size, whole, target, taken), _ in got.items():
            assert taken <= most * size and target <= most * whole, (k, s)
    assert mixing.mix_sources(frame(spark, data).limit(0)).collect() == []


def test_all_empty_texts(spark):
    got = mixing.mix_sources(frame(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert {(r.doc_id, r.target, r.taken) for r in got} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_given_weights_decide(spark):
    """Rows of weight w come first in proportion to w: with two rows the heavier one is taken with chance w / (w + 1); none without weight."""
    docs = spark.range(6000).select((F.col("id") * 3).alias("doc_id"), F.lit("one").alias("text"), F.concat(F.lit("s"), (F.col("id") % 3000).cast("string")).alias("source"), F.when(F.col("id") < 3000, 4.0).otherwise(1.0).alias("w"))
    got = mixing.mix_sources(docs, (1,), (1, 2), 2, quality=F.col("w")).groupBy((F.col("doc_id") < 9000).alias("heavy")).agg(F.sum("taken")).collect()
    heavy = dict(map(tuple, got))
    assert sum(heavy.values()) == 3000 and abs(heavy[True] / 3000 - 0.8) < 5 * np.sqrt(0.16 / 3000)
    odd = spark.createDataFrame([(1, "one", "s", None), (2, "one", "s", -1.0), (3, "one", "s", float("nan")), (4, "one", "s", 0.01)], "doc_id long, text string, source string, w double")
    assert [r.doc_id for r in mixing.mix_sources(odd, (1,), (1, 4), 2, quality=F.col("w")).where("taken > 0").collect()] == [4]


def test_op13(spark, tmp_path):
    data = rows()
    spark.createDataFrame([(k, t, "en", s, 0) for k, t, s in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert found(queries.op13_mixing(spark, str(tmp_path))) == plain(data, (5, 2, 1), (3, 2), 2, 13)
