"""Literal cases of the operators."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quireflow.functions import text as X
from quireflow.operators import ranking as R
from quireflow.operators import titles as T
from quireflow.operators.components import connected_components
from quireflow.operators.shared_grams import shared_grams
from quireflow.plans import forensics
from quireflow.operators.hashes import hamming_join
from quireflow.plans.corpus import digit_run, sentiment
from quireflow.streaming import flows


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_normalize_and_runs(spark):
    r = one(spark, X.normalize(F.lit("Hello, World!  F1=84.6%")).alias("n"), X.word_runs(F.split(F.lit("a b c d e f"), " "), 3).alias("r"), X.word_runs(F.split(F.lit("a b c d"), " "), 5).alias("none"))
    assert (r.n, r.r, r.none) == ("hello world f1 84 6", ["a b c", "b c d", "c d e", "d e f"], [])


def test_jaccard(spark):
    s = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    r = one(spark, X.jaccard(s("a", "b"), s("b", "c")).alias("a"), X.jaccard(s(), s("a")).alias("b"), X.jaccard(s("a"), s("a")).alias("c"))
    assert (round(r.a, 6), r.b, r.c) == (0.333333, 0.0, 1.0)


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, X.cosine(v(1.0, 2.0), v(1.0, 2.0)).alias("a"), X.cosine(v(1.0, 0.0), v(0.0, 1.0)).alias("b"), X.cosine(v(1.0), v(-1.0)).alias("c"), X.cosine(v(1.0), v(1.0, 1.0)).alias("d"))
    assert [round(x, 9) for x in r] == [1, 0, -1, 0]


@pytest.mark.parametrize(("mean", "n", "ok"), [("4.56", 30, False), ("0.333", 3, True), ("0.35", 3, False), ("33.2", 24, True), ("1.5", 2, True), ("24.5", 9, False), ("33.20", 24, False), ("3", 4, True), ("0.000", 30, True)])
def test_grim(spark, mean, n, ok):
    assert one(spark, forensics.grim(F.lit(mean), F.lit(n)).alias("x")).x is ok


@pytest.mark.parametrize(("text", "least", "found"), [("xx1234567yy", 6, True), ("98765", 5, False), ("8901234", 6, True), ("170603762", 6, False), ("12345", 6, False)])
def test_digit_run(spark, text, least, found):
    assert one(spark, digit_run(F.lit(text), least).alias("x")).x is found


def test_rank_fusion_keeps_members_of_one_list(spark):
    lists = [spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(x)], "query_id int, doc_id string, rank int") for x in (["a", "b", "c"], ["b", "c", "d"])]
    got = R.rrf(lists, 10).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["b", "c", "a", "d"]
    assert sorted((r.rrf for r in got), reverse=True) == [r.rrf for r in got]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (None, 3)] + [(100 + i, 101 + i) for i in range(40)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)}


@pytest.mark.parametrize("most", [0, 3, 10, 14])
def test_hamming_join_is_exact(spark, most):
    """All pairs of hashes that differ in 0 to 20 bits of a few bases, with one to three variants, copies and both ends of the range."""
    rng = random.Random(most)
    bases = [0, -1, *(rng.getrandbits(64) - (1 << 63) for _ in range(6))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near = lambda: signed((rng.choice(bases) ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(21)))) & ((1 << 64) - 1))
    rows = [(k, [near() for _ in range(rng.randrange(1, 4))]) for k in range(60)]
    rows += [(60 + k, h) for k, (_, h) in enumerate(rows[:5])]
    left, right = spark.createDataFrame(rows, "a long, ha array<long>"), spark.createDataFrame(rows, "b long, hb array<long>")
    least = lambda x, y: min(((p ^ q) & ((1 << 64) - 1)).bit_count() for p in x for q in y)
    want = {(a, b, least(x, y)) for a, x in rows for b, y in rows if a != b and least(x, y) <= most}
    assert {tuple(r) for r in hamming_join(left, right, most).collect()} == want and len(want) >= 10


def test_sentiment(spark):
    r = sentiment(spark.createDataFrame([("a novel and robust idea, poor data",), ("nothing",)], "t string")).orderBy("score").collect()
    assert [(x.score, x.label) for x in r] == [(0.0, "neutral"), (0.3333, "positive")]


def test_debounce_follows_the_last_accepted_event(spark):
    e = spark.createDataFrame([(i, 1, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 6, 12, 18))], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.event_id for r in flows.debounce(e, 10).orderBy("event_id").collect()] == [0, 2]


def test_token_bucket_starts_full(spark):
    e = spark.createDataFrame([(i, 1, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate((0, 1, 2, 40))], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r.allowed for r in flows.token_bucket(e, 2.0).orderBy("event_id").collect()] == [True, True, False, True]


def test_streams_with_state_agree_with_their_batch_twins(spark):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = flows.stream_of(spark, sf, "events")
    for run in (lambda e: flows.debounce(e, 3600), lambda e: flows.token_bucket(e, 1.0)):
        assert sorted(run(stream).collect()) == sorted(run(events).collect())


def test_block_ratio_is_the_known_one():
    """Against the standard library's ratio on random texts, also long ones."""
    rng = random.Random(14)
    for n, letters in [(12, "ab"), (12, "abcd e"), (40, "abcdefgh "), (260, "abcdefghij" * 3 + "xyz0123456789"), (400, "ab"), (230, "".join(map(chr, range(97, 400))))]:
        for _ in range(60):
            a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(n))) for _ in range(2))
            b = rng.choice((b, a[: n // 2] + b, b[:5] + a))
            assert T.block_ratio(a, b) == pytest.approx(SequenceMatcher(None, a, b).ratio(), abs=1e-12), (a, b)


def test_best_titles(spark):
    rng = random.Random(15)
    word = lambda: " ".join(rng.choice(("deep", "tide", "sea", "learning", "of", "x")) for _ in range(rng.randrange(4)))
    left, right = ([(k, word(), k % 3) for k in range(60)] for _ in range(2))
    got = {tuple(r) for r in T.best_titles(spark.createDataFrame(left, "id long, name string, g long"), spark.createDataFrame(right, "other long, oname string, g long"), "g", 0.55).collect()}
    want = set()
    for k, a, g in left:
        best = max(((SequenceMatcher(None, a, b).ratio(), -o) for o, b, h in right if g == h), default=(0, 0))
        if best[0] >= 0.55:
            want.add((k, -best[1], best[0]))
    assert got == want and len(want) > 20


@pytest.mark.parametrize("shard", [1 << 20, 7])
def test_shared_grams(spark, shard):
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdé日🙂") for _ in range(rng.randrange(n)))
    docs = [(k, text(60)) for k in range(80)] + [(90, None), (91, ""), (92, "ab" * 40)]
    items = [(k, text(30)) for k in range(12)] + [(20, "abababab"), (21, "")]
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    want = {(i, d, len(grams(r) & grams(t))) for i, r in items for d, t in docs if t and grams(r) & grams(t)}
    wanted = spark.createDataFrame([(i, g) for i, r in items for g in grams(r)], "item_id long, g string")
    got = [tuple(r) for r in shared_grams(spark.createDataFrame(docs, "doc_id long, text string"), wanted, 3, shard=shard).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_bootstrap_draws_for_each_row(spark):
    """equal values have draws of their own, and a group that lies in several tasks is added up."""
    import numpy as np

    from quireflow.plans.scoring import POISSON, PRIME, bootstrap

    rows = [(g, float(i % 3), (g * 1009 + i * 7919) % PRIME) for g, n in ((1, 3000), (2, 4), (3, 40), (4, 1)) for i in range(n)]
    got = {r.g: (r.low, r.high) for r in bootstrap(spark.createDataFrame(rows, "g long, x double, s long").repartition(4), 50).collect()}
    want, b = {}, np.arange(50)
    for g in (1, 2, 3, 4):
        x, s = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        y = (s[:, None] + b * 69621 + 12345) % PRIME
        z = (y * y + b) % PRIME
        w = np.searchsorted(np.array(POISSON), z * z % PRIME / float(PRIME), side="right")
        some = w.sum(axis=0) > 0
        want[g] = tuple(np.quantile((w * x[:, None]).sum(axis=0)[some] / w.sum(axis=0)[some], [0.025, 0.975]))
    assert got.keys() == want.keys()
    assert all(got[g] == pytest.approx(want[g]) for g in want)


def test_hamming_keys_are_not_broadcast(spark):
    """a table that is small by Spark's estimate has hundreds of keys a row."""
    h = spark.createDataFrame([(i, [i * 7919]) for i in range(20)], "a long, ha array<long>")
    joined = hamming_join(h, h.toDF("b", "hb"), 14)
    joined.collect()
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_bm25_keeps_documents_in_their_rows(spark, monkeypatch):
    """Scores as by plain Python with ties by key, in one scan and in several, and no aggregate over pairs of query and document."""
    import math
    import random
    from collections import Counter

    from quireflow.operators import ranking

    rng = random.Random(4)
    texts = [" ".join(rng.choice("ab cd ef gh ij kl mn op qr st".split()) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    texts += [texts[3]] * 5 + [None, "", "zz zz", "A x Ab"]
    asked = [(q, " ".join(rng.sample("ab cd ef gh ij kl mn op qr st none x".split(), 4))) for q in range(9)] + [(9, "x"), (10, None), (11, "none")]
    words = [(t or "").lower().split() for t in texts]
    mean, df = sum(map(len, words)) / len(words), Counter(w for own in words for w in set(own))
    want = set()
    for q, text in asked:
        scores = []
        for k, own in enumerate(words):
            tf = Counter(own)
            hit = [w for w in {*(text or "").split()} if len(w) >= 2 and tf[w]]
            if hit:
                scores.append((-round(sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(own) / mean)) for w in hit), 6), k))
        want |= {(q, k, -s, r) for r, (s, k) in enumerate(sorted(scores)[:7], 1)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, qtext string")
    for most in (512, 4):
        monkeypatch.setattr(ranking, "QUERIES", most)
        found = ranking.bm25(docs, queries, 7)
        assert {(r.query_id, r.doc_id, r.score, r["rank"]) for r in found.collect()} == want
        assert "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert ranking.bm25(docs, queries.where("query_id > 9"), 7).count() == 0


def test_words_are_counted_in_slices(spark, monkeypatch):
    """a batch's words are counted in slices, so that their numbers don't all stand in memory; every row once, in order, and the same scores."""
    import tracemalloc

    import pyarrow as pa

    from quireflow.operators import ranking

    docs = spark.createDataFrame([(k, " ".join(["ab cd", "ef ab ab", "cd " * 9, ""][k % 4] for _ in range(k % 7))) for k in range(60)], "doc_id long, text string").coalesce(1)
    queries = spark.createDataFrame([(1, "ab ef"), (2, "cd"), (3, "none")], "query_id long, qtext string")
    want = sorted(ranking.bm25(docs, queries, 9).collect())
    with monkeypatch.context() as m:
        m.setattr(ranking, "WORDS", 4)
        assert want and sorted(ranking.bm25(docs, queries, 9).collect()) == want
    with monkeypatch.context() as m:
        caught = []
        m.setattr(type(docs), "mapInArrow", lambda self, f, schema: caught.append(f))
        ranking._asked_terms(docs, ["ab", "cd"], "doc_id", "text")
    words = [["ab", "x", "cd", "ab"] * (k % 3) for k in range(1000)] + [["x"] * 300_000] + [["x", "ab"] * 500] * 2000 + [[]] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["k", "w"])
    tracemalloc.start()
    rows = [r for b in caught[0](iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["k"] for r in rows] == list(range(len(words)))
    assert all(r["len"] == len(w) and dict(zip(r["terms"], r["tf"], strict=True)) == {t: w.count(x) for t, x in enumerate(["ab", "cd"]) if x in w} for r, w in zip(rows, words, strict=True))
    assert peak < 40e6, peak
