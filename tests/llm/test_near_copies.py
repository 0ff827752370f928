"""Near copies against brute force: words replaced, passages cut off or added, hubs and short texts."""

import random

import pytest

from quireflow.llm.near_copies import keep_one_each, near_copy_groups

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    label = {k: k for k, _ in rows}
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if len(x & y) >= 0.8 * len(x | y)]
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label, links


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = lambda n: [rng.choice("abcdefghij") + str(rng.randrange(3000)) for _ in range(n)]
    out = []
    for _ in range(60):
        w = words(rng.randrange(80, 400))
        n = len(w)
        replaced = [x if rng.random() > 0.02 else "other" for x in w]
        edits = [w[: int(n * 0.81)], w[: int(n * 0.85)], w[int(n * 0.15) :], w + words(int(n * 0.15)), w + words(int(n * 0.22)), w[: n // 2] + words(n // 10) + w[n // 2 :], replaced, w[: int(n * 0.6)]]
        out += [w, rng.choice(edits), rng.choice(edits)]
    short = words(44)
    for _ in range(60):  # a crowd of edits of one text, most of them just below the least similarity
        w = list(short)
        for at in rng.sample(range(44), rng.choice([1, 1, 2, 3])):
            w[at] = rng.choice("xyz") + str(rng.randrange(4 if rng.random() < 0.5 else 10**6))
        out.append(w)
    base = words(200)
    out += [base, *(base[:at] + ["changed"] + base[at + 1 :] for at in rng.sample(range(200), 40))]
    out += [["Short", "text"], ["short", "TEXT"], ["short"], [], [], words(5)]
    rng.shuffle(out)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


def test_components_are_those_of_all_pairs(spark, rows):
    want, links = brute(rows)
    assert len(links) > 100
    got = {r.doc_id: r.component_id for r in near_copy_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_one_of_each_stays(spark, rows):
    want, _ = brute(rows)
    df = spark.createDataFrame([*rows, rows[0], (None, rows[0][1]), (None, None)], SCHEMA)
    kept = [r.doc_id for r in keep_one_each(df).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(set(want.values()))
    assert kept.count(None) == 2
    assert near_copy_groups(df.limit(0)).count() == 0


def test_fingerprints_give_candidates(spark, monkeypatch):
    """with no bucket shared, links come from the SimHash index alone, and each is verified."""
    from quireflow.llm import near_copies

    words = [f"w{k * 7919 % 10007}" for k in range(2000)]
    edited = [*words[:1000], "new", *words[1001:]]
    rows = [(7, " ".join(words)), (9, " ".join(edited)), (11, " ".join(words)), (12, "something else"), (13, "quite another text")]
    monkeypatch.setattr(near_copies, "buckets", lambda rows, width: rows.selectExpr("__key", "__key AS bucket"))
    got = {r.doc_id: r.component_id for r in near_copy_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {7: 7, 9: 7, 11: 7, 12: 12, 13: 13}
