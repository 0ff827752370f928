"""Similarity joins, closures, reading order, references and the embedder hook against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.operators import embedding, outline, similarity


def test_similarity_join_is_exact_and_prunes(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + 0.15 * rng.normal(size=16)).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[0][1]) for k in range(60)] + [(2000, None), (2001, [0.0] * 16), (2002, [-x for x in rows[0][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    keys = np.array([k for k, v in rows if v and any(v)])
    unit = np.array([v for _, v in rows if v and any(v)])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T
    blocks = similarity.vector_blocks(df, "vec_id", "embedding", 16).cache()
    work = []
    for least in (0.2, 0.9, 0.99):
        want = {(min(a, b), max(a, b)) for i, j in zip(*np.nonzero(np.triu(cosine >= least - 1e-9, 1)), strict=True) for a, b in [(int(keys[i]), int(keys[j]))]}
        got = similarity.similarity_join(df, least, rows=16).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
        work.append(similarity.block_pairs(blocks, least).agg(F.sum("products")).first()[0])
    everything = len(keys) * (len(keys) - 1) // 2
    assert everything >= work[0] > work[1] > work[2] and work[2] < everything / 4
    assert similarity.block_pairs(blocks, -1.0).agg(F.sum("products")).first()[0] == everything
    assert similarity.similarity_join(df.limit(0), 0.5).count() == 0


def test_blocks_go_to_tiles_once(spark):
    """a block isn't sent once for each pair of blocks, and every pair is in one tile."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(700)], "vec_id long, embedding array<double>").repartition(4)
    blocks = similarity.vector_blocks(df, "vec_id", "embedding", 8).cache()
    pairs = {(r.i, r.j) for r in similarity.block_pairs(blocks, -1.0).collect()}
    placed = similarity.tiles(blocks, -1.0, 4).collect()
    assert sorted((r.block, j) for r in placed for j in r.others) == sorted(pairs)
    held = {(r.tile, r.block) for r in placed}
    assert len(held) == len(placed) < len(pairs) and all((r.tile, j) in held for r in placed for j in r.others)


def test_closure_ends_on_cycles(spark):
    rng = random.Random(2)
    edges = [(k, rng.randrange(60)) for k in range(60)] + [(5, 6), (6, 7), (7, 5), (70, None), (80, 80)]
    above = {}
    for child, parent in edges:
        if parent is not None:
            above.setdefault(child, set()).add(parent)
    want = set()
    for node in above:
        todo, seen = list(above[node]), set()
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += above.get(x, ())
        want |= {(x, node) for x in seen}
    got = [tuple(r) for r in outline.closure(spark.createDataFrame(edges, "id long, parent long")).select("ancestor", "descendant").collect()]
    assert set(got) == want and len(got) == len(want) and {(80, 80), (5, 5)} <= want


def test_references_follow_the_outline(spark):
    rows = [("p", 1, None, 2, "b [@x] [@y]"), ("p", 2, None, 1, "a [@ y ] and [@z][@y]"), ("p", 3, 2, 1, "[@w] first child"), ("p", 4, 3, 9, None), ("p", 5, 99, 1, "[@never]"), ("p", 6, 7, 1, "c"), ("p", 7, 6, 1, "c"), ("q", 1, None, 1, "[@x]"), ("q", 2, 1, 1, "no mark [@ ]"), ("q", 3, 1, 2, "")]
    df = spark.createDataFrame(rows, "doc string, node long, parent long, ord long, text string")
    placed = outline.reading_order(df, "doc", "node", "parent", "ord")
    assert [r.node for r in placed.where("doc = 'p'").orderBy("path").collect()] == [2, 3, 4, 1]
    chapters, refs = outline.number_references(placed, spark.createDataFrame([("x", "X"), ("y", "Y")], "id string, title string"), "doc")
    assert {(r.doc, r.node): r.text for r in chapters.collect()} == {
        ("p", 1): "b [4] [1]", ("p", 2): "a [1] and [2][1]", ("p", 3): "[3] first child", ("p", 4): None, ("q", 1): "[1]", ("q", 2): "no mark [0]", ("q", 3): "",
    }
    assert {tuple(r) for r in refs.collect()} == {("p", 1, "y", "Y"), ("p", 2, "z", "[not found: z]"), ("p", 3, "w", "[not found: w]"), ("p", 4, "x", "X"), ("q", 1, "x", "X")}


def test_any_embedder_can_be_given(spark):
    lengths = lambda texts: np.array([[len(t), 1.0] for t in texts]).reshape(-1, 2)
    df = spark.createDataFrame([(1, "abc", ["a", "abcd"], ["abcd", "x"]), (2, None, [], ["x"]), (3, "", ["a"], None)], "k long, t string, a array<string>, b array<string>")
    assert {r.k: r.vector for r in embedding.embed(df, "t", lengths).collect()} == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    got = {r.k: r.sims for r in embedding.closest(df, "a", "b", lengths).collect()}
    assert got == {1: pytest.approx([1.0, 1.0]), 2: None, 3: None}


def test_anchors_have_true_places(spark):
    text = "Deep tides rise. Short. Deep tides rise. The sea is 3.5 deep! Nothing here matters at all? tail of it"
    df = spark.createDataFrame([(1, text, "deep tides"), (2, None, "deep"), (3, "Deep tides rise.", None)], "k long, t string, c string")
    got = {r.k: r.anchors for r in embedding.anchors(df, "t", "c", embedding.hashed_words).collect()}
    assert [(a.text, a.start) for a in got[1][:2]] == [("Deep tides rise.", 0), ("Deep tides rise.", 23)] and len(got[1]) == 3 and got[2] == got[3] == []
    assert all(text[a.start : a.end].strip() == a.text for a in got[1])
