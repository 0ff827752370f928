"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quireflow.llm import collocations as co
from quireflow.llm import queries

_rng = random.Random(11)
VOCAB = ["the", "of", "a", "Tide", "tide", "sea", "naïve", "x\0y", "日本", "e.g", "w-w", "ÀB"]
PASSAGE = "one long passage that many rows share and that goes on for quite a while without any stop"
PLANTED = [PASSAGE, "start of " + PASSAGE, PASSAGE + " and more", "a a a a a a", "tide tide tide", "", None, "...", " \t ", "x" * 50]


def rows(n=400):
    made = []
    for k in range(n):
        text = "".join(_rng.choice(VOCAB) + _rng.choice((" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", ": ")) for _ in range(_rng.randrange(30)))
        made.append((k % 350, text if k % 3 else _rng.choice(PLANTED), _rng.choice(("en", "de", None, "und"))))
    return made


def plain(rows, least, top, covered):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in (1, 2, 3, 4):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    found = set()
    for lang, f in counts.items():
        kept = []
        longer = [g for g, n in f.items() if n >= least and len(g) > 2]
        for g in (g for g, n in f.items() if n >= least and len(g) > 1):
            a = f[g]
            if any(len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h))) and 100 * f[h] >= covered * a for h in longer):
                continue
            score, k = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            found.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return found


def frame(spark, data):
    return spark.createDataFrame([(k, t, x, "mine", "mine") for k, t, x in data], "doc_id long, text string, lang string, gram string, n string").repartition(3)


@pytest.mark.parametrize(("least", "top", "bits"), [(3, 2000, 27), (8, 20, 27), (2, 2000, 16)])
def test_collocations(spark, monkeypatch, least, top, bits):
    monkeypatch.setattr(co, "MOST_BITS", bits)
    data = rows()
    got = co.collocations(frame(spark, data), least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(data, least, top, 80)
    assert {tuple(r) for r in got.collect()} == want and len({w[0] for w in want}) == 3


def test_unary_paths_become_one_row(spark):
    data = [(k, PASSAGE, "en") for k in range(9)] + [(9, "and that goes on for quite", "en")] * 2
    src = frame(spark, data).selectExpr("lang", "coalesce(text, '') AS text")
    rows_ = co.graph_rows(src, *co.frequent_pairs(src, 3)).cache()
    nodes = co.nodes_of(rows_, 3).cache()
    paths = sorted((" ".join(r.path), r.n, r.head_flow, r.tail_flow) for r in co.compact_paths(rows_, nodes, 3).collect())
    assert paths == [
        ("and that goes on for quite", 11, 11, 11),
        ("on for quite a while without any stop", 9, 11, 9),
        ("one long passage that many rows share and that goes", 9, 9, 11),
    ]


def test_empty_and_op11(spark, tmp_path):
    assert co.collocations(frame(spark, rows()).limit(0)).collect() == []
    assert co.collocations(frame(spark, [(None, None, None), (1, "", "en"), (1, "one", "en")])).collect() == []
    data = rows(900)
    spark.createDataFrame([(k, t, x, "s", 0) for k, t, x in data], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in queries.op11_collocations(spark, str(tmp_path)).collect()} == plain(data, 30, 2000, 80)
