"""Mentions against a plain search, title by title and pattern by pattern."""

import random
import re

from quireflow.operators.mentions import lowered, mentions

TITLES = ["A tide of the sea", "tide of the", "tide of", "onewordtitle", "deep learning", "deep learning deep", "Ünder the İce", "a\tb c d e f g", "100 years", "aa aa aa aa", "", None]
NAMES = ["Neil", "O'Neil", "Ng", "X", "Smith-Jones", "Jones", "Éluard", None]


def plain(text, title, surname, year, window):
    found = []
    low, want = lowered(text), lowered(title or "")
    if len(want) >= 10 and len(want.split()) >= 2:
        at = low.find(want)
        while at >= 0:
            before, after = text[at - 1] if at else " ", text[at + len(want)] if at + len(want) < len(text) else " "
            if not before.isalnum() and not after.isalnum():
                found.append(at)
            at = low.find(want, at + 1)
    if surname and len(surname) > 1 and year:
        s = re.escape(surname)
        for pattern in (rf"\b{s}\s+et\s+al\.\s*\(\s*{year}\s*\)", rf"\b{s}\s*\(\s*{year}\s*\)", rf"\b{s}\s*,\s*\(?\s*{year}\s*\)?"):
            found += [m.start() for m in re.finditer(pattern, text, re.IGNORECASE)]
    seen, out = set(), []
    for at in sorted(set(found)):
        context = text[max(0, at - window) : at + window]
        if context not in seen:
            seen.add(context)
            out.append((at + 1, context))
    return out


def test_mentions(spark):
    rng = random.Random(8)
    targets = [(k, t, rng.choice(NAMES), rng.choice((2019, 2020, None))) for k, t in enumerate(TITLES * 2)]
    bits = [*filter(None, TITLES), *filter(None, NAMES), " et al. (2020)", " et al. ( 2019 )", "(2020)", " (2019)", ", 2020", ", (2019)", ",2020)", " ", " ", " ", ". ", "x", "_", "9", "-", "deep LEARNING", "NEIL", "İ", "aa "]
    docs = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(25)))) for k in range(150)]
    docs += [(200, None), (201, ""), (202, "aa " * 60), (203, "deep learning. " * 20), (None, "by Ng (2020)")]
    d = spark.createDataFrame([(k, t, "mine", "mine") for k, t in docs], "doc_id long, text string, context string, target string").repartition(3)
    t = spark.createDataFrame(targets, "target long, title string, surname string, year int")
    want = sorted((key, doc is None, doc or 0, at, c) for key, title, surname, year in targets for doc, text in docs if text for at, c in plain(text, title, surname, year, 30))
    for shard in (1 << 20, 60):
        got = sorted((r.target, r.doc_id is None, r.doc_id or 0, r.pos, r.context) for r in mentions(d, t, 30, shard=shard).collect())
        assert got == want
    assert len(want) > 200
    assert mentions(d.limit(0), t).count() == mentions(d, t.limit(0)).count() == 0
