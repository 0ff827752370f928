"""Alignment of two tokenizers against the libraries' own tokens and plain Python."""

import hashlib
import json
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quireflow.llm import alignment, queries
from quireflow.llm.words import byte_alphabet

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_rng = random.Random(12)
BITS = ["the", " ", "  ", "word", "tion", "\n", "é", "日本", "▁", "<|endoftext|>", "<s>", "</s>", "'s", "1234", "\t", "...", "\0", "\xa0", "🙂", "Ünder", "<0x0A>", " a b c"]
TEXTS = [None, "", " ", "  ", "a", " a", "a ", "one text", "one text", "one text", "mark ▁ inside", "<|endoftext|> and <s>", "x" * 300, *["".join(_rng.choice(BITS) for _ in range(_rng.randrange(40))) for _ in range(150)]]
#: Longer than the slices of the test and cut into parts by it.
LONG = " ".join(_rng.choice(("alpha", "beta", "gamma", "de9", "né")) + _rng.choice(("", "s", ",", "  x")) for _ in range(4000))
ROWS = [*enumerate(TEXTS), (900, LONG), (901, LONG), (902, LONG + " ▁"), (None, "one text"), (None, None), (3, "a")]


def expected(rows):
    a_lib, b_lib = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a_lib.encode_special_tokens = True
    alphabet = byte_alphabet()
    with open(BYTE, encoding="utf-8") as f:
        vocab = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    aligned, counts = [], Counter()
    for key, text in rows:
        want = (" " + (text or "")).encode()
        a, b = a_lib.encode(want.decode(), add_special_tokens=False).ids, b_lib.encode(text or "")
        spelled_a = [bytes(alphabet[ch] for ch in vocab[i]) for i in a]
        spelled_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_lib.id_to_piece(i)]]
        if not text or b"".join(spelled_a) != want or b"".join(spelled_b) != want:
            aligned.append((key, [], [], [], ""))
            continue
        ends = [list(accumulate(map(len, side))) for side in (spelled_a, spelled_b)]
        where_b = {e: j for j, e in enumerate(ends[1])}
        groups, i0, j0, links = [], 0, 0, []
        for i, e in enumerate(ends[0]):
            if e in where_b:
                j = where_b[e]
                groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
                links.append((a[i], b[j]))
                i0, j0 = i + 1, j + 1
        counts.update(links)
        aligned.append((key, a, b, links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return sorted(
        ((k is None, k or 0), len(a), len(b), len(links), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), h) for k, a, b, links, h in aligned
    )


def found(df):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "en", "mine", "mine", 1) for k, t in ROWS], "doc_id long, text string, lang string, digest string, slice string, n int").repartition(3)


def test_align_tokenizers(docs, spark):
    want = expected(ROWS)
    assert sum(w[1] for w in want) and sum(w[-1] == "" for w in want) > 3
    assert found(alignment.align_tokenizers(docs, BYTE, PIECE)) == want
    assert alignment.align_tokenizers(docs.limit(0), BYTE, PIECE).collect() == []


def test_parts_are_cut_where_both_begin_a_token(monkeypatch):
    texts = [LONG, "no place to cut" * 3 + "x" * 5000, LONG + " ▁"]
    both = alignment.aligner(BYTE, PIECE)
    whole = {hashlib.sha256(t.encode()).digest(): alignment._slice(both, [t.encode()], [hashlib.sha256(t.encode()).digest()], np.array([3])).to_pylist() for t in texts}
    for digest, rows in whole.items():
        text = next(t for t in texts if hashlib.sha256(t.encode()).digest() == digest).encode()
        cut = alignment.parts(text, 1000)
        assert b" ".join(cut) == text
        assert len(cut) > 5 or text.startswith(b"no place")
        rebuilt = [r for batch in alignment._long(both, cut, [digest], np.array([3])) for r in batch.to_pylist()]
        measures = [r for r in rebuilt if r["slice"] is None]
        assert measures == [r for r in rows if r["slice"] is None]
        weigh = lambda found: sum((Counter(dict(zip(memoryview(r["pairs"]).cast("q").tolist(), memoryview(r["weights"]).cast("q").tolist(), strict=True))) for r in found if r["slice"] is not None), Counter())
        assert weigh(rebuilt) == weigh(rows)


def test_op12(spark, tmp_path):
    rows = [(k, t, "en", "s", 0) for k, t in ROWS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found(got) == expected(ROWS)
