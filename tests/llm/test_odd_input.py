"""Null keys, repeated rows, empty and very long texts, and extra columns with clashing names, for every operator and stage."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quireflow.llm import gif, secrets, sharding, simhash, token_files
from quireflow.llm.alignment import align_tokenizers
from quireflow.llm.bpe import bpe_encode
from quireflow.llm.collocations import collocations
from quireflow.llm.exact_dedup import DigestIndex, exact_dedup, keep_distinct
from quireflow.llm.mixing import mix_sources
from quireflow.llm.near_copies import keep_one_each
from quireflow.llm.packing import pack_documents
from quireflow.llm.quality import keep_good, score_quality
from quireflow.llm.substring import substring_dedup
from quireflow.sources.scratch import scratch_path

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
_rng = random.Random(4)
LONG = " ".join(_rng.choice(("alpha", "beta", "gamma", "delta")) + str(_rng.randrange(60000)) for _ in range(480_000))
ROWS = [(None, "no key"), (None, "no key"), (None, None), (1, "one text"), (1, "one text"), (1, "another text"), (2, ""), (3, None), (4, LONG), (5, "one text")]
CLASH = ("spans", "base_spans", "spans_at", "shard", "slot", "frames", "luma", "ids", "digest", "keep_id", "kept", "bucket", "fp", "component_id", "start", "row")


@pytest.fixture(scope="module")
def odd(spark):
    assert len(LONG) > 5_000_000
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("mine").alias(c) for c in CLASH)).repartition(3)


def test_every_row_comes_back(odd):
    made = {
        "quality": score_quality(odd),
        "sharding": sharding.shuffle_shards(odd, 3, tiebreak="text", rows_per_part=2),
        "bpe": bpe_encode(odd, WORD).select("doc_id", F.size("ids")),
        "exact": exact_dedup(odd),
        "substring": substring_dedup(odd).select("doc_id", "n_words"),
        "simhash": simhash.simhash_groups(odd),
        "gif": gif.read_gifs(gif.store_gifs(odd)).select("doc_id", "error", F.octet_length("luma")),
        "secrets": secrets.scan_secrets(odd).select("doc_id", "spans"),
        "alignment": align_tokenizers(odd, BYTE, public_tokenizers.path("piece_bpe_32k.model")),
        "mixing": mix_sources(odd),
        "token files": token_files.token_file_round_trip(odd, WORD).select("doc_id", "n_tokens"),
    }
    for name, df in made.items():
        got = sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
        assert got == sorted((k is None, k or 0) for k, _ in ROWS), name
    assert {(r.phrase, r.a) for r in collocations(odd, 2).collect()} >= {("one text", 3), ("no key", 2)}
    pieces = pack_documents(odd, BYTE)
    lib = Tokenizer.from_file(BYTE)
    assert pieces.agg(F.sum("length")).first()[0] == sum(len(lib.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)


def test_results_on_odd_rows(odd):
    exact = exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact} >= {(1, 5, 3, False), (5, 5, 3, True), (2, 3, 3, False), (None, None, 2, True)}
    assert keep_distinct(odd).columns == odd.columns and keep_distinct(odd).count() == len({t or "" for _, t in ROWS})
    sub = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(odd).select("doc_id", "n_words", "n_removed").collect()}
    assert (4, 480_000, 0) in sub and (3, 0, 0) in sub and (None, 2, 0) in sub
    fps = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(odd).collect()}
    assert len({f for k, f, _ in fps if k in (2, 3)}) == 1 and (3, "0" * 16, 2) in fps and (None, "0" * 16, 2) in fps


def test_stages_keep_columns_and_clean_rows(odd):
    for stage in (keep_distinct, keep_one_each, secrets.redact):
        assert stage(odd).columns == odd.columns
        assert {r.spans for r in stage(odd).select("spans").collect()} == {"mine"}
    assert keep_good(odd).columns == odd.columns
    assert secrets.redact(odd).count() == len(ROWS)


def test_other_keys(spark):
    small = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id int, text string")
    assert pack_documents(small, BYTE).schema["doc_id"].dataType.simpleString() == "int"
    words = small.withColumn("doc_id", F.concat(F.lit("k"), "doc_id"))
    assert {r.doc_id for r in pack_documents(words, BYTE).collect()} == {"k1", "k2"}
    for run in (exact_dedup, substring_dedup, keep_one_each, lambda d: token_files.token_file_round_trip(d, WORD)):
        with pytest.raises(TypeError, match="whole numbers"):
            run(words)


def test_equal_rows_and_keys_are_spread(spark):
    same = spark.range(0, 2000, 1, 4).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    got = sharding.shuffle_shards(same, 4, rows_per_part=50)
    sizes = {r.shard: (r["n"], r.top) for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("top")).collect()}
    assert sizes == {s: (500, 499) for s in range(4)}


def test_training_sample_is_bounded_for_one_key(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "!!! $$$ ### @@@ !!! $$$").otherwise("The plain words of a clean sentence stand here.").alias("text"), F.lit("en").alias("lang"))
    assert score_quality(docs).count() == 3000


def test_index_is_compacted_and_read_by_buckets(spark):
    index = DigestIndex(spark, scratch_path(spark, "digests"), buckets=4)
    for part in ([(1, "a"), (2, "b")], [(3, "b"), (4, "c")]):
        exact_dedup(spark.createDataFrame(part, "doc_id long, text string"), index=index, batches=1)
    made = index.compact(scratch_path(spark, "compacted"))
    assert spark.table(made.batches[0]).count() == 3
    again = {r.doc_id: r for r in exact_dedup(spark.createDataFrame([(9, "c"), (10, "new")], "doc_id long, text string"), index=made).collect()}
    assert (again[9].keep_id, again[9].kept, again[10].kept) == (4, False, True)
    plan = made.stored(spark.createDataFrame([("x",)], "digest string"))._jdf.queryExecution().executedPlan().toString()
    stored = [line for line in plan.split("\n") if "digests_" in line]
    assert stored and all("Bucketed: true" in line for line in stored)


def test_canvas_is_bounded(spark):
    huge = b"GIF89a" + (65535).to_bytes(2, "little") * 2 + b"\0\0\0\x3b"
    got = gif.read_gifs(spark.createDataFrame([(huge,)], "media binary")).first()
    assert got.frames is None and "pixels" in got.error
