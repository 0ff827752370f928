"""Queries against their DuckDB SQL on a small set: those named here, or all with SQL where QUIREFLOW_ALL is set."""

import math
import os
import re

import pytest

from quireflow.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["a1_facets", "a10_dimension_statistics", "w2_latest_per_key", "w8_trend_with_gaps", "u4_tag_rename_delete", "j13_fuzzy_title_link", "r1_bm25_search", "r4_hybrid_search", "n12_benford", "n17_grim", "k7_offset_sweep", "k15_auc", "e2_duplicate_groups", "d3_corpus_duplication", "c9_outline_tree", "q1_json_issues", "s4_json_lines", "t9_sessions", "s11_score_sheet", "s13_mirror_findings", "s16_reference_export", "q6_backfill_findings", "w13_node_chunks", "s8_sentence_chunks", "w11_key_sentences", "w12_diverse_chunks", "w14_evidence_pack", "d5_paraphrase", "d7_copy_ratio", "d9_fidelity", "d10_coverage", "d15_generated_likelihood", "d16_leakage_report", "k17_isotonic", "k22_bootstrap_interval", "k41_leave_one_out", "r5_mmr_rerank", "c1_citation_contexts", "c5_neighbourhood_graph", "c14_fake_identifiers", "n14_text_flags", "n36_whole_audit", "t2_debounce", "t4_token_bucket", "t7_stuck", "t8_daily_snapshot", "t10_retry_batch", "s12_stream_upsert", "s11_score_summary", "k10_weight_search", "k27_prediction_vs_annotation", "k34_threshold_scan", "k34_group_medians", "k37_score_layers", "j9_similarity_self_join", "j10_hamming_join", "j12_near_hash_leakage", "j14_string_ratio", "j16_registry_reconciliation", "c2_edge_upsert", "c8_reference_numbers", "c8_rewritten_chapters", "c10_descendants", "d8_copied_sentences", "n22_claimed_gain", "n30_claim_penalty", "n32_objective_features", "n33_hype_risk", "r20_sentence_anchors", "r24_context_assembly", "f3_index_then_substring"]
if os.environ.get("QUIREFLOW_ALL"):
    NAMES = sorted(catalog.ORACLE)


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return repr(round(float(v), 6) + 0.0)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = lambda cols: sorted(range(len(cols)), key=lambda i: cols[i])
    got = sorted(tuple(canon(r[i]) for i in order(df.columns)) for r in df.collect())
    assert got == sorted(tuple(canon(r[i]) for i in order(want.columns)) for r in want.fetchall())


def test_no_cartesian_product_in_the_shingle_join(spark):
    from quireflow.plans.corpus import shingle_pairs

    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id long, text string")
    plan = shingle_pairs(docs, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_sections_of_odd_texts(spark, tmp_path):
    """decimals, carriage returns, wide blanks and other line ends, as the SQL takes them."""
    import duckdb

    start = "the novel line with an address that is as long as it needs 10.2"
    texts = ["gain of 91.5% here. Then 3.5 more", "a\nResults\r\nb", "x\n\u00a0Results\u00a0\ny", "open\u2028source. open\rsource", "table\x0b3. table\t3", "L\u0130MITATION here", f"{start[:50]} 1.2 a. {start[:50]} 1.3 b", "\u3000a baseline\u3000. next", None, ""]
    docs = spark.createDataFrame([(3 * i + 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, class, rank, pos, chars FROM ({catalog.ORACLE['n34_sections']})").fetchall()
    got = catalog.QUERIES["n34_sections"](spark, str(tmp_path)).select("doc_id", "class", "rank", "pos", "chars").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_duplicates_are_given_by_class(spark, tmp_path):
    """F8: entries with equal title and authors come once each, not in all pairs; none of those is lost."""
    from quireflow.plans.corpus import ENT

    import duckdb

    con = duckdb.connect()
    con.sql(f"COPY (SELECT i::BIGINT AS s_suppkey, 'x' AS s_name, (i // 210 % 5)::INTEGER AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM range(4200) t(i)) TO '{tmp_path}/supplier.parquet'")
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    got = {tuple(sorted(r)) for r in catalog.QUERIES["e1_duplicate_test"](spark, str(tmp_path)).select("a", "b").collect()}
    want = set(con.sql(f"WITH {ENT} SELECT a.id, b.id FROM e a JOIN e b ON a.title = b.title AND a.id < b.id WHERE len(list_intersect(a.authors, b.authors)) > 0").fetchall())
    assert got <= want and len(got) < len(want) / 3
    entries = dict(con.sql(f"WITH {ENT} SELECT id, (title, list_sort(list_distinct(authors))) FROM e").fetchall())
    first = {}
    for i in sorted(entries):
        first.setdefault(str(entries[i]), i)
    reps = {tuple(sorted((first[str(entries[a])], first[str(entries[b])]))) for a, b in want}
    assert {p for p in reps if p[0] != p[1]} <= got
    assert {(first[str(e)], i) for i, e in entries.items() if first[str(e)] != i} <= got


def test_duplicates_are_all_pairs(spark, tmp_path, monkeypatch):
    """every pair of entries comes once, members of one class too, whatever blocks they are dealt to."""
    import duckdb

    from quireflow.plans import corpus

    con = duckdb.connect()
    con.sql(f"COPY (SELECT CASE WHEN i % 1000 = 999 THEN NULL ELSE i END::BIGINT AS s_suppkey, 'x' AS s_name, CASE WHEN i % 97 = 0 THEN NULL ELSE i // 210 % 5 END::INTEGER AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM range(4200) t(i)) TO '{tmp_path}/supplier.parquet'")
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet'")
    want = con.sql(f"WITH {corpus.ENT} SELECT a.id, b.id FROM e a JOIN e b ON a.title = b.title AND a.id < b.id WHERE len(list_intersect(a.authors, b.authors)) > 0").fetchall()
    assert sorted(con.sql(catalog.ORACLE["e1_duplicate_test"]).fetchall()) == sorted(want)
    for members in (3, 512):
        monkeypatch.setattr(corpus, "MEMBERS", members)
        got = catalog.QUERIES["e1_duplicate_test"](spark, str(tmp_path)).select("a", "b")
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_shingle_pairs_keep_shared_shingles_only(spark):
    """The sets that are joined hold no shingle of one document alone, and no pair is lost; with `within` only its pairs come."""
    import random

    from quireflow.plans.corpus import shared_shingles, shingle_pairs

    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    bases = [[word() for _ in range(80)] for _ in range(6)]
    line = [f"license{k}" for k in range(30)]
    texts = []
    for i in range(60):
        w = list(bases[i % 6]) + (line if i % 4 == 0 else [])
        for _ in range(i // 6 * 2):
            w[rng.randrange(80)] = word()
        texts.append(" ".join(w))
    texts += [texts[0], texts[7], "too short", None, " ".join(word() for _ in range(90))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {}
    for i, t in enumerate(texts):
        if t and t not in [texts[k] for k in sets] and len(t.split()) >= 50:
            w = t.split()
            sets[i] = {" ".join(w[k : k + 5]) for k in range(len(w) - 4)}
    stored = {r.doc_id: (r.n, r.m, len(r.r)) for r in shared_shingles(docs.where("doc_id not in (60, 61)")).collect()}
    shared = {i: sum(any(x in o for j, o in sets.items() if j != i) for x in s) for i, s in sets.items()}
    assert stored == {i: (len(s), shared[i], shared[i]) for i, s in sets.items() if shared[i]} and 64 not in stored
    for least in (0.1, 0.3, 0.55):
        want = {(a, b, round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b}
        want = {p for p in want if p[2] >= least}
        got = {tuple(r) for r in shingle_pairs(docs, least).collect()}
        assert got == want | {(0, 60, 1.0), (7, 61, 1.0)} and len(want) > 10
        some = docs.where("doc_id % 3 = 0").select("doc_id")
        assert {tuple(r) for r in shingle_pairs(docs, least, some).collect()} == {p for p in want if p[0] % 3 == 0 and p[1] % 3 == 0}


def test_shingles_are_exchanged_packed(spark, monkeypatch):
    """shared shingles and their order by frequency are those of single rows, over parts and batches; what is exchanged are a few packed rows."""
    import random
    from collections import Counter

    from quireflow.plans import corpus

    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words[: 5 + i % 60]) for _ in range(40 + i % 90)) for i in range(300)] + [" ".join(words), " ".join(words[:120]), None, ""]
    docs = spark.createDataFrame([(i - 150, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(corpus, "PART", 20000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got = {r.doc_id: (r.n, r.m, r.r) for r in corpus.shared_shingles(docs).collect()}
        plan = corpus.shared_shingles(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sets = {r.doc_id: (r.n, r.r) for r in corpus.shingle_table(docs).collect()}
    df = Counter(x for _, r in sets.values() for x in r)
    want = {i: (n, [x for x in sorted(r, key=lambda x: (df[x], x)) if df[x] > 1]) for i, (n, r) in sets.items()}
    assert got == {i: (n, len(r), r) for i, (n, r) in want.items() if r} and 0 < len(got) < len(sets)
    assert "hashpartitioning(part" in plan and "hashpartitioning(s#" not in plan


def _like_sets(spark, n=700, seed=5):
    """Sets of clusters larger than a block, with every pair's similarity."""
    import random

    rng = random.Random(seed)
    bases = [rng.sample(range(10**6), 40) for _ in range(4)]
    sets = {}
    for i in range(n):
        own = [x for x in bases[0 if i % 2 else i % 4] if rng.random() > 0.01 * (i % 60)] + rng.sample(range(10**6), i % 13)
        sets[3 * i] = sorted({-x if x % 2 else x for x in own} | ({7} if i % 50 == 0 else set())) or [1]
    df = {}
    for r in sets.values():
        for x in r:
            df[x] = df.get(x, 0) + 1
    kept = [(i, len(r), [x for x in sorted(r, key=lambda x: (df[x], x)) if df[x] > 1]) for i, r in sets.items()]
    rows = spark.createDataFrame([(i, n, len(r), r) for i, n, r in kept if r], "doc_id long, n long, m long, r array<long>").repartition(3)
    of = {i: set(r) for i, r in sets.items()}
    share = {(a, b): len(of[a] & of[b]) for a in of for b in of if a < b}
    return rows, {(a, b, round(k / (len(of[a]) + len(of[b]) - k), 6)) for (a, b), k in share.items() if k}


def test_sets_are_sent_by_tiles(spark, monkeypatch):
    """no pair is lost over blocks, groups and parts of a product; a set is sent far less often than it has pairs."""
    from quireflow.operators import set_join

    rows, like = _like_sets(spark)
    monkeypatch.setattr(set_join, "CELLS", 1 << 10)
    placed = set_join.place_sets(rows)
    for least in (0.1, 0.3, 0.55, 1.0):
        want = {p for p in like if p[2] >= least}
        assert {tuple(r) for r in set_join.set_pairs(placed, least).collect()} == want
    assert set_join.set_pairs(placed, 0.3).count() == len({p for p in like if p[2] >= 0.3})
    sent = set_join.tiles(placed, 0.3).selectExpr("sum(bit_count(mask))").first()[0]
    assert sent < 2 * len([p for p in like if p[2] >= 0.3]) / 20


def test_the_best_of_each_set(spark):
    """with `best` a tile gives each set's nearest only, and the nearest of all are among them, ties by id."""
    from quireflow.operators import set_join

    rows, like = _like_sets(spark)
    near = {}
    for a, b, j in like:
        if j >= 0.55:
            near.setdefault(a, []).append((-j, b))
            near.setdefault(b, []).append((-j, a))
    got, n = {}, 0
    for r in set_join.set_pairs(set_join.place_sets(rows), 0.55, best=5).collect():
        n += 1
        got.setdefault(r.a, []).append((-r.jaccard, r.b))
    assert {a: sorted(x)[:5] for a, x in got.items()} == {a: sorted(x)[:5] for a, x in near.items()}
    assert n < sum(map(len, near.values())) / 5


def test_report_stops_at_the_first_threshold_with_enough_pairs(spark, tmp_path, monkeypatch):
    """the 200 closest pairs, by the SQL, whether 200 are found above the first threshold, a later one or none; lower ones aren't sought then."""
    import duckdb
    import random

    from quireflow.plans import corpus

    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(70)]
    found = corpus.set_pairs
    for case, (n, changed, steps) in enumerate([(25, 0, [1.0]), (25, 1, [1.0, 0.8, 0.55]), (8, 1, [1.0, 0.8, 0.55, 0.3])]):
        texts = []
        for i in range(n):
            w = list(base)
            for _ in range(changed):
                w[rng.randrange(70)] = f"new{i}"
            texts.append("  ".join(w) + "." * i)
        at = tmp_path / str(case)
        spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
        con = duckdb.connect()
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
        asked = []
        monkeypatch.setattr(corpus, "set_pairs", lambda placed, least, **more: asked.append(least) or found(placed, least, **more))
        got = catalog.QUERIES["d3_corpus_duplication"](spark, str(at)).collect()
        assert [tuple(r) for r in got] == con.sql(catalog.ORACLE["d3_corpus_duplication"]).fetchall() and len(got) in (200, n * (n - 1) // 2 + 1)
        assert asked == steps


def test_bigram_overlap_of_odd_texts(spark, tmp_path):
    """sentences of one letter, equal ones, blanks within, letters beyond 16 bits and documents of no or one sentence, as the SQL takes them; no array of text bigrams is made."""
    import duckdb

    texts = ["a. a. b. ab. ba", "aa. a a. aaa. aab", "\U0001f600x. \U0001f600x y. x\U0001f600", "one", "", None, "a b\tc. ab c! abc? 3.5 is 3.5. x\ny", "。！", "abab. abab. bab", "z. ", " q . q"]
    docs = spark.createDataFrame([(3 * k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, pos, overlap FROM ({catalog.ORACLE['d11_bigram_overlap']})").fetchall()
    found = catalog.QUERIES["d11_bigram_overlap"](spark, str(tmp_path)).select("doc_id", "pos", "overlap")
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 15
    assert "array_intersect" not in found._jdf.queryExecution().executedPlan().toString()


def test_minhash_bands(spark):
    """equal sets have equal bands, near ones share one and others none; each row has 16, made in one pass over Arrow batches."""
    from quireflow.plans.corpus import minhash_bands

    import numpy as np

    rng = np.random.default_rng(1)
    sets = rng.integers(-(2**63), 2**63 - 1, (300, 100))
    rows = [(k, s.tolist()) for k, s in enumerate(sets)] + [(1000 + k, [*s[:97].tolist(), *rng.integers(0, 2**62, 3).tolist()]) for k, s in enumerate(sets)] + [(2000, sets[0].tolist()[::-1]), (2001, [7])]
    bands = {}
    for r in spark.createDataFrame(rows, "doc_id long, r array<long>").mapInArrow(minhash_bands, "doc_id long, band long").collect():
        bands.setdefault(r.doc_id, set()).add(r.band)
    assert len(bands) == len(rows) and all(len(b) == 16 for b in bands.values()) and bands[2000] == bands[0]
    assert all(bands[k] & bands[1000 + k] for k in range(300))
    assert not any(bands[k] & bands[k + 1] for k in range(299))


def _dealt(spark, monkeypatch, name):
    from quireflow import session

    monkeypatch.setattr(session, "ROWS", 500)
    return catalog.QUERIES[name](spark, SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_series_are_dealt_by_rows(spark, monkeypatch):
    """the number of partitions follows the table's rows (6,000), and nothing is exchanged after that."""
    plan = _dealt(spark, monkeypatch, "n13_series_flags")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\([^)]*, 12\), REPARTITION_BY_NUM", plan)) == 3
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_each_check_of_the_audit_is_written_alone(spark, monkeypatch):
    """no task holds a partition of several checks, and findings are numbered in partitions of bounded rows."""
    df = _dealt(spark, monkeypatch, "n36_whole_audit")
    assert len({f.rsplit("/", 1)[0] for f in df.inputFiles()}) == 10
    assert re.search(r"hashpartitioning\(entity[^)]*\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_spearman_sorts_once_for_each_measure(spark, monkeypatch):
    """two sorts in partitions of bounded rows, by one exchange."""
    plan = _dealt(spark, monkeypatch, "k13_spearman")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange ", plan)) == 1 and re.search(r", 12\), REPARTITION_BY_NUM", plan)
    assert len(re.findall(r"Sort \[", plan)) == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_texts_are_not_exchanged_for_their_best_queries(spark):
    """where documents are too large to be broadcast, the few found rows are; only they and the vectors are exchanged."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        plan = catalog.QUERIES["r16_match"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id", plan)) <= 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_hybrid_search_exchanges_no_documents(spark):
    """the few fused rows go to the documents, where these are too many to be sent."""
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        plan = catalog.QUERIES["r4_hybrid_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
