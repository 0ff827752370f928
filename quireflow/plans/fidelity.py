"""Reports against their sources: copying, grounding, coverage, evidence; sentence chunks and key sentences.

The benchmark's items stand for reports. An item's source is the document with most of its
character 8-grams, so that an item is compared with one text and not with all at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions import text as X
from quireflow.operators.embedding import Embedder, closest, hashed_words
from quireflow.operators.shared_grams import shared_grams
from quireflow.plans.registry import query
from quireflow.session import table
from quireflow.sources.scratch import materialize

# Thresholds, quotas and word lists of the rules.
COPY_HIT, GROUNDED, COVERED, NEAR, STRAY = 0.6, 0.15, 0.55, 0.40, 0.35
COPY_COSINE, COPY_CHARS, FAR_LOW, FAR_HIGH, REPORT_CHARS = 0.85, 15, 0.65, 0.70, 100
KEY_SENTENCES, BUCKETS, CONCLUSIONS, SOURCE_SENTENCES = 12, 6, 4, 300
CONCLUSION_WORDS = ("conclusion", "in summary", "we propose", "we present", "we show", "we demonstrate", "in this paper we")
RESULT_WORDS = ("accuracy", "result", "performance", "improve", "experiment", "error")
ASSERTIVE = "clearly|proves|must"
VERBS = "achiev|reach|improv|that"
SIGNALS = (r"[0-9]+\.[0-9]+|[0-9]+\s*%|%\s*[0-9]+|\b[0-9]{2,}\b", r"\btable\s+[0-9]|\bfig(ure)?\.?\s*[0-9]", "accuracy|precision|recall|f1|bleu|perplexity|error|loss|result|performance")
BUDGET, BLOCKS, BLOCK_CHARS, PREFIX = 2400, 12, 320, 6
CHUNK, OVERLAP, PICKS = 600, 80, 8
RUN = 13


def squeezed(c: str | Column) -> Column:
    return F.regexp_replace(X.col(c), "\\s+", "")


def char_grams(c: Column, n: int) -> Column:
    """Distinct n-grams of a text without white space; a shorter one is its own gram."""
    return F.when(F.length(c) >= n, X.grams(c, n)).when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))


def share_in(grams: Column, text: Column) -> Column:
    """Share of the grams that a text contains."""
    return F.when(F.size(grams) > 0, F.size(F.filter(grams, lambda g: F.contains(text, g))) / F.size(grams)).otherwise(0.0)


def items(spark, sf) -> DataFrame:
    """Reports; those of every tenth item also have a Chinese sentence."""
    far = F.when(F.col("item_id") % 10 == 7, " 该方法在数据上达到更好的性能").otherwise("")
    return table(spark, sf, "benchmark").select("item_id", F.concat(F.coalesce("text", F.lit("")), far).alias("report"))


def docs_of(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def sources(spark, sf, n: int = 8) -> DataFrame:
    """item_id, grams, doc_id, shared: the document with most of an item's distinct n-grams, the smallest id of equal ones; none without a shared one.

    Documents' grams are looked up in the wanted ones inside the scan, by hashes and then by their
    characters, and only counts by (item, document) leave it. A report of fewer characters than n
    has no source.
    """
    own = materialize(items(spark, sf).select("item_id", char_grams(squeezed("report"), n).alias("g")), "grams")
    wanted = own.select("item_id", F.explode("g").alias("g")).where(F.length("g") == n)
    pairs = shared_grams(docs_of(spark, sf).select("doc_id", squeezed("text").alias("text")), wanted, n)
    best = pairs.groupBy("item_id").agg(F.max(F.struct("shared", (-F.col("doc_id")).alias("less"))).alias("m"))
    best = best.select("item_id", (-F.col("m.less")).alias("doc_id"), F.col("m.shared").alias("shared"))
    return own.select("item_id", F.size("g").cast("long").alias("grams")).join(best, "item_id", "left")


SQZ = r"regexp_replace({}, '\s+', '', 'g')"
SRC = rf"""i AS (SELECT item_id, report, {SQZ.format("report")} AS t FROM (SELECT item_id, coalesce(text, '') || CASE WHEN item_id % 10 = 7 THEN ' 该方法在数据上达到更好的性能' ELSE '' END AS report FROM benchmark)), dt AS (SELECT doc_id, coalesce(text, '') AS text, {SQZ.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT DISTINCT item_id, substr(t, k, 8) AS g FROM (SELECT item_id, t, unnest(range(1, greatest(length(t) - 6, 2))) AS k FROM i WHERE t <> '')),
dg AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, substr(t, k, 8) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 6)) AS k FROM dt WHERE length(t) >= 8)) WHERE g IN (SELECT g FROM g)),
pc AS (SELECT item_id, doc_id, count(*) AS shared FROM g JOIN dg USING (g) GROUP BY ALL), so AS (SELECT item_id, doc_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id) AS k FROM pc) WHERE k = 1),
n AS (SELECT i.item_id, count(g.g) AS grams FROM i LEFT JOIN g USING (item_id) GROUP BY 1)"""


@query("d7_copy_ratio", f"WITH {SRC} SELECT item_id, grams, doc_id, round(coalesce(shared * 1.0 / nullif(grams, 0), 0), 6) AS ratio FROM n LEFT JOIN so USING (item_id)")
def d7(spark, sf):
    """Share of an item's grams in the one document that has most of them."""
    ratio = F.when(F.col("grams") > 0, F.coalesce("shared", F.lit(0)) / F.col("grams")).otherwise(0.0)
    return sources(spark, sf).select("item_id", "grams", "doc_id", F.round(ratio, 6).alias("ratio"))


def paired(spark, sf) -> DataFrame:
    """item_id, report, doc_id, source (null without a source): one row for each item."""
    s = materialize(sources(spark, sf).select("item_id", "doc_id"), "sources")
    texts = docs_of(spark, sf).join(s.where("doc_id is not null").select("doc_id").distinct(), "doc_id").withColumnRenamed("text", "source")
    return items(spark, sf).join(s, "item_id").join(texts, "doc_id", "left")


def sentence_hits(spark, sf) -> DataFrame:
    """item_id, doc_id, source, sen: array of (pos, s, n, hit), the share of each sentence's grams that the source has."""
    p = paired(spark, sf).select("item_id", "doc_id", "source", X.once(squeezed(F.coalesce("source", F.lit("")))).alias("t"), X.once(X.sentences("report")).alias("s"))
    hit = F.transform("s", lambda s, k: F.struct((k + 1).cast("long").alias("pos"), s.alias("s"), F.length(s).cast("long").alias("n"), share_in(char_grams(squeezed(s), 8), F.col("t")).alias("hit")))
    return p.select("item_id", "doc_id", "source", X.once(hit).alias("sen"))


SENT = SRC + rf""", sen AS (SELECT item_id, pos, s FROM (SELECT item_id, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS pos FROM (SELECT item_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(report, '[.]([0-9])', chr(1) || '\1', 'g'), '[.!?\n。！？]+'), lambda x: replace(trim(x), chr(1), '.')), lambda x: x <> '') AS x FROM i))),
sg AS (SELECT DISTINCT item_id, pos, substr(q, k, 8) AS g FROM (SELECT item_id, pos, q, unnest(range(1, greatest(length(q) - 6, 2))) AS k FROM (SELECT item_id, pos, {SQZ.format('s')} AS q FROM sen))),
h AS (SELECT item_id, pos, avg(CASE WHEN contains(t, g) THEN 1.0 ELSE 0 END) AS hit FROM sg LEFT JOIN so USING (item_id) LEFT JOIN dt ON dt.doc_id = so.doc_id GROUP BY ALL),
r AS (SELECT item_id, pos, s, length(s) AS n, coalesce(hit, 0) AS hit FROM sen LEFT JOIN h USING (item_id, pos))"""


VECTORS = SENT + rf""", ss AS (SELECT item_id, j, s FROM (SELECT item_id, unnest(x) AS s, unnest(range(1, len(x) + 1)) AS j FROM (SELECT item_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[.]([0-9])', chr(1) || '\1', 'g'), '[.!?\n。！？]+'), lambda x: replace(trim(x), chr(1), '.')), lambda x: length(x) BETWEEN 6 AND 400)[1:300] AS x FROM so JOIN dt USING (doc_id)))),
wv AS (SELECT item_id, side, p, substr(md5(w), 1, 2) AS dim, count(*) AS c FROM (SELECT item_id, 'r' AS side, pos AS p, unnest(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')) AS w FROM sen UNION ALL SELECT item_id, 's', j, unnest(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}]+')) FROM ss) GROUP BY ALL),
nv AS (SELECT item_id, side, p, sum(c * c) AS q FROM wv GROUP BY ALL), dp AS (SELECT a.item_id, a.p, b.p AS j, sum(a.c * b.c) AS d FROM wv a JOIN wv b ON a.item_id = b.item_id AND a.dim = b.dim AND a.side = 'r' AND b.side = 's' GROUP BY ALL),
sm AS (SELECT dp.item_id, dp.p AS pos, max(round(d / sqrt(x.q * y.q), 9)) AS sim FROM dp JOIN nv x ON x.item_id = dp.item_id AND x.side = 'r' AND x.p = dp.p JOIN nv y ON y.item_id = dp.item_id AND y.side = 's' AND y.p = dp.j GROUP BY ALL),
has AS (SELECT DISTINCT item_id FROM ss), cn AS (SELECT so.item_id, len(regexp_extract_all(t, '[\x{{4e00}}-\x{{9fff}}]')) * 1.0::DOUBLE / greatest(length(t), 1) AS paper FROM so JOIN dt USING (doc_id)),
cl AS (SELECT r.*, CASE WHEN has.item_id IS NOT NULL THEN coalesce(sim, 0) END AS sim, coalesce(paper, 0) < 0.20 AND length({SQZ.format("s")}) > 0 AND len(regexp_extract_all(s, '[\x{{4e00}}-\x{{9fff}}]')) * 1.0::DOUBLE / greatest(length({SQZ.format("s")}), 1) >= 0.40 AS far,
  regexp_matches(lower(s), 'clearly|proves|must') OR (regexp_matches(s, '[0-9]') AND regexp_matches(lower(s), 'achiev|reach|improv|that')) AS bold FROM r LEFT JOIN sm USING (item_id, pos) LEFT JOIN has USING (item_id) LEFT JOIN cn USING (item_id)),
cf AS (SELECT *, hit >= 0.6 OR (coalesce(sim, 0) >= 0.85 AND n >= 15) AS copied FROM cl),
ct AS (SELECT *, CASE WHEN copied OR sim IS NULL THEN 'none' WHEN sim >= 0.40 AND (far OR hit >= 0.15) THEN 'grounded' WHEN bold AND (sim >= 0.40 OR sim < 0.35) THEN 'stray' ELSE 'none' END AS kind FROM cf)"""


def compared(spark, sf, embedder: Embedder = hashed_words) -> DataFrame:
    """item_id, report, sen: array of (pos, s, n, hit, sim, copied, far, kind) of an item's sentences against the first 300 of 6 to 400 characters of its source.

    sim is the highest cosine of the embedder's vectors. A sentence is copied by its grams, or at a
    cosine of .85 from 15 characters on; others are grounded at .40 with some shared grams, or
    without where they are Chinese and the source isn't; assertive ones that are neither are stray.
    """
    own = F.slice(F.filter(X.sentences("source"), lambda x: F.length(x).between(6, 400)), 1, SOURCE_SENTENCES)
    rows = sentence_hits(spark, sf).withColumn("own", own).withColumn("texts", F.transform("sen", lambda x: x["s"]))
    rows = closest(rows, "texts", "own", embedder).drop("own", "texts")
    chinese = lambda c: F.regexp_count(c, F.lit("[\\x{4e00}-\\x{9fff}]"))
    plain = squeezed(F.coalesce("source", F.lit("")))
    rows = rows.withColumn("foreign", chinese(plain) / F.greatest(F.length(plain), F.lit(1)) < 0.20)

    def judged(x: Column, i: Column) -> Column:
        sim = F.get("sims", i)
        copied = (x["hit"] >= COPY_HIT) | ((F.coalesce(sim, F.lit(0.0)) >= COPY_COSINE) & (x["n"] >= COPY_CHARS))
        size = F.length(squeezed(x["s"]))
        far = F.col("foreign") & (size > 0) & (chinese(x["s"]) / F.greatest(size, F.lit(1)) >= 0.40)
        grounded = (sim >= NEAR) & (far | (x["hit"] >= GROUNDED))
        stray = assertive(x["s"]) & ((sim >= NEAR) | (sim < STRAY))
        kind = F.when(copied | sim.isNull(), "none").when(grounded, "grounded").when(stray, "stray").otherwise("none")
        return F.struct(x["pos"].alias("pos"), x["s"].alias("s"), x["n"].alias("n"), x["hit"].alias("hit"), sim.alias("sim"), copied.alias("copied"), far.alias("far"), kind.alias("kind"))

    return rows.select("item_id", "doc_id", "source", F.transform("sen", judged).alias("sen"))


@query("d8_copied_sentences", f"WITH {VECTORS} SELECT item_id, pos, copied, coalesce(sim, 0) AS sim FROM cf")
def d8(spark, sf):
    """Sentences whose grams mostly stand in the source, or whose vector is that close to one of its sentences."""
    return compared(spark, sf).select("item_id", F.inline("sen")).select("item_id", "pos", "copied", F.coalesce("sim", F.lit(0.0)).alias("sim"))


@query("d9_fidelity", f"""WITH {VECTORS}, t AS (SELECT item_id, sum(n) AS total, coalesce(sum(n) FILTER (WHERE kind = 'grounded'), 0) * 1.0::DOUBLE / sum(n) AS grounded, coalesce(sum(n) FILTER (WHERE copied), 0) * 1.0::DOUBLE / sum(n) AS copy, coalesce(sum(n) FILTER (WHERE kind = 'stray'), 0) * 1.0::DOUBLE / sum(n) AS stray, bool_or(far) AS far, max(sim) FILTER (WHERE far) AS best FROM ct GROUP BY 1)
SELECT i.item_id, CASE WHEN length(trim(report)) < 100 OR t.item_id IS NULL THEN 'too_short' WHEN has.item_id IS NULL THEN 'no_paper' ELSE 'ok' END AS status, CASE WHEN status = 'ok' THEN round(grounded, 3) END AS grounded, CASE WHEN status = 'ok' THEN round(copy, 3) END AS copied,
CASE WHEN status = 'ok' THEN round(greatest(0, round(grounded - copy - CASE WHEN NOT far THEN 0 WHEN coalesce(best, 0) < 0.65 THEN greatest(stray, 0.50) WHEN best < 0.70 THEN greatest(stray, CASE WHEN stray = 0 THEN 0.15 ELSE 0.25 END) ELSE stray END, 9)), 3) END AS fidelity FROM i LEFT JOIN t USING (item_id) LEFT JOIN has USING (item_id)""")
def d9(spark, sf):
    """Length-weighted grounded share less the copied one; with Chinese sentences about a foreign source also less a penalty by their best cosine and by stray ones."""
    r = compared(spark, sf).withColumn("all", F.aggregate("sen", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    share = lambda test: F.aggregate(F.filter("sen", test), F.lit(0).cast("long"), lambda a, x: a + x["n"]) / F.col("all")
    r = r.select("item_id", "all", share(lambda x: x["kind"] == "grounded").alias("g"), share(lambda x: x["copied"]).alias("c"), share(lambda x: x["kind"] == "stray").alias("stray"), F.exists("sen", lambda x: x["far"]).alias("far"), F.array_max(F.transform(F.filter("sen", lambda x: x["far"]), lambda x: x["sim"])).alias("best"), F.exists("sen", lambda x: x["sim"].isNotNull()).alias("has"))
    best = F.coalesce("best", F.lit(0.0))
    doubt = F.when(best < FAR_LOW, F.greatest("stray", F.lit(0.50))).when(best < FAR_HIGH, F.greatest("stray", F.when(F.col("stray") == 0, 0.15).otherwise(0.25))).otherwise(F.col("stray"))
    value = F.greatest(F.lit(0.0), F.round(F.col("g") - F.col("c") - F.when(F.col("far"), doubt).otherwise(0.0), 9))
    both = items(spark, sf).join(r, "item_id", "left")
    status = F.when((F.length(F.trim("report")) < REPORT_CHARS) | F.coalesce(F.col("all") == 0, F.lit(True)), "too_short").when(~F.coalesce("has", F.lit(False)), "no_paper").otherwise("ok")
    told = lambda c: F.when(F.col("status") == "ok", F.round(c, 3))
    return both.withColumn("status", status).select("item_id", "status", told(F.col("g")).alias("grounded"), told(F.col("c")).alias("copied"), told(value).alias("fidelity"))


def assertive(s: Column) -> Column:
    low = F.lower(s)
    return low.rlike(ASSERTIVE) | (s.rlike("[0-9]") & low.rlike(VERBS))


def bigrams(s: Column) -> Column:
    return char_grams(squeezed(s), 2)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of bigrams, zero if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.round(X.jaccard(a, b), 6))


def taken(start: Column, more: Column, limit: Column | int) -> Column:
    """start and those of `more` whose key is new, in order, up to `limit` in all."""
    new = lambda a, x: (F.size(a) < limit) & ~F.exists(a, lambda y: y["key"] == x["key"])
    return F.aggregate(more, start, lambda a, x: F.when(new(a, x), F.array_append(a, x)).otherwise(a))


def key_sentences(df: DataFrame, text: str, name: str = "keys") -> DataFrame:
    """Add an array of at most 12 key sentences (i, key, s, concl, signal) of a text, all inside its row.

    Sentences of 20 to 400 characters: the first 3; up to 4 with a conclusion word in the second
    half; of 6 position buckets the one with the strongest result signal each; then in order.
    """
    low = lambda s: F.lower(s)
    signal = lambda s: F.when(F.contains(s, F.lit("%")), 2).otherwise(0) + F.when(low(s).rlike("|".join(RESULT_WORDS)), 1).otherwise(0)
    long = F.filter(X.sentences(text), lambda s: F.length(s).between(20, 400))
    described = F.transform(long, lambda s, i: F.struct(i.alias("i"), F.lower(F.substring(s, 1, 80)).alias("key"), s.alias("s"), low(s).rlike("|".join(CONCLUSION_WORDS)).alias("concl"), signal(s).alias("signal")))
    rest = [c for c in df.columns if c != name]
    d = df.select(*rest, X.once(described).alias("__all"))
    every, n = F.col("__all"), F.size("__all")
    d = d.select(*rest, "__all", X.once(taken(F.slice(every, 1, 0), F.slice(every, 1, 3), KEY_SENTENCES)).alias("__a"))
    half = F.filter(every, lambda x: (x["i"] >= F.floor(n / 2)) & x["concl"])
    d = d.select(*rest, "__all", X.once(taken(F.col("__a"), half, F.least(F.size("__a") + CONCLUSIONS, F.lit(KEY_SENTENCES)))).alias("__a"))
    size = F.greatest(F.floor(n / BUCKETS), F.lit(1))
    bucket = lambda x: F.least(F.floor(x["i"] / size), F.lit(BUCKETS - 1))

    def strongest(b):
        own = F.filter(every, lambda x: (bucket(x) == b) & (x["signal"] > 0))
        return F.array_min(F.transform(own, lambda x: F.struct((-x["signal"]).alias("less"), x["i"].alias("i"), x.alias("x"))))["x"]

    d = d.select(*rest, "__all", X.once(taken(F.col("__a"), F.filter(F.array(*map(strongest, range(BUCKETS))), lambda x: x.isNotNull()), KEY_SENTENCES)).alias("__a"))
    return d.select(*rest, X.once(taken(F.col("__a"), every, KEY_SENTENCES)).alias(name))


KEYS = r"""ks AS (SELECT id, i, s, n, lower(substr(s, 1, 80)) AS key, regexp_matches(lower(s), 'conclusion|in summary|we propose|we present|we show|we demonstrate|in this paper we') AS concl,
  CASE WHEN contains(s, '%') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(lower(s), 'accuracy|result|performance|improve|experiment|error') THEN 1 ELSE 0 END AS signal
  FROM (SELECT id, unnest(x) AS s, unnest(range(len(x))) AS i, len(x) AS n FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[.]([0-9])', chr(1) || '\1', 'g'), '[.!?\n。！？]+'), lambda x: replace(trim(x), chr(1), '.')), lambda x: length(x) BETWEEN 20 AND 400) AS x FROM kt))),
p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS q FROM (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY i) AS d FROM ks a WHERE i >= n // 2 AND concl AND NOT EXISTS (SELECT 1 FROM ks b WHERE b.id = a.id AND b.i < 3 AND b.key = a.key)) WHERE d = 1) WHERE q <= 4),
p3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, least(i // greatest(n // 6, 1), 5) ORDER BY signal DESC, i) AS q FROM ks WHERE signal > 0) WHERE q = 1),
pa AS (SELECT id, 1 AS p, i, key, s FROM ks WHERE i < 3 UNION ALL SELECT id, 2, i, key, s FROM p2 UNION ALL SELECT id, 3, i, key, s FROM p3 UNION ALL SELECT id, 4, i, key, s FROM ks),
kp AS (SELECT id, i, s, k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, i) AS k FROM (SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY p, i) AS d FROM pa) WHERE d = 1) WHERE k <= 12)"""


@query("w11_key_sentences", f"WITH kt AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {KEYS} SELECT id AS doc_id, k AS rank, i AS pos, sha256(s) AS sentence FROM kp")
def w11(spark, sf):
    k = key_sentences(docs_of(spark, sf), "text").select("doc_id", F.posexplode("keys").alias("k", "x"))
    return k.select("doc_id", (F.col("k") + 1).cast("long").alias("rank"), F.col("x.i").cast("long").alias("pos"), F.sha2("x.s", 256).alias("sentence"))


BG = rf"CASE WHEN length({SQZ.format('{0}')}) >= 2 THEN list_distinct(list_transform(range(1, length({SQZ.format('{0}')})), lambda k: substr({SQZ.format('{0}')}, k, 2))) ELSE [{SQZ.format('{0}')}] END"
JAC = "round(len(list_intersect({0}, {1})) * 1.0 / len(list_distinct(list_concat({0}, {1}))), 6)"


@query("d10_coverage", f"""WITH {SENT}, kt AS (SELECT doc_id AS id, text FROM dt WHERE doc_id IN (SELECT doc_id FROM so)), {KEYS},
kb AS (SELECT so.item_id, k, {BG.format('s')} AS x FROM so JOIN kp ON kp.id = so.doc_id), rb AS (SELECT item_id, pos, hit, {BG.format('s')} AS y FROM r),
m AS (SELECT item_id, k, max({{'sim': {JAC.format('x', 'y')}, 'less': -pos, 'copied': hit >= 0.6}}) AS m FROM kb JOIN rb USING (item_id) GROUP BY ALL)
SELECT item_id, count(k) AS key_sentences, count(*) FILTER (WHERE m.sim >= 0.55 AND NOT m.copied) AS covered FROM i LEFT JOIN m USING (item_id) GROUP BY 1""")
def d10(spark, sf):
    """Key sentences of the source whose closest report sentence is similar enough (bigrams) and isn't copied."""
    s = key_sentences(sentence_hits(spark, sf).withColumn("source", F.coalesce("source", F.lit(""))), "source")
    rows = F.transform("sen", lambda x: F.struct(x["pos"].alias("pos"), (x["hit"] >= COPY_HIT).alias("copied"), bigrams(x["s"]).alias("b")))
    s = s.select("item_id", X.once(rows).alias("r"), X.once(F.transform("keys", lambda k: bigrams(k["s"]))).alias("k"))
    best = F.transform("k", lambda k: F.array_max(F.transform("r", lambda x: F.struct(overlap(k, x["b"]).alias("sim"), (-x["pos"]).alias("less"), x["copied"].alias("copied")))))
    s = s.select("item_id", X.once(F.filter(best, lambda b: b.isNotNull())).alias("b"))
    return s.select("item_id", F.size("b").cast("long").alias("key_sentences"), F.size(F.filter("b", lambda b: (b["sim"] >= COVERED) & ~b["copied"])).cast("long").alias("covered"))


def next_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, pos, overlap of each sentence's bigrams with the next one's, from doc_id and s; bigrams are numbers of two code points."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            sizes = pc.list_value_length(batch.column("s")).to_numpy(zero_copy_only=False)
            texts = batch.column("s").flatten().to_pylist()
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
            own = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            black = ~np.isin(points, [9, 10, 11, 12, 13, 32])
            points, own = points[black], own[black]
            two = own[1:] == own[:-1]
            alone = np.bincount(own, minlength=len(texts))[own] == 1
            sentence = np.r_[own[:-1][two], own[alone]]
            gram = np.r_[(points[:-1] << 21 | points[1:])[two], points[alone] - (1 << 21)]
            order = np.lexsort((gram, sentence))
            sentence, gram = sentence[order], gram[order]
            new = np.r_[True, (sentence[1:] != sentence[:-1]) | (gram[1:] != gram[:-1])][: len(gram)]
            sentence, gram = sentence[new], gram[new]
            n = np.bincount(sentence, minlength=len(texts))
            place = np.r_[sentence, sentence - 1]  # grams of the next sentence stand at this one's place
            both = np.r_[gram, gram]
            order = np.lexsort((both, place))
            place, both = place[order], both[order]
            twice = (place[1:] == place[:-1]) & (both[1:] == both[:-1])
            shared = np.bincount(place[1:][twice], minlength=len(texts))
            ends = np.cumsum(sizes)
            first = np.ones(len(texts), bool)
            first[ends[sizes > 0] - 1] = False
            here = np.flatnonzero(first)  # every sentence but its document's last
            either = n[here] + n[here + 1] - shared[here]
            value = np.where(np.minimum(n[here], n[here + 1]) > 0, shared[here] / np.maximum(either, 1), 0.0)
            row = np.repeat(np.arange(len(sizes)), sizes)[here]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(here - (ends - sizes)[row] + 1), pa.array(value)], names=["doc_id", "pos", "overlap"])


@query("d11_bigram_overlap", f"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[.]([0-9])', chr(1) || '\\1', 'g'), '[.!?\\n。！？]+'), lambda x: replace(trim(x), chr(1), '.')), lambda x: x <> '') AS x FROM documents), p AS (SELECT doc_id, unnest(range(1, len(x))) AS pos, x FROM s), b AS (SELECT doc_id, pos, {BG.format('x[pos]')} AS a, {BG.format('x[pos + 1]')} AS b FROM p) SELECT doc_id, pos, {JAC.format('a', 'b')} AS overlap FROM b")
def d11(spark, sf):
    """Bigram overlap of every sentence with the next one of its document."""
    found = docs_of(spark, sf).select("doc_id", X.sentences("text").alias("s")).mapInArrow(next_overlaps, "doc_id long, pos long, overlap double")
    return found.select("doc_id", "pos", F.round("overlap", 6).alias("overlap"))


@query("d12_snippet_grounded", f"WITH {SRC}, s6 AS (SELECT DISTINCT item_id, substr(t, k, 6) AS g FROM (SELECT item_id, t, unnest(range(1, greatest(length(t) - 4, 2))) AS k FROM i WHERE t <> '')), h AS (SELECT item_id, avg(CASE WHEN contains(dt.t, s6.g) THEN 1.0 ELSE 0 END) AS hit FROM s6 LEFT JOIN so USING (item_id) LEFT JOIN dt ON dt.doc_id = so.doc_id GROUP BY 1) SELECT item_id, coalesce(hit, 0) >= 0.6 AS grounded FROM i LEFT JOIN h USING (item_id)")
def d12(spark, sf):
    """Whether three fifths of an item's 6-grams stand in its source."""
    p = paired(spark, sf).select("item_id", X.once(squeezed(F.coalesce("source", F.lit("")))).alias("t"), X.once(char_grams(squeezed("report"), 6)).alias("g"))
    return p.select("item_id", (share_in(F.col("g"), F.col("t")) >= 0.6).alias("grounded"))


WORDS = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
RUNS = "(SELECT DISTINCT {0}, array_to_string(w[k:k + {1}], ' ') AS g FROM (SELECT {0}, w, unnest(range(1, len(w) - {1} + 1)) AS k FROM {2}))"


@query("d16_leakage_report", f"""WITH bw AS (SELECT item_id, {WORDS} AS w FROM benchmark), dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
ip AS {RUNS.format('item_id', 12, 'bw')}, dp AS (SELECT * FROM {RUNS.format('doc_id', 12, 'dw')} WHERE g IN (SELECT g FROM ip)), i5 AS {RUNS.format('item_id', 4, 'bw')}, d5 AS {RUNS.format('doc_id', 4, 'dw')},
ni AS (SELECT item_id, count(*) AS n FROM i5 GROUP BY 1), nd AS (SELECT doc_id, count(*) AS n FROM d5 GROUP BY 1), k5 AS (SELECT item_id, doc_id, count(*) AS k FROM i5 JOIN d5 USING (g) GROUP BY ALL),
near AS (SELECT item_id, count(*) AS near FROM k5 JOIN ni USING (item_id) JOIN nd USING (doc_id) WHERE k * 1.0 / (ni.n + nd.n - k) >= 0.55 GROUP BY 1), ps AS (SELECT item_id, count(DISTINCT doc_id) AS passage FROM ip JOIN dp USING (g) GROUP BY 1),
ex AS (SELECT b.item_id, count(*) AS exact FROM benchmark b JOIN documents d ON d.text = b.text GROUP BY 1)
SELECT item_id, coalesce(exact, 0) AS exact, coalesce(near, 0) AS near, coalesce(passage, 0) AS passage FROM benchmark LEFT JOIN ex USING (item_id) LEFT JOIN near USING (item_id) LEFT JOIN ps USING (item_id)""")
def d16(spark, sf):
    """Held-out items against the corpus: documents with equal text, with a five-word Jaccard similarity of .55 or more, and with any 13 words of the item in a row.

    Only runs that some item has leave the documents' scan; documents count once for an item.
    """
    words = lambda c: F.split(X.normalize(F.coalesce(X.col(c), F.lit(""))), " ")
    b = items(spark, sf).select("item_id", X.once(words("report")).alias("w"))
    d = docs_of(spark, sf).select("doc_id", X.once(words("text")).alias("w"))
    runs = lambda df, key, n: df.select(key, X.once(X.word_runs(F.col("w"), n)).alias("r")).select(key, F.size("r").alias(f"n_{key}"), F.explode("r").alias("r")).select(key, f"n_{key}", F.xxhash64("r").alias("g"))

    def pairs(n):
        own = materialize(runs(b, "item_id", n), "runs")
        return runs(d, "doc_id", n).join(own, "g").groupBy("item_id", "doc_id", "n_item_id", "n_doc_id").agg(F.count(F.lit(1)).alias("k"))

    union = F.col("n_item_id") + F.col("n_doc_id") - F.col("k")
    near = pairs(5).where(F.col("k") / union >= 0.55).groupBy("item_id").agg(F.count(F.lit(1)).alias("near"))
    passage = pairs(RUN).groupBy("item_id").agg(F.count(F.lit(1)).alias("passage"))
    held = table(spark, sf, "benchmark").select("item_id", F.sha2("text", 256).alias("h"))
    exact = table(spark, sf, "documents").select(F.sha2("text", 256).alias("h")).join(held, "h").groupBy("item_id").agg(F.count(F.lit(1)).alias("exact"))
    out = items(spark, sf).select("item_id").join(exact, "item_id", "left").join(near, "item_id", "left").join(passage, "item_id", "left")
    return out.na.fill(0, ["exact", "near", "passage"])


def sentence_chunks(text: Column, size: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Chunks of whole sentences, at most `size` characters each; a longer sentence is cut with an overlap and starts anew after it."""
    t = F.regexp_replace(text, "^\\s+|\\s+$", "")
    parts = F.filter(F.split(t, "(?<=[。！？.!?])\\s*"), lambda s: s != "")
    empty = F.array().cast("array<string>")
    closed = lambda a: F.when(a["buf"] != "", F.array_append(a["done"], a["buf"])).otherwise(a["done"])
    hard = lambda s: F.transform(F.sequence(F.lit(1), F.length(s), F.lit(size - overlap)), lambda i: s.substr(i, F.lit(size)))

    def step(a, s):
        fits = F.length(a["buf"]) + F.length(s) <= size
        return (
            F.when(fits, F.struct(a["done"].alias("done"), F.concat(a["buf"], s).alias("buf")))
            .when(F.length(s) > size, F.struct(F.concat(closed(a), hard(s)).alias("done"), F.lit("").alias("buf")))
            .otherwise(F.struct(closed(a).alias("done"), s.alias("buf")))
        )

    packed = F.aggregate(parts, F.struct(empty.alias("done"), F.lit("").alias("buf")), step, closed)
    chunks = F.when(F.length(t) <= size, F.array(t)).otherwise(packed)
    return F.filter(F.transform(chunks, lambda c: F.regexp_replace(c, "^\\s+|\\s+$", "")), lambda c: c != "")


CHUNKS = rf"""ct AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents), cs AS (SELECT doc_id, t, list_filter(list_transform(regexp_extract_all(t, '[^。！？.!?]*[。！？.!?]|[^。！？.!?]+$'), lambda x: regexp_replace(x, '^\s+', '')), lambda x: x <> '') AS x FROM ct WHERE length(t) > {CHUNK}),
RECURSIVE_ AS (SELECT doc_id, 0 AS k, ''::VARCHAR AS buf, []::VARCHAR[] AS done FROM cs UNION ALL
 SELECT doc_id, k + 1, CASE WHEN length(buf) + length(s) <= {CHUNK} THEN buf || s WHEN length(s) > {CHUNK} THEN '' ELSE s END,
  CASE WHEN length(buf) + length(s) <= {CHUNK} THEN [] ELSE CASE WHEN buf <> '' THEN [buf] ELSE [] END || CASE WHEN length(s) > {CHUNK} THEN list_transform(range(1, length(s) + 1, {CHUNK - OVERLAP}), lambda p: substr(s, p, {CHUNK})) ELSE [] END END
 FROM (SELECT a.doc_id, k, buf, x[k + 1] AS s FROM RECURSIVE_ a JOIN cs USING (doc_id) WHERE k < len(x))),
cl AS (SELECT doc_id, t, k, unnest(done) AS c, unnest(range(len(done))) AS o FROM RECURSIVE_ JOIN cs USING (doc_id) UNION ALL SELECT doc_id, t, k + 1, buf, 0 FROM RECURSIVE_ JOIN cs USING (doc_id) WHERE k = len(x) UNION ALL SELECT doc_id, t, 0, t, 0 FROM ct WHERE length(t) <= {CHUNK}),
ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, o) - 1 AS chunk, c FROM (SELECT doc_id, k, o, regexp_replace(c, '^\s+|\s+$', '', 'g') AS c FROM cl) WHERE c <> '')""".replace("RECURSIVE_", "rc")


@query("s8_sentence_chunks", f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk, length(c) AS chars, sha256(c) AS digest FROM ch")
def s8(spark, sf):
    """Sentence-packed chunks, folded inside a document's row."""
    c = docs_of(spark, sf).select("doc_id", F.posexplode(sentence_chunks(F.col("text"))).alias("k", "c"))
    return c.select("doc_id", F.col("k").cast("long").alias("chunk"), F.length("c").cast("long").alias("chars"), F.sha2("c", 256).alias("digest"))


def signal_of(c: Column) -> Column:
    low = F.lower(c)
    return sum((F.when(low.rlike(p), 1).otherwise(0) for p in SIGNALS), F.lit(0))


def picked(df: DataFrame, k: int = PICKS) -> DataFrame:
    """Greedy choice of k chunks in a row: twice the evidence signal plus the distance to the nearest chosen one; of equal scores the first."""
    d = df.select("doc_id", X.once(F.transform("c", signal_of)).alias("g"))
    n = F.size("g")

    def choose(sel, _):
        far = lambda i: F.when(F.size(sel) == 0, 1.0).otherwise(F.array_min(F.transform(sel, lambda j: F.round(F.abs(i - j) / n, 9))))
        free = F.filter(F.transform("g", lambda g, i: F.struct((2.0 * g + far(i)).alias("score"), (-i).alias("less"))), lambda x: ~F.array_contains(sel, -x["less"]))
        return F.array_append(sel, -F.array_max(free)["less"])

    steps = F.sequence(F.lit(1), F.least(n, F.lit(k)))
    chosen = F.when(n > 0, F.aggregate(steps, F.array().cast("array<int>"), choose)).otherwise(F.array().cast("array<int>"))
    return d.select("doc_id", "g", X.once(F.array_sort(chosen)).alias("sel"))


def _picks_sql(k: int) -> str:
    flag = " + ".join(f"CASE WHEN regexp_matches(lower(c), '{p}') THEN 1 ELSE 0 END" for p in SIGNALS)
    out = f"gg AS (SELECT doc_id, chunk AS i, {flag} AS g, count(*) OVER (PARTITION BY doc_id) AS n FROM ch), w0 AS (SELECT DISTINCT doc_id, []::BIGINT[] AS sel FROM gg)"
    for s in range(k):
        far = f"CASE WHEN len(sel) = 0 THEN 1.0 ELSE list_min(list_transform(sel, lambda j: round(abs(i - j) * 1.0 / n, 9))) END"
        out += f", w{s + 1} AS (SELECT doc_id, list_append(any_value(sel), -(max({{'score': 2.0 * g + {far}, 'less': -i}}).less)) AS sel FROM gg JOIN w{s} USING (doc_id) WHERE NOT list_contains(sel, i) GROUP BY doc_id UNION ALL SELECT doc_id, sel FROM w{s} WHERE len(sel) = (SELECT max(n) FROM gg WHERE gg.doc_id = w{s}.doc_id))"
    return out


@query("w12_diverse_chunks", f"WITH RECURSIVE {CHUNKS}, {_picks_sql(PICKS)} SELECT s.doc_id, s.i AS chunk, CAST(g AS BIGINT) AS signal FROM (SELECT doc_id, unnest(sel) AS i FROM w{PICKS}) s JOIN gg ON gg.doc_id = s.doc_id AND gg.i = s.i")
def w12(spark, sf):
    """Chunks that are strong in evidence and far apart, chosen inside a document's row."""
    c = docs_of(spark, sf).select("doc_id", X.once(sentence_chunks(F.col("text"))).alias("c"))
    return picked(c).select("doc_id", "g", F.explode("sel").alias("i")).select("doc_id", F.col("i").cast("long").alias("chunk"), F.get("g", F.col("i")).cast("long").alias("signal"))


PACK = rf"""{SENT}, ds AS (SELECT item_id, unnest(x) AS s, unnest(range(len(x))) AS j FROM (SELECT item_id, list_slice(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[.]([0-9])', chr(1) || '\1', 'g'), '[.!?\n。！？]+'), lambda x: replace(trim(x), chr(1), '.')), lambda x: length(x) BETWEEN 6 AND 400), 1, 300) AS x FROM so JOIN dt USING (doc_id))),
db AS (SELECT item_id, j, length(s) AS n, {BG.format('s')} AS y FROM ds), rb AS (SELECT item_id, pos, s, hit, {BG.format('s')} AS x FROM r WHERE n >= 8),
b AS (SELECT item_id, pos, s, hit, max({{'sim': {JAC.format('x', 'y')}, 'less': -j}}) AS m FROM rb JOIN db USING (item_id) GROUP BY ALL),
ca AS (SELECT item_id, pos, m.sim AS sim, -m.less AS j, CASE WHEN NOT a THEN 2 WHEN m.sim < 0.35 THEN 0 ELSE 1 END AS p FROM (SELECT *, regexp_matches(lower(s), 'clearly|proves|must') OR (regexp_matches(s, '[0-9]') AND regexp_matches(lower(s), 'achiev|reach|improv|that')) AS a FROM b) WHERE hit < 0.6),
co AS (SELECT ca.item_id, ca.j, least(n, 320) + 6 AS cost, row_number() OVER (PARTITION BY ca.item_id ORDER BY p, CASE WHEN p = 0 THEN sim ELSE -sim END, pos) AS k FROM ca JOIN db USING (item_id, j)),
gr AS (SELECT DISTINCT item_id, 0::BIGINT AS k, 0::BIGINT AS used, []::BIGINT[] AS sel FROM co UNION ALL
 SELECT gr.item_id, gr.k + 1, CASE WHEN ok THEN used + cost ELSE used END, CASE WHEN ok THEN list_append(sel, j) ELSE sel END FROM (SELECT gr.*, co.j, co.cost, len(sel) < 12 AND NOT list_contains(sel, co.j) AND used + co.cost <= 2400 AS ok FROM gr JOIN co ON co.item_id = gr.item_id AND co.k = gr.k + 1) gr),
la AS (SELECT item_id, unnest(arg_max(sel, k)) AS j FROM gr GROUP BY 1), il AS (SELECT item_id, j, j - row_number() OVER (PARTITION BY item_id ORDER BY j) AS h FROM la)
SELECT item_id, min(il.j) AS first_pos, count(*) AS sentences, sum(n) + count(*) - 1 AS chars FROM il JOIN db USING (item_id, j) GROUP BY item_id, h"""


@query("w14_evidence_pack", f"WITH RECURSIVE {PACK}")
def w14(spark, sf):
    """Source sentences for a report within a budget of characters, adjacent ones as one block.

    For each report sentence (8 characters or more, not copied) its closest source sentence;
    unsupported assertive sentences first, then assertive ones, then the rest, by similarity;
    what doesn't fit is skipped and the next tried. All inside an item's row.
    """
    s = sentence_hits(spark, sf).where("source is not null")
    own = F.slice(F.filter(X.sentences("source"), lambda x: F.length(x).between(6, 400)), 1, SOURCE_SENTENCES)
    s = s.select("item_id", "sen", X.once(F.transform(own, lambda x, j: F.struct(j.alias("j"), F.length(x).alias("n"), bigrams(x).alias("b")))).alias("src"))
    rows = F.filter("sen", lambda x: (x["n"] >= 8) & (x["hit"] < COPY_HIT))
    s = s.select("item_id", "src", X.once(F.transform(rows, lambda x: F.struct(x["pos"].alias("pos"), assertive(x["s"]).alias("a"), bigrams(x["s"]).alias("b")))).alias("rows"))
    close = lambda x: F.array_max(F.transform("src", lambda y: F.struct(overlap(x["b"], y["b"]).alias("sim"), (-y["j"]).alias("less"))))
    s = s.where(F.size("src") > 0).select("item_id", "src", X.once(F.transform("rows", lambda x: F.struct(x["pos"].alias("pos"), x["a"].alias("a"), close(x).alias("m")))).alias("c"))
    rank = lambda c: F.when(~c["a"], 2).when(c["m"]["sim"] < STRAY, 0).otherwise(1)
    order = F.array_sort(F.transform("c", lambda c: F.struct(rank(c).alias("p"), F.when(rank(c) == 0, c["m"]["sim"]).otherwise(-c["m"]["sim"]).alias("by"), c["pos"].alias("pos"), (-c["m"]["less"]).alias("j"))))
    s = s.select("item_id", "src", X.once(order).alias("c"))

    def pack(a, c):
        cost = F.least(F.get("src", c["j"])["n"], F.lit(BLOCK_CHARS)) + PREFIX
        ok = (F.size(a["sel"]) < BLOCKS) & ~F.array_contains(a["sel"], c["j"]) & (a["used"] + cost <= BUDGET)
        return F.when(ok, F.struct(F.array_append(a["sel"], c["j"]).alias("sel"), (a["used"] + cost).alias("used"))).otherwise(a)

    start = F.struct(F.array().cast("array<int>").alias("sel"), F.lit(0).alias("used"))
    s = s.select("item_id", "src", X.once(F.array_sort(F.aggregate("c", start, pack, lambda a: a["sel"]))).alias("sel"))
    one = s.select("item_id", F.posexplode("sel").alias("k", "j"), "src").select("item_id", "j", (F.col("j") - F.col("k")).alias("island"), F.get("src", F.col("j"))["n"].alias("n"))
    return one.groupBy("item_id", "island").agg(F.min("j").cast("long").alias("first_pos"), F.count(F.lit(1)).alias("sentences"), (F.sum("n") + F.count(F.lit(1)) - 1).alias("chars")).drop("island")
