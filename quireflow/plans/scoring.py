"""Score analytics, agreement, calibration (K)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import text as X
from quireflow.operators.ranking import global_ranks, rank_within
from quireflow.plans.library import VERDICT, largest_remainder, verdict
from quireflow.plans.registry import query
from quireflow.session import dealt, table
from quireflow.sources.scratch import materialize


def n_rows():
    return F.count(F.lit(1))


def rnd(c, digits=6):
    return F.round(c, digits)


def li_of(spark, sf):
    return table(spark, sf, "lineitem")


#: Scores of labelled documents: the length relative to 5000, and whether people accepted.
S = "s AS (SELECT l.doc_id, least(n_chars / 5000.0::DOUBLE, 1.0) AS score, quality AS human, source FROM labels l JOIN documents d USING (doc_id))"


def scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("score"))
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("human")).join(d, "doc_id")


def kappa_of(a, b, c, d):
    """Binary Cohen's kappa from the four counts; 0 where chance agreement is complete."""
    n = a + b + c + d
    po, pe = (a + d) / n, ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n)
    return F.when(pe >= 1, 0.0).otherwise((po - pe) / (1 - pe))


def confusion(df: DataFrame, said, truth, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn of a boolean column against a 0/1 truth."""
    t = truth == 1
    return df.groupBy(*by).agg(F.count_if(said & t).alias("tp"), F.count_if(said & ~t).alias("fp"), F.count_if(~said & t).alias("fn"), F.count_if(~said & ~t).alias("tn"))


CONF = "CAST(count(*) FILTER (WHERE {0} AND human = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE {0} AND human = 0) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE NOT {0} AND human = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE NOT {0} AND human = 0) AS BIGINT) AS tn"
KAPPA = "CASE WHEN ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) * 1.0::DOUBLE / ((tp + fp + fn + tn) * (tp + fp + fn + tn)) >= 1 THEN 0 ELSE ((tp + tn) * 1.0::DOUBLE / (tp + fp + fn + tn) - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) * 1.0::DOUBLE / ((tp + fp + fn + tn) * (tp + fp + fn + tn))) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) * 1.0::DOUBLE / ((tp + fp + fn + tn) * (tp + fp + fn + tn))) END"

#: Weights of the review dimensions by paper type, and the confidence below which they blend.
TYPE_WEIGHTS = {"A": (0.50, 0.20, 0.15, 0.15), "B": (0.25, 0.45, 0.15, 0.15), "C": (0.20, 0.25, 0.30, 0.25), "D": (0.30, 0.25, 0.20, 0.25)}
ELASTIC = 0.8
OTHERS = {t: tuple(sum(w[k] for o, w in TYPE_WEIGHTS.items() if o != t) / 3 for k in range(4)) for t in TYPE_WEIGHTS}
TW = " UNION ALL ".join(f"SELECT '{t}' AS t, {', '.join(f'{x}::DOUBLE AS w{k}, {OTHERS[t][k]!r}::DOUBLE AS o{k}' for k, x in enumerate(w))}" for t, w in TYPE_WEIGHTS.items())


K1_BASE = " + ".join(f"(least(1, conf / 0.8) * w{k} + (1 - least(1, conf / 0.8)) * o{k}) * d{k}" for k in range(4))


@query("k1_type_weighted_score", f"""WITH w AS ({TW}), i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['A', 'B', 'C', 'D'][(l_suppkey % 4)::INT + 1] AS t, 0.5 + l_discount * 5 AS conf, l_quantity / 50 AS d0, l_tax * 10 AS d1, l_discount * 8 AS d2, (l_partkey % 10) / 10.0::DOUBLE AS d3 FROM lineitem),
b AS (SELECT *, greatest(0, least(1, {K1_BASE})) AS base FROM i JOIN w USING (t)), o AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN greatest(0, least(1, 0.8 * base + 0.2 * (0.3 + (l_partkey % 5) / 10.0))) ELSE base END AS mixed FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(base, 9) AS base, round(CASE WHEN l_linenumber % 3 = 0 THEN greatest(0, least(1, mixed + 0.1 * ((l_suppkey % 11) / 10.0 - 0.5))) ELSE mixed END, 9) AS score FROM o""")
def k1(spark, sf):
    """Weights of the own type, blended with the other types' mean below .8 confidence; then an objective score (rows that have one) and the figures' consistency (rows with figures)."""
    rows = ", ".join(f"('{t}', {', '.join(f'{x}D, {OTHERS[t][k]!r}D' for k, x in enumerate(w))})" for t, w in TYPE_WEIGHTS.items())
    weights = spark.sql(f"SELECT * FROM VALUES {rows} AS t(t, {', '.join(f'w{k}, o{k}' for k in range(4))})")
    kind = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("l_suppkey") % 4 + 1).cast("int"))
    dims = [F.col("l_quantity") / 50, F.col("l_tax") * 10, F.col("l_discount") * 8, (F.col("l_partkey") % 10) / 10.0]
    i = li_of(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", kind.alias("t"), F.least(F.lit(1.0), (0.5 + F.col("l_discount") * 5) / ELASTIC).alias("own"), *[d.alias(f"d{k}") for k, d in enumerate(dims)])
    base = X.clamp(sum((F.col("own") * F.col(f"w{k}") + (1 - F.col("own")) * F.col(f"o{k}")) * F.col(f"d{k}") for k in range(4)))
    objective = F.when(F.col("l_linenumber") % 2 == 0, 0.3 + (F.col("l_partkey") % 5) / 10.0)
    figures = F.when(F.col("l_linenumber") % 3 == 0, (F.col("l_suppkey") % 11) / 10.0)
    b = i.join(F.broadcast(weights), "t").withColumn("base", base)  # a row for each type
    mixed = F.when(objective.isNotNull(), X.clamp(0.8 * F.col("base") + 0.2 * objective)).otherwise(F.col("base"))
    score = F.when(figures.isNotNull(), X.clamp(mixed + 0.1 * (figures - 0.5))).otherwise(mixed)
    return b.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd("base", 9).alias("base"), rnd(score, 9).alias("score"))


SEV = "WITH g AS (SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS fatal, CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS BIGINT) AS minor, avg(l_quantity) / 50 AS s FROM lineitem GROUP BY 1)"


def severities(spark, sf):
    flag = F.col("l_returnflag")
    return li_of(spark, sf).groupBy("l_orderkey").agg(F.count_if(flag == "R").alias("fatal"), F.count_if(flag == "A").alias("minor"), (F.avg("l_quantity") / 50).alias("s"))


@query("k2_delta_bounds", f"{SEV} SELECT l_orderkey, CAST(round(greatest(-0.25, -0.08 - least(0.17, 0.06 * fatal + 0.02 * greatest(0, minor - 1))), 6) AS DOUBLE) AS low, CAST(round(least(0.25, 0.12 + CASE WHEN fatal = 0 AND minor = 0 THEN 0.08 ELSE 0 END), 6) AS DOUBLE) AS high FROM g")
def k2(spark, sf):
    f, m = F.col("fatal"), F.col("minor")
    low = F.greatest(F.lit(-0.25), -0.08 - F.least(F.lit(0.17), 0.06 * f + 0.02 * F.greatest(F.lit(0), m - 1)))
    high = F.least(F.lit(0.25), 0.12 + F.when((f == 0) & (m == 0), 0.08).otherwise(0.0))
    return severities(spark, sf).select("l_orderkey", rnd(low).alias("low"), rnd(high).alias("high"))


@query("k3_hard_verdict", f"{SEV} SELECT l_orderkey, CASE WHEN fatal >= 3 THEN 'reject' WHEN fatal >= 1 AND s >= 0.77 THEN 'minor_revision' WHEN s < 0.2 AND fatal = 0 THEN 'major_revision' ELSE {VERDICT.format('s')} END AS verdict FROM g")
def k3(spark, sf):
    """Many fatal points veto, one downgrades an accept, a low score without any isn't rejected outright."""
    s, f = F.col("s"), F.col("fatal")
    v = F.when(f >= 3, "reject").when((f >= 1) & (s >= 0.77), "minor_revision").when((s < 0.2) & (f == 0), "major_revision").otherwise(verdict(s))
    return severities(spark, sf).select("l_orderkey", v.alias("verdict"))


@query("k4_report_overrides", f"{SEV} SELECT l_orderkey, CASE WHEN fatal >= 2 THEN 'rewrite_required' WHEN minor >= 2 THEN 'needs_depth' ELSE 'pass' END AS verdict, round(CASE WHEN fatal >= 2 THEN least(s, 0.60) ELSE s END, 6) AS score FROM g")
def k4(spark, sf):
    f, m, s = F.col("fatal"), F.col("minor"), F.col("s")
    return severities(spark, sf).select("l_orderkey", F.when(f >= 2, "rewrite_required").when(m >= 2, "needs_depth").otherwise("pass").alias("verdict"), rnd(F.when(f >= 2, F.least(s, F.lit(0.60))).otherwise(s)).alias("score"))


def offset_score(s, offset, top=0.85):
    """Shift and clamp; a negative shift fades out between `top` and 1."""
    fade = F.when((s > top) & (offset < 0), (1 - s) / (1 - top)).otherwise(1.0)
    return X.clamp(s + offset * fade)


@query("k5_offset_taper", f"WITH {S} SELECT doc_id, round(greatest(0, least(1, score - 0.09 * CASE WHEN score > 0.85 THEN (1 - score) / (1 - 0.85) ELSE 1 END)), 6) AS corrected FROM s")
def k5(spark, sf):
    return scored(spark, sf).select("doc_id", rnd(offset_score(F.col("score"), F.lit(-0.09))).alias("corrected"))


@query("k6_dimension_offsets", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0 THEN round(l_tax - 0.01, 6) END AS a, round(l_discount - 0.02, 6) AS b FROM lineitem")
def k6(spark, sf):
    dims = F.zip_with(F.array(F.when(F.col("l_tax") > 0, F.col("l_tax")), F.col("l_discount")), F.array(F.lit(0.01), F.lit(0.02)), lambda x, o: F.round(x - o, 6))
    return li_of(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", dims.alias("d")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("d")[0].alias("a"), F.col("d")[1].alias("b"))


def grid(spark, low, high, step, name):
    n = round((high - low) / step)
    return spark.range(n + 1).select(F.round(F.col("id") * step + low, 4).alias(name))


GRID = "{2} AS (SELECT round({0} + i * {1}, 4) AS {2} FROM (SELECT unnest(range({3})) AS i))"


@query("k7_offset_sweep", f"WITH {S}, {GRID.format('-0.30::DOUBLE', '0.05::DOUBLE', 'o', 13)}, c AS (SELECT o, {CONF.format('score + o >= 0.5')} FROM s, o GROUP BY o), k AS (SELECT o, round({KAPPA}, 6) AS kappa FROM c) SELECT o AS best_offset, kappa FROM k ORDER BY kappa DESC, o LIMIT 1")
def k7(spark, sf):
    """The first best of a tie is the lowest offset."""
    rows = scored(spark, sf).crossJoin(F.broadcast(grid(spark, -0.30, 0.30, 0.05, "o")))
    k = confusion(rows, F.col("score") + F.col("o") >= 0.5, F.col("human"), ["o"]).select("o", rnd(kappa_of(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))).alias("kappa"))
    return k.orderBy(F.desc("kappa"), "o").limit(1).withColumnRenamed("o", "best_offset")


@query("k8_threshold_grid", f"WITH {S}, {GRID.format('0.10::DOUBLE', '0.05::DOUBLE', 'lo', 4)}, {GRID.format('0.30::DOUBLE', '0.05::DOUBLE', 'hi', 11)}, c AS (SELECT lo, hi, {CONF.format('(score >= lo AND score <= hi)')} FROM s, lo, hi GROUP BY ALL) SELECT lo, hi, round({KAPPA}, 6) AS kappa FROM c")
def k8(spark, sf):
    cells = grid(spark, 0.10, 0.25, 0.05, "lo").crossJoin(grid(spark, 0.30, 0.80, 0.05, "hi"))
    rows = scored(spark, sf).crossJoin(F.broadcast(cells))
    return confusion(rows, F.col("score").between(F.col("lo"), F.col("hi")), F.col("human"), ["lo", "hi"]).select("lo", "hi", rnd(kappa_of(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))).alias("kappa"))


@query("k9_binary_offset_scan", f"WITH {S}, {GRID.format('-0.20::DOUBLE', '0.10::DOUBLE', 'o', 5)}, c AS (SELECT o, {CONF.format('score + o >= 0.5')}, round(avg(score + o) FILTER (WHERE human = 1), 6) AS mean_pos, round(avg(score + o) FILTER (WHERE human = 0), 6) AS mean_neg FROM s, o GROUP BY o) SELECT *, round({KAPPA}, 6) AS kappa FROM c")
def k9(spark, sf):
    rows = scored(spark, sf).crossJoin(F.broadcast(grid(spark, -0.20, 0.20, 0.10, "o"))).withColumn("x", F.col("score") + F.col("o"))
    c = confusion(rows, F.col("x") >= 0.5, F.col("human"), ["o"])
    means = rows.groupBy("o").agg(rnd(F.avg(F.when(F.col("human") == 1, F.col("x")))).alias("mean_pos"), rnd(F.avg(F.when(F.col("human") == 0, F.col("x")))).alias("mean_neg"))
    return c.join(means, "o").withColumn("kappa", rnd(kappa_of(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))))


RANKED = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2.0::DOUBLE"


BASE_WEIGHTS = (0.5, 0.3, 0.2)


def weight_candidates(base: tuple[float, ...], step: float = 0.05, least: float = 0.05, most: float = 0.9) -> list[tuple[float, ...]]:
    """The base, then for each dimension its weight less and more by the step, kept within bounds, all normalised to 1."""
    found = [base]
    for k in range(len(base)):
        for d in (-step, step):
            w = [max(least, min(most, x + d)) if i == k else x for i, x in enumerate(base)]
            found.append(tuple(x / sum(w) for x in w))
    return found


CANDIDATES = weight_candidates(BASE_WEIGHTS)
W10 = ", ".join(f"({c}, {', '.join(f'{x!r}::DOUBLE' for x in w)})" for c, w in enumerate(CANDIDATES))


@query("k10_weight_search", f"""WITH i AS (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_tax * 12 AS c, l_extendedprice AS y FROM lineitem), w AS (SELECT * FROM (VALUES {W10}) AS t(k, wa, wb, wc)), m AS (SELECT k, round(wa * a + wb * b + wc * c, 9) AS m, y FROM i, w),
r AS (SELECT k, {RANKED.format('k', 'm')} AS rm, {RANKED.format('k', 'y')} AS ry FROM m), rho AS (SELECT k, round(corr(rm, ry), 6) AS rho FROM r GROUP BY k)
SELECT k AS candidate, round(wa, 6) AS w1, round(wb, 6) AS w2, round(wc, 6) AS w3, rho, k = (SELECT min(k) FROM rho WHERE rho = (SELECT max(rho) FROM rho)) AS best FROM rho JOIN w USING (k)""")
def k10(spark, sf):
    """Each dimension's weight .05 less and more, normalised, against the base: rank correlation with the target, the first of the best marked. Ranks within each candidate; the target is ranked once."""
    w = spark.createDataFrame([(k, *x) for k, x in enumerate(CANDIDATES)], "k int, wa double, wb double, wc double")
    base = li_of(spark, sf).select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_tax") * 12).alias("c"), F.col("l_extendedprice").alias("y"))
    mixed = F.round(F.col("wa") * F.col("a") + F.col("wb") * F.col("b") + F.col("wc") * F.col("c"), 9)
    m = materialize(base.crossJoin(F.broadcast(w)).select("k", mixed.alias("m"), "y"), "mixed")  # a fixed number of candidates
    ranked = m.join(global_ranks(m, "m", "k").select("k", "m", F.col("r").alias("x")), ["k", "m"]).join(global_ranks(base, "y").select("y", F.col("r").alias("z")), "y")
    rho = materialize(ranked.groupBy("k").agg(rnd(F.corr("x", "z")).alias("rho")), "rho")
    best = rho.agg(F.min_by("k", F.struct(-F.col("rho"), F.col("k"))).alias("top"))
    return rho.join(w, "k").crossJoin(best).select(F.col("k").alias("candidate"), rnd("wa").alias("w1"), rnd("wb").alias("w2"), rnd("wc").alias("w3"), "rho", (F.col("k") == F.col("top")).alias("best"))


@query("k11_cohen_kappa", """WITH p AS (SELECT l_returnflag AS a, CASE WHEN l_partkey % 4 = 0 THEN 'A' ELSE l_returnflag END AS b FROM lineitem), n AS (SELECT count(*) * 1.0::DOUBLE AS n FROM p), x AS (SELECT a, count(*) AS ca FROM p GROUP BY 1), y AS (SELECT b, count(*) AS cb FROM p GROUP BY 1), e AS (SELECT sum(ca * cb) / (SELECT n * n FROM n) AS pe FROM x JOIN y ON a = b), o AS (SELECT sum(CASE WHEN a = b THEN 1 ELSE 0 END) / (SELECT n FROM n) AS po FROM p) SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM o, e""")
def k11(spark, sf):
    """Several classes: contingency counts first, then their margins."""
    p = li_of(spark, sf).select(F.col("l_returnflag").alias("a"), F.when(F.col("l_partkey") % 4 == 0, "A").otherwise(F.col("l_returnflag")).alias("b"))
    c = p.groupBy("a", "b").agg(n_rows().alias("n"))
    n = c.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))).alias("same"))
    margin = c.groupBy("a").agg(F.sum("n").alias("x")).join(c.groupBy("b").agg(F.sum("n").alias("y")), F.col("a") == F.col("b")).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return n.crossJoin(margin).select(rnd((po - pe) / (1 - pe)).alias("kappa"))


@query("k12_interval_alpha", "WITH g AS (SELECT l_orderkey, sum(2 * (l_quantity - m) * (l_quantity - m)) / count(*) AS d FROM lineitem JOIN (SELECT l_orderkey, avg(l_quantity) AS m FROM lineitem GROUP BY 1) USING (l_orderkey) GROUP BY 1 HAVING count(*) >= 2), e AS (SELECT 2 * var_pop(l_quantity) AS e FROM lineitem) SELECT round(greatest(0, 1 - avg(d) / max(e)), 6) AS alpha FROM g, e")
def k12(spark, sf):
    """interval_alpha_simple: mean within-item disagreement against that of all ratings, floored at 0."""
    g = li_of(spark, sf).groupBy("l_orderkey").agg((2 * F.var_pop("l_quantity")).alias("d"), n_rows().alias("n")).where("n >= 2").agg(F.avg("d").alias("d"))
    return g.crossJoin(li_of(spark, sf).agg((2 * F.var_pop("l_quantity")).alias("e"))).select(rnd(F.greatest(F.lit(0.0), 1 - F.col("d") / F.col("e"))).alias("alpha"))


@query("k13_spearman", f"WITH r AS (SELECT l_suppkey, {RANKED.format('l_suppkey', 'l_quantity')} AS a, {RANKED.format('l_suppkey', 'l_extendedprice')} AS b, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey) AS oa, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS ob FROM lineitem) SELECT l_suppkey, round(corr(a, b), 6) AS rho, round(corr(oa, ob), 6) AS ordinal FROM r GROUP BY 1")
def k13(spark, sf):
    """A supplier's rows are sorted once for each measure: ranks with averaged ties and ordinals come from the same order."""
    tie = ["l_orderkey", "l_linenumber", "l_partkey"]
    r = dealt(li_of(spark, sf).select("l_suppkey", "l_quantity", "l_extendedprice", *tie), "l_suppkey")
    for value, rank, ordinal in (("l_quantity", "a", "oa"), ("l_extendedprice", "b", "ob")):
        r = r.withColumn(ordinal, F.row_number().over(Window.partitionBy("l_suppkey").orderBy(value, *tie)))
        peers = Window.partitionBy("l_suppkey").orderBy(value)
        upto = F.count(F.lit(1)).over(peers.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        r = r.withColumn(rank, (F.rank().over(peers) + upto) / 2)
    return r.groupBy("l_suppkey").agg(rnd(F.corr("a", "b")).alias("rho"), rnd(F.corr("oa", "ob")).alias("ordinal"))


@query("k14_pearson_mae", "SELECT l_suppkey, round(corr(l_quantity, l_extendedprice), 6) AS r, round(avg(abs(l_quantity - l_extendedprice / 2000)), 6) AS mae, round(avg(l_quantity - l_extendedprice / 2000), 6) AS bias FROM lineitem GROUP BY 1")
def k14(spark, sf):
    d = F.col("l_quantity") - F.col("l_extendedprice") / 2000
    return li_of(spark, sf).groupBy("l_suppkey").agg(rnd(F.corr("l_quantity", "l_extendedprice")).alias("r"), rnd(F.avg(F.abs(d))).alias("mae"), rnd(F.avg(d)).alias("bias"))


def auc(df, score, truth):
    """Rank-sum form with averaged ties; ranks of all rows by counts of distinct scores."""
    x = df.select(F.col(score).alias("score"), truth.alias("truth"))
    r = x.groupBy("score", "truth").agg(n_rows().alias("k")).join(global_ranks(x, "score").drop("n"), "score")
    p, n = (F.sum(F.when(F.col("truth") == v, F.col("k")).otherwise(0)) for v in (1, 0))
    return r.agg(((F.sum(F.when(F.col("truth") == 1, F.col("r") * F.col("k"))) - p * (p + 1) / 2) / (p * n)).alias("auc"))


AUC = f"WITH {S}, r AS (SELECT 1 AS g, human, {RANKED.format('1', 'score')} AS r FROM s) SELECT round((sum(CASE WHEN human = 1 THEN r END) - count(*) FILTER (WHERE human = 1) * (count(*) FILTER (WHERE human = 1) + 1) / 2.0) / (count(*) FILTER (WHERE human = 1) * count(*) FILTER (WHERE human = 0)), 6) AS auc FROM r"


@query("k15_auc", AUC)
def k15(spark, sf):
    """Ranks come from counts of distinct scores, so that no task sorts all rows."""
    return auc(scored(spark, sf), "score", F.col("human")).select(rnd("auc").alias("auc"))


@query("k16_threshold_metrics", f"WITH {S}, c AS (SELECT {CONF.format('score >= 0.5')} FROM s) SELECT tp, fp, fn, tn, round(tp * 1.0 / (tp + fp), 6) AS prec, round(tp * 1.0 / (tp + fn), 6) AS rec, round((tp + tn) * 1.0 / (tp + fp + fn + tn), 6) AS acc, round(tp * 1.0 / (tp + fn) + tn * 1.0 / (tn + fp) - 1, 6) AS youden, round((abs(fp - fn) - 1) * (abs(fp - fn) - 1) * 1.0 / (fp + fn), 6) AS mcnemar FROM c")
def k16(spark, sf):
    """Youden's J is sensitivity plus specificity minus 1."""
    c = confusion(scored(spark, sf), F.col("score") >= 0.5, F.col("human"), [])
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    off = F.abs(fp - fn) - 1
    return c.select("*", rnd(tp / (tp + fp)).alias("prec"), rnd(tp / (tp + fn)).alias("rec"), rnd((tp + tn) / (tp + fp + fn + tn)).alias("acc"), rnd(tp / (tp + fn) + tn / (tn + fp) - 1).alias("youden"), rnd(off * off / (fp + fn)).alias("mcnemar"))


@query("k17_isotonic", f"""WITH {S}, d AS (SELECT score, sum(human) * 1.0::DOUBLE AS h, count(*) AS n, row_number() OVER (ORDER BY score) AS i FROM s GROUP BY score), c AS (SELECT i, score, sum(h) OVER (ORDER BY i) AS hs, sum(n) OVER (ORDER BY i) AS ns, h, n FROM d),
m AS (SELECT a.i AS a, b.i AS b, (b.hs - a.hs + a.h) / (b.ns - a.ns + a.n) AS m FROM c a JOIN c b ON b.i >= a.i), t AS (SELECT a, b AS i, min(m) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM m), f AS (SELECT i, max(low) AS y FROM t GROUP BY 1)
SELECT doc_id, round(y, 6) AS calibrated FROM s JOIN d USING (score) JOIN f USING (i)""")
def k17(spark, sf):
    """Pool-adjacent-violators fit, applied to the rows it was fitted on (for a score between two fitted ones the model interpolates)."""
    s = scored(spark, sf).select("doc_id", "score", F.col("human").cast("double").alias("label"))
    model = IsotonicRegression(featuresCol="score", labelCol="label").fit(s)
    return model.transform(s).select("doc_id", rnd("prediction").alias("calibrated"))


@query("k18_ridge_blend")
def k18(spark, sf):
    """Ridge fit on one half for three penalties, chosen by AUC on the other half; all rows are scored by the best."""
    s = scored(spark, sf).withColumn("second", F.col("doc_id") % 7 / 7.0)
    s = VectorAssembler(inputCols=["score", "second"], outputCol="x").transform(s).withColumn("label", F.col("human").cast("double"))
    train, val = s.where("doc_id % 2 = 0"), s.where("doc_id % 2 = 1")
    models = [LinearRegression(featuresCol="x", labelCol="label", regParam=a, elasticNetParam=0.0, solver="normal").fit(train) for a in (0.01, 0.1, 1.0)]
    rated = [auc(m.transform(val), "prediction", F.col("human")).first()["auc"] for m in models]
    best = models[max(range(3), key=lambda i: (rated[i], -i))]
    return best.transform(s).select("doc_id", rnd("prediction").alias("blend"))


@query("k19_monotone_map", "SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN x <= 0.2 THEN x * 0.5 WHEN x <= 0.6 THEN 0.1 + (x - 0.2) * 1.5 ELSE 0.7 + (x - 0.6) * 0.75 END, 6) AS y FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity / 50 AS x FROM lineitem)")
def k19(spark, sf):
    """Piecewise linear through knots; the segment is found in a fixed array of them."""
    knots = [(0.0, 0.0), (0.2, 0.1), (0.6, 0.7), (1.0, 1.0)]
    x = F.col("l_quantity") / 50
    y = None
    for (x0, y0), (x1, y1) in reversed(list(zip(knots, knots[1:], strict=False))):
        line = y0 + (x - x0) * (y1 - y0) / (x1 - x0)
        y = line if y is None else F.when(x <= x1, line).otherwise(y)
    return li_of(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", rnd(y).alias("y"))


@query("k20_score_fusion", "WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(1, 0.6 * l_quantity / 50 + 0.4 * (l_extendedprice - lo) / (hi - lo))), 6) AS fused FROM lineitem, m")
def k20(spark, sf):
    m = li_of(spark, sf).agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"))
    scaled = (F.col("l_extendedprice") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return li_of(spark, sf).crossJoin(F.broadcast(m)).select("l_orderkey", "l_linenumber", "l_partkey", rnd(X.clamp(0.6 * F.col("l_quantity") / 50 + 0.4 * scaled)).alias("fused"))


@query("k21_disagreement", f"WITH {SEV[5:]}, v AS (SELECT l_orderkey, s, {VERDICT.format('s')} AS a, {VERDICT.format('(s * 0.9)')} AS b FROM g) SELECT l_orderkey, a <> b AND NOT (a IN ('accept', 'minor_revision') AND b IN ('accept', 'minor_revision')) AS disagree, round(0.1 * s, 6) AS gap FROM v")
def k21(spark, sf):
    """Accept and minor revision count as equivalent."""
    s = F.col("s")
    g = severities(spark, sf).select("l_orderkey", s, verdict(s).alias("a"), verdict(s * 0.9).alias("b"))
    same = F.array(F.lit("accept"), F.lit("minor_revision"))
    alike = F.array_contains(same, F.col("a")) & F.array_contains(same, F.col("b"))
    return g.select("l_orderkey", ((F.col("a") != F.col("b")) & ~alike).alias("disagree"), rnd(0.1 * s).alias("gap"))


#: Poisson(1) by its distribution: the first count whose bound is above a uniform number.
POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406, 0.999917, 0.99999)
PRIME = 2147483647
BOOT = f"""WITH v AS (SELECT l_suppkey AS g, l_quantity / 50 AS x, (l_orderkey * 1009 + l_linenumber * 7919 + l_partkey * 104729) % {PRIME} AS s FROM lineitem), y AS (SELECT g, x, b, (s + b * 69621 + 12345) % {PRIME} AS y FROM v, (SELECT unnest(range(1000)) AS b)), z AS (SELECT g, x, b, (y * y + b) % {PRIME} AS z FROM y), u AS (SELECT g, x, b, (z * z % {PRIME}) / {float(PRIME)} AS u FROM z),
p AS (SELECT g, b, x, CASE {" ".join(f"WHEN u < {t} THEN {k}" for k, t in enumerate(POISSON))} ELSE {len(POISSON)} END AS w FROM u), m AS (SELECT g, b, sum(w * x) / sum(w) AS m FROM p GROUP BY ALL HAVING sum(w) > 0)"""

#: The same bounds for the whole numbers that are drawn: u is below a bound where its number is.
DRAWS = [next(z for z in range(int(t * PRIME) - 1, PRIME) if z / float(PRIME) >= t) for t in POISSON]


def poisson_weights(rounds: int, most: int = 32):
    """A function from at most `most` row numbers (below PRIME) to their Poisson(1) weights in each round; each call overwrites the last one's result.

    A Mersenne prime's remainder is the sum of the two halves of a number below its square, less
    the prime at most once, so arrays that are kept are worked on in place.
    """
    prime, turn = np.uint64(PRIME), np.arange(rounds, dtype=np.int64)
    shift, turn = ((turn * 69621 + 12345) % PRIME).astype(np.uint64), turn.astype(np.uint64)
    whole, half = np.empty((2, most, rounds), np.uint64)
    drawn, above, weight = np.empty((most, rounds), np.uint32), np.empty((most, rounds), bool), np.empty((most, rounds))

    def less(a: np.ndarray, b: np.ndarray) -> None:
        np.subtract(a, prime, out=b)
        np.minimum(a, b, out=a)

    def remainder(a: np.ndarray, b: np.ndarray) -> None:
        np.right_shift(a, np.uint64(31), out=b)
        np.bitwise_and(a, prime, out=a)
        np.add(a, b, out=a)
        less(a, b)

    def run(s: np.ndarray) -> np.ndarray:
        a, b, z, over, w = (x[: len(s)] for x in (whole, half, drawn, above, weight))
        np.add(s.astype(np.uint64)[:, None], shift, out=a)
        less(a, b)
        np.multiply(a, a, out=a)
        np.add(a, turn, out=a)
        remainder(a, b)
        np.multiply(a, a, out=a)
        remainder(a, b)
        z[:] = a
        count = np.zeros(z.shape, np.uint8)
        for bound in DRAWS:
            np.greater_equal(z, np.uint32(bound), out=over)
            np.add(count, over.view(np.uint8), out=count)
        w[:] = count
        return w

    return run


def bootstrap(values: DataFrame, rounds: int = 1000) -> DataFrame:
    """g, low, high: the 2.5 and 97.5 percentiles of each group's resampled means, by a Poisson bootstrap. values: g, x, s (a number that tells rows apart, from 0 to below PRIME).

    Every row counts in every round with a weight of Poisson(1), drawn by a hash of row and round.
    Rows are dealt by ranges of group and s, so a group of any size lies in as many neighbouring
    tasks as it needs. A task reads its groups one after another and finishes all but the first
    and the last, which can go on in its neighbours: only these send their sums by round.
    """
    shape = "g long, low double, high double, sums binary"

    def ends(total: np.ndarray) -> tuple:
        mean = total[0][total[1] > 0] / total[1][total[1] > 0]
        return (*np.quantile(mean, [0.025, 0.975]).tolist(), None) if len(mean) else (None, None, None)

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"g": pa.int64(), "low": pa.float64(), "high": pa.float64(), "sums": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn, first, now, total = poisson_weights(rounds, 32), True, None, np.zeros((2, rounds))
        for batch in batches:
            rows = []
            g, x, s = (batch.column(c).to_numpy() for c in ("g", "x", "s"))
            for at in range(0, len(g), 32):
                own, w = g[at : at + 32], drawn(s[at : at + 32])
                both = np.stack([x[at : at + 32], np.ones(len(own))])
                starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
                for a, b in zip(starts, starts[1:], strict=False):
                    if own[a] != now and now is not None:
                        rows.append((now, None, None, total.tobytes()) if first else (now, *ends(total)))
                        first, total = False, np.zeros((2, rounds))
                    now = int(own[a])
                    total += np.einsum("ki,ij->kj", both[:, a:b], w[a:b])  # not BLAS, whose threads get in the way of other tasks
            if rows:
                yield rows_of(rows)
        if now is not None:
            yield rows_of([(now, None, None, total.tobytes())])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros((2, rounds))
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["g"] != now and now is not None:
                    rows.append((now, *ends(total)))
                    now, total = None, np.zeros((2, rounds))
                if r["sums"] is None:
                    rows.append((r["g"], r["low"], r["high"], None))
                else:
                    now, total = r["g"], total + np.frombuffer(r["sums"]).reshape(2, rounds)
            if rows:
                yield rows_of(rows)
        if now is not None:
            yield rows_of([(now, *ends(total))])

    sent = values.select("g", "x", "s").repartitionByRange("g", "s").sortWithinPartitions("g", "s").mapInArrow(sums, shape)
    return sent.repartition("g").sortWithinPartitions("g").mapInArrow(merged, shape).select("g", "low", "high")


def ratings(spark, sf) -> DataFrame:
    seed = F.expr(f"(l_orderkey * 1009 + l_linenumber * 7919 + l_partkey * 104729) % {PRIME}")
    return li_of(spark, sf).select(F.col("l_suppkey").alias("g"), (F.col("l_quantity") / 50).alias("x"), seed.alias("s"))


@query("k22_bootstrap_interval", f"{BOOT} SELECT g, round(greatest(0, least(1, quantile_cont(m, 0.025))), 5) AS low, round(greatest(0, least(1, quantile_cont(m, 0.975))), 5) AS high FROM m GROUP BY g")
def k22(spark, sf):
    return bootstrap(ratings(spark, sf)).select("g", *(F.round(X.clamp(F.col(c)), 5).alias(c) for c in ("low", "high")))


@query("k23_uncertainty_gate", f"{BOOT}, w AS (SELECT g, round(quantile_cont(m, 0.975) - quantile_cont(m, 0.025), 5) AS width FROM m GROUP BY g) SELECT g, width, CASE WHEN width > 0.30 THEN 'escalate' WHEN width > 0.15 THEN 'review' ELSE 'ok' END AS gate FROM w")
def k23(spark, sf):
    w = bootstrap(ratings(spark, sf)).select("g", F.round(F.col("high") - F.col("low"), 5).alias("width"))
    return w.withColumn("gate", F.when(F.col("width") > 0.30, "escalate").when(F.col("width") > 0.15, "review").otherwise("ok"))


@query("k24_quantile_alignment", "WITH r AS (SELECT quantile_cont(l_quantity, 0.5) AS ref, avg(l_quantity) AS ref_mean, stddev_pop(l_quantity) AS ref_sd, count(*) AS ref_n FROM lineitem), b AS (SELECT l_shipdate, quantile_cont(l_quantity, 0.5) AS m, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(l_shipdate AS DATE) AS batch, n, round(m, 6) AS median, round(greatest(-10, least(10, ref - m)), 6) AS shift, round(ref, 6) AS ref, round(ref_mean, 6) AS ref_mean, round(ref_sd, 6) AS ref_sd, ref_n FROM b, r WHERE n >= 5")
def k24(spark, sf):
    """Shift of each batch's median to that of all, with the reference's statistics. Values are counted first, so that the reference's percentile works on distinct values."""
    counts = li_of(spark, sf).groupBy(F.to_date("l_shipdate").alias("batch"), "l_quantity").agg(n_rows().alias("n"))
    values = counts.groupBy("l_quantity").agg(F.sum("n").alias("n"))
    ref = values.agg(F.percentile("l_quantity", F.lit(0.5), F.col("n")).alias("ref"), F.sum("n").alias("ref_n"), (F.sum(F.col("l_quantity") * F.col("n")) / F.sum("n")).alias("ref_mean"), (F.sum(F.col("l_quantity") ** 2 * F.col("n")) / F.sum("n")).alias("sq"))
    b = counts.groupBy("batch").agg(F.percentile("l_quantity", F.lit(0.5), F.col("n")).alias("m"), F.sum("n").alias("n")).where("n >= 5")
    sd = F.sqrt(F.col("sq") - F.col("ref_mean") ** 2)
    return b.crossJoin(F.broadcast(ref)).select("batch", "n", rnd("m").alias("median"), rnd(X.clamp(F.col("ref") - F.col("m"), -10.0, 10.0)).alias("shift"), rnd("ref").alias("ref"), rnd("ref_mean").alias("ref_mean"), rnd(sd).alias("ref_sd"), "ref_n")  # one row of the reference



@query("k25_gold_conversion", "SELECT doc_id, quality * 1.0::DOUBLE AS score, CASE WHEN quality = 1 THEN 'accept' WHEN toxic = 1 THEN 'major_revision' ELSE 'reject' END AS verdict FROM labels")
def k25(spark, sf):
    """Two JSON layouts to one schema; an unknown verdict becomes major_revision."""
    q, t = F.col("quality"), F.col("toxic")
    v = F.when(q == 1, "Accept").when(t == 1, "maybe").otherwise("REJECT")
    raw = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.struct(q.alias("overall")).alias("expert_scores"), v.alias("expert_verdict")))).otherwise(F.to_json(F.struct(q.alias("score"), v.alias("decision"))))
    row = table(spark, sf, "labels").select("doc_id", raw.alias("j"))
    either = lambda *paths: F.coalesce(*[F.get_json_object("j", p) for p in paths])
    said = F.lower(either("$.expert_verdict", "$.decision"))
    return row.select("doc_id", either("$.expert_scores.overall", "$.score").cast("double").alias("score"), F.when(said.isin("accept", "minor_revision", "major_revision", "reject"), said).otherwise("major_revision").alias("verdict"))


@query("k26_severity_tree")
def k26(spark, sf):
    """Balanced decision tree (depth 4, leaf 5) on deviation features; rows without a fit fall back to the deviation rule."""
    li = li_of(spark, sf)
    ax = li.groupBy("l_partkey").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")).where("hi > lo")
    x = F.col("l_quantity") * 1.2
    dev = F.greatest(F.col("lo") - x, x - F.col("hi"), F.lit(0.0))
    rows = li.join(ax, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", dev.alias("deviation"), (dev / (F.col("hi") - F.col("lo"))).alias("relative"), (F.col("hi") - F.col("lo")).alias("span"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"))
    share = rows.agg(F.avg("label").alias("p"))
    rows = rows.crossJoin(F.broadcast(share)).withColumn("w", F.when(F.col("label") == 1, 0.5 / F.col("p")).otherwise(0.5 / (1 - F.col("p"))))
    rows = VectorAssembler(inputCols=["deviation", "relative", "span"], outputCol="x").transform(rows)
    model = DecisionTreeClassifier(featuresCol="x", labelCol="label", weightCol="w", maxDepth=4, minInstancesPerNode=5, seed=1).fit(rows)
    return model.transform(rows).select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("prediction") == 1, "major").otherwise("minor").alias("severity"))


@query("k27_prediction_vs_annotation", f"WITH p AS (SELECT doc_id, least(n_chars / 5000.0::DOUBLE, 1) AS p FROM documents), x AS (SELECT l.doc_id, p, quality, toxic, CASE WHEN l.doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS second, {RANKED.format('1', 'p')} AS rp FROM labels l JOIN p USING (doc_id)), k AS (SELECT CAST(count(*) FILTER (WHERE quality = 1 AND second = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE quality = 0 AND second = 1) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE quality = 1 AND second = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (WHERE quality = 0 AND second = 0) AS BIGINT) AS tn FROM x) SELECT round(corr(rp, quality), 6) AS rank_corr, round((sum(CASE WHEN toxic = 1 THEN rp END) - count(*) FILTER (WHERE toxic = 1) * (count(*) FILTER (WHERE toxic = 1) + 1) / 2.0) / (count(*) FILTER (WHERE toxic = 1) * count(*) FILTER (WHERE toxic = 0)), 6) AS auc, (SELECT round({KAPPA}, 6) FROM k) AS annotators FROM x")
def k27(spark, sf):
    """Predictions against annotations of shared rows, and the kappa of two annotators (the second one turns every seventh label)."""
    x = scored(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    r = x.join(global_ranks(x, "score").drop("n"), "score")
    p, n = F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)
    first = F.col("human") == 1
    second = F.when(F.col("doc_id") % 7 == 0, ~first).otherwise(first)
    agreed = kappa_of(*(F.count_if(test) for test in (first & second, ~first & second, first & ~second, ~first & ~second)))
    return r.agg(rnd(F.corr("r", "human")).alias("rank_corr"), rnd((F.sum(F.when(F.col("toxic") == 1, F.col("r"))) - p * (p + 1) / 2) / (p * n)).alias("auc"), rnd(agreed).alias("annotators"))


FLIP = f"WITH {S}, v AS (SELECT doc_id, source, score >= 0.5 AS a, score - 0.1 >= 0.5 AS b, human = 1 AS gold FROM s)"


@query("k28_verdict_flips", f"{FLIP} SELECT CASE WHEN a = gold AND b <> gold THEN 'made_wrong' WHEN a <> gold AND b = gold THEN 'rescued' WHEN a = gold THEN 'both_right' ELSE 'both_wrong' END AS outcome, count(*) AS n, CAST(count(*) FILTER (WHERE a AND NOT b) AS BIGINT) AS down FROM v GROUP BY 1")
def k28(spark, sf):
    before = scored(spark, sf).select("doc_id", (F.col("score") >= 0.5).alias("a"), (F.col("human") == 1).alias("gold"))
    after = scored(spark, sf).select("doc_id", (F.col("score") - 0.1 >= 0.5).alias("b"))
    a, b, g = F.col("a"), F.col("b"), F.col("gold")
    kind = F.when((a == g) & (b != g), "made_wrong").when((a != g) & (b == g), "rescued").when(a == g, "both_right").otherwise("both_wrong")
    return before.join(after, "doc_id").groupBy(kind.alias("outcome")).agg(n_rows().alias("n"), F.count_if(a & ~b).alias("down"))


@query("k29_submissions_view", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 END AS score FROM events")
def k29(spark, sf):
    """The new key before the old one; null for failed rows."""
    new = F.get_json_object("props", "$.final_score").cast("double")
    old = F.get_json_object("props", "$.k").cast("double") / 100
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.coalesce(new, old)).alias("score"))


FLAGS = "WITH a AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS flag FROM part), b AS (SELECT p_partkey, unnest(CASE WHEN p_partkey % 3 = 0 THEN [split_part(p_name, ' ', 1)] ELSE string_split(p_name, ' ') || ['extra'] END) AS flag FROM part)"


@query("k30_multi_label", f"{FLAGS}, j AS (SELECT coalesce(a.flag, b.flag) AS flag, a.flag IS NOT NULL AS gold, b.flag IS NOT NULL AS said FROM (SELECT DISTINCT * FROM a) a FULL JOIN (SELECT DISTINCT * FROM b) b ON a.p_partkey = b.p_partkey AND a.flag = b.flag) SELECT flag, CAST(count(*) FILTER (WHERE gold AND said) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE said AND NOT gold) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE gold AND NOT said) AS BIGINT) AS fn FROM j GROUP BY 1")
def k30(spark, sf):
    p = table(spark, sf, "part")
    words = F.split("p_name", " ")
    a = p.select("p_partkey", F.explode(F.array_distinct(words)).alias("flag")).withColumn("gold", F.lit(True))
    said = F.when(F.col("p_partkey") % 3 == 0, F.array(words[0])).otherwise(F.array_distinct(F.concat(words, F.array(F.lit("extra")))))
    b = p.select("p_partkey", F.explode(said).alias("flag")).withColumn("said", F.lit(True))
    j = a.join(b, ["p_partkey", "flag"], "full_outer").na.fill(False)
    g, s = F.col("gold"), F.col("said")
    return j.groupBy("flag").agg(F.count_if(g & s).alias("tp"), F.count_if(s & ~g).alias("fp"), F.count_if(g & ~s).alias("fn"))


@query("k31_reliability_bins", f"WITH {S}, b AS (SELECT i / 5.0::DOUBLE AS lo, (i + 1) / 5.0::DOUBLE AS hi, i FROM (SELECT unnest(range(5)) AS i)) SELECT lo, hi, count(*) AS n, round(avg(human), 6) AS share FROM s JOIN b ON (score > lo OR (i = 0 AND score >= 0)) AND score <= hi GROUP BY ALL")
def k31(spark, sf):
    """Bins (lo, hi]; the first one is closed."""
    bins = spark.range(5).select((F.col("id") / 5.0).alias("lo"), ((F.col("id") + 1) / 5.0).alias("hi"))
    s = F.col("score")
    rows = scored(spark, sf).join(F.broadcast(bins), ((s > F.col("lo")) | ((F.col("lo") == 0) & (s >= 0))) & (s <= F.col("hi")))
    return rows.groupBy("lo", "hi").agg(n_rows().alias("n"), rnd(F.avg("human")).alias("share"))


@query("k32_repeat_stability", "WITH c AS (SELECT l_partkey, l_linestatus, l_returnflag, count(*) AS k FROM lineitem GROUP BY ALL), m AS (SELECT l_partkey, l_linestatus, max(k) AS top FROM c GROUP BY ALL), g AS (SELECT l_partkey, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, max(l_quantity) - min(l_quantity) AS span, round(stddev_pop(l_discount), 6) AS sd_discount, round(stddev_pop(l_tax), 6) AS sd_tax, round(count(*) FILTER (WHERE l_returnflag = 'R') * 1.0 / count(*), 6) AS share_r, round(count(*) FILTER (WHERE l_returnflag = 'A') * 1.0 / count(*), 6) AS share_a, round(count(*) FILTER (WHERE l_returnflag = 'N') * 1.0 / count(*), 6) AS share_n FROM lineitem GROUP BY ALL) SELECT g.*, round(top * 1.0 / n, 6) AS modal_share FROM g JOIN m USING (l_partkey, l_linestatus)")
def k32(spark, sf):
    by = ["l_partkey", "l_linestatus"]
    c = li_of(spark, sf).groupBy(*by, "l_returnflag").agg(n_rows().alias("k")).groupBy(*by).agg(F.max("k").alias("top"))
    g = li_of(spark, sf).groupBy(*by).agg(n_rows().alias("n"), rnd(F.avg("l_quantity")).alias("mean"), rnd(F.stddev_pop("l_quantity")).alias("sd"), (F.max("l_quantity") - F.min("l_quantity")).alias("span"), rnd(F.stddev_pop("l_discount")).alias("sd_discount"), rnd(F.stddev_pop("l_tax")).alias("sd_tax"), *[rnd(F.count_if(F.col("l_returnflag") == c.upper()) / n_rows()).alias(f"share_{c}") for c in "ran"])
    return g.join(c, by).select(*g.columns, rnd(F.col("top") / F.col("n")).alias("modal_share"))


@query("k33_offset_fit", "WITH u AS (UNPIVOT (SELECT l_quantity / 50 AS a, l_discount * 10 AS b, l_extendedprice / 105000 AS gold FROM lineitem) ON a, b INTO NAME dim VALUE v), o AS (SELECT dim, avg(v - gold) AS o FROM u GROUP BY 1) SELECT dim, round(max(o), 6) AS fitted, round(avg(abs(v - gold)), 6) AS before, round(avg(abs(v - o - gold)), 6) AS after FROM u JOIN o USING (dim) GROUP BY 1")
def k33(spark, sf):
    u = li_of(spark, sf).select((F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (F.col("l_extendedprice") / 105000).alias("gold")).unpivot(["gold"], ["a", "b"], "dim", "v")
    o = u.groupBy("dim").agg(F.avg(F.col("v") - F.col("gold")).alias("o"))
    gap = F.col("v") - F.col("gold")
    return u.join(F.broadcast(o), "dim").groupBy("dim").agg(rnd(F.max("o")).alias("fitted"), rnd(F.avg(F.abs(gap))).alias("before"), rnd(F.avg(F.abs(gap - F.col("o")))).alias("after"))


@query("k34_threshold_scan", f"WITH {S}, {GRID.format('0.50::DOUBLE', '0.01::DOUBLE', 't', 36)}, c AS (SELECT t, {CONF.format('score >= t')} FROM s, t GROUP BY t), x AS (SELECT t, round((tp + tn) * 1.0 / (tp + fp + fn + tn), 6) AS acc, round({KAPPA}, 6) AS kappa, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c) SELECT t, acc, kappa, f1, t = (SELECT min(t) FROM x WHERE acc = (SELECT max(acc) FROM x)) AS best_acc, t = (SELECT min(t) FROM x WHERE f1 = (SELECT max(f1) FROM x)) AS best_f1 FROM x")
def k34(spark, sf):
    """Thresholds of .50 to .85 by hundredths, the first best by accuracy and by F1 marked."""
    rows = scored(spark, sf).crossJoin(F.broadcast(grid(spark, 0.50, 0.85, 0.01, "t")))
    c = confusion(rows, F.col("score") >= F.col("t"), F.col("human"), ["t"])
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    x = materialize(c.select("t", rnd((tp + tn) / (tp + fp + fn + tn)).alias("acc"), rnd(kappa_of(tp, fp, fn, tn)).alias("kappa"), rnd(F.coalesce(2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0))).alias("f1")), "scan")
    best = x.agg(*(F.min_by("t", F.struct(-F.col(c), F.col("t"))).alias(f"top_{c}") for c in ("acc", "f1")))
    return x.crossJoin(best).select(*x.columns, *((F.col("t") == F.col(f"top_{c}")).alias(f"best_{c}") for c in ("acc", "f1")))


@query("k34_group_medians", f"WITH {S} SELECT human, count(*) AS n, min(score) AS low, list_sort(list(score))[count(*) // 2 + 1] AS median, max(score) AS high FROM s GROUP BY human")
def k34_medians(spark, sf):
    """Least, upper median and greatest score of the accepted and of the rejected, from counted values ranked over all partitions."""
    s = scored(spark, sf)
    n = s.groupBy("human").agg(n_rows().alias("all"), F.min("score").alias("low"), F.max("score").alias("high"))
    ranks = global_ranks(s, "score", "human").join(F.broadcast(n), "human")  # two groups
    half, middle = (F.col("n") - 1) / 2, F.floor(F.col("all") / 2) + 1
    holds = (F.col("r") - half <= middle) & (middle <= F.col("r") + half)
    return ranks.where(holds).select("human", F.col("all").alias("n"), "low", F.col("score").alias("median"), "high")


@query("k35_weight_sweep", f"WITH {S}, q AS (SELECT doc_id, toxic * 1.0::DOUBLE AS q FROM labels WHERE doc_id % 3 = 0), {GRID.format('0.0::DOUBLE', '0.1::DOUBLE', 'w', 4)} SELECT w, round(avg(score + w * (coalesce(q, 0.5) - 0.5)), 6) AS mean, CAST(count(*) FILTER (WHERE score + w * (coalesce(q, 0.5) - 0.5) >= 0.5) AS BIGINT) AS accepted FROM s LEFT JOIN q USING (doc_id), w GROUP BY w")
def k35(spark, sf):
    """A missing q leaves the score as it is."""
    q = table(spark, sf, "labels").where("doc_id % 3 = 0").select("doc_id", (F.col("toxic") * 1.0).alias("q"))
    x = F.col("score") + F.col("w") * (F.coalesce("q", F.lit(0.5)) - 0.5)
    rows = scored(spark, sf).join(q, "doc_id", "left").crossJoin(F.broadcast(grid(spark, 0.0, 0.3, 0.1, "w")))
    return rows.groupBy("w").agg(rnd(F.avg(x)).alias("mean"), F.count_if(x >= 0.5).alias("accepted"))


REPLAY = f"""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1), f AS (SELECT l_orderkey, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS fatal FROM lineitem GROUP BY 1),
r AS (SELECT o_custkey, o_totalprice / 500000 AS raw, coalesce(fatal, 0) AS fatal, unnest(['base', 'offset']) AS scenario FROM l LEFT JOIN f ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW'), x AS (SELECT *, greatest(0, least(1, raw + CASE WHEN scenario = 'offset' THEN -0.05 ELSE 0 END)) AS s FROM r), v AS (SELECT *, CASE WHEN fatal >= 3 THEN 'reject' ELSE {VERDICT.format('s')} END AS verdict FROM x)"""


@query("k36_replay", f"{REPLAY} SELECT scenario, verdict, count(*) AS n FROM v GROUP BY ALL")
def k36(spark, sf):
    """Latest record of each key, rows already marked (low priority) left out, one row for each scenario."""
    o = table(spark, sf, "orders").withColumn("k", rank_within("o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey"))).where("k = 1 and o_orderpriority <> '5-LOW'")
    f = li_of(spark, sf).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "R").alias("fatal"))
    r = o.join(f, "o_orderkey", "left").select((F.col("o_totalprice") / 500000).alias("raw"), F.coalesce("fatal", F.lit(0)).alias("fatal"), F.explode(F.array(F.lit("base"), F.lit("offset"))).alias("scenario"))
    s = X.clamp(F.col("raw") + F.when(F.col("scenario") == "offset", -0.05).otherwise(0.0))
    return r.groupBy("scenario", F.when(F.col("fatal") >= 3, "reject").otherwise(verdict(s)).alias("verdict")).agg(n_rows().alias("n"))


HUNDREDTHS = "CAST(2 * l_quantity AS BIGINT) AS base, CAST(2 * l_quantity - round(100 * l_discount) AS BIGINT) AS raw, CAST(greatest(0, 2 * l_quantity - round(100 * l_discount) - round(100 * l_tax)) AS BIGINT) AS final"
MEAN6 = "((20000 * sum({0} + 100)::HUGEINT + {1}) // (2 * {1}) - 1000000) / 1000000.0::DOUBLE"


@query("k37_score_layers", f"""WITH b AS (SELECT {HUNDREDTHS}, l_returnflag FROM lineitem), u AS (UNPIVOT (SELECT base, raw, final FROM b) ON base, raw, final INTO NAME layer VALUE h)
SELECT layer, count(*) AS n, {MEAN6.format("h", "count(*)")} AS mean, round(sqrt((count(*) * sum(h * h)::HUGEINT - sum(h)::HUGEINT * sum(h)::HUGEINT)::DOUBLE) / count(*) / 100, 6) AS sd, round(quantile_cont(h, 0.1) / 100, 6) AS p10, round(quantile_cont(h, 0.9) / 100, 6) AS p90 FROM u GROUP BY 1
UNION ALL SELECT 'shift_' || (raw - final) // 2 + CASE WHEN raw < final AND (final - raw) % 2 = 1 THEN -1 ELSE 0 END, count(*), {MEAN6.format("raw - final", "count(*)")}, NULL, NULL, NULL FROM b GROUP BY 1 UNION ALL SELECT 'reason_' || l_returnflag, count(*), {MEAN6.format("raw - base", "count(*)")}, NULL, NULL, NULL FROM b WHERE raw < base GROUP BY 1""")
def k37(spark, sf):
    """Moments and percentiles of each layer, a histogram of what the last step takes (bins of .02), and reasons of lowered rows with their mean change.

    Scores are whole hundredths, so sums are exact in any order and a tie in the last place is rounded
    up; equal values are counted before anything else, so a layer of any size is a few hundred rows.
    """
    whole = lambda c: F.round(c * 100).cast("long")
    base = whole(F.col("l_quantity") / 50)
    raw = base - whole(F.col("l_discount"))
    b = li_of(spark, sf).select(base.alias("base"), raw.alias("raw"), F.greatest(F.lit(0).cast("long"), raw - whole(F.col("l_tax"))).alias("final"), "l_returnflag")
    b = materialize(b.groupBy(*b.columns).agg(n_rows().alias("n")), "scores")
    exact = lambda c: c.cast("decimal(38,0)")
    total = F.sum("n")

    def mean(h):
        up = exact(F.sum((h + 100) * F.col("n"))) * 20000 + total
        return ((F.call_function("div", up, exact(2 * total)) - 1000000) / 1000000.0).alias("mean")

    layers = b.unpivot(["n"], ["base", "raw", "final"], "layer", "h").groupBy("layer", "h").agg(total.alias("n"))
    h = F.col("h")
    spread = exact(total) * F.sum(h * h * F.col("n")) - exact(F.sum(h * F.col("n"))) * exact(F.sum(h * F.col("n")))
    pc = F.percentile("h", F.array(F.lit(0.1), F.lit(0.9)), F.col("n"))
    layers = layers.groupBy("layer").agg(total.alias("rows"), mean(h), rnd(F.sqrt(spread.cast("double")) / total / 100).alias("sd"), pc.alias("pc"))
    layers = layers.select("layer", F.col("rows").alias("n"), "mean", "sd", rnd(F.col("pc")[0] / 100).alias("p10"), rnd(F.col("pc")[1] / 100).alias("p90"))
    none = [F.lit(None).cast("double").alias(c) for c in ("sd", "p10", "p90")]
    taken = F.col("raw") - F.col("final")
    counted = lambda df, name, change: df.groupBy(name.alias("layer")).agg(total.alias("rows"), mean(change)).select("layer", F.col("rows").alias("n"), "mean", *none)
    shifts = counted(b, F.concat(F.lit("shift_"), F.floor(taken / 2).cast("int").cast("string")), taken)
    reasons = counted(b.where("raw < base"), F.concat(F.lit("reason_"), "l_returnflag"), F.col("raw") - F.col("base"))
    return layers.unionByName(shifts).unionByName(reasons)


@query("k38_high_but_rejected", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1 AND o_totalprice > 400000 AND o_orderstatus = 'F'")
def k38(spark, sf):
    latest = table(spark, sf, "orders").withColumn("k", rank_within("o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey"))).where("k = 1")
    return latest.where("o_totalprice > 400000 and o_orderstatus = 'F'").select("o_custkey", "o_orderkey", "o_totalprice")


@query("k39_boundary_sample", """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1 AND o_totalprice BETWEEN 100000 AND 400000 AND o_custkey NOT IN (SELECT doc_id FROM labels)),
c AS (SELECT o_custkey, o_orderpriority AS layer FROM l), n AS (SELECT layer, count(*) AS n FROM c GROUP BY 1), e AS (SELECT *, n * 60.0::DOUBLE / (SELECT sum(n) FROM n) AS exact FROM n), w AS (SELECT *, CAST(floor(exact) AS BIGINT) AS whole FROM e), r AS (SELECT *, row_number() OVER (ORDER BY round(exact - whole, 9) DESC, layer) AS k, 60 - sum(whole) OVER () AS rest FROM w),
q AS (SELECT layer, whole + CASE WHEN k <= rest THEN 1 ELSE 0 END AS seats FROM r), h AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY md5('b' || o_custkey), o_custkey) AS k FROM c) SELECT o_custkey, h.layer FROM h JOIN q USING (layer) WHERE k <= seats""")
def k39(spark, sf):
    latest = table(spark, sf, "orders").withColumn("k", rank_within("o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey"))).where("k = 1 and o_totalprice between 100000 and 400000")
    gold = table(spark, sf, "labels").select(F.col("doc_id").alias("o_custkey"))
    c = latest.join(gold, "o_custkey", "left_anti").select("o_custkey", F.col("o_orderpriority").alias("layer"))
    seats = largest_remainder(c.groupBy("layer").agg(n_rows().alias("n")), "layer", "n", 60).select("layer", "seats")
    k = rank_within("layer", F.md5(F.concat(F.lit("b"), F.col("o_custkey").cast("string"))), F.col("o_custkey"))
    return c.withColumn("k", k).join(F.broadcast(seats), "layer").where("k <= seats").select("o_custkey", "layer")


@query("k40_trigger_summary", "WITH x AS (SELECT l_quantity / 50 AS s, l_returnflag AS f, l_linestatus AS gold FROM lineitem) SELECT gold, count(*) AS n, CAST(count(*) FILTER (WHERE f = 'R') AS BIGINT) AS flagged, round(quantile_cont(s, 0.25), 6) AS q1, round(quantile_cont(s, 0.75), 6) AS q3, CAST(count(*) FILTER (WHERE f = 'A') AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE f = 'A' AND s > 0.9) AS BIGINT) AS errored, " + ", ".join(f"CAST(count(*) FILTER (WHERE least(CAST(floor(s * 10) AS INT), 9) = {b}) AS BIGINT) AS bin{b}" for b in range(10)) + " FROM x GROUP BY 1")
def k40(spark, sf):
    """Equal scores are counted first, so the quartiles read as many rows as there are scores."""
    each = li_of(spark, sf).groupBy(F.col("l_linestatus").alias("gold"), "l_quantity", F.col("l_returnflag").alias("flag")).agg(n_rows().alias("k"))
    s = F.col("l_quantity") / 50
    count = lambda test: F.sum(F.when(test, F.col("k")).otherwise(0))
    quartile = lambda q: rnd(F.percentile(s, F.lit(q), F.col("k")))
    bins = [count(F.least(F.floor(s * 10).cast("int"), F.lit(9)) == b).alias(f"bin{b}") for b in range(10)]
    skipped = F.col("flag") == "A"
    return each.groupBy("gold").agg(F.sum("k").alias("n"), count(F.col("flag") == "R").alias("flagged"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), count(skipped).alias("skipped"), count(skipped & (s > 0.9)).alias("errored"), *bins)


CLASSES = ("accept", "minor_revision", "major_revision", "reject")


@query("k41_leave_one_out", f"""WITH p AS (SELECT l_suppkey AS g, l_quantity AS x, avg(l_extendedprice) / 105000 AS y FROM lineitem GROUP BY ALL), n AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY g ORDER BY x)),
m AS (SELECT g, y, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (x - x0) * (y1 - y0) / (x1 - x0) END, 9) AS m FROM n WHERE x0 IS NOT NULL OR x1 IS NOT NULL), v AS (SELECT g, y, m, {VERDICT.format('y')} AS a, {VERDICT.format('m')} AS b FROM m),
c AS (SELECT g, count(*) AS n, avg(abs(y - m)) AS mae, corr(y, m) AS r, count(*) FILTER (WHERE a = b) * 1.0::DOUBLE / count(*) AS po, ({" + ".join(f"count(*) FILTER (WHERE a = '{c}') * count(*) FILTER (WHERE b = '{c}')" for c in CLASSES)}) * 1.0::DOUBLE / (count(*) * count(*)) AS pe FROM v GROUP BY g)
SELECT g, n, round(mae, 6) AS mae, round(r, 6) AS r, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM c""")
def k41(spark, sf):
    """Each point is predicted by the piecewise-linear map through its group's other points (equal scores are averaged first): between its two neighbours, or the one it has. Error, correlation and kappa of verdicts by group, without a self join."""
    p = li_of(spark, sf).groupBy(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x")).agg((F.avg("l_extendedprice") / 105000).alias("y"))
    w = Window.partitionBy("g").orderBy("x")
    n = p.select("g", "x", "y", F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x0 is not null or x1 is not null")
    between = F.col("y0") + (F.col("x") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    m = n.select("g", "y", F.round(F.coalesce(between, "y0", "y1"), 9).alias("m")).withColumn("a", verdict(F.col("y"))).withColumn("b", verdict(F.col("m")))
    both = sum((F.count_if(F.col("a") == c) * F.count_if(F.col("b") == c) for c in CLASSES), F.lit(0))
    c = m.groupBy("g").agg(n_rows().alias("n"), F.avg(F.abs(F.col("y") - F.col("m"))).alias("mae"), F.corr("y", "m").alias("r"), (F.count_if(F.col("a") == F.col("b")) / n_rows()).alias("po"), (both / (n_rows() * n_rows())).alias("pe"))
    kappa = F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe")))
    return c.select("g", "n", rnd("mae").alias("mae"), rnd("r").alias("r"), rnd(kappa).alias("kappa"))


@query("k42_class_shift", f"WITH {S}, u AS (SELECT unnest(['before', 'after']) AS phase, unnest([{VERDICT.format('score')}, {VERDICT.format('(score - 0.09)')}]) AS verdict FROM s) SELECT verdict, CAST(count(*) FILTER (WHERE phase = 'before') AS BIGINT) AS before, CAST(count(*) FILTER (WHERE phase = 'after') AS BIGINT) AS after FROM u GROUP BY 1")
def k42(spark, sf):
    s = scored(spark, sf).select(verdict(F.col("score")).alias("before"), verdict(F.col("score") - 0.09).alias("after"))
    return s.unpivot([], ["before", "after"], "phase", "verdict").groupBy("verdict").pivot("phase", ["before", "after"]).agg(n_rows()).na.fill(0)
