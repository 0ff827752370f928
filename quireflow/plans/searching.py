"""Retrieval, ranking and vector queries (R, W5, J7, J25, F2 to F6)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import text as X
from quireflow.operators.embedding import anchors, hashed_words
from quireflow.operators.mentions import containing_any
from quireflow.operators import ranking as R
from quireflow.plans.registry import ORACLE, query
from quireflow.session import table
from quireflow.sources.scratch import materialize

TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
POST = f"""
d AS (SELECT doc_id, {TOK.format('text')} AS w FROM documents),
post AS (SELECT doc_id, len(w) AS len, t AS term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM d),
asked AS (SELECT DISTINCT item_id AS query_id, unnest({TOK.format('text')}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM (SELECT doc_id, term FROM (SELECT doc_id, unnest(list_distinct(w)) AS term FROM d)) GROUP BY term),
p2 AS (SELECT doc_id, len(w) AS len, t AS term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS t FROM d) GROUP BY doc_id, w, t),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM asked JOIN df USING (term) JOIN p2 USING (term), st WHERE length(asked.term) >= 2 GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""
COS = "round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))), 6)"
VEC = f"""
q AS (SELECT item_id AS query_id, embedding AS qvec FROM benchmark JOIN embeddings ON vec_id = item_id),
vs AS (SELECT query_id, vec_id AS doc_id, {COS.format(a='qvec', b='embedding')} AS score FROM q, embeddings),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs)"""
HYBRID = f"""{POST}, {VEC},
fuse AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS rrf
  FROM (SELECT query_id, doc_id, rank FROM bmr WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank FROM vr WHERE rank <= 50) GROUP BY ALL)"""


def docs_of(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def asked_of(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("qtext"))


def vectors_of(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))


def query_vectors(spark, sf):
    """The benchmark's items with the vector of the same number: a fixed, small query set."""
    return asked_of(spark, sf).join(vectors_of(spark, sf).withColumnRenamed("doc_id", "query_id").withColumnRenamed("vec", "qvec"), "query_id").select("query_id", "qvec")


@query("r1_bm25_search", f"WITH {POST} SELECT query_id, doc_id, score, rank FROM bmr WHERE rank <= 10")
def r1(spark, sf):
    return R.bm25(docs_of(spark, sf), asked_of(spark, sf), 10)


@query("w5_vector_top_k", f"WITH {VEC} SELECT query_id, doc_id, score, rank FROM vr WHERE rank <= 10")
def w5(spark, sf):
    return R.vector_top(query_vectors(spark, sf), vectors_of(spark, sf), 10)


@query("r3_rank_fusion", f"""WITH {HYBRID} SELECT * FROM (SELECT query_id, doc_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM fuse) WHERE rank <= 20""")
def r3(spark, sf):
    text = R.bm25(docs_of(spark, sf), asked_of(spark, sf), 50)
    return R.rrf([text, R.vector_top(query_vectors(spark, sf), vectors_of(spark, sf), 50)], 20)


@query("r4_hybrid_search", f"""WITH {HYBRID}, s AS (SELECT fuse.*, lang, source FROM fuse JOIN documents USING (doc_id) WHERE lang = 'en')
SELECT * FROM (SELECT query_id, doc_id, rrf, lang, source, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def r4(spark, sf):
    """Scope (language) is applied after both lists are cut to 50 and before the cut to 10: fewer than 10 rows can come back."""
    meta = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "lang", "source")
    text = R.bm25(docs_of(spark, sf), asked_of(spark, sf), 50)
    fused = R.rrf([text, R.vector_top(query_vectors(spark, sf), vectors_of(spark, sf), 50)], 100).drop("rank")
    fused = materialize(fused, "fused")  # its size is known then, and no document is exchanged or sorted for a few rows
    return fused.join(meta, "doc_id").withColumn("rank", R.rank_within("query_id", F.desc("rrf"), F.asc("doc_id"))).where("rank <= 10")


@query("j7_full_outer_ranked_lists", f"""WITH {POST}, {VEC} SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank AS text_rank, b.rank AS vector_rank
FROM (SELECT * FROM bmr WHERE rank <= 20) a FULL JOIN (SELECT * FROM vr WHERE rank <= 20) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id""")
def j7(spark, sf):
    a = R.bm25(docs_of(spark, sf), asked_of(spark, sf), 20).select("query_id", "doc_id", F.col("rank").alias("text_rank"))
    b = R.vector_top(query_vectors(spark, sf), vectors_of(spark, sf), 20).select("query_id", "doc_id", F.col("rank").alias("vector_rank"))
    return a.join(b, ["query_id", "doc_id"], "full_outer")


@query("r2_snippets", """WITH p AS (SELECT b.item_id, b.w, d.doc_id, d.text, strpos(lower(d.text), b.w) AS pos
  FROM documents d, (SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]{9,}')))[1] AS w FROM benchmark) b WHERE contains(lower(d.text), b.w))
SELECT item_id, doc_id, w AS term, substr(text, greatest(1, p.pos - 30), p.pos - greatest(1, p.pos - 30)) || '[' || substr(text, p.pos, length(w)) || ']' || substr(text, p.pos + length(w), 30) AS snippet FROM p""")
def r2(spark, sf):
    words = table(spark, sf, "benchmark").select("item_id", F.get(F.sort_array(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))), F.lit(0)).alias("term")).where("term is not null")
    hit = R.containing(docs_of(spark, sf), words, 9)
    at, text, n = F.expr("locate(term, lower(text))"), F.col("text"), F.length("term")
    left = F.greatest(F.lit(1), at - 30)
    return hit.select("item_id", "doc_id", "term", F.concat(text.substr(left, at - left), F.lit("["), text.substr(at, n), F.lit("]"), text.substr(at + n, F.lit(30))).alias("snippet"))


def _mmr_sql(top: int) -> str:
    """Greedy choice, one step a table."""
    out = f"WITH {VEC}, c AS (SELECT query_id, doc_id, score AS rel, embedding AS v FROM vr JOIN embeddings ON vec_id = doc_id WHERE rank <= 50), w0 AS (SELECT DISTINCT query_id, []::STRUCT(d BIGINT, m DOUBLE)[] AS sel FROM c)"
    dot = "list_dot_product(c.v::DOUBLE[], x.v::DOUBLE[]) / sqrt(list_dot_product(c.v::DOUBLE[], c.v::DOUBLE[]) * list_dot_product(x.v::DOUBLE[], x.v::DOUBLE[]))"
    for k in range(top):
        out += f""", u{k} AS (SELECT query_id, unnest(sel).d AS d FROM w{k}), n{k} AS (SELECT c.query_id, c.doc_id, any_value(c.rel) AS rel, max({dot}) AS near FROM c LEFT JOIN u{k} ON u{k}.query_id = c.query_id LEFT JOIN c x ON x.query_id = c.query_id AND x.doc_id = u{k}.d WHERE (c.query_id, c.doc_id) NOT IN (SELECT (query_id, d) FROM u{k}) GROUP BY ALL),
b{k} AS (SELECT query_id, max({{'m': round(0.7 * rel - 0.3 * coalesce(near, 0), 9), 'less': -doc_id}}) AS b FROM n{k} GROUP BY 1), w{k + 1} AS (SELECT query_id, list_append(sel, {{'d': -b.less, 'm': b.m}}) AS sel FROM w{k} JOIN b{k} USING (query_id))"""
    return out + f" SELECT query_id, x.d AS doc_id, rank, x.m AS mmr FROM (SELECT query_id, unnest(sel) AS x, unnest(range(1, len(sel) + 1)) AS rank FROM w{top})"


@query("r5_mmr_rerank", _mmr_sql(10))
def r5(spark, sf):
    found = R.vector_top(query_vectors(spark, sf), vectors_of(spark, sf), 50).select("query_id", "doc_id", F.col("score").alias("relevance"))
    return R.mmr(found.join(vectors_of(spark, sf), "doc_id"), 10)


@query("r6_scope_retrieval", f"""WITH {POST}, qs AS (SELECT item_id AS query_id, item_id % 2 = 1 AS empty FROM benchmark),
ranked AS (SELECT query_id, doc_id, rank FROM bmr WHERE rank <= 5 AND query_id % 2 = 0
 UNION ALL SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) FROM qs, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5) WHERE empty)
SELECT query_id, doc_id, rank FROM ranked""")
def r6(spark, sf):
    """Odd queries are taken as empty: they get the first documents by id."""
    asked = asked_of(spark, sf)
    full = R.bm25(docs_of(spark, sf), asked.where("query_id % 2 = 0"), 5).select("query_id", "doc_id", "rank")
    first = docs_of(spark, sf).orderBy("doc_id").limit(5).select("doc_id")
    none = asked.where("query_id % 2 = 1").select("query_id").crossJoin(F.broadcast(first))
    return full.unionByName(none.withColumn("rank", R.rank_within("query_id", F.asc("doc_id"))))


STOP = ["the", "and", "for", "that", "this", "with", "are", "was", "were", "from", "have", "has", "not", "but", "they", "which", "their", "its", "can", "our"]
IN_STOP = ", ".join(f"'{w}'" for w in STOP)


@query("r7_keywords", f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE word NOT IN ({IN_STOP}) GROUP BY ALL)
SELECT * FROM (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 10""")
def r7(spark, sf):
    words = docs_of(spark, sf).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    n = words.where(~F.col("word").isin(STOP)).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", R.rank_within("doc_id", F.desc("n"), F.asc("word"))).where("rank <= 10")


@query("r8_keywords_by_language", f"""WITH w AS (SELECT doc_id, lang, unnest({TOK.format('text')}) AS word FROM documents),
c AS (SELECT doc_id, lang, word, count(*) AS n FROM w WHERE length(word) >= CASE WHEN lang = 'de' THEN 5 WHEN lang = 'en' THEN 3 ELSE 4 END AND NOT (lang = 'en' AND word IN ({IN_STOP})) AND NOT regexp_matches(word, '[0-9]') GROUP BY ALL)
SELECT * FROM (SELECT doc_id, lang, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 5""")
def r8(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", "lang", F.explode(X.tokens("text")).alias("word"))
    least = F.when(F.col("lang") == "de", 5).when(F.col("lang") == "en", 3).otherwise(4)
    kept = words.where((F.length("word") >= least) & ~((F.col("lang") == "en") & F.col("word").isin(STOP)) & ~F.col("word").rlike("[0-9]"))
    n = kept.groupBy("doc_id", "lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rank", R.rank_within("doc_id", F.desc("n"), F.asc("word"))).where("rank <= 5")


@query("r9_query_expansion", """WITH b AS (SELECT item_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark),
x AS (SELECT b.item_id, b.text, list_sort(list_filter(n.w, lambda t: NOT list_contains(b.w, t))) AS extra FROM b JOIN b n ON n.item_id = b.item_id + 1)
SELECT item_id, text || ' ' || array_to_string(extra[1:3], ' ') AS expanded FROM x""")
def r9(spark, sf):
    """Terms of the following item that the query lacks, three at most."""
    words = table(spark, sf, "benchmark").select("item_id", "text", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w"))
    after = words.select((F.col("item_id") - 1).alias("item_id"), F.col("w").alias("next"))
    return words.join(after, "item_id").select("item_id", F.concat_ws(" ", "text", F.array_join(F.slice(F.sort_array(F.array_except("next", "w")), 1, 3), " ")).alias("expanded"))


@query("r10_content_recommendation", f"""WITH {HYBRID}, top AS (SELECT query_id, max(rrf) AS best FROM fuse GROUP BY 1),
s AS (SELECT f.query_id, f.doc_id, round(CASE WHEN v.score IS NULL THEN f.rrf / best ELSE 0.5 * f.rrf / best + 0.5 * greatest(v.score, 0) END, 6) AS score
 FROM fuse f JOIN top USING (query_id) LEFT JOIN vs v ON v.query_id = f.query_id AND v.doc_id = f.doc_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def r10(spark, sf):
    qv, vec = query_vectors(spark, sf), vectors_of(spark, sf)
    fused = R.rrf([R.bm25(docs_of(spark, sf), asked_of(spark, sf), 50), R.vector_top(qv, vec, 50)], 100)
    best = fused.withColumn("best", F.max("rrf").over(Window.partitionBy("query_id")))
    both = best.join(vec, "doc_id", "left").join(F.broadcast(qv), "query_id", "left")
    half = F.col("rrf") / F.col("best")
    near = F.greatest(F.round(X.cosine("qvec", "vec"), 6), F.lit(0.0))
    scored = both.select("query_id", "doc_id", F.round(F.when(F.col("vec").isNull() | F.col("qvec").isNull(), half).otherwise(0.5 * half + 0.5 * near), 6).alias("score"))
    return scored.withColumn("rank", R.rank_within("query_id", F.desc("score"), F.asc("doc_id"))).where("rank <= 10")


PAPER = "p AS (SELECT p_partkey AS id, p_brand AS venue, count(*) AS citations, max(year(l_shipdate)) AS year FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"


def papers_of(spark, sf):
    """Parts as papers: line items cite them, the latest ship date is their year, the brand their venue."""
    cited = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("c"), F.year(F.max("l_shipdate")).alias("year"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("venue"))
    return parts.join(cited, "id", "left").select("id", "venue", F.greatest(F.coalesce("c", F.lit(1)), F.lit(1)).alias("citations"), "year")


FACTORS = f"""{PAPER}, t AS (SELECT embedding AS qvec FROM embeddings WHERE vec_id = 0), m AS (SELECT max(citations) AS mc, min(year) AS y0, max(year) AS y1 FROM p),
f AS (SELECT id, venue, p.citations AS cites, ln(1 + citations) / ln(1 + mc) AS citations, CASE WHEN year IS NULL THEN 0.25 ELSE greatest(0, 1 - (y1 - year) * 1.0::DOUBLE / greatest(y1 - y0, 10)) END AS recency, (CAST(substr(venue, 7) AS INT) % 10) / 10.0::DOUBLE AS journal, greatest(0, coalesce({COS.format(a='qvec', b='embedding')}, 0)) AS similarity
 FROM p CROSS JOIN m CROSS JOIN t LEFT JOIN embeddings ON vec_id = id)"""


def factors(spark, sf):
    """id, venue, cites and four factors of every paper: similarity to a topic, log citations, recency over ten years or more, journal tier."""
    p = papers_of(spark, sf)
    m = p.agg(F.max("citations").alias("mc"), F.min("year").alias("y0"), F.max("year").alias("y1"))
    topic = vectors_of(spark, sf).where("doc_id = 0").select(F.col("vec").alias("qvec"))
    both = p.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(topic)).join(vectors_of(spark, sf).withColumnRenamed("doc_id", "id"), "id", "left")  # one row of bounds, one of the topic
    recency = F.when(F.col("year").isNull(), 0.25).otherwise(F.greatest(F.lit(0.0), 1 - (F.col("y1") - F.col("year")) / F.greatest(F.col("y1") - F.col("y0"), F.lit(10))))
    similarity = F.greatest(F.lit(0.0), F.coalesce(F.round(X.cosine("qvec", "vec"), 6), F.lit(0.0)))
    return both.select("id", "venue", F.col("citations").alias("cites"), (F.log1p("citations") / F.log1p("mc")).alias("citations"), recency.alias("recency"), (F.substring("venue", 7, 9).cast("int") % 10 / 10.0).alias("journal"), similarity.alias("similarity"))


@query("r11_multi_factor_rank", f"WITH {FACTORS}, s AS (SELECT id, round(greatest(0, least(1, 0.30 * similarity + 0.30 * citations + 0.25 * recency + 0.15 * journal)), 6) AS score FROM f) SELECT * FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 50")
def r11(spark, sf):
    score = 0.30 * F.col("similarity") + 0.30 * F.col("citations") + 0.25 * F.col("recency") + 0.15 * F.col("journal")
    top = factors(spark, sf).select("id", F.round(X.clamp(score), 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


@query("r12_selected_set", f"WITH {FACTORS}, u AS (SELECT *, unnest(['topic', 'none']) AS mode FROM f WHERE venue = 'Brand#3') SELECT venue, mode, count(*) AS papers, round(avg(CASE WHEN mode = 'topic' THEN 0.30 * similarity + 0.30 * citations + 0.25 * recency + 0.15 * journal ELSE 0.5 * citations + 0.5 * recency END), 6) AS mean_score, CAST(sum(cites) AS BIGINT) AS citations FROM u GROUP BY ALL")
def r12(spark, sf):
    """A selected set, with a topic by all four weights and without one by citations and recency in halves."""
    s = factors(spark, sf).where("venue = 'Brand#3'").withColumn("mode", F.explode(F.array(F.lit("topic"), F.lit("none"))))
    whole = 0.30 * F.col("similarity") + 0.30 * F.col("citations") + 0.25 * F.col("recency") + 0.15 * F.col("journal")
    score = F.when(F.col("mode") == "topic", whole).otherwise(0.5 * F.col("citations") + 0.5 * F.col("recency"))
    return s.groupBy("venue", "mode").agg(F.count(F.lit(1)).alias("papers"), F.round(F.avg(score), 6).alias("mean_score"), F.sum("cites").alias("citations"))


@query("r13_topic_similarity", f"WITH {VEC} SELECT doc_id, greatest(score, 0) AS similarity FROM vs WHERE query_id = 0")
def r13(spark, sf):
    topic = query_vectors(spark, sf).where("query_id = 0")
    return vectors_of(spark, sf).crossJoin(F.broadcast(topic)).select("doc_id", F.greatest(F.round(X.cosine("qvec", "vec"), 6), F.lit(0.0)).alias("similarity"))


#: Stand-in venue tiers over the part names; the rule is exact, then best substring, then venue words.
TIERS = {"ECONOMY": 1.0, "STANDARD": 0.9, "PROMO": 0.85, "SMALL": 0.8, "small": 0.75, "red": 0.6}
TIER_SQL = " UNION ALL ".join(f"SELECT '{k}' AS name, {v}::DOUBLE AS tier" for k, v in TIERS.items())


def venue_tier(df, spark, venue="venue"):
    """Tier of a venue: exact name, else the best name contained in it, else .45 with a venue word, .40 without, .25 if empty."""
    rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{k}', {v}D)" for k, v in TIERS.items()) + " AS t(name, tier)")
    names = df.select(venue).distinct()
    inside = names.join(F.broadcast(rows), F.contains(F.lower(venue), F.lower("name"))).groupBy(venue).agg(F.max("tier").alias("best"), F.max(F.when(F.col("name") == F.col(venue), F.col("tier"))).alias("exact"))
    other = F.when(F.trim(F.coalesce(F.col(venue), F.lit(""))) == "", 0.25).when(F.lower(venue).rlike("journal|review|transaction|proceedings|conference|symposium"), 0.45).otherwise(0.40)
    return df.join(inside, venue, "left").withColumn("tier", F.coalesce("exact", "best", other)).drop("exact", "best")


@query("r14_venue_tier", f"""WITH t AS ({TIER_SQL}), v AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_type WHEN p_partkey % 7 = 1 THEN '' WHEN p_partkey % 7 = 2 THEN 'Journal of ' || p_brand ELSE p_name END AS venue FROM part)
SELECT p_partkey, venue, coalesce((SELECT tier FROM t WHERE name = venue), (SELECT max(tier) FROM t WHERE contains(lower(venue), lower(name))), CASE WHEN venue = '' THEN 0.25::DOUBLE WHEN regexp_matches(lower(venue), 'journal|review|transaction|proceedings|conference|symposium') THEN 0.45::DOUBLE ELSE 0.40::DOUBLE END) AS tier FROM v""")
def r14(spark, sf):
    k = F.col("p_partkey") % 7
    venue = F.when(k == 0, F.col("p_type")).when(k == 1, "").when(k == 2, F.concat(F.lit("Journal of "), "p_brand")).otherwise(F.col("p_name"))
    return venue_tier(table(spark, sf, "part").select("p_partkey", venue.alias("venue")), spark).select("p_partkey", "venue", "tier")


@query("r16_match", f"""WITH {POST}, qw AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM benchmark), ve AS (SELECT * FROM embeddings WHERE vec_id % 2 = 0),
dw AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS w FROM documents)
SELECT q.item_id, d.doc_id, CASE WHEN a.vec_id IS NOT NULL AND b.vec_id IS NOT NULL THEN round(({COS.format(a='a.embedding', b='b.embedding')[6:-4]} + 1) / 2, 5)
 ELSE round(coalesce(len(list_intersect(q.w, d.w)) / nullif(len(list_distinct(list_concat(q.w, d.w))), 0), 0), 5) END AS match
FROM (SELECT query_id, doc_id FROM bmr WHERE rank <= 5) c JOIN qw q ON q.item_id = c.query_id JOIN dw d ON d.doc_id = c.doc_id LEFT JOIN ve a ON a.vec_id = q.item_id LEFT JOIN ve b ON b.vec_id = d.doc_id""")
def r16(spark, sf):
    """Every item against its five best documents by keyword: (cosine + 1) / 2 where both have a vector (here: even numbers), else Jaccard of words of four letters or more."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))
    vec = vectors_of(spark, sf).where("doc_id % 2 = 0")
    found = materialize(R.bm25(docs_of(spark, sf), asked_of(spark, sf), 5).select(F.col("query_id").alias("item_id"), "doc_id"), "found")  # its size is known then, and no text is exchanged for a few rows
    both = found.join(docs_of(spark, sf), "doc_id").withColumn("dw", words("text")).drop("text").join(table(spark, sf, "benchmark").select("item_id", words("text").alias("qw")), "item_id")
    both = both.join(vec, "doc_id", "left").join(vec.toDF("item_id", "qvec"), "item_id", "left")
    return both.select("item_id", "doc_id", F.round(F.coalesce(F.when(F.col("vec").isNotNull() & F.col("qvec").isNotNull(), (X.cosine("qvec", "vec") + 1) / 2), X.jaccard(F.col("qw"), F.col("dw"))), 5).alias("match"))


@query("r17_authority_recency", f"""WITH {PAPER}, m AS (SELECT max(citations) AS mc FROM p)
SELECT id, round(0.5 * 0.4 + 0.5 * ln(1 + citations) / ln(1 + mc), 6) AS authority, round(CASE WHEN year IS NULL THEN 0 ELSE exp(-(2001 - least(year, 2001)) / 5.0) END, 6) AS recency FROM p, m""")
def r17(spark, sf):
    p = papers_of(spark, sf)
    p = p.crossJoin(F.broadcast(p.agg(F.max("citations").alias("mc"))))
    return p.select("id", F.round(R.authority(F.lit(0.4), F.col("citations"), F.col("mc")), 6).alias("authority"), F.round(R.recency(F.col("year"), 2001), 6).alias("recency"))


@query("r18_citable", """SELECT doc_id, CAST(round(CASE WHEN coalesce(text, '') = '' THEN 0.3 ELSE least(1.0, 0.4 + CASE WHEN regexp_matches(lower(text), '(method|approach|propose|framework|model|algorithm)') THEN 0.2 ELSE 0 END
 + CASE WHEN regexp_matches(lower(text), '(result|experiment|achieve|improve|outperform|dataset|benchmark)') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '[0-9]+(\\.[0-9]+)?\\s*(%|percent|times|×|fold|accuracy|f1|bleu)') THEN 0.1 ELSE 0 END
 + CASE WHEN len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) BETWEEN 80 AND 400 THEN 0.1 ELSE 0 END) END, 4) AS DOUBLE) AS citable FROM documents""")
def r18(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.round(R.citable(F.col("text")), 4).alias("citable"))


@query("r19_readability", """SELECT doc_id, round(greatest(0, least(1, 1 - 10.0 * (length(text) - length(replace(text, '$', ''))) / greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))))), 6) AS readability FROM documents""")
def r19(spark, sf):
    words = F.size(F.filter(F.split("text", "\\s+"), lambda w: w != ""))
    return docs_of(spark, sf).select("doc_id", F.round(X.clamp(1 - 10.0 * F.regexp_count("text", F.lit("\\$")) / F.greatest(F.lit(1), words)), 6).alias("readability"))


@query("r15_recommendation_score", f"""WITH {VEC}, ci AS ({ORACLE['r18_citable']}), re AS ({ORACLE['r19_readability']}), f AS (SELECT v.query_id, v.doc_id, greatest(v.score, 0) AS m, n_chars, citable, readability, quality FROM vr v JOIN documents d ON d.doc_id = v.doc_id JOIN ci ON ci.doc_id = v.doc_id JOIN re ON re.doc_id = v.doc_id LEFT JOIN labels l ON l.doc_id = v.doc_id WHERE rank <= 50),
g AS (SELECT *, max(n_chars) OVER (PARTITION BY query_id) AS mx FROM f),
s AS (SELECT query_id, doc_id, round((0.35 * m + 0.25 * citable + 0.20 * (0.5 * 0.4 + 0.5 * ln(1 + n_chars) / ln(1 + mx)) + 0.10 * exp(-(doc_id % 20) / 5.0) + 0.10 * readability + 0.10 * coalesce(quality, 0.5)) / 1.10, 6) AS score FROM g)
SELECT query_id, doc_id, score, CASE WHEN score >= 0.70 THEN 'strong' WHEN score >= 0.50 THEN 'worth reading' ELSE 'optional' END AS tier FROM s""")
def r15(spark, sf):
    """Match, citable cues, authority (the text's length stands for citations), recency, readability and review (a label, .5 without one); the weights sum to 1.10 and are renormalised; tiers at .70 and .50."""
    found = R.vector_top(query_vectors(spark, sf), vectors_of(spark, sf), 50)
    d = table(spark, sf, "documents").select("doc_id", "n_chars").join(r18(spark, sf), "doc_id").join(r19(spark, sf), "doc_id")
    d = d.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    both = found.join(d, "doc_id").withColumn("mx", F.max("n_chars").over(Window.partitionBy("query_id")))
    parts = [
        (0.35, F.greatest(F.col("score"), F.lit(0.0))),
        (0.25, F.col("citable")),
        (0.20, R.authority(F.lit(0.4), F.col("n_chars"), F.col("mx"))),
        (0.10, F.exp(-(F.col("doc_id") % 20) / 5.0)),
        (0.10, F.col("readability")),
        (0.10, F.coalesce(F.col("quality").cast("double"), F.lit(0.5))),
    ]
    total = sum(w * c for w, c in parts) / sum(w for w, _ in parts)
    scored = both.select("query_id", "doc_id", F.round(total, 6).alias("score"))
    return scored.withColumn("tier", F.when(F.col("score") >= 0.70, "strong").when(F.col("score") >= 0.50, "worth reading").otherwise("optional"))


@query("r20_sentence_anchors", r"""WITH b AS (SELECT item_id, text AS context FROM benchmark), n AS (SELECT count(*) AS n FROM b), d AS (SELECT doc_id, text, context, regexp_extract_all(text, '[^.!?]+[.!?]?') AS m, regexp_split_to_array(text, '[^.!?]+[.!?]?') AS g FROM documents JOIN b ON item_id = doc_id % 40),
u AS (SELECT doc_id, context, unnest(m) AS s, unnest(range(1, len(m) + 1)) AS k, unnest(list_transform(range(1, len(m) + 1), lambda k: 0)) AS z FROM d),
l AS (SELECT doc_id, context, k, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k) - length(s) AS before FROM u),
gp AS (SELECT doc_id, unnest(g) AS gap, unnest(range(1, len(g) + 1)) AS k FROM d), gs AS (SELECT doc_id, k, sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY k) AS skipped FROM gp),
e AS (SELECT l.doc_id, context, l.k, trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS sentence, before + skipped AS start, before + skipped + length(s) AS "end" FROM l JOIN gs ON gs.doc_id = l.doc_id AND gs.k = l.k WHERE length(trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) >= 8),
wv AS (SELECT doc_id, k, substr(md5(w), 1, 2) AS dim, count(*) AS c FROM (SELECT doc_id, k, unnest(regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+')) AS w FROM e) GROUP BY ALL), wq AS (SELECT doc_id, k, sum(c * c) AS q FROM wv GROUP BY ALL),
cv AS (SELECT item_id, substr(md5(w), 1, 2) AS dim, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(lower(context), '[\p{L}\p{N}]+')) AS w FROM b) GROUP BY ALL), cq AS (SELECT item_id, sum(c * c) AS q FROM cv GROUP BY 1),
dt AS (SELECT wv.doc_id, wv.k, sum(wv.c * cv.c) AS d FROM wv JOIN cv ON cv.item_id = wv.doc_id % 40 AND cv.dim = wv.dim GROUP BY ALL),
s AS (SELECT e.doc_id, e.k, sentence, start, "end", coalesce(round(d / sqrt(wq.q * cq.q), 9), 0) AS sim FROM e LEFT JOIN dt ON dt.doc_id = e.doc_id AND dt.k = e.k LEFT JOIN wq ON wq.doc_id = e.doc_id AND wq.k = e.k LEFT JOIN cq ON cq.item_id = e.doc_id % 40)
SELECT doc_id, rank, start::BIGINT AS start, "end"::BIGINT AS "end", sha256(sentence) AS sentence, sim FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, k) AS rank FROM s) WHERE rank <= 3""")
def r20(spark, sf):
    """The three sentences of eight characters or more that are closest to the reader's text (a benchmark item), with their places in the document."""
    context = table(spark, sf, "benchmark").select((F.col("item_id")).alias("__item"), F.col("text").alias("context"))
    both = docs_of(spark, sf).select("doc_id", "text").join(context, F.col("doc_id") % 40 == F.col("__item")).drop("__item")
    found = anchors(both, "text", "context", hashed_words).select("doc_id", F.posexplode("anchors").alias("rank", "a"))
    return found.select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("a.start").alias("start"), F.col("a.end").alias("end"), F.sha2("a.text", 256).alias("sentence"), F.col("a.sim").alias("sim"))


TOPIC = ["then", "ation", "hein", "menter"]


@query("r21_topic_hits", "SELECT doc_id, " + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in TOPIC) + " AS hits, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w}' END" for w in TOPIC) + "], lambda x: x IS NOT NULL), ',') AS terms FROM documents")
def r21(spark, sf):
    return docs_of(spark, sf).select("doc_id", X.hits(F.lower("text"), TOPIC).alias("hits"), F.concat_ws(",", *[F.when(F.contains(F.lower("text"), F.lit(w)), w) for w in TOPIC]).alias("terms"))


@query("r22_objective_impact", f"WITH {PAPER} SELECT id, round(0.5 * least(1, citations / 200.0) + 0.3 * least(1, (citations % 17) / 50.0) + 0.2 * least(1, n_chars / 16666.0), 6) AS impact FROM p JOIN documents ON doc_id = id")
def r22(spark, sf):
    one = lambda c: F.least(F.lit(1.0), c)
    both = papers_of(spark, sf).join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars"), "id")
    return both.select("id", F.round(0.5 * one(F.col("citations") / 200.0) + 0.3 * one(F.col("citations") % 17 / 50.0) + 0.2 * one(F.col("n_chars") / 16666.0), 6).alias("impact"))


FALLBACK = f"""WITH k AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{6,}}'))  AS ws, regexp_extract_all(lower(text), '[a-z]{{6,}}') AS seq FROM benchmark),
u AS (SELECT item_id, word, min(pos) AS first FROM (SELECT item_id, unnest(seq) AS word, unnest(range(1, len(seq) + 1)) AS pos FROM k) GROUP BY ALL),
five AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY first) AS pos FROM u) WHERE pos <= 5),
post AS (SELECT DISTINCT doc_id, unnest({TOK.format('text')}) AS word FROM documents),
hit AS (SELECT item_id, pos, doc_id, row_number() OVER (PARTITION BY item_id, pos ORDER BY doc_id) AS k FROM five JOIN post USING (word)),
m AS (SELECT item_id, doc_id, min(pos) AS pos FROM hit WHERE k <= 10 GROUP BY ALL)"""


def fallback(spark, sf):
    """For each of a query's first five keywords the first ten documents; a document counts for its earliest keyword."""
    seq = table(spark, sf, "benchmark").select("item_id", F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))), 1, 5).alias("w"))
    five = seq.select("item_id", F.posexplode("w").alias("pos", "term"))
    hit = five.join(R.postings(docs_of(spark, sf), five).select("term", "doc_id"), "term").withColumn("k", R.rank_within(["item_id", "pos"], F.asc("doc_id"))).where("k <= 10")
    return hit.groupBy("item_id", "doc_id").agg((F.min("pos") + 1).cast("long").alias("pos"))


@query("r23_keyword_fallback", f"{FALLBACK} SELECT item_id, doc_id, pos FROM m")
def r23(spark, sf):
    return fallback(spark, sf)


@query("r24_context_assembly", f"""{FALLBACK}, o AS (SELECT m.item_id, row_number() OVER (PARTITION BY m.item_id ORDER BY pos, doc_id) AS n, 'Document ' || doc_id || ' (' || (1990 + doc_id % 35) || ', ' || coalesce(source, '') || ') ' || trim(substr(coalesce(d.text, ''), 1, 400)) AS row FROM m JOIN documents d USING (doc_id))
SELECT item_id, string_agg('[' || n || '] ' || row, chr(10) || chr(10) ORDER BY n) AS context FROM o WHERE n <= 5 GROUP BY item_id""")
def r24(spark, sf):
    """Numbered rows with title, year, authors (the source stands for them) and the first 400 characters of the text."""
    ranked = fallback(spark, sf).withColumn("n", R.rank_within("item_id", F.asc("pos"), F.asc("doc_id"))).where("n <= 5")
    k = F.col("doc_id")
    row = F.concat(F.lit("Document "), k.cast("string"), F.lit(" ("), (1990 + k % 35).cast("string"), F.lit(", "), F.coalesce("source", F.lit("")), F.lit(") "), F.trim(F.substring(F.coalesce("text", F.lit("")), 1, 400)))
    heads = ranked.join(table(spark, sf, "documents").select("doc_id", row.alias("row")), "doc_id")
    rows = heads.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("n", "row"))).alias("rows"))
    return rows.select("item_id", F.array_join(F.transform("rows", lambda r: F.concat(F.lit("["), r["n"].cast("string"), F.lit("] "), r["row"])), "\n\n").alias("context"))


@query("j25_parent_child_fusion", """WITH pr AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), t AS (SELECT * FROM pr WHERE rank <= 500)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / 100000 + 12.0 / (60 + coalesce(rank, 9999)), 6) AS score FROM lineitem LEFT JOIN t ON o_orderkey = l_orderkey""")
def j25(spark, sf):
    top = table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(500)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey"))).select(F.col("o_orderkey").alias("l_orderkey"), "rank")
    score = F.col("l_extendedprice") / 100000 + 12.0 / (60 + F.coalesce("rank", F.lit(9999)))
    return table(spark, sf, "lineitem").join(top, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score, 6).alias("score"))


@query("f2_substring_search", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_brand), '#1') OR contains(lower(p_type), '100%')")
def f2(spark, sf):
    """Literal, case-insensitive; % and _ in a term have no special meaning."""
    found = [F.contains(F.lower(c), F.lit(w)) for c, w in (("p_name", "red"), ("p_brand", "#1"), ("p_type", "100%"))]
    return table(spark, sf, "part").where(found[0] | found[1] | found[2]).select("p_partkey", "p_name", "p_brand")


@query("f3_index_then_substring", f"""WITH t AS (SELECT unnest(['the', 'zqx', 'tion', 'hein']) AS term), post AS (SELECT DISTINCT doc_id, unnest({TOK.format('text')}) AS term FROM documents),
h AS (SELECT term, doc_id FROM t JOIN post USING (term)), s AS (SELECT t.term, d.doc_id FROM t JOIN documents d ON contains(lower(d.text), t.term) WHERE t.term NOT IN (SELECT term FROM h))
SELECT term, doc_id, 'index' AS how FROM h UNION ALL SELECT term, doc_id, 'substring' FROM s""")
def f3(spark, sf):
    terms = spark.sql("SELECT * FROM VALUES ('the'), ('zqx'), ('tion'), ('hein') AS t(term)")
    hit = R.postings(docs_of(spark, sf), terms).select("term", "doc_id")
    none = terms.join(hit.select("term").distinct(), "term", "left_anti")
    sub = containing_any(docs_of(spark, sf), none).select("term", "doc_id")
    return hit.withColumn("how", F.lit("index")).unionByName(sub.withColumn("how", F.lit("substring")))


@query("f4_any_field_match", "SELECT p_partkey FROM part WHERE contains(lower(p_type), 'mo') OR len(list_filter(string_split(p_name, ' '), lambda w: contains(lower(w), 'ge'))) > 0")
def f4(spark, sf):
    return table(spark, sf, "part").where(F.contains(F.lower("p_type"), F.lit("mo")) | F.exists(F.split("p_name", " "), lambda w: F.contains(F.lower(w), F.lit("ge")))).select("p_partkey")


@query("f5_regex_search", "SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?i)hein') OR regexp_matches(source, '(?i)rc1$') ORDER BY doc_id DESC LIMIT 100")
def f5(spark, sf):
    return table(spark, sf, "documents").where(F.col("text").rlike("(?i)hein") | F.col("source").rlike("(?i)rc1$")).select("doc_id", "source").orderBy(F.desc("doc_id")).limit(100)


@query("f6_combined_filters", "SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND contains(lower(text), 'tion')")
def f6(spark, sf):
    """Any of category, favourites and keyword may be given."""
    given = {"category": "fr", "keyword": "tion"}
    docs = table(spark, sf, "documents")
    if "category" in given:
        docs = docs.where(F.col("lang") == given["category"])
    docs = docs.join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    if "keyword" in given:
        docs = docs.where(F.contains(F.lower("text"), F.lit(given["keyword"])))
    return docs.select("doc_id", "lang")
