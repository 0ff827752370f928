"""Sources, sinks, incremental intake and data quality (S, Q)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quireflow.operators.ranking import rank_within
from quireflow.plans.registry import query
from quireflow.session import table
from quireflow.sources.scratch import materialize, scratch_path


def n_rows():
    return F.count(F.lit(1))


def written(df, kind, **options):
    """Write df in a text format below the shared folder; returns the path."""
    path = scratch_path(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(path)
    return path


@query("s2_json_documents", "SELECT source, doc_id, n_chars FROM documents")
def s2(spark, sf):
    """JSON documents, each a list or an object with `samples`, to rows."""
    d = table(spark, sf, "documents").groupBy("source", (F.col("doc_id") % 16).alias("k")).agg(F.collect_list(F.struct("source", "doc_id", "n_chars")).alias("rows"))
    text = F.when(F.col("k") % 2 == 0, F.to_json("rows")).otherwise(F.to_json(F.struct(F.col("rows").alias("samples"))))
    raw = spark.read.text(written(d.select(text.alias("value")), "text"))
    rows = "array<struct<source:string,doc_id:bigint,n_chars:bigint>>"
    both = F.coalesce(F.from_json("value", f"samples {rows}")["samples"], F.from_json("value", rows))
    return raw.select(F.inline(both))


@query("s3_csv_with_bom", "SELECT p_partkey, p_size FROM part")
def s3(spark, sf):
    """A header with a byte order mark; the first column's name is cleaned."""
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("﻿p_partkey"), "p_size")
    found = spark.read.csv(written(d, "csv", header=True), header=True)
    return found.toDF(*[c.lstrip("﻿") for c in found.columns]).select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"))


@query("s4_json_lines", "SELECT l_orderkey AS id, l_quantity AS score FROM lineitem WHERE l_linenumber <> 7 AND l_partkey % 11 <> 0")
def s4(spark, sf):
    """Bad lines and rows without a score are skipped; the first of two field names that is filled counts."""
    k = F.col("l_linenumber")
    js = F.when(k == 7, "{broken").when(F.col("l_partkey") % 11 == 0, F.to_json(F.struct(F.col("l_orderkey").alias("id")))).when(k % 2 == 0, F.to_json(F.struct(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("score")))).otherwise(F.to_json(F.struct(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("raw_score"))))
    path = written(table(spark, sf, "lineitem").select(js.alias("value")), "text")
    rows = spark.read.schema("id bigint, score double, raw_score double, bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="bad")
    return rows.where("bad is null").select("id", F.coalesce("score", "raw_score").alias("score")).where("score is not null")


@query("s5_append_log", "WITH o AS (SELECT user_id, max_by(value, event_id) FILTER (WHERE event_type <> 'error') AS v FROM events GROUP BY 1) SELECT user_id, v, c_name FROM o JOIN customer ON c_custkey = user_id WHERE v IS NOT NULL")
def s5(spark, sf):
    """The last record that succeeded wins, then the pairs are joined."""
    last = table(spark, sf, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.max_by("value", "event_id").alias("v"))
    return last.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id").where("v is not null")


@query("s6_atom_feed", "SELECT 'part' || p_partkey AS id, p_name AS title, 2000 + p_size AS year, p_type || ';' || p_brand AS categories FROM part")
def s6(spark, sf):
    """Atom entries to rows: id without its version, year, categories."""
    p = table(spark, sf, "part")
    entry = F.concat(F.lit("<entry><id>http://feed.example/abs/part"), F.col("p_partkey").cast("string"), F.lit("v2</id><title>"), "p_name", F.lit("</title><published>"), (2000 + F.col("p_size")).cast("string"), F.lit("-01-02T00:00:00Z</published><category term=\""), "p_type", F.lit("\"/><category term=\""), "p_brand", F.lit("\"/></entry>"))
    path = written(p.select(entry.alias("value")), "text")
    schema = "id string, title string, published string, category array<struct<_term:string>>"
    rows = spark.read.format("xml").options(rowTag="entry", multiLine="false").schema(schema).load(path)
    bare = F.regexp_replace(F.element_at(F.split("id", "/"), -1), "v[0-9]+$", "")
    return rows.select(bare.alias("id"), "title", F.substring("published", 1, 4).cast("int").alias("year"), F.array_join("category._term", ";").alias("categories"))


@query("s7_fixed_chunks", "SELECT doc_id, i AS chunk, length(substr(text, 1 + i * 448, 512)) AS chars FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 448.0) AS BIGINT), 1))) AS i FROM documents)")
def s7(spark, sf):
    """Windows of 512 characters that overlap by 64, at least one."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    last = F.greatest(F.ceil(F.length("text") / 448.0).cast("long"), F.lit(1)) - 1
    parts = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.col("text").substr((1 + i * 448).cast("int"), F.lit(512)))
    return d.select("doc_id", F.posexplode(parts).alias("p", "c")).select("doc_id", F.col("p").cast("long").alias("chunk"), F.length("c").cast("long").alias("chars"))


@query("s9_page_sources", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, 'clip_web_' || substr(sha1(url), 1, 16) AS id FROM pages")
def s9(spark, sf):
    host = F.parse_url("url", F.lit("HOST"))
    kind = F.when(host.rlike("arxiv"), "arxiv").when(host.rlike("doi\\.org"), "doi").otherwise("web")
    return table(spark, sf, "pages").select("page_id", host.alias("host"), F.concat_ws("_", F.lit("clip"), kind, F.substring(F.sha1("url"), 1, 16)).alias("id"))


@query("s10_flattened_export", "WITH n AS (SELECT user_id AS doc_id, count(*) AS notes FROM events GROUP BY 1) SELECT d.doc_id, coalesce(notes, 0) AS notes, l.doc_id IS NOT NULL AS favourite FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE trim(d.text) <> ''")
def s10(spark, sf):
    notes = table(spark, sf, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.collect_list(F.struct("event_id", "event_type")).alias("list"))
    fav = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("favourite"))
    out = table(spark, sf, "documents").where("trim(text) <> ''").select("doc_id").join(notes, "doc_id", "left").join(fav, "doc_id", "left")
    back = spark.read.schema("doc_id bigint, list array<struct<event_id:bigint>>, favourite boolean").json(written(out, "json"))
    return back.select("doc_id", F.coalesce(F.size("list"), F.lit(0)).cast("long").alias("notes"), F.coalesce("favourite", F.lit(False)).alias("favourite")).withColumn("notes", F.greatest("notes", F.lit(0)))


@query("s12_upsert", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 50 = 0")
def s12(spark, sf):
    """Incoming rows replace stored ones with the same key, others are added."""
    old = table(spark, sf, "embeddings").select("vec_id", "label")
    new = old.where("vec_id % 10 = 0").select("vec_id", (F.col("label") + 100).alias("label")).union(old.where("vec_id % 50 = 0").select(F.col("vec_id") + 1000000, "label"))
    both = old.withColumn("p", F.lit(0)).unionByName(new.withColumn("p", F.lit(1)))
    return both.groupBy("vec_id").agg(F.max_by("label", "p").alias("label"))


@query("s14_idempotent_import", "SELECT event_type AS keyword, CAST(count(*) FILTER (WHERE event_id % 3 = 0) AS BIGINT) AS skipped, CAST(count(*) FILTER (WHERE event_id % 3 <> 0 AND event_id % 10 <> 1) AS BIGINT) AS added, CAST(count(*) FILTER (WHERE event_id % 3 <> 0 AND event_id % 10 = 1) AS BIGINT) AS failed FROM events GROUP BY 1")
def s14(spark, sf):
    """Ids that are there are skipped; of the others, records without a title fail and the rest are added."""
    title = F.when(F.col("event_id") % 10 != 1, F.concat(F.lit("event "), F.col("event_id").cast("string")))
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("keyword"), title.alias("title"))
    there = e.where("event_id % 3 = 0").select("event_id", F.lit(1).alias("seen"))
    both = e.join(there, "event_id", "left")
    return both.groupBy("keyword").agg(F.count("seen").alias("skipped"), F.count_if(F.expr("seen IS NULL AND title IS NOT NULL")).alias("added"), F.count_if(F.expr("seen IS NULL AND title IS NULL")).alias("failed"))


@query("s15_hash_cache", "SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 8 = 0")
def s15(spark, sf):
    """Only (id, hash) pairs not done yet; a changed text has another hash."""
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    done = d.where("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, "stale").otherwise(F.col("hash")).alias("hash"))
    return d.join(done, ["doc_id", "hash"], "left_anti")


DIRTY = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN '' WHEN 2 THEN '[\"a\",\"b\"]' WHEN 3 THEN 'Alice, Bob' WHEN 4 THEN '{\"k\":1}' END AS raw FROM events"


def dirty(spark, sf):
    """A column of lists as found: literal null, empty, a list, plain text, an object, SQL null, a list in a string."""
    k = F.col("event_id") % 6
    raw = F.when(k == 0, "null").when(k == 1, "").when(k == 2, '["a","b"]').when(k == 3, "Alice, Bob").when(k == 4, '{"k":1}')
    return table(spark, sf, "events").select("event_id", raw.alias("raw"))


def issue(raw):
    """Issue code of a column that should hold JSON lists; null if there is none."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    return F.when(raw.isNull(), "NULL_VIOLATION").when(F.trim(raw) == "", "EMPTY").when(kind.isNull(), "NOT_JSON").when(kind == "VOID", "JSON_NULL").when(kind == "STRING", "DOUBLE_ENCODED").when(~kind.startswith("ARRAY"), "TYPE_MISMATCH")


@query("q1_json_issues", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'JSON_NULL' WHEN 1 THEN 'EMPTY' WHEN 3 THEN 'NOT_JSON' WHEN 4 THEN 'TYPE_MISMATCH' WHEN 5 THEN 'NULL_VIOLATION' END AS code FROM ({DIRTY})")
def q1(spark, sf):
    return dirty(spark, sf).select("event_id", issue(F.col("raw")).alias("code"))


@query("q2_vector_checks", "SELECT vec_id, CASE WHEN len(embedding) <> 64 THEN 'DIM' WHEN len(list_filter(embedding, lambda x: isnan(x))) > 0 THEN 'NAN' ELSE 'OK' END AS code FROM embeddings")
def q2(spark, sf):
    bad = F.exists("embedding", lambda x: F.isnan(x) | x.isNull())
    return table(spark, sf, "embeddings").select("vec_id", F.when(F.size("embedding") != 64, "DIM").when(bad, "NAN").otherwise("OK").alias("code"))


@query("q3_issue_report", "SELECT code, count(*) AS n, array_to_string(list_sort(list(event_id))[1:3], ',') AS samples FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'JSON_NULL' WHEN 1 THEN 'EMPTY' WHEN 3 THEN 'NOT_JSON' WHEN 4 THEN 'TYPE_MISMATCH' WHEN 5 THEN 'NULL_VIOLATION' END AS code FROM events) WHERE code IS NOT NULL GROUP BY 1")
def q3(spark, sf):
    """The three smallest ids of each code are found by rank, so no group is gathered."""
    c = q1(spark, sf).where("code is not null")
    few = c.withColumn("k", rank_within("code", F.asc("event_id"))).where("k <= 3").groupBy("code").agg(F.array_join(F.sort_array(F.collect_list("event_id")), ",").alias("samples"))
    return c.groupBy("code").agg(n_rows().alias("n")).join(few, "code")


@query("q4_safe_repair", f"SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'a;b' WHEN 3 THEN 'Alice;Bob' WHEN 4 THEN '{{\"k\":1}}' END AS repaired FROM ({DIRTY})")
def q4(spark, sf):
    """Literal null and empty to null, comma text to a list; an object in a list column is left as it is."""
    code = issue(F.col("raw"))
    fixed = F.when(code.isin("JSON_NULL", "EMPTY", "NULL_VIOLATION"), None).when(code == "NOT_JSON", F.array_join(F.split("raw", "\\s*,\\s*"), ";")).when(code == "TYPE_MISMATCH", F.col("raw")).otherwise(F.array_join(F.from_json("raw", "array<string>"), ";"))
    return dirty(spark, sf).select("event_id", fixed.alias("repaired"))


@query("q5_backfill_blanks", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 99 ELSE p_size END AS size FROM part")
def q5(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 5 == 0, 0).otherwise(F.col("p_size")).alias("x"))
    source = table(spark, sf, "part").select("p_partkey", F.lit(99).alias("y"))
    return p.join(source, "p_partkey", "left").select("p_partkey", F.coalesce(F.nullif("x", F.lit(0)), "y").alias("size"))


@query("q7_losing_last_record", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')")
def q7(spark, sf):
    """Parents all of whose records are of the wrong kind."""
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_returnflag") == "R").alias("all_bad")).where("all_bad")
    return table(spark, sf, "orders").select("o_orderkey").join(g.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")


@query("q8_placeholder_findings", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 = 0 THEN 'MALFORMED' ELSE l_returnflag END AS type FROM lineitem")
def q8(spark, sf):
    """A finding that doesn't parse becomes a placeholder with its id."""
    raw = F.when(F.col("l_partkey") % 5 == 0, "not json").otherwise(F.to_json(F.struct(F.col("l_returnflag").alias("type"))))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(F.from_json(raw, "type string")["type"], F.lit("MALFORMED")).alias("type"))


def rank_all(df, *order):
    """Add `number`, the place in the whole order from 1: a range sort is written, then places within its partitions are shifted by the counts before them."""
    placed = materialize(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__id", 33)
    counts = placed.groupBy(part.alias("__part")).agg(n_rows().alias("n"))  # one row for each partition of the sort
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))
    number = F.col("__id").bitwiseAND((1 << 33) - 1) + F.col("before") + 1
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("number", number).drop("__id", "__part", "before")


@query("s11_score_sheet", "SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS number, p_partkey, p_size AS score FROM part WHERE p_size > 10")
def s11(spark, sf):
    """Scores in JSON joined to their records, ranked by the global rank of a range sort, written as CSV and read back."""
    p = table(spark, sf, "part")
    review = p.select("p_partkey", F.to_json(F.struct(F.col("p_size").alias("score"))).alias("review"))
    both = p.select("p_partkey", "p_retailprice").join(review, "p_partkey").select("*", F.get_json_object("review", "$.score").cast("int").alias("score")).where("score > 10")
    sheet = rank_all(both, F.desc("p_retailprice"), F.asc("p_partkey")).select("number", "p_partkey", "score")
    return spark.read.schema("number bigint, p_partkey bigint, score int").csv(written(sheet, "csv", header=True), header=True)


@query("s11_score_summary", "WITH s AS (SELECT p_size / 60.0::DOUBLE AS score FROM part WHERE p_size > 10) SELECT count(*) AS papers, round(min(score), 3) AS lowest, round(max(score), 3) AS highest, round(sum(CAST(round(score * 60) AS BIGINT)) / 60.0::DOUBLE / count(*), 3) AS mean FROM s")
def s11_summary(spark, sf):
    """The sheet's closing row: number of papers, lowest, highest and mean score."""
    size = F.get_json_object(F.to_json(F.struct(F.col("p_size").alias("score"))), "$.score").cast("int")
    s = table(spark, sf, "part").select(size.alias("k")).where("k > 10")
    return s.agg(F.count(F.lit(1)).alias("papers"), F.round(F.min("k") / 60.0, 3).alias("lowest"), F.round(F.max("k") / 60.0, 3).alias("highest"), F.round(F.sum("k") / 60.0 / F.count(F.lit(1)), 3).alias("mean"))


@query("s13_mirror_findings", "SELECT l_orderkey, l_linenumber, l_returnflag AS type FROM lineitem")
def s13(spark, sf):
    """Index rows of parents that come again are replaced by their findings; other parents keep theirs."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("type"))
    again = F.col("l_orderkey") % 2 == 0
    stored = lines.select("l_orderkey", "l_linenumber", F.when(again, "stale").otherwise(F.col("type")).alias("type"))
    arrived = lines.where(again).groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "type")).alias("findings"))
    return stored.join(arrived.select("l_orderkey"), "l_orderkey", "left_anti").unionByName(arrived.select("l_orderkey", F.inline("findings")))


@query("s16_reference_export", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'article-journal' WHEN p_size % 3 = 1 THEN 'paper-conference' ELSE 'article' END AS type, split_part(p_name, ' ', 1) AS given, CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE '' END AS family, CASE WHEN p_size % 2 = 0 THEN '10.1/' || p_partkey ELSE 'http://x.example/' || p_partkey END AS link FROM part")
def s16(spark, sf):
    """Nested reference records, written as JSON and read back; an identifier goes before a URL. The venue and the author are built from part."""
    p = table(spark, sf, "part")
    venue = F.element_at(F.array(F.lit("Journal of X"), F.lit("Proceedings of X"), F.lit("")), F.col("p_size") % 3 + 1)
    kind = F.when(venue.startswith("Journal"), "article-journal").when(venue.startswith("Proceedings"), "paper-conference").otherwise("article")
    number = F.col("p_partkey").cast("string")
    authors = F.transform(F.array("p_name"), lambda a: F.struct(F.substring_index(a, " ", 1).alias("given"), F.when(F.instr(a, " ") > 0, F.expr("substring(p_name, instr(p_name, ' ') + 1)")).otherwise("").alias("family")))
    out = p.select("p_partkey", kind.alias("type"), authors.alias("author"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("10.1/"), number)).alias("DOI"), F.concat(F.lit("http://x.example/"), number).alias("URL"))
    back = spark.read.schema(out.schema).json(written(out, "json"))
    return back.select("p_partkey", "type", F.col("author")[0]["given"].alias("given"), F.col("author")[0]["family"].alias("family"), F.coalesce("DOI", "URL").alias("link"))


@query("q6_backfill_findings", "SELECT l_orderkey, l_linenumber, l_returnflag AS type FROM lineitem")
def q6(spark, sf):
    """Index rows that are missing are filled from the findings stored with their parent; those there stay."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("type"))
    source = lines.groupBy("l_orderkey").agg(F.to_json(F.collect_list(F.struct("l_linenumber", "type"))).alias("findings"))
    there = lines.where("l_linenumber % 2 = 0")
    found = source.select("l_orderkey", F.inline(F.from_json("findings", "array<struct<l_linenumber:int,type:string>>")))
    kinds = [(f.name, f.dataType) for f in lines.schema.fields]
    found = found.select(*[F.col(n).cast(t).alias(n) for n, t in kinds])
    return there.unionByName(found.join(there.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "left_anti"))
