"""The contract queries op1 to op13 over the driver's documents table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm.alignment import align_tokenizers
from quireflow.llm.bpe import bpe_encode
from quireflow.llm.collocations import collocations
from quireflow.llm.exact_dedup import exact_dedup
from quireflow.llm.gif import BINS, read_gifs, store_gifs
from quireflow.llm.mixing import mix_sources
from quireflow.llm.packing import pack_documents
from quireflow.llm.quality import score_quality
from quireflow.llm.secrets import scan_secrets, span_text
from quireflow.llm.sharding import shuffle_shards
from quireflow.llm.simhash import simhash_groups
from quireflow.llm.substring import substring_dedup
from quireflow.llm.token_files import token_file_round_trip
from quireflow.session import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return score_quality(docs, table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: 8 shards whose counts differ by one at most, as a uniform shuffle."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return shuffle_shards(rows, 8, tiebreak="text_crc32").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_encode(table(spark, sf_dir, "documents"), WORD_BPE)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, len(words) AS n, unnest(range(1, len(words) - 18)) AS s, words FROM d WHERE len(words) >= 20),
g AS (SELECT doc_id, s, array_to_string(list_slice(words, s, s + 19), ' ') AS g FROM w),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r WHERE k > 1),
t AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM d),
k AS (SELECT t.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY t.p) AS kept_text
      FROM t LEFT JOIN gone ON gone.doc_id = t.doc_id AND gone.p = t.p WHERE gone.p IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(kept, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: frames, total milliseconds, then counts of the 8 colour bins over all frames."""
    found = read_gifs(store_gifs(table(spark, sf_dir, "documents")))
    total = lambda field: F.aggregate(F.transform("frames", field), F.lit(0).cast("long"), lambda a, x: a + x)
    sums = [F.expr(f"aggregate(frames, 0L, (a, f) -> a + f.hist[{b}])") for b in range(BINS)]
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("luma").cast("long").alias("payload_bytes"),
        F.sha2("luma", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(luma, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("frames"), total(lambda f: f["delay_ms"]), *sums).alias("feature"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_text("base_spans"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_file_round_trip(table(spark, sf_dir, "documents"), WORD_BPE)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (SELECT lang, pieces, unnest(range(1, len(pieces) + 1)) AS i FROM (
        SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents)),
w AS (SELECT lang, regexp_extract_all(pieces[i], '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, list_slice(w, s, s + k - 1) AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, g, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= 30),
x AS (SELECT c.lang, c.k, c.g, c.a, j, l.f AS l, r.f AS r, 2000000 * c.a // (l.f + r.f) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
      JOIN f l ON l.lang = c.lang AND l.k = j AND l.g = list_slice(c.g, 1, j)
      JOIN f r ON r.lang = c.lang AND r.k = c.k - j AND r.g = list_slice(c.g, j + 1, c.k)),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
h AS (SELECT lang, list_slice(g, s, s + m - 1) AS g, max(a) AS longer FROM (
        SELECT lang, g, a, m, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN h ON h.lang = b.lang AND h.g = b.g WHERE h.longer IS NULL OR 100 * h.longer < 80 * b.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)) JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
k AS (SELECT doc_id, source, size,
        -ln((('0x' || substr(md5('13:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
        / ((0.1::DOUBLE + 0.9::DOUBLE * CASE WHEN text = '' THEN 0 ELSE length(regexp_replace(text, '[^\p{L}]+', '', 'g'))::DOUBLE / length(text)::DOUBLE END)
           * (0.25::DOUBLE + 0.75::DOUBLE * least(1::DOUBLE, size::DOUBLE / 50))) AS draw FROM d),
s AS (SELECT source, sum(size)::HUGEINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS w FROM d GROUP BY source),
c AS (SELECT *, coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS done,
        (sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS open, (sum(source_size) OVER ())::HUGEINT AS total
      FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
f AS (SELECT 3 * total - 4 * done AS pool, 2 * open AS over FROM c WHERE w * (3 * total - 4 * done) <= source_size * 4 * open ORDER BY done, open DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN w * pool > 2 * source_size * over THEN (2 * source_size)::DOUBLE ELSE (w * pool)::DOUBLE / over::DOUBLE END AS target,
        CASE WHEN w * pool > 2 * source_size * over THEN 2 * source_size ELSE (w * pool) // over END AS words FROM s, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS epochs FROM t),
r AS (SELECT k.*, source_size, target, epochs, words - epochs * source_size - (sum(size) OVER (PARTITION BY k.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size) AS room
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size::BIGINT AS size, source_size::BIGINT AS source_size, target, epochs::BIGINT AS epochs, (epochs * size + greatest(0, least(room, size)))::BIGINT AS taken FROM r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op6_substring_dedup": OP6_SQL, "op11_collocations": OP11_SQL, "op13_mixing": OP13_SQL}
