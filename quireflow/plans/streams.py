"""Streaming queries (T) and their batch twins; streams run over all that is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from quireflow.plans.registry import query
from quireflow.session import table
from quireflow.sources.scratch import scratch_path
from quireflow.streaming import flows


@query("t1_folder_watch", "SELECT event_id, value FROM events WHERE length(props) <= 9")
def t1(spark, sf):
    """New files are read as they come; entries beyond a size limit are left out."""
    return flows.drain(flows.stream_of(spark, sf, "events").where(F.length("props") <= 9).select("event_id", "value"), name="watch")


ORDERED = "e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query("t2_debounce", f"WITH RECURSIVE {ORDERED}, r AS (SELECT user_id, event_id, k, t AS last, true AS kept FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.t - r.last >= 3600 THEN e.t ELSE r.last END, e.t - r.last >= 3600 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT user_id, event_id FROM r WHERE kept")
def t2(spark, sf):
    """A stream that folds its events in event time; the batch twin gives the same, late events included."""
    return flows.debounce(flows.stream_of(spark, sf, "events"), 3600)


@query("t3_periodic_ingest", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def t3(spark, sf):
    """Ids that are there already, or that an earlier batch brought, are skipped; a repeated batch changes nothing."""
    there = table(spark, sf, "events").where("event_id % 3 = 0").select("event_id")
    return flows.ingest_new(flows.stream_of(spark, sf, "events").select("event_id"), "event_id", there)


@query("t4_token_bucket", f"WITH RECURSIVE {ORDERED}, r AS (SELECT user_id, event_id, k, t, 1.0::DOUBLE AS have FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, e.t, least(1.0, CASE WHEN have >= 1 THEN have - 1 ELSE have END + (e.t - r.t) * 1.0 / 60) FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT user_id, event_id, have >= 1 AS allowed FROM r")
def t4(spark, sf):
    """A stream that folds its events in event time; the batch twin gives the same, late events included."""
    return flows.token_bucket(flows.stream_of(spark, sf, "events"), 1.0)


@query("t5_rolling_usage", "SELECT start, user_id, count(*) AS n FROM (SELECT user_id, unnest(list_transform(range(24), lambda h: b - to_hours(CAST(h AS INTEGER)))) AS start FROM (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') AS b FROM events)) GROUP BY ALL")
def t5(spark, sf):
    """Update mode: a batch's changed hours replace their rows, the watermark lets old ones go, and windows are summed from hours."""
    return flows.rolling(flows.stream_of(spark, sf, "events"))


@query("t6_latest_progress", "SELECT user_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def t6(spark, sf):
    s = flows.stream_of(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return flows.drain(s, "update", "progress", ("user_id",))


@query("t7_stuck", "WITH n AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events), m AS (SELECT epoch_us(max(ts)) // 1000 AS now FROM events) SELECT user_id, epoch_us(ts) AS last FROM n, m WHERE (next IS NULL OR epoch_us(next) - epoch_us(ts) > 21600000000) AND (epoch_us(ts) + 999) // 1000 + 21600000 <= now - 600000")
def t7(spark, sf):
    """Last event before each silence of over six hours, by event-time timers; the batch twin gives the same."""
    return flows.drain(flows.silences(flows.stream_of(spark, sf, "events"), 21_600_000), name="stuck", **flows.ROCKS)


@query("t8_daily_snapshot", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL")
def t8(spark, sf):
    """Update mode into a keyed table: a batch writes the days it changed; repeated, it changes nothing."""
    s = flows.stream_of(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return flows.drain(s, "update", "snapshot", ("user_id", "day"))


@query("t9_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.s")
def t9(spark, sf):
    return flows.sessions(table(spark, sf, "events"))


@query("t10_retry_batch", "WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type = 'error' ORDER BY event_id) AS k FROM events) SELECT event_id, CASE WHEN event_type = 'error' AND k <= 100 THEN CASE WHEN value >= 40 THEN 'resolved' WHEN value >= 20 THEN 'failed' ELSE 'error' END ELSE event_type END AS status FROM r")
def t10(spark, sf):
    """States as a stream; after each batch the first 100 rows in the state to retry are tried again."""
    s = flows.stream_of(spark, sf, "events").select("event_id", F.col("event_type").alias("status"), "value")
    resolve = F.when(F.col("value") >= 40, "resolved").when(F.col("value") >= 20, "failed").otherwise(F.col("status"))
    retries = flows.Retries(spark, scratch_path(spark, "retries"), s.schema, "event_id", "error", resolve, 100)
    flows.run(s, retries.apply)
    return retries.table.rows().select("event_id", "status")


@query("s12_stream_upsert", "SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def s12_stream(spark, sf):
    """Upsert by key from a stream: of a batch the newest row of each key, and over batches the newest that is stored."""
    return flows.upsert(flows.stream_of(spark, sf, "events").select("user_id", "ts", "event_id", "value"), ("user_id",), "ts", "event_id").select("user_id", "event_id", "value")
