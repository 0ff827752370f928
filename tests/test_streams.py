"""Streams over several micro-batches, with late events and repeated batches, against their batch twins."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quireflow.sources.scratch import scratch_path
from quireflow.streaming import flows
from quireflow.streaming.tables import EpochTable

EVENTS = "event_id long, ts timestamp, user_id long, value double"
N, FILES, DELAY = 1500, 5, 600


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Five files; an event comes at most 500 seconds after a newer one, also over the border of files."""
    rng = random.Random(3)
    at = tmp_path_factory.mktemp("events")
    times = sorted(rng.randrange(0, 3 * 86400) + rng.random() for _ in range(N))
    rows = sorted(((k, 1_700_000_000 + t, rng.randrange(9), float(rng.randrange(50))) for k, t in enumerate(times)), key=lambda r: r[1] + rng.random() * 500)
    for f in range(FILES):
        part = rows[f * N // FILES : (f + 1) * N // FILES]
        spark.createDataFrame(part, "event_id long, t double, user_id long, value double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).select("event_id", "ts", "user_id", "value").coalesce(1).write.parquet(f"{at}/events.parquet{f}")
        time.sleep(0.05)
    return str(at)


def stream(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events.parquet*")


def batch(spark, folder):
    return spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet*")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_events_are_late(spark, folder):
    newest, late = 0, 0
    for f in range(FILES):
        times = [r[0] for r in spark.read.parquet(f"{folder}/events.parquet{f}").select(F.unix_micros("ts")).collect()]
        late += sum(t < newest for t in times)
        newest = max([newest, *times])
    assert late > 0


@pytest.mark.parametrize("limit_s", [600, 1800, 6000])
def test_silences(spark, folder, limit_s):
    want = rows(flows.silent(batch(spark, folder), limit_s * 1000))
    assert rows(flows.drain(flows.silences(stream(spark, folder), limit_s * 1000), **flows.ROCKS)) == want
    assert want and spark.conf.get("spark.sql.streaming.stateStore.providerClass") != flows.ROCKS["spark.sql.streaming.stateStore.providerClass"]


def test_folds(spark, folder):
    for f in (lambda e: flows.debounce(e, 3600), lambda e: flows.token_bucket(e, 0.02)):
        got, want = rows(f(stream(spark, folder))), rows(f(batch(spark, folder)))
        assert got == want and 0 < len(want)


def test_a_repeated_batch_changes_nothing(spark, folder):
    folded = flows.OrderedFold(spark, flows.debounce_rule(3600), DELAY, scratch_path(spark, "fold"))
    tables = ("results", "states", "waiting", "marks")
    for epoch in range(FILES):
        part = batch(spark, folder).where(F.input_file_name().contains(f"parquet{epoch}/"))
        folded.apply(part, epoch)
        once = [rows(getattr(folded, t).rows()) for t in tables]
        folded.apply(part, epoch)
        assert [rows(getattr(folded, t).rows()) for t in tables] == once
    folded.apply(batch(spark, folder).limit(0), FILES, last=True)
    assert rows(folded.results.rows().select("user_id", "event_id", "passed")) == rows(flows.judged(batch(spark, folder), flows.debounce_rule(3600)))


def test_events_below_the_watermark_are_left_out(spark):
    at = lambda k, s: (k, s, 1, 0.0)
    frame = lambda *r: spark.createDataFrame(r, "event_id long, s long, user_id long, value double").withColumn("ts", F.timestamp_seconds("s"))
    folded = flows.OrderedFold(spark, flows.debounce_rule(10), DELAY, scratch_path(spark, "fold"))
    folded.apply(frame(at(1, 10_000), at(2, 10_005)), 0)
    folded.apply(frame(at(3, 9_600), at(4, 9_300), at(5, 10_011)), 1)
    folded.apply(frame(), 2, last=True)
    assert sorted((r.event_id, r.passed) for r in folded.results.rows().collect()) == [(1, True), (2, False), (3, True), (5, True)]


def test_epoch_table(spark):
    schema = spark.createDataFrame([], "k long, v string").schema
    frame = lambda *r: spark.createDataFrame(r, "k long, v string")
    table, want = EpochTable(spark, scratch_path(spark, "t"), schema, ("k",), every=3), {}
    assert table.rows().collect() == []
    for epoch in range(8):
        new = {k: f"{epoch}" for k in range(epoch % 4, 5)}
        want |= new
        for _ in range(2):
            table.write(frame(*new.items()), epoch)
        assert dict(rows(table.rows())) == want
    table.write(frame((0, "again")), 5)  # an epoch whose rows are in a base is replaced there too
    assert dict(rows(table.rows(6)))[0] == "again"
    plain = EpochTable(spark, scratch_path(spark, "t"), schema)
    for epoch in (0, 1, 1):
        plain.write(frame((epoch, "x"), (7, None)), epoch)
    assert sorted(r.k for r in plain.rows().collect()) == [0, 1, 7, 7] and sorted(r.k for r in plain.rows(1).collect()) == [0, 7]


def test_ingest_and_upsert(spark, folder):
    there = spark.createDataFrame([(3,), (5,)], "user_id long")
    got = flows.ingest_new(stream(spark, folder).select("user_id"), "user_id", there)
    assert sorted(r.user_id for r in got.collect()) == [0, 1, 2, 4, 6, 7, 8]
    want = batch(spark, folder).groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts", "value"), F.struct("ts", "event_id")).alias("x")).select("user_id", "x.*")
    assert rows(flows.upsert(stream(spark, folder).select("user_id", "event_id", "ts", "value"), ("user_id",), "ts", "event_id")) == rows(want)


def test_update_mode(spark, folder):
    s = stream(spark, folder).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    want = batch(spark, folder).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(flows.drain(s, "update", "days", ("user_id", "day"))) == rows(want)
    windows = batch(spark, folder).groupBy(F.window("ts", "24 hours", "1 hour"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("window.start", "user_id", "n")
    assert rows(flows.drain(flows.rolling_usage(stream(spark, folder)), "update", "usage", ("start", "user_id"))) == rows(windows)


def test_retries(spark):
    rng = random.Random(5)
    batches = [[(e * 40 + k, rng.choice(("limited", "fine")), rng.random()) for k in range(30)] for e in range(4)] + [[(3, "fine", 0.0), (41, "limited", 0.9)]]
    schema = spark.createDataFrame([], "id long, status string, value double").schema
    resolve = F.when(F.col("value") > 0.7, "found").when(F.col("value") > 0.4, "failed").otherwise(F.col("status"))
    retries, want = flows.Retries(spark, scratch_path(spark, "r"), schema, "id", "limited", resolve, 7), {}
    for epoch, part in enumerate(batches):
        for _ in range(2):
            retries.apply(spark.createDataFrame(part, schema), epoch)
        want |= {k: (s, v) for k, s, v in part}
        for k in sorted(k for k, (s, _) in want.items() if s == "limited")[:7]:
            v = want[k][1]
            want[k] = ("found" if v > 0.7 else "failed" if v > 0.4 else "limited", v)
        assert {r.id: (r.status, r.value) for r in retries.table.rows().collect()} == want


def test_rolling_usage_keeps_hours_as_state(spark, folder, monkeypatch):
    """the same windows from a state of one row for each user and hour, on disk; windows are summed in partitions of bounded rows, without another exchange."""
    import glob
    import re

    want = batch(spark, folder).groupBy(F.window("ts", "24 hours", "1 hour"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("window.start", "user_id", "n")
    hours = batch(spark, folder).groupBy(F.window("ts", "1 hour"), "user_id").count().count()
    paths = []
    monkeypatch.setattr(flows, "scratch_path", lambda s, name: paths.append(scratch_path(s, name)) or paths[-1])
    monkeypatch.setattr(flows, "WINDOWS", 2400)
    got = flows.rolling(stream(spark, folder))
    assert rows(got) == rows(want)
    states = [p for p in paths if p.endswith("/state")]
    assert len(states) == 1 and glob.glob(f"{states[0]}/state/0/*/*.zip") and not glob.glob(f"{states[0]}/state/0/*/*.delta")
    usage = EpochTable(spark, next(p for p in paths if p.endswith("/usage")), got.schema, ("start", "user_id"))
    assert usage.rows().count() == hours < want.count()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert re.findall(r"Exchange hashpartitioning\(user_id[^)]*, (\d+)\), REPARTITION_BY_NUM", plan)[-1:] == [str(-(-hours // 100))] and len(re.findall(r"Exchange ", plan)) == 1
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "8m"
