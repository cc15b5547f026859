"""Streams over several files, stopped and resumed, give the batch result."""

import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators.logs import dedupe_last, replay_acceptance
from scoreloom.streaming import monitors as M
from scoreloom.streaming import runner as S


def add(df, path, part):
    df.where(part).coalesce(1).write.mode("append").parquet(path)


def follow(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_best_stops_and_resumes(spark, tmp_path):
    log = spark.range(400).select((F.col("id") % 3).alias("song"), (F.col("id") / 3).cast("bigint").alias("step"),
                                  F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(1000)) / 10)
                                  .otherwise(F.when(F.col("id") % 2 > 0, float("nan"))).alias("reward"))
    path, run = str(tmp_path / "log"), str(tmp_path / "run")
    want = replay_acceptance(log, 20.0).groupBy("song").agg(
        F.max(F.when(~F.isnan("reward"), F.col("reward"))).alias("best"), F.count_if("accepted").alias("n_accepted"),
        F.max(F.when(F.col("accepted"), F.col("step"))).alias("last_accepted"), F.max("step").alias("last_step"))
    for lo in range(0, 140, 70):
        add(log, path, (F.col("step") >= lo) & (F.col("step") < lo + 70))
        got = S.run_updates(M.stream_best(follow(spark, log, path), 20.0, ttl_days=30), "best", ["song"], run)
    assert got.count() == 3 and got.exceptAll(want).count() == 0


def test_best_takes_a_batch_in_any_order(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(s, i, float(rnd.randrange(500))) for s in range(2) for i in range(300)]
    rnd.shuffle(rows)
    log = spark.createDataFrame(rows, "song bigint, step bigint, reward double")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    got = {r.song: (r.n_accepted, r.last_accepted) for r in S.run_updates(M.stream_best(stream, -1.0), "best", ["song"]).collect()}
    for s in range(2):
        best, taken = -1.0, []
        for _, step, reward in sorted(r for r in rows if r[0] == s):
            if reward > best:
                best, taken = reward, [*taken, step]
        assert got[s] == (len(taken), taken[-1])


def test_budget_alarms_once_over_restarts(spark, tmp_path):
    costs = spark.range(40).select((F.col("id") % 2).alias("run"), (F.col("id") % 2 * 10 + 1).alias("usd"), "id")
    path, run = str(tmp_path / "c"), str(tmp_path / "run")
    for i in range(3):
        add(costs, path, F.col("id") % 3 == i)
        alarms = S.run_append(M.stream_budget(follow(spark, costs, path), 50, ttl_days=30), "b", run, idle=False)
    assert [(r["run"], r["spent"]) for r in alarms.collect()] == [(1, 77)]


def silences(events, gap, passed):
    """(metric, last success, successes so far) of every silence that the watermark has seen to its end."""
    out = []
    for metric in {e[0] for e in events}:
        times = sorted(t for m, t, ok in events if m == metric and ok)
        for i, t in enumerate(times):
            if (i + 1 == len(times) or times[i + 1] - t > gap) and t + gap <= passed:
                out.append((metric, t, i + 1))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 3])
def test_heartbeats_come_without_further_events(spark, tmp_path, batches):
    rnd = random.Random(4)
    # "quiet" never comes back after 200 s; "gappy" pauses and comes back; "busy" keeps time moving
    events = [("busy", t, True) for t in range(0, 2000, 5)] + [("quiet", t, True) for t in range(0, 200, 10)]
    events += [("gappy", t, True) for t in [*range(0, 300, 20), *range(700, 900, 20), *range(1500, 2000, 20)]]
    events += [("quiet", t, False) for t in range(200, 2000, 50)]
    events.sort(key=lambda e: e[1])
    path, run = str(tmp_path / "e"), str(tmp_path / "run")
    size = -(-len(events) // batches)
    schema = "metric string, ts timestamp, ok boolean"
    for b in range(batches):
        part = events[b * size:(b + 1) * size]
        rnd.shuffle(part)
        frame = spark.createDataFrame(part, "metric string, t bigint, ok boolean")
        frame.select("metric", F.timestamp_seconds(F.col("t") + 1_000_000).alias("ts"), "ok").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        out = S.run_append(M.stream_heartbeats(stream, 100, "10 seconds"), "h", run)
    got = sorted((r.metric, r.t, r.n) for r in out.select("metric", (F.unix_seconds("last_success") - 1_000_000).alias("t"), "n").collect())
    assert got == silences(events, 100, 1995 - 10) and {g[0] for g in got} == {"quiet", "gappy"}
    assert out.where(F.unix_seconds("alarm_at") - F.unix_seconds("last_success") != 100).count() == 0


def test_running_means_equal_batch(spark, tmp_path):
    r = spark.range(100).select((F.col("id") % 4).cast("string").alias("condition"), F.col("id").cast("double").alias("score"), "id")
    path = str(tmp_path / "r")
    for i in range(5):
        add(r, path, F.col("id") % 5 == i)
    got = S.run_complete(M.stream_condition_means(follow(spark, r, path)), "m")
    want = r.groupBy("condition").agg(F.avg("score").alias("mean"), F.count("score").alias("n"))
    assert got.exceptAll(want).count() == 0 and got.count() == 4


def test_latest_stops_and_resumes(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 7).alias("key"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("seq"), "id")
    path, run = str(tmp_path / "l"), str(tmp_path / "run")
    for i in range(3):
        add(rows, path, F.col("id") % 3 == i)
        got = S.run_updates(M.stream_latest(follow(spark, rows, path), ["key"], ["seq", "id"]), "l", ["key"], run)
    assert got.exceptAll(dedupe_last(rows, ["key"], ["seq", "id"])).count() == 0 and got.count() == 7


def test_telemetry_counts_errors_by_kind(spark, tmp_path):
    rows = [(0, "pq", 1.0, 0.5, True, None), (1, "pq", 3.0, None, True, None), (2, "pq", 9.0, 9.0, False, "Timeout: 5 s"),
            (3, "pq", None, None, False, "  Timeout"), (4, "pq", None, None, False, None), (5, "sb", float("nan"), 1.0, True, None),
            (200, "pq", 0.0, 0.0, True, None)]
    frame = spark.createDataFrame(rows, "t bigint, which string, sec double, qwait double, ok boolean, err string")
    calls = frame.select(F.timestamp_seconds("t").alias("ts"), *frame.columns[1:])
    calls.write.parquet(str(tmp_path / "t"))
    stream = lambda: spark.readStream.schema(calls.schema).parquet(str(tmp_path / "t"))
    got = {r.which: r for r in S.run_append(M.stream_telemetry(stream(), "60 seconds", "1 second"), "t").collect()}
    pq = got["pq"]
    assert (pq.requests, pq.mean_sec, pq.max_sec, pq.mean_qwait, pq.max_qwait, pq.errors) == (2, 2.0, 3.0, 0.5, 0.5, 3)
    assert pq.errors_by_kind == {"Timeout": 2, "unknown": 1} and pq.last_error == "" and pq.rate == 2 / 60
    assert (got["sb"].requests, got["sb"].mean_sec, got["sb"].errors_by_kind, got["sb"].last_error) == (1, None, {}, None)
    total = {r.which: r for r in M.telemetry_totals(S.run_complete(M.stream_telemetry_totals(stream()), "tt")).collect()}
    assert total["pq"].requests == 3 and total["pq"].errors == 3
