"""Streaming queries: the event table as a stream of files, run to completion."""

from pyspark.sql import functions as F

from scoreloom.functions.scalars import epoch_us
from scoreloom.plans.q_aggregates import r6
from scoreloom.plans.registry import query
from scoreloom.session import scratch_path
from scoreloom.streaming import monitors as M
from scoreloom.streaming import runner as S


def stream(t, name="events"):
    """The table file as a streaming source. Event time must be an instant; zone-less stamps are taken as UTC."""
    table = t.read(name)
    s = t.spark.readStream.schema(table.schema).option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir)
    if name == "events":
        s = s.withColumn("ts", F.timestamp_micros(epoch_us("ts")))
    return s


def plain(c):
    """The instant as a zone-less UTC stamp."""
    local = F.col(c).cast("timestamp_ntz")
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), local).alias(c.split(".")[-1])


def instant(text):
    return F.timestamp_micros(epoch_us(F.lit(text).cast("timestamp_ntz")))


CALLS = """calls AS (SELECT ts, event_type AS which, value AS sec, k / 10.0::DOUBLE AS qwait, k >= 10 AS ok,
      CASE WHEN k < 3 THEN 'Timeout: call ' || event_id WHEN k < 7 THEN 'Refused' WHEN k < 9 THEN '' END AS err
      FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)),
    kinds AS (SELECT *, CASE WHEN NOT ok THEN CASE coalesce(err, '') WHEN '' THEN 'unknown' ELSE regexp_extract(err, '^[A-Za-z]+') END END AS kind FROM calls)"""
TOTALS = """count(*) FILTER (ok) AS requests, round(avg(sec) FILTER (ok), 9) AS mean_sec, max(sec) FILTER (ok) AS max_sec,
      round(avg(qwait) FILTER (ok), 9) AS mean_qwait, max(qwait) FILTER (ok) AS max_qwait, count(*) FILTER (NOT ok) AS errors,
      arg_max(coalesce(err, ''), epoch_us(ts)::VARCHAR || coalesce(err, '')) FILTER (NOT ok) AS last_error"""


def calls(t):
    k = F.get_json_object("props", "$.k").cast("int")
    err = F.when(k < 3, F.concat(F.lit("Timeout: call "), F.col("event_id").cast("string"))).when(k < 7, "Refused").when(k < 9, "")
    return stream(t).select("ts", F.col("event_type").alias("which"), F.col("value").alias("sec"), (k / 10.0).alias("qwait"), (k >= 10).alias("ok"), err.alias("err"))


def shown(out):
    """Rounded means and the map of error kinds as text."""
    text = F.array_join(F.transform(F.map_entries("errors_by_kind"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumns({"mean_sec": F.round("mean_sec", 9), "mean_qwait": F.round("mean_qwait", 9), "errors_by_kind": text})


@query("stream_telemetry", f"""WITH {CALLS}, m AS (SELECT max(ts) - INTERVAL 2 HOUR AS wm FROM events),
    w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS start FROM kinds, m WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= wm),
    e AS (SELECT start, which, string_agg(kind || '=' || n, ',' ORDER BY kind) AS errors_by_kind FROM
      (SELECT start, which, kind, count(*) AS n FROM w WHERE NOT ok GROUP BY ALL) GROUP BY 1, 2),
    o AS (SELECT start, which, {TOTALS}, round(count(*) FILTER (ok) / 21600, 9) AS rate FROM w GROUP BY 1, 2)
    SELECT o.*, coalesce(errors_by_kind, '') AS errors_by_kind FROM o LEFT JOIN e USING (start, which)""")
def stream_telemetry(t):
    out = S.run_append(M.stream_telemetry(calls(t), "6 hours", "2 hours"), "telemetry")
    return r6(shown(out).withColumn("start", plain("window.start")).drop("window"), "rate", digits=9)


@query("stream_telemetry_totals", f"""WITH {CALLS},
    e AS (SELECT which, string_agg(kind || '=' || n, ',' ORDER BY kind) AS errors_by_kind FROM
      (SELECT which, kind, count(*) AS n FROM kinds WHERE NOT ok GROUP BY ALL) GROUP BY 1),
    o AS (SELECT which, {TOTALS} FROM kinds GROUP BY 1)
    SELECT o.*, coalesce(errors_by_kind, '') AS errors_by_kind FROM o LEFT JOIN e USING (which)""")
def stream_telemetry_totals(t):
    return shown(M.telemetry_totals(S.run_complete(M.stream_telemetry_totals(calls(t)), "totals")))


@query("stream_sliding_levels", """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events), x AS (SELECT user_id % 10 AS song, value * value AS e,
      time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * i AS w FROM events, range(0, 3) r(i))
    SELECT song, w AS start, count(*) AS n, round(10 * log10(avg(e) + 1e-12), 6) AS level_db FROM x, m WHERE w + INTERVAL 3 HOUR <= wm GROUP BY 1, 2""")
def stream_sliding_levels(t):
    s = stream(t).select("ts", (F.col("user_id") % 10).alias("song"), (F.col("value") * F.col("value")).alias("energy"))
    out = S.run_append(M.stream_sliding_levels(s, "3 hours", "1 hour", "1 hour"), "levels")
    return out.select("song", plain("window.start"), "n", F.round("level_db", 6).alias("level_db"))


@query("stream_sessions", """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS wm FROM events), g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR
      THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT user_id AS pid, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round(sum(value), 6) AS total FROM s, m GROUP BY user_id, sid, wm
    HAVING max(ts) + INTERVAL 6 HOUR <= wm""")
def stream_sessions(t):
    s = stream(t).select("ts", F.col("user_id").alias("pid"), "value")
    out = S.run_append(M.stream_sessions(s, "6 hours", "1 hour"), "sessions")
    return out.select("pid", plain("first_ts"), plain("last_ts"), "n", F.round("total", 6).alias("total"))


@query("stream_best", """SELECT song, greatest(10, max(reward)) AS best, count(*) FILTER (accepted) AS n_accepted, max(step) FILTER (accepted) AS last_accepted,
    max(step) - coalesce(max(step) FILTER (accepted), -1) AS stall FROM replayed GROUP BY 1""", ["search_log", "replayed"])
def stream_best(t):
    path = scratch_path(t.spark, "log")
    t.search_log().select("song", "step", "reward").write.parquet(path)
    s = t.spark.readStream.schema("song bigint, step bigint, reward double").parquet(path)
    best = S.run_updates(M.stream_best(s, 10.0), "best", ["song"])
    return best.select("song", "best", "n_accepted", "last_accepted", (F.col("last_step") - F.coalesce("last_accepted", F.lit(-1))).alias("stall"))


@query("stream_dedupe", "SELECT event_id, user_id, event_type FROM events")
def stream_dedupe(t):
    s = stream(t).withColumn("copy", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    out = M.stream_dedupe(s.select("ts", "event_id", "user_id", "event_type"), ["event_id"], "1 hour")
    return S.run_append(out, "dedupe").select("event_id", "user_id", "event_type")


@query("stream_latest", """SELECT user_id, event_type, value, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
    WHERE r = 1""")
def stream_latest(t):
    rows = M.stream_latest(stream(t).drop("props"), ["user_id", "event_type"], ["ts", "event_id"])
    return S.run_updates(rows, "latest", ["user_id", "event_type"]).select("user_id", "event_type", "value", plain("ts"))


@query("stream_condition_means", """SELECT l_returnflag || l_linestatus AS condition, round(avg(2 * l_quantity), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1""")
def stream_condition_means(t):
    s = stream(t, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("condition"), (2 * F.col("l_quantity")).alias("score"))
    return r6(S.run_complete(M.stream_condition_means(s), "means"), "mean")


@query("stream_verdict_match", """WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'), s AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
    w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM s)) - INTERVAL 1 HOUR AS wm)
    SELECT c.event_id, s.ts AS server_ts, s.ts IS NULL AS provisional FROM c CROSS JOIN w LEFT JOIN s ON s.user_id = c.user_id AND s.ts >= c.ts AND s.ts <= c.ts + INTERVAL 12 HOUR
    WHERE s.ts IS NOT NULL OR c.ts + INTERVAL 12 HOUR < wm""")
def stream_verdict_match(t):
    e = stream(t)
    c = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("ts").alias("client_ts"))
    s = stream(t).where("event_type = 'purchase'").select("user_id", F.col("ts").alias("server_ts"))
    out = S.run_append(M.stream_verdict_match(c, s, "user_id", "12 HOURS", "1 hour"), "verdicts")
    return out.select("event_id", plain("server_ts"), "provisional")


@query("stream_last_success", """SELECT 'm' || user_id AS metric, max(ts) AS last_success, count(*) AS n,
      date_diff('second', max(ts), TIMESTAMP '2024-02-06 12:00:00') > 604800 AS stale FROM events WHERE event_type <> 'error' GROUP BY 1""")
def stream_last_success(t):
    out = S.run_complete(M.stream_last_success(metrics(t)), "last-success")
    return M.stale_alarm(out, instant("2024-02-06 12:00:00")).select("metric", plain("last_success"), "n", "stale")


def metrics(t):
    return stream(t).select(F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("metric"), "ts", (F.col("event_type") != "error").alias("ok"))


@query("stream_heartbeats", """WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS wm FROM events),
    s AS (SELECT user_id, ts, lead(ts) OVER w AS later, row_number() OVER w AS n FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT 'm' || user_id AS metric, ts AS last_success, n, ts + INTERVAL 2 DAY AS alarm_at FROM s, m
    WHERE (later IS NULL OR later > ts + INTERVAL 2 DAY) AND ts + INTERVAL 2 DAY <= wm""")
def stream_heartbeats(t):
    out = S.run_append(M.stream_heartbeats(metrics(t), 2 * 86400, "1 hour"), "heartbeats")
    return out.select("metric", plain("last_success"), "n", plain("alarm_at"))


@query("stream_budget", """SELECT o_custkey AS run, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS spent FROM orders GROUP BY 1
    HAVING sum(CAST(round(o_totalprice * 100) AS BIGINT)) > 300000000""")
def stream_budget(t):
    s = stream(t, "orders").select(F.col("o_custkey").alias("run"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("usd"))
    return S.run_append(M.stream_budget(s, 300000000), "budget")


@query("tail_events", "SELECT event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def tail_events(t):
    from scoreloom.sources.sinks import append_events
    path = scratch_path(t.spark, "tail")
    append_events(t.events.select(F.col("event_type").alias("kind"), "value"), path)
    rows = S.run_append(M.tail_events(t.spark, path, "kind string, value double"), "tailed")
    return r6(rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total", digits=4)
