"""Live counterparts of the running monitors.

Window and session aggregates use event time with a watermark, so state is bounded. Monitors that need order inside a key or
fire when nothing arrives keep Spark's own keyed state (``transformWithStateInPandas``: value state, timers, time to live);
the state lives in the query's checkpoint, so a query that is stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scoreloom.functions.scalars import nan_to_null


def _served() -> Column:
    return F.coalesce(F.col("ok"), F.lit(False))


def error_kind(err: str = "err") -> Column:
    """Kind of an error text: its leading word, else ``unknown``."""
    word = F.regexp_extract(F.coalesce(F.col(err), F.lit("")), "^\\s*([A-Za-z_][A-Za-z0-9_.]*)", 1)
    return F.when(word == "", "unknown").otherwise(word)


def _telemetry_parts(ts: str) -> list[Column]:
    """Mergeable sums of a group of calls; a failed call counts as an error only."""
    ok = _served()
    sec, wait = F.when(ok, nan_to_null("sec")), F.when(ok, nan_to_null("qwait"))
    return [F.count_if(ok).alias("__ok"), F.sum(sec).alias("__sec"), F.count(sec).alias("__secs"), F.max(sec).alias("max_sec"),
            F.sum(wait).alias("__wait"), F.count(wait).alias("__waits"), F.max(wait).alias("max_qwait"), F.count_if(~ok).alias("__err"),
            F.max(F.when(~ok, F.struct(F.col(ts), F.substring(F.coalesce("err", F.lit("")), 1, 300).alias("text")))).alias("__last")]


def _telemetry_merge() -> list[Column]:
    """One row from the parts of its error kinds."""
    kinds = F.array_sort(F.collect_list(F.when(F.col("__err") > 0, F.struct(F.col("__kind").alias("key"), F.col("__err").alias("value")))))
    return [F.sum("__ok").alias("requests"), (F.sum("__sec") / F.sum("__secs")).alias("mean_sec"), F.max("max_sec").alias("max_sec"),
            (F.sum("__wait") / F.sum("__waits")).alias("mean_qwait"), F.max("max_qwait").alias("max_qwait"), F.sum("__err").alias("errors"),
            F.map_from_entries(kinds).alias("errors_by_kind"), F.max("__last")["text"].alias("last_error")]


def stream_telemetry(events: DataFrame, width: str, late: str, ts: str = "ts", kind: str = "which") -> DataFrame:
    """Per window and kind of call: requests served and their rate, mean / max latency and queue wait, errors, errors by kind of
    error and the last error's text (of equal times the greatest).

    A first aggregation keeps sums per kind of error, a second merges them, so a window's state is a few numbers.
    """
    mark = F.when(~_served(), error_kind())
    parts = events.withWatermark(ts, late).groupBy(F.window(ts, width), kind, mark.alias("__kind")).agg(*_telemetry_parts(ts))
    out = parts.groupBy("window", kind).agg(*_telemetry_merge())
    seconds = (F.unix_micros(F.col("window.end")) - F.unix_micros(F.col("window.start"))) / F.lit(1e6)
    return out.withColumn("rate", F.col("requests") / seconds)


def stream_telemetry_totals(events: DataFrame, ts: str = "ts", kind: str = "which") -> DataFrame:
    """The same numbers since the start, per kind of call and kind of error (complete or update mode)."""
    return events.groupBy(kind, F.when(~_served(), error_kind()).alias("__kind")).agg(*_telemetry_parts(ts))


def telemetry_totals(parts: DataFrame, kind: str = "which") -> DataFrame:
    """One row per kind of call from the table of :func:`stream_telemetry_totals`."""
    return parts.groupBy(kind).agg(*_telemetry_merge())


def stream_sliding_levels(frames: DataFrame, width: str, slide: str, late: str, by: Sequence[str] = ("song",), ts: str = "ts",
                          energy: str = "energy") -> DataFrame:
    """Level per sliding window."""
    out = frames.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *by).agg(F.avg(energy).alias("__e"), F.count("*").alias("n"))
    return out.withColumn("level_db", 10 * F.log10(F.col("__e") + 1e-12)).drop("__e")


def stream_sessions(events: DataFrame, gap: str, late: str, by: str = "pid", ts: str = "ts", value: str = "value") -> DataFrame:
    """Sessions by inactivity gap with start, end, count and total."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def stream_dedupe(records: DataFrame, keys: Sequence[str], late: str, ts: str = "ts") -> DataFrame:
    """Drop exact resends that arrive within the watermark delay."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def stream_condition_means(ratings: DataFrame, by: Sequence[str] = ("condition",), value: str = "score") -> DataFrame:
    """Running mean and count per condition (update or complete mode; one state row per condition)."""
    return ratings.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def stream_verdict_match(client: DataFrame, server: DataFrame, key: str, within: str, late: str, client_ts: str = "client_ts",
                         server_ts: str = "server_ts") -> DataFrame:
    """Client pass with the server verdict that follows within a time bound; unmatched passes are provisional."""
    c = client.withWatermark(client_ts, late)
    s = server.withColumnRenamed(key, "__k").withWatermark(server_ts, late)
    on = ((F.col(key) == F.col("__k")) & (F.col(server_ts) >= F.col(client_ts))
          & (F.col(server_ts) <= F.col(client_ts) + F.expr(f"INTERVAL {within}")))
    return c.join(s, on, "leftOuter").withColumn("provisional", F.col("__k").isNull()).drop("__k")


def stream_last_success(events: DataFrame, metric: str = "metric", ts: str = "ts") -> DataFrame:
    """Last success per metric (complete mode; one state row per metric)."""
    return events.where("ok").groupBy(metric).agg(F.max(ts).alias("last_success"), F.count("*").alias("n"))


def stale_alarm(last: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Alarm column for a table of last successes."""
    return last.withColumn("stale", F.timestamp_diff("SECOND", F.col("last_success"), now) > days * 86400)


def stream_heartbeats(events: DataFrame, silence_sec: int, late: str, metric: str = "metric", ts: str = "ts") -> DataFrame:
    """An alarm whenever a metric has had no success for ``silence_sec``: last success, successes so far, time of the alarm.

    Event-time timers raise it once the watermark has passed that time, so it comes without any further event of the metric
    and does not depend on how events are spread over batches.
    """
    rows = events.withWatermark(ts, late).select(
        F.col(metric).cast("string").alias("metric"), F.unix_micros(ts).alias("us"), F.coalesce("ok", F.lit(False)).alias("ok"), ts)
    out = rows.groupBy("metric").transformWithStateInPandas(
        Silence(silence_sec * 1_000_000), "metric string, last_us bigint, n bigint, alarm_us bigint", "Append", "EventTime")
    return out.select("metric", F.timestamp_micros("last_us").alias("last_success"), "n", F.timestamp_micros("alarm_us").alias("alarm_at"))


class Silence(StatefulProcessor):
    """State of a metric: its recent successes as runs without a silence in between, and the successes before them."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("runs", "starts array<bigint>, ends array<bigint>, counts array<bigint>, before bigint, timer bigint")

    def _load(self):
        if not self.state.exists():
            return [], 0, None
        starts, ends, counts, before, timer = self.state.get()
        return list(zip(starts, ends, counts)), before, timer

    def _store(self, runs: list, before: int, timer: int | None) -> None:
        """Keep the runs and one timer, for when the first of them has been silent long enough (timers count milliseconds)."""
        due = -(-(runs[0][1] + self.gap) // 1000) if runs else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        starts, ends, counts = (list(map(int, c)) for c in zip(*runs)) if runs else ([], [], [])
        self.state.update((starts, ends, counts, before, due))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs, before, timer = self._load()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            us = np.sort(part["us"].to_numpy()[part["ok"].to_numpy(bool)])
            us = us[us > passed]
            if len(us):
                cuts = np.flatnonzero(np.diff(us) > self.gap) + 1
                runs += [(int(p[0]), int(p[-1]), len(p)) for p in np.split(us, cuts)]
                runs = self._joined(runs)
        if runs:
            self._store(runs, before, timer)
        return iter(())

    def _joined(self, runs: list) -> list:
        out: list = []
        for start, end, n in sorted(runs):
            if out and start - out[-1][1] <= self.gap:
                out[-1] = (out[-1][0], max(out[-1][1], end), out[-1][2] + n)
            else:
                out.append((start, end, n))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        runs, before, timer = self._load()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        alarms = []
        while runs and runs[0][1] + self.gap <= passed:
            _, end, n = runs.pop(0)
            before += n
            alarms.append((key[0], end, before, end + self.gap))
        self._store(runs, before, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        if alarms:
            yield pd.DataFrame(alarms, columns=["metric", "last_us", "n", "alarm_us"])

    def close(self) -> None:
        pass


def tail_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100, fmt: str = "json") -> DataFrame:
    """Follow a folder that grows by files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


# --- keyed state ----------------------------------------------------------------------------------


def stream_best(log: DataFrame, init: float, by: str = "song", ttl_days: int | None = None) -> DataFrame:
    """Live best reward, accepted count, last accepted and last step per song (update mode: a row per song and batch).

    A step is accepted when its reward exceeds the best before it; steps of a song arrive in order over the batches and in
    any order within one. The state of a song that has been quiet for ``ttl_days`` of processing time is dropped.
    """
    kind = log.schema[by].dataType.simpleString()
    rows = log.select(by, F.col("step").cast("bigint").alias("step"), F.col("reward").cast("double").alias("reward"))
    return rows.groupBy(by).transformWithStateInPandas(
        BestSoFar(float(init), by, ttl_days), f"`{by}` {kind}, best double, n_accepted bigint, last_accepted bigint, last_step bigint",
        "Update", "ProcessingTime" if ttl_days else "None")


class BestSoFar(StatefulProcessor):
    """State of a song: (best, n_accepted, last_accepted, last_step)."""

    def __init__(self, init: float, by: str, ttl_days: int | None):
        self.start, self.by, self.ttl = init, by, ttl_days and ttl_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", "best double, n_accepted bigint, last_accepted bigint, last_step bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best, n, last, step = self.state.get() if self.state.exists() else (self.start, 0, None, None)
        steps, rewards = np.zeros(0, np.int64), np.zeros(0)
        for part in rows:
            known = part["step"].notna().to_numpy()
            new = part["step"].to_numpy()[known].astype(np.int64)
            step = max([s for s in (step, int(new.max()) if len(new) else None) if s is not None], default=None)
            # Only records of what has been seen of the batch can be records of the whole batch, so no more is kept.
            steps, rewards = np.append(steps, new), np.append(rewards, part["reward"].to_numpy(float)[known])
            order = np.argsort(steps, kind="stable")
            steps, rewards = steps[order], rewards[order]
            before = np.fmax.accumulate(np.append(best, rewards))[:-1]
            steps, rewards = steps[rewards > before], rewards[rewards > before]
        if len(steps):
            best, n, last = float(rewards[-1]), n + len(steps), int(steps[-1])
        self.state.update((best, n, last, step))
        yield pd.DataFrame({self.by: [key[0]], "best": [best], "n_accepted": [n], "last_accepted": pd.array([last], "Int64"),
                            "last_step": pd.array([step], "Int64")})

    def close(self) -> None:
        pass


def stream_budget(costs: DataFrame, cap: int, by: str = "run", amount: str = "usd", ttl_days: int | None = None) -> DataFrame:
    """One alarm per run when its running spend first exceeds the cap, with the spend of the batch that did it."""
    kind = costs.schema[by].dataType.simpleString()
    return costs.select(by, F.coalesce(F.col(amount).cast("bigint"), F.lit(0)).alias("usd")).groupBy(by).transformWithStateInPandas(
        Spend(cap, by, ttl_days), f"`{by}` {kind}, spent bigint", "Append", "ProcessingTime" if ttl_days else "None")


class Spend(StatefulProcessor):
    """State of a run: what it has spent."""

    def __init__(self, cap: int, by: str, ttl_days: int | None):
        self.cap, self.by, self.ttl = cap, by, ttl_days and ttl_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("spent", "spent bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get()[0] if self.state.exists() else 0
        new = old + sum(int(part["usd"].sum()) for part in rows)
        self.state.update((new,))
        if old <= self.cap < new:
            yield pd.DataFrame({self.by: [key[0]], "spent": [new]})

    def close(self) -> None:
        pass


def stream_latest(records: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Last-wins table: the row with the greatest ``seq`` per key (update mode; one state row per key)."""
    rest = [c for c in records.columns if c not in keys]
    out = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("__r"))
    return out.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])
