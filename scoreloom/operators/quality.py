"""Guards: configuration drift, provenance, staleness, expectations. Each returns the violating rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Setting:
    """Expected value of one setting. ``optional``: absent (``has_<name>`` false) is skipped; ``default`` stands in
    for a null; ``tol`` compares numbers with a tolerance; ``needs`` names a setting that has to be above 0 on both sides,
    else this one has no meaning and is not compared."""

    name: str
    value: object
    default: object = None
    optional: bool = False
    tol: float | None = None
    needs: str | None = None


def config_drift(records: DataFrame, expected: Sequence[Setting], key: Sequence[str]) -> DataFrame:
    """Records whose settings differ from this run, one row per differing setting."""
    by_name, arms = {s.name: s for s in expected}, []

    def value(s: Setting) -> Column:
        return F.col(s.name) if s.default is None else F.coalesce(F.col(s.name), F.lit(s.default))

    for s in expected:
        have = value(s)
        want = F.array(*[F.lit(v) for v in s.value]) if isinstance(s.value, (list, tuple)) else F.lit(s.value)
        if s.tol is None:
            differs = ~have.eqNullSafe(want)
        else:
            differs = ~F.coalesce(F.abs(have - want) <= s.tol, have.isNull() & want.isNull())
        if s.optional:
            differs = differs & F.coalesce(F.col(f"has_{s.name}"), F.lit(False))
        if s.needs:
            base = by_name[s.needs]
            differs = differs & F.coalesce(value(base) > 0, F.lit(False)) & F.lit((base.value or 0) > 0)
        arms.append(F.when(differs, F.struct(F.lit(s.name).alias("setting"), have.cast("string").alias("existing"),
                                             want.cast("string").alias("expected"))))
    return records.select(*key, F.inline(F.filter(F.array(*arms), lambda a: a.isNotNull())))


def setting_drift_default_true(records: DataFrame, flag: str, expected: bool, block: str, key: Sequence[str]) -> DataFrame:
    """A flag that old rows do not carry means True; rows without the settings block are out of scope."""
    rows = records.where(F.col(block).isNotNull())
    have = F.coalesce(F.col(flag), F.lit(True))
    return rows.where(have != F.lit(expected)).select(*key, have.alias("existing"), F.lit(expected).alias("expected"))


def vocabulary_drift(records: DataFrame, column: str, expected: str, key: Sequence[str], default: str = "base") -> DataFrame:
    """Rows recorded with another action set; an absent one means the base set."""
    have = F.coalesce(F.col(column), F.lit(default))
    return records.where(have != expected).select(*key, have.alias("existing"), F.lit(expected).alias("expected"))


def provenance_drift(records: DataFrame, proposer: str, digest: str, key: Sequence[str]) -> DataFrame:
    """Rows of another proposer, or of this one with another stats digest."""
    wrong = ~F.col("proposer").eqNullSafe(F.lit(proposer))
    reason = F.when(wrong, "proposer").when(~F.col("stats_digest").eqNullSafe(F.lit(digest)), "stats_digest")
    return records.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*key, "reason")


def mark_success(events: DataFrame, metric: str = "metric", ts: str = "ts", proxy: str = "proxy") -> DataFrame:
    """Latest success per metric; results whose warnings mention a stand-in do not count."""
    real = events.where(F.col("ok") & ~F.exists(F.coalesce("warnings", F.array().cast("array<string>")),
                                                lambda w: F.lower(w).contains(proxy)))
    return real.groupBy(metric).agg(F.max(ts).alias("last_success"), F.max_by("value", ts).alias("last_value"))


def stale_metrics(expected: DataFrame, last: DataFrame, now: Column, days: int = 7, metric: str = "metric") -> DataFrame:
    """Expected metrics never seen, or not seen for more than ``days`` days."""
    age = F.timestamp_diff("SECOND", F.col("last_success"), now) / 86400.0
    j = expected.join(last.select(metric, "last_success"), metric, "left").withColumn("age_days", age)
    status = F.when(F.col("last_success").isNull(), "never_seen").when(F.col("age_days") > days, "stale").otherwise("fresh")
    return j.select(metric, "last_success", "age_days", status.alias("status"))


def expect(df: DataFrame, unique: Sequence[str] = (), not_null: Sequence[str] = (), min_rows: int | None = None,
           rows: dict[str, Column] | None = None, every: bool = False) -> DataFrame:
    """Violations of expectations as (rule, n); an empty result means the data holds.

    With ``every`` the rules that hold are listed too; ``n`` of ``min_rows`` is then negative by the rows above the minimum.
    """
    aggs = [F.count("*").alias("__rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"__null_{c}") for c in not_null]
    aggs += [F.count_if(~F.coalesce(test, F.lit(False))).alias(f"__row_{name}") for name, test in (rows or {}).items()]
    one = df.agg(*aggs)
    out = [F.struct(F.lit(f"not_null:{c}").alias("rule"), F.col(f"__null_{c}").alias("n")) for c in not_null]
    out += [F.struct(F.lit(f"row:{n}").alias("rule"), F.col(f"__row_{n}").alias("n")) for n in (rows or {})]
    if min_rows is not None:
        short = F.lit(min_rows).cast("bigint") - F.col("__rows")
        out.append(F.struct(F.lit("min_rows").alias("rule"), short.alias("n")))
    found = one.select(F.inline(F.array(*out))) if out else None
    if unique:
        dup = df.groupBy(*unique).agg(F.count("*").alias("__c")).where(F.col("__c") > 1).agg(
            F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).alias("n")).select(F.lit("unique:" + ",".join(unique)).alias("rule"), "n")
        found = dup if found is None else found.unionByName(dup)
    if found is None:
        raise ValueError("no expectation given")
    return found if every else found.where(F.col("n") > 0)


def require(df: DataFrame, guard: DataFrame, message: str) -> DataFrame:
    """``df``, but the query fails when the guard has any row (checked in the same job, not on the driver)."""
    n = guard.agg(F.count("*").alias("__bad"))
    checked = df.join(F.broadcast(n), F.lit(True))
    ok = F.when(F.col("__bad") > 0, F.raise_error(F.concat(F.lit(message + ": "), F.col("__bad").cast("string"))).cast("boolean"))
    return checked.where(F.coalesce(ok, F.lit(True))).drop("__bad")
