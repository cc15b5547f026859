"""Result, event and id-list sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Replace the results of the runs in ``df`` and leave every other run as it is."""
    df.write.partitionBy(*(keys or ["run"])).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_id_list(df: DataFrame, path: str, ident: str = "pid") -> None:
    """One id per line; blank ids are never written."""
    c = F.trim(F.col(ident).cast("string"))
    df.select(c.alias("value")).where(F.coalesce("value", F.lit("")) != "").write.mode("overwrite").text(path)
