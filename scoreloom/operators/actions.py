"""Lineage ids of accepted action chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_lineage_id(chain: DataFrame, by: Sequence[str], order: str, content: str) -> DataFrame:
    """Content hash of every state: sha-256 of (parent hash, action), along each accepted chain.

    A hash chain is sequential by definition. Spark brings a chain's rows together in order (sorting spills), and the fold
    passes over them carrying the one hash of the state before, however long the chain is.
    """
    rows = chain.select(*by, F.col(order).cast("bigint").alias(order), F.col(content).cast("string").alias("__c"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    placed = rows.repartition(*by).sortWithinPartitions(*by, order, "__c")
    return placed.mapInArrow(lambda batches: _fold(batches, list(by)), f"{kinds}, state_id string")


def _fold(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    last, state = None, ""
    for batch in batches:
        hashes = []
        for *key, content in zip(*(batch.column(c).to_pylist() for c in (*by, "__c"))):
            if key != last:
                last, state = key, ""
            text = state if content is None else f"{state}|{content}"
            state = hashlib.sha256(text.encode()).hexdigest()
            hashes.append(state)
        kept = batch.drop_columns(["__c"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(hashes, pa.string())], [*kept.schema.names, "state_id"])
