"""Compare registered queries with their SQL twins, the way the driver does (sorted columns, row multiset)."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0) if v != int(v) or abs(v) > 1e15 else repr(float(int(v)))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def compare(df, rel) -> str | None:
    cols = sorted(df.columns)
    want_cols = sorted(rel.columns)
    if cols != want_cols:
        return f"columns {cols} != {want_cols}"
    got = sorted(tuple(canon(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    want = sorted(tuple(canon(v) for v in r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wkinds = dict(zip(rel.columns, [str(t) for t in rel.types]))
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not got:
        return "empty result"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; cols {cols}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    same = {"bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",), "string": ("VARCHAR",),
            "boolean": ("BOOLEAN",), "timestamp": ("TIMESTAMP", "TIMESTAMP WITH TIME ZONE")}
    odd = [(c, kinds[c], wkinds[c]) for c in cols if wkinds[c] not in same.get(kinds[c], (wkinds[c],))]
    return f"types {odd}" if odd else None


def main(argv: list[str]) -> int:
    """harness.py [sf] [name-prefix …]: run and compare."""
    from scoreloom.plans import load_all
    from scoreloom.plans.registry import REGISTRY
    from scoreloom.session import build_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.sql.session.timeZone": os.environ.get("HARNESS_TZ", "UTC")})
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    con = connect(sf_dir)
    bad = 0
    names = [n for n in REGISTRY if len(argv) < 2 or any(n == a or n.startswith(a + "*") or
             (a.endswith("*") and n.startswith(a[:-1])) or REGISTRY[n].plan.__module__.endswith(a) for a in argv[1:])]
    for n in names:
        q = REGISTRY[n]
        t = time.time()
        try:
            df = q.run(spark, sf_dir)
            if q.sql is None:
                msg = None if df.count() > 0 else "empty result"
                note = "rows-only"
            else:
                msg = compare(df, con.sql(q.sql))
                note = "ok"
        except Exception as e:  # noqa: BLE001
            msg, note = f"{type(e).__name__}: {str(e)[:420]}", ""
        dt = time.time() - t
        if msg:
            bad += 1
            print(f"FAIL {n} ({dt:.1f}s): {msg}", flush=True)
        elif dt > 4 or note == "rows-only":
            print(f"{note} {n} ({dt:.1f}s)", flush=True)
    print(f"{len(names) - bad}/{len(names)} good", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
