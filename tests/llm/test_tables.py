"""Mixing and sharding: properties, brute force and edge cases; the registered queries against their SQL twins."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.llm import queries as llm
from scoreloom.llm.mixing import mix_sources, mixed_documents
from scoreloom.llm.sharding import assign_shards, write_shards
from tests.harness import compare, connect


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in sizes if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / free for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_targets_and_copies(make):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 50, 400])), rnd.choice(["a", "a", "a", "b", "ü", "zz", None])) for i in range(900)]
    rows += [(1000 + i, "one two three", "tiny") for i in range(3)] + [(2000, "", "empty")]
    docs = make(rows).repartition(5)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = slow_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, words in taken.items():
        assert abs(words - want[source]) <= 400
    again = mix_sources(docs.repartition(3)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((r.doc_id, r.copies) for r in again)
    copies = {}
    for r in mixed_documents(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {r.doc_id: r.copies for r in got if r.copies}


def test_mix_edge_cases(odd, none):
    rows = mix_sources(odd).collect()
    assert len(rows) == odd.count()
    mixed = mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies for r in rows)
    assert mix_sources(none).count() == 0 and mixed_documents(none).count() == 0


def slow_shards(rows, limit, h):
    out, todo = {}, [("", rows)]
    while todo:
        bits, part = todo.pop()
        if sum(b for _, b in part) <= limit:
            out |= {k: (bits, sum(b for _, b in part)) for k, b in part}
        else:
            for bit in "01":
                todo.append((bits + bit, [(k, b) for k, b in part if h(k)[len(bits)] == bit]))
    return out


def test_shards_match_brute_force(make, tmp_path):
    rnd = random.Random(2)
    rows = [(i, "é" * rnd.choice([0, 1, 50, 300, 400])) for i in range(700)]
    h = lambda k: f"{int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16):060b}"
    docs = make(rows)
    for limit in (800, 20_000, 10**9):
        got = assign_shards(docs, limit=limit)
        want = slow_shards([(k, len(t.encode())) for k, t in rows], limit, h)
        assert {r.doc_id: (r.shard, r.shard_bytes) for r in got.collect() if r.bytes or r.shard_bytes} == {k: v for k, v in want.items() if v[1] or rows[k][1]}
    write_shards(docs, assign_shards(docs, limit=20_000), str(tmp_path / "s"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "s")).count() == 700


def test_shards_edge_cases(odd, none, make):
    rows = assign_shards(odd, limit=1000).collect()
    assert len(rows) == odd.count() and {r.shard for r in rows if r.bytes > 1000} == {"own-4", "own-9"}
    assert assign_shards(none).count() == 0
    hot = assign_shards(make([(5, "x" * 100)] * 90 + [(None, "y" * 100)] * 30 + [(i, "z" * 90) for i in range(90)]), limit=1000).collect()
    sums = {}
    for r in hot:
        sums[r.shard] = sums.get(r.shard, 0) + r.bytes
    assert len(hot) == 210 and max(sums.values()) <= 1000 and all(sums[r.shard] == r.shard_bytes for r in hot)


def test_written_shards_hold_each_row_once(make, tmp_path):
    rows = [(5, f"{i:0100d}") for i in range(90)] + [(None, "y" * 100)] * 30 + [(7, "a" * 2000), (7, "b" * 20)] + [(i, "z" * 90) for i in range(10, 60)]
    docs = make(rows).repartition(3)
    write_shards(docs, assign_shards(docs, limit=1000), str(tmp_path / "s"))
    got = docs.sparkSession.read.parquet(str(tmp_path / "s")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((k or -1, t) for k, t in rows)
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + len(r.text)
    assert {s for s, n in sums.items() if n > 1000} == {"own-7"} and sums["own-7"] == 2000


NAMES = [n for n in llm.QUERIES if n != "op10_jaccard_join" or os.environ.get("SCORELOOM_ALL")]


@pytest.mark.parametrize("name", NAMES)
def test_registered_query(spark, name):
    sf = "/root/testdata/sf0.001"
    df = llm.QUERIES[name](spark, sf)
    if name in llm.ORACLE_SQL:
        assert compare(df, connect(sf).sql(llm.ORACLE_SQL[name])) is None
    else:
        assert df.count() > 0


def test_shards_of_repeated_overlong_rows(make, tmp_path):
    docs = make([(1, "a" * 150), (1, "b" * 150), (2, "c" * 90), (None, "d" * 150), (3, "e" * 500)])
    got = assign_shards(docs, limit=100).collect()
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.bytes
    assert all(sums[r.shard] == r.shard_bytes and r.shard_docs == 1 for r in got)
    assert {r.shard for r in got} == {"own-1", "more-1-1", "", "own-", "own-3"}
    clash = docs.withColumn("shard", F.lit("mine"))
    write_shards(clash, assign_shards(clash, limit=100), str(tmp_path / "s"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "s"))
    assert back.count() == 5 and back.where("shard = 'mine'").count() == 5 and back.select("shard_").distinct().count() == 5


def test_deep_directories_stay_small(spark):
    """Rows of more than half the limit: every two have to be parted, at twice the depth of their number."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 60).alias("text"))
    out = assign_shards(docs, limit=100)
    got = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard").alias("s"), F.max("shard_bytes").alias("b"), F.max("depth").alias("d")).first()
    assert (got.n, got.s, got.b) == (20_000, 20_000, 60) and got.d > 20
