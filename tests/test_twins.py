"""Registered queries against their SQL on tables that the generated ones do not hold."""

import duckdb
from pyspark.sql import functions as F

from scoreloom.operators import sampling as M
from scoreloom.plans import load_all
from scoreloom.plans.proxies import Tables
from scoreloom.plans.registry import REGISTRY
from tests.harness import compare

load_all()


def twin(spark, folder, name, **tables):
    """Differences of a query from its SQL on small tables; a table is the SQL that makes it."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    q = REGISTRY[name]
    return compare(q.plan(Tables(spark, str(folder))), con.sql(q.sql))


def test_gains_of_two_ranges_need_no_join(spark, tmp_path):
    customer = "SELECT i::BIGINT AS c_custkey FROM range(50) r(i)"
    assert twin(spark, tmp_path, "sample_gains", customer=customer) is None
    plan = REGISTRY["sample_gains"].plan(Tables(spark, str(tmp_path)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    songs = spark.range(3).withColumnRenamed("id", "song_index")
    both = M.sample_gains(songs, 2, ["a", "b"], 0.0, 1.0).withColumn("db", M.gain(-20.0, 0.0, "db"))
    assert both.where(F.abs(F.log10("db") * 20 - (-20 + 20 * F.col("gain"))) > 1e-9).count() == 0


def test_verdicts_of_unknown_listeners_count(spark, tmp_path):
    empty = "l_suppkey BIGINT, l_partkey BIGINT, l_orderkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_returnflag VARCHAR, l_linestatus VARCHAR"
    lineitem = "SELECT " + ", ".join(f"NULL::{c.split()[1]} AS {c.split()[0]}" for c in empty.split(", ")) + " WHERE false"
    events = "SELECT 1::BIGINT AS user_id, 1::BIGINT AS event_id, '{\"k\": 1}' AS props, 'click' AS event_type, 1.0::DOUBLE AS value"
    supplier = "SELECT i::BIGINT AS s_suppkey, 1.0::DOUBLE AS s_acctbal FROM range(1, 101) r(i)"  # 81 has its verdict under an id of its own
    assert twin(spark, tmp_path, "exclude_ineligible", lineitem=lineitem, events=events, supplier=supplier) is None


def test_expectations_that_hold_are_listed(spark, tmp_path):
    lineitem = "SELECT i::BIGINT AS l_orderkey, 1 AS l_linenumber, 0.5::DOUBLE AS l_discount, i::BIGINT AS l_partkey FROM range(10000005) r(i)"
    assert twin(spark, tmp_path, "expect", lineitem=lineitem) is None


def test_years_of_doubles_just_below_a_half(spark, tmp_path):
    customer = "SELECT i::BIGINT AS c_custkey, i - 9.5::DOUBLE AS c_acctbal FROM range(8000) r(i)"  # 1599.5 / 100 is less than 15.995
    assert twin(spark, tmp_path, "parse_years", customer=customer) is None


def test_reward_counts_take_more_tasks_for_more_rows(spark, tmp_path, monkeypatch):
    from scoreloom import session
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    lineitem = "SELECT (i % 7)::BIGINT AS l_suppkey, (i % 50)::DOUBLE AS l_quantity, (i % 11) / 100::DOUBLE AS l_discount FROM range(5000) r(i)"
    for name in ("reward_penalized", "reward_weighted", "reward_min", "reward_single"):
        assert twin(spark, tmp_path, name, lineitem=lineitem) is None
        plan = REGISTRY[name].plan(Tables(spark, str(tmp_path)))._jdf.queryExecution()
        assert "RepartitionByExpression [song" in plan.optimizedPlan().toString() and ", 50" in plan.optimizedPlan().toString()
        assert "SortMergeJoin" not in plan.executedPlan().toString()


def test_section_labels_of_many_lines_are_numbered_in_blocks(spark, tmp_path, monkeypatch):
    from scoreloom.sources import tables as B
    monkeypatch.setattr(B, "step_block", lambda c: F.floor(F.col(c) / 10).cast("bigint"))
    lines = [f"{i}.0 {i + 1}.0" + (" x" if i % 3 else "") if i % 5 else "broken" for i in range(500)]
    for name in ("a.lab", "b b.lab"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    out = B.read_section_labels(spark, str(tmp_path / "*.lab"))
    valid = [i for i in range(500) if i % 5]
    want = {(s, float(i), "x" if i % 3 else f"section_{n}") for s in ("a", "b b") for n, i in enumerate(valid)}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)
    spec = [w for w in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if w.lstrip(" :+-").startswith("Window") and "__b1" not in w]
    assert not spec  # no window over all lines of a file


def test_rank_products_of_raters_who_lack_items():
    import numpy as np

    from scoreloom.operators import raters as RT
    rnd = np.random.default_rng(4)
    for fill in (0.97, 0.5, 1.0):
        v, s = rnd.integers(0, 6, (60, 40)).astype(float), rnd.random((60, 40)) < fill
        v[~s] = 0
        got = RT._rank_products(v[:25], s[:25], v[25:], s[25:])
        oa, ob = (np.argsort(np.where(t, u, np.inf), axis=1, kind="stable") for u, t in ((v[:25], s[:25]), (v[25:], s[25:])))
        assert (got == RT._plain_products(oa, s[:25], ob, s[25:])).all()


def test_rater_pairs_leave_out_what_is_not_asked_for(spark):
    from scoreloom.operators import raters as RT
    df = spark.createDataFrame([(r, i, float(r * i % 5)) for r in range(12) for i in range(20) if (r + i) % 9], "rater bigint, item bigint, value double")
    full = RT.rater_pairs(df, "rater", "item", "value", strip_cells=50)
    for diff, rho, gone in ((False, True, ["mean_abs_diff"]), (True, False, ["rho"])):
        part = RT.rater_pairs(df, "rater", "item", "value", diff=diff, rho=rho)
        assert part.columns == [c for c in full.columns if c not in gone] and part.count() == 66
        assert part.exceptAll(full.drop(*gone)).count() == 0


def test_rater_strips_are_not_copied_for_their_pairs(spark):
    from scoreloom.operators import raters as RT
    df = spark.createDataFrame([(r, i, float(r * i % 5)) for r in range(40) for i in range(10)], "rater bigint, item bigint, value double")
    out = RT.rater_pairs(df, "rater", "item", "value", strip_cells=30)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "hashpartitioning" not in plan  # each strip was exploded and shuffled once per strip
    assert sorted((r.rater_a, r.rater_b) for r in out.collect()) == [(a, b) for a in range(40) for b in range(a + 1, 40)]


def test_equal_queries_are_answered_once(spark, monkeypatch):
    from scoreloom.operators import cases as C
    kept, real = {}, C.materialize
    monkeypatch.setattr(C, "materialize", lambda df, name: kept.setdefault(name, real(df, name)))
    kinds = [(None, ["x", "y"], {"a": 1.0, "b": None}, "verse"), ("", ["y", "x", "x", None], {"a": 1.0}, "verse"), ("rock", [], {}, None),
             ("rock", None, None, None), ("rock", None, {"b": 2.0}, None)]
    queries = spark.createDataFrame([(i, *kinds[i % 5]) for i in range(200)], "query_id bigint, genre string, roles array<string>, "
                                    "diagnosis map<string,double>, section string")
    cases = spark.createDataFrame([(i, "rock" if i % 2 else "jazz", ["x"], {"a": float(i)}, "verse", 0.1, i) for i in range(30)],
                                  "case_id bigint, genre string, stem_roles array<string>, diagnosis map<string,double>, section_type string, "
                                  "reward_delta double, n_observations bigint")
    got = {}
    for r in C.similar_cases(queries, cases, 4).collect():
        got.setdefault(r.query_id, []).append((r.place, r.case_id, r.similarity, r.score))
    assert kept["asked"].count() == 3 and sorted(got) == list(range(200))  # all 200 were compared with the cases before
    for group in ((0, 1), (2, 3), (4,)):
        assert len({tuple(sorted(v)) for i, v in got.items() if i % 5 in group}) == 1


def test_case_search_stops_before_all_cases(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from scoreloom.operators import cases as C
    rnd, looked = np.random.default_rng(6), []
    plain = C._similarity
    monkeypatch.setattr(C, "_similarity", lambda q, base, values, known, rows: looked.append(len(base) * len(rows)) or plain(q, base, values, known, rows))
    kind = pa.map_(pa.string(), pa.float64())
    diag = lambda n: [[("a", float(x)), ("b", float(y))] if i % 4 else [] for i, (x, y) in enumerate(rnd.normal(size=(n, 2)))]
    queries = pa.table({"__n": pa.array(range(30)), "query_id": pa.array(range(30)), "genre": ["rock", "jazz", None] * 10, "roles": [["x"], ["x", "y"]] * 15,
                        "diagnosis": pa.array(diag(30), kind), "section": ["verse", None, "chorus"] * 10})
    n = 6000
    cases = pa.table({"case_id": pa.array(rnd.permutation(n)), "genre": ["rock", "jazz", "pop"] * (n // 3), "stem_roles": [["x"], ["y"], ["x", "y"], []] * (n // 4),
                      "section_type": ["verse", "chorus"] * (n // 2), "diagnosis": [[{"key": k, "value": v} for k, v in m] for m in diag(n)],
                      "__bonus": rnd.random(n) / 6})
    got = C._best(queries, cases, 3, ["n", "query_id", "score", "case_id", "similarity"]).to_pylist()
    assert sum(looked) < 30 * n / 3
    monkeypatch.setattr(C, "FIRST", n)  # everything at once
    want = C._best(queries, cases, 3, ["n", "query_id", "score", "case_id", "similarity"]).to_pylist()
    key = lambda rows: sorted((r["n"], -r["score"], r["case_id"]) for r in rows)
    assert len(got) == 90 and key(got) == key(want)
