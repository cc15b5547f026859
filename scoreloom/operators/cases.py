"""Case retrieval: the most similar cases of a table for every row of a query table.

A similarity needs genre, roles, section and diagnosis of both sides, so there is no key to join on. Of cases with equal contents
only the first ``k`` can be among the best and stay; queries that ask for the same are answered once. A task handles one strip
of queries and one of cases: queries of equal genre, roles and section look at the cases in the order of the best score that a
case can still reach for them, and stop as soon as their k-th score is above it. (query, case) pairs are never rows, and nothing passes through the driver.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.session import materialize

#: Queries and cases of a strip; (query, case) pairs that a task compares at a time, beginning with so many cases.
BLOCK = 20_000
CASES = 50_000
PAIRS = 1_000_000
FIRST = 256
_QUERY = ["query_id", "genre", "roles", "diagnosis", "section"]


@dataclass
class Queries:
    """A block of queries as matrices over the roles and diagnosis keys that occur in it."""

    ids: list
    genres: list
    sections: list
    roles: dict[str, int]
    keys: dict[str, int]
    has_role: np.ndarray
    n_roles: np.ndarray
    values: np.ndarray
    known: np.ndarray

    @classmethod
    def build(cls, rows: list[dict]) -> Queries:
        sets = [sorted({r for r in row["roles"] or [] if r is not None}) for row in rows]
        maps = [dict(row["diagnosis"]) if row["diagnosis"] is not None else None for row in rows]
        roles = {r: i for i, r in enumerate(sorted({r for s in sets for r in s}))}
        keys = {k: i for i, k in enumerate(sorted({k for m in maps if m for k in m}))}
        has, values, known = np.zeros((len(rows), len(roles))), np.zeros((len(rows), len(keys))), np.zeros((len(rows), len(keys)))
        for i, (s, m) in enumerate(zip(sets, maps)):
            has[i, [roles[r] for r in s]] = 1
            for k, v in (m or {}).items():
                if v is not None:
                    values[i, keys[k]], known[i, keys[k]] = v, 1
        return cls([r["query_id"] for r in rows], [r["genre"] or None for r in rows], [r["section"] for r in rows], roles, keys,
                   has, np.array([len(s) for s in sets]), values, known)


def _match(mine: list, theirs: list, same: float, other: float, unset: float, open_: bool) -> np.ndarray:
    """(case, query) weights of a label: ``unset`` where the query has none; ``open_``: a case without one fits all."""
    names = {v: i for i, v in enumerate(dict.fromkeys(x for x in mine if x is not None))}
    q = np.array([names.get(v, -1) for v in mine])
    c = np.array([names.get(v, -2) if v is not None else -3 for v in theirs])
    out = np.where(c[:, None] == q, same, other)
    if open_:
        out[c == -3] = same
    out[:, q == -1] = unset
    return out


def _bound(q: Queries, batch: dict) -> np.ndarray:
    """0.45 genre + 0.45 role overlap, (case, query)."""
    sets = [{r for r in s or [] if r is not None} for s in batch["stem_roles"]]
    has = np.zeros((len(sets), len(q.roles)))
    for i, s in enumerate(sets):
        has[i, [q.roles[r] for r in s if r in q.roles]] = 1
    n = np.array([len(s) for s in sets])
    shared = has @ q.has_role.T
    union = n[:, None] + q.n_roles - shared
    jaccard = np.where(union > 0, shared / np.maximum(union, 1), 1.0)
    return 0.45 * _match(q.genres, batch["genre"], 1.0, 0.3, 0.5, False) + 0.45 * jaccard


def _similarity(q: Queries, base: np.ndarray, values: np.ndarray, known: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """(case, query) similarity of cases with the diagnosis ``values`` and ``known`` to the queries ``rows``."""
    if not q.keys:
        return np.repeat(base[:, None], len(rows), 1)
    mine, mine_known = q.values[rows], q.known[rows]
    dot = values @ mine.T
    na, nb = np.sqrt(known @ (mine**2).T), np.sqrt((values**2) @ mine_known.T)
    cosine = np.where((na < 1e-9) | (nb < 1e-9), 0.0, dot / np.maximum(na * nb, 1e-300))
    return np.where(known @ mine_known.T > 0, 0.5 * base[:, None] + 0.25 * (cosine + 1.0), base[:, None])


def _places(rows: list[tuple]) -> tuple[list[tuple], np.ndarray]:
    """Distinct rows and the place of each row among them."""
    index = {r: i for i, r in enumerate(dict.fromkeys(rows))}
    return list(index), np.array([index[r] for r in rows])


def _best(queries: pa.Table, cases: pa.Table, k: int, names: list[str]) -> pa.Table:
    """The best ``k`` cases of a strip for each query of another."""
    cases = cases.filter(pc.is_finite(cases["__bonus"]))
    asked = queries.select(_QUERY).to_pylist()
    if not asked or not cases.num_rows:
        return queries.slice(0, 0).select(["__n", "query_id"]).append_column("score", pa.array([], pa.float64())).append_column(
            "case_id", cases["case_id"].slice(0, 0)).append_column("similarity", pa.array([], pa.float64())).rename_columns(names)
    cases = cases.take(pc.sort_indices(cases, sort_keys=[("case_id", "ascending")], null_placement="at_end"))  # the index breaks ties
    q, bonus = Queries.build(asked), cases["__bonus"].to_numpy()
    values, known = np.zeros((len(bonus), len(q.keys))), np.zeros((len(bonus), len(q.keys)))
    for i, m in enumerate(cases["diagnosis"].to_pylist()):
        for pair in m:
            if pair["key"] in q.keys:
                values[i, q.keys[pair["key"]]], known[i, q.keys[pair["key"]]] = pair["value"], 1
    cells, cell = _places([(g, tuple(r), s) for g, r, s in zip(*(cases[c].to_pylist() for c in ("genre", "stem_roles", "section_type")))])
    shapes, shape = _places([(r["genre"], tuple(sorted({x for x in r["roles"] or [] if x is not None})), r["section"]) for r in asked])
    ask = Queries.build([{"query_id": None, "genre": g, "roles": list(r), "section": s, "diagnosis": None} for g, r, s in shapes])
    labels = {c: [x[i] for x in cells] for i, c in enumerate(("genre", "stem_roles", "section_type"))}
    bases = _bound(ask, labels) + 0.10 * _match(ask.sections, labels["section_type"], 1.0, 0.5, 1.0, True)
    found: list[tuple[np.ndarray, ...]] = []
    for s in range(len(shapes)):
        base = bases[cell, s]
        top = np.maximum(base, 0.5 * base + 0.5) + bonus  # without and with a diagnosis that fits
        order = np.argsort(-top, kind="stable")
        mine = np.flatnonzero(shape == s)
        for at in range(0, len(mine), PAIRS // FIRST):
            found += _search(q, mine[at:at + PAIRS // FIRST], order, top, base, bonus, values, known, k)
    row, score, case, sim = (np.concatenate(c) for c in zip(*found))
    picked = queries.select(["__n", "query_id"]).take(row)
    return pa.table([picked["__n"], picked["query_id"], pa.array(score), cases["case_id"].take(case), pa.array(sim)], names)


def _search(q: Queries, rows: np.ndarray, order: np.ndarray, top: np.ndarray, base: np.ndarray, bonus: np.ndarray, values: np.ndarray,
            known: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """(query, score, case, similarity) of the best ``k`` cases of queries of one shape, cases taken in ``order``."""
    out, at, step = [], 0, FIRST
    score, case, sim = np.full((len(rows), k), -np.inf), np.full((len(rows), k), len(order)), np.zeros((len(rows), k))
    while len(rows):
        some = order[at:at + step]
        new = _similarity(q, base[some], values[some], known[some], rows).T
        total = np.round(new + bonus[some], 9)
        score = np.hstack([score, np.where(np.isnan(total), -np.inf, total)])
        case = np.hstack([case, np.broadcast_to(some, total.shape)])
        first = np.lexsort((case, -score), axis=1)[:, :k]
        score, case, sim = (np.take_along_axis(m, first, 1) for m in (score, case, np.hstack([sim, new])))
        at += step
        done = score[:, -1] > top[order[at]] + 2e-9 if at < len(order) else np.ones(len(rows), bool)
        i, j = np.nonzero(done[:, None] & (score > -np.inf))
        out.append((rows[i], score[i, j], case[i, j], sim[i, j]))
        rows, score, case, sim = rows[~done], score[~done], case[~done], sim[~done]
        step = max(FIRST, min(2 * step, PAIRS // max(len(rows), 1)))
    return out


def similar_cases(queries: DataFrame, cases: DataFrame, k: int = 5, min_reward: float = 0.0, block: int = BLOCK) -> DataFrame:
    """(query_id, place, case_id, similarity, score): per query the top-k cases by similarity plus a small bonus for proven ones.

    ``queries``: query_id, genre, roles, diagnosis (map), section; nulls mean "not asked for". ``cases``: case_id, genre,
    stem_roles, diagnosis, section_type, reward_delta, n_observations; cases that gained less than ``min_reward`` are left
    out. Scores equal to nine decimals are ordered by case_id. Queries and cases are written once (this starts jobs).
    """
    gain = F.coalesce("reward_delta", F.lit(0.0))
    bonus = F.tanh(gain) * 0.1 + F.log1p(F.coalesce("n_observations", F.lit(1)).cast("double")) * 0.02
    roles = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))))
    known = F.array_sort(F.filter(F.coalesce(F.map_entries("diagnosis"), F.array()), lambda e: e["value"].isNotNull()))
    content = {"genre": F.col("genre"), "stem_roles": roles("stem_roles"), "section_type": F.col("section_type"), "diagnosis": known, "__bonus": bonus}
    pool = cases.where(gain >= min_reward).select("case_id", *[c.alias(n) for n, c in content.items()])
    place = F.row_number().over(W.partitionBy(*content).orderBy(F.asc_nulls_last("case_id")))
    pool = materialize(pool.withColumn("__place", place).where(F.col("__place") <= k).drop("__place"), "cases")
    asks = {"genre": F.when(F.col("genre") != "", F.col("genre")), "roles": roles("roles"), "diagnosis": known, "section": F.col("section")}
    asked = materialize(queries.select("query_id", *[c.alias(n) for n, c in asks.items()]), "queries")
    numbered = materialize(asked.groupBy(*asks).agg(F.min("query_id").alias("query_id")).withColumn("__n", F.monotonically_increasing_id()), "asked")
    same = functools.reduce(lambda on, c: on & asked[c].eqNullSafe(numbered[c]), asks, F.lit(True))
    members = asked.join(numbered, same).select(asked["query_id"], "__n")
    numbered = numbered.withColumn("diagnosis", F.map_from_entries("diagnosis"))
    nq, nc = max(1, -(-numbered.count() // block)), max(1, -(-pool.count() // CASES))
    strip, every = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    ask = numbered.withColumn("__q", strip("__n", nq)).withColumn("__c", every(nc))
    have = pool.withColumn("__c", strip("case_id", nc)).withColumn("__q", every(nq))
    names = ["__n", "query_id", "score", "case_id", "similarity"]
    kinds = {n: f.schema[n].dataType.simpleString() for f, n in ((cases, "case_id"), (queries, "query_id"))}
    found = ask.groupBy("__q", "__c").cogroup(have.groupBy("__q", "__c")).applyInArrow(
        lambda mine, theirs: _best(mine, theirs, k, names),
        f"__n bigint, query_id {kinds['query_id']}, score double, case_id {kinds['case_id']}, similarity double")
    best = F.row_number().over(W.partitionBy("__n").orderBy(F.desc("score"), F.asc_nulls_last("case_id")))
    return found.drop("query_id").withColumn("place", best).where(F.col("place") <= k).join(members, "__n").select(
        "query_id", "place", "case_id", F.round("similarity", 3).alias("similarity"), "score")
