"""Set-similarity join of documents on word shingles with PartEnum signatures.

A document's set holds its distinct shingles of ``width`` words (A-Z in lower case). Two documents link when
``intersection / union >= num / den``. Steps:

1. Equal sets fall into one class (``sid``, a 64-bit hash of the set); from here on classes stand for documents.
2. Exact pre-filter. A class with a partner shares at least ``num/den`` of its shingles. Shingles of a fixed part of the
   hash range are counted over all documents; a class in which more than ``1 - num/den`` of the whole set was seen in no
   other class has no partner and leaves. The next parts are counted over the classes that are left, in the same way: two
   partners are both among them.
3. PartEnum. Sizes fall into bands ``[l, l * den / num]``; partners are in one band or in neighbouring ones, so a set
   takes part in its own band and in the next. Within a band ``|A| + |B|`` bounds the symmetric difference by ``k``. The
   domain is cut into ``n1`` ranges, so that some range holds at most one difference, each range into three, and the
   three pairs of these are enumerated: similar sets agree in at least one of ``3 * n1`` signatures.
   An empty projection says nothing; for small ``n1`` it is replaced by the signatures of a second, salted
   partitioning (which loses nothing); with ``n1 >= 24`` about ten ranges agree even at the very threshold, and
   projections of fewer than two shingles are left out (the chance to lose a pair is below 1e-12).
4. Members of a signature group are compared with its first member, the pivot. Parity bits come first: of each place of a
   bitmap, whether an odd number of shingles fell on it. Two bitmaps differ in no more places than the sets have
   differences, so a pair with too many leaves for certain; the others are compared exactly, on the sets.
5. Groups whose members are not all connected by then hold pairs yet to be seen, each set of members once. Up to ``FEW``
   members are paired with each other. In larger groups pairs can link without being connected through the pivot only
   if their differences to the pivot overlap; these are found by a prefix filter on the differences. Pairs of both kinds
   are compared as in step 4. Nothing is capped; near copies with edits of their own cost one comparison each.

Nulls and empties: without words (or with null text) a document has ``n_shingles`` 0, its own id as component and no
links. Rows with a null ``doc_id`` are returned with a null component. Rows that repeat a ``doc_id`` are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.llm.common import components, cut, discard, gram_hashes, mix, release, small_batches, texts, word_hashes

#: Classes that may be broadcast (8 bytes each); above it the same join shuffles.
BROADCAST_ROWS = 1_000_000
#: Members of an open signature group that are all paired with each other; larger groups go by their differences.
FEW = 32
_TOP = 1 << 64
_ONE = np.uint64(1)


def _set(text: str | None, width: int) -> np.ndarray:
    grams = np.sort(gram_hashes(word_hashes(text), width))
    return grams[np.concatenate([[True], grams[1:] != grams[:-1]])] if len(grams) else grams


def _sid(features: np.ndarray) -> int:
    """Hash of a whole set, independent of order."""
    if not len(features):
        return 0
    total = (features * (features >> np.uint64(7) | _ONE)).sum(dtype=np.uint64)
    return int(mix(total + np.array([len(features)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)[0])


def band_of(size: int, num: int, den: int) -> tuple[int, list[int]]:
    """Number of the band that holds ``size``, and the largest sizes of this band and the next."""
    low, i = 1, 0
    while True:
        high = low * den // num
        if size <= high:
            return i, [high, (high + 1) * den // num]
        low, i = high + 1, i + 1


def signatures(features: np.ndarray, num: int, den: int) -> np.ndarray:
    """PartEnum signatures of a sorted set, for its own band and the next."""
    band, highs = band_of(len(features), num, den)
    out = []
    for tag, high in zip((band, band + 1), highs):
        k = 2 * high * (den - num) // (den + num)
        out += _enumerate(features, k, tag + 1, 0)
    return np.unique(np.concatenate(out)) if out else features[:0]


def _enumerate(features: np.ndarray, k: int, salt: int, depth: int) -> list[np.ndarray]:
    values = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(features ^ np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)])
    if k == 0:
        return [mix(values[-1:] + mix(np.array([salt], np.uint64)))]
    n1 = (k + 2) // 2
    edges = np.array([_TOP * i // (3 * n1) for i in range(1, 3 * n1)], np.uint64)
    at = np.concatenate([[0], np.searchsorted(features, edges), [len(features)]])
    sums = (values[at[1:]] - values[at[:-1]]).reshape(n1, 3)
    counts = np.diff(at).reshape(n1, 3)
    sums = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums  # two of the three parts: all but one
    counts = (counts.sum(axis=1)[:, None] - counts).ravel()
    place = mix(np.arange(3 * n1, dtype=np.uint64) + mix(np.array([salt], np.uint64)))
    found = mix(sums.ravel() + place + counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if n1 >= 24:
        return [found[counts >= 2]]
    if depth == 3:
        return [found]
    out = [found[counts > 0]]
    if (counts == 0).any():
        again = np.sort(mix(features + np.uint64(depth + 1)))
        for j in np.flatnonzero(counts == 0):
            out += _enumerate(again, k, int(place[j]), depth + 1)
    return out


def parity(features: np.ndarray) -> np.ndarray:
    """Bitmap of 64-bit words, at least as many bits as the set has shingles: where an odd number of them falls."""
    bits = 64
    while bits < len(features):
        bits *= 2
    odd = np.bincount((features & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _slim(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), _sid(s)) for (text,) in texts([batch], "text") for s in [_set(text, width)]]
            n, sid = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sid, pa.int64())], ["doc_id", "n", "sid"])
    return run


def _sampled(width: int, low: int, high: int):
    """(feature, sid) from the low-th to the high-th percent of the hash range; equal sets of a batch once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = np.uint64(_TOP * low // 100), np.uint64(min(_TOP * high // 100, _TOP - 1))
        for batch in batches:
            seen, feats, sids, held = set(), [], [], 0
            for (text,) in texts([batch], "text"):
                s = _set(text, width)
                sid = _sid(s)
                if not len(s) or sid in seen:
                    continue
                seen.add(sid)
                some = s[np.searchsorted(s, first):np.searchsorted(s, last)]
                feats.append(some.view(np.int64))
                sids.append(np.full(len(some), sid, np.int64))
                held += len(some)
                if held > 200_000:
                    yield _pairs(feats, sids)
                    feats, sids, held = [], [], 0
            if held:
                yield _pairs(feats, sids)
    return run


def _pairs(feats: list[np.ndarray], sids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(feats)), pa.array(np.concatenate(sids))], ["feature", "sid"])


def _signed(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for (text,) in texts([batch], "text"):
                s = _set(text, width)
                rows.append((_sid(s), s.view(np.int64), signatures(s, num, den).view(np.int64), parity(s)))
                held += len(s)
                if held > 200_000:
                    yield _sets(rows)
                    rows, held = [], 0
            if rows:
                yield _sets(rows)
    return run


def _sets(rows: list[tuple]) -> pa.RecordBatch:
    def lists(i):
        ends = np.cumsum([0, *(len(r[i]) for r in rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[i] for r in rows])))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), lists(1), lists(2), lists(3)],
                                      ["sid", "features", "sigs", "bits"])


def _checked(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table of ids only where its counted size allows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def jaccard_links(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> tuple[DataFrame, DataFrame]:
    """Membership (doc_id, n, sid) of every document and the links (a, b) found between classes.

    The links join every two classes that similarity connects; between classes already connected, not every link is
    listed.
    """
    plain = small_batches(docs).select("doc_id", "text")
    member = cut(plain.mapInArrow(_slim(width), "doc_id bigint, n bigint, sid bigint"), "sets")
    # shingles seen in one class only; their number bounds what a class can share
    part = min(100, 150 * (den - num) // den)
    first = member.where("n > 0 and doc_id is not null").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    left = cut(_with_partners(first.withColumn("lone", F.lit(0)), _lone(plain, width, 0, part), num, den), "left")
    while part < 100:
        rest = plain.join(_checked(left.select("doc_id")), "doc_id", "left_semi")
        before, left = left, cut(_with_partners(left, _lone(rest, width, part, min(100, 2 * part)), num, den), "left")
        part = min(100, 2 * part)
        discard(before)
        release(docs.sparkSession)
    sets = cut(plain.join(_checked(left.select("doc_id")), "doc_id", "left_semi").select("text").mapInArrow(
        _signed(width, num, den), "sid bigint, features array<bigint>, sigs array<bigint>, bits array<bigint>"), "signed")
    discard(left)
    if not member.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        several, sets = sets, cut(sets.dropDuplicates(["sid"]), "signed")
        discard(several)

    spark = docs.sparkSession
    release(spark)
    order = W.partitionBy("sig").orderBy("sid")
    groups = sets.select("sid", F.explode("sigs").alias("sig")).select(
        "sig", "sid", F.first("sid").over(order).alias("pivot"), (F.row_number().over(order) > 2).alias("third"),
        F.lead("sid").over(order).isNotNull().alias("more"))
    groups = cut(groups.where("sid <> pivot").select("sig", "sid", "pivot", F.expr("third or more").alias("several")), "groups")
    release(spark)
    links = _links(groups.select(F.col("pivot").alias("p"), F.col("sid").alias("m")).distinct(), sets, num, den)
    small, large = _open(groups.where("several").select("sig", "sid", "pivot"), components(links))
    release(spark)
    pairs = _paired(small)
    if not large.isEmpty():
        near = cut(_differences(large.select(F.col("pivot").alias("p"), F.col("sid").alias("m"), "rm", "rp").distinct(), sets), "star")
        pairs = pairs.unionByName(_other_pairs(near, num, den))
    found = _links(pairs.distinct(), sets, num, den)
    discard(groups, sets)
    release(spark)
    return member, links.unionByName(found)


def _lone(docs: DataFrame, width: int, low: int, high: int) -> DataFrame:
    """(sid, more): shingles of a part of the hash range that no other class of ``docs`` holds."""
    seen = docs.select("text").mapInArrow(_sampled(width, low, high), "feature bigint, sid bigint")
    one = seen.groupBy("feature").agg(F.min("sid").alias("sid"), F.max("sid").alias("other")).where("sid = other")
    return one.groupBy("sid").agg(F.count(F.lit(1)).alias("more"))


def _with_partners(classes: DataFrame, lone: DataFrame, num: int, den: int) -> DataFrame:
    """Classes (doc_id, sid, n, lone) that can have a partner, given what further shingles of theirs no other class holds."""
    rows = classes.join(lone, "sid", "left").withColumn("lone", F.col("lone") + F.coalesce("more", F.lit(0)))
    return rows.where(F.col("lone") * den <= F.col("n") * (den - num)).select("doc_id", "sid", "n", "lone")


def _open(groups: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (sig, sid, pivot, rm, rp) of the groups whose members are of more than one component: up to FEW members, and more.

    ``rm`` and ``rp`` are the components of member and pivot. Of groups with the same members one stays.
    """
    at = groups.join(roots.select(F.col("node").alias("sid"), F.col("root").alias("rm")), "sid", "left").join(
        roots.select(F.col("node").alias("pivot"), F.col("root").alias("rp")), "pivot", "left").select(
        "sig", "sid", "pivot", F.coalesce("rm", "sid").alias("rm"), F.coalesce("rp", "pivot").alias("rp"))
    sums = at.groupBy("sig").agg(F.min("pivot").alias("p"), F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("sid")).alias("who"),
                                 F.min(F.least("rm", "rp")).alias("lo"), F.max(F.greatest("rm", "rp")).alias("hi")).where("lo <> hi")
    once = cut(sums.groupBy("p", "members", "who").agg(F.min("sig").alias("sig")).select("sig", "members"), "open")
    rows = cut(at.join(once, "sig"), "opened")
    discard(once)
    return rows.where(F.col("members") <= FEW), rows.where(F.col("members") > FEW)


def _paired(groups: DataFrame) -> DataFrame:
    """Pairs (p, m) of members of one small group that are of different components."""
    each = groups.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("sid", "rm"))).alias("all"))
    pair = "flatten(transform(all, (x, i) -> transform(filter(slice(all, i + 2, size(all)), y -> y.rm <> x.rm), y -> struct(x.sid as p, y.sid as m))))"
    return each.select(F.explode(F.expr(pair)).alias("e")).select("e.p", "e.m")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those (a, b) of the pairs (p, m) that link: first by sizes and parity bits, which lose none, then exactly."""
    slim = sets.select("sid", F.size("features").alias("n"), "bits")
    rows = pairs.join(slim.toDF("m", "nm", "bm"), "m").join(slim.toDF("p", "np", "bp"), "p")
    rows = rows.where(F.least("np", "nm") * den >= F.greatest("np", "nm") * num)
    # sizes within the threshold give bitmaps of one length or of that and its double; others (num / den below 1 / 2) are not judged
    half = "transform(sequence(0, size({0}) div 2 - 1), i -> {0}[i] ^ {0}[i + size({0}) div 2])"
    for x, y in (("bp", "bm"), ("bm", "bp")):
        rows = rows.withColumn(x, F.when(F.size(x) > F.size(y), F.expr(half.format(x))).otherwise(F.col(x)))
    apart = F.expr("if(size(bp) = size(bm), aggregate(zip_with(bp, bm, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v), 0)")
    likely = cut(rows.where(_linked(apart, F.col("np") + F.col("nm"), num, den)).select("p", "m"), "likely")
    exact = _differences(likely, sets).where(_linked(F.col("d"), F.col("np") + F.col("nm"), num, den))
    exact = cut(exact.select(F.col("p").alias("a"), F.col("m").alias("b")), "found")
    discard(likely)
    return exact


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (p, m) with np, nm, diff, d: sizes of both sets, their symmetric difference and its size."""
    ids = _checked(pairs.select(F.explode(F.array("p", "m")).alias("sid")).distinct())
    sets = sets.select("sid", "features").join(ids, "sid", "left_semi")
    p = sets.select(F.col("sid").alias("p"), F.col("features").alias("fp"))
    m = sets.select(F.col("sid").alias("m"), F.col("features").alias("fm"))
    diff = F.concat(F.array_except("fp", "fm"), F.array_except("fm", "fp"))
    rows = pairs.join(m, "m").join(p, "p").select(*pairs.columns, F.size("fp").alias("np"), F.size("fm").alias("nm"), diff.alias("diff"))
    return rows.withColumn("d", F.size("diff"))


def _linked(d: Column, sizes: Column, num: int, den: int) -> Column:
    """intersection / union >= num / den, said of the symmetric difference and the sum of the sizes."""
    return d * (den + num) <= sizes * (den - num)


def _other_pairs(near: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (p, m) of members of one large signature group that may link and are not yet in one component.

    All members were compared with the group's pivot, so each is its difference to the pivot. With D the differences and
    c = (1 - t) / (1 + t), two members u, m link when ``|D_u| + |D_m| - 2 |D_u & D_m| <= c (|u| + |m|)``. If both link
    with the pivot they are connected already. If u does not, they must share more than ``(1 - c) |D_m| / 2`` elements
    of D_m: a prefix filter on the differences (rare elements first, with the usual bound from the positions) finds
    these pairs; near copies with edits of their own share none and cost nothing.
    """
    s, r = den + num, den - num
    every = cut(near.select("p", "m", "np", "nm", "d", "rm", F.explode("diff").alias("e")), "edits")
    times = every.groupBy("p", "e").agg(F.count(F.lit(1)).alias("times"))
    each = every.join(times, ["p", "e"]).withColumn("j", F.row_number().over(W.partitionBy("p", "m").orderBy("times", "e")) - 1)
    each = cut(each.where("times > 1"), "edits")
    discard(every)
    apart = F.expr(f"{s} * d > {r} * (np + nm)")
    probe = each.where(apart & (F.col("j") <= F.col("d") - F.greatest(F.lit(1), F.expr(f"ceil(({s} * d - {r} * (np + nm) + {s - r}) / {2 * s})"))))
    probe = probe.select("p", "e", F.col("m").alias("u"), F.col("nm").alias("nu"), F.col("d").alias("du"), F.col("rm").alias("ru"), F.col("j").alias("ju"))
    index = each.where(F.expr(f"j <= d - floor({s - r} * d / {2 * s}) - 1")).select("p", "e", "m", "nm", "d", "rm", "j")
    need = F.expr(f"ceil(({s} * (du + d) - {r} * (nu + nm)) / {2 * s})")
    can = F.least(F.col("du") - F.col("ju"), F.col("d") - F.col("j"))
    size = F.least("nu", "nm") * den >= F.greatest("nu", "nm") * num
    found = probe.join(index, ["p", "e"]).where((F.col("ru") != F.col("rm")) & size & (can >= need))
    return found.select(F.least("u", "m").alias("p"), F.greatest("u", "m").alias("m")).distinct()


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: component_id is the smallest doc_id reachable by links."""
    member, links = jaccard_links(docs, width, num, den)
    linkable = member.where("n > 0 and doc_id is not null")
    # rows that repeat a doc_id with other words are one node: their classes are linked through the id
    again = linkable.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b")
    again = linkable.join(again.select("doc_id", "a"), "doc_id").select("a", F.col("sid").alias("b")).where("a <> b")
    roots = components(links.unionByName(again)).withColumnRenamed("node", "sid")
    rooted = cut(linkable.join(roots, "sid", "left").select("doc_id", "n", F.coalesce("root", "sid").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = rooted.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(member.where("n = 0 or doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one_per_component(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` without those that are near copies of a row with a smaller doc_id.

    One row stays for each component; of rows that repeat a kept doc_id the one with the smallest text hash stays. Rows without words or without a
    doc_id are linked with nothing and stay.
    """
    found = cut(jaccard_components(docs, width, num, den), "classes")
    drop = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(_checked(drop), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select("doc_id")
    repeated = cut(repeated, "repeated")
    if repeated.isEmpty():
        return kept
    several = kept.join(_checked(repeated), "doc_id", "left_semi").select(*docs.columns)
    least = F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))
    one = several.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), least).alias("row"))
    return kept.join(_checked(repeated), "doc_id", "left_anti").select(*docs.columns).unionByName(one.select("row.*"))
