"""Near duplicates, contained benchmark items and repeated passages against brute force."""

import random
import re

import numpy as np

from scoreloom.llm.decontaminate import drop_contaminated, leaks
from scoreloom.llm.jaccard import band_of, jaccard_components, keep_one_per_component, signatures
from scoreloom.llm.passages import LEAST, common_passages, compact_windows, repeated_passages, shingles

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute_components(rows, width, num, den):
    sets = {i: shingle_set(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * den >= len(sets[a] | sets[b]) * num:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, bases=12, edits=14):
    """Texts of 1 to 900 words with chains of edited copies, exact copies and a shared first line."""
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(3000)]
    rows, doc = [], 0
    for base in range(bases):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 30, 60, 200, 400, 900]))]
        if base % 3 == 0:
            words = "a common first line of twelve words that many documents share here".split() + words
        for _ in range(rnd.randrange(1, edits)):
            rows.append((doc, " ".join(words)))
            doc += rnd.randrange(1, 4)
            for _ in range(rnd.randrange(0, 1 + len(words) // 25)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
    rnd.shuffle(rows)
    return rows


def test_components_match_brute_force(make):
    for seed, width, num, den in ((1, 3, 9, 10), (2, 5, 4, 5), (3, 3, 9, 10)):
        rows = corpus(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(make(rows).repartition(5), width, num, den).collect()}
        assert got == brute_components(rows, width, num, den)


def test_links_between_members_of_a_hot_group(make):
    """Near copies around the threshold: many links miss the pivot, some run through shared edits only."""
    for seed, width, num, den in ((1, 3, 9, 10), (2, 5, 4, 5)):
        rnd = random.Random(seed)
        base = [f"b{i}" for i in range(150)]
        edits = [(rnd.randrange(150), f"e{i}") for i in range(12)]
        rows = []
        for doc in range(160):
            words = list(base)
            for at, word in rnd.sample(edits, rnd.randrange(0, 8)):
                words[at] = word
            for _ in range(rnd.randrange(0, 5)):
                words[rnd.randrange(150)] = f"own{doc}-{rnd.random()}"
            rows.append((doc, " ".join(words)))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(make(rows).repartition(5), width, num, den).collect()}
        want = brute_components(rows, width, num, den)
        assert got == want and len({c for _, c in want.values()}) > 3


def test_similar_sets_share_a_signature():
    import numpy as np
    rnd = np.random.default_rng(5)
    for num, den in ((9, 10), (4, 5)):
        for size in [1, 2, 3, 5, 9, 10, 11, 17, 30, 64, 65, 130, 300, 1500]:
            for _ in range(40 if size < 100 else 8):
                common = rnd.integers(0, 2**63, size, np.uint64)
                apart = size * (den - num) // num  # the largest difference at the threshold
                left = rnd.integers(0, apart + 1)
                extra = rnd.integers(0, 2**63, apart, np.uint64)
                a, b = np.unique(np.concatenate([common, extra[:left]])), np.unique(np.concatenate([common, extra[left:]]))
                assert len(np.intersect1d(a, b)) * den >= len(np.union1d(a, b)) * num
                assert len(np.intersect1d(signatures(a, num, den), signatures(b, num, den)))
    assert band_of(1, 9, 10) == (0, [1, 2])


def test_hot_group_keeps_one(make):
    """A third of the rows are near copies of one text, each different from the others."""
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:180], f"x{i}", *base[180:]])) for i in range(100)]
    rows += [(100 + i, " ".join(f"{rnd.random()}" for _ in range(30))) for i in range(200)]
    kept = {r.doc_id for r in keep_one_per_component(make(rows).repartition(7)).collect()}
    assert kept == {0, *range(100, 300)}


def test_components_edge_cases(odd, none):
    got = jaccard_components(odd, 3, 9, 10).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert by[1] == (6, 1) and by[5] == (6, 1) and by[2] == by[3][:1] + (2,) == (0, 2) and by[7] == (1, 7) and by[None][1] is None
    kept = keep_one_per_component(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 2, 3, None, None, 4, 6, 7, 8, 9], key=str)
    assert jaccard_components(none).count() == 0 and keep_one_per_component(none).count() == 0


def test_leaks_match_brute_force(spark, make):
    rnd = random.Random(9)
    vocab = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 3, 5, 6, 12, 25, 40, 40, 60])]
    rows = []
    for doc in range(60):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([0, 4, 50, 400]))]
        item = items[doc % len(items)][1].split()
        for _ in range(doc % 4):
            item[rnd.randrange(len(item))] = "other"
        at = rnd.randrange(len(words) + 1)
        rows.append((doc, " ".join(words[:at] + [w.upper() for w in item] + words[at:]) if doc % 5 else " ".join(item)))
    want = set()
    for doc, text in rows:
        for item, passage in items:
            need, have = shingle_set(passage, 5), shingle_set(text.lower(), 5)
            if need and len(need & have) * 5 >= len(need) * 4:
                want.add((doc, item, len(need & have)))
    table = spark.createDataFrame([*items, (90, None), (91, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.shared) for r in leaks(make(rows), table).collect()}
    assert got == want and want
    kept = {r.doc_id for r in drop_contaminated(make(rows), table).collect()}
    assert kept == {doc for doc, _ in rows} - {d for d, _, _ in want}


def test_leaks_edge_cases(spark, odd, none):
    items = spark.createDataFrame([(1, "b c d e f g"), (None, None), (2, "x y z"), (3, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(odd, items).collect()}
    assert got == {(1, 1), (5, 1), (None, 2)}
    kept = drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert leaks(none, items).count() == 0 and leaks(odd, items.limit(0)).count() == 0


def test_open_groups_of_every_size_match_brute_force(make, monkeypatch):
    """Groups paired in full and groups that go by their differences find the same, and parity bits lose no link."""
    from scoreloom.llm import jaccard
    rows = corpus(4, bases=10, edits=20)
    want = brute_components(rows, 3, 9, 10)
    for few in (0, 1000):
        monkeypatch.setattr(jaccard, "FEW", few)
        got = jaccard.jaccard_components(make(rows).repartition(3), 3, 9, 10).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    rnd = np.random.default_rng(5)
    for n, edits in ((1, 1), (64, 9), (65, 20), (700, 90), (5000, 600)):
        a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        b = np.union1d(a[edits // 2:], rnd.integers(0, 1 << 63, edits).astype(np.uint64))
        bits = [np.unpackbits(jaccard.parity(s).view(np.uint8), bitorder="little") for s in (a, b)]
        short = min(map(len, bits))
        one, two = (x.reshape(-1, short).sum(axis=0) & 1 for x in bits)
        assert int((one != two).sum()) <= len(np.setxor1d(a, b)) and all(len(x) >= len(y) for x, y in zip(bits, (a, b)))


def test_near_copies_without_long_shuffles(make):
    """Documents that share a passage with all others, none alike: no table holds their differences shingle by shingle."""
    from scoreloom.llm import jaccard
    rnd = random.Random(8)
    line = [f"l{i}" for i in range(60)]
    rows = [(i, " ".join(line + [f"{rnd.randrange(10**9)}" for _ in range(14)])) for i in range(25)]
    written = []
    real, jaccard.cut = jaccard.cut, lambda df, name: (written.append((name, df)), real(df, name))[1]
    try:
        got = jaccard.jaccard_components(make(rows).repartition(3)).collect()
    finally:
        jaccard.cut = real
    assert {r.doc_id: r.component_id for r in got} == {i: w[1] for i, w in brute_components(rows, 5, 4, 5).items()}
    assert "edits" not in [name for name, _ in written]


def test_compact_windows_match_definition():
    text = " ".join(str(random.Random(i % 70).random()) for i in range(160))
    grams = shingles(text)
    for fn in range(3):
        from scoreloom.llm.passages import _FACTORS
        ranks = [(v >> 8, i) for i, v in enumerate((grams * _FACTORS[fn]).tolist())]
        want = set()
        for c, v in enumerate(ranks):
            low = max([i + 1 for i in range(c) if ranks[i] < v], default=0)
            high = min([i - 1 for i in range(c + 1, len(ranks)) if ranks[i] < v], default=len(ranks) - 1)
            if high - low + 1 >= 20:
                want.add((c, low, high))
        assert set(zip(*(x.tolist() for x in compact_windows(grams, fn, 20)))) == want


def test_repeated_passages_found(make):
    rnd = random.Random(3)
    new = lambda n: [f"{rnd.randrange(10**9)}" for _ in range(n)]
    shared, edited = new(60), new(80)
    rows, want = [], {}
    for doc in range(40):
        words = new(rnd.randrange(0, 300))
        if doc % 4 == 0:
            at = len(words)
            words = words + shared + new(30)
            want[doc] = (at, at + 60)
        rows.append((doc, " ".join(words)))
    other = edited[:40] + ["changed"] + edited[41:]
    rows += [(100, " ".join(new(20) + edited)), (101, " ".join(other + new(50)))]
    rows += [(200 + i, " ".join(["copy"] + [str(j) for j in range(70)])) for i in range(5)]
    got = repeated_passages(make(rows).repartition(4)).collect()
    assert {r.doc_id for r in got} == {*want, 100, 101, *range(200, 205)}
    for r in got:
        if r.doc_id in want:
            assert (r.start_word, r.end_word) == want[r.doc_id]
        elif r.doc_id in (100, 101):
            assert r.end_word - r.start_word == 80 and r.similarity >= 0.8
    # fifty words exactly are enough, forty-nine are not
    words = new(50)
    assert common_passages(shingles(" ".join(words)), shingles(" ".join(new(9) + words)))
    assert not common_passages(shingles(" ".join(words[1:])), shingles(" ".join(new(9) + words))) and LEAST == 46


def test_repeated_passages_edge_cases(odd, none):
    got = repeated_passages(odd.unionByName(odd.where("doc_id = 4").withColumn("doc_id", odd.doc_id + 100))).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in got} == {(4, 0, 30_000), (104, 0, 30_000)}
    assert repeated_passages(none).count() == 0


def exact_starts(a, b, n=50):
    """First words of the runs of ``n`` words of ``a`` that ``b`` holds."""
    have = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)}
    return {i for i in range(len(a) - n + 1) if tuple(a[i:i + n]) in have}


def mosaic(rnd, new, line, passage):
    """Text of a repeated line, copies of a passage, edited copies, runs of one word and words of its own."""
    out = []
    for _ in range(rnd.randrange(2, 8)):
        edited = passage[:]
        edited[rnd.randrange(len(edited))] = "edit"
        out += rnd.choice([line * rnd.randrange(1, 4), passage, new(rnd.randrange(1, 60)), ["x"] * rnd.randrange(5, 120), edited])
    return out


def test_all_places_of_a_passage():
    rnd = random.Random(5)
    new = lambda n: [f"{rnd.randrange(10**9)}" for _ in range(n)]
    for _ in range(150):
        line, passage = new(rnd.randrange(3, 20)), new(rnd.randrange(50, 90))
        a, b = (mosaic(rnd, new, line, passage) for _ in range(2))
        found = common_passages(shingles(" ".join(a)), shingles(" ".join(b)))
        for own, other, at in ((a, b, 0), (b, a, 2)):
            covered = {i for f in found for i in range(f[at], f[at + 1] - LEAST + 2)}
            assert exact_starts(own, other) <= covered
    # a repeated line before the passage, and a second copy, which has a row of its own
    passage = new(60)
    found = common_passages(shingles(" ".join(new(5) + passage + new(9))), shingles(" ".join(passage[20:40] + new(7) + passage + new(8) + passage)))
    assert {f[:4] for f in found} >= {(5, 60, 27, 82), (5, 60, 95, 150)}


def test_edited_passages_right_at_the_similarity():
    rnd = random.Random(6)
    new = lambda n: [f"{rnd.randrange(10**9)}" for _ in range(n)]
    words, fifty = new(90), new(50)
    for a, b in ((words, words[:43] + new(5) + words[48:]), (words, words[:45] + new(9) + words[45:]), (fifty, fifty[:1] + new(1) + fifty[2:])):
        (found,) = common_passages(shingles(" ".join(new(30) + a + new(40))), shingles(" ".join(new(7) + b + new(80))))
        assert found[0] <= 32 and found[1] >= 30 + len(a) - 5 and found[4] >= 0.8
    # a near copy within a longer stretch that is too unlike
    loose = [w if i % 12 else "edit" for i, w in enumerate(new(120))]
    other = [w if i % 12 else "other" for i, w in enumerate(loose)]
    near = words[:45] + ["edit"] + words[46:]
    found = common_passages(shingles(" ".join(loose + words + new(9))), shingles(" ".join(other + near + new(9))))
    assert any(f[0] <= 120 and f[1] >= 120 + 85 for f in found)


def test_runs_that_no_passage_can_hold_are_not_followed(monkeypatch):
    from scoreloom.llm import passages
    rnd = random.Random(8)
    new = lambda n: [f"w{rnd.getrandbits(40)}" for _ in range(n)]
    followed, real = [], passages._chain
    monkeypatch.setattr(passages, "_chain", lambda *a: followed.append(a) or real(*a))
    a, b = [], []
    for _ in range(60):  # shared runs of 16 words, far apart in one text
        run = new(16)
        a, b = a + run + new(8), b + run + new(60)
    assert common_passages(shingles(" ".join(a)), shingles(" ".join(b))) == [] and not followed  # all 60 were followed before
    edited = new(90)
    other = edited[:42] + new(5) + edited[47:]
    (found,) = common_passages(shingles(" ".join(a + edited + new(30))), shingles(" ".join(b + other + new(30))))
    assert found[:4] == (len(a), len(a) + 85, len(b), len(b) + 85) and found[4] == 77 / 95 and len(followed) <= 2


def test_edited_passages_that_both_texts_repeat():
    """Five edited copies in each of two texts: 25 pairs of places of a shingle, and no 50 words that are equal as a whole."""
    rnd = random.Random(11)
    new = lambda n: [f"{rnd.randrange(10**9)}" for _ in range(n)]
    passage, a, b = new(90), [], []
    for _ in range(5):
        a += new(60) + passage[:43] + new(1) + passage[44:]
        b += new(70) + passage
    found = {f[:4]: f[4] for f in common_passages(shingles(" ".join(a)), shingles(" ".join(b)))}
    assert found == {(x, x + 85, y, y + 85): 81 / 91 for x in range(60, 750, 150) for y in range(70, 800, 160)}


def test_equal_runs_are_all_maximal_runs():
    from scoreloom.llm import passages
    rnd = random.Random(12)
    for _ in range(60):
        words = [f"{rnd.randrange(10**9)}" for _ in range(rnd.choice((1, 2, 40)))]
        a, *others = ([rnd.choice(words) if rnd.random() < 0.97 else str(i) for i in range(rnd.randrange(50, 120))] for _ in range(4))
        line = a[:rnd.randrange(50)]
        a, others = a + line + line, [b + line + line + line for b in others]
        one, *rest = (shingles(" ".join(w)) for w in (a, *others))
        want = set()
        for t, two in enumerate(rest):
            equal = {(x, y) for x, v in enumerate(one.tolist()) for y, w in enumerate(two.tolist()) if v == w}
            hit = len({y for _, y in equal}) >= passages.LEAST_BOTH
            for x, y in equal if hit else ():
                if (x - 1, y - 1) not in equal:
                    want.add((t, x, y, next(n for n in range(1, 999) if (x + n, y + n) not in equal)))
        side, many = passages.Side(one), passages.Texts(rest)
        got = passages._equal_runs(side, many, *passages._hits(side, many, np.ones(len(rest), bool)))
        assert len(got) == len(want) and set(map(tuple, got.tolist())) == want


def test_passages_of_frequent_lines(make):
    """Frequent lines around a passage that a few share: each exact run of 50 words is covered, however rows are dealt."""
    rnd = random.Random(7)
    new = lambda n: [f"{rnd.randrange(10**9)}" for _ in range(n)]
    lines = [new(26) for _ in range(6)]
    rows = []
    for doc in range(120):
        words = []
        for _ in range(rnd.randrange(2, 6)):
            words += rnd.choice(lines) + (new(rnd.randrange(1, 30)) if rnd.random() < 0.6 else [])
        rows.append((doc, words))
    texts = dict(rows)
    whole = {i: {tuple(w[j:j + 50]) for j in range(len(w) - 49)} for i, w in rows}
    for parts in (1, 7):
        covered = {i: set() for i in texts}
        for r in repeated_passages(make([(i, " ".join(w)) for i, w in rows]).repartition(parts)).collect():
            covered[r.doc_id] |= set(range(r.start_word, r.end_word - 49))
        for i, w in rows:
            others = set().union(*(s for j, s in whole.items() if j != i))
            assert {j for j in range(len(w) - 49) if tuple(w[j:j + 50]) in others} <= covered[i]


def test_edited_passages_of_frequent_seeds(make):
    """Edited copies of one passage in many documents, in one tile and in several: rows of all pairs, not of the smallest document's only."""
    from scoreloom.llm import passages
    rnd = random.Random(9)
    new = lambda n: [f"{rnd.randrange(10**9)}" for _ in range(n)]
    base, rows = new(120), []
    for doc in range(60):
        words = base[:]
        for _ in range(rnd.randrange(2, 5)):
            words[rnd.randrange(120)] = "edit" + str(rnd.randrange(10**6))
        rows.append((doc, " ".join(new(rnd.randrange(5, 30)) + words + new(rnd.randrange(5, 30)))))
    rows += [(60 + i, " ".join(new(20) + base[40:70] + new(20))) for i in range(8)]
    grams = {i: shingles(t) for i, t in rows}
    want = {}
    for a in grams:
        for b in grams:
            for x0, x1, y0, y1, s in common_passages(grams[a], grams[b]) if a < b else []:
                for at, other in (((a, x0, x1 + 5), b), ((b, y0, y1 + 5), a)):
                    low, high = want.get(at, (other, s))
                    want[at] = min(low, other), max(high, s)
    real = passages.TILE
    try:
        for passages.TILE in (real, 16):
            got = repeated_passages(make(rows).repartition(5)).collect()
            assert {(r.doc_id, r.start_word, r.end_word): (r.other_doc, r.similarity) for r in got} == want
    finally:
        passages.TILE = real


def test_pairs_of_frequent_seeds_meet_once_and_texts_only_then(spark):
    from scoreloom.llm import passages
    rnd = random.Random(13)
    groups = [set(rnd.sample(range(60), 40)) for _ in range(5)]
    groups += [g - {min(g)} for g in groups] + [groups[0] | {99}]  # seeds beside others of almost the same documents
    frequent = spark.createDataFrame([(k, d) for k, g in enumerate(groups) for d in g], "key bigint, doc bigint")
    kept = spark.createDataFrame([(d, "text") for d in (*range(60), 99)], "doc_id bigint, text string")
    real = passages.TILE
    try:
        passages.TILE = 16
        rows = passages._tiles(frequent, kept).collect()
    finally:
        passages.TILE = real
    met = [(r.doc, p) for r in rows for p in r.partners]
    want = {(a, b) for g in groups for a in g for b in g if a < b}
    assert len(met) == len(want) and set(met) == want
    for r in rows:  # a text is sent only where it is compared
        assert r.partners or any(r.doc in o.partners for o in rows if (o.key, o.i, o.j) == (r.key, r.i, r.j))


def test_no_signatures_for_documents_that_share_half(make):
    """Documents that share a long line, but too little in all, leave before signatures are made of them."""
    from scoreloom.llm import jaccard
    rnd = random.Random(10)
    line = [f"l{i}" for i in range(40)]
    rows = [(i, " ".join(line + [f"{rnd.randrange(10**9)}" for _ in range(35)])) for i in range(60)]
    rows += [(100 + i, " ".join(line + [f"m{j}" for j in range(35)] + [f"e{i}"])) for i in range(3)]
    rows_of = {}
    real = jaccard.cut

    def counted(df, name):
        out = real(df, name)
        rows_of[name] = out.count()
        return out
    jaccard.cut = counted
    try:
        got = jaccard.jaccard_components(make(rows).repartition(3)).collect()
    finally:
        jaccard.cut = real
    assert {r.doc_id: r.component_id for r in got} == {i: w[1] for i, w in brute_components(rows, 5, 4, 5).items()}
    assert rows_of["signed"] == 3
