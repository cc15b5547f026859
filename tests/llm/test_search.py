"""Token counts, hard negatives and lexical search against the library, SQL and plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoreloom.llm.best import Best, spans
from scoreloom.llm.lexical import n_terms, plain, rank_documents
from scoreloom.llm.negatives import Residues, hard_negatives, integer_vectors
from scoreloom.llm.queries import ORACLE_SQL, QUERIES
from scoreloom.llm.token_counts import VOCABULARY, count_tokens, counter, whole_tokens
from tests.harness import compare, connect

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_lexical_search"])
def test_sql_twin(spark, name):
    for sf in ("/root/testdata/sf0.001", SF):
        assert compare(QUERIES[name](spark, sf), connect(sf).sql(ORACLE_SQL[name])) is None


# best rows

def test_best_matches_sort():
    rnd = random.Random(3)
    best = Best(4, 3)
    offered = []
    for _ in range(30):
        new = [(rnd.randrange(4), rnd.randrange(6), rnd.randrange(50)) for _ in range(rnd.randrange(12))]
        offered += new
        best.offer(*(np.array([r[i] for r in new], np.int64) for i in range(3)))
    want = [r for o in range(4) for r in sorted((r for r in offered if r[0] == o), key=lambda r: (-r[1], r[2]))[:3]]
    assert list(zip(best.owner.tolist(), best.score.tolist(), best.id.tolist())) == want
    assert best.floor.tolist() == [want[3 * o + 2][1] for o in range(4)]
    assert [b - a for a, b in spans(1000, 300)] == [64, 128, 256, 300, 252] and list(spans(0, 5)) == []


# token counts

def library(texts, path=VOCABULARY):
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_token_counts_equal_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op11_token_counts"](spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(found) == docs.count() and found.keys() == texts.keys()
    for (doc, text), n in zip(texts.items(), library(list(texts.values()))):
        assert (found[doc].n_tokens, found[doc].n_bytes, found[doc].over_limit) == (n, len(text.encode()), n > 2048)


@pytest.mark.parametrize("path", [VOCABULARY, "/opt/tokenizers/byte_bpe_50k.json"])
def test_token_counts_of_odd_strings(path):
    rnd = random.Random(5)
    letters = ["a", "Bc", " ", "  ", "\n", "\t", "é", "é", "́", " ", "'s", "'S", "!", "12", "漢", " ", "🎉", "<|startoftext|>",
               "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "\x1c", "\x1f", "\x85", "İ", "Σ", "ß", "‍", "ſ", "K", "ͅ", "the", "<", "\x00",
               "᠎", "﻿", "'", "~", "\x7f", "don't"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(12))) for _ in range(20_000)]
    assert [counter(path).count(t) for t in texts] == library(texts, path)


def test_whole_tokens_are_those_that_encode_alone_as_one():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    whole = whole_tokens(tokenizer)
    ascii_letters = [t.removesuffix("</w>") for t in tokenizer.get_vocab() if re.fullmatch("[a-z]+</w>", t)]
    alone = {t for t in ascii_letters if len(tokenizer.encode(t, add_special_tokens=False).ids) == 1}
    assert alone == {t for t in ascii_letters if t in whole} and len(alone) > 20_000


def test_token_counts_keep_memory_bounded(monkeypatch):
    monkeypatch.setattr("scoreloom.llm.token_counts.CHUNKS", 10)
    known = counter(VOCABULARY)
    texts = [" ".join(f"zq{i}xv{j}" for j in range(5)) + "q" * 1000 for i in range(40)]
    assert [known.count(t) for t in texts] == library(texts)
    assert len(known) <= known.ready + 12 and len(known.pieces) <= len(known.whole) + 12


def test_token_counts_edge_cases(odd, none):
    found = sorted(count_tokens(odd, limit=3).collect(), key=repr)
    assert len(found) == 12 and [r.n_tokens for r in found if r.doc_id in (2, 3, 6)] == [0, 0, 0]
    assert [r.n_tokens for r in found if r.doc_id == 1] == [8, 8] and sum(r.doc_id is None for r in found) == 2
    assert {r.doc_id: r.over_limit for r in found}[7] is False and {r.doc_id: r.over_limit for r in found}[9] is True
    assert count_tokens(none).count() == 0


# hard negatives

def test_residue_products_are_exact():
    rng = np.random.default_rng(0)
    for width, big in ((64, 256), (1, 3), (1500, 300), (7, 2**27), (200, 2**25), (3, 1)):
        x, y = rng.integers(-big, big + 1, (20, width)), rng.integers(-big, big + 1, (30, width))
        x[0], y[0], y[1] = big, -big, big
        res = Residues.for_bound(width * big * big)
        assert math.prod(res.primes) > 4 * width * big * big
        got = res.product(res.of(x), res.of(y))
        assert got.tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in y] for p in x]


VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_negatives(data, every=2):
    good = []
    for vec, values, label in data:
        if label is None or values is None or any(v is None or not math.isfinite(v) for v in values):
            continue
        good.append((vec, [math.floor(256 * v) for v in values], (label + 1) % 10 if vec is not None and vec % 7 == 0 else label))
    out = []
    key = lambda r: (-r[0], r[1] is None, r[1] or 0)
    for a, av, al in good:
        if a is None or a % every:
            continue
        near = [(sum(x * y for x, y in zip(av, bv)), b, bl) for b, bv, bl in good if b != a]
        for ps, p, _ in sorted((r for r in near if r[2] == al), key=key)[:5]:
            window = sorted((r for r in near if r[2] != al and 50 * ps <= 100 * r[0] <= 95 * ps), key=key)
            out += [(a, p, i + 1, n, ps, ns) for i, (ns, n, _) in enumerate(window[:3])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [4096, 3])
def test_negatives_match_brute_force(spark, block):
    rnd = random.Random(7)
    data = [(i, [rnd.choice([-1.0, -0.25, 0.1, 0.5, 1.0, 2.0]) for _ in range(4)], rnd.randrange(4)) for i in range(60)]
    data += [(60 + i, data[5][1], rnd.randrange(4)) for i in range(30)]  # ties
    data += [(101, None, 1), (102, [1.0, None, 0.0, 0.0], 1), (103, [float("nan")] * 4, 1), (104, [float("inf")] * 4, 1), (106, [1.0] * 4, None),
             (None, [1.0] * 4, 2), (None, None, None), (108, [], 1), (110, [1.0], 2), (112, [1.5, 1.0, 0.5, 0.0, 2.0], 2)]
    table = spark.createDataFrame(data, VECTORS).withColumns({c: F.lit(1) for c in ("score", "owner", "id", "v", "n", "place")})
    got = hard_negatives(table, every=2, block_rows=block)
    assert rows(got) == brute_negatives(data) and got.columns[:3] == ["anchor_id", "positive_id", "rank"]


def test_negatives_edge_cases(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives(empty).count() == 0
    assert hard_negatives(spark.createDataFrame([(50, [1.0], 1)], VECTORS)).count() == 0  # no partner
    assert hard_negatives(spark.createDataFrame([(51, [1.0], 1), (50, None, 1)], VECTORS)).count() == 0  # no anchor
    big = spark.createDataFrame([(1, [3e30, 1.0], 1), (2, [1e5, 1.0], 1)], VECTORS)
    assert [r.vec_id for r in integer_vectors(big).collect()] == [2]
    # repeated anchors are each answered, rows of one id are not partners
    twice = spark.createDataFrame([(50, [1.0], 1)] * 2 + [(51, [1.0], 1), (52, [0.75], 2)], VECTORS)
    assert rows(hard_negatives(twice)) == [(50, 51, 1, 52, 65536, 49152)] * 2


# lexical search

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def brute_ranking(docs, items, k):
    counts = [(doc, Counter(words(text))) for doc, text in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            if c:
                m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in words(text) if c[t])
                if s > 0:
                    scored.append((s, doc))
        scored.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, i + 1, doc, s) for i, (s, doc) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("blocks", [{}, {"block_items": 2}])
def test_ranking_matches_brute_force(spark, make, blocks):
    rnd = random.Random(11)
    vocabulary = ["a", "Ab", "É", "ß", "漢字", "x1", "9", "zz", "K", "K", "foo", "bar", "foobar", "fo"]
    gaps = [" ", "-", "  ", "\x00", "_", "\x7f", "\n", "."]
    text = lambda n: "".join(rnd.choice(vocabulary) + rnd.choice(gaps) for _ in range(n))
    docs = [(i, text(rnd.randrange(30))) for i in range(80)]
    docs += [(200 + i, docs[3][1]) for i in range(40)] + [(3, docs[3][1]), (None, docs[3][1]), (300, None), (301, ""), (302, " - "), (303, "foo " * 5000)]
    items = [(i, text(rnd.randrange(1, 12))) for i in range(7)] + [(7, None), (8, ""), (9, "unseen"), (0, "foo foo a"), (None, "foo bar")]
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumns({c: F.lit(1) for c in ("n", "term", "score")})
    clash = make(docs).withColumns({c: F.lit(1) for c in ("score", "item", "rank", "term", "item_id")})
    assert rows(rank_documents(clash, table, k=5, **blocks)) == brute_ranking(docs, items, 5)


def test_ranking_edge_cases(odd, none, spark):
    items = spark.createDataFrame([(1, "one a"), (2, None)], "item_id int, text string")
    assert {r.doc_id for r in rank_documents(odd, items).collect()} == {1, 5, 7}
    assert rank_documents(none, items).count() == 0 and rank_documents(odd, items.where("item_id > 5")).count() == 0
    assert rank_documents(odd, items.where("item_id = 2")).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_bytes():
    for text in ("", "A-b", "É É", "\x7fa\x80b", "x", " x "):
        data = plain(text.encode())
        assert [w.decode() for w in data.split()] == words(text) and n_terms(data) == len(words(text))
