"""Toxicity scores: bags of subword embeddings averaged per passage into a linear softmax, trained jointly in NumPy.

A word's vector is the mean of the vectors of its character 3- to 5-grams (with word ends marked) and of the word
itself, all hashed into one table, so a misspelling never seen shares most of its vector with the word it distorts. A
passage is ``PASSAGE`` successive words; its class comes from a softmax over a linear layer on the mean of its words'
vectors. The document's score is the highest probability among its passages, so one insult in a long text is not
averaged away. Training starts from all passages of a document under its label and then follows the passage that
decides. Vectors, layer and bias learn together (Adagrad with decay).

Fitted on a bounded sample: per class at most ``Fit.per_class`` labelled documents (times ``Fit.negatives`` for class 0)
of at most ``Fit.max_chars`` characters, the first in the order of a hash of their ids. Scoring reads every whole text.

Null and empty texts are a passage without words: the bias alone decides. Labels that are null are not used; if labels
of one document differ, the highest counts; labels of documents that are absent are ignored. Without any sample the
score is 0.5 less a little, so that nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import ROLLING, mix, small_batches

PASSAGE = 4
REMEMBERED = 48  # characters
EDGES = " \t\r\n.,;:!?\"'()[]{}<>*#%&$-_/"


@dataclass(frozen=True)
class Fit:
    per_class: int = 1500
    negatives: int = 2
    max_chars: int = 12_000
    buckets: int = 1 << 16
    dim: int = 8
    steps: int = 150
    warm_up: int = 40
    rate: float = 0.5
    decay: float = 2e-5
    seed: int = 11


@dataclass
class Model:
    table: np.ndarray  # (buckets, dim)
    layer: np.ndarray  # (2, dim)
    bias: np.ndarray  # (2,)


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character 3- to 5-grams and of the whole of each word (with its ends marked); the word of each."""
    marked = [f"<{w}>" for w in words]
    end = np.cumsum([len(m) for m in marked])
    start = np.concatenate([[0], end[:-1]])
    prefix = ROLLING.prefix_of(mix(np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)))
    word_at = np.repeat(np.arange(len(words)), end - start)
    at = np.arange(len(word_at))
    hashes, owner = [ROLLING.stretches(prefix, start, end)], [np.arange(len(words))]
    for n in (3, 4, 5):
        inside = np.flatnonzero(at + n <= end[word_at])
        hashes.append(ROLLING.stretches(prefix, inside, inside + n))
        owner.append(word_at[inside])
    return (np.concatenate(hashes) % np.uint64(buckets)).astype(np.int64), np.concatenate(owner)


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


#: Entries of an array that a training step looks at together; its temporaries have this length.
CHUNK = 1 << 19


@dataclass
class Encoded:
    """Labelled texts as word numbers (32 bits each) and the subwords of the vocabulary."""

    words: np.ndarray
    lengths: np.ndarray
    labels: np.ndarray
    subs: np.ndarray
    sub_word: np.ndarray

    @classmethod
    def of(cls, samples: Iterable[tuple[str, int]], buckets: int) -> Encoded:
        """Texts are read one after the other and not kept; texts without words are left out."""
        vocab: dict[str, int] = {}
        words, lengths, labels = [], [], []
        for text, label in samples:
            ids = np.fromiter((vocab.setdefault(w.strip(EDGES), len(vocab)) for w in tokens(text)), np.int32)
            if len(ids):
                words.append(ids)
                lengths.append(len(ids))
                labels.append(label)
        subs, owners, names = [], [], iter(vocab)
        for at in range(0, len(vocab), 20_000):
            found, owner = subwords(list(islice(names, 20_000)), buckets)
            subs.append(found.astype(np.int32))
            owners.append((owner + at).astype(np.int32))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
        return cls(join(words), np.array(lengths, np.int64), np.array(labels, float), join(subs), join(owners))


def train(samples: Iterable[tuple[str, int]], fit: Fit = Fit()) -> Model:
    """Model of (text, 0/1) samples; the same samples give the same model."""
    rng = np.random.default_rng(fit.seed)
    table = rng.normal(0, 0.1, (fit.buckets, fit.dim))
    layer = rng.normal(0, 0.5, (2, fit.dim))
    bias = np.zeros(2)
    data = Encoded.of(samples, fit.buckets)
    y = data.labels
    if len(set(y.tolist())) < 2:
        return Model(table * 0, layer, np.array([0.01, 0.0]))
    sub_len = np.bincount(data.sub_word)
    per_doc = -(-data.lengths // PASSAGE)
    doc_of = np.repeat(np.arange(len(y)), per_doc)
    first = np.cumsum(per_doc) - per_doc
    inside = np.arange(len(doc_of)) - first[doc_of]
    start = (np.cumsum(data.lengths) - data.lengths)[doc_of] + inside * PASSAGE
    size = np.minimum(PASSAGE, data.lengths[doc_of] - inside * PASSAGE)
    passages = list(_chunks(len(size), CHUNK // PASSAGE))
    parts = list(_chunks(len(data.subs), CHUNK))
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both classes weigh the same
    seen_t, seen_l, seen_b = np.full(table.shape, 1e-10), np.full(layer.shape, 1e-10), np.full(2, 1e-10)
    for step in range(fit.steps):
        # the layer is linear, so a word enters a passage as the scalar (layer[1] - layer[0]) . vector / length
        toward = layer[1] - layer[0]
        sub_value = table @ toward
        word_value = sum(np.bincount(data.sub_word[c], sub_value[data.subs[c]], len(sub_len)) for c in parts) / sub_len
        logit = np.empty(len(size))
        for c in passages:
            run = slice(start[c.start], start[c.stop - 1] + size[c.stop - 1])
            logit[c] = np.add.reduceat(word_value[data.words[run]], start[c] - run.start) / size[c]
        logit += bias[1] - bias[0]
        p = 1 / (1 + np.exp(-logit))
        weight = share[doc_of] / per_doc[doc_of]
        if step >= fit.warm_up:
            best = _first_best(logit, first, doc_of)
            weight = np.where(y[doc_of] == 1, 0.0, 0.5 * weight)
            weight[best] += np.where(y == 1, share, 0.5 * share)
        g = weight * (p - y[doc_of])
        g_word = np.zeros(len(sub_len))
        for c in passages:
            run = slice(start[c.start], start[c.stop - 1] + size[c.stop - 1])
            g_word += np.bincount(data.words[run], np.repeat(g[c] / size[c], size[c]), len(sub_len))
        g_word /= sub_len
        g_sub = sum(np.bincount(data.subs[c], g_word[data.sub_word[c]], fit.buckets) for c in parts)
        g_layer = g_sub @ table
        g_table = np.outer(g_sub, toward) + fit.decay * table
        for value, grad, seen in ((table, g_table, seen_t), (layer, np.array([-g_layer, g_layer]), seen_l), (bias, np.array([-g.sum(), g.sum()]), seen_b)):
            seen += grad * grad
            value -= fit.rate * 0.2 * grad / np.sqrt(seen)
    return Model(table.astype(np.float32), layer, bias)


def _chunks(total: int, size: int) -> Iterator[slice]:
    return (slice(a, min(total, a + size)) for a in range(0, total, size))


def _first_best(logit: np.ndarray, first: np.ndarray, doc_of: np.ndarray) -> np.ndarray:
    """Index of the first passage with the highest logit of each document."""
    top = np.flatnonzero(logit == np.maximum.reduceat(logit, first)[doc_of])
    return top[np.concatenate([[True], doc_of[top][1:] != doc_of[top][:-1]])]


class Scorer:
    """Scores texts; remembers the value of words it has met, within a bound: so many words, and none that is long."""

    def __init__(self, model: Model):
        self.values = (model.table @ (model.layer[1] - model.layer[0])).astype(float)
        self.bias = float(model.bias[1] - model.bias[0])
        self.known: dict[str, float] = {}

    def _learn(self, found: list[str]) -> None:
        if len(self.known) > 500_000:
            self.known.clear()
        new = list({t for t in found if t not in self.known})
        if new:
            ids, owner = subwords([t.strip(EDGES) for t in new], len(self.values))
            self.known.update(zip(new, (np.bincount(owner, self.values[ids]) / np.bincount(owner)).tolist()))
        self.long = [t for t in new if len(t) > REMEMBERED]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for at, found in _groups(texts):
            flat = [t for ws in found for t in ws]
            self._learn(flat)
            values = np.fromiter(map(self.known.__getitem__, flat), float, len(flat))
            for t in self.long:
                del self.known[t]
            lengths = np.array([len(ws) for ws in found])
            per_doc = -(-lengths // PASSAGE)
            first = np.cumsum(per_doc) - per_doc
            inside = np.arange(per_doc.sum()) - np.repeat(first, per_doc)
            size = np.minimum(PASSAGE, np.repeat(lengths, per_doc) - inside * PASSAGE)
            passages = np.add.reduceat(values, np.cumsum(size) - size) / size
            out[at] += np.maximum.reduceat(passages, first)
        return 1 / (1 + np.exp(-np.clip(out, -700, 700)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def _groups(texts: list[str | None], most: int = 200_000) -> Iterator[tuple[list[int], list[list[str]]]]:
    """The words of the texts that have any, in runs of about ``most`` words, with the texts' places."""
    at, found, held = [], [], 0
    for i, text in enumerate(texts):
        words = tokens(text)
        if words:
            at.append(i)
            found.append(words)
            held += len(words)
        if held >= most:
            yield at, found
            at, found, held = [], [], 0
    if at:
        yield at, found


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that is never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Train on a bounded sample of the labelled documents outside the held-out fold."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    known = known.where(F.col("toxic").isin(0, 1)).withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(fit.seed)))
    parts = []
    for label, most in ((0, fit.per_class * fit.negatives), (1, fit.per_class)):
        parts.append(known.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(most))
    ids = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("labelled_id"), "toxic", "h")
    rows = docs.select("doc_id", "text").where(F.char_length("text").between(1, fit.max_chars)).join(
        F.broadcast(ids), F.col("doc_id") == F.col("labelled_id"))
    # rows that repeat a doc_id count once
    one = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.first("h").alias("h"), F.min("text").alias("text"))
    sample = one.orderBy("h", "doc_id").select("text", "toxic").toArrow()  # columns, not a Python object for each text
    return train(((t.as_py(), y.as_py()) for batch in sample.to_batches() for t, y in zip(batch["text"], batch["toxic"])), fit)


def _score_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            scores = scorer.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])
    return run


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB, whatever the corpus
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_score_batches(shared), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in (batch.slice(at, 500) for batch in batches for at in range(0, batch.num_rows, 500)):
            yield part.filter(pa.array(scorer.scores(part.column("text").to_pylist()) < 0.5))

    return small_batches(docs).mapInArrow(run, docs.schema)
