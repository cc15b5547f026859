"""Secret scans with a trigram index: each rule's regular expression yields a Boolean trigram query, postings are
intersected, candidates verified by the expression.

The documents of a block (a run of rows within a partition) form an index segment: postings of every trigram that some
rule's query mentions, as a document list for each. A query is a tree of "all of" and "any of"; its answer is a superset
of the documents that can match, and only these meet the regular expression. A rule whose expression forces no trigram
is run over every document. Trigrams are taken from the UTF-8 bytes with A-Z in lower case.

Offsets count code points, ends are exclusive. Null text counts as empty; each row gets a result, repeated rows alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame

BLOCK_BYTES = 4 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", least=18),
    Rule("hex", r"[0-9a-f]{16,}", least=16),  # the same matches as of [0-9a-f]+ with 16 characters or more
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

#: A query: a trigram, ("all", queries) or ("any", queries); ("all", ()) holds for every document.
EVERY = ("all", ())
_MOST = 64  # strings that an expression may stand for before it is summed up as a query


def trigram_query(pattern: str, any_case: bool = False):
    """Boolean trigram query that every text with a match of ``pattern`` answers."""
    exact, need = _runs(parser.parse(pattern, re.ASCII | (re.IGNORECASE if any_case else 0)))
    return _all([need, _strings(exact)])


def _node(op, arg) -> tuple[set[str] | None, tuple]:
    if op is sre.LITERAL:
        return {chr(arg)}, EVERY
    if op is sre.IN:
        letters = _letters(arg)
        return (letters, EVERY) if letters else (None, EVERY)
    if op is sre.SUBPATTERN:
        return _runs(arg[-1])
    if op is sre.BRANCH:
        parts = [_runs(p) for p in arg[1]]
        if all(exact is not None for exact, _ in parts):
            return set().union(*(exact for exact, _ in parts)), EVERY
        return None, _any([_all([need, _strings(exact)]) for exact, need in parts])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, body = arg
        exact, need = _runs(body)
        if low == 0:
            return (exact | {""}, EVERY) if high == 1 and exact is not None else (None, EVERY)
        return None, _all([need, _strings(exact)])
    return None, EVERY  # any character, anchors: nothing is forced


def _letters(members) -> set[str]:
    """The characters of a small class; empty for a large or negated one."""
    out: set[str] = set()
    for op, arg in members:
        if op is sre.LITERAL:
            out.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return set()
    return out if len(out) <= 8 else set()


def _runs(tree) -> tuple[set[str] | None, tuple]:
    """(the strings that the whole can be, or None if they are not known; what is needed besides)."""
    exact, need, held = {""}, EVERY, []
    for op, arg in tree:
        one, more = _node(op, arg)
        need = _all([need, more])
        if one is None or len(exact) * len(one) > _MOST:
            held.append(exact)
            exact = one if one is not None else {""}
            if one is None:
                held.append(None)
            continue
        exact = {a + b for a in exact for b in one}
    if not held:
        return exact, need
    return None, _all([need, *(_strings(h) for h in held), _strings(exact)])


def _strings(exact: set[str] | None) -> tuple:
    """Query for: one of these strings occurs."""
    if not exact:
        return EVERY
    parts = []
    for s in exact:
        raw = s.encode().lower()
        grams = sorted({int.from_bytes(raw[i:i + 3], "little") for i in range(len(raw) - 2)})
        parts.append(_all(grams))
    return _any(parts)


def _all(parts) -> tuple | int:
    kept = [p for p in parts if p != EVERY]
    return kept[0] if len(kept) == 1 else ("all", tuple(kept))


def _any(parts) -> tuple | int:
    return EVERY if not parts or EVERY in parts else parts[0] if len(parts) == 1 else ("any", tuple(parts))


def _grams(query) -> set[int]:
    return {query} if isinstance(query, int) else set().union(*(_grams(q) for q in query[1]))


class Index:
    """Postings of chosen trigrams over one block of documents."""

    def __init__(self, raws: list[bytes], wanted: np.ndarray):
        self.every = np.arange(len(raws))
        self.postings: dict[int, np.ndarray] = {}
        data = np.frombuffer(b"\0\0".join(raws) + b"\0\0", np.uint8)  # no wanted trigram spans two documents
        codes = data[:-2].astype(np.uint32)
        codes |= data[1:-1].astype(np.uint32) << np.uint32(8)
        codes |= data[2:].astype(np.uint32) << np.uint32(16)
        at = np.flatnonzero(wanted[codes])
        starts = np.cumsum([0, *(len(r) + 2 for r in raws)])[:-1]
        doc = np.searchsorted(starts, at, "right") - 1
        pairs = np.unique(codes[at].astype(np.int64) << 32 | doc)
        grams, first = np.unique(pairs >> 32, return_index=True)
        for gram, docs in zip(grams.tolist(), np.split(pairs & 0xFFFFFFFF, first[1:])):
            self.postings[gram] = docs

    def find(self, query) -> np.ndarray:
        """Numbers of the documents that answer a query, ascending."""
        if isinstance(query, int):
            return self.postings.get(query, self.every[:0])
        kind, parts = query
        found = [self.find(q) for q in parts]
        if kind == "any":
            return np.unique(np.concatenate(found))
        out = self.every
        for f in sorted(found, key=len):
            out = np.intersect1d(out, f, assume_unique=True)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r.pattern, r.any_case)) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        for *_, query in self.rules:
            self.wanted[list(_grams(query))] = True

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, number of the rule, end) of each text, sorted."""
        index = Index([t.encode().lower() for t in texts], self.wanted)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, pattern, query) in enumerate(self.rules):
            for i in index.find(query).tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), number, m.end()))
        for found in out:
            found.sort()
        return out


def _scan(batches: Iterator[pa.RecordBatch], rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]
    for batch in batches:
        for block in _blocks(batch):
            texts = [t or "" for t in block.column("text").to_pylist()]
            rows = []
            for found in scanner.spans(texts):
                counts = [sum(n == i for _, n, _ in found) for i in range(len(BASE))]
                base = ",".join(f"{kinds[n]}:{a}:{b}" for a, n, b in found if n < len(BASE))
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{kinds[n]}:{a}:{b}" for a, n, b in found)))
            columns = [pa.array(c, pa.int64() if i < 3 else pa.string()) for i, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``BLOCK_BYTES`` of text; a longer text is a run of its own."""
    sizes = [s or 0 for s in pa.compute.binary_length(batch.column("text")).to_pylist()]
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > BLOCK_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def scan_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row; ``more`` rules add spans to the base ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _scan(batches, BASE + tuple(more)),
        f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
