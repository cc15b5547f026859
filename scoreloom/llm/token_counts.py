"""Token counts with a whole-token shortcut.

Of every string of the vocabulary that can stand for a whole pre-token it is proved once per worker, by merging it alone,
whether the result is one token: these are the whole tokens (``whole_tokens``). Pre-tokens among them count 1 without any
merging; only the others are merged. A vocabulary string need not be whole: its merges may be blocked by an earlier one.

Normalising and splitting are the library's own, so counts equal the library's; printable ASCII chunks, which have nothing
to normalise but case, are split by the vocabulary's pattern in Python after a check that both agree. Where the vocabulary drops white space
(``blanks_drop``), no pre-token, composition or special string reaches across a blank, so texts are counted blank-separated
chunk by chunk: chunks that are whole tokens as they stand count 1 at once, other chunks are split into pre-tokens, and
both are remembered within a bound of bytes. Other vocabularies are split text by text.

Special strings within a text count one token each, as the library handles them by default; no begin or end tokens are
added, nothing is cut or padded. Null text counts as empty: 0 bytes, 0 tokens. Repeated rows count alike, null ids stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
LIMIT = 2048
#: Longest chunk that is remembered, in characters, and how many are.
CHUNK, CHUNKS = 48, 250_000
_BLANKS = re.compile("[\x20\x09-\x0D]+")
_ODD = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the library
#: The vocabulary's splitting of a blank-free text as it reads for lower-case printable ASCII.
_ASCII = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """Strings (in the splitter's byte letters) that, merged alone, become one token."""
    model, suffix = tokenizer.model, tokenizer.model.end_of_word_suffix or ""
    texts = (t.removesuffix(suffix) for t in tokenizer.get_vocab(with_added_tokens=False) if t.endswith(suffix))
    return frozenset(t for t in texts if t and len(model.tokenize(t)) == 1)


class Pieces(dict):
    """Number of tokens by pre-token: whole tokens from the start, merged ones as they come up, within a bound."""

    def __init__(self, model, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.tokenize, self.whole = model.tokenize, len(whole)

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenize(piece))
        if len(piece) <= CHUNK:
            remember(self, self.whole, piece, n)
        return n


def remember(known: dict, fixed: int, key: str, n: int) -> None:
    """Keep ``key``; all but the first ``fixed`` entries go when there are too many."""
    if len(known) > fixed + CHUNKS:
        for old in list(known)[fixed:]:
            del known[old]
    known[key] = n


class Counter(dict):
    """Number of tokens by chunk, filled as chunks come up."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer, self.splitter = (getattr(self.tokenizer, k) for k in ("model", "normalizer", "pre_tokenizer"))
        self.whole = whole_tokens(self.tokenizer)
        self.pieces = Pieces(self.model, self.whole)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added):
            raise ValueError("added tokens that are not plain strings of the raw text are not supported")
        strings = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.blanks_drop = self.split("a b") == self.split("a") + self.split("b") and self.split(" \n\t ") == []
        printable = "".join(map(chr, range(33, 127)))
        self.ascii = self.blanks_drop and all(self.split(t) == _ASCII.findall(t.lower()) for t in (
            printable, printable[::-1], "i've'd'll's't're'm'1'S", *(f"a{c}1{c}{c}" for c in printable)))
        #: letters that the library leaves as they are count as chunks, too
        ready = (t for t in self.whole if t.isascii() and t.isalpha() and t == t.lower())
        super().__init__(dict.fromkeys(ready, 1) if self.ascii else {})
        self.ready = len(self)

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text in the splitter's byte letters."""
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return [piece for piece, _ in self.splitter.pre_tokenize_str(text)]

    def _merged(self, text: str) -> int:
        ready = self.ascii and text.isascii() and text.isprintable() and " " not in text
        return sum(map(self.pieces.__getitem__, _ASCII.findall(text.lower()) if ready else self.split(text)))

    def measure(self, text: str) -> int:
        """Tokens of a text by pre-tokens; special strings are taken out of the raw text first."""
        if self.special is None or not self.special.search(text):
            return self._merged(text) if text else 0
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._merged(p) for p in parts if p)

    def __missing__(self, chunk: str) -> int:
        n = self.measure(chunk)
        if len(chunk) <= CHUNK:
            remember(self, self.ready, chunk, n)
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.blanks_drop:
            return self.measure(text)
        chunks = text.split() if text.isascii() and not _ODD.search(text) else filter(None, _BLANKS.split(text))
        return sum(map(self.__getitem__, chunks))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for all tasks of a worker process."""
    return Counter(path)


def _count(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    known = counter(path)
    for batch in batches:
        text = batch.column("text")
        n = np.fromiter((known.count(t.as_py()) for t in text), np.int64, len(text))
        size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)],
                                         ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row; ``vocabulary`` is a file that every executor can read."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _count(batches, vocabulary, limit), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
