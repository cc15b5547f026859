"""Token ids packed into rows of equal width: best-fit-decreasing with a segment tree over free capacities.

A document's ids are those of a public byte-level vocabulary, closed by an end id, so the ids of every document, an empty
one too, are never none and its text is regained exactly. A document longer than a row is split: full rows and a rest.
Rests of a block of documents are placed longest first, each into the row with the least free space that still holds it;
a segment tree over the capacities 0..width finds that space in log(width) steps. Blocks are runs of rows within a
partition and hold at most ``BLOCK_IDS`` ids, so packing needs no shuffle, and the memory of a task is bounded.

Each packed row has the id matrix row (little-endian, ``width`` ids, the rest of the row filled with the end id), the
cumulative lengths of its segments, the offsets where positions start again at 0, and per segment its document, the
piece's number and offset in the document.

Null text counts as empty (the end id alone). Repeated rows are packed as often as they occur. A null doc_id stays null.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from scoreloom.llm.common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's pattern for splitting a text before the byte pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
WIDTH = 2048
BLOCK_IDS = 4_000_000
SCHEMA = ("ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, pieces array<int>, "
          "starts array<bigint>")


class Encoder:
    """Ids of a text as little-endian 16-bit bytes. Texts are encoded whole; nothing is remembered between them."""

    def __init__(self, path: str = VOCABULARY):
        if sys.byteorder != "little":
            raise RuntimeError("packed ids are written in the machine's byte order, which has to be little-endian")
        lines = Path(path).read_bytes().splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        self.bpe = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __len__(self) -> int:
        """Chunks remembered between texts: none, so a worker's memory does not grow with the distinct words it meets."""
        return 0

    def encode(self, text: str | None) -> bytes:
        return array("H", self.bpe.encode_ordinary(text)).tobytes() if text else b""

    def decode(self, ids: bytes) -> str:
        return self.bpe.decode(np.frombuffer(ids, "<u2").tolist())


class Capacities:
    """Segment tree over free capacities: how many open rows have each, and the least that is at least a size."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int = 1) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += n
            i >>= 1

    def least(self, size: int) -> int | None:
        i = self.leaves + size
        if self.count[i]:
            return size
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(sizes: list[int], width: int) -> list[list[int]]:
    """Rows of item numbers; every size is between 1 and ``width``. Ties keep the order given."""
    rows: list[list[int]] = []
    free = Capacities(width)
    open_rows: list[list[int]] = [[] for _ in range(width + 1)]
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        space = free.least(size)
        if space is None:
            row, space = len(rows), width
            rows.append([])
        else:
            row = open_rows[space].pop()
            free.add(space, -1)
        rows[row].append(item)
        if space > size:
            open_rows[space - size].append(row)
            free.add(space - size)
    return rows


def _pack(block: list[tuple], width: int, end: int) -> Iterator[tuple]:
    """Packed rows of (doc_id, ids) pairs."""
    pieces, sizes = [], []
    for doc, ids in block:
        n = len(ids) // 2
        for piece, start in enumerate(range(0, n, width)):
            pieces.append((doc, piece, start, ids[2 * start:2 * (start + width)]))
            sizes.append(min(width, n - start))
    blank = np.array([end], "<u2").tobytes()
    for row in best_fit_decreasing(sizes, width):
        lengths = np.cumsum([0, *(sizes[i] for i in row)]).tolist()
        data = b"".join(pieces[i][3] for i in row)
        yield (data + blank * (width - lengths[-1]), lengths, lengths[:-1], *([pieces[i][j] for i in row] for j in range(3)))


def _rows(batches: Iterator[pa.RecordBatch], width: int, vocabulary: str, block_ids: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(vocabulary)
    closing = np.array([END], "<u2").tobytes()
    names = ["ids", "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts"]
    kinds = [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def emit(block):
        rows = list(_pack(block, width, END))
        for i in range(0, len(rows), 500):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i:i + 500]), kinds)], names)

    block, held = [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = encoder.encode(text.as_py()) + closing
            block.append((doc, ids))
            held += len(ids) // 2
            if held >= block_ids:
                yield from emit(block)
                block, held = [], 0
    if block:
        yield from emit(block)


def pack_documents(docs: DataFrame, width: int = WIDTH, vocabulary: str = VOCABULARY, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Packed rows of all documents (columns: see ``SCHEMA``)."""
    return small_batches(docs).select("doc_id", "text").mapInArrow(lambda batches: _rows(batches, width, vocabulary, block_ids), SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrices as Parquet: ``ids`` of successive rows concatenate to a (rows, width) matrix of 16-bit ids."""
    packed.write.mode("errorifexists").parquet(path)


def position_ids(cu_seqlens: list[int], width: int = WIDTH) -> np.ndarray:
    """Position of each id within its segment; the filling counts on from 0 as well."""
    ends = np.array([*cu_seqlens, width])
    starts = ends[:-1]
    return np.arange(width) - np.repeat(starts, np.diff(ends))
