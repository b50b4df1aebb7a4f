"""Harmonic packing of token ids into sequences.

A document's whole sequences come first; what is left of it, n ids, is of the class of the reciprocal capacity that it
fits: class k holds rests from capacity / (k + 1) to capacity / k ids, and each of its bins takes exactly k of them, whole.
What a filled bin leaves is taken by the next rests that fit into it, the tightest bin first; only when more than WAITING
bins wait is a rest cut, to fill those with most room to the last id. Every worker fills its own bins, holding only those
that are open or wait. Their rests are left at the end; a pool of WORKERS_PER_POOL workers lays them end to end and
cuts them, so that one sequence in each pool is not full.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, pick, through_arrow, vocabulary

CAPACITY = 1024
END_ID = 0
WORKERS_PER_POOL = 64
WAITING = 32

#: How byte-level BPE splits text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space of more characters than this goes to tokenizers: the other library's stack ends at about a million.
LONG_SPACE = 50_000

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bins:
    """The open and waiting bins of a worker. A piece is (doc_id, start, ids in bytes, doc_tokens)."""

    def __init__(self, capacity: int, waiting: int = WAITING):
        self.capacity, self.most = capacity, waiting
        self.open: dict[int, list[tuple]] = {}
        self.gaps: list[int] = []  # sorted, with the bins that have them
        self.bins: list[list[tuple]] = []

    def _wait(self, gap: int, bin_: list[tuple]) -> None:
        at = bisect_left(self.gaps, gap)
        self.gaps.insert(at, gap)
        self.bins.insert(at, bin_)

    def add(self, doc_id, start: int, ids: bytes, total: int) -> Iterator[list[tuple]]:
        """Places the rest of a document that begins at start; gives the bins that this fills."""
        while len(self.gaps) > self.most and ids:
            gap, bin_ = self.gaps.pop(), self.bins.pop()
            n = min(gap, len(ids) // 4)
            bin_.append((doc_id, start, ids[: 4 * n], total))
            start, ids = start + n, ids[4 * n :]
            if n == gap:
                yield bin_
            else:
                self._wait(gap - n, bin_)
        n = len(ids) // 4
        if not n:
            return
        piece = (doc_id, start, ids, total)
        at = bisect_left(self.gaps, n)
        if at < len(self.gaps):
            gap, bin_ = self.gaps.pop(at) - n, self.bins.pop(at)
            bin_.append(piece)
        else:
            k = self.capacity // n
            bin_ = self.open.setdefault(k, [])
            bin_.append(piece)
            if len(bin_) < k:
                return
            del self.open[k]
            gap = self.capacity - sum(len(p[2]) for p in bin_) // 4
        if gap:
            self._wait(gap, bin_)
        else:
            yield bin_

    def left(self) -> list[tuple]:
        return [p for bin_ in [*self.open.values(), *self.bins] for p in bin_]


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, by the vocabulary in a tokenizers JSON file.

    The merges are run by tiktoken, four times as fast as the library that wrote the file and with the same ids. That
    library (tokenizers) itself encodes the few texts that hold an added token, as the file says how those are cut out,
    or very long white space.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", [])}
        byte_of = self._bytes()
        vocab = {bytes(byte_of[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self._exact = Tokenizer.from_file(path)
        self._added = re.compile("|".join(map(re.escape, special))) if special else None
        self._bpe = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={})

    @staticmethod
    def _bytes() -> dict[str, int]:
        """Byte-level BPE writes the printable bytes as themselves and the others as characters from U+0100 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def _hard(self, text: str) -> bool:
        if self._added and self._added.search(text):
            return True
        return len(text) > LONG_SPACE and any(m.end() - m.start() > LONG_SPACE for m in re.finditer(r"\s+", text))

    def __call__(self, text: str) -> bytes:
        if self._hard(text):
            return array("I", self._exact.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self._bpe.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _fill(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n.split()[0], pa.int64()) for n in _PIECE.split(", ")] + [("pool", pa.int32()), ("ids", pa.binary())])
    encode, bins = encoder(path), Bins(capacity)
    worker = TaskContext.get().partitionId()
    sequence = worker << 33
    end = np.array([END_ID], "<u4").tobytes()
    out: list[tuple] = []

    def full(bin_: list[tuple]) -> None:
        nonlocal sequence
        offset = 0
        for doc_id, start, ids, total in bin_:
            out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, None, None))
            offset += len(ids) // 4
        sequence += 1

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = encode(text or "") + end
            total = len(ids) // 4
            whole = total - total % capacity
            for start in range(0, whole, capacity):
                full([(doc_id, start, ids[4 * start : 4 * (start + capacity)], total)])
            for bin_ in bins.add(doc_id, whole, ids[4 * whole :], total):
                full(bin_)
            if len(out) > 20_000:
                yield _table(out, schema)
                out.clear()
    out += [(doc_id, start, len(ids) // 4, zlib.crc32(ids), total, None, None, worker // WORKERS_PER_POOL, ids) for doc_id, start, ids, total in bins.left()]
    if out:
        yield _table(out, schema)


def _lay_out(table: pa.Table, capacity: int) -> pa.Table:
    """The rest of a pool, end to end and cut at the capacity."""
    schema = pa.schema([(n.split()[0], pa.int64()) for n in _PIECE.split(", ")])
    rows = table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pool", "ids"]).to_pylist()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["start"], r["doc_tokens"], r["ids_crc32"]))
    sequence, offset, out = (1 << 62) + (rows[0]["pool"] << 33), 0, []
    for r in rows:
        at = 0
        while at < r["length"]:
            n = min(r["length"] - at, capacity - offset)
            out.append((r["doc_id"], r["start"] + at, n, zlib.crc32(r["ids"][4 * at : 4 * (at + n)]), r["doc_tokens"], sequence, offset))
            at, offset = at + n, offset + n
            if offset == capacity:
                sequence, offset = sequence + 1, 0
    return pa.Table.from_batches([_table(out, schema)])


def harmonic_pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Repeated rows are packed each on their own, null ids too. An empty table
    gives an empty one. Other columns are ignored. path: a tokenizers JSON file of a byte-level BPE that all machines have.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    pieces = cut(through_arrow(rows, lambda batches: _fill(batches, path, capacity), f"{_PIECE}, pool int, ids binary"))
    rest = pieces.where("pool IS NOT NULL").groupBy("pool").applyInArrow(lambda t: _lay_out(t, capacity), _PIECE)
    return pieces.where("pool IS NULL").drop("pool", "ids").unionByName(rest)
