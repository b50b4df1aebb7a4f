"""Vector codes by Lloyd's method on parts of vectors, with a heap of parts for each codebook entry.

A part keeps two bounds on distances: upper (its own entry) and lower (the nearest other one). While lower - upper exceeds
what the entries have moved since, the part stays where it is. Each entry therefore has a heap of its parts, keyed by
lower - upper plus the drift that the entry had gathered when the part came in; in a round only the parts whose key the
entry's drift has reached are popped, and these are compared with all entries in whole numbers. Heaps belong to a block of
vectors and never leave it; the sums that the new entries need are corrected by the parts that change their entry.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, forget, pick, stored, through_arrow
from attesta.llm.topk import dense, whole_vectors

#: Numbers in a block of vectors, and what hot labels are spread over.
BLOCK, SALTS = 1 << 18, 32


def _limit(width: int) -> int:
    """The largest component for which a squared distance of parts stays within a long."""
    return math.isqrt((1 << 62) // max(1, width)) // 2


def _blocked(parts: int, width: int, per_block: int):
    """Rows (vec_id, label, x) become blocks: ids, labels, x (parts of whole numbers, as small as they can be written)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, per_block):
                rows = b.slice(at, per_block)
                x = dense(rows["x"], parts * width, _limit(width)).astype(np.int64)
                most = int(np.abs(x).max(initial=0))
                kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
                whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
                yield pa.RecordBatch.from_arrays([whole(rows["vec_id"]), whole(rows["label"]), pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary())], names=["ids", "labels", "kind", "x"])

    return run


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts to all entries, in whole numbers."""
    out = np.empty((len(x), len(entries)), dtype=np.int64)
    for e, c in enumerate(entries):
        d = x - c
        out[:, e] = np.einsum("ij,ij->i", d, d)
    return out


def _nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, the lower index on ties, and lower - upper: how much nearer it is than any other."""
    if not len(x):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    d = _distances(x, entries)
    own = d.argmin(axis=1)
    upper = np.sqrt(d[np.arange(len(x)), own].astype(float))
    d[np.arange(len(x)), own] = np.iinfo(np.int64).max
    lower = np.sqrt(d.min(axis=1).astype(float)) if len(entries) > 1 else np.full(len(x), np.inf)
    return own, lower - upper


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """parts x entries: by how much lower - upper can have shrunk for the parts of each entry in this round."""
    moved = np.sqrt(((after - before).astype(float) ** 2).sum(axis=2))
    out = moved.copy()
    for p, m in enumerate(moved):
        for e in range(len(m)):
            out[p, e] += max([*m[:e], *m[e + 1 :]], default=0.0)
    return out * (1 + 1e-9)


_STATE = "codes binary, heap binary, keys binary, sums array<bigint>, scanned bigint"


class _Block:
    """A block's heaps. For each part position p and entry e, heap[p] holds the rows of e in order of their keys, entry after
    entry: a run in order is a heap whose pops are its beginning."""

    def __init__(self, x: np.ndarray, entries: int, state: dict | None):
        self.x = x  # rows x parts x width
        n, parts, width = x.shape
        if state is None:  # no part has an entry yet
            self.codes = np.full((parts, n), entries, dtype=np.uint8)
            self.heap, self.keys = np.zeros((parts, 0), dtype=np.int32), np.zeros((parts, 0))
            self.sums = np.zeros((parts, entries, width + 1), dtype=np.int64)
        else:
            self.codes = np.frombuffer(state["codes"], dtype=np.uint8).reshape(parts, n).copy()
            self.heap = np.frombuffer(state["heap"], dtype=np.int32).reshape(parts, n)
            self.keys = np.frombuffer(state["keys"]).reshape(parts, n)
            self.sums = np.array(state["sums"], dtype=np.int64).reshape(parts, entries, width + 1)
        self.scanned = 0

    def round(self, codebooks: np.ndarray, drift: np.ndarray) -> None:
        """drift: parts x entries, gathered since the first round."""
        heaps, keys = [], []
        for p, entries in enumerate(codebooks):
            popped, left, left_keys = self._pop(p, len(entries), drift[p])
            own, slack = _nearest(self.x[popped, p], entries)
            self.scanned += len(popped)
            was = self.codes[p, popped]
            for change, at, sign in ((was != own, was, -1), (was != own, own, 1)):
                known = change & (at < len(entries))
                rows = self.x[popped[known], p]
                np.add.at(self.sums[p], at[known], sign * np.concatenate([rows, np.ones((len(rows), 1), dtype=np.int64)], axis=1))
            self.codes[p, popped] = own
            # Pushed: the runs of all entries are merged by entry and key.
            rows, k = np.concatenate([left, popped]), np.concatenate([left_keys, slack + drift[p, own]])
            order = np.lexsort((rows, k, self.codes[p, rows]))
            heaps.append(rows[order])
            keys.append(k[order])
        self.heap, self.keys = np.stack(heaps).astype(np.int32), np.stack(keys)

    def _pop(self, p: int, entries: int, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows whose bounds no longer hold, and the others with their keys."""
        if not self.heap.shape[1]:
            return np.arange(len(self.x)), np.zeros(0, dtype=np.int64), np.zeros(0)
        heap, keys = self.heap[p], self.keys[p]
        ends = np.searchsorted(self.codes[p, heap], np.arange(entries + 1))
        out = np.zeros(len(heap), dtype=bool)
        for e in range(entries):
            reached = drift[e] + 1e-9 * (1 + drift[e])  # doubles err by far less
            out[ends[e] : ends[e] + np.searchsorted(keys[ends[e] : ends[e + 1]], reached, side="right")] = True
        return heap[out].astype(np.int64), heap[~out].astype(np.int64), keys[~out]

    def record(self) -> list:
        return [self.codes.tobytes(), self.heap.tobytes(), self.keys.tobytes(), self.sums.ravel(), self.scanned]


def _numbers(kind: str, x: bytes, parts: int, width: int) -> np.ndarray:
    return np.frombuffer(x, dtype=kind).astype(np.int64).reshape(-1, parts, width)


def _round(codebooks: np.ndarray, drift: np.ndarray):
    """A round over blocks: what each holds, with its heaps after the round."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                state = {k: row[k][0].as_py() for k in ("codes", "heap", "keys", "sums")} if "codes" in row.schema.names else None
                block = _Block(_numbers(row["kind"][0].as_py(), row["x"][0].as_py(), parts, width), entries, state)
                block.round(codebooks, drift)
                codes, heap, keys, sums, scanned = block.record()
                own = [pa.array([codes], pa.binary()), pa.array([heap], pa.binary()), pa.array([keys], pa.binary()), pa.array([sums], pa.list_(pa.int64())), pa.array([scanned])]
                yield pa.RecordBatch.from_arrays([*(row[c] for c in ("ids", "labels", "kind", "x")), *own], names=["ids", "labels", "kind", "x", "codes", "heap", "keys", "sums", "scanned"])

    return run


def _coded(codebooks: np.ndarray):
    """Blocks to rows: vec_id, label, codes (a number for each part) and error against the last codebooks."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = _numbers(b["kind"][i].as_py(), b["x"][i].as_py(), parts, width)
                codes = np.frombuffer(b["codes"][i].as_py(), dtype=np.uint8).reshape(parts, -1)
                error = np.zeros(len(x), dtype=np.int64)
                for p in range(parts):
                    d = x[:, p] - codebooks[p][codes[p]]
                    error += np.einsum("ij,ij->i", d, d)
                text = np.ascontiguousarray(codes.T).tobytes().hex()
                yield pa.RecordBatch.from_arrays([b["ids"].slice(i, 1).flatten(), b["labels"].slice(i, 1).flatten(), pa.array([text[r * 2 * parts : (r + 1) * 2 * parts] for r in range(len(x))], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _means(before: np.ndarray, sums: DataFrame) -> np.ndarray:
    """New codebooks from the blocks' sums: parts * entries * (width + 1) numbers come to the driver."""
    parts, entries, width = before.shape
    s = np.zeros(parts * entries * (width + 1), dtype=object)
    for r in sums.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        s[r["i"]] = int(r["v"])
    s = s.reshape(parts, entries, width + 1)
    after = before.copy()
    for p in range(parts):
        for e in range(entries):
            if s[p, e, width]:
                after[p, e] = [int(v) // int(s[p, e, width]) for v in s[p, e, :width]]
    return after


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", per_block: int | None = None) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Codebooks of vectors, and their blocks after the last round; use encode() for rows.

    Returns (blocks, codebooks as parts x entries x width whole numbers, parts compared with all entries in each round).
    """
    if not 0 < entries < 256:
        raise ValueError("an index has to fit a byte")
    v = whole_vectors(pick(vectors, id_col, vector_col, label_col).toDF("vec_id", "v", "label"), scale, "vec_id", "v", "label")
    size = v.agg(F.max(F.size("x"))).first()[0] or 0
    width = max(1, math.ceil(size / parts))
    first = v.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").toArrow()["x"].combine_chunks()
    first = first.chunk(0) if isinstance(first, pa.ChunkedArray) else first
    codebooks = dense(first, parts * width, _limit(width)).astype(np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    kind = v.schema["label"].dataType.simpleString()
    held = f"ids array<bigint>, labels array<{kind}>, kind string, x binary"
    state = through_arrow(v, _blocked(parts, width, per_block or max(16, BLOCK // (parts * width))), held)
    drift, scanned = np.zeros(codebooks.shape[:2]), []
    if not len(first):
        return state.withColumns({"codes": F.lit(None).cast("binary")}), codebooks, scanned
    for r in range(rounds + 1):
        now = stored(through_arrow(state, _round(codebooks, drift), f"{held}, {_STATE}"))
        if r:
            forget(state)
        state = now
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        if r < rounds:
            after = _means(codebooks, state.select("sums"))
            drift = drift + drifts(codebooks, after)
            codebooks = after
    return state, codebooks, scanned


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def heap_lloyd(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", per_block: int | None = None) -> DataFrame:
    """A row for each kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold a null, NaN or infinity are dropped; components become floor(scale * component).
    Codebooks start as the parts of the vectors of the smallest ids, repeated rows included (of rows with one id the
    smaller vector first, null ids last); fewer vectors than entries give as many entries. A part that is as near to
    several entries has the lowest index; entries without parts stay. Vectors whose length isn't a multiple of `parts`,
    or which are shorter than others, count as zero beyond their end. Components beyond what keeps a squared distance
    within a long (2 ** 29 / scale for parts of 8) count as that limit. Other columns are ignored; an empty table gives
    none. label_error sums error over equal labels, nulls together.

    Each round writes the blocks with their heaps to the shared folder and deletes those of the round before.
    """
    blocks, codebooks, _ = fit(vectors, parts, entries, rounds, scale, id_col, vector_col, label_col, per_block)
    kind = pick(vectors, label_col).schema[0].dataType.simpleString()
    rows = cut(through_arrow(blocks.select("ids", "labels", "kind", "x", "codes"), _coded(codebooks), f"vec_id bigint, label {kind}, code string, error bigint"))
    forget(blocks)
    # A label may hold a third of the rows: sums meet them in as many copies as rows of a label are spread over.
    key = F.struct(F.col("label"))
    sums = rows.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error"))
    sums = sums.select("key", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.select("vec_id", "code", "error", key.alias("key"), F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(sums, ["key", "salt"]).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
