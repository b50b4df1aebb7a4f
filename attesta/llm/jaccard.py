"""Exact Jaccard self-join of word-shingle sets with set-relation skipping.

Documents with equal sets are one node. Two sets that link share one of the first few shingles in any common order (the
prefix), at positions that leave room for the overlap they need. The order here is by how many texts have a shingle,
rare ones first: a first pass counts all shingles of all texts by distributed runs of their hashes, and those of
FREQUENT texts or more (so few of them that a bounded table holds them) come last, by their count.

Index-level skipping: an index list holds the sets that have a shingle in their prefix, in blocks of equal set size and
by position in each block. For two blocks the sizes alone say how far down a position may be; the rest of a block, or
all of it, is skipped. Bitmaps rule out further pairs: each set has the parities of how many of its shingles fall on
each of BITS places, and sets differ by as many shingles as their bitmaps differ at least.

Answer-level skipping: in a first round each set meets one other only, its pivot: the set that most of its lists name as
the one with most relatives. What a set lacks of its pivot and what it has beyond it are kept. Sets that link to a pivot
share its component, so the second round for components looks only at pairs that no links connect yet; and the overlap
of two sets of one pivot follows from their differences to it, |p| - |lost(x) | lost(y)| + |gained(x) & gained(y)|,
without either set. Only pairs of different pivots are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import as_before, cut, pick, place_of, placed, through_arrow
from attesta.llm.components import connected_components

SHINGLE, PERCENT = 4, 85
#: Shingles of this many texts come last, at most so many of them: beyond, the least count is doubled until they fit.
FREQUENT, LAST_SHINGLES = 16, 2_000_000
BITS = 256
#: Rows up to which a table of ids is broadcast; beyond, it is joined.
BROADCAST_IDS = 1_000_000
#: Sets that a task compares with one pivot, and entries of one index list that a task holds; more are dealt out.
CELL, LIST = 250, 20_000

#: A shingle is a number of this many bits of hash, under its order's class of five bits.
HASH_BITS = 58
#: Bits of a hash that are counted within its bucket.
COUNTED_BITS = 24


class Shingles:
    """Sorted arrays of the distinct shingles of texts, as 64-bit numbers: their class in the order, then their hash.

    Words are hashed where they lie in the batch's bytes: a word's polynomial hash is the difference of two running sums.
    """

    SLICE = 1 << 18
    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, size: int, last: tuple[int, np.ndarray, np.ndarray] | None = None):
        """last: how many bits of a hash are compared, the sorted ones that come last, and their classes."""
        self.size = size
        self.shift, self.last, self.classes = (HASH_BITS - last[0], last[1], last[2]) if last else (0, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self._lower = np.arange(256, dtype=np.uint64) + np.uint64(1)
        self._lower[0x41:0x5B] += np.uint64(0x20)
        self._space = np.zeros(256, bool)
        self._space[[0x20, *range(0x09, 0x0E)]] = True
        self._powers = self._inverse = np.zeros(0, np.uint64)

    def _tables(self, n: int) -> None:
        if len(self._powers) < n:
            n = max(n, self.SLICE)
            self._powers, self._inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (np.uint64(self.BASE), np.uint64(pow(self.BASE, -1, 1 << 64))))

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def _joined(self, words: np.ndarray, n: int) -> np.ndarray:
        """The hash of each run of n words."""
        out = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            out = self._mix(out + words[i : len(words) - n + 1 + i])
        return out

    def _ordered(self, hashes: np.ndarray) -> np.ndarray:
        out = np.unique(hashes >> np.uint64(64 - HASH_BITS))
        if len(self.last) and len(out):
            part = out >> np.uint64(self.shift)
            at = np.minimum(np.searchsorted(self.last, part), len(self.last) - 1)
            hit = self.last[at] == part
            if hit.any():
                out = np.sort(out | np.where(hit, self.classes[at] << np.uint64(HASH_BITS), np.uint64(0)))
        return out.view(np.int64)

    def _slice(self, data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        self._tables(len(data) + 1)
        word = ~self._space[data]
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        starts_of_texts = np.r_[0, ends[:-1]]
        inside = starts_of_texts[starts_of_texts < len(data)]
        begins[inside] = word[inside]
        closes = np.zeros(len(data) + 1, bool)
        closes[1:] = word
        closes[1:-1] &= ~word[1:] | begins[1:]
        first, last = np.flatnonzero(begins), np.flatnonzero(closes)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._lower[data] * self._powers[: len(data)], out=sums[1:])
        words = self._mix((sums[last] - sums[first]) * self._inverse[first] + (last - first).astype(np.uint64))
        per_text = np.searchsorted(first, ends) - np.searchsorted(first, starts_of_texts)
        runs = self._joined(words, self.size) if len(words) >= self.size else None
        out, at = [], 0
        for n in per_text.tolist():
            if n >= self.size:
                out.append(self._ordered(runs[at : at + n - self.size + 1]))
            else:
                out.append(self._ordered(self._joined(words[at : at + n], n)) if n else np.zeros(0, np.int64))
            at += n
        return out

    def arrays(self, texts: pa.Array) -> list[np.ndarray]:
        """One array for each text; none in that of a null or blank one."""
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        out, lo = [], 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + self.SLICE, side="right")) - 1)
            out += self._slice(data[ends[lo] : ends[hi]], ends[lo + 1 : hi + 1] - ends[lo])
            lo = hi
        return out


def needed(a, b, percent: int):
    """The overlap that sets of sizes a and b need to link: percent * union <= 100 * overlap."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-(percent * n) // 100) + 1 if n else 0


def _blobs(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that follow each other in data, by their ends in bytes."""
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each bucket of a partition that is sorted by bucket."""
    bucket, held = None, []
    for b in batches:
        at = b.column("bucket").to_numpy()
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]).tolist() if len(at) else []
        for lo, hi in zip(starts, [*starts[1:], len(at)], strict=True):
            if at[lo] != bucket:
                if held:
                    yield bucket, held
                bucket, held = int(at[lo]), []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield bucket, held


def _joined(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.frombuffer(b"".join(x for p in parts for x in p.column(name).to_pylist()), np.uint8)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers of COUNTED_BITS as three bytes each."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].reshape(-1)


def _wide(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x) // 3, 4), np.uint8)
    out[:, :3] = x.reshape(-1, 3)
    return out.view("<u4").reshape(-1)


def _token_runs(batches: Iterator[pa.RecordBatch], size: int, bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the texts' shingles by bucket: those met once, and those met more often with their counts."""
    of, held, n = Shingles(size), [], 0
    flush = min(4_000_000, 400 << bucket_bits)

    def run() -> pa.RecordBatch:
        x = np.sort(np.concatenate(held))
        starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        times, x = np.diff(np.r_[starts, len(x)]), x[starts]
        buckets = np.unique(x >> COUNTED_BITS)
        once, often = x[times == 1], x[times > 1]
        limits = (buckets + 1) << COUNTED_BITS
        n_once, n_often = np.searchsorted(once, limits), np.searchsorted(often, limits)
        columns = [pa.array(buckets.astype(np.int32)), _blobs(_narrow(once), 3 * n_once), _blobs(_narrow(often), 3 * n_often), _blobs(times[times > 1].astype("<u4").view(np.uint8), 4 * n_often)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "once", "often", "times"])

    for b in batches:
        for x in of.arrays(b.column("text")):
            held.append(x >> (HASH_BITS - bucket_bits - COUNTED_BITS))
            n += len(x)
            if n >= flush:
                yield run()
                held, n = [], 0
    if n:
        yield run()


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash parts of shingles of FREQUENT texts or more, and their counts."""
    for bucket, parts in _by_bucket(batches):
        once, often = _wide(_joined(parts, "once")), _wide(_joined(parts, "often"))
        x = np.concatenate([once, often])
        times = np.concatenate([np.ones(len(once), np.int64), _joined(parts, "times").view("<u4").astype(np.int64)])
        order = np.argsort(x, kind="stable")
        x, times = x[order], times[order]
        starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        total = np.add.reduceat(times, starts)
        keep = total >= FREQUENT
        yield pa.RecordBatch.from_arrays([pa.array((bucket << COUNTED_BITS) + x[starts][keep].astype(np.int64)), pa.array(total[keep])], ["token", "n"])


def node_of(shingles: np.ndarray) -> int:
    """The number that stands for a set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _rows(batches: Iterator[pa.RecordBatch], size: int, percent: int, last) -> Iterator[pa.RecordBatch]:
    of = Shingles(size, last and last.value)
    for b in batches:
        sets = of.arrays(b.column("text"))
        n = np.array([len(x) for x in sets], np.int64)
        nodes = [node_of(x) if len(x) else None for x in sets]
        bits = [np.packbits(np.bincount(x & (BITS - 1), minlength=BITS).astype(np.uint8) & 1).view(np.int64) for x in sets]
        bits = np.array(bits).reshape(-1, BITS // 64)
        prefixes = [x[: prefix_length(len(x), percent)] for x in sets]
        prefix = _blobs(np.concatenate([*prefixes, np.zeros(0, np.int64)]).view(np.uint8), 8 * np.cumsum([len(x) for x in prefixes], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(n), pa.array(nodes, pa.int64()), *(pa.array(bits[:, k].copy()) for k in range(BITS // 64)), prefix], ["doc_id", "row", "n", "node", *_BIT_COLUMNS, "prefix"])


def _entries(batches: Iterator[pa.RecordBatch], bucket_bits: int) -> Iterator[pa.RecordBatch]:
    """The index entries of a task's sets, each set once, packed by bucket of their shingle: shingle, node, size and position."""
    seen: set[int] = set()
    held, n = [], 0
    flush = min(1_000_000, 200 << bucket_bits)

    def run() -> pa.RecordBatch:
        token, node, place = (np.concatenate(x) for x in zip(*held, strict=True))
        at = (token >> 20) & ((1 << bucket_bits) - 1)
        order = np.argsort(at, kind="stable")
        buckets, counts = np.unique(at, return_counts=True)
        ends = 8 * np.cumsum(counts)
        return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), *(_blobs(x[order].view(np.uint8), ends) for x in (token, node, place))], ["bucket", "token", "node", "place"])

    for b in batches:
        for size, node, prefix in zip(b.column("n").to_pylist(), b.column("node").to_pylist(), b.column("prefix").to_pylist(), strict=True):
            if node is None or node in seen:
                continue
            seen.add(node)
            tokens = np.frombuffer(prefix, np.int64)
            held.append((tokens, np.full(len(tokens), node, np.int64), (size << 32) + np.arange(1, len(tokens) + 1, dtype=np.int64)))
            n += len(tokens)
            if n >= flush:
                yield run()
                held, n = [], 0
    if n:
        yield run()


def _shared_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of lists with two sets or more."""
    for _, parts in _by_bucket(batches):
        token, node, place = (_joined(parts, c).view(np.int64) for c in ("token", "node", "place"))
        order = np.lexsort((node, token))
        token, node, place = token[order], node[order], place[order]
        new = np.r_[True, (token[1:] != token[:-1]) | (node[1:] != node[:-1])]  # copies in several tasks
        token, node, place = token[new], node[new], place[new]
        same = token[1:] == token[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        place = place[keep]
        yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(node[keep]), pa.array(place >> 32), pa.array(place & 0xFFFFFFFF)], ["token", "node", "n", "pos"])


def _index_lists(batches: Iterator[pa.RecordBatch], columns: list[str], keys: int = 1) -> Iterator[dict[str, np.ndarray]]:
    """The index lists of a partition sorted by the first `keys` columns; a list may span batches."""
    rest: list[list[np.ndarray]] = []
    last = None
    for b in batches:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(cols[0]):
            continue
        new = np.zeros(len(cols[0]), bool)
        for c in cols[:keys]:
            new[1:] |= c[1:] != c[:-1]
        new[0] = last is None or any(c[0] != x for c, x in zip(cols, last, strict=False))
        last = [c[-1] for c in cols[:keys]]
        starts = np.flatnonzero(new).tolist()
        if not starts:
            rest.append(cols)
            continue
        if rest or starts[0]:
            rest.append([c[: starts[0]] for c in cols])
            whole = [np.concatenate(x) for x in zip(*rest, strict=True)]
            if len(whole[0]) > 1:
                yield dict(zip(columns, whole, strict=True))
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi - lo > 1:
                yield {c: x[lo:hi] for c, x in zip(columns, cols, strict=True)}
        rest = [[c[starts[-1] :] for c in cols]]
    if rest:
        whole = [np.concatenate(x) for x in zip(*rest, strict=True)]
        if len(whole[0]) > 1:
            yield dict(zip(columns, whole, strict=True))


def _out(pairs: list[np.ndarray]) -> pa.RecordBatch:
    p, n = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), pa.array(n)], ["a", "b", "lists"])


_BIT_COLUMNS = [f"bits{k}" for k in range(BITS // 64)]


def _may_link(x: dict[str, np.ndarray], i: np.ndarray | int, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the bitmaps of entries i and j differ at no more places than sets that link may."""
    differ = sum(np.bitwise_count((x[c][i] ^ x[c][j]).view(np.uint64)).astype(np.int64) for c in _BIT_COLUMNS)
    n_i, n_j = x["n"][i], x["n"][j]
    return differ <= n_i + n_j - 2 * needed(n_i, n_j, percent)


def _pivot_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each list, the pairs of a pivot with the others that sizes, positions and bitmaps allow.

    The pivot is the set that shares most of its prefix with others: of near copies, the one that the others were made
    of. Sets of sizes that can't link to it get a pivot of their own.
    """
    found, held = [], 0
    for x in _index_lists(batches, ["token", "part", "node", "n", "pos", "shared", *_BIT_COLUMNS], 2):
        node, n, pos, shared = x["node"], x["n"], x["pos"], x["shared"]
        left = np.arange(len(n))
        while len(left) > 1:
            i = left[np.lexsort((node[left], -shared[left]))[0]]
            low, high = np.minimum(n[left], n[i]), np.maximum(n[left], n[i])
            near = 100 * low >= percent * high
            j = left[near & (left != i)]
            req = needed(n[i], n[j], percent)
            j = j[(pos[j] <= n[j] - req + 1) & (pos[i] <= n[i] - req + 1)]
            j = j[_may_link(x, i, j, percent)]
            if len(j):
                found.append(np.stack([np.full(len(j), node[i]), node[j]], axis=1))
                held += len(j)
            left = left[~near]
        if held > 200_000:
            yield _out(found)
            found, held = [], 0
    if found:
        yield _out(found)


def _cross_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each list, the pairs of different components that sizes, positions and bitmaps allow, block by block.

    A list that is dealt out in parts comes once for each two of them, and for each alone.
    """
    found, held = [], 0
    for x in _index_lists(batches, ["token", "first", "second", "node", "n", "pos", "component", "part", *_BIT_COLUMNS], 3):
        node, n, pos, comp, part = x["node"], x["n"], x["pos"], x["component"], x["part"]
        if (comp == comp[0]).all():
            continue
        apart = x["first"][0] != x["second"][0]
        starts = np.flatnonzero(np.r_[True, n[1:] != n[:-1]]).tolist()
        blocks = list(zip(starts, [*starts[1:], len(n)], n[starts].tolist(), strict=True))
        for k, (lo2, hi2, s2) in enumerate(blocks):
            for lo1, hi1, s1 in blocks[k::-1]:
                if 100 * s1 < percent * s2:
                    break
                req = needed(s1, s2, percent)
                i = np.arange(lo1, lo1 + np.searchsorted(pos[lo1:hi1], s1 - req + 1, side="right"))
                j = np.arange(lo2, lo2 + np.searchsorted(pos[lo2:hi2], s2 - req + 1, side="right"))
                step = max(1, 500_000 // max(1, len(j)))
                for at in range(0, len(i), step):
                    some = i[at : at + step]
                    u, v = np.repeat(some, len(j)), np.tile(j, len(some))
                    ok = (comp[u] != comp[v]) & ((u < v) | (lo1 != lo2))
                    if apart:
                        ok &= part[u] != part[v]
                    u, v = u[ok], v[ok]
                    ok = _may_link(x, u, v, percent)
                    if ok.any():
                        found.append(np.sort(np.stack([node[u[ok]], node[v[ok]]], axis=1), axis=1))
                        held += int(ok.sum())
                    if held > 200_000:
                        yield _out(found)
                        found, held = [], 0
    if found:
        yield _out(found)


def _sets(batches: Iterator[pa.RecordBatch], size: int, last) -> Iterator[pa.RecordBatch]:
    """The sets of texts that have the wanted node (others have the same doc_id), as bytes."""
    of = Shingles(size, last and last.value)
    for b in batches:
        sets = of.arrays(b.column("text"))
        nodes = np.array([node_of(x) if len(x) else 0 for x in sets], np.int64)
        hit = np.flatnonzero((nodes == b.column("node").to_numpy()) & np.array([len(x) > 0 for x in sets], bool))
        data = np.concatenate([*(sets[i] for i in hit), np.zeros(0, np.int64)]).view(np.uint8)
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(hit)) for c in ("pivot", "part", "lead", "node")), _blobs(data, 8 * np.cumsum([len(sets[i]) for i in hit], dtype=np.int64))], ["pivot", "part", "lead", "node", "shingles"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pivot, part, lead first and node: of each set its overlap with the pivot and its differences."""
    pivot, whole, before = None, np.zeros(0, np.int64), None
    for b in batches:
        out: list[tuple] = []
        for p, part, lead, node, data in zip(*(b.column(c).to_pylist() for c in ("pivot", "part", "lead", "node", "shingles")), strict=True):
            x = np.frombuffer(data, np.int64)
            if lead:
                pivot, whole = (p, part), x
                continue
            if pivot != (p, part) or before == (p, part, node):  # the same text with the same doc_id again
                continue
            before = (p, part, node)
            both = np.intersect1d(whole, x, assume_unique=True)
            lost, gained = np.setdiff1d(whole, both, assume_unique=True), np.setdiff1d(x, both, assume_unique=True)
            far = 2 * len(both) < len(x)  # then the differences are no shorter than the sets
            out.append((p, node, len(whole), len(x), len(both), None if far else lost.tobytes(), None if far else gained.tobytes()))
        if out:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k > 4 else pa.int64()) for k, c in enumerate(columns)], ["a", "b", "n_a", "n_b", "overlap", "lost", "gained"])


def _derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlap of two sets from their differences to one pivot."""
    for b in batches:
        overlap = []
        for n, *differences in zip(*(b.column(c).to_pylist() for c in ("n_pivot", "lost_a", "lost_b", "gained_a", "gained_b")), strict=True):
            lost_a, lost_b, gained_a, gained_b = (np.frombuffer(x, np.int64) for x in differences)
            overlap.append(n - len(np.union1d(lost_a, lost_b)) + len(np.intersect1d(gained_a, gained_b, assume_unique=True)))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(overlap, pa.int64())], ["a", "b", "n_a", "n_b", "overlap"])


class JaccardJoin:
    """The join of one table: rows (doc_id, row, n, node, prefix and bitmaps) and links()."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", list_limit: int = LIST, cell: int = CELL):
        self.size, self.percent, self.list_limit, self.cell = size, percent, list_limit, cell
        self.docs = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
        self.bucket_bits = max(8, min(20, int(self.docs.count() // 200).bit_length()))
        last = self._last_shingles()
        self.last = docs.sparkSession.sparkContext.broadcast(last) if last else None  # LAST_SHINGLES numbers at most
        last = self.last
        bits = ", ".join(f"{c} long" for c in _BIT_COLUMNS)
        self.rows = cut(through_arrow(self.docs, lambda x: _rows(x, size, percent, last), f"doc_id long, row long, n long, node long, {bits}, prefix binary"))

    def _in_buckets(self, packed: DataFrame) -> DataFrame:
        return packed.repartition("bucket").sortWithinPartitions("bucket")

    def _last_shingles(self) -> tuple[int, np.ndarray, np.ndarray] | None:
        size, bits = self.size, self.bucket_bits
        runs = through_arrow(self.docs.select("text"), lambda x: _token_runs(x, size, bits), "bucket int, once binary, often binary, times binary")
        found = cut(through_arrow(self._in_buckets(runs), _frequent, "token long, n long").withColumn("class", F.floor(F.log2("n")).cast("int")))
        counts = {r["class"]: r["count"] for r in found.groupBy("class").count().collect()}
        least = next((k for k in sorted(counts) if sum(v for c, v in counts.items() if c >= k) <= LAST_SHINGLES), None)
        if least is None:
            return None
        t = found.where(F.col("class") >= least).select("token", "class").orderBy("token").toArrow()
        token, kind = t["token"].to_numpy().astype(np.uint64), t["class"].to_numpy().astype(np.uint64)
        return (bits + COUNTED_BITS, token, np.minimum(kind - np.uint64(FREQUENT.bit_length() - 2), np.uint64(31)))

    def _lists(self) -> DataFrame:
        """The entries (token, part, node, n, pos, shared, bitmaps) of index lists of several sets, long ones in parts."""
        bits = self.bucket_bits
        packed = through_arrow(self.rows.select("n", "node", "prefix"), lambda x: _entries(x, bits), "bucket int, token binary, node binary, place binary")
        lists = cut(through_arrow(self._in_buckets(packed), _shared_entries, "token long, node long, n long, pos long"))
        shared = lists.groupBy("node").agg((F.count("*") * 1_000_000 / (F.max("n") + 1)).cast("long").alias("shared"))
        maps = self.rows.where("n > 0").groupBy("node").agg(*(F.first(c).alias(c) for c in _BIT_COLUMNS))
        lists = lists.join(shared.join(maps, "node"), "node")
        long = lists.groupBy("token").count().where(F.col("count") > self.list_limit).select("token", F.ceil(F.col("count") / self.list_limit).alias("parts"))
        lists = lists.join(long, "token", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), "parts"), F.lit(0)).cast("long"))
        return cut(lists.select("token", "part", F.coalesce("parts", F.lit(1)).cast("long").alias("parts"), "node", "n", "pos", "shared", *_BIT_COLUMNS))

    def _first_pairs(self, lists: DataFrame) -> DataFrame:
        """A pivot (a) for each set (b) that has one."""
        percent = self.percent
        dealt = lists.drop("parts").repartition("token", "part").sortWithinPartitions("token", "part", "n", "pos", "node")
        pairs = through_arrow(dealt, lambda x: _pivot_pairs(x, percent), "a long, b long, lists long").groupBy("a", "b").agg(F.sum("lists").alias("lists"))
        best = pairs.groupBy("b").agg(F.max(F.struct("lists", "a")).alias("best"))
        return cut(best.select(F.col("best.a").alias("a"), "b"))

    def _further_pairs(self, lists: DataFrame, component: DataFrame | None) -> DataFrame:
        """The pairs of lists; with component (j, component) only those of different ones."""
        percent = self.percent
        if component is None:
            lists = lists.withColumn("component", F.col("node"))
        else:
            lists = lists.join(component, F.col("node") == F.col("j"), "left").withColumn("component", F.coalesce("component", "node"))
            mixed = lists.where("parts > 1").groupBy("token").agg((F.min("component") < F.max("component")).alias("mixed")).where("mixed").select("token")
            lists = lists.where("parts = 1").unionByName(lists.where("parts > 1").join(mixed, "token", "left_semi"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        dealt = lists.withColumn("other", other).select("token", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"), "part", "node", "n", "pos", "component", *_BIT_COLUMNS)
        dealt = dealt.repartition("token", "first", "second").sortWithinPartitions("token", "first", "second", "n", "pos", "node")
        return through_arrow(dealt, lambda x: _cross_pairs(x, percent), "a long, b long, lists long").select("a", "b").distinct()

    def _compare(self, pairs: DataFrame) -> DataFrame:
        """Of pairs a (the pivot), b: a, b, n_a, n_b, overlap, lost, gained. Each set goes to each of its pivots once."""
        size, last, cell = self.size, self.last, self.cell
        parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts"))
        leads = parts.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("lead"))
        others = pairs.join(parts, "a").select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(0).alias("lead"))
        wanted = cut(leads.unionByName(others))
        ids = self.rows.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("want"))
        wanted = cut(wanted.join(ids, "node").withColumnRenamed("a", "pivot"))
        hint = F.broadcast if wanted.count() <= BROADCAST_IDS else lambda x: x
        texts = self.docs.join(hint(wanted), F.col("doc_id").eqNullSafe(F.col("want"))).select("text", "pivot", "part", "lead", "node")
        sets = through_arrow(texts, lambda x: _sets(x, size, last), "pivot long, part int, lead int, node long, shingles binary")
        sets = sets.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.desc("lead"), "node")
        return cut(through_arrow(sets, _compared, "a long, b long, n_a long, n_b long, overlap long, lost binary, gained binary"))

    def _linked(self, compared: DataFrame) -> DataFrame:
        hit = F.lit(100 + self.percent) * F.col("overlap") >= self.percent * (F.col("n_a") + F.col("n_b"))
        return compared.where(hit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "overlap")

    def links(self, every: bool = False) -> DataFrame:
        """Links a, b, overlap between nodes: enough to connect all that link, or every one."""
        lists = self._lists()
        first = self._compare(self._first_pairs(lists))
        linked = self._linked(first).distinct()
        component = None if every else connected_components(linked).withColumnRenamed("node", "j")
        known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = self._further_pairs(lists, component).join(known, ["a", "b"], "left_anti")
        # What two sets of one pivot share follows from their differences to it.
        of = first.where("lost IS NOT NULL")
        side = lambda s: of.select(F.col("b").alias(s), F.col("a").alias(f"pivot_{s}"), F.col("n_a").alias("n_pivot"), F.col("n_b").alias(f"n_{s}"), F.col("lost").alias(f"lost_{s}"), F.col("gained").alias(f"gained_{s}"))
        met = cut(pairs.join(side("a"), "a", "left").join(side("b").drop("n_pivot"), "b", "left"))
        near = F.coalesce(F.col("pivot_a") == F.col("pivot_b"), F.lit(False))
        derived = through_arrow(met.where(near).drop("pivot_a", "pivot_b"), _derived, "a long, b long, n_a long, n_b long, overlap long")
        rest = met.where(~near).select("a", "b")
        # The side that is in more pairs is the pivot, so that few sets move often.
        ends = rest.select(F.col("a").alias("x")).union(rest.select("b")).groupBy("x").count()
        rest = rest.join(ends.toDF("a", "count_a"), "a").join(ends.toDF("b", "count_b"), "b")
        turned = F.col("count_a") < F.col("count_b")
        rest = cut(rest.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b")))
        more = self._linked(derived).unionByName(self._linked(self._compare(rest)))
        return cut(linked.unionByName(more))


def jaccard_links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link between different sets, and who has which set.

    The first table has class_a < class_b, overlap; the second, for each row of docs, doc_id, n_shingles, class_id (null
    for a text without words). Rows of one class have equal sets and link to each other. A group of g different near
    copies can have g * g / 2 links, and this table is as long.
    """
    join = JaccardJoin(docs, size, percent, id_col, text_col)
    links = join.links(every=True).toDF("class_a", "class_b", "overlap")
    return links, join.rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("node").alias("class_id"))


def _components(join: JaccardJoin) -> DataFrame:
    """doc_id, row, n, component for each row; component is null for a text without words."""
    joined = connected_components(join.links()).withColumnRenamed("node", "j")
    hint = F.broadcast if joined.count() <= BROADCAST_IDS else lambda x: x
    rows = join.rows.select("doc_id", "row", "n", "node")
    return cut(rows.join(hint(joined), F.col("node") == F.col("j"), "left").select("doc_id", "row", "n", F.coalesce("component", "node").alias("component")))


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    A text of fewer words than a shingle is one shingle; null texts and those without words have none and link with
    nothing. Equal sets link. Repeated rows are rows of one component. A null id counts as larger than others, and a
    component of null ids alone has a null id. An empty table gives an empty one. Other columns are ignored.
    """
    rows = _components(JaccardJoin(docs, size, percent, id_col, text_col))
    ids = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("members")).where("members > 1")
    ids = cut(ids.select(F.col("component").alias("c"), F.col("component_id").alias("smallest")))
    hint = F.broadcast if ids.count() <= BROADCAST_IDS else lambda x: x
    out = rows.join(hint(ids), F.col("component") == F.col("c"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("smallest", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs (doc_id, text and any others) with the smallest doc_id of their component, with docs' columns.

    Of rows that share that id, the first read stays; a null id counts as larger than others. Null texts and those
    without words stay all. An empty table gives an empty one. Other columns, also of clashing names, are kept as they are.
    """
    rows = _components(JaccardJoin(docs, size, percent)).where("component IS NOT NULL")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = rows.groupBy("component").agg(F.min(rank).alias("first"), F.count("*").alias("members")).where("members > 1").select(F.col("component").alias("c"), "first")
    gone = rows.join(first, F.col("component") == F.col("c")).where(F.col("row") != F.col("first.row"))
    gone = cut(gone.select(F.col("doc_id").alias("x_id"), F.col("row").alias("x_row")))
    numbered = placed(docs).withColumn("row", F.monotonically_increasing_id())
    hit = place_of(docs, "doc_id").cast("long").eqNullSafe(F.col("x_id")) & (F.col("row") == F.col("x_row"))
    hint = F.broadcast if gone.count() <= BROADCAST_IDS else lambda x: x
    return as_before(numbered.join(hint(gone), hit, "left_anti"), docs)
