"""Exact top-k search: candidates in order of length, inner products summed up along singular directions.

Vectors lie in blocks, the longest first. A query stops at the block whose longest vector can't reach its k-th best score
(Cauchy-Schwarz on whole lengths). Within a block the products of the first singular directions are summed up, and a pair
goes on only while that sum plus the product of what is left of both lengths reaches the k-th best score; pairs that get
to the end are scored in whole numbers, so that results are exact.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import cut, delete, forget, pick, shared_folder, stored, through_arrow

#: Numbers in a block of candidates and in the blocks of one partition (8 bytes each), and in the queries of one pass.
BLOCK, PARTITION, PASS = 1 << 18, 1 << 22, 1 << 21
#: Shares of the directions after which a pair's bound is looked at, and numbers in a table of partial sums.
STEPS, TABLE = (0.125, 0.25, 0.5), 1 << 21
#: What a null id counts as: it comes last among ties.
NO_ID = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """vec_id, x (doubles that are whole numbers) and the columns `more`: each component becomes floor(scale * component).
    Vectors that are null or hold a null, NaN or infinity are left out."""
    v = pick(vectors, id_col, vector_col, *more).toDF("vec_id", "v", *more).withColumns({"vec_id": F.col("vec_id").cast("long"), "v": F.col("v").cast("array<double>")})
    v = v.where(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("double")).alias("x"), *more)


def limit_of(size: int, bits: int) -> int:
    """The largest whole number of which `size` squares sum up to less than 2 ** bits."""
    return math.isqrt((1 << bits) // max(1, size)) - 1


def _packed(size: int, limit: int, per_block: int):
    """Rows (vec_id, x, length) in order become blocks (longest, ids, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, lengths, n = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal ids, xs, lengths, n
            i, x, l = np.concatenate(ids), np.concatenate(xs), np.concatenate(lengths)
            ids, xs, lengths, n = [i[per_block:]], [x[per_block:]], [l[per_block:]], max(0, n - per_block)
            return pa.RecordBatch.from_arrays([pa.array([float(l[:per_block].max())]), pa.array([i[:per_block].tobytes()], pa.binary()), pa.array([x[:per_block].tobytes()], pa.binary())], names=["longest", "ids", "x"])

        for b in batches:
            ids.append(b["vec_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False))
            xs.append(dense(b["x"], size, limit))
            lengths.append(b["length"].to_numpy(zero_copy_only=False))
            n += b.num_rows
            while n >= per_block:
                yield block()
        if n:
            yield block()

    return run


def dense(lists: pa.Array, size: int, limit: int) -> np.ndarray:
    """Lists of numbers as rows of `size` columns, zeros beyond their ends, no number beyond +-limit."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), size))
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return np.clip(out, -limit, limit)


def _moments(size: int):
    """Each task's sums of x_i * x_j, a row for each i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            for x in b["x"]:
                m = np.frombuffer(x.as_py()).reshape(-1, size)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "m"])

    return run


def rotation(blocks: DataFrame, size: int) -> np.ndarray:
    """The right singular vectors of all candidates as columns, those of the largest singular values first.

    size * size numbers come to the driver, however many vectors there are.
    """
    sums = through_arrow(blocks.select("x"), _moments(size), "i long, m array<double>")
    rows = sums.select("i", F.posexplode("m").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((size, size))
    for r in rows:
        m[r["i"], r["j"]] = r["v"]
    return np.linalg.eigh(m)[1][:, ::-1].copy()


class _Search:
    """The best `most` candidates of the queries of one pass, for the blocks that one task reads."""

    def __init__(self, q: np.ndarray, v: np.ndarray, least: np.ndarray, most: int):
        size = q.shape[1]
        self.q, self.v, self.most = q, v, most
        self.turned, self.length = q @ v, np.linalg.norm(q, axis=1)
        self.steps = sorted({max(1, math.ceil(size * s)) for s in STEPS} | {size})
        self.rest = [self._rest(self.turned, h) for h in self.steps]
        #: The score that a candidate has to reach; below it nothing can be among the best.
        self.least = least.copy()
        self.scores = np.zeros((len(q), 0), dtype=np.int64)
        self.ids = np.zeros((len(q), 0), dtype=np.int64)
        self.filled = np.zeros(len(q), dtype=np.int64)

    @staticmethod
    def _rest(x: np.ndarray, h: int) -> np.ndarray:
        return np.linalg.norm(x[:, h:], axis=1)

    def exact(self, qi: np.ndarray, xi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Scores in whole numbers: doubles while they are exact, else longs."""
        out, step = np.empty(len(qi), dtype=np.int64), max(1, TABLE // x.shape[1])
        sure = len(x) == 0 or self.length.max() * np.linalg.norm(x, axis=1).max() < 2**52
        for a in range(0, len(qi), step):
            u, w = self.q[qi[a : a + step]], x[xi[a : a + step]]
            out[a : a + step] = np.einsum("ij,ij->i", u, w) if sure else np.einsum("ij,ij->i", u.astype(np.int64), w.astype(np.int64))
        return out

    def pairs(self, rows: np.ndarray, turned: np.ndarray, rest: list[np.ndarray], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (query, candidate) of `rows` and the block whose bounds reach the query's least score."""
        qi = xi = part = None
        for k, h in enumerate(self.steps):
            before = self.steps[k - 1] if k else 0
            if qi is None:  # all pairs of the tile: a product of two tables
                part = self.turned[rows, :h] @ turned[:, :h].T
                # Rounding of doubles is far below this share of both lengths.
                slack = 1e-9 * self.length[rows] * length.max() + 1e-6
                if h == self.steps[-1] and len(turned) >= self.most:  # the block's own k-th best are enough
                    best = np.partition(part, -self.most, axis=1)[:, -self.most]
                    self.least[rows] = np.maximum(self.least[rows], best - slack)
                ok = part + np.outer(self.rest[k][rows], rest[k]) >= (self.least[rows] - slack)[:, None]
                if ok.mean() > 0.1 and h < self.steps[-1]:
                    continue
                r, xi = np.nonzero(ok)
                qi, part = rows[r], part[r, xi]
            else:
                part = part + np.einsum("ij,ij->i", self.turned[qi, before:h], turned[xi, before:h])
                ok = part + self.rest[k][qi] * rest[k][xi] + 1e-9 * self.length[qi] * length[xi] + 1e-6 >= self.least[qi]
                qi, xi, part = qi[ok], xi[ok], part[ok]
        return qi, xi

    def add(self, ids: np.ndarray, x: np.ndarray, longest: float) -> None:
        turned, length = x @ self.v, np.linalg.norm(x, axis=1)
        rest = [self._rest(turned, h) for h in self.steps]
        reach = np.nonzero(self.length * longest * (1 + 1e-9) + 1e-6 >= self.least)[0]
        for a in range(0, len(reach), step := max(1, TABLE // max(1, len(x)))):
            qi, xi = self.pairs(reach[a : a + step], turned, rest, length)
            if len(qi):
                self.merge(qi, self.exact(qi, xi, x), ids[xi])

    def merge(self, qi: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        own = np.unique(qi)
        had = np.arange(self.scores.shape[1])[None, :] < self.filled[own, None]
        r, c = np.nonzero(had)
        qi, scores, ids = np.concatenate([qi, own[r]]), np.concatenate([scores, self.scores[own[r], c]]), np.concatenate([ids, self.ids[own[r], c]])
        order = np.lexsort((ids, -scores, qi))
        qi, scores, ids = qi[order], scores[order], ids[order]
        at = np.arange(len(qi)) - np.searchsorted(qi, qi)
        keep = at < self.most
        qi, scores, ids, at = qi[keep], scores[keep], ids[keep], at[keep]
        if self.scores.shape[1] < self.most:
            self.scores, self.ids = (np.zeros((len(self.q), self.most), dtype=np.int64) for _ in range(2))
        self.scores[qi, at], self.ids[qi, at] = scores, ids
        self.filled[own] = np.searchsorted(qi, own, side="right") - np.searchsorted(qi, own)
        full = own[self.filled[own] == self.most]
        self.least[full] = np.maximum(self.least[full], self.scores[full, self.most - 1].astype(np.float64))

    def found(self) -> pa.RecordBatch:
        r, c = np.nonzero(np.arange(self.scores.shape[1])[None, :] < self.filled[:, None])
        return pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)), pa.array(self.ids[r, c]), pa.array(self.scores[r, c])], names=["q", "vec_id", "score"])


_FOUND = "q long, vec_id long, score long"


def _searched(blocks: DataFrame, shared, size: int, most: int) -> DataFrame:
    """For each task that reads blocks, the best candidates of each query among them: q, vec_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _Search(*shared.value, most)
        for b in batches:
            for longest, ids, x in zip(b["longest"], b["ids"], b["x"], strict=True):
                s.add(np.frombuffer(ids.as_py(), dtype=np.int64), np.frombuffer(x.as_py()).reshape(-1, size), longest.as_py())
        yield s.found()

    return through_arrow(blocks.select("longest", "ids", "x"), run, _FOUND)


def _best(found: DataFrame, most: int) -> DataFrame:
    """The best `most` of each query, with place from 1."""
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", per_pass: int | None = None, per_block: int | None = None) -> DataFrame:
    """For each row of vectors for which is_query (a condition on vec_id) holds, its k best candidates: query_id, rank, vec_id, score.

    Candidates are all rows but the query's own; the score is the inner product of the vectors of floor(scale * component).
    Fewer than k candidates give fewer rows, ties go to the smaller vec_id. Vectors that are null or hold a null, NaN or
    infinity take no part. Repeated rows are candidates of each other and a query each, with the same rows. A null vec_id
    is a candidate, last among ties, and no query. Shorter vectors count as zero beyond their end, empty ones as zero.
    Components that would make the sum of squares leave a long count as the largest that doesn't (beyond some
    10,000,000 / scale for any usual size). Other columns are ignored; an empty table, or one without query, gives no rows.

    Queries meet the candidates in passes of per_pass distinct queries (PASS numbers), which are broadcast; candidates are
    never moved after they have been put in order, and a pass reads only blocks that can still reach one of its queries.
    """
    spark = vectors.sparkSession
    v = whole_vectors(vectors, scale, id_col, vector_col)
    n, size = v.agg(F.count("*"), F.max(F.size("x"))).first()
    size = max(1, size or 0)
    limit, per_block, per_pass = limit_of(size, 62), per_block or max(16, BLOCK // size), per_pass or max(16, PASS // size)
    v = v.withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)))
    parts = max(math.ceil((n or 1) * size / PARTITION), min(spark.sparkContext.defaultParallelism, math.ceil((n or 1) / per_block)), 1)
    ordered = v.repartitionByRange(parts, F.desc("length"), "vec_id", F.xxhash64("x")).sortWithinPartitions(F.desc("length"), "vec_id")
    blocks = stored(through_arrow(ordered, _packed(size, limit, per_block), "longest double, ids binary, x binary"))
    # The same vector under the same id is searched for once.
    queries = v.where(is_query).groupBy("vec_id", "x").agg(F.count("*").alias("times"))
    passes = max(1, math.ceil(queries.count() / per_pass))
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    queries.withColumn("pass", F.pmod(F.xxhash64("vec_id", "x"), F.lit(passes)).cast("int")).repartition(passes, "pass").write.partitionBy("pass").parquet(folder)
    queries = spark.read.schema("vec_id long, x array<double>, times long, pass int").parquet(folder)
    v_ = rotation(blocks, size) if n else np.eye(size)
    top = blocks.agg(F.max("longest")).first()[0] or 0.0
    out = []
    for p in range(passes):
        own = queries.where(F.col("pass") == p).select("vec_id", "x", "times").toArrow()
        if not own.num_rows:
            continue
        order = np.argsort(own["vec_id"].to_numpy(), kind="stable")
        own = own.take(pa.array(order)).combine_chunks()
        q = dense(own["x"].chunk(0), size, limit)
        least = np.full(len(q), -np.inf)
        # The block of the longest vectors gives the first k-th best scores; its own place is one more.
        first = spark.sparkContext.broadcast((q, v_, least))
        for r in _best(_searched(blocks.where(F.col("longest") >= top).limit(1), first, size, k + 1), k + 1).where(F.col("place") == k + 1).select("q", "score").collect():
            least[r["q"]] = r["score"]
        shared = spark.sparkContext.broadcast((q, v_, least))
        length = np.linalg.norm(q, axis=1)
        need = float(np.min(np.where(length > 0, least / np.maximum(length, 1e-300), -np.inf))) * (1 - 1e-9) - 1e-6 if len(q) else 0.0
        near = blocks.where(F.col("longest") >= need) if math.isfinite(need) else blocks
        about = spark.createDataFrame(pa.table({"q": np.arange(len(q)), "query_id": own["vec_id"], "own": np.einsum("ij,ij->i", q.astype(np.int64), q.astype(np.int64)), "times": own["times"]}))
        out.append(cut(_own_left_out(_best(_searched(near, shared, size, k + 1), k + 1).join(about, "q"), k)))
        first.unpersist()
        shared.unpersist()
    forget(blocks)
    delete(spark, folder)
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found


def _own_left_out(best: DataFrame, k: int) -> DataFrame:
    """The k + 1 best of each query without one row that is the query's own: same id, and the score of its own vector."""
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))).over(Window.partitionBy("q"))
    rest = best.withColumn("at", F.coalesce(own, F.lit(k + 1))).where(F.col("place") != F.col("at"))
    rank = (F.col("place") - (F.col("place") > F.col("at")).cast("int")).cast("int")
    vec_id = F.when(F.col("vec_id") != NO_ID, F.col("vec_id"))
    return rest.select("query_id", rank.alias("rank"), vec_id.alias("vec_id"), "score", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy")
