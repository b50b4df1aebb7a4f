"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition sorts the digests of its rows into a run with one entry per digest. The entries then move through
log_f(P) rounds over P = f**k nodes: in round r the f nodes whose numbers differ only in their r-th base-f digit
exchange runs so that each keeps one f-th of what they hold, chosen by the r-th digit of the digest's own node. Each
node merges the f sorted runs it gets and retains, for each digest, the smallest identifier and the number of rows.
After the last round every node holds one P-th of the digests, merged from all partitions; no level has a node that
gathers everything, and a digest with a third of all rows is one entry per node at every level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import SPACE, as_before, cut, pick, place_of, placed, through_arrow

#: Runs merged at once, and entries that a node should hold at most.
FAN_IN = 8
ENTRIES_PER_NODE = 500_000
BROADCAST_ROWS = 500_000

_RUN = "node int, digest binary, fingerprint long, chars long, keep_id long, row long, ties long, n long"
_KEY = ("digest", "fingerprint", "chars")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _merge(table: pa.Table) -> pa.Table:
    """One sorted run of all runs in table: an entry for each digest, verified by a second hash and the length."""
    if not table.num_rows:
        return table
    table = table.take(pc.sort_indices(table, [(k, "ascending") for k in (*_KEY, "keep_id", "row")], null_placement="at_end")).combine_chunks()
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in _KEY:
        col = table[k]
        new[1:] |= pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)).to_numpy()
    starts = np.flatnonzero(new)
    ids = table["keep_id"]
    group = np.cumsum(new) - 1
    lead = ids.take(pa.array(starts[group]))
    same = pc.or_kleene(pc.equal(ids, lead), pc.and_(pc.is_null(ids), pc.is_null(lead))).fill_null(False).to_numpy(zero_copy_only=False)
    out = table.take(pa.array(starts))
    for name, values in (("ties", np.where(same, table["ties"].to_numpy(), 0)), ("n", table["n"].to_numpy())):
        out = out.set_column(out.schema.get_field_index(name), name, pa.array(np.add.reduceat(values, starts)))
    return out


def _runs(batches: Iterator[pa.RecordBatch], target) -> Iterator[pa.RecordBatch]:
    """Merges what a task gets, compacting whenever the buffer has doubled, and names the node each entry goes to."""
    held: list[pa.Table] = []
    rows, limit = 0, 200_000
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        rows += b.num_rows
        if rows >= limit:
            held = [_merge(pa.concat_tables(held))]
            rows = held[0].num_rows
            limit = max(limit, 2 * rows)
    if held:
        run = _merge(pa.concat_tables(held))
        run = run.set_column(run.schema.get_field_index("node"), "node", pa.array(target(run), pa.int32()))
        yield from run.to_batches(max_chunksize=50_000)


def _home(run: pa.Table, nodes: int) -> np.ndarray:
    """The node where a digest ends: its first eight bytes modulo the number of nodes."""
    data = b"".join(x[:8] for x in run["digest"].to_pylist())
    return (np.frombuffer(data, ">u8") % np.uint64(nodes)).astype(np.int64)


def tree_merge(runs: DataFrame, fan_in: int, levels: int) -> DataFrame:
    """runs: rows of _RUN in any partitions. Returns an entry for each distinct key."""
    nodes = fan_in**levels

    def sender(level: int):
        step = fan_in**level

        def to(run: pa.Table) -> np.ndarray:
            if level == 0:
                at = np.full(run.num_rows, TaskContext.get().partitionId() % nodes, np.int64)
            else:
                at = run["node"].to_numpy().astype(np.int64)
            home = _home(run, nodes)
            return at + (home // step % fan_in - at // step % fan_in) * step

        return lambda batches: _runs(batches, to)

    for level in range(levels):
        runs = through_arrow(runs, sender(level), _RUN).repartitionById(nodes, F.col("node"))
    return through_arrow(runs, lambda batches: _runs(batches, lambda run: run["node"].to_numpy()), _RUN)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    d = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return d.select("doc_id", "row", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), F.xxhash64("text").alias("fingerprint"), F.length("text").cast("long").alias("chars"))


def groups(base: DataFrame, fan_in: int = FAN_IN, entries_per_node: int = ENTRIES_PER_NODE) -> DataFrame:
    """An entry for each distinct text of what digests() gave: its key, keep_id, the row that stays, ties, n."""
    n = max(1, base.count())
    levels = max(2, math.ceil(math.log(max(1, n / entries_per_node), fan_in)))
    first = base.select(F.lit(0).alias("node"), *_KEY, F.col("doc_id").alias("keep_id"), "row", F.lit(1).cast("long").alias("ties"), F.lit(1).cast("long").alias("n"))
    return tree_merge(first, fan_in, levels)


def _small(df: DataFrame) -> DataFrame:
    """Up to BROADCAST_ROWS of some 90 bytes go to every task, so that a digest of very many rows needs no task of its own; more are joined."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as an empty one; empty texts are equal to each other. Of rows with the same smallest id one
    stays (the first read); null ids come after all others. An empty table gives an empty one. Other columns are ignored.
    """
    base = cut(digests(docs, id_col, text_col))
    many = cut(groups(base).where("n > 1").select(*(F.col(k).alias(f"g_{k}") for k in _KEY), "keep_id", F.col("row").alias("g_row"), "n"))
    on = [F.col(k) == F.col(f"g_{k}") for k in _KEY]
    return base.join(_small(many), on, "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("g_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that exact_dedup keeps, with docs' columns.

    A null text counts as an empty one. Of rows with the same smallest id the first read stays; null ids come after all
    others. An empty table gives an empty one. Other columns, also of clashing names, are kept as they are.
    """
    base = cut(digests(docs))
    many = cut(groups(base).where("n > 1").select(*(F.col(k).alias(f"g_{k}") for k in _KEY), F.col("keep_id").alias("g_id"), F.col("row").alias("g_row"), "ties"))
    pairs = base.join(_small(many), [F.col(k) == F.col(f"g_{k}") for k in _KEY])
    same = F.col("doc_id").eqNullSafe(F.col("g_id"))
    # Rows that share the smallest id need their row number; all others go by id and digest.
    gone = pairs.where(~same | ((F.col("ties") > 1) & (F.col("row") != F.col("g_row"))))
    gone = cut(gone.select(F.col("doc_id").alias("x_id"), F.col("digest").alias("x_digest"), F.when(same, F.col("row")).alias("x_row")).distinct())
    rows = placed(docs).withColumns({"row": F.monotonically_increasing_id(), "digest": F.unhex(F.sha2(normalised(place_of(docs, "text")), 256))})
    hit = place_of(docs, "doc_id").cast("long").eqNullSafe(F.col("x_id")) & (F.col("digest") == F.col("x_digest")) & (F.col("x_row").isNull() | (F.col("row") == F.col("x_row")))
    return as_before(rows.join(_small(gone), hit, "left_anti"), docs)
