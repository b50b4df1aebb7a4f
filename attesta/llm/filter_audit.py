"""What each of several filters removes in every order of them, with copies found by routing texts by fingerprint.

An RDD of texts is partitioned by xxhash: the rows of one fingerprint meet in one partition, where a chain keeps each
different text in full with the smallest id that has it; rows of greater ids are emitted as copies. Before that, each task
keeps a chain of its own, so that a text goes over the network once for a task, however many copies it has there. Rows
then become vectors of counts by failure mask, merged by combineByKey, and every order of the filters is read off these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import pick

FILTERS = "ABCDE"
_UPPER = bytes(range(65, 91))
#: Bytes of different texts that a task keeps at a time while it looks for its own copies.
HELD = 32 << 20
#: Bytes of text for which there is a partition of fingerprints.
ROUTED = 32 << 20

#: A copy that is known as such travels without a text, under a key of its own.
Row = tuple[int | None, str, int]  # doc_id, part, mask of A to D


def mask_of(text: str) -> int:
    """The bits of A to D: 1 where the text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: at x20 and x09 to x0D only
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * upper > 3 * len(text)) << 2 | any(c in text for c in "#$%&*|") << 3


def fingerprint(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class Chains:
    """By fingerprint a chain of [text, smallest id, its rows]: several rows may share the smallest id. Null ids are no id:
    they are never copies, nor does a text begin with them."""

    def __init__(self):
        self.by_print: dict[int, list[list]] = {}
        self.held = 0

    def add(self, key: int, text: str, doc_id: int | None, rows: list[Row]) -> list[Row]:
        """Takes rows of a text; gives those that are copies of a smaller id now."""
        chain = self.by_print.setdefault(key, [])
        for link in chain:
            if link[0] == text:
                break
        else:
            chain.append([text, doc_id, list(rows)])
            self.held += len(text)
            return []
        if doc_id == link[1]:
            link[2] += rows
            return []
        if link[1] < doc_id:
            return rows
        gone, link[1], link[2] = link[2], doc_id, list(rows)
        return gone


def route(rows: Iterator, fingerprint_of=fingerprint, held: int = HELD) -> Iterator[tuple[int, tuple]]:
    """Rows (doc_id, text, part) of one task to (key, (text, doc_id, rows)); the copies among them to (key, (None, copy, None))."""
    chains = Chains()
    decided = lambda r: (hash((r[0], r[2])), (None, r, None))

    def emptied() -> Iterator[tuple[int, tuple]]:
        for key, chain in chains.by_print.items():
            for text, doc_id, own in chain:
                yield key, (text, doc_id, own)

    for doc_id, text, part in rows:
        text, row = text or "", (doc_id, part or "", mask_of(text or ""))
        if doc_id is None:
            yield xxhash.xxh64_intdigest(row[1]) ^ len(text), (None, (*row, 0), None)
            continue
        for copy in chains.add(fingerprint_of(text), text, doc_id, [row]):
            yield decided((*copy, 1))
        if chains.held > held:
            yield from emptied()
            chains = Chains()
    yield from emptied()


def settle(routed: Iterator[tuple[int, tuple]]) -> Iterator[tuple[int | None, str, int]]:
    """The rows of a partition, in order of their fingerprints, to (doc_id, part, mask of all filters)."""
    chains, now = Chains(), None

    def kept() -> Iterator[tuple]:
        for chain in chains.by_print.values():
            for _, _, own in chain:
                yield from own

    for key, (text, doc_id, rows) in routed:
        if text is None:
            yield doc_id[0], doc_id[1], doc_id[2] | doc_id[3] << 4
            continue
        if key != now:
            yield from kept()
            chains, now = Chains(), key
        for i, part, mask in chains.add(key, text, doc_id, rows):
            yield i, part, mask | 16
    yield from kept()


def masks(docs: DataFrame, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", fingerprint_of=fingerprint) -> DataFrame:
    """doc_id, part, mask (bit i: the text fails filter i of ABCDE), a row for each row of docs."""
    rows = pick(docs, id_col, text_col, part_col).toDF("doc_id", "text", "part")
    rows = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("part").cast("string"))
    if partitions is None:
        volume = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(1 + volume // ROUTED, docs.sparkSession.sparkContext.defaultParallelism)
    rows = rows.rdd
    routed = rows.mapPartitions(partial(route, fingerprint_of=fingerprint_of))
    # Sorted by Spark's external sorter: one fingerprint's chain is in memory at a time, whatever a partition holds.
    settled = routed.repartitionAndSortWithinPartitions(partitions, partitionFunc=lambda key: key).mapPartitions(settle)
    return docs.sparkSession.createDataFrame(settled, "doc_id long, part string, mask int", verifySchema=False)


def mask_counts(marked: RDD) -> RDD:
    """Rows (part, mask, good, toxic) to (part, counts), counts[mask] = (documents, good, toxic)."""

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        counts[row[0]] += (1, row[1], row[2])
        return counts

    return marked.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: add(np.zeros((1 << len(FILTERS), 3), dtype=np.int64), row), add, lambda a, b: a + b)


def orders(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """All orders of the filters and their steps, from one part's counts by mask."""
    mask = np.arange(len(counts))
    found, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = np.zeros(len(mask), dtype=bool)  # removed by an earlier filter
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            fails = mask & bit > 0
            here = fails & ~before
            n, good, toxic = (int(v) for v in counts[here].sum(axis=0))
            shapley[f] += n
            redundant = int(counts[fails & before, 0].sum())
            before |= fails
            found.append((part, "".join(order), step, int(counts[~before, 0].sum()), n, redundant, int(counts[bit, 0]), good, toxic, f))
    for *row, f in found:
        yield (*row, shapley[f])


_AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def filter_audit(docs: DataFrame, labels: DataFrame, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", fingerprint_of=fingerprint) -> DataFrame:
    """For each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A: under 200 words; B: fewer than half of the words are different; C: over 3 % of the characters are A-Z; D: holds one
    of #$%&*|; E: a smaller doc_id has the same text. A null text counts as empty, a null part as the empty string. Rows
    with the same smallest id and text are no copies of each other. A null doc_id is never a copy, makes none, and has no
    labels. Of repeated labels of an id one suffices. An empty table gives no rows. Other columns are ignored. Texts of
    any length are compared in full.
    """
    found = masks(docs, partitions, id_col, text_col, part_col, fingerprint_of)
    own = pick(labels, "doc_id", "quality", "toxic").where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    own = own.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    # Rows without an id meet no label; keys of their own keep them out of one task.
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id() % 1024 + 1).otherwise(0)
    found = found.withColumns({"key": F.coalesce("doc_id", F.lit(0)), "spread": spread})
    marked = found.join(own.withColumn("none", F.lit(0).cast("long")), (F.col("key") == F.col("id")) & (F.col("spread") == F.col("none")), "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    counts = mask_counts(marked.rdd)
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda x: orders(*x)), _AUDIT, verifySchema=False)
