"""Balanced label propagation: documents linked by equal texts gather in shards of even size.

Large groups of equal texts are placed first, largest first: whole into the fullest shard that can hold them, and only
what no shard can hold is cut, into as few shards as possible. They are counted in blocks of bounded size, of which the
driver gets the counts (a large group has a part of a shard's rows, so their number is bounded), and stay where they are.

The links of each other group form a star: each member is linked to the first one, its hub. They start in proportion to
the room that large groups left. Each round moves hubs to the shard most of their members are in, then
members towards their hub's shard, both by joins on the block. A target shard has a quota, what linked documents may
still enter it; where more want in, each of them is let in with the probability that fills the quota (by a hash of
document and round, so that reruns agree). Only shard-by-shard counts reach the driver. Documents without links, and
those that a quota left over, fill the shards up to exactly even row counts in the end.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import cut, pick

SHARDS = 24
ROUNDS = 4
#: A group is large beyond this part of a shard's capacity, or beyond this many rows.
BLOCK_PART = 4
BLOCK_ROWS = 100_000
#: A block of a large group is this part of a shard's capacity, and no more rows than that; shards are filled by blocks.
FINE_PART = 64
#: Rows that a task numbers in the last step.
NUMBERED_ROWS = 20_000


def _unit(*cols: Column) -> Column:
    """A hash from 0 to 1."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def place(groups: list[list[int]], shards: int, capacity: int) -> tuple[list[list[int]], list[int]]:
    """groups: the rows of each one's blocks. Returns their blocks' shards, and the room left in each shard.

    What is left of a group goes whole into the fullest shard that can hold it, else as much of it as fits into the
    emptiest one; the largest rest is always next.
    """
    room, places = [capacity] * shards, [[0] * len(g) for g in groups]
    rest = [(-sum(g), i, list(range(len(g)))) for i, g in enumerate(groups)]
    heapq.heapify(rest)
    while rest:
        n, i, blocks = heapq.heappop(rest)
        fits = [s for s in range(shards) if room[s] >= -n]
        s = min(fits, key=lambda s: room[s]) if fits else max(range(shards), key=lambda s: room[s])
        left = []
        for b in blocks:
            if room[s] >= groups[i][b]:
                places[i][b] = s
                room[s] -= groups[i][b]
            else:
                left.append(b)
        if len(left) == len(blocks):  # no shard has room for any block: the last step deals out what is too much
            b = left.pop()
            places[i][b] = s
            room[s] -= groups[i][b]
        if left:
            heapq.heappush(rest, (-sum(groups[i][b] for b in left), i, left))
    return places, room


def place_large(rows: DataFrame, key: str, shards: int, capacity: int) -> tuple[DataFrame, list[int]]:
    """Adds part and placed, the block and shard of a row of a large group (else null); and the room left in each shard."""
    limit, fine = max(2, min(BLOCK_ROWS, capacity // BLOCK_PART)), max(1, min(BLOCK_ROWS, capacity // FINE_PART))
    spark = rows.sparkSession
    # A row that is in no group of over `limit` rows doesn't count, so there are rows / limit groups at most.
    large = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()
    large = sorted(((bytes(r[0]), -(-r[1] // fine)) for r in large))
    if not large:
        return rows.withColumns({"part": F.lit(None).cast("long"), "placed": F.lit(None).cast("int")}), [capacity] * shards
    known = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(large)], "group int, k binary, blocks int")
    number = F.pmod(F.xxhash64("doc_id", "row"), F.col("blocks")).cast("int")
    sizes = [[0] * n for _, n in large]
    for r in rows.join(F.broadcast(known), F.col(key) == F.col("k")).groupBy("group", number.alias("b")).agg(F.count("*").alias("n")).collect():
        sizes[r["group"]][r["b"]] = r["n"]
    places, room = place(sizes, shards, capacity)
    known = spark.createDataFrame([(k, n, p) for (k, n), p in zip(large, places, strict=True)], "k binary, blocks int, places array<int>")
    out = rows.join(F.broadcast(known), F.col(key) == F.col("k"), "left")
    return out.select(*rows.columns, F.when(F.col("k").isNotNull(), F.xxhash64(key, number)).alias("part"), F.get("places", number).alias("placed")), room


def links(rows: DataFrame, key: str) -> DataFrame:
    """Adds block (null for a row that is alone) and hub, whether it is its block's first. rows needs doc_id, row, key."""
    first = rows.groupBy(key).agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("members")).where("members > 1")
    first = first.select(F.col(key).alias("k"), F.col("first.row").alias("r"))
    out = rows.join(first, F.col(key) == F.col("k"), "left")
    return out.select(*rows.columns, F.when(F.col("k").isNotNull(), F.xxhash64(key)).alias("block"), F.coalesce(F.col("r") == F.col("row"), F.lit(False)).alias("hub"))


def _start(unit: Column, room: list[int]) -> Column:
    """A shard by a number from 0 to 1, in proportion to the shards' room."""
    room = [max(0, r) for r in room]
    room = room if sum(room) else [1] * len(room)
    shard, below = F, 0
    for s, r in enumerate(room[:-1]):
        below += r
        shard = shard.when(unit < below / sum(room), s)
    return shard.otherwise(len(room) - 1).cast("int") if len(room) > 1 else F.lit(0)


def _allowed(wanting: DataFrame, loads: dict[int, int], room: list[int]) -> Column:
    """The probability with which a move to shard `want` is let in, from a table of at most shards rows."""
    demand = {r["want"]: r["n"] for r in wanting.groupBy("want").agg(F.count("*").alias("n")).collect()}
    share = {s: min(1.0, max(0, room[s] - loads.get(s, 0)) / n) for s, n in demand.items()}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for s, v in share.items() for x in (s, v))), F.col("want")), F.lit(0.0)) if share else F.lit(0.0)


def propagate(linked: DataFrame, room: list[int], rounds: int = ROUNDS) -> DataFrame:
    """linked: doc_id, row, block, hub, shard. Returns it with shards that follow the links, room by shard kept."""
    for k in range(rounds):
        for hubs in (True, False):
            loads = {r["shard"]: r["n"] for r in linked.groupBy("shard").agg(F.count("*").alias("n")).collect()}
            if hubs:  # a block's most frequent shard, the hub's own on ties
                votes = linked.groupBy("block", "shard").agg(F.count("*").alias("n"), F.max("hub").alias("own"))
                best = votes.groupBy("block").agg(F.max(F.struct("n", "own", -F.col("shard"))).alias("b")).select("block", (-F.col("b.col3")).alias("want"))
            else:
                best = linked.where("hub").select("block", F.col("shard").alias("want"))
            wish = linked.join(best, "block")
            moving = (F.col("hub") == F.lit(hubs)) & (F.col("want") != F.col("shard"))
            let_in = _allowed(wish.where(moving), loads, room)
            # A block as a whole comes first: the hash of the block decides for all its members.
            go = moving & (_unit(F.col("block"), F.lit(k)) < let_in)
            linked = cut(wish.select("doc_id", "row", "block", "hub", F.when(go, F.col("want")).otherwise(F.col("shard")).alias("shard")))
    return linked


def even(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """rows: shard, block, large and others. Adds slot and changes shard so that counts differ by one at most.

    Rows are numbered in each shard, large groups first, then linked ones, block by block; numbers from the shard's target on overflow
    into the free slots of other shards. Numbering takes two steps, over buckets and in a bucket.
    """
    buckets = max(1, total // NUMBERED_ROWS // shards)
    place = F.xxhash64(F.coalesce("block", F.xxhash64("doc_id", "row")))
    bucket = F.when(F.col("large"), 0).when(F.col("block").isNotNull(), buckets).otherwise(2 * buckets) + F.pmod(place, F.lit(buckets))
    rows = cut(rows.withColumns({"place": place, "bucket": bucket}))
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    have = {r["shard"]: r["n"] for r in sizes.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    inside = Window.partitionBy("shard", "bucket").orderBy("place", "block", "doc_id", "row")
    numbered = rows.withColumn("k", F.row_number().over(inside) - 1).join(sizes.drop("n"), ["shard", "bucket"]).withColumn("k", F.col("k") + F.col("before"))
    target = [total // shards + (s < total % shards) for s in range(shards)]
    at = lambda xs: F.element_at(F.array(*(F.lit(x).cast("long") for x in xs)), F.col("shard") + 1)
    spilled, free, n_spilled, n_free = [], [], 0, 0
    for s in range(shards):
        spilled.append(n_spilled)
        n_spilled += max(0, have.get(s, 0) - target[s])
        if gap := target[s] - have.get(s, 0):
            if gap > 0:
                free.append((n_free, s, have.get(s, 0)))
                n_free += gap
    numbered = numbered.withColumn("o", F.when(F.col("k") >= at(target), F.col("k") - at(target) + at(spilled)))
    shard, slot = F.col("shard"), F.col("k")
    for lo, s, first in free:  # the last that applies holds
        shard = F.when(F.col("o") >= lo, F.lit(s)).otherwise(shard)
        slot = F.when(F.col("o") >= lo, F.col("o") - lo + first).otherwise(slot)
    return numbered.withColumns({"to": shard, "slot": slot}).drop("shard", "k", "before", "o", "bucket", "place").withColumnRenamed("to", "shard")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('rows': counts differ by one at most), shard, slot, grown_shard.

    size: UTF-8 bytes (null: none) plus 8. Null texts equal empty ones. Repeated rows and null ids are rows like
    others. An empty table gives an empty one. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )
    rows = cut(rows)
    total = rows.count()
    capacity = max(1, total // shards)
    dealt, room = place_large(rows, "key", shards, capacity)
    known = links(dealt.where("placed IS NULL").drop("part", "placed"), "key").drop("key")
    known = cut(known.withColumn("shard", _start(_unit(F.coalesce("block", F.xxhash64("doc_id", "row")), F.lit("start")), room)))
    linked = known.where("block IS NOT NULL").select("doc_id", "row", "block", "hub", "shard")
    # Members start where documents without links would: the rounds bring them together.
    own = _start(_unit(F.col("doc_id"), F.col("row")), room)
    linked = propagate(cut(linked.withColumn("shard", F.when(F.col("hub"), F.col("shard")).otherwise(own))), room, rounds)
    moved = linked.select(F.col("row").alias("r"), F.col("shard").alias("moved"))
    settled = known.join(moved, F.col("row") == F.col("r"), "left").withColumn("shard", F.coalesce("moved", "shard")).drop("r", "moved", "hub")
    settled = settled.withColumn("large", F.lit(False))
    placed = dealt.where("placed IS NOT NULL").select(*settled.columns[:-3], F.col("part").alias("block"), F.col("placed").alias("shard"), F.lit(True).alias("large"))
    settled = settled.unionByName(placed)
    out = even(settled, shards, total)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
