"""Mixing sources to target weights by entropy balancing.

A document's rate r says how many copies of it the mix takes on average, from 0 to max_copies. Among all rates that meet
each source's token target, entropy balancing takes those nearest to one copy each in relative entropy, summed over
documents. Their form is known: r = min(max_copies, exp(a * size / mean size of the source)), with one dual variable
`a` for each source. The dual is convex, and its Newton steps need sums over documents only. As a rate depends on a
document's source and size alone, they run over the distributed table of (source, size) counts; each step is one
aggregation of it, and no table of documents or sources reaches the driver.

Rates become copies by systematic rounding in order of size: copies = floor(after) - floor(before), where before and
after are the sums of rates up to a document and with it. Neighbours have nearly equal sizes, so what a source takes
differs from its target by about half its largest document at most; a copy more or less of a few documents of falling
size then brings it as near as their sizes allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import as_before, cut, pick, place_of, placed, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
STEPS = 40
#: Parts of the documents of one source and size, numbered on their own.
PARTS = 1024
#: Rows of three numbers that are sent to every task so that texts need not move; more are joined.
BROADCAST_ROWS = 1_000_000


def token_targets(totals: DataFrame, weights=WEIGHTS, share=SHARE, most=MAX_COPIES) -> DataFrame:
    """totals (source, source_size): a row for each source. Adds target.

    Sources take weights in turn in their order, nulls last. The level t with sum of min(most * size, weight * t) =
    share * all is found in order of most * size / weight: a source is at its limit if t as computed from it and the
    sources after it is not below its own limit.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cyclic = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", cyclic).withColumn("most", F.col("source_size") * most)
    ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, on = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = F.sum("source_size").over(Window.partitionBy())
    t = t.withColumn("level", (everything * share - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(on))
    t = t.withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    # Full sources come first; the level of the first other one holds for all others.
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(Window.partitionBy())
    return t.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(level["level"] * F.col("weight")).alias("target"))


def tilted(a: Column, size: Column, mean: Column, most: int = MAX_COPIES) -> Column:
    """exp(a * size / mean), at most `most`."""
    return F.exp(F.least(a * size / mean, F.log(F.lit(float(most)))))


def balance(cells: DataFrame, targets: DataFrame, most: int = MAX_COPIES, steps: int = STEPS) -> DataFrame:
    """cells (source, size > 0, n), targets (source, source_size, target). Returns source, a: the dual variables.

    Newton steps that leave the interval known to hold the solution, or come from a vanishing slope, halve it instead.
    """
    cells = cells.withColumn("source_key", _key(F.col("source")))
    mean = cells.groupBy("source_key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = targets.where("source_size > 0").withColumn("source_key", _key(F.col("source"))).join(mean, "source_key")
    # At the limit every rate is `most`; no finite variable gives less than all of it.
    state = cut(state.select("source_key", "target", "mean", F.lit(0.0).alias("a"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"), (F.col("target") >= F.col("source_size") * most).alias("done")))
    for step in range(steps):
        r = tilted(F.col("a"), F.col("size"), F.col("mean"), most)
        got = F.sum(F.col("n") * F.col("size") * r).alias("got")
        slope = F.sum(F.when(r < most, F.col("n") * F.col("size") * F.col("size") / F.col("mean") * r).otherwise(0.0)).alias("slope")
        now = cells.join(state.where("NOT done"), "source_key").groupBy("source_key").agg(got, slope)
        s = state.join(now, "source_key", "left")
        over = F.col("got") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("a")), F.when(over, F.col("a")).otherwise(F.col("hi"))
        newton = F.col("a") + F.try_divide(F.col("target") - F.col("got"), F.col("slope"))
        wide = F.when(over, F.when(F.col("lo") > -1e9, (F.col("lo") + F.col("a")) / 2).otherwise(F.least(F.col("a") * 2, F.col("a") - 1))).otherwise(F.when(F.col("hi") < 1e9, (F.col("hi") + F.col("a")) / 2).otherwise(F.greatest(F.col("a") * 2, F.col("a") + 1)))
        inside = newton.isNotNull() & (newton > lo) & (newton < hi) & (F.abs(newton - F.col("a")) <= 4 * (1 + F.abs(F.col("a"))))
        near = F.abs(F.col("got") - F.col("target")) <= F.greatest(F.lit(0.5), F.col("target") * 1e-7)
        live = ~F.col("done")
        state = cut(s.select("source_key", "target", "mean", F.when(live & ~near, F.when(inside, newton).otherwise(wide)).otherwise(F.col("a")).alias("a"), F.when(live, lo).otherwise(F.col("lo")).alias("lo"), F.when(live, hi).otherwise(F.col("hi")).alias("hi"), F.when(live, near).otherwise(True).alias("done")))
        if step % 2 and state.where("NOT done").isEmpty():
            break
    else:
        raise ArithmeticError(f"no solution in {steps} steps")
    # Rounded, as sums in another order differ in their last bits, and reruns have to agree.
    return state.select("source_key", F.round("a", 9).alias("a"), "mean")


def _key(source: Column) -> Column:
    """Null and the empty text are different sources."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def entropy_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies.

    size is the number of words (null: 0), taken = copies * size with copies from 0 to most. Documents without words
    take nothing; a source without words has target 0. Null is a source of its own, after all others. Repeated rows
    are rows of their own, of equal rate. An empty table gives an empty one. Other columns are ignored.
    """
    rows = pick(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    rows = rows.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    return mix_sizes(cut(rows), weights, share, most).drop("row")


def take_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, source and any others) as often as the mix takes them, with docs' columns.

    Null and empty texts are never taken. Repeated rows are rows of their own, each with its own copies. Null is a source
    of its own. An empty table gives an empty one. Other columns, also of clashing names, are kept as they are.
    """
    numbered = placed(docs).withColumn("row", F.monotonically_increasing_id())
    rows = numbered.select(place_of(docs, "doc_id").alias("doc_id"), place_of(docs, "source").alias("source"), F.size(words(place_of(docs, "text"))).cast("long").alias("size"), "row")
    copies = cut(mix_sizes(cut(rows)).where("copies > 0").select("row", "copies"))
    hint = F.broadcast if copies.count() <= BROADCAST_ROWS else lambda x: x
    taken = numbered.join(hint(copies), "row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return as_before(taken, docs)


def mix_sizes(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MAX_COPIES) -> DataFrame:
    """As entropy_mix, of rows (doc_id, source, size, row); row tells rows that repeat an id apart."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    parts = rows.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    cells = cut(parts.groupBy("source", "size").agg(F.sum("n").alias("n")))
    targets = cut(token_targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    duals = balance(cells.where("size > 0"), targets, most)
    known = targets.withColumn("source_key", _key(F.col("source"))).join(duals, "source_key", "left").drop("source")
    rate = F.when(F.col("target") >= F.col("source_size") * most, F.lit(float(most))).otherwise(tilted(F.col("a"), F.col("size"), F.col("mean"), most))
    rated = cells.withColumn("source_key", _key(F.col("source"))).join(known, "source_key").withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
    # Sums of rates: over the sizes of a source, the parts of a size, the documents of a part.
    by_size = Window.partitionBy("source_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("below", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(by_size), F.lit(0.0)))
    rated = rated.select("source_key", "size", "source_size", "target", "rate", "below")
    by_part = Window.partitionBy("source_key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = parts.withColumn("source_key", _key(F.col("source"))).withColumn("first", F.coalesce(F.sum("n").over(by_part), F.lit(0))).select("source_key", "size", "part", "first")
    firsts = firsts.join(rated, ["source_key", "size"])
    in_part = Window.partitionBy("source_key", "size", "part").orderBy("doc_id", "row")
    out = rows.withColumn("source_key", _key(F.col("source"))).withColumn("k", F.row_number().over(in_part)).join(firsts, ["source_key", "size", "part"])
    to = lambda k: F.floor(F.col("below") + (F.col("first") + k) * F.col("rate") + 0.5 + 1e-9)  # noqa: E731  # the tiny part absorbs the error of the sums
    copies = F.when(F.col("size") > 0, F.least(to(F.col("k")) - to(F.col("k") - 1), F.lit(most))).otherwise(0).cast("long")
    out = cut(out.select("doc_id", "row", "source_key", "size", "part", "k", "source_size", "target", copies.alias("copies")))
    changes = _corrections(out, most)
    out = out.join(changes, ["source_key", "size", "part", "k"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0)))
    return out.select("doc_id", "row", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _corrections(rounded: DataFrame, most: int) -> DataFrame:
    """One copy more or less of a few documents of each source, so that what rounding left is as small as they allow.

    The candidates are the largest and the smallest document of each power of two of sizes, under sixty a source;
    from the largest on, each is taken that fits into what is still missing or too much.
    """
    left = rounded.groupBy("source_key").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
    # The ends of both directions are found before the join, so that no document meets its source's one row.
    at, more, less = F.struct("size", "part", "k"), F.col("copies") < most, F.col("copies") > 0
    ends = rounded.where("size > 0").groupBy("source_key", F.floor(F.log2("size")).alias("power"))
    ends = ends.agg(*(f(F.when(can, at)).alias(name) for can, way in ((more, "more"), (less, "less")) for f, name in ((F.max, f"high_{way}"), (F.min, f"low_{way}"))))
    end = lambda name: F.when(F.col("left") > 0, F.col(f"{name}_more")).otherwise(F.col(f"{name}_less")).alias(name)
    ends = ends.join(left, "source_key").select("source_key", "left", end("high"), end("low")).where("high IS NOT NULL")
    per_source = ends.groupBy("source_key").agg(F.max("left").alias("left"), F.reverse(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("high", "low")))))).alias("can"))
    start = F.struct(F.abs("left").alias("left"), F.slice("can", 1, 0).alias("taken"))
    nearer = lambda s, c: c["size"] <= s["left"]
    step = lambda s, c: F.struct(F.when(nearer(s, c), s["left"] - c["size"]).otherwise(s["left"]).alias("left"), F.when(nearer(s, c), F.array_append(s["taken"], c)).otherwise(s["taken"]).alias("taken"))
    picked = per_source.select("source_key", F.signum("left").cast("long").alias("change"), F.explode(F.aggregate("can", start, step)["taken"]).alias("c"))
    return picked.select("source_key", "c.*", "change")
