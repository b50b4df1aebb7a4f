"""Titles that are similar by the ratio of their matching blocks, found without loss.

Matching blocks are common to both titles and in order, so their characters are a common subsequence: twice the length of
the longest one, over both lengths, is never less than the ratio. Titles meet in blocks. What the steps from one common
character to the next can count for leaves most pairs out (Lengths), then the longest common subsequence, which a machine
word computes for 64 characters at once over many pairs; only pairs that still reach the least similarity are compared by difflib. Each task keeps the best
candidate of a title, so that no pairs leave it.
"""

from __future__ import annotations

import bisect
import difflib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.storage import forget, partitions, stored

#: Titles of a pass (they are broadcast, some 200 bytes each), and of a block.
PASS, BLOCK = 20_000, 4096
#: Machine words of a batch of titles and a block, in which a step is looked up at once.
WORDS = 8192
#: Pairs of which common subsequences are looked for at once.
PAIRS = 50_000
#: What a title counts as at least when over half of one begins the other, and from what length on.
BEGINS, SHORTEST = 0.9, 5
#: What an author of another name and a year that differs by over one cost.
OTHER_AUTHOR, OTHER_YEAR = 0.2, 0.1
#: Similarities are rounded to four places, so a ratio this much below a limit can still reach it.
ROUNDING = 5.1e-5


def _codes(titles: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all titles in a row, and their lengths."""
    lengths = np.fromiter((len(t) for t in titles), dtype=np.int64, count=len(titles))
    return np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), lengths


class Alphabet:
    """Numbers for the characters of the titles of a pass; all others are 0 and match nothing."""

    def __init__(self, titles: list[str]):
        self.known = np.unique(_codes(titles)[0])
        self.size = len(self.known) + 1

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, codes)
        return np.where((at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == codes), at + 1, 0) if len(self.known) else np.zeros(len(codes), dtype=np.int64)


def _ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def _half(p: str) -> str:
    return p[: len(p) // 2 + 1]


def begins(a: str, b: str) -> bool:
    """Whether over half of one begins the other."""
    return (len(a) >= SHORTEST and b.startswith(_half(a))) or (len(b) >= SHORTEST and a.startswith(_half(b)))


class Block:
    """Titles, the shorter first, as columns of character numbers."""

    def __init__(self, titles: list[str], alphabet: Alphabet):
        order = sorted(range(len(titles)), key=lambda i: len(titles[i]))
        self.order, self.titles, self.alphabet = np.array(order, dtype=np.int64), [titles[i] for i in order], alphabet
        codes, self.lengths = _codes(self.titles)
        self.numbers, n, longest = alphabet.numbers(codes), len(titles), int(self.lengths.max(initial=0))
        self.row = np.repeat(np.arange(n), self.lengths)
        self.column = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.columns = np.zeros((longest, n), dtype=np.int64)
        self.columns[self.column, self.row] = self.numbers

    def steps(self, own: "Lengths") -> tuple[np.ndarray, np.ndarray]:
        """Titles of the block that have a pair of characters at about a place: next to each other, or with at most one between
        them. A row a pair and place (as Lengths numbers them), a bit a title."""
        near, next_ = (np.zeros((own.buckets * own.codes, -(-len(self.titles) // 64) * 64), dtype=bool) for _ in range(2))
        m = self.lengths
        back = np.floor(own.longest - own.least * (own.longest + m) / 2 + 1e-9).astype(np.int64)
        ahead = np.floor(m - own.least * (own.shortest + m) / 2 + 1e-9).astype(np.int64)
        for gap, tables in ((2, (near,)), (1, (near, next_))):
            at = np.flatnonzero(self.column + gap < m[self.row])
            at = at[(self.numbers[at] > 0) & (self.numbers[at + gap] > 0)]
            code, row, j = own.code(self.numbers[at], self.numbers[at + gap]), self.row[at], self.column[at]
            first = np.maximum(j - ahead[row], 0) // own.width
            last = np.minimum(np.floor_divide(j + back[row], own.width), own.buckets - 1)
            for t in range(int((last - first).max(initial=-1)) + 1):
                some = first + t <= last
                for table in tables:
                    table[(first[some] + t) * own.codes + code[some], row[some]] = True
        return tuple(np.packbits(table, axis=1, bitorder="little").view("<u8") for table in (near, next_))

    def least_steps(self, n: int, least: float) -> np.ndarray:
        """What the steps of a title of n characters have to count for at least, for each title of the block."""
        common = np.ceil(least * (n + self.lengths) / 2 - 1e-9).astype(np.int64)
        return np.where(common <= np.minimum(n, self.lengths), np.maximum(4 * common - 2 - n - self.lengths, 0), 1 << 15)

    def common(self, own: "Lengths", titles: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The lengths of the longest common subsequences of pairs of a title, by its place in own, and a row (bit vectors of Hyyro)."""
        order = np.argsort(rows, kind="stable")
        titles, rows = titles[order], rows[order]
        used, place = np.unique(titles, return_inverse=True)
        words, size = -(-own.longest // 64), self.alphabet.size
        masks = np.zeros(len(used) * words * size, dtype=np.uint64)
        some = [own.numbers[i] for i in used.tolist()]
        ends = np.cumsum(n := np.array([len(x) for x in some]))
        at = np.arange(ends[-1]) - np.repeat(ends - n, n)
        np.bitwise_or.at(masks, (np.repeat(np.arange(len(used)), n) * words + at // 64) * size + np.concatenate(some), np.uint64(1) << (at % 64).astype(np.uint64))
        lengths, base = self.lengths[rows], place * (words * size)
        v = np.full((words, len(rows)), ~np.uint64(0))
        for j, a in enumerate(np.searchsorted(lengths, np.arange(int(lengths[-1])), side="right").tolist()):  # shorter titles are at their ends
            at, carry = base[a:] + self.columns[j, rows[a:]], None
            for w in range(words):
                u = v[w, a:] & masks[at + w * size]
                s = v[w, a:] + u
                over = s < u
                if carry is not None:
                    s = s + carry
                    over |= s < carry
                v[w, a:] = s | (v[w, a:] & ~u)
                carry = over.astype(np.uint64) if words > 1 else None
        out = np.empty(len(rows), dtype=np.int64)
        out[order] = sum(np.bitwise_count(~v[w]).astype(np.int64) for w in range(words))
        return out

    def near(self, title: str, numbers: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose ratio with one title may reach `least`, and what it is at most. counts: of its characters."""
        own = Lengths([0], [numbers], least, self.alphabet)
        pairs = [r for _, r in own.near(self)] if counts[1:].any() else []
        rows = np.concatenate(pairs) if pairs else np.zeros(0, dtype=np.int64)
        if not len(rows):
            return rows, np.zeros(0)
        most = 2 * self.common(own, np.zeros(len(rows), dtype=np.int64), rows) / (len(title) + self.lengths[rows])
        return rows[most >= least - 1e-9], most[most >= least - 1e-9]


class Beginnings:
    """Titles by what they begin with."""

    def __init__(self, titles: list[str]):
        self.by_name = sorted(range(len(titles)), key=titles.__getitem__)
        self.names = [titles[i] for i in self.by_name]
        self.halves: dict[str, list[int]] = {}
        for i, t in enumerate(titles):
            if len(t) >= SHORTEST:
                self.halves.setdefault(_half(t), []).append(i)
        self.half_lengths = sorted({len(h) for h in self.halves})

    def of(self, title: str) -> set[int]:
        """The titles of which over half begins this one, or which over half of this one begins."""
        found = set()
        if len(title) >= SHORTEST:
            lo = bisect.bisect_left(self.names, half := _half(title))
            while lo < len(self.names) and self.names[lo].startswith(half):
                found.add(self.by_name[lo])
                lo += 1
        for n in self.half_lengths:
            if n > len(title):
                break
            found.update(self.halves.get(title[:n], ()))
        return found


class Counter:
    """Counts bits that stand at the same places of arrays of words: the sums of all places at once, a word for 64 of them."""

    def __init__(self, shape: tuple[int, ...]):
        self.shape, self.free, self.levels = shape, [], [[]]

    def array(self) -> np.ndarray:
        return self.free.pop() if self.free else np.empty(self.shape, dtype=np.uint64)

    def add(self, x: np.ndarray, level: int = 0) -> None:
        """Adds 2**level where x has a bit; x is used up. Three of a level make one and one of the next level."""
        if level == len(self.levels):
            self.levels.append([])
        held = self.levels[level]
        held.append(x)
        if len(held) == 3:
            x, y, z = held
            carry = np.bitwise_and(x, y, out=self.array())
            np.bitwise_xor(x, y, out=x)
            np.bitwise_and(x, z, out=y)
            np.bitwise_xor(x, z, out=x)
            np.bitwise_or(carry, y, out=carry)
            self.free += [y, z]
            self.levels[level] = [x]
            self.add(carry, level + 1)

    def reaches(self, least: np.ndarray) -> np.ndarray:
        """The places whose sum is that of `least` at least, which is given for each place of the last axis."""
        out, level, most = np.full(self.shape, ~np.uint64(0)), 0, int(least.max(initial=0))
        while level < len(self.levels) or most >> level:
            held = self.levels[level] if level < len(self.levels) else []
            if len(held) == 2:
                x, y = held
                carry = np.bitwise_and(x, y, out=self.array())
                np.bitwise_xor(x, y, out=x)
                self.add(carry, level + 1)
            have = held[0] if held else np.zeros(self.shape, dtype=np.uint64)
            want = np.packbits((least >> level & 1).astype(bool), bitorder="little").view("<u8")
            out = (have & ~want) | (~(have ^ want) & out)
            level += 1
        return out


class Lengths:
    """Titles of a pass of about the same length, and the steps they can take.

    A common subsequence of K characters takes K - 1 steps, each from one to the next in both titles. A step that leaves out
    e characters, in both together, counts for 2 - e, if that is positive. All leave out n + m - 2 K at most, so they count
    for 4 K - 2 - n - m at least. Positions of a common character differ by n - K or m - K at most. Each step begins at another
    character, so what the steps from each character of a title can count for at most, by the pairs of characters that the
    other one has at about this position, leaves pairs out without loss.
    """

    def __init__(self, places: list[int], numbers: list[np.ndarray], least: float, alphabet: Alphabet):
        self.places, self.numbers, self.least, self.size = places, numbers, least, alphabet.size
        self.shortest, self.longest = len(numbers[0]), len(numbers[-1])
        self.width = max(8, -(-self.longest // 8))
        self.buckets, self.codes = -(-self.longest // self.width), min(alphabet.size**2, 1021)
        lengths = np.array([len(x) for x in numbers])
        cuts = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(numbers)]
        #: Of titles of one length: the first, the length, and the rows of the pairs next to each other and of those with one between.
        self.groups = [(a, int(lengths[a]), *self._rows(np.stack(numbers[a:b]))) for a, b in zip(cuts, cuts[1:], strict=False)]

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * self.size + b) % self.codes

    def _rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = np.arange(x.shape[1]) // self.width * self.codes
        return tuple((bucket[: max(x.shape[1] - gap, 0)] + self.code(x[:, :-gap], x[:, gap:])).T.astype(np.int32) for gap in (1, 2))

    def near(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a title, by its place here, and a row of the block, that the steps leave."""
        near, next_ = block.steps(self)
        size = max(1, WORDS // near.shape[1])
        titles, rows, held = [], [], 0
        for begin, n, pairs, skips in self.groups:
            least = np.full(64 * near.shape[1], 2 * n)  # no title reaches it
            least[: len(block.titles)] = np.minimum(block.least_steps(n, self.least), 2 * n)
            if least.min() == 2 * n:
                continue
            for k in range(0, pairs.shape[1], size):
                some, over = pairs[:, k : k + size], skips[:, k : k + size]
                counter = Counter((some.shape[1], near.shape[1]))
                for i in range(n - 1):
                    one = np.take(near, some[i], axis=0, out=counter.array(), mode="clip")
                    if i < n - 2:
                        skip = np.take(next_, over[i], axis=0, out=counter.array(), mode="clip")
                        np.bitwise_or(one, skip, out=one)
                        counter.free.append(skip)
                    counter.add(one)
                    counter.add(np.take(next_, some[i], axis=0, out=counter.array(), mode="clip"))
                left = counter.reaches(least)
                title, word = np.nonzero(left)
                at, bit = np.nonzero(np.unpackbits(left[title, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                if len(at):
                    titles.append(begin + k + title[at])
                    rows.append(word[at] * 64 + bit)
                    held += len(at)
                if held > PAIRS:
                    yield np.concatenate(titles), np.concatenate(rows)
                    titles, rows, held = [], [], 0
        if held:
            yield np.concatenate(titles), np.concatenate(rows)


class Titles:
    """The different titles of a pass, ready to meet blocks."""

    def __init__(self, titles: list[str], least: float):
        self.titles, self.least, self.alphabet = titles, least - ROUNDING, Alphabet(titles)
        codes, lengths = _codes(titles)
        ends = np.cumsum(lengths)
        numbers = self.alphabet.numbers(codes)
        self.numbers = [numbers[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        self.beginnings = Beginnings(titles)
        self.classes: list[Lengths] = []
        some: list[int] = []
        for i in [*sorted((i for i, t in enumerate(titles) if t), key=lambda i: len(titles[i])), -1]:
            if some and (i < 0 or len(titles[i]) > len(titles[some[0]]) * 1.1 + 2):
                self.classes.append(Lengths(some, [self.numbers[k] for k in some], self.least, self.alphabet))
                some = []
            some.append(i)

    def meet(self, others: list[str]) -> Iterator[tuple[int, list[tuple[int, float, bool]]]]:
        """For each title, by its number, the others (number, similarity at most, whether one begins the other) that may reach the least similarity."""
        for at in range(0, len(others), BLOCK):
            block = Block(others[at : at + BLOCK], self.alphabet)
            found: dict[int, dict[int, float]] = {}
            for own in self.classes:
                for titles, rows in own.near(block):
                    for k in range(0, len(titles), PAIRS):
                        t, r = titles[k : k + PAIRS], rows[k : k + PAIRS]
                        most = 2 * block.common(own, t, r) / (np.array([len(own.numbers[i]) for i in t.tolist()]) + block.lengths[r])
                        for x in np.flatnonzero(most >= self.least - 1e-9).tolist():
                            found.setdefault(own.places[t[x]], {})[int(r[x])] = float(most[x])
            begun: dict[int, set[int]] = {}
            for r, other in enumerate(block.titles if self.least <= BEGINS else ()):
                for i in self.beginnings.of(other) if other else ():
                    begun.setdefault(i, set()).add(r)
            for i in sorted(found.keys() | begun.keys()):
                near, begin = found.get(i, {}), begun.get(i, set())
                both = [(at + int(block.order[r]), near.get(r, 0.0), r in begin) for r in sorted(near.keys() | begin) if self.titles[i] and block.titles[r]]
                if both:
                    yield i, both

    def similarity(self, i: int, other: str, most: float, begin: bool) -> float:
        """As functions.text.title_similarity has it; difflib is asked only where it can matter."""
        if begin and most <= BEGINS:
            return BEGINS
        ratio = _ratio(self.titles[i], other)
        return round(max(ratio, BEGINS) if begin else ratio, 4)


def _passes(titles: DataFrame, size: int) -> int:
    return max(1, math.ceil(titles.count() / size))


def _spread(titles: DataFrame) -> DataFrame:
    """Titles over all cores: the work on a block is long, however few bytes it has."""
    spark = titles.sparkSession
    return titles.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "t")


def similar_titles(left: DataFrame, right: DataFrame, least: float, size: int = PASS) -> DataFrame:
    """left, right: title. All pairs of different normalised titles whose similarity is `least` or more: left_title,
    right_title, similarity. Empty titles have none. As many rows as there are such pairs: use best_match for one a title."""
    norm = lambda df: df.select(T.normalize_reference(F.col("title")).alias("t")).where("t <> ''").distinct()
    mine, others = stored(norm(left)), stored(_spread(norm(right)))
    parts = partitions(others, 2 * BLOCK)  # small files would be read by one task
    out = []
    for p in range(n := _passes(mine, size)):
        own = mine.where(F.pmod(F.xxhash64("t"), F.lit(n)) == p).toArrow()["t"].to_pylist()
        if not own:
            continue
        shared = mine.sparkSession.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            titles = Titles(shared.value, least)  # noqa: B023
            for b in batches:
                names = b["t"].to_pylist()
                found = [(titles.titles[i], names[j], titles.similarity(i, names[j], most, begin)) for i, rows in titles.meet(names) for j, most, begin in rows]
                a, o, s = zip(*(f for f in found if f[2] >= least), strict=True) if any(f[2] >= least for f in found) else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(o, pa.string()), pa.array(s, pa.float64())], names=["left_title", "right_title", "similarity"])

        out.append(stored(others.repartition(parts, "t").mapInArrow(run, "left_title string, right_title string, similarity double")))
        shared.unpersist()
    forget(mine)
    forget(others)
    found = out[0] if out else mine.sparkSession.createDataFrame([], "left_title string, right_title string, similarity double")
    for o in out[1:]:
        found = found.unionByName(o)
    return found


_BEST = "q int, similarity double, author_ok boolean, year_diff int, cand_rank int, cand_ord long, cand_doi string, cand_title string"


class _Best:
    """The best candidate of each query (title, author, year) among those seen: highest score, then rank, order and DOI."""

    def __init__(self, queries: list[dict], least: float):
        self.by_title: dict[str, list[int]] = {}
        for k, q in enumerate(queries):
            self.by_title.setdefault(q["t"], []).append(k)
        self.queries, self.least = queries, least
        self.titles = Titles(list(self.by_title), least)
        self.best: dict[int, tuple] = {}

    def add(self, rows: list[dict]) -> None:
        names = sorted({r["t"] for r in rows})
        by_name: dict[str, list[dict]] = {}
        for r in rows:
            by_name.setdefault(r["t"], []).append(r)
        for i, found in self.titles.meet(names):
            for j, most, begin in sorted(found, key=lambda f: -max(f[1], BEGINS * f[2])):
                self._compare(i, names[j], by_name[names[j]], most, begin)

    def _compare(self, i: int, name: str, rows: list[dict], most: float, begin: bool) -> None:
        highest, similarity = round(max(most, BEGINS * begin), 4), None
        for k in self.by_title[self.titles.titles[i]]:
            q = self.queries[k]
            for r in rows:
                author = q["a"] is None or r["a"] is None or q["a"] in r["a"] or r["a"] in q["a"]
                years = None if q["y"] is None or r["y"] is None else abs(q["y"] - r["y"])
                key = lambda s: (-(s - OTHER_AUTHOR * (not author) - OTHER_YEAR * (years is not None and years > 1)), r["rank"], r["ord"], r["doi"] is None, r["doi"] or "", name, not author, years or 0)  # noqa: B023, E731
                if k in self.best and self.best[k][0] <= key(highest):
                    continue
                if similarity is None:
                    similarity = self.titles.similarity(i, name, most, begin)
                if similarity >= self.least and (k not in self.best or key(similarity) < self.best[k][0]):
                    self.best[k] = (key(similarity), similarity, author, years, r)

    def found(self) -> pa.RecordBatch:
        rows = [(k, s, author, years, r["rank"], r["ord"], r["doi"], r["t"]) for k, (_, s, author, years, r) in sorted(self.best.items())]
        kinds = (pa.int32(), pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=[x.split()[0] for x in _BEST.split(", ")])


def score(similarity: Column, author_ok: Column, year_diff: Column) -> Column:
    """What candidates are compared by."""
    return similarity - F.when(author_ok, 0.0).otherwise(OTHER_AUTHOR) - F.when(F.coalesce(year_diff, F.lit(0)) > 1, OTHER_YEAR).otherwise(0.0)


def _order() -> list[Column]:
    """The best candidate first."""
    best = F.desc(score(F.col("similarity"), F.col("author_ok"), F.col("year_diff")))
    return [best, F.col("cand_rank"), F.col("cand_ord"), F.asc_nulls_last("cand_doi"), F.col("cand_title"), F.desc("author_ok"), F.coalesce("year_diff", F.lit(0))]


def _first(candidates: DataFrame, *keys: str) -> DataFrame:
    return candidates.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order()))).where("k = 1").drop("k")


def best_match(refs: DataFrame, registry: DataFrame, least: float, size: int = PASS) -> DataFrame:
    """The best record for each title of refs, among all whose similarity is `least` or more.

    refs: title, first_author, year; registry: these and rank, ord, doi. Gives title, first_author, year, similarity,
    author_ok, year_diff, cand_doi, one row for each different (title, first_author, year) that has one. The score is the
    similarity, less 0.2 if the authors differ and 0.1 if the years are more than one apart; on ties the record of lower
    rank, then of lower ord, then of lower doi. A null or empty title has no match, an unknown author or year fits any.

    Equal records are compared once, equal references too. A reference whose title a record has, with an author and a year
    that fit, needs no search, as nothing scores higher; the others are broadcast in passes of `size`.
    """
    spark = refs.sparkSession
    year = F.col("year").try_cast("int").alias("y")
    norm = T.normalize_reference(F.col("title")).alias("t")
    author = F.when(F.col("first_author").isNotNull(), T.normalize_reference(F.col("first_author"))).alias("a")
    own = stored(refs.select("title", "first_author", "year").distinct().select("title", "first_author", "year", norm, author, year).where("t <> ''"))
    first = F.min(F.struct("rank", "ord", F.col("doi").isNull().alias("none"), "doi")).alias("f")
    records = stored(_spread(registry.select(norm, author, year, F.col("rank").cast("int").alias("rank"), F.coalesce(F.col("ord").cast("long"), F.lit(0)).alias("ord"), "doi").where("t <> ''").groupBy("t", "a", "y").agg(first).select("t", "a", "y", "f.rank", "f.ord", "f.doi")))
    parts = partitions(records, 2 * BLOCK)
    keys = own.select("t", "a", "y").distinct()
    # A longer title could be another one by so little that it rounds to 1.
    same = keys.where(F.length("t") < 10_000).alias("k").join(records.alias("r"), "t")
    same = same.select("t", "k.a", "k.y", F.lit(1.0).alias("similarity"), (F.col("k.a").isNull() | F.col("r.a").isNull() | F.contains("k.a", F.col("r.a")) | F.contains("r.a", F.col("k.a"))).alias("author_ok"), F.abs(F.col("k.y") - F.col("r.y")).alias("year_diff"), F.col("r.rank").alias("cand_rank"), F.col("r.ord").alias("cand_ord"), F.col("r.doi").alias("cand_doi"), F.col("t").alias("cand_title"))
    sure = stored(_first(same.where(F.col("author_ok") & (F.coalesce("year_diff", F.lit(0)) <= 1)), "t", "a", "y"))
    of = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in "tay"]
    rest = stored(keys.alias("k").join(sure.alias("s"), of("k", "s"), "left_anti"))
    found = sure
    for p in range(n := _passes(rest, size)):
        queries = rest.where(F.pmod(F.xxhash64("t", "a", "y"), F.lit(n)) == p).toArrow()
        if not queries.num_rows:
            continue
        shared = spark.sparkContext.broadcast(queries.to_pylist())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(shared.value, least)  # noqa: B023
            for b in batches:
                best.add(b.to_pylist())
            yield best.found()

        about = spark.createDataFrame(queries.append_column("q", pa.array(np.arange(queries.num_rows, dtype=np.int32))))
        found = found.unionByName(stored(_first(records.repartition(parts, "t").mapInArrow(run, _BEST), "q").join(about, "q").select(*sure.columns)))
        shared.unpersist()
    forget(records)
    forget(rest)
    return own.alias("o").join(found.alias("b"), of("o", "b")).select("o.title", "o.first_author", "o.year", "similarity", "author_ok", "year_diff", "cand_doi")
