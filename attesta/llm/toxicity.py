"""Toxicity by weak supervision.

Labelled texts are dealt into FOLDS. Each fold's lexicons are those units (words; and beginnings of words, for inflected
forms) that a likelihood-ratio test finds tied to toxic labels in the other folds, so that the lexicons overlap and differ
where a unit hangs on few texts. A lexicon of words and one of beginnings for each fold, and voters for patterns, look at
every training text: a lexicon votes toxic if it has a unit of the text and clean if it has none, a pattern votes toxic or
not at all. A generative label model estimates from these votes alone, without labels, how accurate and how correlated
the voters are; its posterior labels train a linear classifier over the units, which scores whole texts. Of texts that
share the least of their shingle hashes (mostly near copies) the test counts one, lest one text's copies make all its
words toxic; all of them train the models.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, not_held_out, pick, through_arrow
from attesta.llm.weak import LabelModel, distinct_votes, train_linear

#: Bounds: labelled texts in the training sample, remembered tokens of a worker.
TRAIN_DOCS, REMEMBERED = 16_000, 100_000
FOLDS = 8
#: What a unit of a lexicon needs: toxic texts that have it, and their part of all that do.
MIN_TOXIC_DOCS, PRECISION = 3, 0.8
BEGINNINGS = (4, 5)
THRESHOLD = 0.7

_LETTERS = re.compile(r"[^\W\d_]+")


def stems_of(token: str) -> list[int]:
    """Hashes, multiples of four, of a token's words, and of their beginnings plus one."""
    out = []
    for w in _LETTERS.findall(token.lower()):
        if len(w) > 1:
            out.append(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) >> 3 << 2)
        out += [xxhash.xxh3_64_intdigest(w[:n].encode("utf-8", "surrogatepass")) >> 3 << 2 | 1 for n in BEGINNINGS if len(w) >= n]
    return out


def units_of(stems: Counter) -> list[int]:
    """The units of a text, from how many of its distinct tokens have each stem: each word; each beginning, and also
    (plus one, plus two) those that two or four tokens have, as inflected forms of one word come together."""
    out = [x for s, n in stems.items() for x in ((s, s + 1, s + 2)[: 1 + (n > 1) + (n > 3)] if s & 1 else (s,))]
    return sorted(out)


def patterns_of(text: str) -> list[int]:
    """Pattern voters: shouting in capitals, strings of exclamation marks, strings of symbols. 0 abstains."""
    letters = sum(map(str.isalpha, text)) or 1
    return [int(sum(map(str.isupper, text)) > 0.5 * letters), int("!!" in text), int(bool(re.search(r"[#*$%&@]{3}", text)))]


def sketch(text: str) -> int:
    """The least of the hashes of five-word shingles, which near copies mostly share."""
    w = text.split()
    return min(zlib.crc32(" ".join(w[i : i + 5]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 4)))


def _training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        units = [units_of(Counter(u for t in set(text.split()) for u in stems_of(t))) for text in texts]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(units, pa.list_(pa.int64())), pa.array([patterns_of(t) for t in texts], pa.list_(pa.int32())), pa.array([sketch(t) for t in texts], pa.int64())], ["doc_id", "toxic", "units", "patterns", "sketch"])


def _known_units(batches: Iterator[pa.RecordBatch], known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The places in `known` (sorted) of each text's units."""
    for b in batches:
        found = []
        for x in b.column("units"):
            u = x.values.to_numpy()
            at = np.minimum(np.searchsorted(known, u), len(known) - 1)
            found.append(at[known[at] == u])
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("patterns"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "patterns", "at"])


def lexicon(a: np.ndarray, df: np.ndarray, t: int, n: int) -> np.ndarray:
    """Which units, in a toxic ones of df texts, are tied to toxic labels, of which n texts have t."""
    b, tested = df - a, max(2, int((a >= MIN_TOXIC_DOCS).sum()))
    with np.errstate(divide="ignore", invalid="ignore"):
        p = a / np.maximum(df, 1)
        gain = 2 * (a * np.log(p / (t / n)) + np.where(b > 0, b * np.log((1 - p) / (1 - t / n)), 0.0))
    return (a >= MIN_TOXIC_DOCS) & ((a + 0.5) / (df + 1) >= PRECISION) & (a / t > 4 * (b + 0.5) / (n - t)) & (gain > 2 * np.log(tested))


class Model:
    def __init__(self, units: list[int], weights: np.ndarray, intercept: float):
        self.units = {u: i for i, u in enumerate(units)}
        self.weights, self.intercept = weights.tolist(), intercept
        self._known: dict[str, list[int]] = {}

    def score(self, text: str) -> float:
        known, stems = self._known, Counter()
        for t in set(text.split()):
            hit = known.get(t)
            if hit is None:
                if len(known) > REMEMBERED:
                    known.clear()
                hit = known[t] = [s for s in stems_of(t) if any(u in self.units for u in ((s, s + 1, s + 2) if s & 1 else (s,)))]
            if hit:
                stems.update(hit)
        z = self.intercept + sum(self.weights[self.units[u]] for u in units_of(stems) if u in self.units)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Rows whose label is null, or conflicts with itself, count as their largest."""
    marks = pick(labels, "doc_id", "toxic").where("toxic IS NOT NULL").where(not_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, TRAIN_DOCS / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    texts = pick(docs, "doc_id", "text").join(F.broadcast(marks), "doc_id").select(F.col("doc_id").cast("long"), "toxic", "text")  # TRAIN_DOCS pairs of numbers
    rows = cut(through_arrow(texts, _training_rows, "doc_id long, toxic int, units array<long>, patterns array<int>, sketch long"))
    fold = F.pmod(F.xxhash64("sketch"), F.lit(FOLDS))
    once = rows.select("toxic", "sketch", fold.alias("fold"), F.explode("units").alias("unit")).distinct()
    counts = [F.count(F.when((F.col("fold") == k) & (F.col("toxic") == y), 1)).alias(f"n{k}_{y}") for k in range(FOLDS) for y in (0, 1)]
    numbers = lambda t: np.stack([np.stack([t[f"n{k}_{y}"].to_numpy() for k in range(FOLDS)], axis=1) for y in (0, 1)])
    total = numbers(rows.select("toxic", "sketch", fold.alias("fold")).distinct().agg(*counts).toArrow())[:, 0]
    if not total[1].sum() or not total[0].sum():
        return Model([], np.zeros(0), 4.0 if total[1].sum() else -4.0)
    # Units of TRAIN_DOCS texts at most.
    per_unit = once.groupBy("unit").agg(F.sum("toxic").alias("a"), *counts).where(F.col("a") >= MIN_TOXIC_DOCS).orderBy("unit").toArrow()
    known, by_fold = per_unit["unit"].to_numpy(), numbers(per_unit)
    members = np.zeros((FOLDS, len(known)), bool)
    for k in range(FOLDS):
        a, b = (by_fold[y].sum(axis=1) - by_fold[y][:, k] for y in (1, 0))
        t, n = total[1].sum() - total[1][k], total.sum() - total[:, k].sum()
        if 0 < t < n:
            members[k] = lexicon(a, a + b, t, n)
    used = members.any(axis=0)
    known, members = known[used], members[:, used]
    if not len(known):
        return Model([], np.zeros(0), -4.0)
    found = through_arrow(rows.select("doc_id", "units", "patterns"), lambda x: _known_units(x, known), "doc_id long, patterns array<int>, at array<long>").orderBy("doc_id").toArrow()
    present = [np.array(x, int) for x in found["at"].to_pylist()]
    beginning = known % 4 > 0
    kinds = [members & ~beginning, members & beginning]
    votes = np.array([[*(1 if kind[k, x].any() else -1 for kind in kinds for k in range(FOLDS)), *p] for x, p in zip(present, found["patterns"].to_pylist(), strict=True)])
    patterns, count, index = distinct_votes(votes)
    # The first guess: what half of the lexicons call toxic is more likely toxic than not.
    model = LabelModel(patterns, count, start=np.where((patterns[:, : 2 * FOLDS] > 0).mean(axis=1) >= 0.25, 0.9, 0.05))
    target = model.posterior(patterns)[index]
    weights, intercept = train_linear(present, [np.ones(len(x)) for x in present], target, len(known), l2=1e-4, steps=1000)
    return Model(known.tolist(), weights, intercept)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        scores = np.array([model.score(t or "") for t in b.column("text").to_pylist()], float)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without any unit. Repeated rows get equal scores. Without labels of
    both kinds every text scores low, or high if all labels are toxic. Other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # units of TRAIN_DOCS texts
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (~not_held_out(F.col("doc_id"))).alias("held_out"), "text")
    return through_arrow(rows, lambda batches: _score(batches, model.value), "doc_id long, held_out boolean, score double, predicted int")
