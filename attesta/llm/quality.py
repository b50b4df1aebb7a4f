"""Quality classifier from weak labels.

Overlapping heuristics look at a text's words, lines and characters and vote junk, good or nothing. Expectation-
maximisation estimates how accurate each is, and how correlated, from how they agree, without any labels; its posterior
labels train a linear scorer on hashed features of how texts are written (shapes of words and of neighbours), not on the
votes, which then scores every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import as_before, cut, pick, placed, through_arrow
from attesta.llm.weak import LabelModel, distinct_votes, train_linear

#: Bounds: texts in the training sample, hashed features, remembered words of a worker.
TRAIN_DOCS, FEATURES, REMEMBERED = 12_000, 1 << 14, 50_000
THRESHOLD = 0.4

#: By code point: 1 a letter, 2 a capital, 3 a symbol.
_CLASS = np.array([2 if (c := chr(i)).isupper() and c.isalpha() else 1 if c.isalpha() else 3 if c in "#*$%&|<>@^~=+\\" else 0 for i in range(1 << 16)], np.uint8)


class _Kinds(dict):
    """For str.translate: small letters become x, capitals X, digits 9; others stay."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        self[code] = out = ord("9" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c)
        return out


_kinds, _repeated = _Kinds(), re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """A word with its letters and digits reduced to their kinds, repeated ones to two, and a long rest left out."""
    out = _repeated.sub(r"\1\1", word.translate(_kinds))
    return out if len(out) <= 11 else out[:10] + out[-1]


def votes(text: str, words: list[str], shapes: Counter) -> list[int]:
    """The heuristics: -1 junk, 1 good, 0 no vote. Each sees one kind of junk, so most of them never vote good."""
    n, chars = len(words), sum(map(len, words))
    points = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF)
    _, small, upper, symbols = np.bincount(_CLASS[points], minlength=4).tolist()
    letters = small + upper
    marks = text.count("!") + text.count("?")
    repeats = sum(map(eq, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    if not n:
        return [-1] * 2 + [0] * 9
    junk = lambda bad: -1 if bad else 0
    good = lambda fine: 1 if fine else 0
    distinct = len({*words})
    lower = sum(k for s, k in shapes.items() if s[0] == "x") / n
    ends = sum(k for s, k in shapes.items() if s[-1] in ".,;:") / n
    return [
        junk(upper > 0.4 * max(1, letters) and letters > 20),
        junk(symbols > 0.3 * n),
        junk(marks > 0.3 * n and n > 5),
        junk(repeats > 0.2 * n and n > 10),
        junk(n >= 60 and distinct < 0.15 * n),
        junk(n >= 30 and text.count("|") > 0.2 * n),
        junk(len(lines) >= 4 and len({*lines}) < 0.5 * len(lines)),
        junk(letters < 0.5 * chars),
        good(0.6 <= lower and 0.02 <= ends <= 0.4),
        good(n >= 20 and distinct > 0.3 * n),
        good(letters > 0.85 * chars and 3 <= letters / n <= 12),
    ]


class Features:
    """Hashed features of a text with the square roots of their shares as values."""

    def __init__(self):
        self._shapes: dict[str, str] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Places, values, and what votes() gives."""
        words = text.split()
        known = self._shapes
        if len(known) > REMEMBERED:
            known.clear()
        for w in {*words}.difference(known):
            known[w] = shape(w)
        shapes = [*map(known.__getitem__, words)]
        single = Counter(shapes)
        n = max(1, len(words))
        vote = votes(text, words, single)
        found = Counter({"\1".join(pair): k for pair, k in Counter(zip(shapes, shapes[1:], strict=False)).items()}) + single
        values: dict[int, int] = {}
        for k, v in found.items():
            at = zlib.crc32(k.encode("utf-8", "surrogatepass")) % FEATURES
            values[at] = values.get(at, 0) + v
        places = sorted(values)
        return np.array(places, int), np.sqrt(np.array([values[x] for x in places], float) / n), vote


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept
        self._of = None

    def score(self, text: str) -> float:
        if self._of is None:
            self._of = Features()
        at, values, _ = self._of(text)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[at] @ values + self.intercept)))))


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = Features()
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        found = [of(t) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([f[2] for f in found], pa.list_(pa.int32())), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], ["h", "votes", "at", "value"])


def train(docs: DataFrame) -> tuple[Model, LabelModel | None]:
    """From a sample of about TRAIN_DOCS distinct texts, chosen by a hash of the text."""
    rows = pick(docs, "text").where("text IS NOT NULL")
    share = min(1.0, TRAIN_DOCS / max(1, rows.count()))
    h = F.xxhash64("text")
    rows = rows.select(h.alias("h"), "text").where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    found = through_arrow(rows, _samples, "h long, votes array<int>, at array<int>, value array<float>").groupBy("h").agg(*(F.first(c).alias(c) for c in ("votes", "at", "value")))
    found = found.orderBy("h").toArrow()  # TRAIN_DOCS rows, but for chance
    if not found.num_rows:
        return Model(np.zeros(FEATURES), 4.0), None
    lists = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in found[c].combine_chunks()]
    patterns, n, index = distinct_votes(np.stack(lists("votes")))
    junk = (patterns < 0).sum(axis=1)
    # The first guess: what any heuristic calls junk is more likely junk than not.
    model = LabelModel(patterns, n, start=np.where(junk == 0, 0.95, 0.1))
    target = model.posterior(patterns)[index]
    weights, intercept = train_linear([x.astype(int) for x in lists("at")], [x.astype(float) for x in lists("value")], target, FEATURES)
    return Model(weights, intercept), model


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        scores = np.array([model.value.score(t or "") for t in b.column("text").to_pylist()], float)
        at = b.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(scores), pa.array(scores >= THRESHOLD)], [*(n for n in b.schema.names if n != "text"), "score", "kept"])


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1, higher: better), kept (score >= THRESHOLD).

    Null and empty texts are scored as texts without words. Repeated rows get equal scores. An empty table gives an
    empty one. Other columns are ignored.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = docs.sparkSession.sparkContext.broadcast(train(rows)[0])  # FEATURES numbers
    return through_arrow(rows, lambda batches: _score(batches, model), "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs (text and any others) that classify keeps, with docs' columns; no row moves.

    Null and empty texts are scored as texts without words. Repeated rows stay or go together. An empty table gives an
    empty one. Other columns, also of clashing names, are kept as they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs)[0])  # FEATURES numbers
    rows = placed(docs)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.value.score(t or "") >= THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return as_before(through_arrow(rows, kept, rows.schema), docs)
