"""Language identification by cross-parsing entropy.

A suffix automaton of a language's training text knows all its substrings. A text is parsed against it into phrases,
each the longest match with the training text from where the last one ended; a text in that language needs few. With c
phrases over n characters and a training text of N, c * log2(N) / n estimates the cross entropy, and the language with
the lowest estimate wins.

An automaton is stored as a double array (the transition of state s on class c is the slot base[s] + c, if that slot's
check is s), so that alphabets may be large. A task parses its texts' blocks of BLOCK characters side by side with numpy,
each from its own beginning, and then goes on with each block's last phrase into the next block until one of its phrases
starts where one of that block's own does: from there on both parses are the same. The few texts where that doesn't
happen within a block are parsed in one go, so phrases are as long as in a parse of the whole text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import not_held_out, pick, through_arrow

#: The training sample: so many whole texts of each language, in order of a hash.
SAMPLE_DOCS = 16
BLOCK = 1024
#: Characters that a task parses at once.
AT_ONCE = 3_000_000

UNKNOWN, SPACE = 0, 1


def letters_of(text: str) -> str:
    """Lower case; what is no letter or mark becomes one space."""
    return " ".join("".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower()).split())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of the states of the smallest automaton that accepts the substrings of codes; state 0 starts."""
    moves: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]
    last = 0
    for c in codes:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


class Automaton:
    """The double array of a suffix automaton; state 0 starts, and its transitions are in root."""

    def __init__(self, moves: list[dict[int, int]], width: int):
        self.root = np.zeros(width, np.int32)
        for c, q in moves[0].items():
            self.root[c] = q
        size = width + sum(map(len, moves)) * 5 // 4 + 1
        taken = bytearray(size + width)
        base, slots = [0] * len(moves), {}
        first, single = width, width  # where the search for room begins
        for s in sorted(range(1, len(moves)), key=lambda s: (-len(moves[s]), s)):
            m = moves[s]
            if not m:
                continue
            low, tries = min(m), 0
            at = single if len(m) == 1 else first
            while True:
                at = taken.find(0, at)
                if at < 0:
                    at = len(taken)
                if at + width > len(taken):
                    taken.extend(bytes(width + len(taken) // 4))
                b = at - low
                if all(not taken[b + c] for c in m):
                    break
                at, tries = at + 1, tries + 1
            if len(m) == 1:
                single = at
            elif tries > 20:  # little room is left below
                first = at
            base[s] = b
            for c, q in m.items():
                taken[b + c] = 1
                slots[b + c] = (s, q)
        self.base = np.array(base, np.int32)
        self.check, self.target = np.full(len(taken) + width, -1, np.int32), np.zeros(len(taken) + width, np.int32)
        where = np.fromiter(slots, np.int64, len(slots))
        self.check[where] = [s for s, _ in slots.values()]
        self.target[where] = [q for _, q in slots.values()]
        self._lists = None

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether a phrase starts with c. In state 0 one always does."""
        at = self.base[state] + c
        start = self.check[at] != state
        return np.where(start, self.root[c], self.target[at]), start

    def phrases(self, codes: list[int]) -> int:
        """The phrases of one text, a character at a time."""
        if self._lists is None:
            self._lists = tuple(x.tolist() for x in (self.base, self.check, self.target, self.root))
        base, check, target, root = self._lists
        state = n = 0
        for c in codes:
            at = base[state] + c
            if check[at] == state:
                state = target[at]
            else:
                n, state = n + 1, root[c]
        return n


class Model:
    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        texts = {k: letters_of(v) for k, v in samples.items()}
        self.classes = {" ": SPACE} | {c: i + 2 for i, c in enumerate(sorted({*"".join(texts.values())} - {" "}))}
        self.bits = np.array([np.log2(max(2, len(texts[k]))) for k in self.langs])
        self.automata = [Automaton(suffix_automaton([self.classes[c] for c in texts[k]]), len(self.classes) + 1) for k in self.langs]
        self._lookup = None

    def _class(self, c: str) -> int:
        low = c.lower()
        return self.classes.get(low if len(low) == 1 else low[0], UNKNOWN)

    def classify(self, code_points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each character and whether it is a letter."""
        if self._lookup is None:
            table, letter = np.full(1 << 16, SPACE, np.int32), np.zeros(1 << 16, bool)
            for i in range(1 << 16):
                c = chr(i)
                if unicodedata.category(c)[0] in "LM":
                    letter[i] = unicodedata.category(c)[0] == "L"
                    table[i] = self._class(c)
            self._lookup = table, letter
        table, letter = self._lookup
        low = np.minimum(code_points, 0xFFFF)
        out, letters = table[low], letter[low]
        for x in np.unique(code_points[code_points > 0xFFFF]):
            kind, at = unicodedata.category(chr(x))[0], code_points == x
            out[at], letters[at] = (self._class(chr(x)) if kind in "LM" else SPACE), kind == "L"
        return out, letters

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the phrases needed in each language, and whether it has a letter."""
        sizes = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        codes, letter = self.classify(points)
        doc = np.repeat(np.arange(len(texts)), sizes)
        keep = np.ones(len(codes), bool)
        keep[1:] = ~((codes[1:] == SPACE) & (codes[:-1] == SPACE) & (doc[1:] == doc[:-1]))
        has = np.bincount(doc[letter], minlength=len(texts)) > 0
        codes, doc = codes[keep], doc[keep]
        sizes = np.bincount(doc, minlength=len(texts))
        starts = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[owner] + nth * BLOCK
        length = np.minimum(BLOCK, sizes[owner] - nth * BLOCK)
        found = np.zeros((len(texts), len(self.langs)), np.int64)
        for i, automaton in enumerate(self.automata):
            found[:, i] = self._phrases(automaton, codes, owner, nth, begin, length, starts, sizes)
        return found, has

    @staticmethod
    def _phrases(automaton: Automaton, codes, owner, nth, begin, length, starts, sizes) -> np.ndarray:
        order = np.argsort(-length, kind="stable")
        active = np.searchsorted(-length[order], -np.arange(BLOCK), side="left")  # blocks longer than t
        first = begin[order]
        started = np.zeros(len(codes), bool)
        state = np.zeros(len(order), np.int32)
        for t in range(int(length.max()) if len(length) else 0):
            n = active[t]
            at = first[:n] + t
            state[:n], started[at] = automaton.step(state[:n], codes[at])
        last = np.empty_like(state)
        last[order] = state
        count = np.bincount(owner[np.repeat(np.arange(len(owner)), length)], weights=started, minlength=len(sizes)).astype(np.int64)
        # What each block begins with is parsed again as its predecessor's last phrase goes on.
        lane = np.flatnonzero((nth > 0) & (np.r_[0, last[:-1]] > 0))
        state = last[lane - 1]
        change = np.zeros(len(lane), np.int64)
        open_ = np.arange(len(lane))
        t = 0
        while len(open_):
            open_ = open_[length[lane[open_]] > t]
            at = begin[lane[open_]] + t
            state[open_], start = automaton.step(state[open_], codes[at])
            own = started[at]
            met = start & own
            change[open_] += start.astype(np.int64) - own
            open_ = open_[~met]
            t += 1
            if t >= BLOCK:
                break
        count += np.bincount(owner[lane], weights=change, minlength=len(sizes)).astype(np.int64)
        for k in {int(owner[lane[x]]) for x in open_}:  # no phrase of a whole block started where one of its own does
            count[k] = automaton.phrases(codes[starts[k] : starts[k] + sizes[k]].tolist())
        return count

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        found, has = self.parse(texts)
        bits = found * self.bits
        best = bits.argmin(axis=1)
        score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        return [self.langs[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0).tolist()


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model | None:
    """From a bounded sample of the rows of docs with a language and a letter; None if there are none."""
    rows = pick(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64("doc_id", "text").alias("h"), F.col("text").alias("t"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))).where(F.col("k") <= SAMPLE_DOCS)
    samples: dict[str, list] = {}
    for r in first.orderBy("lang", "k").collect():
        samples.setdefault(r["lang"], []).append(r["t"])
    samples = {k: " ".join(v) for k, v in samples.items() if letters_of(" ".join(v))}
    return Model(samples) if samples else None


def _score(batches: Iterator[pa.RecordBatch], model: Model | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [t or "" for t in b.column("text").to_pylist()]
        langs: list[str] = []
        scores: list[float] = []
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= AT_ONCE):
                size, hi = size + len(texts[hi]), hi + 1
            k, s = model.predict(texts[lo:hi]) if model else (["und"] * (hi - lo), [0.0] * (hi - lo))
            langs, scores, lo = langs + k, scores + s, hi
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model | None, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score, from the text alone.

    lang_pred is `und`, and score 0, for a null text, one without letters, and all texts if there is no model. Ties
    go to the first language by name. Repeated rows get equal results. Other columns are ignored.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    held = ~not_held_out(F.col("doc_id")) if held_out is None else held_out
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SAMPLE_DOCS texts of each language
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return through_arrow(rows, lambda batches: _score(batches, shared.value), "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """Trains on the rows of docs (doc_id, text, lang) that are not held out and identifies all rows."""
    docs = pick(docs, "doc_id", "text", "lang")
    return identify(docs, train(docs.where(not_held_out(F.col("doc_id")))))
