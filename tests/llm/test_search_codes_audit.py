"""Top-k search, vector codes and the filter audit against brute force, and on awkward tables."""

import hashlib
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import codes, filter_audit, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VECTORS = "vec_id long, embedding array<float>, label int"
BAD = [None, [0.5, None, 0.25], [float("nan"), 1.0], [float("inf")]]


def vectors(seed: int, n: int, size: int, copies: int = 0) -> list[tuple]:
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, size)) * np.linspace(2.0, 0.1, size) * r.choice([0.2, 1.0, 3.0], size=(n, 1))
    rows = [(i, [float(np.float32(c)) for c in v], None if i % 7 == 0 else i % 3) for i, v in enumerate(base)]
    return rows + [(n + i, rows[3][1], 1) for i in range(copies)]


def awkward_vectors() -> list[tuple]:
    rows = vectors(5, 60, 11, copies=30)
    rows += [(1000 + i, v, 2) for i, v in enumerate(BAD)] + [(50, rows[50][1], 1), (50, rows[50][1], 1), (50, rows[4][1], 1)]
    return rows + [(None, rows[9][1], 0), (None, None, None), (2000, [], 2), (2050, [0.25], None)]


def whole(rows: list[tuple], scale: int) -> tuple[list, np.ndarray, list]:
    kept = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    size = max([1, *(len(r[1]) for r in kept)])
    x = np.array([[int(np.floor(scale * float(c))) for c in r[1]] + [0] * (size - len(r[1])) for r in kept], dtype=np.int64).reshape(-1, size)
    return [r[0] for r in kept], x, [r[2] for r in kept]


def plain_top_k(rows: list[tuple], every: int = 50, k: int = 5) -> list[tuple]:
    ids, x, _ = whole(rows, 256)
    out = []
    for q in (i for i, n in enumerate(ids) if n is not None and n % every == 0):
        best = sorted((-int(x[c] @ x[q]), ids[c] is None, ids[c] or 0, c) for c in range(len(ids)) if c != q)[:k]
        out += [(ids[q], r, ids[c], -s) for r, (s, _, _, c) in enumerate(best, 1)]
    return sorted(out, key=repr)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [vectors(1, 300, 24), vectors(2, 120, 5, copies=80), awkward_vectors(), vectors(3, 3, 4), []], ids=["spread", "copies", "awkward", "few", "none"])
@pytest.mark.parametrize("per_pass", [None, 2])
def test_top_k_is_that_of_all_pairs(spark, rows, per_pass):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert rows_of(topk.top_k(df, F.col("vec_id") % 50 == 0, per_pass=per_pass, per_block=32)) == plain_top_k(rows)


def test_top_k_of_other_k_and_clashing_columns(spark):
    rows = vectors(4, 100, 8)
    df = spark.createDataFrame(rows, VECTORS).select("*", *(F.col("vec_id").alias(c) for c in ("x", "q", "length", "pass", "VEC_ID", "score")))
    assert rows_of(topk.top_k(df, F.col("vec_id") % 10 == 0, k=1)) == plain_top_k(rows, 10, 1)


def test_huge_components_do_not_crash_the_search(spark):
    rows = [(i, [3e38, -3e38, float(i)], 0) for i in range(4)]
    found = topk.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 0, k=2).collect()
    assert len(found) == 2 and all(r["score"] > 0 for r in found)


def test_bounds_leave_pairs_out_but_none_of_the_best():
    r = np.random.default_rng(7)
    x = np.floor(256 * r.normal(size=(2000, 32)) * np.linspace(3, 0.01, 32))
    v = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    search = topk._Search(x[:20], v, np.full(20, -np.inf), 6)
    seen = []
    plain = search.exact
    search.exact = lambda qi, xi, b: seen.append(len(qi)) or plain(qi, xi, b)
    order = np.argsort(-np.linalg.norm(x, axis=1))
    for a in range(0, 2000, 250):
        block = x[order[a : a + 250]]
        search.add(order[a : a + 250], block, float(np.linalg.norm(block, axis=1).max()))
    assert sum(seen) < 0.2 * 20 * 2000
    assert (search.scores == np.sort(x[:20] @ x.T, axis=1)[:, :-7:-1]).all()


def plain_codes(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6) -> list[tuple]:
    ids, x, labels = whole(rows, 4096)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, rows_key(x[i])))
    ids, x, labels = [ids[i] for i in order], x[order], [labels[i] for i in order]
    if not ids:
        return []
    width = -(-x.shape[1] // parts)
    x = np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(ids), parts, width)
    books = x[:entries].transpose(1, 0, 2).copy()
    far = lambda: ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
    for _ in range(rounds):
        own = far().argmin(axis=2)
        for p in range(parts):
            for e in range(books.shape[1]):
                if (own[:, p] == e).any():
                    books[p, e] = x[own[:, p] == e, p].sum(axis=0) // (own[:, p] == e).sum()
    own, error = far().argmin(axis=2), far().min(axis=2).sum(axis=1)
    of = {k: sum(int(e) for e, b in zip(error, labels, strict=True) if b == k) for k in set(labels)}
    sha = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in o), int(e), of[b], sha) for i, o, e, b in zip(ids, own, error, labels, strict=True)), key=repr)


def rows_key(v: np.ndarray) -> list:
    return [float(c) for c in v]


@pytest.mark.parametrize("rows", [vectors(1, 400, 24), vectors(2, 90, 16, copies=60), vectors(6, 9, 16), []], ids=["spread", "copies", "few", "none"])
def test_codes_are_those_of_plain_lloyd(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    assert rows_of(codes.heap_lloyd(df, per_block=64)) == plain_codes(rows)


def test_codes_of_awkward_vectors(spark):
    rows = [r for r in awkward_vectors() if r[1] != []]
    df = spark.createDataFrame(rows, VECTORS).select("*", *(F.col("vec_id").alias(c) for c in ("x", "codes", "kind", "LABEL", "error", "salt", "key")))
    found = rows_of(codes.heap_lloyd(df.repartition(2)))
    assert found == plain_codes(rows) and len(found) == len(rows) - len(BAD) - 1
    one = spark.createDataFrame([(1, [3e38, -3e38], None), (2, [], None), (2, [0.0], 1)], VECTORS)
    assert len(codes.heap_lloyd(one).collect()) == 3


def test_text_labels_and_other_sizes(spark):
    rows = vectors(8, 200, 12)
    df = spark.createDataFrame([(i, v, str(b)) for i, v, b in rows], "vec_id long, embedding array<double>, label string")
    want = plain_codes(rows, parts=3, entries=5, rounds=4)
    assert rows_of(codes.heap_lloyd(df, parts=3, entries=5, rounds=4)) == want


def test_later_rounds_compare_only_parts_whose_bounds_fell():
    r = np.random.default_rng(1)
    x = np.floor(4096 * (r.choice([-4.0, -1.0, 1.0, 4.0], size=(2000, 2, 1)) + r.normal(size=(2000, 2, 3)) * 0.1)).astype(np.int64)
    books, drift, scanned = x[:6].transpose(1, 0, 2).copy(), np.zeros((2, 6)), []
    block = codes._Block(x, 6, None)
    for _ in range(30):
        block.round(books, drift)
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        assert (block.codes.T == far.argmin(axis=2)).all()
        scanned.append(block.scanned - sum(scanned))
        after = books.copy()
        for p, e in np.ndindex(2, 6):
            own = x[block.codes[p] == e, p]
            assert (block.sums[p, e] == [*own.sum(axis=0), len(own)]).all()
            after[p, e] = own.sum(axis=0) // len(own) if len(own) else books[p, e]
        drift, books = drift + codes.drifts(books, after), after
    assert scanned[0] == 4000 and sum(scanned[-3:]) == 0


DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def texts() -> list[tuple]:
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abcXY"), r.integers(1, 6))) for _ in range(150)]
    out = []
    for i in range(120):
        n = int(r.choice([5, 150, 250, 600]))
        t = " ".join(r.choice(words, n)) if i % 3 else " ".join(f"w{j}" for j in range(n))
        out.append((i, t + ("#" if i % 5 == 0 else ""), ["en", "de", "", None][i % 4]))
    copies = [(200 + i, out[4][1], "en") for i in range(60)] + [(1, out[10][1], "fr"), (10, out[10][1], "en"), (10, out[10][1], "en"), (-5, out[4][1], "xx")]
    odd = [(300, None, "en"), (301, "", None), (302, None, "de"), (None, out[4][1], "en"), (None, None, None), (303, "é 日 " * 300, "ja"), (304, "one two " * 20_000, "en"), (305, "A\x1cB\x0bC", "en")]
    return out + copies + odd


def labelled() -> list[tuple]:
    return [(i, i % 2, (i // 2) % 2) for i in range(0, 260, 3)] + [(3, 1, 0), (3, 0, 0), (4, None, 1), (None, 1, 1)]


def plain_audit(docs: list[tuple], labels: list[tuple]) -> list[tuple]:
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))
        rows.append((part or "", {f for f, x in zip("ABCDE", fails, strict=True) if x}, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, shapley, steps = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                left = [r for r in own if not r[1] & set(order[:s])]
                here = [r for r in left if f in r[1]]
                shapley[f] += len(here)
                steps.append(((part, "".join(order), s + 1, len(left) - len(here), len(here), sum(f in r[1] for r in own) - len(here), sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here)), f))
        out += [(*row, shapley[f]) for row, f in steps]
    return sorted(out, key=repr)


@pytest.mark.parametrize("prints", ["own", "colliding"])
def test_audit_is_that_of_plain_filters(spark, prints):
    docs = spark.createDataFrame(texts(), DOCS).repartition(5).select("*", *(F.col("doc_id").alias(c) for c in ("part", "mask", "TEXT", "id", "key")))
    found = filter_audit.filter_audit(docs, spark.createDataFrame(labelled(), LABELS), fingerprint_of=filter_audit.fingerprint if prints == "own" else len)
    assert rows_of(found) == plain_audit(texts(), labelled())


def test_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.filter_audit(docs, labels).collect() == []
    one = filter_audit.filter_audit(spark.createDataFrame([(1, None, None)], DOCS), labels)
    assert rows_of(one) == plain_audit([(1, None, None)], [])


def test_a_task_that_holds_little_at_a_time_finds_the_same_copies():
    rows = texts()
    copy = lambda i, t: i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
    want = sorted((repr(i), int(copy(i, t))) for i, t, _ in rows)
    for held in (1, 5000, 1 << 25):
        routed = sorted(filter_audit.route(iter(rows), held=held), key=lambda x: x[0])
        assert sorted((repr(i), m >> 4) for i, _, m in filter_audit.settle(iter(routed))) == want
