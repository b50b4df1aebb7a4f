"""Similar titles against difflib over all pairs, and what verification makes of registries in any order."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import references, titles

WORDS = "learning of deep networks for the detection study a survey on methods analysis graph annual report safety 안전 관리 시스템 연구 site work and".split()


def made(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, k=r.randint(1, 14))) for _ in range(n)]


def mistyped(title: str, r: random.Random) -> str:
    out = list(title)
    for _ in range(r.randint(0, max(1, len(out) // 4))):
        at = r.randrange(len(out) + 1)
        kind = r.randrange(3)
        if kind == 0:
            out.insert(at, r.choice("abc xyz"))
        elif out and kind == 1:
            del out[min(at, len(out) - 1)]
        elif out:
            out[min(at, len(out) - 1)] = r.choice("qw e")
    return "".join(out)


def plain(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    half = lambda p: p[: len(p) // 2 + 1]
    ratio = difflib.SequenceMatcher(None, a, b).ratio()
    near = (len(a) >= 5 and b.startswith(half(a))) or (len(b) >= 5 and a.startswith(half(b)))
    return round(max(ratio, 0.9) if near else ratio, 4)


def sample(n: int) -> tuple[list[str], list[str]]:
    r = random.Random(5)
    right = [*made(1, n), "x" * 150, "ab" * 120, "deep", "deepl", "정보", ""]
    left = [*(mistyped(t, r) for t in right[: n // 2]), *made(2, n // 2), "x" * 149 + "y", "ab" * 100, "deep learning of deep networks for the detection of work and work and work and work", ""]
    return left, right


@pytest.mark.parametrize("least", [0.72, 0.5, 0.95])
def test_pairs_are_those_of_difflib_over_all_pairs(spark, least):
    left, right = sample(220)
    frame = lambda x: spark.createDataFrame([(t,) for t in x] + [(None,)], "title string")
    norm = lambda x: {" ".join(t.split()) for t in x} - {""}
    found = titles.similar_titles(frame(left).repartition(3), frame(right).repartition(3), least, size=100).collect()
    want = {(a, b, s) for a in norm(left) for b in norm(right) if (s := plain(a, b)) >= least}
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 20


def test_a_common_subsequence_bounds_the_ratio():
    left, right = sample(150)
    right = sorted(set(right) - {""})
    own = titles.Titles(sorted(set(left) - {""}), 0.01)
    block = titles.Block(right, own.alphabet)
    for i, t in enumerate(own.titles):
        rows, most = block.near(t, own.numbers[i], np.bincount(own.numbers[i], minlength=own.alphabet.size), 0.01)
        for r, m in zip(rows.tolist(), most.tolist(), strict=True):
            table = np.zeros((len(t) + 1, len(block.titles[r]) + 1), dtype=int)
            if i % 10 == 0 and r % 5 == 0:
                for x, c in enumerate(t):
                    for y, d in enumerate(block.titles[r]):
                        table[x + 1, y + 1] = table[x, y] + 1 if c == d else max(table[x, y + 1], table[x + 1, y])
                assert m == 2 * table[-1, -1] / (len(t) + len(block.titles[r]))
            assert difflib.SequenceMatcher(None, t, block.titles[r]).ratio() <= m + 1e-12


def test_similarity_rounds_as_the_join_does(spark):
    left, right = sample(60)
    pairs = [(a, b) for a in left[::3] for b in right[::3]] + [("0" * 3 + "_" * 29, "0" * 3 + "+" * 29)]
    for a, b, s in spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.title_similarity(F.col("a"), F.col("b"))).collect():
        clean = [" ".join("".join(c for c in x if c.isalnum() or c in "_ ").split()) for x in (a, b)]
        assert s == plain(*clean)


RECORD = "ord long, doi string, title string, first_author string, year string"


def records(n: int) -> list[tuple]:
    r = random.Random(9)
    names = ["Kim", "Lee", None, "Park, J."]
    return [(i, f"10.1000/{i}" if i % 4 else None, t, names[i % 4], str(1990 + i % 20) if i % 5 else None) for i, t in enumerate(made(3, n))] + [(n + i, f"10.2000/{i}", "annual report of the site", r.choice(names), "2001") for i in range(25)]


def plain_best(title, author, year, registry):
    best = None
    for o, doi, t, a, y in registry:
        s = plain(title, t)
        ok = author is None or a is None or author.lower() in a.lower().replace(",", "").replace(".", "") or a.lower().replace(",", "").replace(".", "") in author.lower()
        years = None if year is None or y is None else abs(int(year) - int(y))
        score = s - (0.0 if ok else 0.2) - (0.1 if years is not None and years > 1 else 0.0)
        if s >= 0.72 and (best is None or (-score, o) < best[0]):
            best = ((-score, o), (s, ok, years, doi))
    return best and best[1]


@pytest.mark.parametrize("size", [30, 20_000])
def test_best_match_is_the_first_of_the_highest_score(spark, size):
    r, registry = random.Random(11), records(150)
    refs = [(mistyped(t, r) if i % 2 else t, ["Kim", "Lee", None][i % 3], ["2001", "1995", None, "x"][i % 4]) for i, (_, _, t, _, _) in enumerate(registry[:90])] + [("annual report of the site", "Kim", "2001"), ("annual report of", "Nobody", "1950"), ("", "Kim", None), (None, None, None)]
    frame = spark.createDataFrame(refs, "title string, first_author string, year string").repartition(3)
    g = spark.createDataFrame(registry, RECORD).select(F.lit(1).alias("rank"), "*").repartition(4)
    found = {tuple(x[:3]): tuple(x[3:]) for x in titles.best_match(frame, g, 0.72, size=size).collect()}
    clean = lambda t: " ".join(t.split())
    for ref in set(refs):
        want = plain_best(clean(ref[0]), ref[1], ref[2] if ref[2] != "x" else None, registry) if ref[0] else None
        assert found.get(ref) == want, ref


REFS = "ref_id long, title string, doi string, arxiv string, first_author string, year string, kind string"


def test_verification_does_not_depend_on_the_order_of_rows(spark):
    refs = spark.createDataFrame([(1, "on the detection of graphs", "10.1/a", None, "Kim", "2001", "article")], REFS)
    rows = [("10.1/A", None, "on the detection of graphs", "Kim", "2001"), ("10.1/A", None, "on the detection of graphs", "Kim", "1980")]
    for order in (rows, rows[::-1]):
        g = spark.createDataFrame(order, "doi string, arxiv string, title string, first_author string, year string").coalesce(1)
        assert [(r["status"], r["diffs"]) for r in references.verify(refs, g).collect()] == [("verified", [])]


def test_every_status(spark):
    g = spark.createDataFrame(
        [("10.1/a", None, "graph networks for site safety", "Kim", "2001"), ("10.1/b", "2001.00001", "a survey on deep learning methods", "Lee", "2010"), ("10.1/c", None, "graph report", "Park", "2005"), ("10.1/d", None, None, None, None)],
        "doi string, arxiv string, title string, first_author string, year string",
    )
    rows = [
        (1, "graph networks for site safety", "10.1/A", None, "Kim", "2002", "article"),
        (2, "something else entirely here", "10.1/a", None, "Kim", "2001", "article"),
        (3, "graph networks for site safety", "10.1/zz", None, "Kim", "2001", "article"),
        (4, "zzz zzz zzz", "10.1/zz", None, "Kim", "2001", "article"),
        (5, "graph networks for site safty", None, None, "Other", "1950", "article"),
        (6, "graph report", None, None, "Kim", "2005", "article"),
        (7, "graph report", None, None, "Park", "1999", "article"),
        (8, "a survey on deep learning methods", None, "2001.00001", "Lee", "2010", "article"),
        (9, "a survey on deep learning methods", None, "2001.99999", "Lee", "2010", "article"),
        (10, "graph report", None, None, "Park", "2005", "web"),
        (11, "qqq www", None, None, None, None, "book"),
        (12, "qqq www", None, None, None, None, "article"),
        (13, None, "10.9/known", None, None, None, "article"),
        (14, "any title", "10.1/d", None, "Kim", "2001", "article"),
        (15, None, None, None, None, None, None),
    ]
    known = spark.createDataFrame([("10.9/KNOWN",)], "doi string")
    out = {r["ref_id"]: (r["status"], r["matched_doi"], r["diffs"]) for r in references.verify(spark.createDataFrame(rows, REFS), g, None, known).collect()}
    assert {k: v[0] for k, v in out.items()} == {1: "verified", 2: "partial", 3: "partial", 4: "unverified", 5: "verified", 6: "partial", 7: "verified", 8: "verified", 9: "unreachable", 10: "not_applicable", 11: "unreachable", 12: "unverified", 13: "partial", 14: "partial", 15: "unverified"}
    assert out[3][1] == "10.1/a" and out[2][2] == ["title_differs"] and out[6][2] == ["author_differs"]


def test_empty_tables(spark):
    none, g = spark.createDataFrame([], REFS), spark.createDataFrame([], "doi string, arxiv string, title string, first_author string, year string")
    assert references.verify(none, g).collect() == []
    one = spark.createDataFrame([(1, "a title of its own", None, None, None, None, "article")], REFS)
    assert [r["status"] for r in references.verify(one, g).collect()] == ["unverified"]


def test_lines_of_a_reference_are_merged_by_their_ends(spark):
    def plain(lines):
        out = []
        for line in (x.strip() for x in lines if x.strip()):
            if out and out[-1][-1].isalnum() and line[0].isalnum():
                out[-1] += line
            else:
                out.append(line)
        return " ".join(out)

    r = random.Random(6)
    cases = [["".join(r.choices("ab 9.-한,", k=r.randint(0, 5))) for _ in range(r.randint(0, 6))] for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, ls array<string>")
    got = {x.i: x.t for x in df.select("i", references.merge_lines(F.col("ls")).alias("t")).collect()}
    assert got == {i: plain(c) for i, c in enumerate(cases)}
    mended = spark.createDataFrame([(["doi: 10.", "1234/ab"],)], "ls array<string>").select(references.merge_lines(F.col("ls")).alias("t")).first().t
    assert mended == "doi: 10.1234/ab"


def test_papers_of_two_sources_as_a_dictionary_has_them(spark):
    r = random.Random(8)
    some = lambda n: [(r.choice([None, *(f"10.1/{k}" for k in range(6))]), r.choice([None, "u1", "u2"]), r.choice(["a title of twenty characters and more", "a title of twenty characters and other", "b"]), i) for i in range(n)]
    for _ in range(4):
        first, second, want = some(14), some(14), {}
        for rank, rows in ((1, first), (2, second)):
            for doi, url, title, o in rows:
                key = doi or url or (rank, title[:20])
                if doi and rank == 1:
                    want[key] = ((doi, url, title), rank, want[key][2] if key in want else o)
                elif key not in want:
                    want[key] = ((doi, url, title), rank, o)
        frame = lambda x: spark.createDataFrame(x, "doi string, url string, title string, ord long")
        got = {((x.doi, x.url, x.title), x.source_rank, x.ord) for x in references.union_registries(frame(first), frame(second)).collect()}
        assert got == set(want.values())


def test_unlike_titles_are_left_out_without_their_subsequences():
    """Sixteen million pairs of unlike titles with a common beginning, and the few like ones among them."""
    import hashlib
    import time

    sha = lambda i: "study " + hashlib.sha256(str(i).encode()).hexdigest()
    mine, others = [sha(i) for i in range(2000)], [sha(i) for i in range(10_000, 18_000)]
    others[::1000] = [t[:20] + "_" + t[24:] for t in mine[:8]]
    began, found = time.process_time(), set()
    pass_ = titles.Titles(mine, 0.72)
    for i, near in pass_.meet(others):
        found |= {(i, j) for j, most, begin in near if pass_.similarity(i, others[j], most, begin) >= 0.72}
    assert found == {(k, 1000 * k) for k in range(8)}
    assert time.process_time() - began < 15


def test_steps_leave_few_of_the_pairs_with_a_common_word():
    """Three million pairs of unlike titles that begin with the same word; what is left has its subsequences computed."""
    import hashlib

    made_ = lambda i: "study " + hashlib.sha256(str(i).encode()).hexdigest()
    own = titles.Titles([made_(i) for i in range(700)], 0.72)
    block = titles.Block([made_(i) for i in range(10_000, 14_096)], own.alphabet)
    left = sum(len(rows) for c in own.classes for _, rows in c.near(block))
    assert left < 0.003 * 700 * 4096
