"""Rules that meet sentences through literals, against every pattern on every sentence."""

import random
import re

import pytest

from attesta.functions.literals import required, trie
from attesta.operators import checklist

PATTERNS = [r"직접\s*(지시|명령)", r"(ab|cd)+x", r"a?b*c", r"[xy]z", r"foo(?=bar)", r"(?i)Kiosk", r"plant (in|of) ALGERIA", r"a{0,2}q", r"^$", r"x|", r"(?:one|two) three", r"(unbalanced", r"배\d+치", r"\bstop\b"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_every_match_holds_a_required_literal(pattern):
    for any_case in (False, True):
        words = required(pattern, any_case)
        if pattern == "(unbalanced":
            assert words is None
            continue
        r, flags = random.Random(4), re.IGNORECASE if any_case else 0
        texts = ["".join(r.choices(["직접", " ", "지시", "명령", "ab", "cd", "x", "z", "c", "foo", "bar", "KIOSK", "kiosk", "Plant in Algeria", "plant of ALGERIA", "q", "one", "two", " three", "배1", "치", "stop"], k=r.randint(0, 6))) for _ in range(3000)]
        hit = [t for t in texts if re.search(pattern, t, flags)]
        low = any_case or "(?i)" in pattern
        assert words is None or all(any(w in (t.lower() if low else t) for w in words) for t in hit)


def test_what_is_required():
    assert required(r"직접\s*(지시|명령)") == {"직접"}
    assert required(r"원청 (조회|보고)") == {"원청 "}
    assert required(r"조회|아침\s*조회") == {"조회", "아침"}
    assert required(r"a?") is None and required(r"(?i)ski") is None
    assert required("PLANT", any_case=True) == {"plant"}


def test_trie_finds_what_the_words_find():
    r = random.Random(1)
    words = {"".join(r.choices("ab.가", k=r.randint(1, 4))) for _ in range(30)}
    for _ in range(2000):
        t = "".join(r.choices("ab.가나", k=r.randint(0, 8)))
        assert bool(re.search(trie(words), t)) == any(w in t for w in words)


def plain(texts: list, rules: list) -> dict:
    out = {}
    for i, t in texts:
        s = [x.strip() for x in re.split(r"[.?！；;:\n]+", t or "") if x.strip()]
        s = [x for x in s if not re.search(checklist.NEGATION, x.lower())]
        for axis, item, _, patterns, good, bad in rules:
            patterns = [patterns] if isinstance(patterns, str) else patterns
            e = [x for x in s if any(re.search(p, x, re.IGNORECASE) for p in patterns)]
            matched = [p for p in patterns if any(re.search(p, x, re.IGNORECASE) for x in e)]
            hit = lambda ws: [w for w in ws if any(w in x for x in e)]  # noqa: B023, E731
            label = "no_evidence" if not e else "risk" if hit(bad) else "compliant"
            out[i, axis, item] = (label, e, matched, hit(bad), hit(good))
    return out


def sample(n: int) -> list:
    r = random.Random(2)
    words = [w for row in checklist.DEFAULT for w in [*row[4], *row[5]]] + ["작업 방법", "급여  수준", "사내 Intranet", "INTRANET", "직접 지시", "없다", "않", "공정수행", "책임", "수급인 관리자", "Plant in X", "plant", "x"]
    return [(i, "".join(w + r.choice([" ", ". ", "\n", "; ", ""]) for w in r.choices(words, k=r.randint(0, 9)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "...")]


OWN = [(1, 1, "case", "PLANT (in|of)", ["X"], ["plant"]), (1, 2, "none", r"\d|x{0,2}$", [], []), (2, 1, "many", ["급여", r"책\s*임"], ["책임"], [])]


@pytest.mark.parametrize("rules", [checklist.DEFAULT, OWN], ids=["default", "own"])
def test_both_ways_find_what_all_patterns_find(spark, rules):
    texts = sample(150)
    docs, want = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), plain(texts, rules)
    for found in (checklist.evaluate(docs, checklist.rules_table(spark, rules)), checklist.evaluate_fixed(docs, rules)):
        got = {(r.doc_id, r.axis, r.item): (r.label, r.evidence, r.matched_patterns, r.risk_hits, r.compliant_hits) for r in found.collect()}
        assert got == want


def test_no_rules_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "급여")], "doc_id long, text string")
    assert checklist.evaluate(docs, checklist.rules_table(spark, [])).collect() == []
    assert checklist.evaluate(docs.limit(0), checklist.rules_table(spark)).collect() == []
    assert checklist.evaluate_fixed(docs.limit(0)).collect() == []


def test_the_default_items():
    assert [len(r[3]) for r in checklist.DEFAULT] == [3, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3, 2, 2, 2]
    assert all(required(p, any_case=True) for r in checklist.DEFAULT for p in r[3])
