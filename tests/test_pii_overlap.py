"""Overlapping findings against a plain greedy choice, and lines of very many of them."""

import random
import time

from pyspark.sql import functions as F

from attesta.operators import pii

SPANS = "array<struct<start:int,end:int,rule:int>>"


def rows(seed: int) -> list:
    """For each of up to five rules spans in order that don't overlap each other, touching ones among them."""
    r = random.Random(seed)
    out = []
    for rule in range(5):
        at, spans = r.randint(0, 6), []
        for _ in range(r.randint(0, 8) if r.random() < 0.7 else 0):
            n = r.randint(1, 6)
            spans.append((at, at + n, rule))
            at += n + r.choice([0, 0, 1, 1, 2, 7])
        out.append(spans)
    return out


def greedy(rules: list) -> list:
    kept = []
    for spans in rules:
        for s in spans:
            if not any(s[0] <= k[1] and s[1] >= k[0] for k in kept):
                kept.append(s)
    return sorted(kept)


def test_kept_are_those_of_the_plain_choice(spark):
    cases = [rows(i) for i in range(400)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + ", ".join(f"c{k} {SPANS}" for k in range(5)))
    got = {r.i: [tuple(s) for s in r.kept] for r in df.select("i", pii.keep_without_overlap([F.col(f"c{k}") for k in range(5)]).alias("kept")).collect()}
    assert got == {i: greedy(c) for i, c in enumerate(cases)}


def test_a_line_of_twenty_thousand_findings(spark):
    line = " ".join(f"u{i}@x.org 1588-{i % 10000:04d}" for i in range(10_000))
    docs = spark.createDataFrame([(1, line)], "doc_id long, text string")
    rules = [r for r in pii.RULES if r.kind in ("email", "toll_free")]
    began = time.time()
    found = pii.scan(docs, rules=rules)
    assert found.count() == 20_000
    masked = pii.masked_copies(docs, found).first()["masked_text"]
    assert time.time() - began < 30
    words = masked.split(" ")
    assert len(words) == 20_000 and all("***@" in w for w in words[::2]) and all("1588" not in w or "*" in w for w in words[1::2])


def test_touching_keys_of_one_rule(spark):
    key = "-----BEGIN PRIVATE KEY-----"
    docs = spark.createDataFrame([(1, key * 5), (2, f"{key} {key}")], "doc_id long, text string")
    found = pii.scan(docs, rules=[r for r in pii.RULES if r.kind == "private_key"])
    assert sorted((r.doc_id, r.start // len(key)) for r in found.collect()) == [(1, 0), (1, 2), (1, 4), (2, 0), (2, 1)]
