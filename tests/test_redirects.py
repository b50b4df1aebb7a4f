"""Ends of redirects against following every chain step by step."""

import random

import pytest

from attesta.operators import references

EDGES = "from_url string, to_url string"


def follow(edges: list, hops: int) -> dict:
    to = {}
    for a, b in edges:
        if a is not None and b is not None:
            to[a] = min(b, to.get(a, b))
    out = {}
    for url in to:
        seen, at = [url], to[url]
        while at in to and at not in seen and len(seen) < hops:
            seen.append(at)
            at = to[at]
        state = "cycle" if at in seen else "too_long" if at in to else "final"
        out[url] = (at, len(seen), state)
    return out


def made(seed: int, n: int) -> list:
    r = random.Random(seed)
    return [(f"p{i}", f"p{r.choice([i + 1, i + 1, i + 1, r.randrange(n)])}") for i in range(n) if r.random() < 0.93] + [(None, "p1"), ("p2", None), ("self", "self"), ("p5", "p3")]


@pytest.mark.parametrize("hops", [1, 2, 7, 10, 16])
def test_ends_are_those_of_following(spark, hops):
    edges = made(hops, 150)
    got = {r.url: (r.final_url, r.hops, r.state) for r in references.redirect_ends(spark.createDataFrame(edges, EDGES).repartition(3), hops).collect()}
    assert got == follow(edges, hops) and {s for _, _, s in got.values()} >= {"final", "cycle"}


def test_a_chain_of_a_thousand(spark):
    edges = [(f"c{i}", f"c{i + 1}") for i in range(1000)] + [(f"r{i}", f"r{(i + 1) % 700}") for i in range(700)]
    got = {r.url: (r.final_url, r.hops, r.state) for r in references.redirect_ends(spark.createDataFrame(edges, EDGES), 1000).collect()}
    assert got["c0"] == ("c1000", 1000, "final") and got["c999"] == ("c1000", 1, "final")
    assert got["r0"] == ("r0", 700, "cycle") and len(got) == 1700


def test_no_edges(spark):
    assert references.redirect_ends(spark.createDataFrame([], EDGES)).collect() == []
