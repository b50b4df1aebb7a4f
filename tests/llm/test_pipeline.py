"""The pipeline stage by stage against brute force, and the registered queries against their SQL."""

import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from attesta.llm import exact_dedup, quality, registry
from tests.llm.test_operators import SPACES, WORD, components, prose

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = np.random.default_rng(5)
    texts = []
    for i in range(150):
        t = ". ".join(prose(100 * i + k, 14).capitalize() for k in range(5)) + "."
        kind = i % 10
        texts.append(t.upper().replace(" ", "!! ") if kind == 0 else t)
        if kind == 1:
            texts += [t, t.replace(" ", "  ")]
        if kind == 2:
            words = t.split()
            words[int(r.integers(len(words)))] = "other"
            texts.append(" ".join(words))
    texts += [None, "", "short text"]
    rows = [(i, t, "en", ["a", "b", "c", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    out = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return out


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if name != "packing":
            assert docs.columns == columns
        if name == "quality classifier":
            junk = {r.doc_id for r in before if "!!" in (r.text or "")}
            assert not junk & ids and len(ids) >= len(before) - len(junk) - 3
        elif name == "exact dedup":
            first = {}
            for r in sorted(before, key=lambda r: r.doc_id):
                first.setdefault(SPACES.sub(" ", r.text or ""), r.doc_id)
            assert ids == set(first.values()) and len(after) == len(ids)
        elif name == "n-gram Jaccard join":
            assert ids == {x[2] for x in components([(r.doc_id, r.text) for r in before], 5, 80)} and len(after) == len(ids)
        elif name == "mixing sources to target weights":
            size = lambda rows: sum(len(WORD.findall(r.text or "")) for r in rows)
            assert max(Counter(r.doc_id for r in after).values()) <= 2 and abs(size(after) - 1.5 * size(before)) <= 0.02 * size(before)
        else:
            per = Counter()
            for r in after:
                per[r.doc_id] += r.length
            for r in after:
                assert per[r.doc_id] % r.doc_tokens == 0
            assert ids == {r.doc_id for r in before}


def test_run_gives_the_last_stage(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_dedup_of_kept_rows_is_stable(spark, folder):
    docs = quality.keep_good(spark.read.parquet(f"{folder}/documents.parquet"))
    once = {r.doc_id for r in exact_dedup.keep_first(docs).collect()}
    assert once == {r.doc_id for r in exact_dedup.keep_first(docs).collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    want = c.sql(registry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted(map(repr, df[columns].astype(object).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_every_operator_has_a_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.queries()] == list(range(1, 14))
