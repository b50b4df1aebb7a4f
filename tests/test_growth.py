"""What keeps time and memory of a task from growing faster than the input."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions.literals import trie
from attesta.operators import checklist, references

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan_of(spark, name):
    from attesta.plans import catalog

    return catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", ["claim_ref_first_match", "link_missing", "link_uncited"])
def test_citations_and_references_meet_where_they_are_dealt(spark, name):
    """No join by estimated sizes, and no further exchange into a fixed number of partitions."""
    p = plan_of(spark, name)
    assert "Join" not in p and p.count("Exchange ") == p.count("REPARTITION_BY_NUM") == 2


def test_links_of_markers_with_nulls_and_other_types(spark):
    kind = "marker_type string, marker_value string"
    cited = spark.createDataFrame([(1, "number", "1"), (1, "number", "1"), (1, "number", "2"), (1, None, None)], f"doc_id int, {kind}")
    listed = spark.createDataFrame([(1, "number", "2"), (1, "number", "3"), (1, None, None), (2, "number", "1")], f"doc_id long, {kind}")
    uncited, missing = references.link_report(cited, listed)
    assert sorted(map(str, map(tuple, uncited.collect()))) == sorted(map(str, [(1, "number", "3"), (1, None, None), (2, "number", "1")]))
    assert sorted(map(str, map(tuple, missing.collect()))) == sorted(map(str, [(1, "number", "1"), (1, None, None)]))
    assert (uncited.schema["doc_id"].dataType.typeName(), missing.schema["doc_id"].dataType.typeName()) == ("long", "integer")
    refs = spark.createDataFrame([(1, 7, "[2] Kim"), (1, 5, "[2] Lee"), (2, 1, "[1] Kim")], "doc_id long, ref_id int, text string")
    got = references.first_matching_reference(cited.withColumn("ord", F.lit(3)), refs)
    assert got.columns == ["doc_id", "marker_type", "marker_value", "ord", "ref_id"]
    assert {(r.marker_value, r.ref_id) for r in got.collect()} == {("1", None), ("2", 5), (None, None)} and got.count() == 4


def test_a_line_is_split_at_one_character(spark):
    """A pattern of several characters is compiled anew for each row."""
    df = spark.range(1).select(T.sentences(F.col("id").cast("string")).alias("s"))
    assert "[\u0001\n]" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_as_before(spark):
    pieces = ["et al", "e.g", "i.e.", "Fig. ", "No.", " ", "\n", "\t", ".", "!", "。", "Kim", "x", "[1]", "(2001)", "\u0001", "\u0002", "St. ", "é", "가"]
    r = random.Random(1)
    texts = ["".join(r.choice(pieces) for _ in range(14)) for _ in range(500)] + [None, ""]
    held = F.regexp_replace(F.coalesce("t", F.lit("")), rf"(?<![\p{{L}}\p{{N}}])({'|'.join(a.replace('.', r'\.') for a in T.ABBREVIATIONS)})\.(?=\s)", "$1\u0002")
    cut = F.split(F.regexp_replace(held, r"([.!?。])[ \t]+(?=\S)", "$1\u0001"), "[\u0001\n]")
    want = F.filter(F.transform(cut, lambda x: F.trim(F.translate(x, "\u0002", "."))), lambda x: x != "")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.sentences(F.col("t")).alias("a"), want.alias("b")).collect()
    assert all(g.a == g.b for g in got)


def test_beginnings_are_compared_by_ranges():
    words = [chr(c) + tail for c in range(0xAC00, 0xAC00 + 40) for tail in ("x", "yz")] + ["]a", "-b", "^c"]
    pattern = trie(words)
    assert "(?=[" in pattern
    assert all(re.fullmatch(pattern, w) for w in words) and not re.search(pattern, "xyz ab c 힣x")


def test_more_rules_than_bits(spark):
    rules = [(1, k, f"rule {k}", [f"word{k:03}", "all"] if k % 2 else [rf"\bw\w*{k:03}"], [f"good{k:03}"], ["bad"] if k % 3 else []) for k in range(70)]
    docs = spark.createDataFrame([(1, "word003 and word065 bad. good000 word000; word069"), (2, "ALL of it"), (3, None)], "doc_id long, text string")
    key = ["doc_id", "axis", "item"]
    a, b = (sorted(map(str, f.orderBy(*key).collect())) for f in (checklist.evaluate_fixed(docs, rules), checklist.evaluate(docs, checklist.rules_table(spark, rules))))
    assert a == b and len(a) == 210


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_rules_of_a_sentence_are_bits(spark):
    """A list of rules would be gone through once for each rule and sentence."""
    assert "array_contains" not in plan_of(spark, "checklist_axis_summary")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_words_come_before_patterns_of_dates(spark):
    assert "Contains(line" in plan_of(spark, "notice_date_kinds")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_a_sum_of_points_searches_no_percentages(spark):
    assert "*%" not in plan_of(spark, "notice_score_tables").replace(r"(?:점|%)", "")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", ["notice_analysis", "notice_details"])
def test_parts_of_a_notice_are_never_broadcast(spark, name):
    """Their estimated size is that of a column of keys, whatever is found in the texts."""
    p = plan_of(spark, name)
    assert "Broadcast" not in p and p.count("Exchange ") == p.count("REPARTITION_BY_NUM")
