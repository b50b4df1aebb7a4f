"""Tools called from SQL: parameters, defaults, errors, and that they are planned with the rest of the query."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import sql_tools, tools


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "mail a@example.org\n010-1234-5678"), (2, "nothing"), (3, None)], "doc_id long, text string")


def test_only_tools_whose_tables_are_given_are_defined(spark, docs):
    assert set(sql_tools.register(spark, documents=docs)) == {"verify_references", "scan_pii", "pii_risk", "check_subcontract", "parse_document"}
    with pytest.raises(ValueError, match="no tool reads document$"):
        sql_tools.register(spark, document=docs)


def test_defaults_and_named_parameters(spark, docs):
    sql_tools.register(spark, documents=docs)
    found = tools.scan_pii(docs)[0]
    assert spark.sql("SELECT * FROM scan_pii()").count() == found.count() == 2
    assert spark.sql("SELECT * FROM scan_pii(min_confidence => 'high')").count() == found.where("rank >= 4").count()
    assert {(r.doc_id, r.risk) for r in spark.sql("SELECT doc_id, risk FROM pii_risk()").collect()} == {(r.doc_id, r.risk) for r in tools.scan_pii(docs)[1].collect()}
    joined = spark.sql("SELECT p.doc_id, count(*) AS n FROM parse_document() p JOIN scan_pii('medium') f ON p.doc_id = f.doc_id AND p.ord + 1 = f.line GROUP BY p.doc_id")
    assert [tuple(r) for r in joined.collect()] == [(1, 2)]


@pytest.mark.parametrize("call", ["scan_pii('loud')", "scan_pii(NULL)", "check_subcontract('maybe')", "parse_document(-1)", "verify_references('right')"])
def test_parameters_out_of_range_end_the_query(spark, docs, call):
    sql_tools.register(spark, documents=docs)
    with pytest.raises(Exception, match="is out of range"):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_required_parameters(spark):
    laws = spark.createDataFrame([("산업안전보건법", ["산안법"]), ("근로기준법", None)], "law_key string, aliases array<string>")
    sql_tools.register(spark, laws=laws)
    assert [r.law_key for r in spark.sql("SELECT * FROM search_articles('산안')").collect()] == ["산업안전보건법"]
    assert [r.law_key for r in spark.sql("SELECT * FROM search_articles('근로 기준')").collect()] == ["근로기준법"]
    with pytest.raises(Exception, match="out of range"):
        spark.sql("SELECT * FROM search_articles('  ')").collect()
    with pytest.raises(Exception, match="(?i)keyword|parameter|argument"):
        spark.sql("SELECT * FROM search_articles()").collect()


def test_without_a_registry_all_references_are_unreachable(spark, docs):
    refs = docs.select("doc_id", F.lit("[1] Kim, A. (2001). \"Title of a study\". doi:10.1/x.").alias("text"))
    sql_tools.register(spark, documents=refs)
    assert {r.status for r in spark.sql("SELECT status FROM verify_references()").collect()} == {"unreachable"}
    assert spark.sql("SELECT * FROM verify_references('verified')").count() == 0


def test_detections_and_papers(spark):
    d = spark.createDataFrame([("i", "gauge", "crack", 0.41, None), ("i", "gauge", "crack", 0.2, None), ("j", "defect", "crack", 0.9, None)], "image string, domain string, label string, conf double, box array<int>")
    p = spark.createDataFrame([("1", None, "Deep graph networks", 2), ("2", None, "Graph study", 1)], "doi string, url string, title string, ord long")
    sql_tools.register(spark, detections=d, papers=p, more_papers=p.limit(0))
    assert spark.sql("SELECT * FROM detect_objects('gauge')").count() == 1
    assert spark.sql("SELECT * FROM detect_objects('gauge', 0.1)").count() == 2
    assert [r.doi for r in spark.sql("SELECT doi FROM search_papers('GRAPH', 1)").collect()] == ["2"]
    assert [r.doi for r in spark.sql("SELECT doi FROM search_papers('networks, graph')").collect()] == ["1"]
    with pytest.raises(Exception, match="out of range"):
        spark.sql("SELECT * FROM detect_objects('roof')").collect()
