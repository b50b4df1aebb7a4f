"""Context in the header of comma-separated values, by column."""

import csv
import io

from pyspark.sql import functions as F

from attesta.operators import evidence, photos, pii

DOCS = "doc_id long, text string, is_csv boolean"


def found(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    return sorted((r.doc_id, r.line, r.type, r.value) for r in pii.scan(docs, rules=[r for r in pii.RULES if r.kind in ("account_number", "student_id")], header=F.col("is_csv")).collect())


def test_values_under_a_head_are_found_and_others_not(spark):
    table = "이름,계좌번호,금액\n가,110-123-456789,220-456-123456\n\"나, 다\",110-123-456780,1"
    assert found(spark, [(1, table, True), (2, table, False), (3, table, None)]) == [(1, 2, "account_number", "110-123-456789"), (1, 3, "account_number", "110-123-456780")]


def test_words_on_the_line_count_as_before(spark):
    assert found(spark, [(1, "a,b\n계좌,110-123-456789", True), (2, "계좌 110-123-456789", False)]) == [(1, 2, "account_number", "110-123-456789"), (2, 1, "account_number", "110-123-456789")]


def test_odd_tables(spark):
    assert found(spark, [(1, None, True), (2, "", True), (3, "계좌", True), (4, "계좌번호\n110-123-456789,220-456-123456", True)]) == [(4, 2, "account_number", "110-123-456789")]


def test_cells_and_columns_are_those_of_a_reader(spark):
    lines = ['a,b,c', '"x, y",b', '"q ""in"" it",2,"3,4",5', ',,', '']
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", pii._cells(F.col("line")).alias("cells"))
    for r in df.collect():
        want = next(csv.reader(io.StringIO(r.line)), [""])
        assert [c.strip('"').replace('""', '"') for c in r.cells] == want
    at = spark.createDataFrame([('"x, y",b,"c, d"', i) for i in (0, 2, 7, 10, 13)], "line string, at int")
    assert [r.c for r in at.select(pii._column(F.col("line"), F.col("at")).alias("c")).collect()] == [0, 0, 1, 2, 2]


def test_verdicts_of_answers(spark):
    answers = {'{"verdict": "뒷받침 안 함"}': "not_supported", '{"verdict": "supported"} 판단 불가': "supported", '{"verdict": "maybe"}': "cannot_judge", "뒷받침함": "supported", "결과: 뒷받침 안 함.": "not_supported", "판단 불가": "cannot_judge", "it contradicts": "not_supported", "": "cannot_judge", None: "cannot_judge"}
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    assert {r.a: r.v for r in df.select("a", evidence.verdict_in(F.col("a")).alias("v")).collect()} == answers


def test_domains_in_the_order_of_their_words(spark):
    said = {"압력계 균열": "defect", "온도 값": "gauge", "쓰레기 적재": "cleaning", "Cardboard pile": "cleaning", "측정 후 청소": "gauge", "": "defect"}
    df = spark.createDataFrame([(s,) for s in said], "s string")
    assert {r.s: r.d for r in df.select("s", photos.domain(F.col("s")).alias("d")).collect()} == said
