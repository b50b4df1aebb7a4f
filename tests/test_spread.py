"""Rows whose work is long are dealt out over all cores before it, whatever file they come from."""

import os

import pytest
from pyspark.sql import functions as F

from attesta.operators import notice
from attesta.storage import spread

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DEALT = ["notice_long_line", "law_claim_check", "notice_date_kinds", "claim_ref_first_match", "checklist_labels", "claim_markers", "notice_details", "checklist_axis_summary", "reference_extraction", "claims_per_doc", "notice_analysis", "link_missing", "sql_analyze_notice", "notice_score_tables", "ref_cross_page_merge", "pii_csv_accounts"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", DEALT)
def test_rows_are_dealt_out_first(spark, name):
    from attesta.plans import catalog

    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_more_rows_more_partitions(spark):
    cores = spark.sparkContext.defaultParallelism
    assert [spread(spark.range(n), "id", rows=10).rdd.getNumPartitions() for n in (5, 10_000)] == [2 * cores, 1000]


def test_dates_beside_the_sign_that_splits(spark):
    docs = spark.createDataFrame([(1, "2026-09-01\1 2026-09-02 (\1) 10:00, 9. 31. (월), 9월 3일 오후 2시")], "doc_id long, text string")
    got = notice.dates(docs, F.to_date(F.lit("2026-08-01"))).orderBy("date").collect()
    assert [(r.raw, str(r.date), r.time) for r in got] == [("2026-09-01", "2026-09-01", None), ("2026-09-02", "2026-09-02", "10:00"), ("9월 3일", "2026-09-03", "14:00")]
