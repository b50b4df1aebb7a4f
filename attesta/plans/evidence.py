"""Further registered queries: reports, drafts, notices, snapshots and the small operators between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import evidence, references, reports, tools
from attesta.plans.catalog import _ITEMS, _items, query, table
from attesta.storage import spread

# -- References -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS ref_id, 'unreachable' AS status FROM part")
def ref_verify_offline(spark, d):
    refs = table(spark, d, "part").select(F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("title"))
    return references.verify(refs, None).select("ref_id", "status")


@query("SELECT p_partkey AS ref_id, CASE p_partkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'verified' WHEN 2 THEN 'partial' ELSE 'unverified' END AS status FROM part")
def ref_verify_second_registry(spark, d):
    """arXiv ids in the first registry, DOIs in the second, DOIs that are only registered, and unknown ones."""
    p = table(spark, d, "part")
    none = F.lit(None).cast("string")
    refs = p.select(F.col("p_partkey").alias("ref_id"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("title"), F.expr("case when p_partkey % 4 > 0 then '10.2000/' || p_partkey end").alias("doi"), F.expr("case when p_partkey % 4 = 0 then '2001.' || (10000 + p_partkey) end").alias("arxiv"), F.lit("Lee").alias("first_author"), F.lit("2001").alias("year"), F.lit("article").alias("kind"))
    record = lambda k, doi, arxiv: p.where(f"p_partkey % 4 = {k}").select(doi.alias("doi"), arxiv.alias("arxiv"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("title"), F.lit("Lee").alias("first_author"), F.lit("2002").alias("year"))
    first, second = record(0, none, F.expr("'2001.' || (10000 + p_partkey)")), record(1, F.expr("'10.2000/' || p_partkey"), none)
    return references.verify(refs, first, second, p.where("p_partkey % 4 = 2").selectExpr("'10.2000/' || p_partkey AS doi")).select("ref_id", "status")


_NOTE = "CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'no candidate found' ELSE 'titles differ; author differs; year differs by 4' END"


@query(f"SELECT p_partkey AS ref_id, {_NOTE} AS note FROM part")
def ref_notes(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey AS ref_id", "case when p_partkey % 3 = 0 then 'verified' else 'unverified' end AS status", "case p_partkey % 3 when 0 then 1.0D when 2 then 0.5D end AS similarity", "case when p_partkey % 3 = 2 then false end AS author_ok", "case when p_partkey % 3 = 2 then 4 end AS year_diff")
    return p.select("ref_id", reports.unverified_note(*map(F.col, ("status", "similarity", "author_ok", "year_diff"))).alias("note"))


_STATUS = "CASE WHEN l_returnflag = 'R' THEN 'verified' WHEN l_returnflag = 'A' THEN 'partial' ELSE 'unverified' END"


@query(
    f"""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS ref_id, {_STATUS} AS status, 'part ' || l_partkey AS title FROM lineitem),
s AS (SELECT doc_id, 1 AS part, 0 AS no, 'references: ' || count(*) || ', verified: ' || count(*) FILTER (status = 'verified') || ', partial: ' || count(*) FILTER (status = 'partial') || ', unverified: ' || count(*) FILTER (status = 'unverified') || ', unreachable: 0, not_applicable: 0' AS line FROM r GROUP BY doc_id
UNION ALL SELECT DISTINCT doc_id, 2, 0, 'verified from a title similarity of 0.85, partial from 0.72' FROM r
UNION ALL SELECT DISTINCT doc_id, 3, 0, '| no | status | title |' || chr(10) || '|-|-|-|' FROM r
UNION ALL SELECT doc_id, 3, ref_id, '| ' || ref_id || ' | ' || status || ' | ' || title || ' |' FROM r
UNION ALL SELECT doc_id, 4, ref_id, '[' || ref_id || '] ' || title FROM r WHERE status = 'partial'
UNION ALL SELECT doc_id, 5, ref_id, '- ' || ref_id || ': titles differ' FROM r WHERE status = 'unverified')
SELECT doc_id, string_agg(line, chr(10) ORDER BY part, no, line) AS markdown FROM s GROUP BY doc_id"""
)
def reference_report_full(spark, d):
    r = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS ref_id", f"{_STATUS} AS status", "'part ' || l_partkey AS title")
    r = r.withColumns({"entry": F.when(F.col("status") == "partial", F.col("title")), "note": F.when(F.col("status") == "unverified", "titles differ")})
    return reports.reference_report(r)


@query(f"SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS n, CASE WHEN l_partkey % 10 < 6 THEN l_partkey END AS part FROM {_ITEMS}")
def claim_metadata(spark, d):
    li = _items(spark, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), F.col("l_linenumber").alias("ref_id"), "l_partkey")
    meta = li.where("l_partkey % 10 < 6").select("doc_id", "ref_id", F.col("l_partkey").cast("string").alias("title"), F.lit("").alias("abstract"))
    return evidence.with_metadata(li.select("doc_id", "n", "ref_id"), meta).select("doc_id", "n", F.col("title").cast("long").alias("part"))


@query("WITH c AS (SELECT l_partkey AS ref_id, l_orderkey AS cand, l_linenumber AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) SELECT ref_id, cand, CAST(n AS INT) AS n FROM c WHERE k <= 3")
def candidates_first_three(spark, d):
    c = table(spark, d, "lineitem").selectExpr("l_partkey AS ref_id", "l_orderkey AS cand", "l_linenumber AS n", "l_extendedprice")
    return evidence.first_rows(c, ["ref_id"], [F.desc("l_extendedprice"), "cand", "n"], 3).select("ref_id", "cand", "n")


@query("SELECT p_partkey AS ref_id, 'title' AS source FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'preprint' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'text' FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 3 <> 0")
def candidate_union(spark, d):
    p = table(spark, d, "part")
    some = lambda where, source: p.where(where).select(F.col("p_partkey").alias("ref_id"), F.lit(source).alias("source"))
    return evidence.candidate_union(some("p_partkey % 5 = 0", "title"), some("p_partkey % 3 = 0", "preprint"), some("true", "text"))


@query("SELECT p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 2 = 0 THEN 2 END AS found, CASE WHEN p_partkey % 3 = 0 THEN 'first' WHEN p_partkey % 2 = 0 THEN 'second' END AS value FROM part")
def snapshot_lookup(spark, d):
    """DOI handles, a second registry and archived pages are asked one after the other."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("url"))
    some = lambda where, v: p.where(where).select(F.col("url").alias("key"), F.lit(v).alias("value"))
    return evidence.by_snapshots(p, "url", some("url % 3 = 0", "first"), some("url % 2 = 0", "second"))


@query("SELECT p_partkey AS doi, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE p_partkey % 4 = 0 END AS retracted FROM part")
def tool_check_retraction(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doi"), F.col("p_partkey").alias("k"))
    registry = p.where("k % 4 < 3").select("doi", F.expr("case when k % 4 = 0 then array('retraction') else array('correction') end").alias("update_types"), F.lit(False).alias("is_retracted"))
    return tools.check_retraction(p.select("doi"), registry).select(F.col("doi").cast("long").alias("doi"), "retracted")


@query("SELECT p_partkey AS url, CASE WHEN p_partkey % 2 = 0 THEN 'copy' END AS snapshot FROM part")
def tool_find_snapshot(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("url"))
    return tools.find_snapshot(p, p.where("url % 2 = 0").select(F.col("url").alias("key"), F.lit("copy").alias("value")))


@query("SELECT p_partkey AS url, CASE WHEN p_partkey % 10 > 5 THEN p_partkey // 10 * 10 + 10 ELSE p_partkey END AS final_url, CASE WHEN p_partkey % 10 IN (0, 6, 7, 8, 9) AND (CASE WHEN p_partkey % 10 > 5 THEN p_partkey // 10 * 10 + 10 ELSE p_partkey END) <= (SELECT max(p_partkey) FROM part) THEN '200' END AS status FROM part")
def tool_check_url(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("url"))
    pages = p.where("url % 10 = 0").select(F.col("url").alias("key"), F.lit(200).alias("value"))
    edges = p.where("url % 10 > 5").select(F.col("url").alias("from_url"), (F.col("url") + 1).alias("to_url"))
    return tools.check_url(p, pages, edges).select("url", "final_url", "status")


_ANSWER = "CASE l_linenumber % 5 WHEN 0 THEN '{{\"verdict\": \"supported\"}}' WHEN 1 THEN 'So: {{\"verdict\": \"not_supported\", \"quote\": \"\"}}' WHEN 2 THEN 'The claim is not supported.' WHEN 3 THEN 'This cannot be told' ELSE 'It is supported by the text' END".replace("{{", "{").replace("}}", "}")


@query("SELECT l_orderkey AS doc_id, CASE l_linenumber % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'not_supported' WHEN 2 THEN 'not_supported' WHEN 3 THEN 'cannot_judge' ELSE 'supported' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1, 2")
def model_verdicts(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), evidence.verdict_in(F.expr(_ANSWER)).alias("verdict"))
    return a.groupBy("doc_id", "verdict").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS status, count(*) AS n FROM lineitem GROUP BY 1")
def status_histogram(spark, d):
    return evidence.status_histogram(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("status")))


@query("SELECT l_orderkey AS doc_id, CAST(sum(l_linenumber) AS BIGINT) AS total_risk FROM lineitem GROUP BY 1")
def total_risk(spark, d):
    return evidence.total_risk(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("risk_count")))


@query("SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag = 'R') AS critical FROM lineitem GROUP BY 1")
def critical_count(spark, d):
    return evidence.critical_count(table(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", "case l_returnflag when 'R' then 'critical: missing' when 'A' then 'minor' end AS reason"))


@query("SELECT o_orderkey AS doc_id, CAST(1 AS BIGINT) AS item_no, 'Kim, A. (2001). Title ' || o_orderkey || ' goes on. Journal.' AS item FROM orders UNION ALL SELECT o_orderkey, 2, 'Lee, B. (2002). Other.' FROM orders")
def author_year_items(spark, d):
    text = "'Kim, A. (2001). Title ' || o_orderkey || '\\n  goes on. Journal.\\nLee, B. (2002). Other.'"
    lines = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.split(F.expr(text), "\n")).alias("line_no", "line"))
    return evidence.author_year_items(lines)


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1")
def body_blocks(spark, d):
    e = table(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", "case l_linenumber % 3 when 0 then 'list' when 1 then 'Paragraph' else 'text_block' end AS category")
    return references.body_blocks(e).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"WITH i AS (SELECT l_orderkey, l_linenumber, bool_or(l_linenumber = 4) OVER (PARTITION BY l_orderkey) AS headed FROM {_ITEMS}) SELECT l_orderkey AS doc_id, string_agg('line ' || l_linenumber, chr(10) ORDER BY l_linenumber) AS body FROM i WHERE l_linenumber < 4 OR NOT headed GROUP BY 1")
def body_text(spark, d):
    e = _items(spark, d).selectExpr("l_orderkey AS doc_id", "l_linenumber AS position", "case when l_linenumber = 4 then 'References' else 'line ' || l_linenumber end AS text")
    return references.body_text(references.split_sections(e))


@query("SELECT p_partkey AS doc_id, p_partkey % 3 < 2 AS passport, p_partkey % 2 = 0 AS landline FROM part")
def number_forms(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey AS doc_id", "case p_partkey % 3 when 0 then 'M12345678' when 1 then 'M123A4567' else 'M1234' end AS passport", "case when p_partkey % 2 = 0 then '02-1234-5678' else '010-1234-5678' end AS phone")
    return p.select("doc_id", evidence.passport_form(F.col("passport")).alias("passport"), evidence.fax_or_landline(F.col("phone")).alias("landline"))


@query("SELECT s_suppkey AS name FROM supplier WHERE s_suppkey % 4 <> 1")
def enabled_servers(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey AS name", "case s_suppkey % 4 when 0 then true when 1 then false end AS enabled")
    return evidence.enabled(s).select("name")


# -- Photos and drafts ------------------------------------------------------------------------------------------------


@query(f"SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS photo_no FROM {_ITEMS} WHERE l_linenumber <= 3")
def photo_by_name(spark, d):
    li = _items(spark, d).where("l_linenumber <= 3")
    results = li.selectExpr("l_orderkey AS doc_id", "'/tmp/job/' || 'p' || l_linenumber || '.jpg' AS path")
    own = li.selectExpr("l_orderkey AS doc_id", "l_linenumber AS photo_no", "'p' || l_linenumber || '.jpg' AS file")
    return evidence.photo_numbers(results, own).select("doc_id", "photo_no")


_DRAFT_LABEL = "CASE WHEN event_id % 2 = 0 THEN 'crack' ELSE 'paper' END"
_DRAFT_CONF = "(event_id * 37 % 64) / 64.0"




_TAGS_SQL = f"""t AS (SELECT user_id AS doc_id, event_id % 3 + 1 AS photo_no, {_DRAFT_LABEL} AS label, max(CAST((event_id * 37 % 4) * 0.25 AS DOUBLE)) AS conf FROM events GROUP BY 1, 2, 3),
g AS (SELECT doc_id, photo_no, string_agg('[사진' || photo_no || ':' || label || ' ' || printf('%.2f', conf) || ']', ' ' ORDER BY label) AS tags FROM t GROUP BY 1, 2)"""


def _quarters(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 3 + 1).alias("photo_no"), F.expr(_DRAFT_LABEL).alias("label"), F.expr("cast((event_id * 37 % 4) * 0.25 as double)").alias("conf"))


@query(f"WITH {_TAGS_SQL} SELECT doc_id, photo_no, tags FROM g")
def photo_tags(spark, d):
    return reports.photo_tags(_quarters(spark, d))


def _inspected(spark, d):
    return _quarters(spark, d).groupBy("doc_id", "photo_no").agg(F.expr("case when bool_or(label = 'crack') then 'risk' else 'caution' end").alias("severity"), F.lit("c").alias("categories"))


@query(
    f"""WITH {_TAGS_SQL}, i AS (SELECT doc_id, photo_no, CASE WHEN bool_or(label = 'crack') THEN 'risk' ELSE 'caution' END AS severity FROM t GROUP BY 1, 2)
SELECT doc_id, string_agg('photo ' || photo_no || ' (' || severity || '): c ' || tags || chr(10), chr(10) ORDER BY photo_no) AS markdown FROM i JOIN g USING (doc_id, photo_no) GROUP BY 1"""
)
def draft_report(spark, d):
    return reports.draft(_inspected(spark, d), reports.photo_tags(_quarters(spark, d)))


@query("SELECT o_orderkey AS doc_id, CAST(0 AS INT) AS block_no, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '(to be checked) ' END || '[사진1:crack 0.50] 제2조' AS text, o_orderkey % 2 = 0 AS valid FROM orders UNION ALL SELECT o_orderkey, 2, 'plain', true FROM orders")
def draft_checked(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    drafted = reports.blocks(o.withColumn("markdown", F.lit("[사진1:crack 0.50] 제2조\n\n제99조 is cited\n \nplain")))
    detections = o.select("doc_id", F.lit("crack").alias("label"), F.expr("case when doc_id % 2 = 0 then 0.5D else 0.25D end").alias("conf"))
    articles = spark.createDataFrame([("L", a, None) for a in range(1, 10)], "law_key string, article int, sub int")
    return reports.checked_blocks(drafted, detections, articles, "L")


@query("SELECT DISTINCT user_id AS image, 'L' AS law, CASE WHEN event_id % 2 = 0 THEN CAST(3 AS INT) ELSE CAST(5 AS INT) END AS article, 'text ' || CASE WHEN event_id % 2 = 0 THEN '3' ELSE '5' END AS excerpt FROM events WHERE event_id % 3 > 0")
def law_excerpts(spark, d):
    e = table(spark, d, "events").selectExpr("user_id AS image", "case when event_id % 3 = 0 then 'helmet' when event_id % 2 = 0 then 'crack' else 'paper' end AS label")
    labels = spark.createDataFrame([("crack", "L", 3), ("paper", "L", 5), ("helmet", None, None)], "label string, law string, article int")
    articles = spark.createDataFrame([("L", a, None, f"text {a}") for a in range(1, 10)], "law_key string, article int, sub int, full_text string")
    return reports.law_excerpts(e, labels, articles)


@query("SELECT user_id AS image, count(*) AS n FROM events WHERE event_id % 4 = 0 AND (event_id * 37 % 64) / 64.0 >= 0.25 GROUP BY 1")
def tool_detect_objects(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("image"), F.expr("case event_id % 4 when 0 then 'defect' when 1 then 'gauge' else 'safety' end").alias("domain"), F.lit("crack").alias("label"), F.expr(f"cast({_DRAFT_CONF} as double)").alias("conf"))
    return tools.detect_objects(e, "defect").groupBy("image").agg(F.count("*").alias("n"))


# -- Notices ----------------------------------------------------------------------------------------------------------

_DAY = "(1 + o_orderkey % 28)"


def _calls(spark, d):
    text = f"'# 창업 공모전 공고\\n접수 마감: 2026-09-' || lpad({_DAY}, 2, '0') || ' 18:00\\n마감 이후 제출은 실격 처리\\n심사 기준\\n| 창의성 | 60점 |\\n| 실현성 | 40점 |\\n결과 발표: 2026-12-' || lpad({_DAY}, 2, '0') || ', 분량 20쪽 이내, 문의 a' || o_orderkey || '@x.org'"
    return spread(table(spark, d, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.expr(text).alias("text"))


@query(
    """SELECT o_orderkey AS doc_id, true AS likely, '창업 공모전 공고' AS title, CAST('2026-09-' || lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0') AS DATE) AS deadline, 'D-' || (31 + o_orderkey % 28) AS dday_label, CAST(2 AS BIGINT) AS score_lines, CAST(100 AS DOUBLE) AS total, true AS near_hundred,
CAST(1 AS BIGINT) AS risks FROM orders"""
)
def notice_analysis(spark, d):
    found = tools.analyze_notice(_calls(spark, d), F.to_date(F.lit("2026-08-01")), ["2026-09-24"])
    return found.select("doc_id", "likely", "title", "deadline", "dday_label", "score_lines", "total", "near_hundred", "risks")


@query(
    """WITH o AS (SELECT o_orderkey AS doc_id, CAST(1 + o_orderkey % 28 AS INT) AS k, make_date(2026, 9, CAST(1 + o_orderkey % 28 AS INT)) AS d1, make_date(2026, 12, CAST(1 + o_orderkey % 28 AS INT)) AS d2 FROM orders),
w AS (SELECT *, CASE WHEN isodow(d1) > 5 THEN 'weekend' ELSE '' END AS w1, CASE WHEN isodow(d2) > 5 THEN 'weekend' ELSE '' END AS w2, CASE WHEN d1 >= DATE '2026-09-24' THEN 'holiday:2026-09-24' ELSE '' END AS h1 FROM o)
SELECT doc_id, 'ok' AS status, d1 AS deadline, '18:00' AS time, 'submission_deadline' AS kind,
 '2 submission_deadline D-' || (30 + k) || ' ' || array_to_string(list_filter([w1, h1], lambda x: x <> ''), '+') || '; 7 announcement D-' || (121 + k) || ' ' || array_to_string(list_filter([w2, 'holiday:2026-09-24'], lambda x: x <> ''), '+') AS schedule,
 '3 실격' AS risks, '7 limit=20쪽 이내,pages=20' AS specs, '5 60.00 60.00+40.00; 6 40.00 40.00' AS scores, CAST(100 AS DOUBLE) AS total, 'a' || doc_id || '@x.org' AS emails, w1 <> '' OR w2 <> '' AS weekend FROM w"""
)
def notice_details(spark, d):
    """The nested lists of a notice, one line each."""
    found = reports.notice_details(_calls(spark, d), F.to_date(F.lit("2026-08-01")), ["2026-09-24"])
    joined = lambda c, f: F.array_join(F.transform(c, f), "; ")
    numbers = lambda c: F.array_join(F.transform(c, lambda x: x.cast("decimal(9,2)").cast("string")), "+")
    return found.select(
        "doc_id", "status", F.col("primary_deadline.date").alias("deadline"), F.col("primary_deadline.time").alias("time"), F.col("primary_deadline.kind").alias("kind"),
        joined("schedule", lambda r: F.concat_ws(" ", r["line_no"], r["kind"], r["dday_label"], F.array_join(r["warnings"], "+"))).alias("schedule"),
        joined("risk_lines", lambda r: F.concat_ws(" ", r["line_no"], r["keyword"])).alias("risks"),
        joined("spec_lines", lambda r: F.concat_ws(" ", r["line_no"], F.array_join(F.transform(r["specs"], lambda s: F.concat_ws("=", s["spec"], s["value"])), ","))).alias("specs"),
        joined("score_lines", lambda r: F.concat_ws(" ", r["line_no"], numbers(r["points"]), numbers(r["cells"]))).alias("scores"),
        F.col("score_sum.total").alias("total"), F.array_join("contacts.emails", ",").alias("emails"), F.col("date_flags.weekend").alias("weekend"),
    )


@query("SELECT DISTINCT n_nationkey AS law_no, CAST(a AS INT) AS article, CASE a WHEN 1 THEN '목적' ELSE '정의' END AS title FROM nation, (VALUES (1), (2)) t(a)")
def law_layouts(spark, d):
    """Articles from Markdown and from HTML, with metadata before them and an addendum after."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("law_key"), F.expr("case when n_nationkey % 2 = 0 then '시행 2020\\n## 제1조(목적) 이 법은\\n## 제2조(정의) 다음\\n부칙\\n제1조(시행일) 오늘' else '<p>시행</p><p>제1조(목적) 이 법은</p><div>제2조(정의) 다음</div><p>부 칙</p><p>제1조(시행일)</p>' end").alias("text"))
    return reports.law_articles_of(n).select(F.col("law_key").alias("law_no"), "article", "title")
