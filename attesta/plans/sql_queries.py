"""Registered queries of the tools in SQL: their tables are derived from those of the session, the rest is spark.sql."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import sql_tools
from attesta.plans.catalog import _articles, _ARTICLES_SQL, _cites, _CITES_SQL, query, table
from attesta.storage import spread


_REFERENCE = "'[1] Kim, A. (2001). \"' || {sha} || '\". doi:10.1000/' || p_partkey || '.'"


@query("SELECT p_partkey AS doc_id, '10.1000/' || p_partkey AS doi, CASE p_partkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'partial' ELSE 'unverified' END AS status FROM part WHERE p_partkey % 3 < 2")
def sql_verify_references(spark, d):
    """References that a registry has, rightly or under another title."""
    p = table(spark, d, "part").withColumn("sha", F.sha2(F.col("p_partkey").cast("string"), 256))
    docs = p.select(F.col("p_partkey").alias("doc_id"), F.expr(_REFERENCE.format(sha="sha")).alias("text"))
    registry = p.where("p_partkey % 3 < 2").select(F.expr("'10.1000/' || p_partkey").alias("doi"), F.lit(None).cast("string").alias("arxiv"), F.expr("case when p_partkey % 3 = 0 then sha else 'zzz' end").alias("title"), F.lit("Kim").alias("first_author"), F.lit("2001").alias("year"))
    sql_tools.register(spark, documents=docs, registry=registry)
    return spark.sql("SELECT doc_id, doi, status FROM verify_references() WHERE status <> 'unverified'")


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem WHERE l_partkey % 3 = 0 AND l_returnflag = 'R' GROUP BY 1")
def sql_match_claim(spark, d):
    """Claims whose quote isn't in the abstract, by a tool that is asked for those that can't be judged."""
    m = table(spark, d, "lineitem").select("l_returnflag", F.expr("case when l_returnflag = 'R' then 'supported' else 'not_supported' end").alias("verdict"), F.expr("case when l_partkey % 3 = 0 then 'words that do not occur there' else 'a statement about part ' || l_partkey end").alias("quote"), F.lit("Title").alias("title"), F.expr("'It has a statement about part ' || l_partkey || ' in it.'").alias("abstract"))
    sql_tools.register(spark, matches=m)
    return spark.sql("SELECT l_returnflag AS flag, count(*) AS n FROM match_claim('cannot_judge') GROUP BY l_returnflag")


_MAILS = "'mail u' || p_partkey || '@example.org' || CASE WHEN p_partkey % 2 = 0 THEN ' and call 1588-' || lpad(CAST(p_partkey % 10000 AS {s}), 4, '0') ELSE '' END"


@query("SELECT p_partkey AS doc_id, 'email' AS type, CAST(5 AS INT) AS start, 'u' || p_partkey || '@example.org' AS value FROM part")
def sql_scan_pii(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_MAILS.format(s="string")).alias("text"))
    sql_tools.register(spark, documents=docs)
    return spark.sql("SELECT doc_id, type, start, value FROM scan_pii(min_confidence => 'high')")


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS n_findings, 'MEDIUM' AS risk, count(*) AS documents FROM part GROUP BY 1")
def sql_pii_risk(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(_MAILS.format(s="string")).alias("text"))
    sql_tools.register(spark, documents=docs)
    return spark.sql("SELECT n_findings, risk, count(*) AS documents FROM pii_risk() GROUP BY ALL")


@query(f"WITH {_ARTICLES_SQL}, {_CITES_SQL} SELECT cite_id FROM c WHERE EXISTS (FROM a WHERE a.law_key = c.law_key) AND NOT EXISTS (FROM a WHERE a.law_key = c.law_key AND a.article = c.article AND c.paragraph <= a.n_par)")
def sql_lookup_article(spark, d):
    sql_tools.register(spark, citations=_cites(spark, d), articles=_articles(spark, d))
    return spark.sql("SELECT cite_id FROM lookup_article('no_such_article')")


@query("SELECT n_name AS law_key FROM nation WHERE contains(n_name, 'AN') OR contains('ALIAN' || n_nationkey, 'AN1')")
def sql_search_articles(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("law_key"), F.array(F.when(F.expr("n_nationkey like '1%'"), F.expr("'ALIAN' || n_nationkey")).otherwise(F.lit("none"))).alias("aliases"))
    sql_tools.register(spark, laws=n)
    return spark.sql("SELECT law_key FROM search_articles(' A N')")


@query("SELECT o_orderkey AS doc_id, CAST(1 AS INT) AS axis, CAST(1 AS INT) AS item FROM orders WHERE o_orderkey % 3 = 0")
def sql_check_subcontract(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr("case cast(o_orderkey % 3 as int) when 0 then '원청이 직접 지시 했다' when 1 then '수급인이 직접 명령 했다' else '특이 사항' end").alias("text"))
    sql_tools.register(spark, documents=docs)
    return spark.sql("SELECT doc_id, axis, item FROM check_subcontract(wanted => 'risk')")


@query("WITH u AS (SELECT 'd' || p_partkey AS doi, 'Study of item ' || p_partkey % 7 || ' in group ' || p_partkey % 5 AS title, 1 AS r, p_partkey AS ord FROM part UNION ALL SELECT 's' || s_suppkey, 'A group 3 study of ' || s_name, 2, s_suppkey FROM supplier) SELECT doi, title FROM u WHERE contains(lower(title), 'group') AND contains(title, '3') AND contains(lower(title), 'study') ORDER BY r, ord LIMIT 5000")
def sql_search_papers(spark, d):
    none = F.lit(None).cast("string").alias("url")
    first = table(spark, d, "part").select(F.expr("'d' || p_partkey").alias("doi"), none, F.expr("'Study of item ' || p_partkey % 7 || ' in group ' || p_partkey % 5").alias("title"), F.col("p_partkey").alias("ord"))
    second = table(spark, d, "supplier").select(F.expr("'s' || s_suppkey").alias("doi"), none, F.expr("'A group 3 study of ' || s_name").alias("title"), F.col("s_suppkey").alias("ord"))
    sql_tools.register(spark, papers=first, more_papers=second)
    return spark.sql("SELECT doi, title FROM search_papers('Group, STUDY  3', 5000)")


@query("SELECT count(*) AS dois, count(*) FILTER (p_partkey % 4 = 0) AS retracted, count(*) FILTER (p_partkey % 4 = 3) AS unknown FROM part")
def sql_check_retraction(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("doi"), F.col("p_partkey").alias("k"))
    retractions = p.where("k % 4 < 3").select("doi", F.expr("case when k % 4 = 0 then array('retraction') else array('correction') end").alias("update_types"), F.lit(False).alias("is_retracted"))
    sql_tools.register(spark, dois=p.select("doi"), retractions=retractions)
    return spark.sql("SELECT count(*) AS dois, count_if(retracted) AS retracted, count_if(retracted IS NULL) AS unknown FROM check_retraction()")


@query("SELECT p_partkey % 10 AS digit, CAST(CASE WHEN p_partkey % 10 > 5 THEN 10 - p_partkey % 10 ELSE 0 END AS INT) AS hops, count(*) AS n, count(*) FILTER (p_partkey % 2 = 0) AS copies FROM part GROUP BY ALL")
def sql_check_url(spark, d):
    """Ends of redirects and archived copies, joined in SQL."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("url"))
    pages, archive = (p.where(f"url % {k} = 0").select(F.col("url").alias("key"), F.lit(v).alias("value")) for k, v in ((10, "200"), (2, "copy")))
    edges = p.where("url % 10 > 5").select(F.col("url").alias("from_url"), (F.col("url") + 1).alias("to_url"))
    sql_tools.register(spark, urls=p, pages=pages, redirects=edges, archive=archive)
    return spark.sql("SELECT url % 10 AS digit, hops, count(*) AS n, count(snapshot) AS copies FROM check_url() JOIN find_snapshot() USING (url) GROUP BY ALL")


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line) <> '' AND i > 2 GROUP BY doc_id")
def sql_parse_document(spark, d):
    sql_tools.register(spark, documents=table(spark, d, "documents").select("doc_id", "text"))
    return spark.sql("SELECT doc_id, count(*) AS n FROM parse_document(from_line => 2) GROUP BY doc_id")


@query("SELECT user_id AS image, count(*) AS n FROM events WHERE event_id % 2 = 0 AND (event_id * 37 % 100) / 100.0 >= 0.4 GROUP BY user_id")
def sql_detect_objects(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("image"), F.expr("case when event_id % 2 = 0 then 'gauge' else 'defect' end").alias("domain"), F.lit("crack").alias("label"), F.expr("cast(event_id * 37 % 100 as double) / 100").alias("conf"))
    sql_tools.register(spark, detections=e)
    return spark.sql("SELECT image, count(*) AS n FROM detect_objects('gauge', 0.4) GROUP BY image")


@query("SELECT o_orderkey AS doc_id, CAST('2026-09-' || lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0') AS DATE) AS deadline FROM orders WHERE 31 + o_orderkey % 28 <= 40")
def sql_analyze_notice(spark, d):
    text = "'창업 공모전 공고\\n접수 마감: 2026-09-' || lpad(1 + o_orderkey % 28, 2, '0') || ' 18:00'"
    docs = spread(table(spark, d, "orders"), "o_orderkey").select(F.col("o_orderkey").alias("doc_id"), F.expr(text).alias("text"))
    sql_tools.register(spark, notices=docs, today=F.to_date(F.lit("2026-08-01")), holidays=["2026-09-24"])
    return spark.sql("SELECT doc_id, deadline FROM analyze_notice(within_days => 40)")
