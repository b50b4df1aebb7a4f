"""Registered queries of readers: responses in every form, recorded attempts. Their JSON is made from columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.plans.catalog import query, table
from attesta.sources import responses

#: Of a part's element: the text under one of five keys or within content; a category as text, list or neither; a page under one of five keys or as text; four forms of a box.
_TEXT = "case cast(p_partkey % 8 as int) when 0 then '\"text\": \"' || p_name || '\", \"content\": \"no\"' when 1 then '\"content\": \"' || p_name || '\"' when 2 then '\"text\": 5, \"Content\": \"' || p_name || '\"' when 3 then '\"textContent\": \"' || p_name || '\"' when 4 then '\"text\": null, \"TEXT\": \"' || p_name || '\"' when 5 then '\"content\": {\"text\": \"' || p_name || '\", \"html\": \"<p>\"}' when 6 then '\"content\": {\"text\": \"\", \"Content\": \"' || p_name || '\"}' else '\"other\": 1' end"
_CATEGORY = "case cast(p_partkey % 3 as int) when 0 then '\"category\": \"' || p_brand || '\"' when 1 then '\"category\": [\"' || p_brand || '\", \"x\"]' else '\"category\": null' end"
_PAGE = "case cast(p_partkey % 6 as int) when 0 then '\"page\": ' when 1 then '\"pageNumber\": ' when 2 then '\"page_number\": ' when 3 then '\"pageIndex\": ' when 4 then '\"pagenum\": ' else '\"page\": \"x\", \"pagenum\": ' end || p_size || '.5'"
_BOX = "case cast(p_partkey % 5 as int) when 0 then '\"boundingBox\": [0.5, 1, 2, ' || p_size || ']' when 1 then '\"box\": {\"x\": 0.5, \"y\": 1, \"width\": 2, \"height\": ' || p_size || '}' when 2 then '\"boundingBox\": [], \"bbox\": {\"left\": 0.5, \"top\": 1, \"w\": 2, \"h\": ' || p_size || '}' when 3 then '\"coordinates\": [{\"x\": 0.5, \"y\": 1}, {\"x\": 2.5, \"y\": ' || (p_size + 1) || '}]' else '\"box\": [1, 2, 3]' end"
_ELEMENT = f"'{{' || {_TEXT} || ', ' || {_CATEGORY} || ', ' || {_PAGE} || ', ' || {_BOX} || '}}'"
_WRAPS = "case cast(p_partkey % 7 as int) when 0 then '{\"elements\": [' || e || ']}' when 1 then '{\"content\": {\"elements\": [' || e || ']}}' when 2 then '[' || e || ']' when 3 then '{\"data\": [' || e || ']}' when 4 then '{\"result\": {\"elements\": [' || e || ']}}' when 5 then '{\"pages\": 1}' else '{\"elements\": [' || e end"


def _responses(spark, d):
    return table(spark, d, "part").withColumn("e", F.expr(_ELEMENT)).select(F.col("p_partkey").alias("doc_id"), F.expr(_WRAPS).alias("body"))


@query(
    """SELECT p_partkey AS doc_id, CAST(0 AS INT) AS ord, CASE WHEN p_partkey % 8 = 7 THEN '' ELSE p_name END AS text, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE p_brand END AS category, CAST(p_size AS INT) AS page,
 CASE WHEN p_partkey % 5 < 4 THEN 0.5::DOUBLE END AS x, CASE WHEN p_partkey % 5 < 4 THEN 1::DOUBLE END AS y, CASE WHEN p_partkey % 5 < 4 THEN 2::DOUBLE END AS w, CASE WHEN p_partkey % 5 < 4 THEN p_size::DOUBLE END AS h FROM part WHERE p_partkey % 7 < 5"""
)
def response_elements(spark, d):
    """Elements under every key, in every form and wrapping that a parse response may have."""
    return responses.elements_of(_responses(spark, d)).select("doc_id", "ord", "text", "category", "page", "x", "y", "w", "h")


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 7 < 5 THEN 'parsed' WHEN p_partkey % 7 = 5 THEN 'no_elements' ELSE 'not_json' END AS state FROM part")
def response_states(spark, d):
    return responses.response_state(_responses(spark, d)).select("doc_id", "state")


@query("SELECT p_partkey AS doc_id, CAST(i AS INT) AS ord, CAST(p_partkey + i AS VARCHAR) AS id, CASE WHEN i = 0 THEN p_name END AS title, CAST(1990 + p_size AS VARCHAR) AS year, CASE WHEN i = 0 THEN 0.5::DOUBLE END AS confidence, CASE WHEN i = 1 THEN 'a+b' END AS notes FROM part, range(2) t(i)")
def response_references(spark, d):
    """References as items of an object or as a list, with fields of other kinds than expected."""
    one = "'{\"id\": ' || p_partkey || ', \"title\": \"' || p_name || '\", \"year\": \"' || (1990 + p_size) || '\", \"confidence\": 0.5}'"
    two = "'{\"id\": \"' || (p_partkey + 1) || '\", \"title\": null, \"year\": ' || (1990 + p_size) || ', \"confidence\": \"none\", \"notes\": [\"a\", \"b\"]}'"
    body = f"case when p_partkey % 2 = 0 then '{{\"items\": [' else '[' end || {one} || ', ' || {two} || case when p_partkey % 2 = 0 then ']}}' else ']' end"
    r = table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.expr(body).alias("body"))
    return responses.references_of(r).select("doc_id", "ord", "id", "title", "year", "confidence", F.array_join("notes", "+").alias("notes"))


#: The answers of an order: its line items in order, each with a code.
_CODE = "CASE CAST((o_orderkey + n) % 5 AS INT) WHEN 0 THEN 503 WHEN 1 THEN 429 WHEN 2 THEN NULL WHEN 3 THEN 404 ELSE 200 END"


@query(
    f"""WITH a AS (SELECT o_orderkey AS key, n, {_CODE} AS status FROM orders, (SELECT unnest(range(3)) AS n) WHERE n < o_orderkey % 4),
r AS (SELECT key, n + 1 AS tries, status, status IS NULL OR status IN (429, 500, 502, 503, 504) AS again FROM a WHERE n < 2),
f AS (SELECT *, NOT again OR tries = 2 AS final FROM r),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY final DESC, CASE WHEN final THEN tries ELSE -tries END) = 1)
SELECT o_orderkey AS key, CAST(coalesce(tries, 0) AS INT) AS tries, CAST(status AS INT) AS status, CASE WHEN b.key IS NULL THEN 'missing' WHEN NOT final THEN 'retry' WHEN status = 200 THEN 'ok' WHEN status IS NULL THEN 'unreachable' ELSE 'http_error' END AS state FROM orders LEFT JOIN b ON b.key = o_orderkey"""
)
def recorded_attempts(spark, d):
    """What became of requests that were sent up to three times."""
    o = table(spark, d, "orders")
    a = o.select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n")).where("n < o_orderkey % 4")
    attempts = a.select(F.col("o_orderkey").alias("key"), F.col("n").alias("attempt"), F.expr(_CODE).cast("int").alias("status"), F.lit("body").alias("body"))
    return responses.answered(o.select(F.col("o_orderkey").alias("key")), attempts).select("key", "tries", "status", "state")
