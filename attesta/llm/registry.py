"""The queries of this subpackage, with production parameters and whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import read


def op1_harmonic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.packing import harmonic_pack

    return harmonic_pack(read(spark, sf_dir, "documents"))


def op2_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.licences import scan

    return scan(read(spark, sf_dir, "documents"))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.quality import classify

    return classify(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.decision_list import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.mixing import entropy_mix

    return entropy_mix(read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.jaccard import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM documents),
s AS (SELECT doc_id, CASE WHEN len(a) = 0 THEN [] WHEN len(a) < 4 THEN [array_to_string(a, ' ')] ELSE list_distinct(list_transform(range(1, len(a) - 2), lambda i: array_to_string(a[i:i + 3], ' '))) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS h FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.g) + len(y.g) - n)),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a)
SELECT s.doc_id, CAST(len(any_value(s.g)) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.langid import language_id

    return language_id(read(spark, sf_dir, "documents"))


def op11_norm_sorted_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS a
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.a, c.a), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM t WHERE rank <= 5
"""


def op12_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.codes import heap_lloyd

    return heap_lloyd(read(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.filter_audit import filter_audit

    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, part, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS a FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {'A': len(a) < 200, 'B': 100 * len(list_distinct(a)) < 50 * len(a), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), 'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS f FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, f),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c1.x || d1.x || e.x AS filter_order FROM c a, c b, c c1, c d1, c e WHERE len(list_distinct([a.x, b.x, c1.x, d1.x, e.x])) = 5),
s AS (SELECT part, filter_order, step, filter_order[step] AS x, f[filter_order[step]] AS fails, len(list_filter(range(1, step), lambda i: f[filter_order[i]])) > 0 AS before, f, n, good, toxic FROM m, o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, x, CAST(sum(n) FILTER (WHERE NOT fails AND NOT before) AS BIGINT) AS kept, CAST(sum(n) FILTER (WHERE fails AND NOT before) AS BIGINT) AS removed, CAST(sum(n) FILTER (WHERE fails AND before) AS BIGINT) AS redundant,
  CAST(sum(n) FILTER (WHERE fails AND len(list_filter(map_values(f), lambda v: v)) = 1) AS BIGINT) AS unique_fails, CAST(sum(good) FILTER (WHERE fails AND NOT before) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (WHERE fails AND NOT before) AS BIGINT) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM g
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_harmonic_pack, op2_licence_sentences, op3_shards, op4_quality_classifier, op5_toxicity, op6_quality_rules, op7_exact_dedup, op8_entropy_mix, op9_jaccard_join, op10_language_id, op11_norm_sorted_top_k, op12_heap_lloyd, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    from attesta.llm.licences import scan_sql

    return {"op2_licence_sentences": scan_sql(), "op7_exact_dedup": OP7_SQL, "op9_jaccard_join": OP9_SQL, "op11_norm_sorted_top_k": OP11_SQL, "op13_filter_audit": OP13_SQL}
