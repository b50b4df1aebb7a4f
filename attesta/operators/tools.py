"""The tools of the domain as functions of DataFrames; a missing parameter raises ValueError at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import checklist, evidence, law, photos, pii, references, reports
from attesta.sources import documents


def _needs(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def verify_references(docs: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """docs: doc_id, text. Its references parsed, with their status; without a registry snapshot all are unreachable."""
    _needs(docs, "doc_id", "text")
    items = references.split_items(docs).withColumn("ref_id", F.concat_ws("-", "doc_id", "item_no")).withColumnRenamed("item", "raw")
    return references.verify(references.parse_references(items), registry)


def match_claim(matches: DataFrame) -> DataFrame:
    """matches: verdict, quote, title, abstract."""
    _needs(matches, "verdict", "quote", "title", "abstract")
    return references.downgrade(matches)


def scan_pii(docs: DataFrame, min_confidence: str = "info") -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Findings, and each document's risk (NONE without any)."""
    _needs(docs, "doc_id", "text")
    if min_confidence not in pii.RANK:
        raise ValueError(f"no confidence is called {min_confidence}")
    found = pii.scan(docs, min_confidence=min_confidence)
    risk = docs.select("doc_id").join(pii.document_risk(found), "doc_id", "left")
    return found, risk.fillna({"n_findings": 0, "risk": "NONE"})


def lookup_article(citations: DataFrame, articles: DataFrame) -> DataFrame:
    _needs(citations, "law_key", "article", "paragraph", "sub_article")
    return law.lookup(citations, articles)


def search_articles(laws: DataFrame, keyword: str) -> DataFrame:
    if not keyword.strip():
        raise ValueError("the keyword is empty")
    return law.search(laws, keyword)


def check_subcontract(docs: DataFrame, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. Every item's label (of the caller's rules, else the 18 known ones), and the summary of axes."""
    _needs(docs, "doc_id", "text")
    items = checklist.evaluate_fixed(docs) if rules is None else checklist.evaluate(docs, rules)
    return items, checklist.axis_summary(items, ("doc_id", "axis"))


def search_papers(first: DataFrame, second: DataFrame, query: str, most: int = 10) -> DataFrame:
    """Papers of two registries (doi, url, title, ord) whose titles have all words of the query, the first source's first."""
    if not query.strip():
        raise ValueError("the query is empty")
    has = lambda df: df.where(F.forall(F.split(T.normalize_reference(F.lit(query)), " "), lambda w: F.contains(T.normalize_reference(F.col("title")), w)))
    return references.union_registries(has(first), has(second)).orderBy("source_rank", "ord").limit(most)


def check_retraction(dois: DataFrame, registry: DataFrame) -> DataFrame:
    """dois: doi. Adds retracted; null for a DOI that the registry doesn't have."""
    _needs(dois, "doi")
    gone = references.retracted(registry).select(F.lower("doi").alias("key")).distinct().withColumn("gone", F.lit(True))
    known = registry.select(F.lower("doi").alias("key")).distinct().join(gone, "key", "left").select("key", F.coalesce("gone", F.lit(False)).alias("retracted"))
    return dois.join(known, F.lower("doi") == F.col("key"), "left").drop("key")


def check_url(urls: DataFrame, pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """urls: url; pages: key (URL), value (its status). Adds final_url, hops, state, and the status of the final page."""
    _needs(urls, "url")
    ends = urls.join(references.redirect_ends(redirects).withColumn("url", F.col("url").cast(urls.schema["url"].dataType)), "url", "left")
    ends = ends.withColumns({"final_url": F.coalesce("final_url", "url"), "hops": F.coalesce("hops", F.lit(0)), "state": F.coalesce("state", F.lit("final"))})
    return evidence.by_snapshots(ends, "final_url", pages).withColumnRenamed("value", "status").drop("found")


def find_snapshot(urls: DataFrame, archive: DataFrame) -> DataFrame:
    """urls: url; archive: key (URL), value (where a copy is). Adds snapshot, null without one."""
    _needs(urls, "url")
    return evidence.by_snapshots(urls, "url", archive).withColumnRenamed("value", "snapshot").drop("found")


def parse_document(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Its lines as layout elements."""
    _needs(docs, "doc_id", "text")
    return documents.text_elements(docs)


def detect_objects(detections: DataFrame, domain: str, threshold: float = 0.25) -> DataFrame:
    """detections: image, domain, label, conf, box, as a detector left them. Those of one domain from the threshold on."""
    if domain not in ("defect", "gauge", "cleaning", "safety"):
        raise ValueError(f"no domain is called {domain}")
    return detections.where((F.col("domain") == domain) & (F.col("conf") >= threshold)).withColumn("conf", F.round("conf", 4))


def inspect_photos(detections: DataFrame, labels: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each photo's risk, and the law excerpts that its labels refer to."""
    return photos.inspect(detections, labels), reports.law_excerpts(detections.where(F.col("conf") >= photos.THRESHOLD), labels, articles)


def analyze_notice(docs: DataFrame, today: Column, holidays: list[str]) -> DataFrame:
    _needs(docs, "doc_id", "text")
    return reports.notice_analysis(docs, today, holidays)
