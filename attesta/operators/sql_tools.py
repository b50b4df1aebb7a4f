"""The domain's tools as SQL table functions with declared parameters, over tables that a session brings.

register() makes a temporary view of what a tool gives for all rows of its input and a temporary function over it, so that
`SELECT * FROM scan_pii('medium')` is planned with the rest of a query. A parameter out of its range ends a query that looks at
any row with an error that names it; one that is left out has the default that the function declares.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import pii, references, tools


@dataclass(frozen=True)
class Tool:
    """needs: the tables it reads. rows: what it gives for all of them. parameters: name, type, default (None: required),
    test of its range. where: which rows a call gets, in terms of columns and parameters. hidden: columns for `where` alone."""

    name: str
    needs: tuple[str, ...]
    rows: Callable[..., DataFrame]
    parameters: tuple[tuple[str, str, str | None, str], ...] = ()
    where: str = "true"
    hidden: tuple[str, ...] = ()


_RANKS = "map(" + ", ".join(f"'{k}', {v}" for k, v in pii.RANK.items()) + ")"
_DOMAINS = "'defect', 'gauge', 'cleaning', 'safety'"


def _verified(documents: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    found = tools.verify_references(documents, registry)
    return found.select("doc_id", "ref_id", "raw", "doi", "title", "status", "similarity", "matched_doi", "diffs")


def _papers(papers: DataFrame, more_papers: DataFrame) -> DataFrame:
    both = references.union_registries(papers, more_papers)
    return both.select("doi", "url", "title", "source_rank", "ord", T.normalize_reference(F.col("title")).alias("plain"))


def _laws(laws: DataFrame) -> DataFrame:
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    return laws.dropDuplicates(["law_key"]).select("law_key", aliases.alias("aliases"))


_OWN_KEY = r"regexp_replace(keyword, '[\\s·ㆍ「」]', '')"
_WORDS = r"split(trim(regexp_replace(regexp_replace(lower(query), '[^\\p{L}\\p{M}\\p{N}_\\s]', ''), '\\s+', ' ')), ' ')"

TOOLS = [
    Tool("verify_references", ("documents", "registry?"), _verified, (("wanted", "STRING", "''", f"wanted IN ('', {', '.join(repr(s) for s in references.STATUSES)})"),), "wanted = '' OR status = wanted"),
    Tool("match_claim", ("matches",), tools.match_claim, (("wanted", "STRING", "''", "wanted IN ('', 'supported', 'not_supported', 'cannot_judge')"),), "wanted = '' OR final_verdict = wanted"),
    Tool("scan_pii", ("documents",), lambda documents: tools.scan_pii(documents)[0], (("min_confidence", "STRING", "'info'", f"map_contains_key({_RANKS}, min_confidence)"),), f"rank >= {_RANKS}[min_confidence]"),
    Tool("pii_risk", ("documents",), lambda documents: tools.scan_pii(documents)[1]),
    Tool("lookup_article", ("citations", "articles"), tools.lookup_article, (("wanted", "STRING", "''", "wanted IN ('', 'exists', 'no_such_article', 'snapshot_not_held')"),), "wanted = '' OR verdict = wanted"),
    Tool("search_articles", ("laws",), _laws, (("keyword", "STRING", None, "trim(keyword) <> ''"),), f"contains(law_key, {_OWN_KEY}) OR exists(aliases, a -> contains(a, {_OWN_KEY}))"),
    Tool("check_subcontract", ("documents",), lambda documents: tools.check_subcontract(documents)[0], (("wanted", "STRING", "''", "wanted IN ('', 'no_evidence', 'risk', 'compliant')"),), "wanted = '' OR label = wanted"),
    Tool("search_papers", ("papers", "more_papers"), _papers, (("query", "STRING", None, "trim(query) <> ''"), ("max_results", "INT", "10", "max_results > 0")), f"forall({_WORDS}, w -> contains(plain, w)) QUALIFIED row_number() OVER (ORDER BY source_rank, ord) <= max_results", ("plain",)),
    Tool("check_retraction", ("dois", "retractions"), lambda dois, retractions: tools.check_retraction(dois, retractions), (("of_doi", "STRING", "''", "true"),), "of_doi = '' OR lower(doi) = lower(of_doi)"),
    Tool("check_url", ("urls", "pages", "redirects"), lambda urls, pages, redirects: tools.check_url(urls, pages, redirects), (("of_url", "STRING", "''", "true"),), "of_url = '' OR CAST(url AS STRING) = of_url"),
    Tool("find_snapshot", ("urls", "archive"), lambda urls, archive: tools.find_snapshot(urls, archive), (("of_url", "STRING", "''", "true"),), "of_url = '' OR CAST(url AS STRING) = of_url"),
    Tool("parse_document", ("documents",), lambda documents: tools.parse_document(documents), (("from_line", "INT", "0", "from_line >= 0"),), "ord >= from_line"),
    Tool("detect_objects", ("detections",), lambda detections: detections.withColumn("conf", F.round("conf", 4)), (("in_domain", "STRING", None, f"in_domain IN ({_DOMAINS})"), ("threshold", "DOUBLE", "0.25", "threshold BETWEEN 0 AND 1")), "domain = in_domain AND conf >= threshold"),
    Tool("analyze_notice", ("notices", "today", "holidays"), lambda notices, today, holidays: tools.analyze_notice(notices, today, holidays), (("within_days", "INT", "1000000", "within_days >= 0"),), "dday IS NULL OR dday <= within_days"),
]


def define(spark: SparkSession, tool: Tool, rows: DataFrame) -> None:
    """The temporary view _<tool> of rows and the table function <tool>."""
    rows.createOrReplaceTempView(f"_{tool.name}")
    shown = [f for f in rows.schema if f.name not in tool.hidden]
    declared = ", ".join(f"{n} {kind}" + (f" DEFAULT {default}" if default is not None else "") for n, kind, default, _ in tool.parameters)
    where, _, first = tool.where.partition(" QUALIFIED ")
    # One expression, so that no optimiser asks for rows before it has asked for the range.
    wrong = "".join(f"WHEN NOT coalesce({test}, false) THEN CAST(raise_error('{tool.name}: {n} is out of range') AS BOOLEAN) " for n, _, _, test in tool.parameters)
    condition = f"CASE {wrong}ELSE {where} END" if wrong else where
    names = ", ".join(f"`{f.name}`" for f in shown)
    body = f"SELECT {names} FROM _{tool.name} WHERE {condition}"
    if first:
        order, _, limit = first.partition(" <= ")
        body = f"SELECT {names} FROM (SELECT *, {order} AS _place FROM _{tool.name} WHERE {condition}) WHERE _place <= {limit}"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {tool.name}({declared}) RETURNS TABLE({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in shown)}) RETURN {body}")


def register(spark: SparkSession, **tables) -> list[str]:
    """Defines the tools whose tables are given, and gives their names. tables: DataFrames by the names in Tool.needs (one
    with a question mark may be missing); today, a date column, and holidays, a list of days, for analyze_notice."""
    known = {n.rstrip("?") for t in TOOLS for n in t.needs}
    if wrong := sorted(set(tables) - known):
        raise ValueError(f"no tool reads {', '.join(wrong)}")
    done = []
    for t in TOOLS:
        if all(n in tables for n in t.needs if not n.endswith("?")):
            define(spark, t, t.rows(**{n.rstrip("?"): tables[n.rstrip("?")] for n in t.needs if n.rstrip("?") in tables}))
            done.append(t.name)
    return done
