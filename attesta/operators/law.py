"""Law citations: extraction, lookup in snapshots, nearest articles, search, comparison of claims with articles.

Snapshots are two tables: law (law_key, name, aliases) and law_article (law_key, article, sub, pos, title, paragraphs,
full_text). A law that is absent, or has no articles, is "not held"; nothing is guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARTICLE = re.compile(r"제\s*(\d+)\s*조(?:\s*제\s*(\d+)\s*항|\s*의\s*(\d+))?")
_BLOCK = re.compile(r"「\s*([^」]*?(?:법률|법|法)(?:\s*시행령|\s*시행규칙)?)\s*」")
_FREE = re.compile(r"(?<![가-힣A-Za-z0-9_])((?:[가-힣A-Za-z]+[\s·])*?[가-힣A-Za-z]*(?:법률|법|法)(?:\s*시행령|\s*시행규칙)?)(?=[\s·]|$|제\s*\d)")
#: Endings of a word before a law's name that show it isn't a part of the name.
_CONNECTIVES = ("하며", "하고", "하여", "으로", "에서", "및", "또는", "따라", "근거로", "의한", "대한", "관한")

NOT_HELD, NO_ARTICLE, EXISTS = "snapshot_not_held", "no_such_article", "exists"


def law_key(name: Column) -> Column:
    """Names compare without blanks, middle dots and brackets."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s·ㆍ「」]", "")


def _plausible(name: str) -> str:
    words = name.split()
    while len(words) > 1 and words[0].endswith(_CONNECTIVES):
        words = words[1:]
    return " ".join(words)


def _find(text: str) -> list[tuple]:
    out, seen, blocks = [], set(), []
    for kind, pattern in (("block", _BLOCK), ("free", _FREE)):
        for m in pattern.finditer(text):
            begin, name = (m.start(), m.group(1).strip()) if kind == "block" else (m.start(1), m.group(1))
            if kind == "free":
                short = _plausible(name)
                begin, name = begin + len(name) - len(short), short
                if any(a < m.end() and begin < b for a, b in blocks):
                    continue
            else:
                blocks.append((m.start(), m.end()))
            art = ARTICLE.search(text, m.end())
            if not art:
                continue
            article, paragraph, sub = (int(x) if x else None for x in art.groups())
            key = (re.sub(r"[\s·ㆍ「」]", "", name), article, paragraph or sub)
            if key not in seen:
                seen.add(key)
                out.append((text[begin : art.end()], begin, art.end(), name, key[0], article, paragraph or sub, sub, art.start() - m.end()))
    return sorted(out, key=lambda r: r[1])


def _citations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "raw", "start", "end", "law_name", "law_key", "article", "paragraph", "sub_article", "gap"]
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    for b in batches:
        rows = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in _find(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def extract_citations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per citation; a law's name binds to the next article number, gap characters later.

    Binding needs offsets of two patterns at once, so this is an Arrow function; texts without an article never reach it.
    """
    rows = docs.where(F.col(text_col).rlike(r"제\s*\d+\s*조")).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_citations, "doc_id long, raw string, start int, end int, law_name string, law_key string, article int, paragraph int, sub_article int, gap int")


def resolve_aliases(citations: DataFrame, laws: DataFrame) -> DataFrame:
    """Replaces law_key by the key of the law that has it as key or alias."""
    names = laws.select(F.col("law_key").alias("to_key"), F.explode(F.array_union(F.array("law_key"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias")).groupBy("alias").agg(F.min("to_key").alias("to_key"))
    return citations.join(names, F.col("law_key") == F.col("alias"), "left").withColumn("law_key", F.coalesce("to_key", "law_key")).drop("alias", "to_key")


def lookup(citations: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds verdict and full_text: not held, no such article or paragraph, exists."""
    held = articles.select(F.col("law_key").alias("h_key")).distinct()
    a = articles.select(F.col("law_key").alias("a_key"), F.col("article").alias("a_article"), F.coalesce("sub", F.lit(0)).alias("a_sub"), F.size("paragraphs").alias("n_paragraphs"), "full_text")
    sub = F.coalesce("sub_article", F.lit(0))
    c = citations.join(held, F.col("law_key") == F.col("h_key"), "left").join(a, (F.col("law_key") == F.col("a_key")) & (F.col("article") == F.col("a_article")) & (sub == F.col("a_sub")), "left")
    beyond = (sub == 0) & F.col("paragraph").isNotNull() & (F.col("paragraph") > F.col("n_paragraphs"))
    verdict = F.when(F.col("h_key").isNull(), NOT_HELD).when(F.col("a_key").isNull() | beyond, NO_ARTICLE).otherwise(EXISTS)
    return c.withColumn("verdict", verdict).drop("h_key", "a_key", "a_article", "a_sub", "n_paragraphs")


def nearest_articles(missing: DataFrame, articles: DataFrame, k: int = 2) -> DataFrame:
    """missing: cite_id, law_key, article. The k nearest other articles of that law, earlier ones first on ties."""
    a = articles.select("law_key", F.col("article").alias("near"), "pos")
    j = missing.join(a, "law_key").where("near <> article").withColumn("distance", F.abs(F.col("near") - F.col("article")))
    rank = F.row_number().over(Window.partitionBy("cite_id").orderBy("distance", "pos"))
    return j.withColumn("rank", rank).where(F.col("rank") <= k)


def search(laws: DataFrame, keyword: str) -> DataFrame:
    """Laws whose name has the keyword, then those with it in an alias; each once."""
    key = F.lit(re.sub(r"[\s·ㆍ「」]", "", keyword))
    by_name, by_alias = F.contains("law_key", key), F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(a, key))
    return laws.where(by_name | by_alias).withColumn("found_in", F.when(by_name, "name").otherwise("alias")).dropDuplicates(["law_key"])


def parse_law_text(lines: DataFrame) -> DataFrame:
    """lines: law_key, line_no, line. Articles as islands of lines that a head 제N조(title) begins."""
    head = r"^\s*제(\d+)조(?:의(\d+))?\s*\(([^)]*)\)"
    w = Window.partitionBy("law_key").orderBy("line_no")
    rows = lines.withColumn("pos", F.sum(F.col("line").rlike(head).cast("int")).over(w)).where("pos > 0")
    g = rows.groupBy("law_key", "pos").agg(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))).alias("l")).withColumn("l", F.transform("l", lambda x: x["line"]))
    first = F.element_at("l", 1)
    paragraphs = F.filter(F.col("l"), lambda x: x.rlike(r"[①-⑳]"))
    number = lambda i: F.regexp_extract(first, head, i).try_cast("int")
    return g.select("law_key", number(1).alias("article"), number(2).alias("sub"), "pos", F.regexp_extract(first, head, 3).alias("title"), paragraphs.alias("paragraphs"), F.array_join("l", "\n").alias("full_text"))


def claim_against_article(claim: Column, body: Column, shortest: int = 15) -> Column:
    """struct(supported, quote): the longest part of the claim (of `shortest` characters) that stands in the article.

    Without one, a run of seven down to two words that does.
    """
    squeeze = lambda s: F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))
    parts = F.filter(F.transform(F.split(claim, r"[.,;…]|\.\.\."), squeeze), lambda p: (F.length(p) >= shortest) & F.contains(squeeze(body), p))
    longest = lambda a: F.array_max(F.transform(a, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    words = F.split(squeeze(claim), " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(7)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))))
    run = longest(F.filter(runs, lambda p: (F.length(p) >= shortest) & F.contains(squeeze(body), p)))
    quote = F.coalesce(longest(parts), run)
    return F.struct(quote.isNotNull().alias("supported"), quote.alias("quote"))
