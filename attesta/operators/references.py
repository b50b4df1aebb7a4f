"""Bibliographies: extraction from layout elements, parsing, links to citations, verification against a registry.

Elements are rows (doc_id, ord, page, category, text, x, y, w, h). Order is always a column, never the row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import titles
from attesta.storage import forget, stored

#: How headings, numbered items and ids are written.
HEADING = r"(?i)^(references|참고문헌|인용문헌)[ \t]*(\n|$)"
EXCLUDED = r"^(header|footer|heading)"
BODY = r"^(body|text|paragraph)"
NUMBERED = r"^\s*(\[\d+\]|\d+\.|\d+\))\s+"
DOI = r"(?i)(10\.\d{4,9}/[^\s\"<>)]+)"
ARXIV = r"(?i)(?:arxiv\.org/(?:abs|pdf)/|arxiv[:\-]\s*)(\d{4}\.\d{4,5}(?:v\d+)?)"
URL = r"(https?://(?!doi\.org)[^\s\"<>)]+)"
YEAR = r"(?:^|[^0-9])(19[5-9]\d|20[0-4]\d)(?:[^0-9]|$)"
#: Outcomes, and the title similarities from which a match is one.
STATUSES = ("verified", "partial", "unverified", "unreachable", "not_applicable")
VERIFIED, PARTIAL = 0.85, 0.72


# -- Elements ---------------------------------------------------------------------------------------------------------


def reading_order(elements: DataFrame) -> DataFrame:
    """Adds position: by page, column (right if the centre is), top, then the order of the source."""
    column = F.when(F.coalesce(F.col("x") + F.col("w") / 2, F.lit(0.0)) >= 0.5, 1).otherwise(0)
    order = Window.partitionBy("doc_id").orderBy("page", column, F.coalesce("y", F.lit(0.0)), "ord")
    return elements.withColumn("position", F.row_number().over(order))


def is_heading() -> Column:
    return F.col("text").rlike(HEADING)


def split_sections(elements: DataFrame) -> DataFrame:
    """Adds section: body before the first bibliography heading, heading, references from it on."""
    at = F.min(F.when(is_heading(), F.col("position"))).over(Window.partitionBy("doc_id"))
    e = elements.withColumn("at", at)
    return e.withColumn("section", F.when(F.col("at").isNull() | (F.col("position") < F.col("at")), "body").when(F.col("position") == F.col("at"), "heading").otherwise("references")).drop("at")


def body_blocks(elements: DataFrame) -> DataFrame:
    """The elements of running text: those whose category begins as body, text or paragraph; lists give no claims."""
    return elements.where(F.lower("category").rlike(BODY))


def body_text(elements: DataFrame) -> DataFrame:
    """doc_id, body: the texts of the body section in reading order, a line each. elements: as split_sections gives them."""
    own = elements.where("section = 'body'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("t"))
    return own.select("doc_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("body"))


def looks_like_reference(t: Column) -> Column:
    """A year in brackets in the first three lines of a text that begins with a word, or a DOI or arXiv id."""
    three = F.array_join(F.slice(F.split(t, "\n"), 1, 3), "\n")
    word = F.regexp_extract(F.trim(three), r"^([\p{L}]+)", 1)
    return ((three.rlike(r"\(\d{4}\)")) & ((F.length(word) > 1) | ((F.length(word) == 1) & ~three.rlike("et al")))) | t.rlike(DOI) | t.rlike(ARXIV)


def classify_element(t: Column, category: Column) -> Column:
    """number_bib, author_year_bib or body; a footnote is no bibliography unless numbered."""
    numbered = F.element_at(F.split(t, "\n"), 1).rlike(NUMBERED)
    return F.when(numbered, "number_bib").when(~F.lower(category).startswith("footnote") & looks_like_reference(t), "author_year_bib").otherwise("body")


def split_numbered(elements: DataFrame) -> DataFrame:
    """One row per island of lines that a number mark begins: doc_id, position, page, item, text, marked."""
    rows = elements.select("doc_id", "position", "page", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    w = Window.partitionBy("doc_id", "position").orderBy("i")
    rows = rows.withColumn("marked", F.col("line").rlike(NUMBERED)).withColumn("item", F.sum(F.col("marked").cast("int")).over(w))
    g = rows.groupBy("doc_id", "position", "page", "item").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("l"), F.bool_or("marked").alias("marked"))
    return g.select("doc_id", "position", "page", "item", merge_lines(F.transform("l", lambda x: x["line"])).alias("text"), "marked")


def merge_lines(ls: Column) -> Column:
    """Lines joined with a blank, but without one between two letters or digits, where a word or an id was broken; blank
    lines go, DOIs are mended."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    joined = F.array_join(F.filter(F.transform(ls, strip), lambda x: x != ""), "\n")
    glued = F.regexp_replace(joined, r"(?<=[\p{L}\p{N}])\n(?=[\p{L}\p{N}])", "")
    return F.regexp_replace(F.replace(glued, F.lit("\n"), F.lit(" ")), r"10\.\s+(\d{4,9}/)", "10.$1")


def merge_across_pages(items: DataFrame) -> DataFrame:
    """items: doc_id, position, item, page, text, marked. An unmarked item on the page after the last marked one's goes to its end."""
    order = Window.partitionBy("doc_id").orderBy("position", "item")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("marked"), F.struct("position", "item", "page")), ignorenulls=True).over(before)
    rows = items.withColumn("last", last)
    follows = ~F.col("marked") & (F.col("page") == F.col("last.page") + 1)
    rows = rows.withColumns({"to_position": F.when(follows, F.col("last.position")).otherwise(F.col("position")), "to_item": F.when(follows, F.col("last.item")).otherwise(F.col("item"))})
    g = rows.groupBy("doc_id", "to_position", "to_item").agg(F.array_sort(F.collect_list(F.struct("position", "item", "text"))).alias("t"), F.min("page").alias("page"), F.bool_or("marked").alias("marked"), F.count("*").alias("parts"))
    return g.select("doc_id", F.col("to_position").alias("position"), F.col("to_item").alias("item"), "page", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"), "marked", "parts")


def extract_references(elements: DataFrame) -> DataFrame:
    """Elements to references: doc_id, ref_id (from 1), page, text, source_note."""
    e = split_sections(reading_order(elements)).where("section = 'references'").where(~F.lower("category").rlike(EXCLUDED)).where(F.trim("text") != "")
    e = e.withColumn("kind", classify_element(F.col("text"), F.col("category")))
    numbered = split_numbered(e.where("kind <> 'author_year_bib'"))
    own = e.where("kind = 'author_year_bib'").select("doc_id", "position", "page", F.lit(1).cast("long").alias("item"), merge_lines(F.split("text", "\n")).alias("text"), F.lit(True).alias("marked"))
    merged = merge_across_pages(numbered.unionByName(own)).where("marked")
    note = F.when(F.col("parts") > 1, "merged").when(F.col("text").rlike(NUMBERED), "number_marked").otherwise("author_year")
    order = Window.partitionBy("doc_id").orderBy("position", "item")
    return merged.select("doc_id", F.row_number().over(order).alias("ref_id"), "page", F.trim("text").alias("text"), note.alias("source_note"))


# -- Parsing ----------------------------------------------------------------------------------------------------------


def _first(s: Column, pattern: str) -> Column:
    v = F.regexp_extract(s, pattern, 1)
    return F.when(v != "", v)


def split_items(docs: DataFrame, mode: str = "auto", text_col: str = "text") -> DataFrame:
    """Reference text to items: doc_id, item_no, item. mode: numbered, paragraphs, lines or auto (the first that applies)."""
    t = F.col(text_col)
    kept = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    lines = kept(F.split(t, "\n"))
    forms = {"numbered": kept(F.split(t, r"\n(?=\s*(?:\[\d+\]|\d+\.|\d+\))\s)")), "paragraphs": kept(F.split(t, r"\n\s*\n")), "lines": lines}
    auto = F.when(F.exists(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: x.rlike(NUMBERED)), forms["numbered"]).when(F.size(forms["paragraphs"]) > 1, forms["paragraphs"]).otherwise(lines)
    return docs.select("doc_id", F.posexplode(forms.get(mode, auto)).alias("i", "item")).select("doc_id", (F.col("i") + 1).alias("item_no"), "item")


def parse(raw: Column) -> dict[str, Column]:
    """The fields of a reference: doi, arxiv, url, year, title, first_author, kind, confidence."""
    doi = F.regexp_replace(_first(raw, DOI), r"[.,;:)]+$", "")
    arxiv, url = _first(raw, ARXIV), F.regexp_replace(_first(raw, URL), r"[.,;:)\]]+$", "")
    year = _first(raw, YEAR)
    quoted = F.regexp_extract_all(raw, F.lit("[\"“”]([^\"“”]+)[\"“”]"), F.lit(1))
    longest_quote = F.trim(F.array_max(F.transform(quoted, lambda q: F.struct(F.length(q).alias("n"), q.alias("q"))))["q"])
    trail = r"[^\p{L}\p{N}”’\"'\-–—]+$"
    after_year = F.regexp_replace(_first(raw, r"\(\d{4}\)\s*\.\s*(.+)"), trail, "")
    bare = raw
    for p in (r"\(?\d{4}\)?", DOI, ARXIV, URL):
        bare = F.regexp_replace(bare, p, "")
    pieces = F.filter(F.transform(F.split(bare, r"[.;]\s*"), lambda x: F.trim(x)), lambda p: F.length(p) >= 10)
    longest = F.array_max(F.transform(pieces, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), p.alias("p"))))["p"]
    title = F.coalesce(longest_quote, F.when(F.length(after_year) >= 8, after_year), F.left(F.regexp_replace(longest, trail, ""), F.lit(200)))
    line = F.trim(F.element_at(F.split(raw, "\n"), 1))
    english, korean = _first(line, r"^\s*([A-Z][a-zà-ü]+)\s*,"), _first(line, r"^\s*([가-힣]{2,5})\s*[,(·]\s*[가-힣]{2,5}")
    word = F.element_at(F.split(line, r"\s+"), 1)
    guess = F.when(word.rlike(r"^\p{Lu}\p{L}{2,14}$"), word)
    low = F.lower(raw)
    says = lambda *ws: low.rlike("|".join(w.replace(".", r"\.") for w in ws))
    kind = F.when(says("report", "보고서", "working paper"), "report").when(says("retrieved", "접속", "accessed"), "web").when(says("press", "springer", "wiley", "elsevier", "academic", "oup", "pub"), "book")
    kind = kind.when(says("journal of", "transact", "review", "proceedings", "conference", "annual", "vol.", "pp.", "doi", "arxiv", "preprint"), "article").when(doi.isNotNull() | arxiv.isNotNull(), "article").when(url.isNotNull(), "web")
    some = lambda c, v: F.when(c.isNotNull(), v)
    confidence = F.greatest(F.lit(0.5), some(doi, 0.7), some(arxiv, 0.85), some(year, 0.65), some(longest_quote, 0.75), F.when(longest_quote.isNull() & (F.length(after_year) >= 8), 0.65), some(F.coalesce(english, korean), 0.6))
    none = F.coalesce(doi, arxiv, url, year, title).isNull()
    return {"doi": doi, "arxiv": arxiv, "url": url, "year": year, "title": title, "first_author": F.coalesce(korean, english, guess), "kind": kind, "confidence": F.when(none, 0.2).otherwise(confidence)}


def parse_references(refs: DataFrame, raw_col: str = "raw") -> DataFrame:
    return refs.withColumns(parse(F.col(raw_col)))


# -- Claims and links -------------------------------------------------------------------------------------------------


def extract_claims(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, ord, page, text. One row per sentence and marker: doc_id, ord, sentence_no, claim, marker_type, marker_value, page."""
    # explode() would have Spark make sentences and markers twice, first for the arrays' sizes.
    s = blocks.select("doc_id", "ord", "page", F.posexplode_outer(T.sentences(F.col("text"))).alias("sentence_no", "claim")).where("claim IS NOT NULL")
    marks = F.concat(F.transform(T.number_markers(F.col("claim")), lambda v: F.struct(F.lit("number").alias("marker_type"), v.alias("marker_value"))), F.transform(T.author_year_markers(F.col("claim")), lambda v: F.struct(F.lit("author_year").alias("marker_type"), v.alias("marker_value"))))
    return s.select("doc_id", "ord", "sentence_no", "claim", "page", F.explode_outer(marks).alias("m")).where("m IS NOT NULL").select("doc_id", "ord", "sentence_no", "claim", "page", "m.*")


def reference_marker(t: Column) -> Column:
    """struct(marker_type, marker_value) of a reference: [n], else n., else first surname and year."""
    n = F.coalesce(_first(t, r"^\s*\[(\d+)\]"), _first(t, r"^\s*(\d+)[.)]\s"))
    name = lambda x: F.when(_first(x["t"], r"^\s*(\p{L}+)").isNotNull() & _first(x["t"], r"(\d{4})").isNotNull(), F.struct(F.lit("author_year").alias("marker_type"), T.author_year_key(x["t"]).alias("marker_value")))
    return T.let(F.struct(n.alias("n"), t.alias("t")), lambda x: F.when(x["n"].isNotNull(), F.struct(F.lit("number").alias("marker_type"), x["n"].alias("marker_value"))).otherwise(name(x)))


def link_report(cited: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cited, listed: doc_id, marker_type, marker_value. Returns (listed but not cited, cited but not listed), distinct.

    Both are one table's groups, so that rows which are dealt out by doc_id already move no more; a join would have them sorted
    and dealt out anew by all three columns, into a fixed number of partitions.
    """
    c, r = cited.select(*_MARKER, F.lit(True).alias("cited"), F.lit(False).alias("listed")), listed.select(*_MARKER, F.lit(False).alias("cited"), F.lit(True).alias("listed"))
    g = c.unionByName(r).groupBy(*_MARKER).agg(F.bool_or("cited").alias("cited"), F.bool_or("listed").alias("listed"))
    of = lambda side, other, df: g.where(F.col(side) & ~(F.col(other) & _whole_marker())).select(*(F.col(k).cast(df.schema[k].dataType).alias(k) for k in _MARKER))
    return of("listed", "cited", listed), of("cited", "listed", cited)


#: What a citation and a reference have in common.
_MARKER = ["doc_id", "marker_type", "marker_value"]


def _whole_marker() -> Column:
    """A marker with a null equals no other."""
    return F.col("doc_id").isNotNull() & F.col("marker_type").isNotNull() & F.col("marker_value").isNotNull()


def markers_within(t: Column) -> Column:
    """Every marker that a reference's text answers to: [n] anywhere, the ends of digits before a dot among its first
    twenty characters, and each capitalised or Hangul word with each year of the text."""
    start = F.regexp_extract_all(F.left(t, F.lit(20)), F.lit(r"(\d+)(?=\.)"), F.lit(1))
    ends = F.flatten(F.transform(start, lambda d: F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substring(d, i, F.length(d)))))
    numbers = F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(r"\[(\d+)\]"), F.lit(1)), ends))
    names = F.array_distinct(F.regexp_extract_all(t, F.lit(r"([\p{Lu}가-힣][\p{L}\-]+)"), F.lit(1)))
    years = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(\d{4})"), F.lit(1)))
    pairs = F.flatten(F.transform(years, lambda y: F.transform(names, lambda w: F.concat_ws(", ", w, y))))
    kind = lambda name: lambda v: F.struct(F.lit(name).alias("marker_type"), v.alias("marker_value"))
    return F.concat(F.transform(numbers, kind("number")), F.transform(pairs, kind("author_year")))


def first_matching_reference(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """claims with (doc_id, marker_type, marker_value); refs (doc_id, ref_id, text): adds the first ref_id whose text has the marker.

    References list all the markers they answer to; claims and markers meet in the groups of one table, so that the search is
    no comparison of every pair, and rows which are dealt out by doc_id already move no more (as in link_report).
    """
    m = refs.select("doc_id", "ref_id", F.explode_outer(markers_within(F.col("text"))).alias("m")).where("m IS NOT NULL").groupBy("doc_id", "m.marker_type", "m.marker_value").agg(F.min("ref_id").alias("ref_id"))
    own = [c for c in claims.columns if c not in _MARKER]
    rows = claims.withColumns({"listed": F.lit(False), "ref_id": F.lit(None).cast(refs.schema["ref_id"].dataType)}).unionByName(m.withColumn("listed", F.lit(True)), allowMissingColumns=True)
    first = F.when(_whole_marker(), F.min("ref_id").over(Window.partitionBy(*_MARKER)))
    return rows.withColumn("ref_id", first).where("NOT listed").select(*(F.col(k).cast(claims.schema[k].dataType).alias(k) for k in _MARKER), *own, "ref_id")


def misquoted(matches: DataFrame, statuses: DataFrame) -> DataFrame:
    """Matches judged not supported whose reference is verified or partly so."""
    real = statuses.where(F.col("status").isin("verified", "partial")).select("doc_id", "ref_id")
    return matches.where("verdict = 'not_supported'").join(real, ["doc_id", "ref_id"], "left_semi")


def status_counts(results: DataFrame, names=STATUSES, by: str = "doc_id", column: str = "status") -> DataFrame:
    """A count for each status, and whether they sum up to all rows."""
    counted = results.groupBy(by).agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == n).alias(n) for n in names))
    return counted.withColumn("complete", sum((F.col(n) for n in names), F.lit(0)) == F.col("total"))


def downgrade(matches: DataFrame) -> DataFrame:
    """Post-processing of verdicts: support without a quote that exists can't be judged; a denial stays, but is tagged."""
    quoted = T.quote_exists(F.col("quote"), F.col("title"), F.col("abstract"))
    has = F.coalesce(F.trim("quote"), F.lit("")) != ""
    verdict = F.when((F.col("verdict") == "supported") & ~quoted, "cannot_judge").otherwise(F.col("verdict"))
    tags = F.array_compact(F.array(F.when((F.col("verdict") == "supported") & ~quoted, "quote_not_found"), F.when((F.col("verdict") == "not_supported") & ~has, "no_quote")))
    return matches.withColumns({"quote_exists": quoted, "final_verdict": verdict, "tags": tags, "post_processed": verdict != F.col("verdict")})


# -- Registry ---------------------------------------------------------------------------------------------------------


def union_registries(first: DataFrame, second: DataFrame) -> DataFrame:
    """Papers of two sources (doi, url, title, ord, ...), one per DOI, else per URL, else per source and beginning of the title.

    The first source wins. Of its papers with one DOI the last counts, at the first one's place in ord; of all others the
    first.
    """
    both = first.withColumn("source_rank", F.lit(1)).unionByName(second.withColumn("source_rank", F.lit(2)))
    key = F.coalesce(F.concat(F.lit("d:"), F.lower("doi")), F.concat(F.lit("u:"), "url"), F.concat(F.lit("t"), F.col("source_rank").cast("string"), F.lit(":"), F.left("title", F.lit(20))))
    w = Window.partitionBy("key")
    later = F.col("doi").isNotNull() & (F.col("source_rank") == 1)
    best = F.row_number().over(w.orderBy("source_rank", F.when(later, -F.col("ord")).otherwise(F.col("ord"))))
    both = both.withColumn("key", key).withColumns({"k": best, "place": F.min("ord").over(Window.partitionBy("key", "source_rank"))})
    return both.where("k = 1").withColumn("ord", F.col("place")).drop("k", "place")


def best_candidate(candidates: DataFrame) -> DataFrame:
    """candidates: ref_id, cand_ord, similarity, author_ok, year_diff, ...; the highest score per ref_id, the first on ties."""
    score = F.col("similarity") - F.when(F.col("author_ok"), 0.0).otherwise(0.2) - F.when(F.coalesce("year_diff", F.lit(0)) > 1, 0.1).otherwise(0.0)
    c = candidates.withColumn("score", score)
    best = F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc("score"), "cand_ord"))
    return c.withColumn("k", best).where("k = 1").drop("k")


def _records(registry: DataFrame, rank: int) -> DataFrame:
    order = F.col("ord").cast("long") if "ord" in registry.columns else F.lit(0).cast("long")
    return registry.select(F.lit(rank).alias("rank"), order.alias("ord"), F.lower("doi").alias("doi"), "arxiv", "title", "first_author", F.col("year").cast("string").alias("year"))


def _by_id(refs: DataFrame, records: DataFrame) -> DataFrame:
    """ref_id with similarity, author_ok, year_diff and cand_doi of the best record that has the DOI or arXiv id."""
    ids = lambda d, a: F.explode(F.array_compact(F.array(F.concat(F.lit("d"), d), F.concat(F.lit("a"), a)))).alias("key")
    mine = refs.select("ref_id", "title", "first_author", "year", ids(F.lower("doi"), F.col("arxiv")))
    g = records.distinct().select(F.struct("rank", "ord", F.col("doi").isNull().alias("no_doi"), "doi", "title", "first_author", "year", "arxiv").alias("g"), ids(F.col("doi"), F.col("arxiv")))
    c = mine.join(g, "key").select("ref_id", "g", T.title_similarity(F.col("title"), F.col("g.title")).alias("similarity"), T.author_match(F.col("first_author"), F.col("g.first_author")).alias("author_ok"), T.year_difference(F.col("year"), F.col("g.year")).alias("year_diff"))
    best = best_candidate(c.withColumnRenamed("g", "cand_ord"))
    return best.select("ref_id", "similarity", "author_ok", "year_diff", F.col("cand_ord.doi").alias("cand_doi"))


def verify(refs: DataFrame, registry: DataFrame | None, more: DataFrame | None = None, known_dois: DataFrame | None = None) -> DataFrame:
    """refs: ref_id and the columns of parse(); registry: doi, arxiv, title, first_author, year, and ord if its order counts.
    Adds status, similarity, matched_doi and diffs (what keeps a match from being right).

    Ids are equi-joins; `more` is a second registry of that form, asked for ids that the first doesn't have. A record found
    by its id is right or partly so. Without one, titles are searched (titles.best_match, all pairs that are similar enough):
    a reference with an unknown DOI is partly right at best, and matched_doi is the correct one; one without ids is right by
    its title alone, unless that has two words or fewer and the authors differ. known_dois (doi) are registered without
    metadata: partial. An arXiv id or a book that isn't found is unreachable; a web page without id does not apply. Without
    a registry snapshot everything is unreachable. On ties the first registry, then the lower ord, then the lower DOI wins;
    the order of rows never counts.
    """
    if registry is None:
        return refs.withColumns({"status": F.lit("unreachable"), "similarity": F.lit(None).cast("double"), "matched_doi": F.lit(None).cast("string"), "diffs": F.array().cast("array<string>")})
    g = _records(registry, 1) if more is None else _records(registry, 1).unionByName(_records(more, 2))
    by_id = _by_id(refs, g)
    no_id = F.col("doi").isNull() & F.col("arxiv").isNull()
    page = no_id & (F.coalesce("kind", F.lit("")) == "web")
    only_arxiv = F.col("doi").isNull() & F.col("arxiv").isNotNull()
    search = refs.where(F.col("title").isNotNull() & ~page & ~only_arxiv).join(by_id, "ref_id", "left_anti")
    known = ["title", "first_author", "year"]
    by_title = titles.best_match(search.select(*known), g, PARTIAL).alias("b")
    by_title = search.select("ref_id", *known).alias("s").join(by_title, [F.col(f"s.{c}").eqNullSafe(F.col(f"b.{c}")) for c in known]).select("ref_id", "similarity", "author_ok", "year_diff", "cand_doi")
    found = by_id.withColumn("by_id", F.lit(True)).unionByName(by_title.withColumn("by_id", F.lit(False)))
    out = refs.join(found, "ref_id", "left")
    late = F.coalesce("year_diff", F.lit(0)) > 1
    short = F.size(F.split(F.trim("title"), r"\s+")) <= 2
    status = (
        F.when(F.col("by_id"), F.when((F.col("similarity") >= VERIFIED) & F.col("author_ok") & ~late, "verified").otherwise("partial"))
        .when(page, "not_applicable")
        .when(only_arxiv, "unreachable")
        .when(F.col("similarity").isNotNull(), F.when(no_id & (F.col("similarity") >= VERIFIED) & ~(short & ~F.col("author_ok")), "verified").otherwise("partial"))
    )
    if known_dois is not None:
        out = out.join(known_dois.select(F.lower("doi").alias("known")).distinct(), F.lower("doi") == F.col("known"), "left")
        status = status.when(F.col("known").isNotNull(), "partial")
    status = status.when(no_id & (F.col("kind") == "book"), "unreachable").otherwise("unverified")
    diffs = F.array_compact(F.array(F.when(F.col("similarity") < VERIFIED, "title_differs"), F.when(~F.col("author_ok"), "author_differs"), F.when(late & F.col("similarity").isNotNull(), "year_differs")))
    return out.select(*refs.columns, status.alias("status"), "similarity", F.col("cand_doi").alias("matched_doi"), diffs.alias("diffs"))


def retracted(registry: DataFrame) -> DataFrame:
    """registry: doi, update_types array, is_retracted. Those with a retraction or withdrawal notice."""
    notice = F.exists(F.coalesce("update_types", F.array().cast("array<string>")), lambda t: F.lower(t).rlike("retraction|withdrawal"))
    return registry.where(notice | F.coalesce("is_retracted", F.lit(False)))


def _after(steps: DataFrame, hops: int) -> DataFrame:
    """steps: url, at (the next page), n (1) and perhaps path ([at]). Where each page leads after `hops` steps, or before if
    there are no more: by steps of 1, 2, 4, ... pages, each of two of the last kind, of which those that `hops` sums up to
    are taken. So a chain costs as many joins as its length has binary digits, twice at most."""

    def then(l: DataFrame, r: DataFrame) -> DataFrame:
        j = l.alias("l").join(r.alias("r"), F.col("l.at") == F.col("r.url"), "left")
        path = [F.concat("l.path", F.coalesce("r.path", F.array().cast("array<string>"))).alias("path")] if "path" in l.columns else []
        return j.select("l.url", F.coalesce("r.at", "l.at").alias("at"), (F.col("l.n") + F.coalesce("r.n", F.lit(0))).alias("n"), *path)

    far, out = steps, None
    for k in range(hops.bit_length()):
        if k:
            last, far = far, stored(then(far, far))
            if k > 1 and out is not last:
                forget(last)
        if hops >> k & 1:
            out = far if out is None else stored(then(out, far))
    return out


def redirect_ends(edges: DataFrame, hops: int = 10) -> DataFrame:
    """edges: from_url, to_url. For each from_url url, final_url, hops and state: where its redirects end ('final'), where they
    come back to a page of the chain ('cycle', hops being the pages it has), or where they are after `hops` steps ('too_long').

    Of several targets of a page the first by name counts; edges without one of the pages don't. Chains are doubled, with
    a table in the shared folder each time; only pages whose chain hasn't ended by then get a list of `hops` pages, in
    which a page that comes back is looked for.
    """
    if hops < 1:
        raise ValueError("a chain has a step at least")
    e = edges.select(F.col("from_url").cast("string"), F.col("to_url").cast("string")).where("from_url IS NOT NULL AND to_url IS NOT NULL")
    e = stored(e.groupBy(F.col("from_url").alias("url")).agg(F.min("to_url").alias("at")).withColumn("n", F.lit(1)))
    pages = e.select(F.col("url").alias("page"))
    ends = _after(e, hops).withColumnRenamed("at", "final_url")
    on = stored(ends.join(pages, F.col("final_url") == F.col("page"), "left_semi"))
    done = ends.join(pages, F.col("final_url") == F.col("page"), "left_anti").select("url", "final_url", F.col("n").alias("hops"), F.lit("final").alias("state"))
    if on.isEmpty():
        return done
    # Chains that come back never leave the pages that are still on their way.
    turning = stored(e.join(on.select("url"), "url", "left_semi").withColumn("path", F.array("at")))
    seen = _after(turning, hops).select("url", F.concat(F.array("url"), "path").alias("path")).where(F.size("path") == hops + 1)
    seen = seen.withColumn("pages", F.size(F.array_distinct("path"))).where(F.col("pages") <= hops)
    back = seen.select(F.col("url").alias("page"), "pages", F.get("path", F.col("pages")).alias("again"))
    rest = on.join(back, F.col("url") == F.col("page"), "left")
    state = F.when(F.col("page").isNotNull(), "cycle").otherwise("too_long")
    return done.unionByName(rest.select("url", F.coalesce("again", "final_url").alias("final_url"), F.coalesce("pages", "n").alias("hops"), state.alias("state")))


def corrected_entry() -> Column:
    """A bibliography entry of registry columns."""
    part = lambda c, f: F.when(F.col(c).isNotNull(), f)
    return F.concat_ws(" | ", part("first_author", F.col("first_author")), part("year", F.concat(F.lit("("), "year", F.lit(")"))), part("title", F.col("title")), part("container", F.col("container")), part("doi", F.concat(F.lit("doi:"), "doi")))
