"""Reports as ordered lines of Markdown, drafts whose tags and law citations are checked, and the analysis of a notice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators import law, notice, references


def joined_lines(lines: DataFrame, *order: str) -> DataFrame:
    """lines: doc_id, line and the columns of `order`. doc_id, markdown: a document's lines in that order."""
    g = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, "line"))).alias("l"))
    return g.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("markdown"))


def unverified_note(status: Column, similarity: Column, author_ok: Column, year_diff: Column) -> Column:
    """Why a reference was not verified, in words; null for a verified one."""
    why = F.concat_ws("; ", F.when(similarity.isNull(), "no candidate found"), F.when(similarity < references.PARTIAL, "titles differ"), F.when(~author_ok, "author differs"), F.when(year_diff > 1, F.format_string("year differs by %d", year_diff)))
    return F.when(status != "verified", F.when(why == "", F.lit("check by hand")).otherwise(why))


def reference_report(results: DataFrame) -> DataFrame:
    """results: doc_id, ref_id, status, title, entry (the corrected one or null), note. doc_id, markdown: the counts of each
    status, the criteria, a table in order, the corrected bibliography and what is left to check."""
    line = lambda part, df, no, text: df.select("doc_id", F.lit(part).alias("part"), no.cast("long").alias("no"), text.alias("line"))
    counts = results.groupBy("doc_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in references.STATUSES))
    summary = F.format_string("references: %d, " + ", ".join(f"{s}: %d" for s in references.STATUSES), "total", *references.STATUSES)
    parts = [
        line(1, counts, F.lit(0), summary),
        line(2, counts, F.lit(0), F.lit(f"verified from a title similarity of {references.VERIFIED}, partial from {references.PARTIAL}")),
        line(3, counts, F.lit(0), F.lit("| no | status | title |\n|-|-|-|")),
        line(3, results, F.col("ref_id"), F.format_string("| %d | %s | %s |", "ref_id", "status", F.coalesce("title", F.lit("-")))),
        line(4, results.where("entry IS NOT NULL"), F.col("ref_id"), F.format_string("[%d] %s", "ref_id", "entry")),
        line(5, results.where("note IS NOT NULL"), F.col("ref_id"), F.format_string("- %d: %s", "ref_id", "note")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return joined_lines(out, "part", "no")


# -- Drafts -----------------------------------------------------------------------------------------------------------


def photo_tags(detections: DataFrame) -> DataFrame:
    """detections: doc_id, photo_no, label, conf. doc_id, photo_no, tags: one of each label, by its highest confidence."""
    best = detections.groupBy("doc_id", "photo_no", "label").agg(F.max("conf").alias("conf"))
    tag = F.format_string("[사진%d:%s %.2f]", "photo_no", "label", "conf")
    g = best.groupBy("doc_id", "photo_no").agg(F.array_sort(F.collect_list(F.struct("label", tag.alias("tag")))).alias("t"))
    return g.select("doc_id", "photo_no", F.array_join(F.transform("t", lambda x: x["tag"]), " ").alias("tags"))


def draft(inspected: DataFrame, tags: DataFrame) -> DataFrame:
    """inspected: doc_id, photo_no, severity, categories; tags: photo_tags(). doc_id, markdown: a block for each photo with a
    risk or caution, blank lines between them."""
    hit = inspected.where(F.col("severity").isin("risk", "caution")).join(tags, ["doc_id", "photo_no"], "left")
    line = F.concat(F.format_string("photo %d (%s): %s", "photo_no", "severity", "categories"), F.coalesce(F.concat(F.lit(" "), "tags"), F.lit("")), F.lit("\n"))
    return joined_lines(hit.select("doc_id", "photo_no", line.alias("line")), "photo_no")


def blocks(drafts: DataFrame) -> DataFrame:
    """drafts: doc_id, markdown. doc_id, block_no, text: what blank lines separate."""
    return drafts.select("doc_id", F.posexplode(F.split("markdown", r"\n\s*\n")).alias("block_no", "text")).where(F.trim("text") != "")


def checked_blocks(drafted: DataFrame, detections: DataFrame, articles: DataFrame, law_key: str) -> DataFrame:
    """drafted: doc_id, block_no, text. Blocks that cite an article the law lacks go; one with a tag that is no detection
    of its document (doc_id, label, conf at two decimals) is demoted: adds valid, and a mark before its text."""
    cited = drafted.select("doc_id", "block_no", F.explode(F.regexp_extract_all("text", F.lit(r"제\s*(\d+)\s*조"), F.lit(1))).alias("article"))
    bad = cited.join(articles.where(F.col("law_key") == law_key).select(F.col("article").cast("string").alias("article")).distinct(), "article", "left_anti")
    left = drafted.join(bad.select("doc_id", "block_no").distinct(), ["doc_id", "block_no"], "left_anti")
    tags = left.select("doc_id", "block_no", F.explode(F.regexp_extract_all("text", F.lit(r"\[사진\d+:([a-z_]+ \d\.\d\d)\]"), F.lit(1))).alias("tag"))
    false = tags.join(detections.select("doc_id", F.format_string("%s %.2f", "label", "conf").alias("tag")).distinct(), ["doc_id", "tag"], "left_anti")
    marked = left.join(false.select("doc_id", "block_no").distinct().withColumn("false", F.lit(True)), ["doc_id", "block_no"], "left")
    return marked.select("doc_id", "block_no", F.when(F.col("false"), F.concat(F.lit("(to be checked) "), "text")).otherwise(F.col("text")).alias("text"), F.col("false").isNull().alias("valid"))


def law_excerpts(detections: DataFrame, labels: DataFrame, articles: DataFrame, characters: int = 120) -> DataFrame:
    """detections: image, label; labels: label, law, article. image, law, article, excerpt of each law that a label refers
    to and that is held; each once."""
    named = detections.join(labels.where("law IS NOT NULL").select("label", F.col("law").alias("law_key"), "article"), "label").select("image", "law_key", "article").distinct()
    held = articles.where(F.coalesce("sub", F.lit(0)) == 0).select("law_key", "article", F.left("full_text", F.lit(characters)).alias("excerpt"))
    return named.join(held, ["law_key", "article"]).select("image", F.col("law_key").alias("law"), "article", "excerpt")


# -- Notices ----------------------------------------------------------------------------------------------------------


def notice_analysis(docs: DataFrame, today: Column, holidays: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All that is found in a notice, a row a document: likely (a notice by its words), title, deadline and what is left
    until then, numbers of dates, risk lines, specifications and score lines, the score's total, contacts and a summary."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = notice.dates(d, today)
    left = notice.days_left(notice.primary_deadline(found), today, holidays, "deadline")
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    out = d.select("doc_id", notice.is_notice(F.col("text")).alias("likely"))
    for part in (notice.title_line(d), left, count(found, "dates"), count(notice.risk_lines(d), "risks"), count(notice.spec_lines(d), "specs"), notice.score_check(d), notice.contacts(d)):
        out = out.join(part.hint("merge"), "doc_id", "left")  # by the size of the files below it Spark would broadcast a part
    out = out.fillna(0, ["dates", "risks", "specs", "score_lines"])
    said = F.concat_ws("; ", F.col("title"), F.concat(F.lit("deadline "), F.col("deadline").cast("string"), F.lit(" "), "dday_label"), F.format_string("%d risks", "risks"), F.format_string("%d specifications", "specs"), F.when(F.col("score_lines") > 0, F.concat(F.regexp_replace(F.col("total").cast("string"), r"\.0$", ""), F.lit(" points"))))
    return out.withColumn("summary", said)


def _listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """doc_id and `name`, an array of structs of the columns in their order. columns: the first ones give the order."""
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def notice_details(docs: DataFrame, today: Column, holidays: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A notice in full, a row a document: status (ok, no_dates, empty), warnings, schedule, primary_deadline, date_flags,
    risk_lines, spec_lines, score_lines, score_sum, contacts. Lists are in order of lines, and empty where nothing is found.

    schedule: line_no, raw, date, time, weekday, weekday_in_text, kind, dday, dday_label, business_days, holidays_between,
    warnings. primary_deadline is the schedule's first submission date, else its first date. Rows of one document id count
    as one notice. A document holds its lists in one row; they are as long as its text has findings.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = notice.dates(d, today)
    dated = notice.deadline_warnings(notice.days_left(found, today, holidays, "date"), today, holidays, "date", "time")
    schedule = _listed(dated, "schedule", "line_no", "date", "time", "raw", "weekday", "weekday_in_text", "weekday_mismatch", "year_inferred", "kind", "dday", "dday_label", "business_days", "holidays_between", "past", "warnings")
    specs = notice.spec_lines(d).groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_set(F.struct("spec", "value"))).alias("specs"))
    out = d.groupBy("doc_id").agg(F.max(notice.is_notice(F.col("text"))).alias("likely"), F.max(F.trim(F.coalesce("text", F.lit(""))) != "").alias("some"))
    parts = [schedule, _listed(notice.risk_lines(d), "risk_lines", "line_no", "keyword", "classes", "line"), _listed(specs, "spec_lines", "line_no", "specs"), _listed(notice.score_lines(d), "score_lines", "line_no", "points", "cells", "weights", "in_table")]
    for part in parts:
        out = out.join(part.hint("merge"), "doc_id", "left")
        name = part.columns[1]
        out = out.withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    sums = notice.score_check(d).select("doc_id", F.struct("total", "near_hundred").alias("score_sum"))
    people = notice.contacts(d).groupBy("doc_id").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in ("emails", "phones", "urls")))
    out = out.join(sums.hint("merge"), "doc_id", "left").join(people.select("doc_id", F.struct("emails", "phones", "urls").alias("contacts")).hint("merge"), "doc_id", "left")
    by_date = lambda x: F.array_min(F.transform(x, lambda r: F.struct(r["date"].alias("date"), r["line_no"].alias("line_no"), r["time"].alias("time"), r["raw"].alias("raw"), r["kind"].alias("kind"), r["dday"].alias("dday"), r["dday_label"].alias("dday_label"))))
    due = F.coalesce(by_date(F.filter("schedule", lambda r: r["kind"] == "submission_deadline")), by_date(F.col("schedule")))
    any_ = lambda f: F.exists("schedule", lambda r: F.coalesce(f(r), F.lit(False)))
    flags = F.struct(any_(lambda r: r["weekday_mismatch"]).alias("weekday_mismatch"), any_(lambda r: r["year_inferred"]).alias("year_inferred"), any_(lambda r: r["past"]).alias("past_deadline"), any_(lambda r: F.weekday(r["date"]) >= 5).alias("weekend"))
    status = F.when(~F.col("some"), "empty").when((F.size("schedule") > 0) | F.col("likely"), "ok").otherwise("no_dates")
    warnings = F.array_compact(F.array(F.when(~F.coalesce("likely", F.lit(False)), "unlike_a_notice"), F.when(F.size("schedule") == 0, "no_dates")))
    score_sum = F.coalesce("score_sum", F.struct(F.lit(0.0).alias("total"), F.lit(False).alias("near_hundred")))
    return out.select("doc_id", status.alias("status"), warnings.alias("warnings"), "schedule", due.alias("primary_deadline"), flags.alias("date_flags"), "risk_lines", "spec_lines", "score_lines", score_sum.alias("score_sum"), "contacts")


def law_articles_of(docs: DataFrame, pattern: str = r"^\s*(?:#+\s*)?제(\d+)조") -> DataFrame:
    """docs: law_key, text in any layout of lines, Markdown or HTML. Articles as law.parse_law_text gives them: tags go,
    heads may stand behind marks, and metadata before the first and an addendum after the last are left out."""
    plain = F.regexp_replace(F.regexp_replace("text", r"(?i)<(?:br|/p|/div|/li|/tr|/h\d)[^>]*>", "\n"), r"<[^>]+>", "")
    l = docs.select("law_key", F.posexplode(F.split(plain, r"\r\n?|\n")).alias("line_no", "line"))
    end = F.min(F.when(F.col("line").rlike(r"^\s*(?:#+\s*)?부\s*칙"), F.col("line_no"))).over(Window.partitionBy("law_key"))
    l = l.withColumn("end", end).where(F.col("end").isNull() | (F.col("line_no") < F.col("end"))).withColumn("line", F.regexp_replace("line", r"^\s*#+\s*", ""))
    return law.parse_law_text(l.drop("end"))
