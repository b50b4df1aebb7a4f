"""Notices: dates with what they mean, days left, rule lines, specifications, scores and contacts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.functions.literals import required
from attesta.functions.text import LEFT, RIGHT, let
from attesta.operators.pii import lines

#: Words of lines about disqualification, in the order they are looked for.
RISK_WORDS = ["실격", "제외", "불가", "무효", "취소", "환수", "박탈", "금지", "불이익", "반려", "미준수", "위반", "표절", "도용", "중복", "허위", "부정", "유의", "주의", "엄수"]
#: Classes of such lines.
RISK_CLASSES = [("disqualification", "실격|제외|불가|무효|취소|반려|미준수|위반|부정|허위"), ("deduction", "감점"), ("forfeit", "환수|박탈"), ("prohibition", "금지|도용|표절|중복"), ("caution", "유의|주의|엄수")]
#: Kinds of dates by words on their line, first match first.
DATE_KINDS = [
    ("submission_deadline", "마감|접수 마감|제출 마감|접수 마감일|제출 마감일|접수종료|제출기한|제출 기한|마감일|마감 기한|마감 시|마감시간|오후 6시|18:00|23:59|자정"),
    ("final_award", "결선|시상|시상식|대상|시상 식|시상일|시상 일자"),
    ("announcement", "발표|결과 발표|합격 발표|예비심사 결과|서류 심사 결과|발표일"),
    ("briefing", "설명|교육|워크숍|세미나|오리엔테이션|O[ T]?T|사전 설명|설명회|참가 안내|오픈 설명"),
    ("start", "시작|접수 시작|접수 시작일|시작일|공모 시작|모집 시작|접수 개시|접수개시"),
    ("event", "행사|개막|페스티벌|컵|데이|포럼|콘퍼런스|컨퍼런스|전시회|박람회|해커톤|아이디어톤|대회|올림피아드|캠프"),
]
#: Lines that a table of scores may stand below the line that introduces it, and what its sum should be.
SCORE_WINDOW, FULL_SCORE = 20, (95, 105)
#: What specifications look like.
SPECS = [("size", r"(\d+(?:\.\d+)?\s*(?i:MB|KB|GB))"), ("pages", r"(\d+)\s*(?:쪽|장|페이지|매)"), ("characters", r"(\d+)\s*자"), ("minutes", r"(\d+)\s*(?:분|초)"), ("copies", r"(\d+)\s*부"), ("people", r"(\d+)\s*(?:인|명)"), ("file_type", r"(?:^|[^A-Za-z])(?i:(HWP|PDF|DOCX|PPTX|MP4|ZIP|PNG|JPG|MP3))(?:[^A-Za-z]|$)"), ("limit", r"(\d+(?:\.\d+)?\s*(?:쪽|자|분|MB|KB|GB|부|인|장)\s*(?:이내|이하|미만))"), ("file_name", r"파일명\s*(?:규칙|형식|안내|지정|예시)[:：\s]*(.{1,120})")]
WEEKDAYS = "월화수목금토일"
#: English names by their first letters, and a bracketed weekday in either language.
ENGLISH = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
BRACKETED = rf"^\s*\(\s*(?:[{WEEKDAYS}](?:요일)?|(?i:{'|'.join(ENGLISH)})[A-Za-z]*\.?)\s*\)"
#: A year of two digits stands before a whole month and day only.
_YEAR = r"\d{4}|\d{2}(?=\s*[-./년]\s*(?:0?[1-9]|1[0-2])\s*[-./월]\s*(?:0?[1-9]|[12]\d|3[01])(?!\d|\.\d|\s*[:시]))"
DATE = rf"(?:({_YEAR})\s*[-./년]\s*)?(\d{{1,2}})\s*[-./월]\s*(\d{{1,2}})\s*일?"
_ONE = rf"(?=\d)(?<![\d.\-/vV])(?:(?:{_YEAR})\s*[-./년]\s*)?\d{{1,2}}\s*[-./월]\s*\d{{1,2}}(?![\d]|\s*(?:점|%|MB|쪽))(?:\s*일|\.(?!\d))?"


def dates(docs: DataFrame, today: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per date on a line: doc_id, line_no, raw, date, time, year_inferred, weekday, weekday_in_text, weekday_mismatch, kind.

    A year of two digits is one from 2000 on. A year that is left out is this one, or the next if the date would be over 240 days past. A two-part number that is
    a score, a size or no date gives nothing. Of equal dates and times on a line the first stays.
    """
    # Two numbers with a sign between them are found quickly, and few lines have any.
    kind = F
    for name, words in DATE_KINDS:
        # What a match has to hold is looked for as bytes, which leaves most lines out before the pattern runs.
        some = [w for w in required(words) if not any(o in w and o != w for o in required(words))]
        begin = "".join(sorted({w[0] for w in words.split("|")}))  # most places of a line are left after one character
        kind = kind.when(reduce(Column.__or__, (F.contains("line", F.lit(w)) for w in sorted(some))) & F.col("line").rlike(f"(?=[{begin}]){LEFT}(?:{words}){RIGHT}"), name)
    l = lines(docs, id_col, text_col).where(F.col("line").rlike(r"\d\s*[-./월]\s*\d"))
    # split() compiles a pattern for each row, but not a single character. One search puts a sign before and one after each date.
    cut = F.split(F.regexp_replace("line", f"({_ONE})", "\1$1\2"), "\1", -1)
    pair = lambda x: let(F.length(F.substring_index(x, "\2", 1)), lambda n: F.struct(F.left(x, n).alias("raw"), F.substring(x, n + 2, F.length(x)).alias("rest")))
    quick = let(cut, lambda x: F.transform(F.slice(x, F.lit(2), F.size(x)), pair))
    after = let(F.split("line", _ONE, -1), lambda x: F.slice(x, F.lit(2), F.size(x)))
    slow = F.zip_with(F.regexp_extract_all("line", F.lit(_ONE), F.lit(0)), after, lambda raw, rest: F.struct(raw.alias("raw"), rest.alias("rest")))
    pairs = F.when(F.contains("line", F.lit("\1")) | F.contains("line", F.lit("\2")), slow).otherwise(quick)
    # All that is found of a date is computed once, in arrays: filters on columns would repeat the expressions below them, and
    # explode() would have Spark ask for the array's size first.
    found = F.transform(pairs, lambda x: F.struct(x["raw"].alias("raw"), x["rest"].alias("rest"), F.regexp_extract_all(x["raw"], F.lit(r"\d+"), F.lit(0)).alias("n")))
    number = lambda x, k: F.element_at(x["n"], k).try_cast("int")
    kept = lambda x, *names: [x[c].alias(c) for c in names]
    found = F.transform(found, lambda x, i: F.struct(i.alias("i"), *kept(x, "raw", "rest"), F.when(F.size(x["n"]) > 2, number(x, 1)).alias("y"), number(x, -2).alias("m"), number(x, -1).alias("d")))
    found = F.filter(found, lambda x: x["y"].isNotNull() | x["raw"].contains("월") | x["rest"].rlike(BRACKETED))
    found = F.transform(found, lambda x: F.struct(*kept(x, "i", "raw", "rest"), x["y"].isNull().alias("year_inferred"), _day(x, today).alias("date")))
    found = F.filter(found, lambda x: x["date"].isNotNull())
    clock = lambda x, k: F.regexp_extract(x["rest"], r"^[^\d]{0,12}(\d{1,2})\s*(?::|시)\s*(\d{2})?", k)
    low = lambda c: let(c, lambda v: F.when(v != "", F.lower(v)).otherwise(v))
    said = lambda x: F.regexp_extract(x["rest"], rf"^\s*\(?\s*([{WEEKDAYS}])(?:요일)?\s*\)", 1)
    named = lambda x: low(F.regexp_extract(x["rest"], rf"^\s*\(?\s*(?i:({'|'.join(ENGLISH)})(?:day|sday|nesday|rsday|urday)?)\b", 1))
    found = F.transform(found, lambda x: F.struct(*kept(x, "i", "raw", "date", "year_inferred"), clock(x, 1).alias("hour"), clock(x, 2).alias("minute"), x["rest"].rlike(r"^[^\d]{0,12}오후").alias("afternoon"), x["rest"].rlike(r"^[^\d]{0,8}자정").alias("midnight"), said(x).alias("said"), named(x).alias("named")))
    d = l.select("doc_id", "line_no", kind.otherwise("other").alias("kind"), F.explode_outer(found).alias("p")).where("p IS NOT NULL").select("doc_id", "line_no", "kind", "p.*")
    said = F.coalesce(F.nullif("said", F.lit("")), *(F.when(F.col("named") == e, k) for e, k in zip(ENGLISH, WEEKDAYS, strict=True)))
    whole = lambda c: F.when(F.col(c) != "", F.col(c).try_cast("int")).alias(c)  # noqa: E731  (an empty text would cost an exception)
    d = d.withColumns({c: whole(c) for c in ("hour", "minute")})
    evening = F.col("afternoon") & (F.col("hour") < 12)
    padded = lambda n: F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(2)), F.lit("0"))
    time = F.when(F.col("midnight"), "24:00").when(F.col("hour").isNotNull(), F.concat(padded(F.col("hour") + F.when(evening, 12).otherwise(0)), F.lit(":"), padded(F.coalesce("minute", F.lit(0)))))
    weekday = F.substring(F.lit(WEEKDAYS), F.weekday("date") + 1, F.lit(1))
    d = d.select("doc_id", "line_no", "kind", "i", "raw", "date", "year_inferred", time.alias("time"), weekday.alias("weekday"), said.alias("weekday_in_text"))
    first = F.row_number().over(Window.partitionBy("doc_id", "line_no", "date", "time").orderBy("i"))
    return d.withColumn("k", first).where("k = 1").select("doc_id", "line_no", "raw", "date", "time", "year_inferred", "weekday", "weekday_in_text", (F.col("weekday_in_text") != F.col("weekday")).alias("weekday_mismatch"), "kind")


def _day(x: Column, today: Column) -> Column:
    """The date of the numbers y, m and d of x, y being null where the text leaves it out; null if there is none."""

    def day(y: Column) -> Column:
        first = F.make_date(y, x["m"], F.lit(1))
        return F.when(x["m"].between(1, 12) & (x["d"] > 0), F.when(x["d"] <= F.dayofmonth(F.last_day(first)), F.make_date(y, x["m"], x["d"])))

    this = day(F.year(today))
    ahead = F.when(F.date_diff(today, this) > 240, day(F.year(today) + 1)).otherwise(this)
    return F.when(x["y"].isNull(), ahead).otherwise(day(x["y"] + F.when(x["y"] < 100, 2000).otherwise(0)))


def holidays_table(spark: SparkSession, days: list[str]) -> DataFrame:
    return spark.createDataFrame([(d,) for d in days], "day string").select(F.to_date("day").alias("day"))


def days_left(targets: DataFrame, today: Column, holidays: list[str], column: str = "target") -> DataFrame:
    """Adds dday (days from today), label, business_days and holidays_between in (today, target], past.

    Business days are counted by whole weeks and the rest, so a far target costs no more than a near one.
    """
    t = F.col(column)
    n = F.date_diff(t, today)
    free = F.array(*(F.to_date(F.lit(h)) for h in holidays)) if holidays else F.array().cast("array<date>")
    between = F.filter(free, lambda h: (h > today) & (h <= t))
    week = F.weekday(today)
    rest = F.pmod(n, F.lit(7))
    # Weekdays among the days after whole weeks: they begin on the day after today.
    odd = sum((F.when((rest >= k) & (F.pmod(week + k, F.lit(7)) < 5), 1).otherwise(0) for k in range(1, 7)), F.lit(0))
    work = F.floor(n / 7) * 5 + odd - F.size(F.filter(between, lambda h: F.weekday(h) < 5))
    label = F.when(n == 0, "D-DAY").when(n > 0, F.format_string("D-%d", n)).otherwise(F.format_string("D+%d", -n))
    return targets.withColumns({"dday": n, "dday_label": label, "business_days": F.when(n > 0, work).otherwise(0).cast("int"), "holidays_between": F.size(between), "past": n < 0})


def deadline_warnings(counted: DataFrame, today: Column, holidays: list[str], column: str = "target", time: str | None = None) -> DataFrame:
    """Adds to days_left() the array warnings: codes past, soon (three days or fewer), weekend, holiday:<day> for each one
    from tomorrow to the target, midnight (by the column `time`, if one is named: 23:59, 24:00 or the word for it)."""
    t = F.col(column)
    free = F.array_sort(F.array_distinct(F.array(*(F.to_date(F.lit(h)) for h in holidays)))) if holidays else F.array().cast("array<date>")
    days = F.transform(F.filter(free, lambda h: (h > today) & (h <= t)), lambda h: F.concat(F.lit("holiday:"), h.cast("string")))
    one = lambda test, code: F.when(test, F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))
    late = one(F.col(time).rlike("(^|T)(23:59|24:00)|자정"), "midnight") if time else F.array().cast("array<string>")
    soon = (F.col("dday") >= 0) & (F.col("dday") <= 3)
    return counted.withColumn("warnings", F.concat(one(F.col("dday") < 0, "past"), one(soon, "soon"), one(F.weekday(t) >= 5, "weekend"), F.coalesce(days, F.array().cast("array<string>")), late))


def risk_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, line, keyword (the first that stands on it), classes."""
    l = lines(docs, id_col, text_col).where(F.col("line").rlike("|".join(RISK_WORDS)))
    first = F.element_at(F.filter(F.array(*map(F.lit, RISK_WORDS)), lambda k: F.contains("line", k)), 1)
    classes = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), name) for name, p in RISK_CLASSES)))
    return l.select("doc_id", "line_no", "line", first.alias("keyword"), F.when(F.size(classes) > 0, classes).otherwise(F.array(F.lit("other"))).alias("classes"))


def spec_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, spec, value; of a rule for file names the first 120 characters."""
    named = lambda name: lambda v: F.struct(F.lit(name).alias("spec"), v.alias("value"))
    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all("line", F.lit(p), F.lit(1)), named(name)) for name, p in SPECS)))
    return lines(docs, id_col, text_col).where(F.col("line").rlike(r"(?i)\d|파일명|HWP|PDF|DOCX|PPTX|MP4|ZIP|PNG|JPG|MP3")).select("doc_id", "line_no", F.explode(found).alias("s")).select("doc_id", "line_no", "s.*")


def table_cells(line: Column) -> Column:
    """struct(cells, weights): the numbers that stand alone in the cells of a row of bars, points and percentages apart.
    A row that separates head and body has none, nor has text outside of a table."""
    return let(_parts(line), lambda ps: F.struct(_numbers(ps, "점?").alias("cells"), _numbers(ps, "%").alias("weights")))


def _parts(line: Column) -> Column:
    """What stands between the bars of a row of a table; of other lines nothing."""
    none = F.array().cast("array<string>")
    row = lambda ps: F.when(F.exists(ps, lambda p: p.rlike("^[-:]+$")), none).otherwise(ps)
    return F.when(F.contains(line, F.lit("|")), let(F.transform(F.split(line, r"\|", -1), lambda p: F.trim(p)), row)).otherwise(none)


def _numbers(parts: Column, unit: str) -> Column:
    """The parts that are a number with this unit."""
    found = F.transform(parts, lambda p: F.regexp_extract(p, rf"^(\d+(?:\.\d+)?)\s*{unit}\s*$", 1))
    return F.transform(F.filter(found, lambda v: v != ""), _number)


def _number(text: Column) -> Column:
    """Exact, so that sums don't depend on their order."""
    return text.try_cast("decimal(20,6)")


def score_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines with points or percentages: doc_id, line_no, line, points, cells, weights, in_table.

    points are the numbers before 점 or %, decimals included; cells and weights those of the table rows among this line and
    the next 19. Rows of tables and lines of text are told apart by in_table.
    """
    l = lines(docs, id_col, text_col).where(F.col("line").rlike(r"\||\d\s*(?:점|%)"))
    points = F.transform(F.regexp_extract_all("line", F.lit(r"(\d+(?:\.\d+)?)\s*(?:점|%)"), F.lit(1)), _number)
    l = l.withColumns({"points": points, "parts": _parts(F.col("line"))})
    # Each of the two in a column of its own, so that what nobody asks for is not searched.
    l = l.withColumns({"own_cells": _numbers(F.col("parts"), "점?"), "own_weights": _numbers(F.col("parts"), "%")})
    below = Window.partitionBy("doc_id").orderBy("line_no").rangeBetween(0, SCORE_WINDOW - 1)
    l = l.withColumns({k: F.flatten(F.collect_list(F.col(f"own_{k}")).over(below)) for k in ("cells", "weights")})
    return l.where(F.size("points") > 0).select("doc_id", "line_no", F.trim("line").alias("line"), "points", "cells", "weights", F.ltrim("line").startswith("|").alias("in_table"))


def score_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score_lines, total, near_hundred. A table's row counts its own points, a line of text the cells of the table
    that it introduces; points of text alone make no total."""
    of = F.when(F.col("in_table"), F.col("points")).otherwise(F.col("cells"))
    total = F.sum(F.aggregate(of, F.lit(0).cast("decimal(30,6)"), lambda a, b: (a + F.coalesce(b, F.lit(0))).cast("decimal(30,6)")))
    g = score_lines(docs, id_col, text_col).groupBy("doc_id").agg(F.count("*").alias("score_lines"), F.round(total, 2).cast("double").alias("total"))
    return g.withColumn("near_hundred", F.col("total").between(*FULL_SCORE))


def window_cells(cells: DataFrame, ahead: int = 19) -> DataFrame:
    """cells: doc_id, line_no, values (array): adds those of the line and the next `ahead` lines."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(0, ahead)
    return cells.withColumn("window_values", F.flatten(F.collect_list("values").over(w)))


def contacts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, emails, phones, urls: distinct and sorted."""
    each = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(text_col, F.lit(p), F.lit(1))))
    return docs.select(F.col(id_col).alias("doc_id"), each(r"([A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+)").alias("emails"), each(r"(0\d{1,2}-\d{3,4}-\d{4})").alias("phones"), each(r"(https?://[^\s,;)]+)").alias("urls"))


def primary_deadline(found: DataFrame) -> DataFrame:
    """doc_id, deadline: the first submission date, else the first date."""
    rank = F.struct((F.col("kind") != "submission_deadline").alias("other"), "date", "line_no")
    return found.groupBy("doc_id").agg(F.min_by("date", rank).alias("deadline"), F.bool_or("weekday_mismatch").alias("any_mismatch"), F.bool_or("year_inferred").alias("any_inferred"))


def is_notice(text: Column, least: int = 2) -> Column:
    words = ["공고", "모집", "접수", "마감", "심사", "제출", "응모", "참가", "시상", "공모"]
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda k: F.contains(text, k))) >= least


def title_line(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, title: the first of 15 lines of 3 to 80 characters that names a contest or call."""
    l = lines(docs, id_col, text_col).where("line_no <= 15").withColumn("line", F.trim(F.regexp_replace("line", r"^#+\s*", ""))).where(F.length("line").between(3, 80)).where(F.col("line").rlike("공모|대회|공고|경진|모집"))
    return l.groupBy("doc_id").agg(F.min_by("line", "line_no").alias("title"))


def mask_inline(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+", "***@***"), r"(0\d{1,2})-\d{3,4}-\d{4}", "$1-****-****")
