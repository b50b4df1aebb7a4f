"""Score lines and what they sum up to, against a plain reading of lines; notices in full."""

import random
import re

from pyspark.sql import functions as F

from attesta.operators import notice, reports

def today():
    return F.to_date(F.lit("2026-08-01"))


def plain(text):
    lines = (text or "").split("\n")
    score, total = [], 0.0

    def cells(line):
        parts = [p.strip() for p in line.split("|")]
        if "|" not in line or any(re.match(r"^[-:]+$", p) for p in parts):
            return [], []
        found = [m for p in parts if (m := re.match(r"^(\d+(?:\.\d+)?)\s*(점|%)?\s*$", p))]
        return [float(m[1]) for m in found if m[2] != "%"], [float(m[1]) for m in found if m[2] == "%"]

    for i, line in enumerate(lines):
        points = [float(n) for n, _ in re.findall(r"(\d+(?:\.\d+)?)\s*(점|%)", line)]
        if points:
            window = [cells(x) for x in lines[i : i + 20]]
            own = [v for c, _ in window for v in c]
            score.append((i + 1, points, own, [v for _, w in window for v in w], line.lstrip().startswith("|")))
            total += sum(points if score[-1][4] else own)
    return score, round(total, 2)


def texts(n: int) -> list:
    r = random.Random(3)
    kinds = ["| 항목 | 배점 |", "|---|:-:|", "심사 {a}점 만점", "| 창의성 | {a}.5점 | {b} |", "  | 비중 | {b}% | 3 |", "{a} | {b}", "", "총점 {a}.25%", "| 10.5점 | 20점 이상 |", "그냥 문장", "v1.2 | 3.10 |"]
    return [(i, "\n".join(r.choice(kinds).format(a=r.randint(0, 99), b=r.randint(0, 50)) for _ in range(r.randint(0, 45)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "| 1점 |")]


def test_score_lines_and_sums(spark):
    rows = texts(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for r in notice.score_lines(docs).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, [float(x) for x in r.points], [float(x) for x in r.cells], [float(x) for x in r.weights], r.in_table))
    sums = {r.doc_id: (r.score_lines, r.total, r.near_hundred) for r in notice.score_check(docs).collect()}
    for i, t in rows:
        score, total = plain(t)
        assert sorted(got.get(i, [])) == score
        assert sums.get(i) == ((len(score), total, 95 <= total <= 105) if score else None)


def test_every_date_of_a_long_line(spark):
    line = ", ".join(f"2026-09-{1 + i % 28:02d} {i // 100:02d}:{i % 60:02d}(월)" for i in range(1500))
    found = notice.dates(spark.createDataFrame([(1, line)], "doc_id long, text string"), today()).collect()
    assert {(r.date.day, r.time) for r in found} == {(1 + i % 28, f"{i // 100:02d}:{i % 60:02d}") for i in range(1500)}


def test_kinds_need_words_of_their_own(spark):
    lines = ["2026-09-01 마감", "2026-09-01 마감과", "시상식 2026-09-01", "2026-09-01 OT", "2026-09-01 ROT", "접수 시작 2026-09-01 18:00", "해커톤 2026-09-01", "2026-09-01"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.doc_id: r.kind for r in notice.dates(docs, today()).collect()} == dict(enumerate(["submission_deadline", "other", "final_award", "briefing", "other", "submission_deadline", "event", "other"]))


def test_a_notice_in_full(spark):
    text = "# 창업 공모전 공고\n접수 마감 2026-07-31 24:00\n제출 마감 2026-09-26(금) 18:00\n시상식 9월 30일\n위반 시 실격\nPDF 20쪽 이내\n심사 100점\n| 가 | 60점 |\n| 나 | 40점 |\n문의 a@x.org 02-123-4567"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "아무 글"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in reports.notice_details(docs, today(), ["2026-09-24"]).collect()}
    one = got[1]
    assert one.status == "ok" and one.warnings == []
    assert [(r.line_no, str(r.date), r.kind, r.dday_label, r.warnings) for r in one.schedule] == [(2, "2026-07-31", "submission_deadline", "D+1", ["past", "midnight"]), (3, "2026-09-26", "submission_deadline", "D-56", ["weekend", "holiday:2026-09-24"]), (4, "2026-09-30", "final_award", "D-60", ["holiday:2026-09-24"])]
    assert (str(one.primary_deadline.date), one.primary_deadline.time) == ("2026-07-31", "24:00")
    assert tuple(one.date_flags) == (True, True, True, True)
    assert [(r.line_no, r.keyword, r.classes) for r in one.risk_lines] == [(5, "실격", ["disqualification"])]
    assert [(r.line_no, [(s.spec, s.value) for s in r.specs]) for r in one.spec_lines if r.line_no == 6] == [(6, [("file_type", "PDF"), ("limit", "20쪽 이내"), ("pages", "20")])]
    assert [(r.line_no, [float(p) for p in r.points], [float(c) for c in r.cells]) for r in one.score_lines] == [(7, [100], [60, 40]), (8, [60], [60, 40]), (9, [40], [40])]
    assert tuple(one.score_sum) == (200.0, False) and one.contacts.emails == ["a@x.org"] and one.contacts.phones == ["02-123-4567"]
    assert [(got[k].status, got[k].warnings, got[k].schedule, got[k].primary_deadline) for k in (2, 3, 4)] == [("empty", ["unlike_a_notice", "no_dates"], [], None), ("no_dates", ["unlike_a_notice", "no_dates"], [], None), ("empty", ["unlike_a_notice", "no_dates"], [], None)]
