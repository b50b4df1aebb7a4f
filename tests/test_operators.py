"""Operators on literal inputs."""

import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.functions import validators as V
from attesta.operators import checklist, gate, law, notice, photos, pii, references
from attesta.sources import documents, sinks
from attesta.streaming import timeline


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [("A b. C d! E", ["A b.", "C d!", "E"]), ("Kim et al. wrote it. Next", ["Kim et al. wrote it.", "Next"]), ("a\nb", ["a", "b"]), ("", []), (None, [])],
)
def test_sentences(spark, text, want):
    assert one(spark, T.sentences(F.col("t").cast("string")), t=text) == want


def test_markers(spark):
    t = "As shown [1] and [12]. (Kim, 2019) agrees; Vaswani et al. (2017) too."
    assert one(spark, T.number_markers(F.col("t")), t=t) == ["1", "12"]
    assert one(spark, T.author_year_markers(F.col("t")), t=t) == ["Kim, 2019", "Vaswani, 2017"]


def test_quotes(spark):
    q = lambda s: one(spark, T.quote_exists(F.col("q"), F.lit("A Title"), F.lit("We propose a new simple network architecture, the model.")), q=s)
    assert q("a new simple network architecture") and q("We propose a new ... simple network architecture")
    assert not q("a new complex network architecture") and not q("short") and not q("")


def test_title_similarity(spark):
    rows = spark.createDataFrame([("Attention is all you need", "attention is all you need."), ("Attention is all you", "Attention is all you need now"), ("abc", None), ("deep nets", "cooking")], "a string, b string")
    got = [r[0] for r in rows.select(T.title_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0 and got[1] >= 0.9 and got[2] == 0.0 and got[3] < 0.5


def test_spans_have_offsets(spark):
    got = one(spark, T.spans("t", r"\d+"), t="a12 b3")
    assert [(s.start, s.end, s.value) for s in got] == [(1, 3, "12"), (5, 6, "3")]


def test_validators(spark):
    assert one(spark, V.luhn(F.lit("4539 1488 0343 6467"))) and not one(spark, V.luhn(F.lit("4539 1488 0343 6468")))
    assert one(spark, V.resident_status(F.lit("991332-1234567"))) == "invalid-date"
    assert one(spark, V.ip_reserved(F.lit("172.20.1.1"))) and not one(spark, V.ip_reserved(F.lit("172.40.1.1")))
    assert not one(spark, V.ip_valid(F.lit("1.2.3.256")))


PII = "메일 kim.lee@example.org 전화 010-1234-5678\r\n주민 901201-1234567 카드 4539-1488-0343-6467\nkey sk-abcdefghijklmnopqrstuv1 ip 10.0.0.1\n계좌 110-234-567890 이름 홍길동\n생년월일 1990-02-30 1990-02-28"


def test_scan_finds_masks_and_suppresses(spark):
    docs = spark.createDataFrame([(1, PII), (2, "nothing here"), (3, None)], "doc_id long, text string")
    f = pii.scan(docs).persist()
    kinds = {(r.type, r.line): r for r in f.collect()}
    assert {k for k, _ in kinds} >= {"email", "mobile_phone", "resident_number", "credit_card", "openai_api_key", "ipv4", "account_number", "name", "birth_date"}
    assert kinds["email", 1].masked == "ki***@example.org" and kinds["mobile_phone", 1].masked == "010-****-****"
    assert kinds["birth_date", 5].value == "1990-02-28"
    by_line = {}
    for r in f.collect():
        assert PII.replace("\r\n", "\n").split("\n")[r.line - 1][r.start : r.end].endswith(r.value[-3:])
        by_line.setdefault(r.line, []).append((r.start, r.end))
    for s in by_line.values():
        s.sort()
        assert all(a[1] < b[0] for a, b in zip(s, s[1:], strict=False))
    masked = pii.masked_copies(docs, f).collect()
    assert [r.doc_id for r in masked] == [1] and all(r.value not in masked[0].masked_text for r in f.collect() if r.type != "name")
    assert [(r.doc_id, r.risk) for r in pii.document_risk(f).collect()] == [(1, "HIGH")]
    assert pii.report_lines(f).first().markdown.startswith("| type |")


def test_reference_fields(spark):
    raw = ['[1] Vaswani, A. et al. (2017). Attention is all you need. arXiv:1706.03762.', 'Kim, A. "A quoted title here", Journal of X, 2020. doi:10.1234/abc.5', "김철수, 이영희 (2019). 안전 관리 보고서.", "nothing"]
    rows = references.parse_references(spark.createDataFrame(list(enumerate(raw)), "ref_id int, raw string")).orderBy("ref_id").collect()
    assert rows[0].arxiv == "1706.03762" and rows[0].year == "2017" and rows[0].kind == "article" and rows[0].confidence == 0.85
    assert rows[1].doi == "10.1234/abc.5" and rows[1].title == "A quoted title here" and rows[1].first_author == "Kim"
    assert rows[2].first_author == "김철수" and rows[2].kind == "report"
    assert rows[3].confidence == 0.2


def test_references_from_elements(spark):
    e = [(1, 0, 1, "paragraph", "Body text [1].", 0.1, 0.1), (1, 1, 1, "heading1", "References", 0.1, 0.2), (1, 2, 1, "list", "[1] Kim, A. (2001). First title\ngoes on here.\n[2] Lee, B. (2002). Second", 0.1, 0.3), (1, 3, 1, "footer", "page 1", 0.1, 0.9), (1, 4, 2, "paragraph", "title that continues.", 0.1, 0.1)]
    rows = spark.createDataFrame(e, "doc_id long, ord int, page int, category string, text string, x double, y double").withColumns({"w": F.lit(0.3), "h": F.lit(0.1)})
    got = references.extract_references(rows).orderBy("ref_id").collect()
    assert [r.text for r in got] == ["[1] Kim, A. (2001). First titlegoes on here.", "[2] Lee, B. (2002). Second title that continues."]
    assert [r.source_note for r in got] == ["number_marked", "merged"]


def test_item_modes(spark):
    t = spark.createDataFrame([(1, "[1] a\nb\n[2] c"), (2, "x\n\ny z"), (3, "p\nq")], "doc_id int, text string")
    got = {}
    for r in references.split_items(t).orderBy("doc_id", "item_no").collect():
        got.setdefault(r.doc_id, []).append(r.item)
    assert got == {1: ["[1] a\nb", "[2] c"], 2: ["x", "y z"], 3: ["p", "q"]}


def test_law(spark):
    docs = spark.createDataFrame([(1, "이는 「산업안전보건법」 제38조 제2항과 근로기준법 제6조의2에 따른다."), (2, "법 없음")], "doc_id long, text string")
    got = [(r.law_key, r.article, r.paragraph, r.sub_article) for r in law.extract_citations(docs).orderBy("start").collect()]
    assert got == [("산업안전보건법", 38, 2, None), ("근로기준법", 6, 2, 2)]
    articles = spark.createDataFrame([("산업안전보건법", 38, None, 1, ["a"], "x")], "law_key string, article int, sub int, pos int, paragraphs array<string>, full_text string")
    verdicts = {r.law_key: r.verdict for r in law.lookup(law.extract_citations(docs), articles).collect()}
    assert verdicts == {"산업안전보건법": law.NO_ARTICLE, "근로기준법": law.NOT_HELD}


def test_checklist(spark):
    docs = spark.createDataFrame([(1, "원청이 직접 지시 한다. 출퇴근 기록은 없다."), (2, "")], "doc_id int, text string")
    got = {(r.doc_id, r.axis, r.item): r.label for r in checklist.evaluate(docs, checklist.rules_table(spark)).collect()}
    assert got[1, 1, 1] == "risk" and got[1, 1, 3] == "no_evidence" and set(v for k, v in got.items() if k[0] == 2) == {"no_evidence"}


def test_full_checklist(spark):
    docs = spark.createDataFrame([(1, "파견 근로자 지시 사항이 있고 원청의 구체적인 지시 문서도 있다."), (2, "원청 조회에 직접 참석 한다.")], "doc_id int, text string")
    found = checklist.evaluate(docs, checklist.rules_table(spark, checklist.DEFAULT)).collect()
    got = {(r.doc_id, r.axis, r.item): r.label for r in found}
    assert len(got) == len(found) == 2 * 18 and {a for _, a, _ in got} == {1, 2, 3, 4, 5}
    assert got[1, 1, 1] == "risk" and got[2, 2, 2] == "risk"


def test_notice(spark):
    docs = spark.createDataFrame([(1, "접수 마감: 2026년 9월 10일(금) 18시까지\n시상 12월 5일(토)\n심사표\n| 창의성 | 60점 |\n| 완성도 | 40점 |")], "doc_id int, text string")
    got = notice.dates(docs, F.to_date(F.lit("2026-08-01"))).orderBy("line_no").collect()
    assert [(r.date, r.time, r.weekday_mismatch, r.kind) for r in got] == [(date(2026, 9, 10), "18:00", True, "submission_deadline"), (date(2026, 12, 5), None, False, "final_award")]
    assert notice.score_check(docs).first().near_hundred


def test_notice_dates_in_all_forms(spark):
    forms = {
        "2026년 8월 31일(월) 오후 6시": (date(2026, 8, 31), "18:00", "월", False),
        "2026. 8. 31.(월) 18:00": (date(2026, 8, 31), "18:00", "월", False),
        "26. 8. 3.": (date(2026, 8, 3), None, None, None),
        "2026-08-31 23:59": (date(2026, 8, 31), "23:59", None, None),
        "9/7(월)": (date(2026, 9, 7), None, "월", False),
        "8월 31일 자정": (date(2026, 8, 31), "24:00", None, None),
        "8. 31.(월)": (date(2026, 8, 31), None, "월", False),
        "2026.09.04(금) 17시": (date(2026, 9, 4), "17:00", "금", False),
        "8월31일": (date(2026, 8, 31), None, None, None),
        "2026. 8. 31.(화)": (date(2026, 8, 31), None, "화", True),
        "8. 31.(Mon)": (date(2026, 8, 31), None, "월", False),
        "2026-08-31 (Tuesday) 18:00": (date(2026, 8, 31), "18:00", "화", True),
    }
    none = ["3.5점", "10.5MB", "v1.2", "1. 2. 3.", "10.11.12.13"]
    docs = spark.createDataFrame(list(enumerate([*forms, *none])), "doc_id int, text string")
    got = {r.doc_id: (r.date, r.time, r.weekday_in_text, r.weekday_mismatch) for r in notice.dates(docs, F.to_date(F.lit("2026-08-01"))).collect()}
    assert got == dict(enumerate(forms.values()))


@pytest.mark.parametrize("start", ["2026-08-01", "2026-08-03", "2026-08-06"])
def test_business_days_by_counting(spark, start):
    holidays = ["2026-08-17", "2026-09-25", "2026-08-15"]
    d = spark.range(1, 60).select(F.date_add(F.to_date(F.lit(start)), F.col("id").cast("int")).alias("target"))
    from datetime import timedelta

    s = date.fromisoformat(start)
    for r in notice.days_left(d, F.to_date(F.lit(start)), holidays).collect():
        days = [s + timedelta(k) for k in range(1, r.dday + 1)]
        assert r.business_days == sum(x.weekday() < 5 and x.isoformat() not in holidays for x in days)


@pytest.mark.parametrize("counter,limit,tier,reason", gate.BRANCHES)
def test_gate_branches(spark, counter, limit, tier, reason):
    counts = spark.createDataFrame([(1, limit), (2, limit + 1)], f"doc_id long, {counter} long")
    got = {r.doc_id: (r.status, r.reason) for r in gate.gate(gate.combine(counts, counts)).collect()}
    assert got == {1: ("submittable", "all_checked"), 2: (tier, reason)}


def test_photos(spark):
    docs = spark.createDataFrame([(1, "[사진 2] 창고의 균열. 사진 5 참고.")], "doc_id int, text string")
    files = spark.createDataFrame([(1, 1, "창고.jpg", None), (1, 2, "b.jpg", None)], "doc_id int, photo_no int, file string, places array<string>")
    got = {r.photo_no: r.matched_file for r in photos.match_photos(photos.photo_claims(docs), files).collect()}
    assert got == {2: "창고.jpg", 5: None}
    d = spark.createDataFrame([("pipe", "corrosion", 0.84), ("pipe", "crack", 0.58), ("box", "cardboard", 0.47), ("low", "crack", 0.4)], "image string, label string, conf double")
    assert {r.image: r.severity for r in photos.inspect(d, photos.labels_table(spark)).collect()} == {"pipe": "risk", "box": "caution", "low": "none"}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("안녕".encode("cp949"))
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    (tmp_path / "c.html").write_text("<p>x &amp; y</p><table><tr><td>1</td><td>2</td></tr></table><script>no</script>")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p>")
    (tmp_path / "d.docx").write_bytes(data.getvalue())
    files = documents.binary_files(spark, str(tmp_path))
    assert {r.path[-5:]: r.skip for r in files.collect()}["b.bin"] == "binary"
    got = {r.path[-6:]: r.text for r in documents.file_texts(files).collect()}
    assert got["/a.txt"] == "안녕" and got["c.html"] == "x & y\n1 | 2" and got["d.docx"] == "one\ntwo"


def test_parse_responses_and_sinks(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"elements": [{"id": 1, "page": 2, "category": "paragraph", "content": {"text": "t"}, "coordinates": [{"x": 0.1, "y": 0.2}, {"x": 0.5, "y": 0.4}]}]}')
    r = documents.parse_responses(spark, str(tmp_path / "r.json")).first()
    assert (r.text, r.page, r.x, r.y) == ("t", 2, 0.1, 0.2) and r.w == pytest.approx(0.4)
    sinks.save_json(spark.range(3), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_streaming_timeline(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01 00:00:00.2", "crack", 0.9), ("2026-01-01 00:00:00.7", "paper", 0.8), ("2026-01-01 00:00:05", "helmet", 0.9), ("2026-01-01 00:01:00", "glass", 0.2), ("2026-01-01 00:02:00", "glass", 0.9)], "t string, label string, conf double").select(F.to_timestamp("t").alias("ts"), "label", "conf")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = timeline.risk_timeline(stream, photos.labels_table(spark)).writeStream.format("memory").queryName("timeline").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.severity, r.n) for r in spark.table("timeline").orderBy("second").collect()]
    assert got == [("risk", 2), ("reference", 1)]


def test_references_found_by_any_marker_they_answer_to(spark):
    claims = spark.createDataFrame([(1, "author_year", "Lee, 2001"), (1, "number", "2"), (1, "number", "7")], "doc_id int, marker_type string, marker_value string")
    refs = spark.createDataFrame([(1, 1, "Kim, A., Lee, B. (2001). Title."), (1, 2, "12. Park, C. (2002). Other."), (1, 3, "[2] Choi, D. (2003).")], "doc_id int, ref_id int, text string")
    got = {r.marker_value: r.ref_id for r in references.first_matching_reference(claims, refs).collect()}
    assert got == {"Lee, 2001": 1, "2": 2, "7": None}


def test_a_damaged_archive_is_an_error_of_its_row(spark):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w:p>hello</w:p>" * 50)
    whole = buffer.getvalue()
    broken = whole[:45] + bytes(b ^ 0x5A for b in whole[45:75]) + whole[75:]
    files = spark.createDataFrame([("a", whole, "docx", None), ("b", broken, "docx", None), ("c", b"no archive", "docx", None)], "path string, content binary, ext string, skip string")
    got = {r.path: r for r in documents.file_texts(files).collect()}
    assert got["a"].text.startswith("hello") and not got["a"].error
    assert got["b"].error and got["c"].error and got["b"].text is None


def test_long_chains_and_cycles_of_redirects(spark):
    edges = [(f"p{i}", f"p{i + 1}") for i in range(14)] + [("a", "b"), ("b", "a")]
    got = {r.url: (r.final_url, r.hops, r.state) for r in references.redirect_ends(spark.createDataFrame(edges, "from_url string, to_url string")).collect()}
    assert got["p4"] == ("p14", 10, "final") and got["p3"] == ("p13", 10, "too_long") and got["a"] == ("a", 2, "cycle") and len(got) == 16


def test_tools_check_their_parameters(spark):
    import pytest

    from attesta.operators import tools

    with pytest.raises(ValueError):
        tools.scan_pii(spark.range(1))
    with pytest.raises(ValueError):
        tools.search_articles(spark.range(1), " ")
    docs = spark.createDataFrame([(1, "mail a@b.kr"), (2, "nothing")], "doc_id long, text string")
    found, risk = tools.scan_pii(docs)
    assert [r.type for r in found.collect()] == ["email"] and {r.doc_id: r.risk for r in risk.collect()}[2] == "NONE"
    papers = spark.createDataFrame([("10.1/a", None, "Deep nets", 1), ("10.1/b", None, "Shallow nets", 2)], "doi string, url string, title string, ord int")
    assert [r.doi for r in tools.search_papers(papers, papers, "deep").collect()] == ["10.1/a"]
    items, axes = tools.check_subcontract(docs)
    assert items.count() == 36 and axes.count() == 10


def test_warnings_of_days_left_and_file_name_rules(spark):
    today, holidays = F.to_date(F.lit("2026-09-22")), ["2026-09-24", "2026-09-25", "2026-10-03"]
    targets = [("2026-09-20", None), ("2026-09-22", "18:00"), ("2026-09-25", "23:59"), ("2026-10-04", "자정"), (None, None)]
    t = spark.createDataFrame(targets, "day string, time string").withColumn("target", F.to_date("day"))
    got = {r.day: r.warnings for r in notice.deadline_warnings(notice.days_left(t, today, holidays), today, holidays, time="time").collect()}
    assert got["2026-09-20"] == ["past", "weekend"] and got["2026-09-22"] == ["soon"]
    assert got["2026-09-25"] == ["soon", "holiday:2026-09-24", "holiday:2026-09-25", "midnight"]
    assert got["2026-10-04"] == ["weekend", "holiday:2026-09-24", "holiday:2026-09-25", "holiday:2026-10-03", "midnight"]
    assert got[None] == []

    text = "파일명 규칙: 팀명_제목\n본문 안내\n제출은 pdf 형식\n파일명 예시 " + "가" * 130
    specs = {(r.line_no, r.spec, r.value) for r in notice.spec_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert specs == {(1, "file_name", "팀명_제목"), (3, "file_type", "pdf"), (4, "file_name", "가" * 120)}
