"""Sensitive data: findings per line, overlap suppression, masked copies, summaries and risk.

Rules are rows of a table below. Each gives a pattern that Spark searches natively with offsets; candidates that pass
their rule's check compete line by line, where a rule of higher priority, then an earlier start, wins overlapping spans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions import validators as V
from attesta.functions.text import LEFT, RIGHT, let, spans

#: Words that have to stand on a line for its rule to apply.
CONTEXT = {
    "account": ["계좌", "은행", "예금주", "입금", "송금", "통장", "계좌번호"],
    "passport": ["여권", "passport", "여권번호", "여권 발급", "passport no"],
    "student_id": ["학번", "사번", "사원번호", "수험번호", "직원번호", "학생번호"],
    "birth": ["생년월일", "생일", "출생", "태어남", "출생일"],
    "name": ["이름", "성명", "담당자", "참석자", "예금주", "문의", "작성자", "발언자", "발표자", "보고자", "님", "씨", "과장", "대리", "팀장", "대표", "교수", "선생님"],
    "address": ["주소", "거주", "주소지", "자택", "거주지", "현주소", "본적", "소재지"],
    "card": ["카드", "credit", "card", "결제", "pay", "카드번호"],
}
RANK = {"info": 1, "low": 2, "medium": 3, "high": 4}
#: Types that alone make a document a high risk.
HIGH_RISK = ["resident_number", "credit_card", "license", "openai_api_key", "aws_access_key", "github_token", "google_api_key", "slack_token", "jwt", "private_key", "connection_string"]


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    priority: int
    confidence: str
    check: Callable[[Column], Column] | None = None
    context: str | None = None
    bounded: bool = True
    #: Each match holds one of these; a line without any needs no search.
    needs: tuple[str, ...] = ()

    @property
    def search(self) -> str:
        return f"{LEFT}{self.pattern}{RIGHT}" if self.bounded else self.pattern


#: What each type looks like.
RULES = [
    Rule("openai_api_key", r"sk-[A-Za-z0-9]{20,}", 1, "high", needs=("sk-",)),
    Rule("aws_access_key", r"(?:AKIA|ASIA)[A-Za-z0-9]{16,}", 1, "high", needs=("AKIA", "ASIA")),
    Rule("github_token", r"gh[pousr]_[A-Za-z0-9]{30,}", 1, "high", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("google_api_key", r"AIza[A-Za-z0-9_-]{35,}", 1, "high", needs=("AIza",)),
    Rule("slack_token", r"xox[baprs]-[A-Za-z0-9-]{10,}", 1, "high", needs=("xox",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 1, "high", needs=("eyJ",)),
    Rule("private_key", r"-----BEGIN\s+(?:RSA|EC|DSA|OPENSSH|ENCRYPTED|PKCS8|PEM)?\s*PRIVATE\s+KEY-----", 1, "high", bounded=False, needs=("-----BEGIN",)),
    Rule("connection_string", r"[A-Za-z]+://[^@\s]+:[^@\s]+@[A-Za-z0-9._-]+(?::\d+)?(?:/\S*)?", 1, "high", needs=("://",)),
    Rule("bearer_token", r"Bearer\s+[A-Za-z0-9._~+/-]+", 1, "medium", lambda v: F.length(v) > 20, needs=("Bearer",)),
    Rule("generic_secret", r"(?i:api[_ ]?key|secret|token|password|passwd|pwd|auth)[=:]\s*[A-Za-z0-9_.!@#$%^&*+=-]{8,}", 1, "medium", bounded=False, needs=("=", ":")),
    Rule("resident_number", r"\d{6}-\d{7}", 2, "high", lambda v: V.resident_status(v) != "invalid-date", needs=("-",)),
    Rule("credit_card", r"\d{4}[\s-]?\d{4,6}[\s-]?\d{4,7}[\s-]?\d+", 2, "high", V.luhn),
    Rule("business_number", r"\d{3}-\d{2}-\d{5}", 2, "high", V.business_valid, needs=("-",)),
    Rule("license", r"\d{2}-\d{2}-\d{6}-\d{2}", 2, "high", needs=("-",)),
    Rule("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 3, "high", needs=("@",)),
    Rule("mobile_phone", r"01[0-9]-\d{3,4}-\d{4}", 4, "high", needs=("-",)),
    Rule("landline_phone", r"(?!01)\d{2,3}-\d{3,4}-\d{4}", 4, "high", needs=("-",)),
    Rule("toll_free", r"15\d{2}-\d{4}", 4, "medium", needs=("-",)),
    Rule("ipv4", r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", 5, "info", V.ip_valid),
    Rule("account_number", r"\d{3,5}-\d{2,6}-\d{2,6}", 6, "medium", context="account", needs=("-",)),
    Rule("passport_new", r"[A-Z]\d{3}[A-Z0-9]\d{4}", 6, "medium", context="passport"),
    Rule("student_id", r"\d{5,10}", 6, "medium", context="student_id"),
    Rule("birth_date", r"\d{4}[-/]\d{2}[-/]\d{2}", 6, "medium", lambda v: V.valid_date(F.left(v, F.lit(4)).cast("int"), F.substring(v, 6, 2).cast("int"), F.right(v, F.lit(2)).cast("int")), context="birth", needs=("-", "/")),
    Rule("name", r"[가-힣]{2,4}", 6, "low", context="name"),
    Rule("address", r"[가-힣]+(?:시|도)?\s*[가-힣]+구\s*[가-힣]+(?:로|길)\s*\d+|[가-힣]+(?:시|도)\s*[가-힣]+(?:로|길)\s*\d+", 6, "medium", context="address"),
    Rule("vehicle_plate", r"\d{2}[가-힣]\d{4}", 6, "medium"),
]


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", header: Column | None = None) -> DataFrame:
    """doc_id, line_no (from 1), line; a null text has none. With header, a condition on docs: also header, the cells of the
    first line of documents for which it holds, else null."""
    text = F.regexp_replace(F.col(text_col), r"\r\n?|[\x0B\x0C\x85  ]", "\n")
    cells = [] if header is None else [F.when(header, _cells(F.element_at(F.split(text, "\n", 2), 1))).alias("header")]
    l = docs.select(F.col(id_col).alias("doc_id"), *cells, F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    return l.select("doc_id", (F.col("i") + 1).alias("line_no"), "line", *(["header"] if cells else []))


def _cells(line: Column) -> Column:
    """The cells of a line of comma-separated values, commas between quotes kept."""
    return F.split(line, r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", -1)


def _column(line: Column, at: Column) -> Column:
    """The number, from 0, of the cell that begins at or before an offset: the commas before it that stand in no quotes."""
    before = F.regexp_replace(F.substring(line, F.lit(1), at), r'\"[^\"]*(\"|$)', "")
    return F.length(before) - F.length(F.replace(before, F.lit(","), F.lit("")))


def _any_word(line: Column, words: list[str]) -> Column:
    return F.lower(line).rlike("|".join(w.lower() for w in words))


#: A character or a beginning that every rule's match has; most lines have none, and no rule needs to look at them.
_SIGNS, _STARTS = "[0-9@=:가-힣]", ("sk-", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AIza", "xox", "eyJ", "-----BEGIN", "Bearer")


def _may_match(rule: Rule, header: bool) -> Column:
    """A cheap test that each line with a match of the rule passes."""
    tests = [reduce(or_, (F.contains("line", F.lit(n)) for n in rule.needs))] if rule.needs else []
    if rule.context:
        words = CONTEXT[rule.context]
        above = F.exists("header", lambda h: _any_word(h, words)) if header else F.lit(False)
        tests.append(_any_word(F.col("line"), words) | F.coalesce(above, F.lit(False)))
    return reduce(and_, tests, F.lit(True))


def _candidates(rule: Rule, header: bool = False) -> Column:
    line = F.col("line")
    confidence = F.lit(RANK[rule.confidence])

    def ranked(v: Column) -> Column:
        if rule.kind == "credit_card":
            return F.when((F.length(V.digits(v)) < 15) & ~_any_word(line, CONTEXT["card"]), RANK["medium"]).otherwise(confidence)
        if rule.kind == "resident_number":
            return F.when(V.resident_status(v) == "form-only", RANK["medium"]).otherwise(confidence)
        return confidence

    found = spans("line", rule.search, only=_may_match(rule, header))
    if rule.check:
        found = F.filter(found, lambda x: rule.check(x["value"]))
    if rule.context and header:  # of the words above, those of the value's own column count
        words = CONTEXT[rule.context]
        here = _any_word(line, words)
        found = F.filter(found, lambda x: here | F.coalesce(_any_word(F.get("header", _column(line, x["start"])), words), F.lit(False)))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rule.kind).alias("type"), x["value"].alias("value"), ranked(x["value"]).alias("rank")))


def _points(kept: Column) -> Column:
    """A byte for each point of a line up to the last kept span: 1 where a span lies, its end included."""
    before = lambda i: F.coalesce(F.get(kept, i - 1)["end"] + 1, F.lit(0))
    runs = F.transform(kept, lambda x, i: F.concat(F.repeat(F.lit("0"), x["start"] - before(i)), F.repeat(F.lit("1"), x["end"] - x["start"] + 1)))
    return F.array_join(runs, "").cast("binary")


def _apart(spans_: Column) -> Column:
    """Of spans in order, those that don't touch the one kept before: of each chain of touching ones every other."""

    def others(s: Column, chained: Column) -> Column:
        marks = F.split(F.regexp_replace(F.regexp_replace(F.array_join(chained, ""), "tt", "dk"), "t", "d"), "")
        return let(marks, lambda m: F.filter(s, lambda x, i: F.get(m, i) != "d"))

    chain = lambda s: F.transform(s, lambda x, i: F.when(x["start"] <= F.get(s, i - 1)["end"], "t").otherwise("s"))
    return let(spans_, lambda s: let(chain(s), lambda c: F.when(F.array_contains(c, "t"), others(s, c)).otherwise(s)))


def keep_without_overlap(candidates: list[Column]) -> Column:
    """Greedy by the order of the rules, each an array of spans (start, end, ...) in order that don't overlap each other: a
    span that overlaps or touches a kept one goes. Kept spans in order of their starts.

    Each rule looks at the points that are taken so far, so that a line costs its length and its spans once for each rule
    that has any, however many there are.
    """
    found = F.filter(F.array(*candidates), lambda c: F.size(c) > 0)

    def add(state: Column, spans_: Column) -> Column:
        free = F.filter(spans_, lambda x: ~F.contains(F.substring(state["points"], x["start"] + 1, x["end"] - x["start"] + 1), F.lit(b"1")))
        return let(F.array_sort(F.concat(state["kept"], _apart(free))), lambda k: F.struct(k.alias("kept"), _points(k).alias("points")))

    none = F.slice(candidates[0], 1, 0)
    greedy = F.aggregate(found, F.struct(none.alias("kept"), F.lit(b"").alias("points")), add, lambda s: s["kept"])
    return let(found, lambda f: F.when(F.aggregate(f, F.lit(0), lambda n, c: n + F.size(c)) <= 1, F.flatten(f)).otherwise(greedy))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES, min_confidence: str = "info", names: bool = True, header: Column | None = None) -> DataFrame:
    """Findings: doc_id, type, line, col, start, end, matched, confidence, rank, masked, value. No shuffle.

    header: a condition on docs that holds for comma-separated values with a header; there a value's context may also stand
    in its column's head.
    """
    use = [r for r in rules if names or r.kind != "name"]
    hit = F.col("line").rlike(_SIGNS) | reduce(or_, (F.contains("line", F.lit(s)) for s in _STARTS))
    kept = keep_without_overlap([_candidates(r, header is not None) for r in sorted(use, key=lambda r: r.priority)])
    # explode() would have Spark search a line twice, first for the number of its findings.
    f = lines(docs, id_col, text_col, header).where(hit).select("doc_id", "line_no", F.explode_outer(kept).alias("f")).where("f IS NOT NULL")
    level = F.element_at(F.create_map(*(F.lit(x) for k, v in RANK.items() for x in (v, k))), F.col("f.rank"))
    out = f.select("doc_id", F.col("f.type").alias("type"), F.col("line_no").alias("line"), (F.col("f.start") + 1).alias("col"), F.col("f.start").alias("start"), F.col("f.end").alias("end"), F.length("f.value").alias("matched"), level.alias("confidence"), F.col("f.rank").alias("rank"), V.mask(F.col("f.type"), F.col("f.value")).alias("masked"), F.col("f.value").alias("value"))
    return out.where(F.col("rank") >= RANK[min_confidence])


def document_risk(findings: DataFrame) -> DataFrame:
    """doc_id, n_findings, risk: HIGH, MEDIUM or LOW; documents without findings are absent (NONE)."""
    high = F.col("rank") == RANK["high"]
    some = findings.groupBy("doc_id").agg(F.count("*").alias("n_findings"), F.bool_or(high & F.col("type").isin(HIGH_RISK)).alias("unique"), F.bool_or(F.col("rank") >= RANK["medium"]).alias("other"))
    return some.select("doc_id", "n_findings", F.when(F.col("unique"), "HIGH").when(F.col("other"), "MEDIUM").otherwise("LOW").alias("risk"))


def type_summary(findings: DataFrame) -> DataFrame:
    """Per type: findings, documents, the highest confidence and the first masked example that has it."""
    first = F.struct("rank", (-F.col("doc_id")).alias("d"), (-F.col("line")).alias("l"), (-F.col("start")).alias("s"))
    return findings.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.max("rank").alias("max_rank"), F.max_by("masked", first).alias("example"))


def top_findings(findings: DataFrame, k: int = 40) -> DataFrame:
    return findings.orderBy(F.desc("rank"), "doc_id", "line", "start").limit(k)


def masked_copies(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, masked_text of documents with findings: each line is put together from what lies between its spans and their masks."""
    per = findings.groupBy("doc_id", "line").agg(F.array_sort(F.collect_list(F.struct("start", "end", "masked"))).alias("f"))
    end = lambda i: F.coalesce(F.get("f", i - 1)["end"], F.lit(0))
    pieces = F.transform("f", lambda x, i: F.concat(F.substring("line", end(i) + 1, x["start"] - end(i)), x["masked"]))
    spliced = F.concat(F.array_join(pieces, ""), F.substring("line", F.element_at("f", -1)["end"] + 1, F.length("line")))
    hit = findings.select(F.col("doc_id").alias("hit_id")).distinct()
    some = lines(docs.select(id_col, text_col).join(hit, F.col(id_col) == F.col("hit_id"), "left_semi"), id_col, text_col)
    out = some.join(per.withColumnRenamed("line", "line_no"), ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.coalesce(spliced, F.col("line")).alias("line"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return out.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("masked_text"))


def report_lines(findings: DataFrame) -> DataFrame:
    """Markdown of the report: one row, a table of types by count and the top findings."""
    t = type_summary(findings).select(F.struct(F.lit(1).alias("part"), (-F.col("n")).alias("o"), F.col("type").alias("k"), F.format_string("| %s | %d | %d | %s |", "type", "n", "n_docs", "example").alias("line")).alias("x"))
    ranked = top_findings(findings).withColumn("o", F.row_number().over(Window.orderBy(F.desc("rank"), "doc_id", "line", "start")))
    d = ranked.select(F.struct(F.lit(2).alias("part"), F.col("o").cast("long").alias("o"), F.col("type").alias("k"), F.format_string("- %s, document %d, line %d: %s", "type", "doc_id", "line", "masked").alias("line")).alias("x"))
    body = t.unionByName(d).agg(F.array_sort(F.collect_list("x")).alias("x"))  # bounded: types and top findings
    return body.select(F.concat_ws("\n", F.lit("| type | findings | documents | example |"), F.lit("|-|-|-|-|"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("markdown"))
