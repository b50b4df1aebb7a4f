"""Quality rules as a learned decision list, native DataFrame expressions throughout.

Statistics of the labelled texts are cut into bins at quantiles. Sequential covering then grows one rule at a time: the
threshold condition with the best gain is added until the rule covers no clean text or grows no better; conditions are
pruned from its end while that helps on a separate part of the labelled texts; the texts that the rule covers are set
aside and the next rule is grown on the rest. Every step is one aggregation of counts by statistic, bin and label; only
such counts, statistics times bins rows, reach the driver. The learned list is an ordered CASE expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import SPACE, cut, let, not_held_out, pick

BINS, RULES, CONDITIONS = 24, 8, 3
#: A rule has to be right this often, with a cautious estimate, on the part that grew it and on the pruning part.
PRECISION = 0.9
MIN_COVER = 4
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: Statistics a rule may test, by name; all are ratios, so that they behave alike for short and long texts.
RATIOS = {
    "symbol_ratio": "n_symbols / greatest(word_chars, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "mark_ratio": "n_marks / greatest(n_words, 1)",
    "digit_ratio": "n_digits / greatest(word_chars, 1)",
    "distinct_ratio": "n_distinct / sqrt(greatest(n_words, 1))",
    "bar_ratio": "n_bars / greatest(n_words, 1)",
}


def repeated_positions(w: Column, n: Column) -> Column:
    """How many of the n words w lie in a three-word window that occurs twice or more."""

    def counted(grams: Column) -> Column:
        # Sorted windows stand beside their equals; where each begins is sorted again to count the words they cover.
        same = lambda k: F.coalesce(F.get(grams, k)["g"] == F.get(grams, k + 1)["g"], F.lit(False))
        hit = F.filter(grams, lambda x, k: same(k) | ((k > 0) & same(k - 1)))
        at = F.array_sort(F.transform(hit, lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, x: F.struct((s["n"] + F.least(F.lit(3), x - s["last"])).alias("n"), x.alias("last")))["n"])

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
    return F.when(n >= 4, let(F.array_sort(windows), counted)).otherwise(0)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and counts of its text (null: an empty one)."""
    d = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("text")
    without = lambda kind: F.length(t) - F.length(F.regexp_replace(t, kind, ""))
    plain = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        return F.struct(n.alias("n"), F.size(F.array_distinct(w)).alias("n_distinct"), repeated_positions(w, n).alias("n_repeat_words"))

    counted = d.select(
        "doc_id",
        let(F.filter(F.split(t, SPACE, -1), lambda w: w != ""), of_words).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
        (F.length(t) - plain(" \t\n\x0b\f\r")).alias("word_chars"),
        plain("#*$%&|<>").alias("n_symbols"),
        without(r"\p{Lu}").alias("n_upper"),
        plain("!?").alias("n_marks"),
        plain("0123456789").alias("n_digits"),
        plain("|").alias("n_bars"),
    )
    whole = {"n_words": "w.n", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.dup", "n_repeat_words": "w.n_repeat_words"}
    rest = {"n_lines": "l.n", "n_distinct": "w.n_distinct", "n_upper": "n_upper", "n_marks": "n_marks", "n_digits": "n_digits", "n_bars": "n_bars"}
    return counted.select("doc_id", *(F.col(v).cast("long").alias(k) for k, v in (whole | rest).items()))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


#: A condition: statistic, 'ge' or 'lt', threshold.
Rule = list[tuple[str, str, float]]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for name, way, limit in rule:
        value = F.expr(RATIOS[name])
        out = out & (value >= limit if way == "ge" else value < limit)
    return out


def verdict(rules: list[Rule]) -> Column:
    """kept by the list: the first rule that holds rejects; without one the text is kept."""
    out = F
    for rule in rules:
        out = out.when(holds(rule), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def _counts(rows: DataFrame, names: list[str]) -> list[tuple[str, int, int, int]]:
    """(statistic, bin, bad, good), with counts by bin."""
    per = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"b_{n}").alias("bin")) for n in names))).alias("x")
    t = rows.select("bad", per).groupBy("x.name", "x.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
    return [(r["name"], r["bin"], int(r["p"]), int(r["n"])) for r in t.collect()]


def _best(counts: list, cuts: dict[str, list[float]]) -> tuple[tuple[str, str, float] | None, int, int]:
    """The condition of highest gain (bad texts kept, times how much purer they get)."""
    by: dict[str, dict[int, tuple[int, int]]] = {}
    for name, b, p, n in counts:
        by.setdefault(name, {})[b] = (p, n)
    best, best_gain, cover = None, 1e-9, (0, 0)
    for name in sorted(by):
        p_all, n_all = (sum(x[i] for x in by[name].values()) for i in (0, 1))
        if not p_all:
            return None, 0, 0
        p_low = n_low = 0
        for b, limit in enumerate(cuts[name]):
            p_low, n_low = p_low + by[name].get(b, (0, 0))[0], n_low + by[name].get(b, (0, 0))[1]
            for way, p, n in (("lt", p_low, n_low), ("ge", p_all - p_low, n_all - n_low)):
                if p >= MIN_COVER:
                    gain = p * (math.log2(p / (p + n)) - math.log2(p_all / (p_all + n_all)))
                    if gain > best_gain:
                        best, best_gain, cover = (name, way, limit), gain, (p, n)
    return best, *cover


def learn(stats: DataFrame, labels: DataFrame, rules: int = RULES, conditions: int = CONDITIONS, bins: int = BINS) -> list[Rule]:
    """The ordered rules, from stats (statistics()) and labels (doc_id, quality) of texts that are not held out.

    Texts without a label teach nothing; of several labels the lowest counts. Without bad or good labels: no rules.
    """
    marks = pick(labels, "doc_id", "quality").where("quality IS NOT NULL").where(not_held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.min("quality") == 0).cast("long").alias("bad"))
    values = stats.where(~base_failed()).join(marks, "doc_id").select("doc_id", "bad", *(F.expr(e).alias(n) for n, e in RATIOS.items()))
    values = cut(values.groupBy(*RATIOS, "bad").agg(F.min("doc_id").alias("doc_id")))  # copies count once
    names = list(RATIOS)
    marks_at = values.agg(*(F.percentile_approx(n, [i / bins for i in range(1, bins)], 10_000).alias(n) for n in names), *(F.percentile_approx(F.when(F.col("bad") == 1, F.col(n)), [i / 8 for i in range(1, 8)], 10_000).alias(f"bad_{n}") for n in names)).first()
    cuts = {n: sorted({*(marks_at[n] or []), *(marks_at[f"bad_{n}"] or [])}) for n in names}
    place = lambda n: sum((F.when(F.col(n) >= c, 1).otherwise(0) for c in cuts[n]), F.lit(0)).alias(f"b_{n}")
    part = F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0
    rows = cut(values.select("bad", part.alias("prune"), *names, *(place(n) for n in names)))
    tests = {n: F.col(n) for n in names}

    def within(rule: Rule) -> Column:
        out = F.lit(True)
        for n, way, limit in rule:
            out = out & (tests[n] >= limit if way == "ge" else tests[n] < limit)
        return out

    found: list[Rule] = []
    for _ in range(rules):
        rest = rows.where(~(F.lit(False) if not found else _any(within, found)))
        rule: Rule = []
        p = n = 0
        while len(rule) < conditions and (not rule or n):
            condition, p1, n1 = _best(_counts(rest.where("NOT prune").where(within(rule)), names), cuts)
            if condition is None:
                break
            rule, p, n = [*rule, condition], p1, n1
        if not rule:
            break
        # Pruning: the shortest beginning of the rule that does best on the other part.
        counts = rest.where("prune").agg(*(F.sum(F.when(within(rule[:k]), v).otherwise(0)).alias(f"{s}{k}") for k in range(1, len(rule) + 1) for s, v in (("p", F.col("bad")), ("n", 1 - F.col("bad"))))).first()
        worth = {k: ((counts[f"p{k}"] or 0) - (counts[f"n{k}"] or 0)) / max(1, (counts[f"p{k}"] or 0) + (counts[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)}
        k = min(worth, key=lambda k: (-worth[k], k))
        both = rest.where(within(rule[:k])).agg(F.sum("bad").alias("p"), F.count("*").alias("all")).first()
        if not both["p"] or (both["p"] + 1) / (both["all"] + 2) < PRECISION:
            break
        found.append(rule[:k])
    return found


def _any(within, rules: list[Rule]) -> Column:
    out = within(rules[0])
    for r in rules[1:]:
        out = out | within(r)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail. Repeated rows get equal results; ties between conditions go to the
    first statistic and lowest threshold. An empty table gives an empty one. Other columns are ignored.
    """
    stats = cut(statistics(docs))
    rules = learn(stats, labels)
    out = stats.withColumn("base_failed", base_failed())
    out = out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
