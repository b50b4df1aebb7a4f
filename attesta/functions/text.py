"""Text functions as column expressions; offsets count code points from 0."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: No word character before, none after: \b of Unicode-aware engines, also next to Hangul and accented letters.
LEFT, RIGHT = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"

#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = ("et al", "e.g", "i.e", "etc", "cf", "vs", "Fig", "fig", "Eq", "No", "vol", "Vol", "pp", "Dr", "Mr", "Ms", "Prof", "St")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once also where body uses it in lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def normalize_reference(s: Column) -> Column:
    """Lower case, no punctuation, single blanks; null becomes empty."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{M}\p{N}_\s]", ""))


def normalize_claim(s: Column) -> Column:
    """Lower case, quotes unified, brackets, ellipses and punctuation turned to blanks, single blanks."""
    unified = F.translate(F.lower(F.coalesce(s, F.lit(""))), "“”‘’「」『』《》〈〉…", "\"\"''         ")
    return squeeze(F.regexp_replace(unified, r"[^\p{L}\p{M}\p{N}_\s]", " "))


def split_ellipsis(s: Column) -> Column:
    return F.filter(F.transform(F.split(s, r"\.\.\.|…"), lambda x: F.trim(x)), lambda x: x != "")


def quote_exists(quote: Column, title: Column, abstract: Column, shortest: int = 15) -> Column:
    """Whether every part of the quote of `shortest` characters or more occurs in title and abstract; false without one."""
    meta = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(abstract, F.lit(""))))
    parts = F.transform(split_ellipsis(F.coalesce(quote, F.lit(""))), lambda p: F.lower(F.regexp_replace(p, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    long = F.filter(parts, lambda p: F.length(p) >= shortest)
    return (F.size(long) > 0) & F.forall(long, lambda p: F.contains(squeeze(meta), squeeze(p)))


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([round(difflib.SequenceMatcher(None, x, y).ratio(), 4) if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def title_similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of the normalised titles, 0.9 at least where over half of one begins the other."""
    x, y = normalize_reference(a), normalize_reference(b)

    def begins(p: Column, q: Column) -> Column:
        return (F.length(p) >= 5) & F.startswith(q, F.substring(p, F.lit(1), F.floor(F.length(p) / 2).cast("int") + 1))

    ratio = _ratio(x, y)
    return F.when((x == "") | (y == ""), 0.0).otherwise(F.when(begins(x, y) | begins(y, x), F.greatest(ratio, F.lit(0.9))).otherwise(ratio))


def author_match(a: Column, b: Column) -> Column:
    """True if either is unknown, or one contains the other after normalisation."""
    x, y = normalize_reference(a), normalize_reference(b)
    return a.isNull() | b.isNull() | F.contains(x, y) | F.contains(y, x)


def year_difference(a: Column, b: Column) -> Column:
    return F.abs(a.try_cast("int") - b.try_cast("int"))


def sentences(s: Column) -> Column:
    """Sentences of running text: a line end always ends one; a mark with a blank does unless an abbreviation precedes."""
    # Few places are looked at after their first character; split() compiles a pattern for each row, but not a single character.
    begin = "".join(sorted({a[0] for a in ABBREVIATIONS}))
    held = F.regexp_replace(F.coalesce(s, F.lit("")), rf"(?=[{begin}])(?<![\p{{L}}\p{{N}}])({'|'.join(a.replace('.', r'\.') for a in ABBREVIATIONS)})\.(?=\s)", "$1\u0002")
    cut = F.regexp_replace(held, r"([.!?。])[ \t]+(?=\S)", "$1\u0001")
    whole = F.replace(F.replace(cut, F.lit("\u0002"), F.lit(".")), F.lit("\n"), F.lit("\u0001"))
    return F.filter(F.transform(F.split(whole, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def checklist_sentences(s: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), r"[.?！；;:\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def photo_sentences(s: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), r"(?<=[．］』」)])\s+|(?<=[.!?])\s+|\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")


def number_markers(s: Column) -> Column:
    """The numbers cited as [n], in order."""
    return F.when(F.contains(s, F.lit("[")), F.regexp_extract_all(s, F.lit(r"\[(\d+)\]"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def author_year_markers(s: Column) -> Column:
    """'surname, year' of (Author, 2017), Author (2017) and Author et al. (2017), by the first surname."""
    inside = F.regexp_extract_all(s, F.lit(r"\(([A-Z가-힣][^()0-9]{0,39}?,?\s*\d{4})\)"), F.lit(1))
    before = F.regexp_extract_all(s, F.lit(r"([A-Z가-힣][\p{L}\-]+(?:\s+(?:et al\.?|and\s+[A-Z][\p{L}\-]+))?\s+\(\d{4}\))"), F.lit(1))
    return F.when(F.contains(s, F.lit("(")), F.transform(F.concat(inside, before), author_year_key)).otherwise(F.array().cast("array<string>"))


def author_year_key(s: Column) -> Column:
    return F.concat_ws(", ", F.regexp_extract(s, r"^\s*([\p{L}\-]+)", 1), F.regexp_extract(s, r"(\d{4})", 1))


#: Matches that are folded at a time: an array that grows by one costs the square of its length.
_FOLD = 256


def spans(column: str, pattern: str, group: int = 0, only: Column | None = None) -> Column:
    """Array of struct(start, end, value) of the matches of a pattern that never matches nothing, without Python.

    The text between matches (split) and the matches (extract all) alternate, so running lengths give the offsets: first
    within blocks of matches, then those of the blocks. Rows for which `only` isn't true have none and aren't searched.
    """
    p, kind = "r\"" + pattern + "\"", "array<struct<start:int,end:int,value:string>>"
    begin = "acc.at + length(get(x.gaps, i))"
    step = f"named_struct('at', {begin} + length(get(x.found, i)), 'out', array_append(acc.out, named_struct('start', {begin}, 'end', {begin} + length(get(x.found, i)), 'value', get(x.vals, i))))"
    block = f"aggregate(sequence(b, least(b + {_FOLD}, size(x.found)) - 1), named_struct('at', 0, 'out', cast(array() as {kind})), (acc, i) -> {step})"
    blocks = f"transform(sequence(0, size(x.found) - 1, {_FOLD}), b -> {block})"
    shifted = "transform(b.out, m -> named_struct('start', m.start + all.at, 'end', m.end + all.at, 'value', m.value))"
    whole = f"flatten(aggregate({blocks}, named_struct('at', 0, 'out', cast(array() as array<{kind}>)), (all, b) -> named_struct('at', all.at + b.at, 'out', array_append(all.out, {shifted})), all -> all.out))"
    parts = f"named_struct('gaps', split({column}, {p}, -1), 'found', regexp_extract_all({column}, {p}, 0), 'vals', regexp_extract_all({column}, {p}, {group}))"
    found = F.expr(f"{column} rlike {p}")
    return F.when(found if only is None else only & found, F.expr(f"element_at(transform(array({parts}), x -> {whole}), 1)")).otherwise(F.expr(f"cast(array() as {kind})"))
