"""Small relational operators between the large ones: lookups in snapshots, limits, histograms, verdicts in model text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, by: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first `most` rows of each group: three candidates a reference, twenty lines a section, sixty references."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


def status_histogram(df: DataFrame, column: str = "status") -> DataFrame:
    """How often each value occurs, whatever values there are."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def total_risk(axes: DataFrame) -> DataFrame:
    """axes: doc_id, risk_count of each axis. doc_id, total_risk."""
    return axes.groupBy("doc_id").agg(F.sum("risk_count").alias("total_risk"))


def critical_count(results: DataFrame, prefix: str = "critical") -> DataFrame:
    """doc_id, critical: its rows whose reason begins with the prefix."""
    return results.groupBy("doc_id").agg(F.count_if(F.coalesce(F.startswith("reason", F.lit(prefix)), F.lit(False))).alias("critical"))


def with_metadata(claims: DataFrame, references: DataFrame) -> DataFrame:
    """Claims (doc_id, ref_id) with title and abstract of their reference; null where there is none."""
    return claims.join(references.select("doc_id", "ref_id", "title", "abstract"), ["doc_id", "ref_id"], "left")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def photo_numbers(results: DataFrame, photos: DataFrame) -> DataFrame:
    """results: doc_id, path; photos: doc_id, photo_no, file. Adds photo_no by the path's last part."""
    own = photos.select("doc_id", F.col("file").alias("name"), "photo_no")
    return results.withColumn("name", base_name(F.col("path"))).join(own, ["doc_id", "name"], "left").drop("name")


def candidate_union(by_title: DataFrame, by_preprint: DataFrame, by_text: DataFrame) -> DataFrame:
    """Candidates (ref_id, ...) of both title searches; those of the search by text only for references without any."""
    both = by_title.unionByName(by_preprint)
    return both.unionByName(by_text.join(both.select("ref_id").distinct(), "ref_id", "left_anti"))


def all_detections(*domains: DataFrame) -> DataFrame:
    """The detections of several domains one after the other."""
    out = domains[0]
    for d in domains[1:]:
        out = out.unionByName(d)
    return out


def by_snapshots(keys: DataFrame, column: str, *snapshots: DataFrame) -> DataFrame:
    """Adds found (the rank of the first snapshot that has the key, else null) and value. snapshots: key, value.

    Registries that are asked one after the other, DOI handles and archived pages are all such lookups.
    """
    ranked = None
    for k, s in enumerate(snapshots):
        s = s.select("key", F.struct(F.lit(k + 1).alias("found"), F.col("value").cast("string").alias("value")).alias("hit"))
        ranked = s if ranked is None else ranked.unionByName(s)
    first = ranked.groupBy("key").agg(F.min("hit").alias("hit"))
    return keys.join(first, F.col(column) == F.col("key"), "left").select(*keys.columns, "hit.found", "hit.value")


def enabled(servers: DataFrame) -> DataFrame:
    """Servers (name, enabled) that are not switched off."""
    return servers.where(F.coalesce("enabled", F.lit(True)))


#: The verdicts as models name them.
VERDICTS = {"뒷받침함": "supported", "뒷받침 안 함": "not_supported", "판단 불가": "cannot_judge"}


def verdict_in(answer: Column) -> Column:
    """The verdict in a model's answer: that of the object in it that has one, else what its words say, else cannot_judge."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    stated = F.regexp_extract(F.coalesce(answer, F.lit("")), r'(?s)(\{[^}]*"verdict"[^}]*\})', 1)
    value = F.get_json_object(stated, "$.verdict")
    named, said = F, F
    for word, code in VERDICTS.items():
        named, said = named.when(value.isin(word, code), code), said.when(F.contains(low, F.lit(word)), code)
    said = said.when(low.rlike(r"not[ _]supported|unsupported|contradict"), "not_supported").when(low.rlike(r"cannot|can't|unclear"), "cannot_judge").when(F.contains(low, F.lit("supported")), "supported").otherwise("cannot_judge")
    return F.when(stated != "", F.coalesce(named.otherwise("cannot_judge"), F.lit("cannot_judge"))).otherwise(said)


def author_year_items(lines: DataFrame) -> DataFrame:
    """lines: doc_id, line_no, line. doc_id, item_no, item: a line 'Surname, I.' begins an item if the line before ends one."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    starts = F.col("line").rlike(r"^\s*(\p{Lu}[\p{L}\-]+,\s*\p{Lu}\.|[가-힣]{2,5}[,(])")
    before = F.lag(F.trim("line")).over(w)
    rows = lines.withColumn("new", (starts & (before.isNull() | before.rlike(r"[.)\]\d/]$"))).cast("int")).withColumn("item_no", F.sum("new").over(w)).where("item_no > 0")
    g = rows.groupBy("doc_id", "item_no").agg(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("line")))).alias("l"))
    return g.select("doc_id", "item_no", F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("item"))


def passport_form(value: Column) -> Column:
    """A letter and eight digits, or a letter, three digits, a letter and four digits."""
    return F.coalesce(value.rlike(r"^[A-Z](\d{8}|\d{3}[A-Z]\d{4})$"), F.lit(False))


def fax_or_landline(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(value, r"[ -]", "").rlike(r"^0(?!1)\d{8,10}$"), F.lit(False))
