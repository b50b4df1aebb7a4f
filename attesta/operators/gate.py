"""The document gate: one ordered decision over the counts of all sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In this order: counter, how many are still fine, tier, reason.
BRANCHES = [
    ("law_missing_article", 0, "needs_revision", "law_missing_article"),
    ("photo_not_supported", 0, "needs_revision", "photo_not_supported"),
    ("checklist_risk", 0, "needs_revision", "checklist_risk"),
    ("unverified", 0, "needs_revision", "unverified"),
    ("misquoted", 0, "needs_revision", "misquoted"),
    ("photo_critical", 0, "needs_check", "photo_critical"),
    ("photo_unmatched", 0, "needs_check", "photo_unmatched"),
    ("photo_cannot_judge", 3, "needs_check", "photo_cannot_judge"),
    ("law_not_held", 0, "needs_check", "law_not_held"),
    ("cannot_judge", 3, "needs_check", "cannot_judge"),
]
COUNTERS = [b[0] for b in BRANCHES]
EXIT_CODES = {"submittable": 0, "needs_revision": 1, "needs_check": 2}


def combine(documents: DataFrame, *sections: DataFrame) -> DataFrame:
    """documents: doc_id. Sections: doc_id and counters. Absent counters are 0."""
    out = reduce(lambda a, b: a.join(b, "doc_id", "left"), sections, documents.select("doc_id"))
    return out.select("doc_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if c in out.columns else F.lit(0).cast("long").alias(c) for c in COUNTERS))


def gate(counts: DataFrame, no_input: str | None = None) -> DataFrame:
    """Adds status, reason and exit_code; the first counter beyond its limit decides. no_input: a boolean column of documents that could not be read."""
    status, reason = (F.when(F.col(no_input), v) for v in ("needs_check", "no_input")) if no_input else (F, F)
    for counter, limit, tier, why in BRANCHES:
        status, reason = status.when(F.col(counter) > limit, tier), reason.when(F.col(counter) > limit, why)
    out = counts.withColumns({"status": status.otherwise("submittable"), "reason": reason.otherwise("all_checked")})
    return out.withColumn("exit_code", F.element_at(F.create_map(*(F.lit(x) for kv in EXIT_CODES.items() for x in kv)), F.col("status")))
