"""Results as files: JSON per document and Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def summary_lines(gated: DataFrame) -> DataFrame:
    """A line per document for people."""
    return gated.select("doc_id", F.format_string("document %d: %s (%s)", "doc_id", "status", "reason").alias("line"))


def reference_report(results: DataFrame) -> DataFrame:
    """doc_id, markdown: a table of the references and their status, in order."""
    row = F.format_string("| %d | %s | %s |", "ref_id", "status", F.coalesce("title", F.lit("-")))
    g = results.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ref_id", row.alias("line")))).alias("l"))
    return g.select("doc_id", F.concat_ws("\n", F.lit("| no | status | title |"), F.lit("|-|-|-|"), F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("markdown"))
