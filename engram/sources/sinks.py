"""Output formats of the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_duplicate_csv(export: DataFrame, path: str) -> None:
    """Clean-up list as CSV: every cell quoted, line breaks become spaces, quotes are doubled."""
    columns = {
        "duplicate_memory_id": "duplicateMemoryId",
        "cluster_index": "clusterIndex",
        "canonical_preview": "canonicalPreview",
        "duplicate_preview": "duplicatePreview",
        "reason": "reason",
    }
    cells = [F.regexp_replace(F.col(c).cast("string"), r"\r?\n", " ").alias(name) for c, name in columns.items()]
    export.select(*cells).write.mode("overwrite").option("header", True).option("quoteAll", True).option(
        "escape", '"'
    ).csv(path)


def write_report_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line, ``documents`` being (owner_id, value)."""
    documents.select("value").write.mode("overwrite").text(path)
