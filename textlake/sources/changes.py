"""Change tables: the commit-history input of the commit-message pipeline, as rows.

Running git is not part of this library; a change table ``(repo, seq, path, patch, message)`` holds one staged
change per row (``seq`` orders history, higher is newer). :func:`changes_from_documents` derives one from the
document table for tests and benchmarks: each document is one change of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import first_line
from .tables import document_path


def changes_from_documents(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("source").alias("repo"),
        F.col("doc_id").alias("seq"),
        document_path().alias("path"),
        F.col("text").alias("patch"),
        first_line("text").alias("message"),
    )


def require_changes(changes: DataFrame) -> DataFrame:
    """The original tool stops when nothing is staged; a plan over an empty change table is an error."""
    if changes.isEmpty():
        raise ValueError("the change table has no rows")
    return changes
