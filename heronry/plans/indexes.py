"""The index of documents that the search queries share."""

from __future__ import annotations

from heronry.functions import text as T
from heronry.operators import index as I
from heronry.plans.base import table
from heronry.scratch import scratch_path
from heronry.sources.paths import fingerprint

_INDEXES: dict[tuple, str] = {}


def stored_index(spark, sf_dir: str) -> str:
    """The index of documents, written when it is first asked for and again when their files change."""
    mark = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, f"{sf_dir}/documents.parquet"))
    if mark not in _INDEXES:
        path = scratch_path(spark, "index")
        I.write_index(table(spark, sf_dir, "documents"), "doc_id", T.simple_tokens("text"), path, 16)
        _INDEXES[mark] = path
    return _INDEXES[mark]
