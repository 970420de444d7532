"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of frequent pre-tokens and their ids, of a fixed maximal size; tier two is a cache in each Python
worker, filled by encoding what the table lacks. Texts are never shuffled, nor are pre-tokens.

Null text counts as empty (0 bytes, 0 tokens); null doc_id stays null; repeated rows give repeated rows; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from heronry.llm.common import id_and_text, lean, small_batches, table
from heronry.llm.pretokens import frequent_chunks, tokenizer_path, worker_cache

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per row of docs: UTF-8 bytes, tokens by the library for `path`, and whether they exceed `limit`."""
    small_batches(docs.sparkSession)
    docs = id_and_text(docs)
    frequent = frequent_chunks(docs, path)

    def count(batches):
        cache = worker_cache(path, frequent)
        for batch in batches:
            texts = batch.column("text")
            n_bytes, n_tokens = [], []
            for value in texts:
                text = value.as_py()
                n_bytes.append(value.as_buffer().size)
                n_tokens.append(cache.count(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.mapInArrow(lean(count), SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
