"""Queries of the operators and of the pipeline, and the SQL twins of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from heronry.llm.decontamination import op9_decontamination
from heronry.llm.infilling import OP12_SQL, op12_fill_in_middle
from heronry.llm.jaccard_join import op8_ngram_jaccard_join
from heronry.llm.licences import op1_license_scans
from heronry.llm.line_dedup import op7_line_dedup
from heronry.llm.media import op2_media_columns
from heronry.llm.packing import op6_packing, packed_conversations
from heronry.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from heronry.llm.quality import op4_quality_classifier
from heronry.llm.substrings import OP13_SQL, op13_substring_dedup
from heronry.llm.token_counts import op5_token_counts
from heronry.llm.toxicity import op3_toxicity
from heronry.llm.warc_audit import OP10_SQL, op10_warc_audit

QUERIES = {
    "op1_license_scans": op1_license_scans,
    "op2_media_columns": op2_media_columns,
    "op3_toxicity": op3_toxicity,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_counts": op5_token_counts,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_decontamination": op9_decontamination,
    "op10_warc_audit": op10_warc_audit,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_substring_dedup": op13_substring_dedup,
    "packed_conversations": packed_conversations,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {"op10_warc_audit": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_substring_dedup": OP13_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
