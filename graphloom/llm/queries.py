"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.alignment import op13_token_alignment
from graphloom.llm.annsearch import op8_nearest_neighbours
from graphloom.llm.bloomlm import op7_lm_scoring
from graphloom.llm.chat import OP4_SQL, op4_chat_formatting
from graphloom.llm.jaccard import op11_ngram_jaccard_join
from graphloom.llm.langid import op1_language_id
from graphloom.llm.mixing import op6_mixing
from graphloom.llm.passages import op10_substring_dedup
from graphloom.llm.pieces import op5_sentencepiece
from graphloom.llm.simhash import op2_simhash_near_dedup
from graphloom.llm.sketch import op3_document_fingerprints
from graphloom.llm.toxicity import op9_toxicity
from graphloom.llm.whitening import op12_embedding_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_mixing": op6_mixing,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_ngram_jaccard_join": op11_ngram_jaccard_join,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {"op4_chat_formatting": OP4_SQL}
