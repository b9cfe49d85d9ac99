"""The queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from twinframe.llm.language import op8_language
from twinframe.llm.licenses import OP3_SQL, op3_licenses
from twinframe.llm.media import op9_media
from twinframe.llm.mixing import OP10_SQL, op10_mixing
from twinframe.llm.neighbours import OP4_SQL, op4_block_knn
from twinframe.llm.pieces import op7_sentencepiece
from twinframe.llm.sharding import op5_virtual_slots
from twinframe.llm.simhash import op6_simhash
from twinframe.llm.tokens import op1_token_counts
from twinframe.llm.toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_toxicity": op2_toxicity,
    "op3_licenses": op3_licenses,
    "op4_block_knn": op4_block_knn,
    "op5_virtual_slots": op5_virtual_slots,
    "op6_simhash": op6_simhash,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_language": op8_language,
    "op9_media": op9_media,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {"op3_licenses": OP3_SQL, "op4_block_knn": OP4_SQL, "op10_mixing": OP10_SQL}
