"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import embedding_join, language_id, line_dedup, maxent, mpeg_audio, packing, personal_data, shingle_join, token_counts, word_bpe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_join": embedding_join.query,
    "op2_word_bpe": word_bpe.query,
    "op3_maxent": maxent.query,
    "op4_personal_data": personal_data.query,
    "op5_language_id": language_id.query,
    "op6_packing": packing.query,
    "op7_mpeg_audio": mpeg_audio.query,
    "op8_token_counts": token_counts.query,
    "op9_shingle_join": shingle_join.query,
    "op10_line_dedup": line_dedup.query,
    # columns of op3 and op4 that SQL can express
    "language_model_base": maxent.base_query,
    "personal_data_base": personal_data.base_query,
}

ORACLE: dict[str, str] = {
    "op1_embedding_join": embedding_join.ORACLE,
    "op9_shingle_join": shingle_join.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "language_model_base": maxent.BASE_ORACLE,
    "personal_data_base": personal_data.BASE_ORACLE,
}
