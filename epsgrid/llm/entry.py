"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from epsgrid.llm import decontaminate, html_text, language, licences, line_dedup, media, near_dup, pieces, quality, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1,
    "op2_pieces": pieces.op2,
    "op3_token_files": token_files.op3,
    "op4_html_text": html_text.op4,
    "op5_near_duplicates": near_dup.op5,
    "op6_licences": licences.op6,
    "op7_media_chunks": media.op7,
    "op8_language": language.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_line_dedup": line_dedup.op10,
}

SQL: dict[str, str] = {
    "op5_near_duplicates": near_dup.OP5_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
}
