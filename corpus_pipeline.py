"""From raw documents to token ids: five stages, each written and read again before the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept. All
but the last return the columns of ``documents``; the last returns one row a document with its ids.

Defined results: rows with a null or letterless text go in the first stage; nulls in other columns
stay; rows with one id are one document and stay or go together where documents are judged by id
(line dedup, near duplicates), otherwise each row by its text; rows without an id are never near
duplicates; an empty table gives no rows at any stage; columns besides those of ``documents`` are left
out; texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgrid.llm import decontaminate as decontamination
from epsgrid.llm import language, line_dedup, near_dup, pieces
from epsgrid.llm.common import crc_of_id, table
from epsgrid.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose positions favour no language this much on average is rejected.
LEAST_LANGUAGE_SCORE = 0.35
#: The network learns from these documents only.
TAUGHT_BY = (3, 1)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or of no learned language; the language found is kept.

    Where no row may teach (none has a language, or all that have one are held out) no language is
    learned: then only documents without a letter go, and ``lang`` stays as given.
    """
    known = docs.select("doc_id", "text", "lang")
    usable = ~F.coalesce(crc_of_id(F.col("doc_id")) % TAUGHT_BY[0] == TAUGHT_BY[1], F.lit(False))
    langs, params = language.fit(known, usable)
    if not langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language.identify(docs.select(*COLUMNS), langs, params)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; rows of which nothing but white space is left go."""
    kept = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return kept.where(F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id, with all rows that have it. Rows without an id stay."""
    dropped = near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose texts are contaminated by the benchmark; without items all stay."""
    found = decontamination.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row, and whether they decode to its text."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), results=("ids", "n_tokens", "ids_crc32", "n_differ", "round_trip"), keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", benchmark_stage),
    ("pieces", pieces_stage),
]

#: SQL cannot express a trained network; the pipeline is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
