"""What several of the operators share."""

from __future__ import annotations

import ctypes
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch and of one batch of the parquet reader: both hold whole texts.
BATCH_ROWS = 500
_BATCHES = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` as it is; its session's batches have at most BATCH_ROWS rows from here on."""
    conf = df.sparkSession.conf
    for key in _BATCHES:
        if not 0 < int(conf.get(key)) <= BATCH_ROWS:
            conf.set(key, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read in small batches."""
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def names_for(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def field_of(df: DataFrame, name: str) -> T.StructField:
    """The field of a column; where a name comes twice, of the first."""
    return next(f for f in df.schema.fields if f.name == name)


#: Values of ``draw``, from 0.
DRAWS = 1 << 62


def draw(*parts: Column | str) -> Column:
    """A number in 0 .. DRAWS - 1 that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 2)


def draw_below(wanted: int, count: int) -> int:
    """A bound that about four times ``wanted`` of ``count`` different draws are below, and surely enough of them.

    Four times as many and forty more are expected; that fewer than ``wanted`` come has a chance
    below 1e-9 at any count. The least draws among them are then a sample of just so many rows.
    """
    many = 4 * wanted + 40
    return DRAWS if many >= count else DRAWS * many // count


def crc_of_id(doc_id: Column) -> Column:
    """Unsigned crc32 of an id written as text; it alone decides which rows are held out."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def release() -> None:
    """Gives a Python worker's freed memory back to the system at a task's end; workers live on between stages."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
