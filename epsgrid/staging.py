"""Materialised intermediate tables.

Lineage is cut by writing parquet below the shared folder that the cluster names in
``spark.checkpoint.dir``, so a lost executor costs a re-read and never a recomputation of
everything above. Where that setting is absent a temporary folder is used, on a local master only:
elsewhere the executors would not see it.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_STAGED: list[str] = []
#: Names of the bucketed tables by their place.
_TABLES: dict[str, str] = {}
#: Shuffle files of a finished staging write are of no further use.
_STAGING_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

_CODEC = "spark.sql.parquet.compression.codec"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="epsgrid-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


@contextlib.contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def far_copies(spark: SparkSession) -> None:
    """Parquet that the session writes is zstd from now on, unless the session names a codec.

    For results whose rows repeat what stands more than 64 KB before them, which is as far as snappy,
    the default, looks back. It stays, since a result is written after its query has returned.
    """
    if spark.conf.get(_CODEC, None) is None:
        spark.conf.set(_CODEC, "zstd")


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted by ``clear``."""
    _STAGED.append(f"{shared_dir(spark)}/epsgrid-{label}-{uuid.uuid4().hex[:12]}")
    return _STAGED[-1]


def stage(df: DataFrame, label: str, compression: str = "zstd", conf: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = place(spark, label)
    with settings(spark, _STAGING_CONF | (conf or {})):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete every table staged so far; results that were not written yet can't be read any more."""
    while _STAGED:
        _delete(spark, _STAGED[-1])


def _delete(spark: SparkSession, path: str) -> None:
    if name := _TABLES.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _STAGED:
        _STAGED.remove(path)


def stage_bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """As ``stage``, in buckets of ``key``, so that a join on it does not move the table again."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"epsgrid_{label.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    with settings(spark, _STAGING_CONF):
        df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").option("compression", "uncompressed").saveAsTable(name)
    _STAGED.append(f"{shared_dir(spark)}/{name}")
    _TABLES[_STAGED[-1]] = name
    out = spark.table(name)
    out._staged_at = _STAGED[-1]
    return out
