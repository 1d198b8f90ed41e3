"""Line dedup over a sharded minimal perfect hash.

1. Rows are dealt at random to groups that are bounded in rows and in bytes on average, and written
   with their group, so that equal rows are dealt apart. Every row gives its distinct long line keys.
2. Distinct documents and the largest one are counted for each key: a document counts once however
   many rows and groups it is in, and a line that a third of all documents share is summed up within
   tasks before it is shuffled.
3. The distinct keys, both halves of their 128-bit hashes, are dealt to shards. A shard is one row: a
   minimal perfect hash (levels of bit arrays with ranks, Limasset et al. 2017) and arrays of
   fingerprints, counts and largest documents in its order.
4. The groups' requests probe their shard's arrays; only keys found in ``min_docs`` documents
   answer. Each group of documents then drops its lines by the answers to that group.

Defined results: null or empty text is one empty line; a text whose lines all go becomes empty;
rows with one document id are one document, of which all rows keep what the largest id keeps; rows
without an id are one document too, smaller than any other; an empty table gives no rows. Columns
besides the id and the text pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgrid.llm.common import release, small_batches, table
from epsgrid.staging import stage, unstage

MIN_DOCS = 3
MIN_CHARS = 20
#: Rows and bytes of text of a group, on average, and bytes of text of a task that puts texts together.
GROUP_DOCS, GROUP_BYTES, TASK_BYTES = 1000, 4 << 20, 32 << 20
SHARD_KEYS = 50_000
#: Requests that one task holds.
PROBE_ROWS = 1_000_000
_BLANK = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
_NONE = -(1 << 63)


def line_key(line: str) -> str:
    return line.strip(_BLANK).translate(_LOWER)


def _key_hashes(text: str, min_chars: int) -> list[tuple[int, int] | None]:
    """For each line the two halves of its key's 128-bit hash, None for short keys."""
    out: list[tuple[int, int] | None] = []
    for line in text.split("\n"):
        key = line.strip(_BLANK)
        if len(key) < min_chars:
            out.append(None)
        else:
            h = xxhash.xxh3_128_intdigest(key.translate(_LOWER).encode("utf-8", "surrogatepass"))
            out.append((h & 0x7FFFFFFFFFFFFFFF, h >> 64 & 0x7FFFFFFFFFFFFFFF))
    return out


def requests(rows: DataFrame, min_chars: int) -> DataFrame:
    """``(g, h, f, doc)``: distinct keys of each row of ``(g, doc, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(g, *k, doc) for g, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in _key_hashes(text or "", min_chars) if k}
            keys = np.array(list(found), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in keys.T], ["g", "h", "f", "doc"])
        release()

    return rows.mapInArrow(run, "g long, h long, f long, doc long")


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Slots of keys, rows of two numbers, on a level."""
    x = keys[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31)) ^ keys[:, 1].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray, gamma: float = 1.6) -> tuple[list[int], bytes]:
    """Level sizes and bits of a minimal perfect hash of distinct keys."""
    sizes, bits, level = [], [], 0
    left = keys
    while len(left):
        size = max(64, int(gamma * len(left)))
        slot = _level(left, level, size)
        count = np.bincount(slot, minlength=size)
        bits.append(count == 1)
        sizes.append(size)
        left = left[count[slot] != 1]
        level += 1
        if level > 200:
            raise ValueError("keys are not distinct")
    return sizes, np.packbits(np.concatenate(bits)).tobytes() if bits else b""


class PerfectHash:
    """Index of each key (h, f) of the set in 0..n-1; some index or -1 for other keys."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes = [int(x) for x in sizes]
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)[: sum(self.sizes)]
        self.rank = np.cumsum(self.bits) - self.bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = base + _level(keys[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        return out


INDEX_SCHEMA = "s long, sizes array<bigint>, bits binary, fingerprints binary, counts binary, lasts binary"


def build_index(keys: DataFrame, shards: int) -> DataFrame:
    """One row a shard over ``keys(h, f, n, last)``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf[["h", "f"]].to_numpy(np.int64)
        sizes, bits = build_hash(keys)
        at = np.argsort(PerfectHash(sizes, bits)(keys))
        pick = lambda c, t: pdf[c].to_numpy(t)[at].tobytes()
        return pd.DataFrame([{"s": pdf["s"].iloc[0], "sizes": sizes, "bits": bits, "fingerprints": pick("f", np.int64), "counts": pick("n", np.int64), "lasts": pick("last", np.int64)}])

    return keys.select(_shard(shards), "h", "f", "n", "last").groupBy("s").applyInPandas(run, INDEX_SCHEMA)


def _shard(shards: int):
    return F.pmod(F.col("h"), F.lit(shards)).alias("s")


def probe(asked: DataFrame, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """``(g, h, f, last)`` of the requests whose key is in at least ``min_docs`` documents."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("g", "h", "f", "last")})
        row = right.iloc[0]
        counts, lasts, prints = (np.frombuffer(row[c], np.int64) for c in ("counts", "lasts", "fingerprints"))
        at = PerfectHash(row["sizes"], row["bits"])(left[["h", "f"]].to_numpy(np.int64))
        hit = (at >= 0) & (prints[at] == left["f"].to_numpy(np.int64)) & (counts[at] >= min_docs)
        return left.loc[hit, ["g", "h", "f"]].assign(last=lasts[at[hit]])

    asked = asked.select(_shard(shards), "g", "h", "f")
    # a line that is in most groups makes its shard's requests many: such shards are probed in parts
    many = stage(asked.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > PROBE_ROWS).select("s", F.ceil(F.col("n") / PROBE_ROWS).cast("long").alias("parts")), "line-many")
    left = asked.join(many, "s", "left").select("s", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("g"), F.col("parts"))).cast("long").alias("part"), "g", "h", "f")
    right = index.join(many, "s", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.groupBy("s", "part").cogroup(right.groupBy("s", "part")).applyInPandas(run, "g long, h long, f long, last long")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the text that stays, and ``n_lines`` and ``n_dropped``."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
    size = packed.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = 1 + max(size["rows"] // GROUP_DOCS, size["bytes"] // GROUP_BYTES)
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).alias("g")
    rows = stage(packed.select(dealt, F.struct("doc_id", "rest").alias("row"), F.coalesce("doc_id", F.lit(_NONE)).alias("doc"), "text"), "line-rows")
    found = stage(requests(rows.select("g", "doc", "text"), min_chars), "line-found")
    keys = stage(found.groupBy("h", "f").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("last")), "line-keys")
    shards = 1 + keys.count() // SHARD_KEYS
    index = stage(build_index(keys, shards), "line-index")
    asked = stage(found.select("g", "h", "f").distinct(), "line-requests")
    answers = stage(probe(asked, index, shards, min_docs), "line-answers")
    unstage(found, keys, index, asked)

    def keep(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        last = {(h, f): x for h, f, x in zip(right["h"].tolist(), right["f"].tolist(), right["last"].tolist(), strict=True)}
        texts, n, gone = [], [], []
        for doc, text in zip(left["doc"].tolist(), left["text"].tolist(), strict=True):
            lines = (text or "").split("\n")
            kept = [x for x, k in zip(lines, _key_hashes(text or "", min_chars), strict=True) if k is None or last.get(k, doc) == doc] if last else lines
            texts.append("\n".join(kept))
            n.append(len(lines))
            gone.append(len(lines) - len(kept))
        return pd.DataFrame({"row": left["row"], "text": texts, "n_lines": n, "n_dropped": gone})

    kind = rows.schema["row"].dataType.simpleString()
    # so many tasks that each reads about TASK_BYTES of text, whatever the session's number of partitions
    tasks = 1 + size["bytes"] // TASK_BYTES
    out = rows.repartition(tasks, "g").groupBy("g").cogroup(answers.repartition(tasks, "g").groupBy("g")).applyInPandas(keep, f"row {kind}, text string, n_lines long, n_dropped long")
    made = {id_col: F.col("row.doc_id").alias(id_col), text_col: F.col("text").alias(text_col)}
    return out.select(*[made.get(c, F.col(f"row.rest.`{c}`").alias(c)) for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = """
WITH parts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS doc, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, doc, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts),
keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (
  SELECT k, max(doc) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc) >= 3),
marked AS (SELECT keyed.*, common.last IS NOT NULL AND common.last <> doc AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
