"""Media columns in a content-defined chunk store.

A payload is stored as 8-bit mono samples in a WAVE file. The file is cut where a rolling gear hash
of its last 32 bytes has ``CUT_BITS`` leading zeros, within ``LEAST`` and ``MOST`` bytes. Chunks
are named by their SHA-256, compressed, deduplicated by a Spark aggregation on the name and written
in buckets of it; a payload keeps the ordered list of its chunks. Reading joins these lists to the
chunks without moving the store, puts each file together in order as rows stream past, verifies its
digest and computes features of the samples. Equal payloads are put together once. Chunks that a
large share of all lists hold meet their lists by a broadcast of at most ``HOT_KEYS`` chunks.

Defined results: null counts as empty; an empty payload is 64 zero bytes; payloads may share all of
their chunks; repeated rows and ids each get a row; an empty table gives no rows; other columns are
ignored. A payload is held whole only in the task that assembles it.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgrid.llm.common import crc32, draw, draw_below, small_batches, table
from epsgrid.operators.skew import HOT_KEYS, HOT_ROWS
from epsgrid.staging import stage, stage_bucketed

UNIT = 64
CUT_BITS = 12
LEAST, MOST = 1024, 32768
LEVEL = 15
#: Rows from which the compression dictionary is trained, and its size.
DICTIONARY_ROWS, DICTIONARY_BYTES = 1600, 1 << 19
RATE = 8000
#: Slots of digests that are counted first.
SLOTS = 4 * HOT_KEYS
_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def padded(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8 and the payload, padded to a positive multiple of UNIT."""
    data = (text or "").encode()
    return len(data), data + bytes(max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def to_media(payload: bytes) -> bytes:
    """A WAVE file with the payload as its samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def from_media(media: bytes) -> bytes:
    riff, size, wave, fmt, n, kind, channels, _, _, align, bits, data, length = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (riff, wave, fmt, n, kind, channels, align, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 1, 8, b"data") or size != 36 + length or len(media) != 44 + length:
        raise ValueError("not a file of 8-bit mono samples")
    return media[44:]


def cut_points(data: bytes, bits: int = CUT_BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks; they depend on the content near them and on the cut before."""
    if len(data) <= least:
        return [len(data)] if data else []
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):  # sums over windows of 2, 4, ... 32 bytes
        wider = h.copy()
        wider[width:] += h[:-width] << np.uint32(width)
        h = wider
    out, start = [], 0
    for end in (np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1).tolist():
        while end - start > most:
            start += most
            out.append(start)
        if end - start >= least:
            start = end
            out.append(start)
    while len(data) - start > most:
        start += most
        out.append(start)
    if start < len(data):
        out.append(len(data))
    return out


def chunks_of(media: bytes) -> list[bytes]:
    ends = cut_points(media)
    return [media[a:b] for a, b in zip([0, *ends], ends, strict=False)]


@functools.lru_cache(maxsize=4)
def _codec(dictionary: bytes | None) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    told = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=told), zstandard.ZstdDecompressor(dict_data=told)


def train_dictionary(texts: DataFrame) -> bytes | None:
    """From the DICTIONARY_ROWS texts of least hashes, of each a beginning; None where they are too few."""
    drawn = texts.where("text is not null").withColumn("draw", draw("text"))
    some = drawn.where(F.col("draw") < draw_below(DICTIONARY_ROWS, drawn.count())).groupBy("draw").agg(F.count("*")).select("draw")
    least = sorted(r["draw"] for r in some.collect())[:DICTIONARY_ROWS]  # numbers only, about four times as many
    chosen = drawn.where(F.col("draw") <= (least[-1] if least else -1)).groupBy("draw").agg(F.min(F.substring("text", 1, MOST)).alias("text")).collect()
    # by text: a dictionary trained on samples beside their like is a few hundredths better
    samples = [c for r in sorted(chosen, key=lambda r: r["text"]) for c in chunks_of(r["text"].encode())]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if size < 1024 or len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return None


@dataclass
class Store:
    """``recipes(doc_id, n_bytes, media_sha, digests)`` and ``chunks(digest, data)``."""

    recipes: DataFrame
    chunks: DataFrame
    dictionary: bytes | None


def write_store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Store:
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(docs.select("text"))

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, lists = [], [], []
            for text in batch.column(1):
                n, payload = padded(text.as_py())
                media = to_media(payload)
                sizes.append(n)
                names.append(hashlib.sha256(media).digest())
                lists.append([hashlib.sha256(c).digest() for c in chunks_of(media)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "n_bytes", "media_sha", "digests"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = _codec(dictionary)[0].compress
        for batch in batches:
            found: dict[bytes, bytes] = {}
            for text in batch.column(0):
                for c in chunks_of(to_media(padded(text.as_py())[1])):
                    name = hashlib.sha256(c).digest()
                    if name not in found:
                        found[name] = compress(c)
            yield pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "data"])

    kept = stage(docs.mapInArrow(recipes, "doc_id long, n_bytes long, media_sha binary, digests array<binary>"), "media-recipes")
    distinct = docs.select("text").mapInArrow(chunks, "digest binary, data binary").dropDuplicates(["digest"])
    return Store(kept, stage_bucketed(distinct, "media-chunks", "digest"), dictionary)


def feature(payload: bytes) -> str:
    """Mean, root mean square, zero crossings, range and a histogram of sixteen bins of the samples."""
    raw = np.frombuffer(payload, np.uint8)
    x = raw.astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    bins = np.bincount(raw >> 4, minlength=16).tolist()
    rms = float(np.sqrt((x * x).sum() / len(x)))
    return f"mean={x.sum() / len(x):.4f};rms={rms:.4f};cross={crossings};low={x.min()};high={x.max()};hist={','.join(map(str, bins))}"


def hot_digests(store: Store) -> list[int]:
    """Hashes of the digests that more than one of HOT_KEYS equal shares of all lists' entries are, HOT_KEYS at most."""
    entries = store.recipes.select(F.explode("digests").alias("digest")).select(F.xxhash64("digest").alias("h"))
    total = store.recipes.agg(F.sum(F.size("digests")).alias("n")).first()["n"] or 0
    limit = max(HOT_ROWS, total // HOT_KEYS)
    # digests are counted one by one only in the slots that hold enough entries for one of them to be hot
    slot = F.pmod("h", F.lit(SLOTS))
    slots = [r["slot"] for r in entries.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()]
    if not slots:
        return []
    return [r["h"] for r in entries.where(slot.isin(slots)).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()]


def assemble(store: Store) -> DataFrame:
    """``(media_sha, media_bytes, payload)`` summarised once for each distinct file, read back and verified."""
    lists = store.recipes.groupBy("media_sha").agg(F.first("digests").alias("digests"))
    parts = lists.select("media_sha", F.posexplode("digests").alias("i", "digest"))
    hot = hot_digests(store)
    if hot:
        common = F.xxhash64("digest").isin(hot)
        held = stage(store.chunks.where(common), "media-hot", "uncompressed")
        parts = parts.where(common).join(F.broadcast(held), "digest").unionByName(parts.where(~common).join(store.chunks, "digest"))
    else:
        parts = parts.join(store.chunks, "digest")
    dictionary = store.dictionary
    names = ["media_sha", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = _codec(dictionary)[1].decompress

        def whole(name: bytes, data: list[bytes]) -> tuple:
            media = b"".join([expand(x) for x in data])
            if hashlib.sha256(media).digest() != name:
                raise ValueError(f"file {name.hex()} is damaged")
            payload = from_media(media)
            return name, len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-UNIT:]), len(media), name.hex(), feature(payload)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

        now, held = None, []
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != now:
                    if held:
                        rows.append(whole(now, held))
                    now, held = name, []
                held.append(data)
            yield out(rows)
        if held:
            yield out([whole(now, held)])

    ordered = parts.select("media_sha", "i", "data").repartition("media_sha").sortWithinPartitions("media_sha", "i")
    return ordered.select("media_sha", "data").mapInArrow(run, "media_sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = write_store(table(spark, sf_dir, "documents"))
    found = stage(assemble(store), "media-features")
    return store.recipes.select("doc_id", "n_bytes", "media_sha").join(found, "media_sha").drop("media_sha")
