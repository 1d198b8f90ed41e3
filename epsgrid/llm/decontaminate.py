"""Benchmark decontamination as a prefix-filtered set join with exact window checks.

Items are cut into windows of ``WINDOW`` words. A window must be contained whole, so the necessary
prefix of its shingles, ordered by their counts over all documents, is its rarest one; windows with
a shingle that no document holds are out. Documents give their occurrences of prefix shingles, each
with the words around it. These are joined with where the shingle stands in windows and how long
they are; what begins before the document or ends behind it falls out (positional and length
bounds), and the words that are left are joined with the windows word for word.

All of this is joins of tables; nothing of the items is held on the driver but a sieve, a bit array
of at most ``SIEVE_BITS`` bits, by which the documents' tasks pass over most shingles that no item
has. It only spares work: a full sieve gives the same rows.

Defined results: null and word-free documents have no words and no hits; null and word-free items
and those without an id have no windows; equal windows of several items count for each item; rows
with equal texts are judged alike, whatever their ids, and equal texts are joined once; words of
over ``LONG`` bytes are compared by a 128-bit digest; without items nothing is contaminated; an
empty document table gives no rows. Other columns pass through; those named like a result column
are replaced.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epsgrid.llm.common import field_of, names_for, release, small_batches, table
from epsgrid.llm.near_dup import mix, run_hashes
from epsgrid.staging import stage, unstage

WINDOW = 13
SHINGLE = 3
#: Bounds of the sieve's size; within them it has 64 bits a shingle.
LEAST_BITS, SIEVE_BITS = 1 << 16, 1 << 27
LONG = 48
#: Bytes of a text whose words are hashed at once.
PIECE = 1 << 20

_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_BYTE_KEY = np.random.default_rng(9).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
RESULT = ["n_words", "n_hit", "n_items", "items", "contaminated"]


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Words:
    """The words of a text by their places and hashes; equal words have equal hashes, others may.

    The hash is a polynomial of the bytes, taken for all words of a piece of the text at once; words
    of over ``LONG`` bytes have a hash of their own.
    """

    def __init__(self, text: str | None):
        self.data = text.encode().translate(_TABLE) if text else b""
        pieces = [self._piece(a, b) for a, b in self._cuts()]
        self.starts, self.ends, self.hashes = (np.concatenate([x[i] for x in pieces]) if pieces else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.uint64)))

    def _cuts(self) -> Iterator[tuple[int, int]]:
        """Pieces that end at a space or hold one word."""
        at, size = 0, len(self.data)
        while at < size:
            end = size if size - at <= PIECE else self.data.rfind(b" ", at, at + PIECE)
            if end <= at:
                end = self.data.find(b" ", at + 1)
                end = size if end < 0 else end
            yield at, end
            at = end

    def _piece(self, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(self.data, np.uint8)[at:end]
        edge = np.flatnonzero(np.diff(data != 32, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if len(data) <= PIECE:
            power, inverse = _powers(max(1 << 12, 1 << (len(data) - 1).bit_length()))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE_KEY[data] * power[: len(data)], out=sums[1:])
            hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        else:
            hashes = np.zeros(len(starts), np.uint64)
        for i in np.flatnonzero(ends - starts > LONG).tolist():
            hashes[i] = xxhash.xxh3_64_intdigest(self.data[at + starts[i] : at + ends[i]])
        return starts + at, ends + at, hashes

    def spelled(self, first: int, end: int) -> bytes:
        """Words joined by spaces, very long ones by their digest behind a byte that no word holds."""
        words = [self.data[a:b] for a, b in zip(self.starts[first:end].tolist(), self.ends[first:end].tolist(), strict=True)]
        return b" ".join([w if len(w) <= LONG else b"\x01" + hashlib.blake2b(w, digest_size=16).hexdigest().encode() for w in words])

    def __len__(self) -> int:
        return len(self.starts)


@functools.lru_cache(maxsize=16)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64 and of its inverse."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``(item, w, len, keys)``: each window of each item once, with the keys of its shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = Words(text)
                if item is None or not len(words):
                    continue
                size = min(window, len(words))
                k = min(SHINGLE, size)
                keys = run_hashes(words.hashes, k).view(np.int64)
                found = {words.spelled(p, p + size): p for p in range(len(words) - size + 1)}
                lists = pa.array([keys[p : p + size - k + 1] for p in found.values()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found)), pa.array([w.decode() for w in found]), pa.array([size] * len(found), pa.int32()), lists], ["item", "w", "len", "keys"])

    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return items.mapInArrow(run, "item string, w string, len int, keys array<bigint>")


class Sieve:
    """Two bits for each key of a table (Bloom, 1970); a key that lacks one of its bits is surely not in it."""

    def __init__(self, keys: DataFrame):
        self.bits = min(SIEVE_BITS, max(LEAST_BITS, 1 << (64 * keys.count()).bit_length()))
        slots = keys.select(F.explode(F.array(*[F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(self.bits - 1).cast("long")) for shift in (0, 32)])).alias("slot"))
        words = slots.select(F.shiftright("slot", 6).cast("int").alias("at"), F.expr("shiftleft(1L, int(slot & 63))").alias("bit"))
        rows = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most a row for 64 bits
        made = np.zeros(self.bits >> 6, np.int64)
        made[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
        self.made = made.tobytes()

    def passes(self, keys: np.ndarray) -> np.ndarray:
        """Whether the keys may be in the table."""
        made = np.frombuffer(self.made, np.uint8)
        out = np.ones(len(keys), bool)
        for shift in (0, 32):
            slot = (keys >> np.uint64(shift) & np.uint64(self.bits - 1)).astype(np.int64)
            out &= (made[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
        return out


def shingle_counts(texts: DataFrame, wanted: DataFrame, sizes: list[int]) -> DataFrame:
    """``(key, n)``: how often each wanted shingle occurs in all texts."""
    sieve = Sieve(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for text in batch.column(0):
                hashes = Words(text.as_py()).hashes
                for k in sizes:
                    keys = run_hashes(hashes, k)
                    found.append(keys[sieve.passes(keys)])
            keys, many = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(many.astype(np.int64))], ["key", "n"])
        release()

    counted = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.join(wanted, "key", "left_semi")


def text_key(text: str) -> tuple[int, int]:
    """Two halves of a 128-bit hash; equal texts are one wherever they come."""
    key = xxhash.xxh3_128_intdigest(text.encode())
    return key & 0x7FFFFFFFFFFFFFFF, key >> 65


def occurrences(texts: DataFrame, places: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """``(a, b, key, before, around, at)``: where prefix shingles stand in a text, by the words around them.

    ``before`` of the words ``around`` stand before the shingle; ``at`` lists its positions with
    just these words around it.
    """
    sieve = Sieve(places.select("key").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[], [], [], [], [], []]
            for text in batch.column(0).to_pylist():
                words, found = Words(text), defaultdict(list)
                for k in sizes:
                    keys = run_hashes(words.hashes, k)
                    for p in np.flatnonzero(sieve.passes(keys)).tolist():
                        before = min(p, window - k)
                        found[int(keys[p]), before, words.spelled(p - before, p + window)].append(p)
                if found:
                    a, b = text_key(text)
                    for (key, before, around), at in found.items():
                        for column, value in zip(made, (a, b, key - (key >> 63 << 64), before, around.decode(), at), strict=True):
                            column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], ["a", "b", "key", "before", "around", "at"])
        release()

    return texts.mapInArrow(run, "a long, b long, key long, before int, around string, at array<bigint>")


def contained(texts: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(a, b, n_hit, items)`` of every text that holds a window of an item, by the key of the text."""
    named = stage(item_windows(benchmark, item_col, item_text, window), "item-windows")
    windows = named.groupBy("w", "len").agg(F.first("keys").alias("keys"))
    shingles = stage(windows.select("w", "len", F.size("keys").alias("parts"), F.posexplode("keys").alias("offset", "key")), "window-shingles")
    wanted = stage(shingles.select("key").distinct(), "shingles")
    sizes = sorted(min(SHINGLE, r["len"]) for r in named.select(F.least("len", F.lit(SHINGLE)).alias("len")).distinct().collect())
    counts = stage(shingle_counts(texts, wanted, sizes), "shingle-counts")
    # windows with a shingle that is in no text lose a row here
    prefix = shingles.join(counts, "key").groupBy("w", "len", "parts").agg(F.min(F.struct("n", "key", "offset")).alias("p"), F.count("*").alias("found")).where("found = parts")
    prefix = stage(prefix.select("w", "len", "p.key", "p.offset"), "prefixes")
    places = stage(prefix.select("key", "offset", "len").distinct(), "prefix-places")
    seen = stage(occurrences(texts, places, sizes, window).distinct(), "occurrences")
    words = F.split("around", " ")
    near = seen.join(places, "key").where(F.col("offset") <= F.col("before")).withColumn("first", F.col("before") - F.col("offset"))
    near = near.where(F.col("first") + F.col("len") <= F.size(words))
    # the optimiser may spell w before the filters above are met, where first can be -1 and slice would raise
    near = near.select("a", "b", "at", "offset", "len", F.array_join(F.slice(words, F.greatest(F.col("first") + 1, F.lit(1)), F.col("len")), " ").alias("w"))
    hits = stage(near.join(prefix.select("w", "len"), ["w", "len"]).select("a", "b", "w", "len", F.transform("at", lambda p: p - F.col("offset")).alias("starts")), "window-hits")
    spans = hits.select("a", "b", F.explode("starts").alias("start"), F.col("len").cast("long").alias("len")).distinct().withColumn("end", F.col("start") + F.col("len"))
    earlier = F.max("end").over(Over.partitionBy("a", "b").orderBy("start", "end").rowsBetween(Over.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0).cast("long"), F.col("end") - F.greatest("start", F.coalesce(earlier, F.lit(0).cast("long"))))
    covered = spans.select("a", "b", fresh.alias("fresh")).groupBy("a", "b").agg(F.sum("fresh").alias("n_hit"))
    owners = hits.select("a", "b", "w").distinct().join(named.select("item", "w"), "w").groupBy("a", "b").agg(F.sort_array(F.collect_set("item")).alias("items"))
    found = stage(covered.join(owners, ["a", "b"]), "contained")
    unstage(named, shingles, wanted, counts, prefix, places, seen, hits)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, min_share: tuple[int, int] = (1, 20), drop_text: bool = False) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, items, contaminated``.

    A document is contaminated if a hit exists and at least ``min_share`` of its words are hit.
    """
    text = F.col(f"`{text_col}`").cast("string")
    found = contained(small_batches(docs).select(text.alias("text")), small_batches(benchmark), item_col, item_text, window)
    keep = [c for c in docs.columns if c.lower() not in RESULT and not (drop_text and c == text_col)]
    rest = docs.select(*[F.col(f"`{c}`") for c in keep])
    a, b, n, given = names_for(rest, "a", "b", "n_words", "text")
    schema = T.StructType([field_of(rest, c) for c in keep] + [T.StructField(c, T.LongType()) for c in (a, b, n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            keys = [text_key(x) if x else (None, None) for x in texts]
            sizes = [len(words_of(x)) for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)], pa.array(sizes, pa.int64())], schema.names)
        release()

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text.alias(given)).mapInArrow(run, schema)
    hit, items = names_for(rows, "n_hit", "items")
    out = rows.join(found.select(F.col("a").alias(a), F.col("b").alias(b), F.col("n_hit").alias(hit), F.col("items").alias(items)), [a, b], "left")
    made = {"n_words": F.col(n), "n_hit": F.coalesce(hit, F.lit(0).cast("long")), "items": F.coalesce(items, F.array().cast("array<string>"))}
    made["n_items"] = F.size(made["items"]).cast("long")
    made["contaminated"] = (made["n_hit"] > 0) & (made["n_hit"] * min_share[1] >= made["n_words"] * min_share[0])
    return out.select(*[F.col(f"`{c}`") for c in keep], *[made[c].alias(c) for c in RESULT])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), drop_text=True)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


OP9_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bp AS (
  SELECT item_id, w, least(len(w), 13) AS l, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM bw WHERE len(w) > 0),
bwin AS MATERIALIZED (SELECT DISTINCT item_id, l, array_to_string(list_slice(w, p, p + l - 1), ' ') AS k FROM bp),
ls AS (SELECT DISTINCT l FROM bwin),
dp AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM dw, ls WHERE len(w) >= l),
hits AS MATERIALIZED (
  SELECT dp.doc_id, dp.p, dp.l, bwin.item_id FROM dp JOIN bwin
    ON bwin.l = dp.l AND bwin.k = array_to_string(list_slice(dp.w, dp.p, dp.p + dp.l - 1), ' ')),
words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.w) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""
