"""MinHash near-duplicate components with sequential Bayesian verification.

1. Texts with one shingle set are one class, named by its smallest document; a class has a
   signature of ``ROWS * BANDS`` minimum hashes.
2. Classes that agree on a whole band share a bucket; buckets with the same members are taken
   once. In every bucket, whatever its size, signatures are compared batch after batch; a pair goes
   when the posterior probability that its similarity reaches the threshold falls below ``MISS``.
3. Components of the surviving pairs hold every link. Inside each, the pairs that share a component
   and survive the same comparison are verified on the full sets, unless links found before join
   them already. Only a spanning forest of the links leaves a task.
4. The components of those forests are the result.

Buckets and components of more than ``BLOCK_ROWS`` classes, or ``BLOCK_SHINGLES`` shingles, are dealt
in blocks. First each block is compared within itself and with one class of the whole group; then
only the classes outside the group's largest component so far meet the other blocks. A group of
near copies is thus compared about once a class; the work stays quadratic for groups in which many
classes are near to, but not, each other's copies.

A pair at the threshold misses all bands with a chance of (1 - s ** 6) ** 40: 6e-9 at 0.85,
5e-6 at 0.8; a link is lost only if no chain of other links joins the two.

Defined results: null, empty and word-free texts have no shingles and are components of their own;
fewer words than a shingle make one shingle of the whole sequence; rows with one document id are
one document; a null id takes no part in links and its component is null; an empty table gives no
rows. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgrid.llm.common import release, small_batches, table
from epsgrid.operators.components import connected_components, forest
from epsgrid.operators.skew import join_unique
from epsgrid.staging import stage, unstage

ROWS, BANDS = 6, 40
#: Chance at which a pair is given up.
MISS = 1e-7
#: Hashes compared at once.
STEP = 40
#: Classes and shingles of one block.
BLOCK_ROWS, BLOCK_SHINGLES = 256, 1 << 20
#: Rows and bytes that a task gathers, at least, before it compares them.
GATHER_ROWS, GATHER_BYTES = 4000, 16 << 20
#: Forest rows that one task merges (16 bytes a row, as many as every task's buffer); more go through star rounds.
MERGED = 1_000_000
_WORDS_KEPT = 300_000
_WORDS: dict[bytes, int] = {}
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    try:
        return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    except KeyError:
        pass
    if len(_WORDS) > _WORDS_KEPT:
        _WORDS.clear()
    for w in set(words):
        if w not in _WORDS:
            _WORDS[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the runs of k words, in order; none where there are fewer."""
    n = max(0, len(h) - k + 1)
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return acc


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of k words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(run_hashes(word_hashes(words), min(k, len(words))))


class Hasher:
    def __init__(self, rows: int, bands: int):
        rng = np.random.default_rng(20240)
        self.rows, self.bands, n = rows, bands, rows * bands
        self.a = (rng.integers(0, 1 << 32, n, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)[:, None]
        self.band = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(h), 1024):
            x = self.a * h[None, i : i + 1024]
            x += self.b
            x ^= x >> np.uint32(15)
            np.minimum(out, x.min(axis=1), out=out)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        acc = self.band.copy()
        for column in minima.reshape(self.bands, self.rows).T:
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
        return acc.view(np.int64)


def short(minima: np.ndarray) -> bytes:
    """One byte of each minimum hash."""
    return (minima * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """``(doc_id, n, k1, k2, keys, sig)``: set size, 128-bit key of the set, band keys, one byte a hash."""
    schema = "doc_id long, n long, k1 long, k2 long, keys array<bigint>, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(rows, bands)
        for batch in batches:
            made: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                key = xxhash.xxh3_128_intdigest(s.tobytes())
                minima = hasher.minima(s)
                row = (len(s), key & 0x7FFFFFFFFFFFFFFF, key >> 64 & 0x7FFFFFFFFFFFFFFF, hasher.keys(minima) if len(s) else np.zeros(0, np.int64), short(minima))
                for column, value in zip(made, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(made, kinds, strict=True)]], ["doc_id", "n", "k1", "k2", "keys", "sig"])
        _WORDS.clear()
        release()

    return docs.mapInArrow(run, schema)


def least_matches(similarity: float, hashes: int, step: int = STEP, miss: float = MISS) -> list[tuple[int, int]]:
    """After so many hashes, the fewest matches at which a pair stays.

    With a uniform prior the posterior of the match rate is Beta(m + 1, n - m + 1), and its mass
    above t is the chance of at most m successes in n + 1 trials of chance t. One byte of each
    hash is kept, so unequal ones match by chance once in 256.
    """
    t = similarity + (1 - similarity) / 256
    out = []
    for n in [*range(step, hashes, step), hashes]:
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups, of GATHER_ROWS or GATHER_BYTES about, from rows that are sorted by their key."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            held.append(batch.slice(i, 100))
            rows, size = rows + held[-1].num_rows, size + held[-1].nbytes
            if rows < GATHER_ROWS and size < GATHER_BYTES:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            last = int(_changes(whole, key)[-1])
            if last:
                yield whole.slice(0, last)
            held = whole.slice(last).combine_chunks().to_batches()
            # a group that goes on is looked at again after as many rows
            rows, size = (0, 0) if not last else (whole.num_rows - last, sum(x.nbytes for x in held))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _changes(rows: pa.Table, key: list[str]) -> np.ndarray:
    """First row of each group."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for c in key:
        x = rows.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _mates(first: np.ndarray, end: int, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside each group: all of them, or those of sides 0 and 1 where a group has both."""
    sizes = np.diff(first, append=end)
    two = np.maximum.reduceat(side, first) > 0
    for size in np.unique(sizes[(sizes > 1) & ~two]).tolist():
        i, j = np.triu_indices(size, 1)
        starts = first[(sizes == size) & ~two]
        step = max(1, (1 << 20) // len(i))
        for s in range(0, len(starts), step):
            at = starts[s : s + step, None]
            yield (at + i).ravel(), (at + j).ravel()
    for a, b in zip(first[two].tolist(), (first + sizes)[two].tolist(), strict=True):
        i, j = (a + np.flatnonzero(side[a:b] == k) for k in (0, 1))
        yield np.repeat(i, len(j)), np.tile(j, len(i))


def survivors(a: np.ndarray, b: np.ndarray, n: np.ndarray, sig: np.ndarray, num: int, den: int, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose set sizes and signatures leave the threshold possible, the likeliest first."""
    possible = den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])
    a, b = a[possible], b[possible]
    same, done = np.zeros(len(a), np.int64), 0
    for upto, least in bounds:
        for s in range(0, len(a), 1 << 18):
            c = slice(s, s + (1 << 18))
            same[c] += (sig[a[c], done:upto] == sig[b[c], done:upto]).sum(axis=1)
        stay = same >= least
        a, b, same, done = a[stay], b[stay], same[stay], upto
    order = np.argsort(-same, kind="stable")
    return a[order], b[order]


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def verified(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that are links, exactly; pairs that links join already are not looked at."""
    label = np.arange(len(sets))
    us, vs = [], []
    while True:
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        if not len(a):
            return np.asarray(us, np.int64), np.asarray(vs, np.int64)
        # one pair of each element at a time: most others are joined by what they find
        _, now = np.unique(a, return_index=True)
        for k in now.tolist():
            x, y = sets[a[k]], sets[b[k]]
            inner = common(x, y)
            if den * inner >= num * (len(x) + len(y) - inner):
                us.append(a[k])
                vs.append(b[k])
        rest = np.ones(len(a), bool)
        rest[now] = False
        a, b = a[rest], b[rest]
        if us:
            nodes, roots = forest(np.asarray(us, np.int64), np.asarray(vs, np.int64))
            label = np.arange(len(sets))
            label[nodes] = roots


def _compare(rows: DataFrame, key: list[str], num: int, den: int, hashes: int) -> DataFrame:
    """``(u, v)`` joining the nodes of each group of ``rows(.., node, n, sig, side[, shingles])`` that survive and, with sets, are links."""
    bounds, exact = least_matches(num / den, hashes), "shingles" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _grouped(batches, key):
            node, n, side = (part.column(c).to_numpy() for c in ("node", "n", "side"))
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint8).reshape(part.num_rows, -1)
            sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()] if exact else []
            for a, b in _mates(_changes(part, key), part.num_rows, side):
                a, b = survivors(a, b, n, sig, num, den, bounds)
                if exact:
                    a, b = verified(a, b, sets, num, den)
                if not len(a):
                    continue
                u, v = forest(node[a], node[b])
                yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], ["u", "v"])
        release()

    return rows.repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(run, "u long, v long")


def joined_in_groups(rows: DataFrame, num: int, den: int, hashes: int, label: str) -> DataFrame:
    """Staged ``(u, v)`` that join the nodes of each group as all its pairs would.

    ``rows(grp, pivot, parts, node, n, sig[, shingles])`` are staged; ``pivot`` is a node of the group
    and ``parts`` the number of its blocks.
    """
    placed = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    payload = [c for c in rows.columns if c not in ("grp", "pivot", "parts")]
    own = placed.select("grp", "part", *payload, F.lit(0).alias("side"))
    placed = placed.where("parts > 1")
    large = not placed.isEmpty()
    if large:
        everywhere = placed.where("node = pivot").withColumn("to", F.explode(F.expr("sequence(0, parts - 1)"))).where("to <> part")
        own = own.union(everywhere.select("grp", F.col("to").alias("part"), *payload, F.lit(0).alias("side")))
    links = stage(_compare(own, ["grp", "part"], num, den, hashes), label)
    if not large:
        return links
    inside = links.join(placed.select(F.col("node").alias("u")).distinct(), "u", "left_semi")
    roots = stage(connected_components(inside, merge_limit=MERGED), f"{label}-roots")
    labelled = placed.select("grp", "node", "parts").join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = stage(labelled.distinct(), f"{label}-labels")
    # only groups that are in several components are looked at again
    major = labelled.groupBy("grp", "root").agg(F.count("*").alias("many")).groupBy("grp").agg(F.max(F.struct("many", "root")).alias("top"), F.count("*").alias("roots"))
    major = major.where("roots > 1").select("grp", F.col("top.root").alias("major"))
    minor = stage(labelled.join(major, "grp").where("root <> major").select("grp", "node", "parts"), f"{label}-minor")
    columns = minor.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("long").alias("columns"))
    column = F.pmod(F.xxhash64("node", F.lit("column")), F.col("columns"))
    apart = rows.drop("parts").join(minor.join(columns, "grp"), ["grp", "node"]).withColumn("column", column).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    blocks = placed.join(columns, "grp").withColumn("column", F.explode(F.expr("sequence(0, columns - 1)")))
    both = blocks.select("grp", "part", "column", *payload, F.lit(0).alias("side")).union(apart.select("grp", "part", "column", *payload, F.lit(1).alias("side")))
    return stage(links.union(_compare(both, ["grp", "part", "column"], num, den, hashes)), f"{label}-all")


def candidate_sets(docs: DataFrame, groups: DataFrame, k: int, rows: int, bands: int) -> DataFrame:
    """``(grp, pivot, parts, node, n, sig, shingles)`` of each class in the candidate components ``groups(id, root, pivot, parts)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(rows, bands)
        for batch in batches:
            made = [shingle_set(x.as_py(), k) for x in batch.column(4)]
            columns = [pa.array([len(x) for x in made], pa.int64()), pa.array([short(hasher.minima(x)) for x in made], pa.binary()), pa.array([x.tobytes() for x in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], ["grp", "pivot", "parts", "node", "n", "sig", "shingles"])
        _WORDS.clear()
        release()

    chosen = docs.join(groups, docs["doc_id"] == groups["id"]).select("root", "pivot", "parts", "doc_id", "text")
    return chosen.mapInArrow(run, "grp long, pivot long, parts long, node long, n long, sig binary, shingles binary").where("n > 0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: tuple[int, int] = (80, 100), rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` a row of ``docs``; links have similarity >= threshold."""
    num, den = threshold
    docs = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = stage(signatures(docs, words, rows, bands), "signatures")
    signed = every.where("doc_id is not null and n > 0")
    classes = stage(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("docs")), "classes")
    named = join_unique(signed.select("doc_id", "k1", "k2"), classes, ["k1", "k2"], "docs")
    # the least class of each document, and the classes that a repeated id joins
    owners = stage(named.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("last"), F.count("*").alias("rows")), "owners")
    same_id = named.join(owners.where("node <> last").select("doc_id", F.col("node").alias("first")), "doc_id").where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    nodes = signed.join(classes.select(F.col("node").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi").withColumnRenamed("doc_id", "node")
    repeated = not owners.where("rows > 1").isEmpty()
    if repeated:  # a class' node may then have several rows of its text
        nodes = nodes.dropDuplicates(["k1", "k2"])
    nodes = stage(nodes.select("node", "n", "keys", "sig"), "class-signatures")
    spread = nodes.select("node", F.explode("keys").alias("band"))
    buckets = spread.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("low"), F.bit_xor(F.xxhash64("node")).alias("mark")).where("size > 1")
    buckets = buckets.groupBy("size", "low", "mark").agg(F.min("band").alias("band"))
    buckets = buckets.select("band", F.col("low").alias("pivot"), F.ceil(F.col("size") / BLOCK_ROWS).cast("long").alias("parts"))
    members = stage(spread.join(buckets, "band").select(F.col("band").alias("grp"), "pivot", "parts", "node"), "members")
    # written, so that no task runs two Python workers at once
    members = stage(members.join(nodes.select("node", "n", "sig"), "node").select("grp", "pivot", "parts", "node", "n", "sig"), "buckets")
    pairs = joined_in_groups(members, num, den, rows * bands, "pairs")
    candidates = stage(connected_components(pairs, merge_limit=MERGED), "candidates")
    sized = candidates.join(nodes.select(F.col("node").alias("id"), "n"), "id")
    size = F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)
    groups = candidates.join(sized.groupBy("root").agg(F.ceil(size).cast("long").alias("parts")), "root")
    groups = stage(groups.select("id", "root", F.col("root").alias("pivot"), "parts"), "groups")
    unstage(nodes, members, pairs, candidates)
    sets = candidate_sets(docs, groups, words, rows, bands)
    sets = stage(sets.distinct() if repeated else sets, "candidate-sets")
    links = joined_in_groups(sets, num, den, rows * bands, "links")
    unstage(sets, groups)
    roots = stage(connected_components(links.union(same_id), merge_limit=MERGED), "components")
    unstage(links)
    found = owners.select("doc_id", "node").join(roots.select(F.col("id").alias("node"), "root"), "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    known = every.where("doc_id is not null").select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    nameless = every.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("root"))
    component = F.coalesce("root", "doc_id")
    out = known.union(nameless)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=(85, 100))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM w),
n AS MATERIALIZED (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT u, v FROM pairs JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
cc(id, lab) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT e.v, min(cc.lab) FROM cc JOIN e ON e.u = cc.id JOIN recurring.cc r ON r.id = e.v WHERE cc.lab < r.lab GROUP BY e.v)
SELECT n.doc_id, n.n AS n_shingles, lab AS component_id, n.doc_id = lab AS kept FROM n JOIN cc ON cc.id = n.doc_id
"""
