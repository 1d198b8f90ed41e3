"""Quality scores: kernel ridge regression by random Fourier features, then isotonic calibration.

Every whole text becomes a vector of statistics. Cosine features with Gaussian frequencies
approximate a Gaussian kernel over these vectors (Rahimi and Recht, 2007). Each task sums its part
of the normal equations; their sum, of a size fixed by ``FEATURES``, is solved on the driver. The
training rows' raw scores are summed into ``BINS`` bins and pooled to a monotone curve.

Defined results: null and empty texts are scored from the statistics of an empty text; null labels
and labels without a document teach nothing; a document with several labels teaches each; with no
labelled row, or labels of one kind, every score is the mean label (0.5 without any); an empty
table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgrid.llm.common import crc_of_id, small_batches, table
from epsgrid.staging import stage

FEATURES = 256
RIDGE = 1e-3
BINS = 4096
#: Share of the raw score in the final one, so that it still ranks where the curve is flat.
RANK_SHARE = 0.01
THRESHOLD = 0.3

NAMES = ["log_bytes", "log_words", "word_length", "upper", "digit", "mark", "symbol", "pipe", "space", "line", "non_ascii", "entropy", "repeated", "distinct", "top_word", "marked_words", "capital_words", "log_longest"]
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_MARK = np.isin(_BYTES, [ord(c) for c in ".,;:'\"()-?"])
_HIGH = _BYTES >= 128
_BLANK = np.isin(_BYTES, [9, 10, 11, 12, 13, 32])
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _MARK | _HIGH | _BLANK)


def statistics(text: str | None) -> list[float]:
    """Counts over the whole text, as shares where they would grow with it; in the order of NAMES."""
    data = (text or "").encode()
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words = data.split()
    many = max(1, len(words))
    kinds = Counter(words)
    share = count[count > 0] / n
    joined = b" ".join(kinds)
    letters = max(1, int(count[_UPPER | _LOWER | _HIGH].sum()))
    tails = Counter(w[-1] for w in words)
    marked = sum(c for b, c in tails.items() if _SYMBOL[b])
    return [
        float(np.log1p(len(data))),
        float(np.log1p(len(words))),
        (len(data) - int(count[_BLANK].sum())) / many,
        float(count[_UPPER].sum()) / letters,
        float(count[_DIGIT].sum()) / n,
        float(count[_MARK].sum()) / n,
        float(count[_SYMBOL].sum()) / n,
        float(count[ord("|")]) / n,
        float(count[32]) / n,
        float(count[10]) / n,
        float(count[_HIGH].sum()) / letters,
        float(-(share * np.log2(share)).sum()),
        sum(map(operator.eq, words, words[1:])) / many,
        len(kinds) / many**0.85,
        max(kinds.values(), default=0) / many,
        marked / many,
        sum(c for w, c in kinds.items() if w.isupper() and len(w) > 1) / many,
        float(np.log1p(max(map(len, joined.split()), default=0))),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, x)`` with x the statistics, shares by their square root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray([statistics(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(NAMES))
            shares = [i for i, name in enumerate(NAMES) if name in ("upper", "digit", "mark", "symbol", "pipe", "line", "non_ascii", "repeated", "top_word", "marked_words", "capital_words")]
            x[:, shares] = np.sqrt(x[:, shares])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


class Model:
    """Standardisation, frequencies, weights and curve; a few kB, whatever the corpus."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((len(mean), features)) / np.sqrt(len(mean))
        self.phase = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + len(mean) + 1)
        self.knots: tuple[np.ndarray, np.ndarray] | None = None
        self.base = 0.5

    def features(self, x: np.ndarray) -> np.ndarray:
        """Kernel features, the standardised statistics themselves and a constant."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.cos(z @ self.w + self.phase) * np.sqrt(2 / self.w.shape[1]), z / 6, np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), self.base)
        raw = self.raw(x)
        return (1 - RANK_SHARE) * np.clip(np.interp(raw, *self.knots), 0, 1) + RANK_SHARE * np.clip(raw, 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def normal_equations(rows: DataFrame, model: Model) -> np.ndarray:
    """Sums of outer products of features and label, one matrix row a group, over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows:
                f = model.features(_matrix(batch.column(0)))
                part = f.T @ np.column_stack([f, np.asarray(batch.column(1), np.float64)])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"][:1], "v": [np.sum([np.frombuffer(v, np.float64) for v in pdf["v"]], axis=0).tobytes()]})

    parts = rows.select("x", "y").mapInArrow(run, "i long, v binary")
    total = parts.groupBy("i").applyInPandas(add, "i long, v binary").collect()
    return np.stack([np.frombuffer(r["v"], np.float64) for r in sorted(total, key=lambda r: r["i"])])


def pool_adjacent(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The monotone sequence nearest to y by weighted squares."""
    blocks: list[list[float]] = []
    for value, weight in zip(y.tolist(), w.tolist(), strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1])
            a[1] += b[1]
            a[2] += b[2]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def calibrate(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the curve from raw score to probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, y = (np.zeros(BINS) for _ in range(3))
        for batch in batches:
            raw = model.raw(_matrix(batch.column(0)))
            at = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
            n += np.bincount(at, minlength=BINS)
            s += np.bincount(at, raw, BINS)
            y += np.bincount(at, np.asarray(batch.column(1), np.float64), BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(s[at]), pa.array(y[at])], ["b", "n", "s", "y"])

    bins = rows.select("x", "y").mapInArrow(run, "b long, n double, s double, y double").groupBy("b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("y").alias("y")).collect()
    n, s, y = (np.asarray([r[c] for r in sorted(bins, key=lambda r: r["b"])]) for c in ("n", "s", "y"))
    return s / n, pool_adjacent(y / n, n)


def fit(stats: DataFrame, labels: DataFrame, usable: Column, label: str = "quality") -> Model:
    """``stats(doc_id, x)`` and ``labels(doc_id, <label>)``; ``usable`` says which rows may teach."""
    known = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    rows = stage(stats.where(usable).join(known, "doc_id").select("x", "y"), "quality-training")
    d = len(NAMES)
    sums = rows.agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.min("y").alias("low"), F.max("y").alias("high"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(d) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not sums["n"]:
        return Model(np.zeros(d), np.ones(d))
    model = Model(np.asarray([sums[f"m{i}"] for i in range(d)]), np.asarray([max(sums[f"s{i}"], 1e-3) for i in range(d)]))
    model.base = sums["y"]
    if sums["low"] == sums["high"]:
        return model
    total = normal_equations(rows, model)
    gram, right = total[:, :-1], total[:, -1]
    model.weights = np.linalg.solve(gram + np.diag(np.full(len(gram), RIDGE * sums["n"] / len(gram) + 1e-6)), right)
    model.knots = calibrate(rows, model)
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """The other columns of ``stats`` with ``score`` and ``predicted``."""
    keep = [c for c in stats.columns if c not in ("x", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, len(NAMES)))
            s = np.round(model.score(x), 9)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], [*keep, "score", "predicted"])

    fields = ", ".join([f"`{c}` {stats.schema[c].dataType.simpleString()}" for c in keep] + ["score double", "predicted int"])
    return stats.select(*keep, "x").mapInArrow(run, fields)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = stage(document_statistics(docs), "quality-statistics")
    stats = stats.withColumn("held_out", F.coalesce(crc_of_id(F.col("doc_id")) % 5 == 0, F.lit(False)))
    model = fit(stats, labels, ~F.col("held_out"))
    return score(stats, model).select("doc_id", "held_out", "score", "predicted")
