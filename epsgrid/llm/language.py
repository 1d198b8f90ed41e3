"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here, in numpy, by backpropagation through time on one window of each of
at most ``TRAIN_DOCS`` labelled documents: of each label the same number, those with the least
hashes of id and text, so that no label is left out however many rows there are. A
text is cut into blocks of ``LENGTH`` bytes; every position of every block gets a label
distribution and a document's distribution is the mean over all its positions.

Defined results: null text and text without a letter are ``und`` with score 0; equal texts get
equal labels; a null label is never learned; without any labelled row every document is ``und``;
an empty table gives no rows. Other columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epsgrid.llm.common import DRAWS, crc_of_id, draw, draw_below, release, small_batches, table

TRAIN_DOCS = 4000
LENGTH = 64
HIDDEN = 12
STEPS = 260
BATCH = 256
#: Blocks that are run at once; always so many, so that a text's result does not depend on its neighbours.
LANES = 2048
_LETTER = re.compile(r"[^\W\d_]+")
_PAD = 256
Params = dict[str, np.ndarray]


def has_letter(text: str) -> bool:
    """Whether a character is of a category of letters; numerals such as fractions are not."""
    return any(any(map(str.isalpha, m[0])) for m in _LETTER.finditer(text))


def initial(labels: int, hidden: int, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * shape[0] ** -0.5).astype(np.float32)
    p: Params = {"b": np.zeros(labels, np.float32)}
    for way in "fb":
        p[f"x{way}"] = (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32)
        p[f"g{way}"] = draw(hidden, 2 * hidden)
        p[f"n{way}"] = draw(hidden, hidden)
        p[f"w{way}"] = draw(hidden, labels)
    return p


def _run(p: Params, way: str, data: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States along one direction, time first; data and live are (time, lane)."""
    x, g, u = p[f"x{way}"], p[f"g{way}"], p[f"n{way}"]
    hidden = u.shape[0]
    gates, cand = np.ascontiguousarray(x[:, : 2 * hidden]) * np.float32(0.5), np.ascontiguousarray(x[:, 2 * hidden :])
    half = g * np.float32(0.5)
    h = np.zeros((data.shape[1], hidden), np.float32)
    states = np.empty((*data.shape, hidden), np.float32)
    memory = []
    full = live.all(axis=1)
    for t in range(len(data)) if way == "f" else range(len(data) - 1, -1, -1):
        a = gates.take(data[t], axis=0)
        a += h @ half
        np.tanh(a, out=a)  # sigmoid(v) = (1 + tanh(v / 2)) / 2
        a *= np.float32(0.5)
        a += np.float32(0.5)
        z, r = a[:, :hidden], a[:, hidden:]
        hn = h @ u
        n = hn * r
        n += cand.take(data[t], axis=0)
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        if not full[t]:
            new *= live[t][:, None]
        if keep:
            memory.append((t, h, z, r, n, hn))
        h = new
        states[t] = h
    return states, memory


def _logits(p: Params, data: np.ndarray, live: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
    logits, told = p["b"], {}
    for way in "fb":
        states, memory = _run(p, way, data, live, keep)
        logits = logits + states @ p[f"w{way}"]
        told[way] = (states, memory)
    return logits, told


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def gradients(p: Params, data: np.ndarray, live: np.ndarray, label: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over the live positions and its gradient, through time in both directions."""
    logits, told = _logits(p, data, live, True)
    prob = _softmax(logits)
    count = np.float32(max(1, live.sum()))
    lanes = np.arange(len(label))
    loss = float(-(np.log(prob[:, lanes, label] + 1e-9) * live).sum() / count)
    prob[:, lanes, label] -= 1
    d = prob * (live[..., None] / count).astype(np.float32)
    out: Params = {"b": d.sum(axis=(0, 1))}
    order = np.argsort(data, axis=None, kind="stable")
    symbols, first = np.unique(data.ravel()[order], return_index=True)
    for way in "fb":
        states, memory = told[way]
        g, u, w = p[f"g{way}"], p[f"n{way}"], p[f"w{way}"]
        hidden = u.shape[0]
        out[f"w{way}"] = np.tensordot(states, d, ([0, 1], [0, 1]))
        out[f"g{way}"], out[f"n{way}"] = np.zeros_like(g), np.zeros_like(u)
        dx = np.empty((*data.shape, 3 * hidden), np.float32)
        later = np.zeros((data.shape[1], hidden), np.float32)
        for t, h, z, r, n, hn in reversed(memory):
            dh = (d[t] @ w.T + later) * live[t][:, None]
            dn = dh * (1 - z) * (1 - n * n)
            dg = np.concatenate([dh * (h - n) * z * (1 - z), dn * hn * r * (1 - r)], axis=1)
            dhn = dn * r
            dx[t, :, : 2 * hidden], dx[t, :, 2 * hidden :] = dg, dn
            out[f"g{way}"] += h.T @ dg
            out[f"n{way}"] += h.T @ dhn
            later = dh * z + dg @ g.T + dhn @ u.T
        out[f"x{way}"] = np.zeros_like(p[f"x{way}"])
        out[f"x{way}"][symbols] = np.add.reduceat(dx.reshape(-1, 3 * hidden)[order], first, axis=0)
    return loss, out


def lay_out(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of the texts, padded, and the number of blocks of each text."""
    blocks = np.asarray([-(-len(x) // length) for x in texts], np.int64)
    flat = np.full(int(blocks.sum()) * length, _PAD, np.int16)
    at = np.cumsum(blocks) - blocks
    for x, a in zip(texts, (at * length).tolist(), strict=True):
        flat[a : a + len(x)] = np.frombuffer(x, np.uint8)
    return flat.reshape(-1, length), blocks


def train(windows: list[bytes], labels: np.ndarray, classes: int, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Params:
    """Adam on batches that draw every label alike."""
    data, blocks = lay_out([w[:LENGTH] for w in windows], LENGTH)
    label = np.repeat(labels, blocks)
    rng, p = np.random.default_rng(seed), initial(classes, hidden, seed)
    by = [np.flatnonzero(label == c) for c in range(classes)]
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(x, -(-BATCH // classes)) for x in by if len(x)])
        batch = np.ascontiguousarray(data[pick].T)
        _, grad = gradients(p, batch, batch != _PAD, label[pick])
        size = np.sqrt(sum(float((x * x).sum()) for x in grad.values()))
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for k, x in grad.items():
            x = x / np.float32(max(1, size))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def pooled(p: Params, texts: list[bytes]) -> np.ndarray:
    """Mean label distribution over all positions of each text; zeros for an empty one."""
    data, blocks = lay_out(texts, LENGTH)
    sums = np.zeros((len(data), len(p["b"])))
    for i in range(0, len(data), LANES):
        part = data[i : i + LANES]
        lanes = np.full((LENGTH, LANES), _PAD, np.int16)
        lanes[:, : len(part)] = part.T
        live = lanes != _PAD
        logits, _ = _logits(p, lanes, live)
        prob = _softmax(logits) * live[..., None]
        sums[i : i + LANES] = prob.sum(axis=0, dtype=np.float32)[: len(part)]
    owner = np.repeat(np.arange(len(texts)), blocks)
    total = np.stack([np.bincount(owner, sums[:, c], len(texts)) for c in range(sums.shape[1])], 1)
    return total / np.maximum(1, [len(x) for x in texts])[:, None]


def fit(docs: DataFrame, usable, train_docs: int = TRAIN_DOCS) -> tuple[list[str], Params | None]:
    """Labels and network from at most ``train_docs`` rows of ``docs(doc_id, text, lang)``, and at least one a label."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], None
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(F.lit(1), F.length("text") - LENGTH)).cast("int")
    drawn = known.select("lang", draw("doc_id", "text").alias("draw"), F.expr("text").substr(start + 1, F.lit(LENGTH)).alias("w"))
    rows = sample(drawn, counts, max(1, train_docs // len(langs)))
    at = {x: i for i, x in enumerate(langs)}
    return langs, train([w.encode() for _, w in rows], np.asarray([at[x] for x, _ in rows], np.int64), len(langs))


def sample(drawn: DataFrame, counts: dict[str, int], each: int) -> list[tuple[str, str]]:
    """``(lang, w)`` of the ``each`` least draws of each language in ``drawn(lang, draw, w)``.

    Only rows below a bound that follows from the counts are collected. Equal rows have one draw and
    are taken once: where so many are equal that too few are left, the bound is lifted in turn.
    """
    out: list[tuple[str, str]] = []
    left, wide = dict(counts), 1
    while left:
        below = F.lit(False)
        for lang, n in left.items():
            below = below | ((F.col("lang") == lang) & (F.col("draw") < min(DRAWS, wide * draw_below(each, n))))
        found: dict[str, list[tuple[int, str]]] = {x: [] for x in left}
        for r in drawn.where(below).groupBy("lang", "draw").agg(F.min("w").alias("w")).collect():
            found[r["lang"]].append((r["draw"], r["w"]))
        for lang, rows in found.items():
            if len(rows) >= each or wide * draw_below(each, left[lang]) >= DRAWS:
                out += [(lang, w) for _, w in sorted(rows)[:each]]
                del left[lang]
        wide *= 8
    return sorted(out)


def identify(docs: DataFrame, langs: list[str], params: Params | None, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score") and not (drop_text and c == text_col)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(len(keep)).to_pylist()]
            texts = [x if params and has_letter(x) else "" for x in texts]
            mean = pooled(params, [x.encode() for x in texts]) if params else np.zeros((len(texts), 1))
            best = mean.argmax(axis=1)
            label = [langs[i] if x else "und" for i, x in zip(best.tolist(), texts, strict=True)]
            score = np.round(np.clip(mean.max(axis=1), 0, 1), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(label, pa.string()), pa.array(score)], schema.names)
        release()

    return small_batches(docs).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_in_text")).mapInArrow(run, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_of_id(F.col("doc_id")) % 3 == 1, F.lit(False))
    langs, params = fit(docs, ~held_out)
    found = identify(docs.select("doc_id", held_out.alias("held_out"), "text"), langs, params, drop_text=True)
    return found.select("doc_id", "held_out", "lang_pred", "score")
