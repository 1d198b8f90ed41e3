"""SentencePiece models on the tokenizers library.

The model's protocol buffer is parsed here. Its normaliser, white-space marker, scores and byte
fallback are rebuilt as a tokenizer of that library: scores as they are for a unigram model, and
as ranks of merges for a byte-pair model. No piece holds the marker behind another character (this
is looked up in the model), so a text may be cut before each run of markers: every distinct
segment is encoded once, in multithreaded batches, and held against the sentencepiece library.
Models with other pieces are encoded by whole texts. The ids are always those of the rebuilt
tokenizer; segments (or texts) for which the other library has other ids, or where it can't be asked
for a segment alone, are counted in ``n_differ``. Ids are decoded by the rebuilt decoder,
which is asked for each piece, and for each distinct run of fallback bytes, once: only such runs
decode otherwise than piece by piece.

Defined results: null counts as empty; an empty text has no ids and decodes to an empty text; the
marker itself in a text decodes to a space, as the format has it, and ``round_trip`` is false;
repeated rows are encoded alike; an empty table gives no rows. Other columns pass through; those
named like a result are replaced.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epsgrid.llm.common import release, small_batches, table

MARK = "▁"
#: Distinct segments whose ids, and runs of fallback bytes whose texts, a worker remembers.
KEPT = 400_000
#: Segments that go to the libraries in one call.
LEARN_AT_ONCE = 4000
#: Segments of one marker that are encoded as one text and parted again by their markers.
JOINED = 64
#: Threads of the tokenizers library in each worker, unless the environment says otherwise.
THREADS = "2"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_ONE = re.compile(f"{MARK}[^{MARK}]+")
_LOADED: dict[str, PieceEncoder] = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = number(i)
        kind = key & 7
        if kind == 0:
            value, i = number(i)
        else:
            size, i = number(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + size], i + size
        yield key >> 3, value


@dataclass
class PieceModel:
    """What a model file says; field numbers are those of the public format."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_spaces: bool = True
    escape: bool = True

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        out = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                out.pieces.append(piece)
                out.scores.append(score)
                out.kinds.append(kind)
            elif number == 2:
                told = dict(_fields(value))
                out.model_type = told.get(3, UNIGRAM)
                out.byte_fallback = bool(told.get(35, 0))
            elif number == 3:
                told = dict(_fields(value))
                out.charsmap = told.get(2, b"")
                out.dummy_prefix, out.remove_spaces, out.escape = (bool(told.get(k, 1)) for k in (3, 4, 5))
        return out

    @property
    def unknown(self) -> int:
        return self.kinds.index(UNKNOWN)

    def by_segment(self) -> bool:
        """Whether pieces may be found segment by segment."""
        return self.escape and not any(MARK in p.lstrip(MARK) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER))

    def merges(self) -> list[tuple[str, str]]:
        """Pairs of pieces that make a piece, best score first."""
        usable = {p: s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True) if k in (NORMAL, USER, UNUSED)}
        order = {p: i for i, p in enumerate(self.pieces)}
        found = [(-usable[p], order[p], k, p) for p in usable for k in range(1, len(p)) if p[:k] in usable and p[k:] in usable]
        found.sort(key=lambda m: (m[0], m[1], m[2]))
        return [(p[:k], p[k:]) for _, _, k, p in found]

    def tokenizer(self):
        """The same model as a tokenizer of the tokenizers library, without the segment cut."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        if self.model_type == UNIGRAM:
            model = models.Unigram(list(zip(self.pieces, self.scores, strict=True)), self.unknown, self.byte_fallback)
        elif self.model_type == BPE:
            model = models.BPE({p: i for i, p in enumerate(self.pieces)}, self.merges(), unk_token=self.pieces[self.unknown], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.model_type} is neither unigram nor byte-pair")
        made = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.remove_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        made.normalizer = normalizers.Sequence(steps)
        made.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []))
        return made


class PieceEncoder:
    """Ids of whole texts, segment by segment where the model allows it."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        from sentencepiece import SentencePieceProcessor
        from tokenizers import decoders, normalizers

        with open(path, "rb") as file:
            self.model = PieceModel.parse(file.read())
        self.whole = self.model.tokenizer()
        self.other = SentencePieceProcessor(model_file=path)
        self.normalizer = self.whole.normalizer
        self.bare = self.model.tokenizer()
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.by_segment = self.model.by_segment()
        self.plain = not self.model.charsmap and not self.model.remove_spaces
        self.known: dict[str, bytes] = {}
        #: Those of the known segments that the libraries encode differently.
        self.differ: set[str] = set()
        pieces = self.model.pieces
        self.begins = np.asarray([p.startswith(MARK) for p in pieces], bool)
        #: By id: whether the decoder takes the piece for a byte; the texts of the others, and of the runs of bytes met so far.
        self.byte = np.asarray([len(p.encode()) == 6 and p.startswith("<0x") and p.endswith(">") for p in pieces], bool)
        self.texts = self.bare.decode_batch([[i] for i in range(len(pieces))], skip_special_tokens=False)
        self.runs: dict[bytes, str] = {}

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in _LOADED:
            _LOADED[path] = cls(path)
        return _LOADED[path]

    def _normal(self, text: str) -> str:
        if not text:
            return ""
        if self.plain:
            return (MARK if self.model.dummy_prefix else "") + (text.replace(" ", MARK) if self.model.escape else text)
        return self.normalizer.normalize_str(text)

    def _other_ids(self, segments: list[str]) -> list[list[int] | None]:
        """The sentencepiece library's ids of normalised segments; it writes its prefix itself."""
        first = self.model.dummy_prefix
        # its prefix stands for the first marker; it writes none before an empty text
        led = [first and s.startswith(MARK) and s != MARK for s in segments]
        made = iter(self.other.encode([s[1:].replace(MARK, " ") for s, x in zip(segments, led, strict=True) if x], num_threads=1))
        return [next(made) if x else self._inner(s) for s, x in zip(segments, led, strict=True)]

    def _inner(self, segment: str) -> list[int] | None:
        """Ids of a segment that does not begin with the marker, by way of a line break before it; None where that merges with it."""
        lead = self.other.encode("\n")
        made = self.other.encode("\n" + segment.replace(MARK, " "))
        return made[len(lead) :] if made[: len(lead)] == lead else None

    def _ids(self, segments: list[str]) -> list[list[int]]:
        """The rebuilt tokenizer's ids of normalised segments."""

        def ids(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]

        # no merge reaches over a marker, so byte-pair ids of joined segments are those of each
        one = [s for s in segments if _ONE.fullmatch(s)] if self.model.model_type == BPE else []
        flat = list(itertools.chain.from_iterable(ids(["".join(one[i : i + JOINED]) for i in range(0, len(one), JOINED)])))
        cuts = np.flatnonzero(self.begins[np.asarray(flat, np.int64)]).tolist()
        found = dict(zip(one, (flat[a:b] for a, b in itertools.pairwise([*cuts, len(flat)])), strict=True)) if len(cuts) == len(one) else {}
        rest = [s for s in segments if s not in found]
        found.update(zip(rest, ids(rest), strict=True))
        return [found[s] for s in segments]

    def _learn(self, segments: list[str]) -> None:
        for i in range(0, len(segments), LEARN_AT_ONCE):
            some = segments[i : i + LEARN_AT_ONCE]
            made = self._ids(some)
            data = np.fromiter(itertools.chain.from_iterable(made), "<u4").tobytes()
            ends = itertools.accumulate((4 * len(ids) for ids in made), initial=0)
            self.known.update(zip(some, [data[a:b] for a, b in itertools.pairwise(ends)], strict=True))
            self.differ.update(s for s, ids, other in zip(some, made, self._other_ids(some), strict=True) if ids != other)

    def encode(self, texts: list[str]) -> list[tuple[bytes, int]]:
        """Little-endian ids of each text and how many of its segments the libraries encode differently."""
        if not self.by_segment:
            made = self.whole.encode_batch(texts, add_special_tokens=False)
            other = self.other.encode(texts, num_threads=1)
            return [(np.asarray(a.ids, "<u4").tobytes(), int(a.ids != b)) for a, b in zip(made, other, strict=True)]
        split = [_SEGMENT.findall(self._normal(x)) for x in texts]
        new = list(set(itertools.chain.from_iterable(split)) - self.known.keys())
        self._learn(new)
        out = [(b"".join(map(self.known.__getitem__, words)), sum(w in self.differ for w in words) if self.differ else 0) for words in split]
        if len(self.known) > KEPT:
            _forget(self.known, new)
            self.differ.difference_update(new)
        return out

    def decode(self, documents: list[np.ndarray]) -> list[str]:
        """Texts of the ids: pieces and fallback bytes joined, markers as spaces, without the prefix."""
        out = [self._text(ids) for ids in documents]
        if len(self.runs) > KEPT:
            self.runs.clear()
        return [x.removeprefix(" ") for x in out] if self.model.dummy_prefix else out

    def _text(self, ids: np.ndarray) -> str:
        byte = self.byte[ids]
        if not byte.any():
            return "".join(map(self.texts.__getitem__, ids.tolist()))
        out = []
        for a, b in itertools.pairwise([0, *(np.flatnonzero(byte[1:] != byte[:-1]) + 1).tolist(), len(ids)]):
            if not byte[a]:
                out.extend(map(self.texts.__getitem__, ids[a:b].tolist()))
                continue
            run = ids[a:b].tobytes()
            if run not in self.runs:
                self.runs[run] = self.bare.decode(ids[a:b].tolist(), skip_special_tokens=False)
            out.append(self.runs[run])
        return "".join(out)


def _forget(known: dict, keys: list) -> None:
    for key in keys:
        del known[key]


RESULT = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("n_differ", T.LongType()), T.StructField("decoded", T.StringType()), T.StructField("round_trip", T.BooleanType())])


def encode_documents(docs: DataFrame, model: str, text_col: str = "text", results: tuple[str, ...] = tuple(RESULT.names), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the columns of RESULT that are asked for."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT.names]
    schema = T.StructType([docs.schema[c] for c in keep] + [RESULT[c] for c in results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(model)
        for batch in batches:
            texts = [x or "" for x in batch.column(len(keep)).to_pylist()]
            made: dict[str, list] = {c: [] for c in RESULT.names}
            found = [(np.frombuffer(data, "<u4"), data, differ) for data, differ in encoder.encode(texts)]
            for text, (ids, data, differ), decoded in zip(texts, found, encoder.decode([x for x, _, _ in found]), strict=True):
                row = (ids.astype(np.int32), len(ids), zlib.crc32(data), differ, decoded, decoded == text)
                for c, value in zip(RESULT.names, row, strict=True):
                    made[c].append(value)
            kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_crc32": pa.int64(), "n_differ": pa.int64(), "decoded": pa.string(), "round_trip": pa.bool_()}
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(made[c], kinds[c]) for c in results]], schema.names)
        release()

    return small_batches(docs).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("_in_text")).mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids are summed up by their number and crc32; ``round_trip``: decoding gives the text again."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), results=("n_tokens", "ids_crc32", "n_differ", "round_trip"), keep=["doc_id"])
