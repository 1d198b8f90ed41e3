"""Token-id files: canonical length-limited Huffman coding of the ids of all documents.

A dataset of shards is written in ascending document order. A shard holds up to
``SHARD_TOKENS`` ids (a document is never cut), coded with one canonical code that follows from
the counts over all documents. Every ``BLOCK`` ids a bit offset is kept, so that a reader decodes
all blocks of a shard side by side with a table of ``2 ** MAX_BITS`` entries.

Defined results: null text counts as empty; an empty text has the end id alone; documents with
one id and repeated rows are all written, in order of their ids; a null id sorts first; an empty
table writes a dataset without shards; columns besides the two named ones are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epsgrid.llm.common import crc32, small_batches, table
from epsgrid.staging import stage

MAX_BITS = 18
BLOCK = 512
SHARD_TOKENS = 1 << 19
#: Distinct words whose ids a worker remembers.
WORDS_KEPT = 1_600_000
#: Words that go to the library in one call.
LEARN_AT_ONCE = 10_000

_SPACE, _BREAK, _LETTER, _DIGIT, _OTHER, _ODD = range(6)


def _classes() -> np.ndarray:
    """Classes of Latin-1 characters as the pre-tokenizer has them; _ODD where texts are left to the library."""
    out = np.full(256, _ODD, np.uint8)
    out[33:127] = _OTHER
    for low, high in ((65, 91), (97, 123), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x100)):
        out[low:high] = _LETTER
    out[48:58] = _DIGIT
    out[32], out[10], out[ord("'")] = _SPACE, _BREAK, _ODD  # apostrophes may begin contractions
    return out


_CLASS = _classes()
_PLAIN = bytes(np.flatnonzero(_CLASS != _ODD).tolist())
#: Longest run of characters that is cut into words at once.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BYTE_KEY = np.random.default_rng(3).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_ENCODERS: dict[str, Encoder] = {}


def word_starts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokenizer's words in texts laid end to end; ``first`` are the texts' starts.

    Its pattern takes runs of letters, of digits or of other marks, each with one space before it;
    of several blanks the last stands alone or leads the next word, those before it are a word, and
    blanks at the end of a text are one word.
    """
    kind = _CLASS[data]
    blank = kind <= _BREAK
    start = np.empty(len(data), bool)
    start[0] = True
    start[1:] = np.where(blank[1:], ~blank[:-1], (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE))
    last = np.zeros(len(data), bool)
    last[:-1] = blank[:-1] & ~blank[1:]
    last[first[1:] - 1] = False  # a text's end is no next word
    start[1:] |= last[1:] & blank[:-1]
    start[first] = True
    return np.flatnonzero(start)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64 and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def _room(a: np.ndarray, size: int) -> np.ndarray:
    """``a`` with space for so many values, doubled where it lacks it."""
    while len(a) < size:
        a = np.concatenate([a, np.zeros_like(a)])
    return a


class Encoder:
    """Ids of whole texts by the tokenizers library; every distinct word of plain text goes to it once.

    A byte-level pre-tokenizer cuts a text into words that are merged independently. Texts of known
    characters are cut here, all of a batch at once. Words are looked up by a 64-bit hash and every
    occurrence is then compared with the word itself; texts where a word is another's hash, all
    other texts, and those that hold the string of an added token are encoded by the library as
    they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        pre = told.get("pre_tokenizer") or {}
        self.by_word = told.get("normalizer") is None and told.get("post_processor") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [x["content"] for x in told.get("added_tokens", [])]
        self.dtype = dtype_of(self.tokenizer.get_vocab_size())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, self.dtype)
        self.begin = np.zeros(1 << 14, np.int64)  # of each word's ids in the pool; one more than words
        self.letters = np.zeros(1 << 18, np.uint8)  # the words themselves, end to end
        self.letter = np.zeros(1 << 14, np.int32)  # of each word's start among them

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _learn(self, keys: list[int], words: list[str]) -> None:
        made = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        cut = np.searchsorted(np.asarray(made.word_ids, np.int64), np.arange(1, len(words) + 1))
        ids = np.asarray(made.ids, self.dtype)
        n, end = len(self.known), int(self.begin[len(self.known)])
        told, last = np.frombuffer("".join(words).encode("latin-1"), np.uint8), int(self.letter[n])
        self.pool, self.letters = _room(self.pool, end + len(ids)), _room(self.letters, last + len(told))
        self.begin, self.letter = _room(self.begin, n + len(words) + 1), _room(self.letter, n + len(words) + 1)
        self.pool[end : end + len(ids)] = ids
        self.begin[n + 1 : n + len(words) + 1] = end + cut
        self.letters[last : last + len(told)] = told
        self.letter[n + 1 : n + len(words) + 1] = last + np.cumsum([len(w) for w in words])
        self.known.update(zip(keys, range(n, n + len(words)), strict=True))

    def _plain(self, text: str) -> bytes | None:
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return data if self.by_word and not data.translate(None, _PLAIN) and not any(a in text for a in self.added) else None

    def _same(self, word: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which occurrences are letter by letter the words that their hashes stand for."""
        size = (ends - starts).astype(np.int32)
        first = self.letter[word]
        same = self.letter[word + 1] - first == size
        at = np.repeat(first - starts.astype(np.int32), size) + np.arange(len(data), dtype=np.int32)
        differ = self.letters.take(at, mode="clip") != data
        if differ.any():
            same &= ~np.logical_or.reduceat(differ, starts)
        return same

    def _by_words(self, pieces: list[bytes]) -> list[np.ndarray | None]:
        """Ids of plain pieces, none of them empty; None where a word's hash is another's."""
        joined = b"".join(pieces)
        data = np.frombuffer(joined, np.uint8)
        sizes = np.asarray([len(x) for x in pieces], np.int64)
        first = np.cumsum(sizes) - sizes
        starts = word_starts(data, first)
        ends = np.append(starts[1:], len(data))
        power, inverse = _powers(1 << max(16, len(data).bit_length()))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_KEY[data] * power[: len(data)], out=sums[1:])
        keys = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
        order = np.argsort(keys)
        keys = keys[order]
        new_key = np.append(True, keys[1:] != keys[:-1])
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new_key) - 1
        at, keys = order[new_key], keys[new_key].tolist()
        if len(self.known) + len(keys) > WORDS_KEPT:
            self._forget()
        numbers = list(map(self.known.get, keys))
        if None in numbers:
            new = [k for k, n in enumerate(numbers) if n is None]
            text = joined.decode("latin-1")
            for i in range(0, len(new), LEARN_AT_ONCE):
                some = new[i : i + LEARN_AT_ONCE]
                self._learn([keys[k] for k in some], [text[a:b] for a, b in zip(starts[at[some]].tolist(), ends[at[some]].tolist(), strict=True)])
            numbers = list(map(self.known.__getitem__, keys))
        word = np.asarray(numbers, np.int64)[back]
        same = self._same(word, data, starts, ends)
        begin, many = self.begin[word], self.begin[word + 1] - self.begin[word]
        upto = np.cumsum(many)
        ids = self.pool[np.repeat(begin - upto + many, many) + np.arange(upto[-1])]
        edge = np.searchsorted(starts, first)
        made: list[np.ndarray | None] = [*np.split(ids, upto[edge[1:] - 1])]
        for i in np.flatnonzero(~np.logical_and.reduceat(same, edge)).tolist() if not same.all() else ():
            made[i] = None
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of the width that the vocabulary needs."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        rest: set[int] = set()
        owners: list[int] = []
        pieces: list[bytes] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if pieces:
                for i, ids in zip(owners, self._by_words(pieces), strict=True):
                    if ids is None:
                        rest.add(i)
                    else:
                        parts[i].append(ids)
            owners.clear()
            pieces.clear()
            held = 0

        for i, text in enumerate(texts):
            data = self._plain(text)
            if data is None:
                rest.add(i)
                continue
            for piece in plain_pieces(data):
                if held + len(piece) > 2 * PIECE:
                    flush()
                owners.append(i)
                pieces.append(piece)
                held += len(piece)
        flush()
        out = [(x[0] if len(x) == 1 else np.concatenate(x)).tobytes() if x else b"" for x in parts]
        if rest:
            left = sorted(rest)
            for i, made in zip(left, self.tokenizer.encode_batch([texts[i] for i in left], add_special_tokens=False), strict=True):
                out[i] = np.asarray(made.ids, self.dtype).tobytes()
        return out


_BEFORE_SPACE = re.compile(rb"[^ \n](?= )")


def plain_pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A text cut where a word surely ends: between a mark or letter and a space."""
    start = 0
    while len(data) - start > size:
        found = _BEFORE_SPACE.search(data, start + size)
        if not found:
            break
        yield data[start : found.end()]
        start = found.end()
    if start < len(data):
        yield data[start:]


def dtype_of(vocabulary: int) -> np.dtype:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


@functools.cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _squeeze(ids: bytes, width: int) -> bytes:
    """Byte planes, compressed: what is shuffled is near the size of the coded ids."""
    planes = np.frombuffer(ids, np.uint8).reshape(-1, width).T.tobytes()
    return _zstd()[0].compress(planes)


def _unsqueeze(data: bytes, width: int) -> bytes:
    return np.frombuffer(_zstd()[1].decompress(data), np.uint8).reshape(width, -1).T.tobytes()


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)``: the compressed ids of every text with the end id behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        width = encoder.dtype.itemsize
        end = np.asarray([end_id], encoder.dtype).tobytes()
        for batch in batches:
            sizes, ids = [], []
            for text_ids in encoder.encode([x or "" for x in batch.column(1).to_pylist()]):
                sizes.append(len(text_ids) // width + 1)
                ids.append(_squeeze(text_ids + end, width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """``(id, n)`` over all documents, summed within each task before the shuffle."""
    width, dtype = dtype_of(vocabulary).itemsize, dtype_of(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            ids = b"".join([_unsqueeze(x, width) for x in batch.column(0).to_pylist()])
            total += np.bincount(np.frombuffer(ids, dtype), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids need more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(max_bits):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        merged = both[at]
        half = len(merged) // 2
        packages = merged[: 2 * half : 2] + merged[1 : 2 * half : 2]
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        leaf = int(is_leaf[:take].sum())
        lengths[order[:leaf]] += 1
        take = 2 * (take - leaf)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then of id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code = last = 0
    for i in order.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length for each value of the next ``bits`` bits."""
    bits = max(1, int(lengths.max(initial=1)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (bits - lengths[order])
    ids, sizes = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint8)
    ids[: span.sum()] = np.repeat(order, span)
    sizes[: span.sum()] = np.repeat(lengths[order], span)
    return ids, sizes, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The coded bits and the bit offset of every block."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths.astype(np.uint8)[ids]
    ends = np.cumsum(size, dtype=np.int64)
    starts = ends - size
    word = starts >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    # codes are set against the left end of 64 bits, moved to their bit, and summed by their first word
    placed = (codes << (64 - lengths).astype(np.uint64))[ids]
    placed >>= (starts & 31).astype(np.uint64)
    summed, at = np.add.reduceat(placed, first), word[first]
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    out[at] = summed >> np.uint64(32)
    out[at + 1] += summed & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes()[: int(ends[-1] + 7) // 8], starts[::block]


def unpack(payload: bytes, offsets: np.ndarray, n: int, made: tuple[np.ndarray, np.ndarray, int], block: int = BLOCK) -> np.ndarray:
    """All blocks are decoded in step, one id of each block at a time."""
    if not n:
        return np.zeros(0, np.uint32)
    ids, sizes, bits = made
    data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    at = offsets.astype(np.int64)
    out = np.zeros((len(at), block), np.uint32)
    mask, lanes = np.uint32((1 << bits) - 1), len(at)
    last = n - (len(at) - 1) * block
    for k in range(min(block, n)):
        if k == last:
            lanes -= 1
            at = at[:lanes]
        key = (window[at >> 3] >> (32 - bits - (at & 7)).astype(np.uint32)) & mask
        out[:lanes, k] = ids[key]
        at = at + sizes[key]
    return out.reshape(-1)[:n]


SHARD_SCHEMA = "part int, part_start long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, block_bits array<bigint>, payload binary, crc long"


def write_shards(tokens: DataFrame, lengths: np.ndarray, vocabulary: int) -> DataFrame:
    """The shards, staged in ascending document order; a row is a shard."""
    dtype = dtype_of(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part, start = canonical_codes(lengths), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []

        def shard() -> pa.RecordBatch:
            nonlocal start, held
            ids = np.concatenate([x for _, x in held])
            payload, bits = pack(ids, codes, lengths)
            row = [part, start, len(ids), [d for d, _ in held], [len(x) for _, x in held], bits.tolist(), payload, crc32(payload)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64()]
            start, held = start + len(ids), []
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in SHARD_SCHEMA.split(", ")])

        size = 0
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(_unsqueeze(data.as_py(), dtype.itemsize), dtype)
                if held and size + len(ids) > SHARD_TOKENS:
                    yield shard()
                    size = 0
                held.append((doc, ids))
                size += len(ids)
        if held:
            yield shard()

    ordered = tokens.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return stage(ordered.mapInArrow(run, SHARD_SCHEMA), "id-shards", "uncompressed")


def read_shards(shards: DataFrame, lengths: np.ndarray, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` decoded from the shards; ids little-endian unsigned 32-bit.

    With ``digest`` there is ``ids_crc32`` in place of the ids, which then stay in their task.

    The ids before each task's part are summed on the driver: one number for each written part.
    """
    totals = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, run_total = {}, 0
    for part in sorted(totals):
        before[part] = run_total
        run_total += totals[part]

    name = "ids_crc32" if digest else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = decoding_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                part, part_start, n, docs, sizes, bits, payload, crc = (c[i].as_py() for c in batch.columns)
                if crc32(payload) != crc:
                    raise ValueError(f"shard of part {part} at {part_start} is damaged")
                ids = unpack(payload, np.asarray(bits, np.int64), n, made).astype("<u4")
                ends = np.cumsum(np.asarray(sizes, np.int64))
                begin = ends - sizes
                cut = [ids[a:b].data for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]
                last = pa.array([crc32(x) for x in cut], pa.int64()) if digest else pa.array([x.tobytes() for x in cut], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begin + before[part] + part_start, pa.int64()), pa.array(sizes, pa.int64()), last], ["doc_id", "start", "n_tokens", name])

    return shards.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {'long' if digest else 'binary'}")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, max_bits: int = MAX_BITS) -> tuple[DataFrame, np.ndarray]:
    """Tokenise, count, code and write; the shards and the code lengths of the ids."""
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    tokens = stage(tokenise(docs, tokenizer, end_id), "ids", "uncompressed")
    counts = np.zeros(vocabulary, np.int64)
    for row in id_counts(tokens, vocabulary).collect():  # at most a row for each id of the vocabulary
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts, max_bits)
    return write_shards(tokens, lengths, vocabulary), lengths


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shards, lengths = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(shards, lengths, digest=True)
