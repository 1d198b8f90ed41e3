"""Quality, language, pieces, token files, media and html."""

import hashlib
import itertools
import random
import struct
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from epsgrid.llm import html_text as H
from epsgrid.llm import language as G
from epsgrid.llm import media as M
from epsgrid.llm import pieces as P
from epsgrid.llm import quality as Q
from epsgrid.llm import token_files as K
from tests.llm.conftest import frame

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "a\n\n b\n", "don't we'll", "<|endoftext|> x", "日本語 𝒳", "tab\there", "é" * 30, "x" * 3000, "\x00a", "▁ mark", "a" + " " * 37 + "b "]


# quality


def test_quality_on_held_out_documents(spark, sf):
    d = sf.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = Q.op1(spark, d).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_quality_edge_cases(spark, documents):
    df = frame(spark, [*documents[:40], (None, "x"), (7000, None), (7001, ""), (7002, "word " * 30_000)])
    stats = Q.document_statistics(df).withColumn("score", F.lit("clash"))
    none = Q.fit(stats, frame(spark, [], "doc_id long, quality int"), F.lit(True))
    assert {r["score"] for r in Q.score(stats, none).collect()} == {0.5}
    labels = frame(spark, [(0, 1), (0, 1), (1, None), (999_999, 0)], "doc_id long, quality int")
    assert {r["score"] for r in Q.score(stats, Q.fit(stats, labels, F.lit(True))).collect()} == {1.0}
    labels = frame(spark, [(d, d % 2) for d, _ in documents[:40]], "doc_id long, quality int")
    got = Q.score(stats, Q.fit(stats, labels, F.lit(True)))
    assert got.count() == 44 and got.where("score between 0 and 1").count() == 44
    assert Q.score(stats.limit(0), none).count() == 0


def test_pool_adjacent():
    assert Q.pool_adjacent(np.array([1.0, 0, 2, 1, 3]), np.array([1.0, 1, 1, 3, 1])).tolist() == [0.5, 0.5, 1.25, 1.25, 3]


# language


def test_gradients_by_differences():
    p = {k: v.astype(np.float64) for k, v in G.initial(3, 4).items()}
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, (9, 5)).astype(np.int16)
    data[6:, 2] = 256
    label = np.array([0, 1, 2, 0, 1])
    _, grad = G.gradients(p, data, data != 256, label)
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(grad[k])), grad[k].shape)
        loss = []
        for step in (1e-3, -1e-3):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += step
            loss.append(G.gradients(q, data, data != 256, label)[0])
        assert grad[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=2e-2)


def test_language_on_held_out_documents(spark, sf):
    d = sf.replace("0.001", "0.01")
    lang = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = G.op8(spark, d).where("held_out").join(lang, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)


def test_language_edge_cases(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    langs, params = G.fit(docs, F.lit(True), train_docs=80)
    text = docs.first()["text"]
    rows = [(1, None), (2, ""), (3, "12 -- 34 !"), (4, text), (5, text), (6, "ß"), (7, text * 60), (None, text)]
    got = {r["doc_id"]: r for r in G.identify(frame(spark, rows).withColumn("score", F.lit("x")), langs, params).collect()}
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][2:] == got[5][2:] == got[None][2:] and got[4]["lang_pred"] in langs and got[6]["lang_pred"] in langs
    assert G.fit(docs.where("lang is null"), F.lit(True)) == ([], None)
    assert G.identify(frame(spark, rows), [], None).where("lang_pred <> 'und'").count() == 0
    assert G.identify(frame(spark, rows).limit(0), langs, params).count() == 0


def test_numerals_are_no_letters(spark):
    texts = ["½²Ⅷ①", "12 ½", "½ a", "ª", "日", "_", "²é"]
    assert [G.has_letter(x) for x in texts] == [False, False, True, True, True, False, True]
    got = {r["doc_id"]: r["lang_pred"] for r in G.identify(frame(spark, list(enumerate(texts))), ["x", "y"], G.initial(2, 4)).collect()}
    assert [got[i] == "und" for i in range(len(texts))] == [True, True, False, False, False, True, False]


def test_samples_do_not_vanish_at_any_count(spark):
    """Bounds on draws, and rows taken of a table that is told to be of 10 billion rows."""
    from epsgrid.llm.common import DRAWS, draw, draw_below

    for count in (1, 50, 10**6, 10**10, 10**15):
        share = draw_below(1000, count) / DRAWS
        assert share * count >= min(count, 4039)
    rows = spark.range(3000).selectExpr("if(id < 2990, 'a', 'b') as lang", "id", "cast(if(id < 1000, 7, id) as string) as w").withColumn("draw", draw("w"))
    many = G.sample(rows, {"a": 10**10, "b": 10}, 40)
    least = sorted({(r["draw"], r["w"]) for r in rows.where("lang = 'a'").collect()})[:40]
    assert many == sorted([("a", w) for _, w in least] + [("b", str(i)) for i in range(2990, 3000)])


def test_pooled_result_does_not_depend_on_neighbours():
    p = G.initial(2, 4)
    texts = [bytes([i % 256] * (i * 7)) for i in range(60)]
    together = G.pooled(p, texts)
    assert all((G.pooled(p, [t])[0] == together[i]).all() for i, t in enumerate(texts))


# token files


def test_token_files_by_brute_force(spark, documents, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(K, "SHARD_TOKENS", 4000)
    tokenizer = Tokenizer.from_file(BPE)
    rows = documents + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None), (20_001, "word " * 20_000), (None, "first")]
    rows.sort(key=lambda r: (r[0] is not None, r[0]))
    want, start = [], 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    random.Random(1).shuffle(rows)
    shards, lengths = K.encode_documents(frame(spark, rows).repartition(5), BPE)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in K.read_shards(shards, lengths).where("doc_id is not null").collect())
    assert got == want[1:]
    digests = {r["doc_id"]: r["ids_crc32"] for r in K.read_shards(shards, lengths, digest=True).collect()}
    assert digests == {d: zlib.crc32(x) for d, _, _, x in want}
    assert shards.count() > 5


def test_token_files_repeated_ids_and_empty_table(spark):
    df = frame(spark, [(1, "b", 0), (1, "a", 0), (1, "a", 0), (2, "", 0)], "doc_id long, text string, start int")
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in K.read_shards(*K.encode_documents(df, BPE)).collect())
    assert got == [(1, 0, 2), (1, 2, 2), (1, 4, 2), (2, 6, 1)]
    assert K.read_shards(*K.encode_documents(df.limit(0), BPE)).count() == 0


def test_words_are_cut_as_the_library_does():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(BPE), K.Encoder(BPE)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab1 \n\n  .,'é!") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert encoder.encode(texts) == [np.asarray(x.ids, "<u2").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    long = " ".join(texts[20:]).replace("'", "")
    pieces = list(K.plain_pieces(long.encode("latin-1"), 50))
    assert len(pieces) > 500 and b"".join(pieces).decode("latin-1") == long
    assert np.concatenate(encoder._by_words(pieces)).tolist() == tokenizer.encode(long, add_special_tokens=False).ids


def test_words_with_one_hash_get_their_own_ids():
    """Words after Thue and Morse have one polynomial hash, whatever its base."""
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(BPE), K.Encoder(BPE)
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    texts = [f"x {one} y", f"x {other} y", other, one, "plain words"]
    want = [np.asarray(x.ids, "<u2").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    assert [encoder.encode([t])[0] for t in reversed(texts)] == want[::-1]
    encoder.known = dict.fromkeys(encoder.known, 0)  # every known word is taken for the first one
    assert encoder.encode(texts) == want


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(5)
    for counts in (rng.integers(0, 50, 40), np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89]), np.array([0, 7, 0]), np.array([3, 4])):
        free = K.code_lengths(counts, 18)
        heap = sorted(int(c) for c in counts if c)
        cost = 0 if len(heap) > 1 else sum(heap)
        while len(heap) > 1:
            heap = sorted([heap[0] + heap[1], *heap[2:]])
            cost += heap[0] if len(heap) == 1 else 0
        merged = sorted(int(c) for c in counts if c)
        total = 0
        while len(merged) > 1:
            a, b, *rest = merged
            total += a + b
            merged = sorted([a + b, *rest])
        assert (free * counts).sum() == (total or cost)
        short = K.code_lengths(counts, 6)
        assert short.max() <= 6 and sum(2.0 ** -x for x in short[short > 0]) <= 1
    with pytest.raises(ValueError, match="more than 2 bits"):
        K.code_lengths(np.ones(5, int), 2)


def test_pack_and_unpack():
    rng = np.random.default_rng(6)
    ids = rng.zipf(1.3, 5000) % 700
    lengths = K.code_lengths(np.bincount(ids, minlength=700), 11)
    for n in (0, 1, 511, 512, 513, 5000):
        payload, offsets = K.pack(ids[:n], K.canonical_codes(lengths), lengths)
        assert (K.unpack(payload, offsets, n, K.decoding_table(lengths)) == ids[:n]).all()


# pieces


def test_pieces_equal_the_other_library(spark, documents):
    from sentencepiece import SentencePieceProcessor

    other = SentencePieceProcessor(model_file=PIECES)
    rows = documents + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, None), (20_001, "a " * 20_000), (None, "x")]
    got = {r["doc_id"]: r for r in P.encode_documents(frame(spark, rows).withColumn("ids", F.lit("clash")), PIECES).collect()}
    for doc, text in rows:
        assert got[doc]["ids"] == other.encode(text or ""), text
        assert got[doc]["decoded"] == other.decode(other.encode(text or ""))
        assert got[doc]["round_trip"] == (P.MARK not in (text or ""))
        assert got[doc]["n_differ"] == 0
    assert P.encode_documents(frame(spark, rows).limit(0), PIECES).count() == 0


def test_pieces_and_runs_of_bytes_are_decoded_once(documents, monkeypatch):
    """Any ids decode as the whole sequence does; the decoder is not asked for every text anew."""
    rng = np.random.default_rng(8)
    encoder = P.PieceEncoder(PIECES)
    n = len(encoder.model.pieces)
    texts = [t or "" for _, t in documents] + ODD
    sequences = [np.frombuffer(x, "<u4") for x, _ in encoder.encode(texts)]
    sequences += [rng.integers(0, top, size).astype("<u4") for top in (n, 400) for size in range(40)]
    want = encoder.whole.decode_batch([x.tolist() for x in sequences], skip_special_tokens=False)
    assert encoder.decode(sequences) == want
    met = len(encoder.runs)
    assert encoder.decode(sequences[::-1]) == want[::-1]
    assert 0 < len(encoder.runs) == met < len(sequences) * 20
    monkeypatch.setattr(P, "KEPT", 5)
    fresh = P.PieceEncoder(PIECES)
    assert [x for s in range(0, len(sequences), 7) for x in fresh.decode(sequences[s : s + 7])] == want
    assert [x for t in texts[:60] + ODD for x in fresh.encode([t])] == encoder.encode(texts[:60] + ODD)
    assert len(fresh.runs) <= 5 and len(fresh.known) <= 5


def test_joined_segments_have_the_ids_of_each(documents):
    encoder = P.PieceEncoder(PIECES)
    segments = sorted({s for t in [t or "" for _, t in documents] + ODD for s in P._SEGMENT.findall(encoder._normal(t))})
    calls, alone = [], [encoder.bare.encode(s, add_special_tokens=False).ids for s in segments]
    library = encoder.bare.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, **more):
            calls.extend(texts)
            return library(texts, **more)

    encoder.bare = Counted()
    assert encoder._ids(segments) == alone
    assert len(calls) < len(segments) / 10
    encoder.begins[:] = False  # segments that can't be told apart again go one by one
    assert encoder._ids(segments) == alone


def _message(*fields):
    def number(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    out = b""
    for key, value in fields:
        if isinstance(value, bytes):
            out += number(key << 3 | 2) + number(len(value)) + value
        elif isinstance(value, float):
            out += number(key << 3 | 5) + struct.pack("<f", value)
        else:
            out += number(key << 3) + number(value)
    return out


def test_unigram_model(tmp_path):
    """A model written field by field; both libraries take the best-scored cut."""
    from sentencepiece import SentencePieceProcessor

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [("▁", -2.0, 1), ("a", -3.0, 1), ("b", -3.1, 1), ("▁ab", -2.5, 1), ("ab", -4.0, 1), ("ba", -4.2, 1), ("bb", -9.0, 1)]
    data = b"".join(_message((1, _message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    data += _message((2, _message((3, 1), (4, len(pieces)), (35, 1), (40, 0), (41, 1), (42, 2))), (3, _message((1, b"identity"), (3, 1), (4, 0), (5, 1))))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    other, encoder = SentencePieceProcessor(model_file=str(path)), P.PieceEncoder(str(path))
    texts = ["".join(t) for n in range(5) for t in itertools.product("ab é", repeat=n)]
    for text, (ids, differ) in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.whole.encode(text).ids
        assert encoder.decode([np.frombuffer(ids, "<u4")]) == [text]
        assert (differ == 0) == (encoder.whole.encode(text).ids == other.encode(text))
    assert encoder.model.model_type == P.UNIGRAM and encoder.model.scores[-1] == -9.0


# media


def test_media_by_brute_force(spark, documents):
    rng = random.Random(3)
    big = "".join(rng.choice("abcdefgh \n") for _ in range(60_000))
    rows = documents + [(10_000, None), (10_001, ""), (10_002, big), (10_003, "new head " + big), (10_004, big), (10_004, "twice"), (None, "x" * 64)]
    df = frame(spark, rows, "doc_id long, text string").withColumn("digests", F.lit(1)).repartition(4)
    store = M.write_store(df)
    found = {r["media_sha256"]: r for r in M.assemble(store).collect()}
    recipes = store.recipes.collect()
    assert len(recipes) == len(rows)
    want = {}
    for doc, text in rows:
        n, payload = M.padded(text)
        media = M.to_media(payload)
        assert len(payload) % 64 == 0 and len(payload) >= 64
        want[hashlib.sha256(media).hexdigest()] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), M.feature(payload))
    assert {k: (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["feature"]) for k, r in found.items()} == want
    # both long texts share all but their first chunks
    lists = {r["doc_id"]: r["digests"] for r in recipes}
    assert len(set(map(bytes, lists[10_003])) - set(map(bytes, lists[10_002]))) <= 2 < len(lists[10_002])
    assert store.chunks.count() == len({bytes(d) for r in recipes for d in r["digests"]})
    assert M.assemble(M.write_store(df.limit(0))).count() == 0


def test_chunks_that_many_files_share(spark, monkeypatch):
    monkeypatch.setattr(M, "HOT_ROWS", 5)
    rng = random.Random(7)
    big = "".join(rng.choice("abcdefgh \n") for _ in range(90_000))
    rows = [(i, big + f" end {i}") for i in range(12)] + [(100 + i, f"text {i}") for i in range(30)]
    store = M.write_store(frame(spark, rows).repartition(4))
    assert M.hot_digests(store)
    found = {r["media_sha256"]: r["payload_sha256"] for r in M.assemble(store).collect()}
    payloads = [M.padded(t)[1] for _, t in rows]
    assert found == {hashlib.sha256(M.to_media(x)).hexdigest(): hashlib.sha256(x).hexdigest() for x in payloads}


def test_cut_points_cover_and_keep_their_bounds():
    data = np.random.default_rng(1).integers(0, 256, 300_000).astype(np.uint8).tobytes()
    for text in (data, bytes(200_000), b"", b"x", data[: M.LEAST + 1]):
        ends = M.cut_points(text)
        sizes = np.diff([0, *ends])
        assert sum(sizes) == len(text) and (sizes <= M.MOST).all() and (sizes[:-1] >= M.LEAST).all()
    h, expected = 0, []
    for i, b in enumerate(data[:5000]):
        h = ((h << 1) + int(M._GEAR[b])) & 0xFFFFFFFF
        if h >> (32 - M.CUT_BITS) == 0 and i >= 31:
            expected.append(i + 1)
    wide = M.cut_points(data[:5000], least=1, most=10**9)
    assert [e for e in wide if 32 <= e < 5000] == [e for e in expected if e < 5000]


def test_damaged_media_is_told():
    media = M.to_media(M.padded("abc")[1])
    assert M.from_media(media)[:3] == b"abc"
    with pytest.raises(ValueError):
        M.from_media(media[:-1])


# html


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a></nav>", ""),
        ("<p>One &amp; two<br>three&nbsp; four<script>var t='</p>';</script><p>five &am", "One & two three four\nfive &am"),
        ("<title>T</title><header>Site</header><article><h1>Head</h1><p>Body <b>bold</b>.</article><footer>&copy;</footer>", "Head\nBody bold."),
        ("<main><div class='ad'>buy</div><p>Text one.</p><aside>side</aside><section id=\"comments\"><p>I agree, very good text.</p></section></main>", "Text one."),
        ("<article><p>Kept text, all of it.</p><div class=cookie-notice>We use cookies</div><form>Name <input></form><p>x</p></article>", "Kept text, all of it.\nx"),
        ("<article><!-- <p>no</p> --><p title='a>b'>yes</p><style>p{}</style><ul><li>one<li>two</ul><article class=comment>no</article></article>", "yes\none\ntwo"),
        ("<article><p>cut off <a hre", "cut off"),
        ("<article><p>a<!-- open", "a"),
        ("<div class='menu-wrapper'><div id='content'><p>An article that is here, with a few words.</p></div></div>", "An article that is here, with a few words."),
        ("<div class='layout has-sidebar'><main><p>Main text.</p></main><div class=sidebar>Some more, to read.</div></div>", "Main text."),
        ("<div><a href=a>Home</a> <a href=b>News</a></div><header><h1>The title</h1></header><div><p>A text of some words, which goes on.</p><p>And on, for a while.</p></div>", "The title\nA text of some words, which goes on.\nAnd on, for a while."),
        ("<article><h2 id=banner>A heading</h2><p>Its text, of some words.</p><p class=ad>Buy this, it is very good.</p></article>", "A heading\nIts text, of some words."),
        ("<header><h1>Site</h1></header><div>Unnamed words outside</div><article><h1>Head</h1><p>Text of it.</p></article>", "Head\nText of it."),
        ("<form><main><p>All of the page is in a form.</p></main><div class='ad-container'>No, thank you, not that.</div></form>", "All of the page is in a form."),
    ],
)
def test_extraction(html, text):
    pages = ["<nav><a>m</a></nav><article><p>Some words, and more.</p></article><footer>f</footer>"] * 3
    assert H.extract(html, H.fit_text(pages)) == text
    assert H.extract(html, H.fit_text([])) == text


class _Article(HTMLParser):
    """The text of <article> by the standard library's parser, for pages that have one."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "h2", "h3", "li", "ul", "ol", "div", "blockquote", "article"):
            self.lines.append("")
        elif tag in ("br", "td"):
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "h2", "h3", "li", "ul", "ol", "div", "blockquote", "article"):
            self.lines.append("")

    def handle_data(self, data):
        if self.inside > 0:
            self.lines[-1] += data


def test_pages_of_a_table(spark, sf):
    d = sf.replace("0.001", "0.01")
    rows = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.op4(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        brute = _Article()
        brute.feed(p["html"])
        brute.close()
        text = "\n".join(x for x in (" ".join(line.split()) for line in brute.lines) if x)
        assert rows[p["page_id"]] == (text, len(text))


def test_long_pages_of_unclosed_elements_take_linear_time():
    pages = ["<div>" * n + "</section>" * n + "<h1>" * n + "<li>a</li>" * n for n in (500, 8000)]
    took = []
    for page in pages:
        began = time.process_time()
        H.blocks_of(page)
        took.append(time.process_time() - began)
    assert took[1] < 60 * took[0] + 0.5


def test_the_cut_overturns_names_and_text():
    """One short line without marks among five that are surely text, under names that speak against all a little."""
    page = "<div class='menu-wrapper'>" + "<p>A sentence of many words, which goes on and on for a while, until it ends.</p>" * 2 + "<p>x <a>y</a></p>" + "<p>A sentence of many words, which goes on and on for a while, until it ends.</p>" * 2 + "</div>"
    blocks = H.blocks_of(page)
    assert blocks[2].odds + H.text_features(blocks[2]) @ np.asarray(H.PRIOR) < 0
    assert H.extract(page, np.asarray(H.PRIOR)).count("\n") == 4


def test_minimum_cut_by_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda x: sum(-g for g, s in zip(gain, x, strict=True) if s) + sum(c for a, b, c in edges if x[a] != x[b])  # noqa: B023, E731
        best = min(cost(x) for x in itertools.product((False, True), repeat=n))
        assert cost(H.label(gain, edges)) == pytest.approx(best)
        assert cost(H.max_flow_side(gain, edges)) == pytest.approx(best)


def test_pages_edge_cases(spark):
    df = frame(spark, [(1, None, 1), (1, "<article><p>" + "word " * 50_000, 2)], "page_id long, html string, n_chars int").withColumn("text", F.lit("old"))
    got = sorted((r["page_id"], r["n_chars"]) for r in H.extract_pages(df).collect())
    assert got == [(1, 0), (1, 249_999)]
    assert H.extract_pages(df.limit(0)).count() == 0
