"""Line dedup, near duplicates, decontamination and licences against brute force."""

import hashlib
import itertools
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from epsgrid.llm import decontaminate as D
from epsgrid.llm import licences as C
from epsgrid.llm import line_dedup as L
from epsgrid.llm import near_dup as N
from epsgrid.operators import components as M
from tests.llm.conftest import frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# line dedup


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    rows = [(-(1 << 63) if doc is None else doc, text) for doc, text in rows]
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            holders.setdefault(k, set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


LINE = "A line that is long enough"
CASES = [
    (1, f"{LINE}\nshort\n{LINE}"),
    (2, f"  {LINE.upper()}\t\nown words of two, long enough"),
    (3, None),
    (4, f"{LINE}\r\n\nx"),
    (5, ""),
    (6, "É" * 19 + "\n" + "É" * 20),
    (7, "É" * 20),
    (8, "É" * 20 + "\n" + "é" * 20),
    (9, "\n\n"),
    (10, LINE),
    (11, "two only, but long enough here"),
    (12, "two only, but long enough here"),
]


def test_lines_by_brute_force(spark):
    got = sorted(tuple(r) for r in L.dedup_lines(frame(spark, CASES)).collect())
    assert got == brute_lines(CASES)
    assert {d: n for d, _, _, n in got if n} == {1: 2, 2: 1, 4: 1, 6: 1, 7: 1}


def test_lines_of_a_table(spark, documents):
    assert sorted(tuple(r) for r in L.dedup_lines(frame(spark, documents).repartition(5)).collect()) == brute_lines(documents)


def test_lines_with_many_groups_and_shards(spark, documents, monkeypatch):
    monkeypatch.setattr(L, "GROUP_DOCS", 9)
    monkeypatch.setattr(L, "SHARD_KEYS", 20)
    monkeypatch.setattr(L, "PROBE_ROWS", 15)
    assert sorted(tuple(r) for r in L.dedup_lines(frame(spark, documents)).collect()) == brute_lines(documents)


def test_lines_other_columns_ties_and_empty_table(spark):
    rows = [(1, LINE, "a", 5), (1, LINE, "b", 6), (2, LINE, None, 7), (None, LINE, "c", None), (None, LINE, "d", None)]
    df = frame(spark, rows, "doc_id long, text string, n_lines string, h int")
    got = L.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "h", "n_lines", "n_dropped"]
    assert sorted(((r["doc_id"] or 0, r["h"] or 0, r["n_dropped"], r["text"]) for r in got.collect())) == [(0, 0, 1, ""), (0, 0, 1, ""), (1, 5, 1, ""), (1, 6, 1, ""), (2, 7, 0, LINE)]
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_lines_of_repeated_ids_are_of_one_document(spark):
    """Two documents of three rows keep a line, three documents of six rows lose it, in the code and in its SQL."""
    other = "another line that is long enough"
    rows = [(1, f"{LINE}\n{other}"), (1, LINE), (2, LINE), (2, other), (1, other), (3, other), (None, f"only here and {other}"), (None, f"only here and {other}"), (4, f"only here and {other}")] + [(9, "x")] * 40
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in L.dedup_lines(frame(spark, rows).repartition(5)).collect())
    assert [x[:3] for x in got][:9] == [(0, 1, 0)] * 2 + [(1, 1, 0), (1, 1, 1), (1, 2, 1), (2, 1, 0), (2, 1, 1), (3, 1, 0), (4, 1, 0)]
    con = duckdb.connect()
    documents = pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], "Int64"), "text": [t for _, t in rows]})  # noqa: F841
    assert sorted((r[0] or 0, *r[1:]) for r in con.sql(L.OP10_SQL).fetchall()) == got


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 62, (5000, 2))
    keys[:50, 0] = 7
    index = L.PerfectHash(*L.build_hash(keys))
    assert sorted(index(keys)) == list(range(len(keys)))
    assert (index(keys + 1) < len(keys)).all()


# near duplicates


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows, k, num, den):
    sets = {d: shingles(t, k) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_by_brute_force(spark, documents, k, num):
    words = [f"w{i}" for i in range(60)]
    more = [(10_000 + i, " ".join(words[: 60 - i % 4] + [f"x{j}{i}" for j in range(i % 7)])) for i in range(90)]
    rows = documents + more + [(20_000, None), (20_001, ""), (20_002, " \t\n"), (20_003, "One two"), (20_004, "one TWO"), (20_005, "one")]
    got = N.near_duplicates(frame(spark, rows).repartition(6), words=k, threshold=(num, 100))
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, k, num, 100)


@pytest.mark.parametrize("most", [6, 16])
def test_near_duplicates_in_large_groups(spark, monkeypatch, most):
    """Buckets and components that are dealt in blocks, of copies that hang together and of ones that partly do."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 10)
    monkeypatch.setattr(N, "GATHER_ROWS", 7)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(120):
        w = list(base)
        for at in rng.integers(0, 80, rng.integers(0, most)):
            w[at] = f"y{d}"
        rows.append((d, " ".join(w)))
    got = N.near_duplicates(frame(spark, rows), words=3, threshold=(85, 100))
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, 3, 85, 100)


@pytest.mark.parametrize("merged", [0, N.MERGED])
def test_rounds_are_for_large_forests_only(spark, documents, monkeypatch, merged):
    rounds, stars = [], M._star_rounds
    monkeypatch.setattr(M, "_star_rounds", lambda edges: rounds.append(1) or stars(edges))
    monkeypatch.setattr(N, "MERGED", merged)
    monkeypatch.setattr(N, "BLOCK_ROWS", 10)
    rows = documents[:300] + [(10_000 + i, " ".join(f"w{j}" for j in range(60 + i % 40))) for i in range(80)]
    got = N.near_duplicates(frame(spark, rows), words=3, threshold=(85, 100))
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows, 3, 85, 100)
    assert bool(rounds) == (merged == 0)


def test_links_are_verified_as_all_pairs_would_be():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.choice(60, 50)).astype(np.uint64) for _ in range(60)]
    i, j = np.triu_indices(60, 1)
    want = [(a, b) for a, b in zip(i, j, strict=True) if 100 * N.common(sets[a], sets[b]) >= 50 * len(np.union1d(sets[a], sets[b]))]
    assert all(N.common(sets[a], sets[b]) == len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True))
    u, v = N.verified(i, j, sets, 50, 100)
    assert set(zip(u, v, strict=True)) <= set(want)
    parts = [dict(zip(*map(list, N.forest(np.asarray(x), np.asarray(y))), strict=True)) for x, y in ((u, v), zip(*want, strict=True))]
    assert parts[0] == parts[1] and len(u) <= 59


def test_near_duplicates_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    other = text.replace("h", "h i j k l m n o p q r s t u v w x y z")
    rows = [(None, text), (3, text), (3, text), (5, text), (6, "z"), (7, other), (3, None), (5, other), (8, None), (9, "q"), (9, other + " 1")]
    df = frame(spark, [(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, root int")
    got = sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=str)
    want = [(None, 4, None, True), (3, 4, 3, True), (3, 4, 3, True), (5, 4, 3, False), (6, 1, 6, True), (7, 22, 3, False), (3, 0, 3, True), (5, 22, 3, False), (8, 0, 8, True), (9, 1, 3, False), (9, 23, 3, False)]
    assert got == sorted(want, key=str)
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_posterior_bounds_keep_pairs_at_the_threshold():
    for n, least in N.least_matches(0.85, 240):
        draws = np.random.default_rng(n).binomial(n, 0.85, 20_000)
        assert (draws >= least).all() and least > 0.4 * n


# decontamination


def brute_hits(rows, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in rows:
        w = split(text)
        hit, named = set(), set()
        for i in range(len(w)):
            for size in {len(x) for x in windows}:
                if tuple(w[i : i + size]) in windows and i + size <= len(w):
                    hit.update(range(i, i + size))
                    named |= windows[tuple(w[i : i + size])]
        out.append((doc, len(w), len(hit), len(named), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_hits_by_brute_force(spark, sf, documents, bits, monkeypatch):
    """With a sieve that parts shingles, and with one that lets nearly all pass."""
    monkeypatch.setattr(D, "LEAST_BITS", bits)
    monkeypatch.setattr(D, "SIEVE_BITS", bits)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    long = items[0][1]
    items += [(900, "Zwei Wörter"), (901, "solo"), (902, None), (903, " .. "), (904, long), (905, "a a a a a a a a a a a a a a")]
    items += [(906, f"{'z' * 90} {'z' * 91} " * 8), (None, long), (907, long)]
    rows = documents + [(9008, f"q {'z' * 91} {'z' * 90} {'z' * 91} " * 5), (9009, f"q {'Z' * 90} {'z' * 91} " + f"{'z' * 90} {'z' * 91} " * 6), (9001, "zwei wörter!")]
    rows += [(9000, f"x {long} y"), (9001, "zwei wörter!"), (9002, "solo-SOLO"), (9003, None), (9004, ""), (9005, "a " * 40), (9006, long[5:]), (9007, "zwei " + "wörter, " * 60)]
    got = D.decontaminate(frame(spark, rows), frame(spark, items, "item_id long, text string"), drop_text=True).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
    assert sorted(tuple(r) for r in got.collect()) == brute_hits(rows, [x for x in items if x[0] is not None])


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_texts_that_begin_inside_a_window(spark, broadcast):
    """The rarest shingle stands nearer to the text's begin than to the window's, by one word and by more."""
    words = [f"w{i}" for i in range(13)]
    texts = [" ".join(words)] + [" ".join(words[i:] + ["x", "y"]) for i in range(1, 11)] + [" ".join(words[:11])] * 12
    rows = list(enumerate(texts))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = D.decontaminate(frame(spark, rows), frame(spark, [(1, texts[0])], "item_id long, text string"), drop_text=True).select("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")
        assert sorted(tuple(r) for r in got.collect()) == brute_hits(rows, [(1, texts[0])])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_words_by_piece(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 64)
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = "".join(rng.choice(list("aB é.7"), rng.integers(0, 300))) + "x" * rng.integers(0, 200)
        words, want = D.Words(text), D.words_of(text)
        assert [words.data[a:b] for a, b in zip(words.starts, words.ends, strict=True)] == want
        assert len(set(zip(want, words.hashes.tolist(), strict=True))) == len(set(want)) == len(set(words.hashes.tolist()))


def test_hits_with_many_items_are_joined_and_not_held(spark):
    """Four megabytes of items, a passage that all documents share, and items that share all windows."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 5)))
    vocabulary = [word() for _ in range(3000)]
    text = lambda n: " ".join(vocabulary[i] for i in rng.integers(0, 3000, n))
    shared = text(20)
    items = [(i, f"{text(200)} {shared if i % 3 == 0 else ''} {text(150)}") for i in range(2000)]
    rows = [(i, f"{text(40)} {shared} {text(40)}" if i % 2 else f"{text(30)} {items[i][1][300:500]} {text(9)}") for i in range(300)]
    got = {r["doc_id"]: r for r in D.decontaminate(frame(spark, rows).repartition(4), frame(spark, items, "item_id long, text string")).collect()}
    thirds = sorted(str(i) for i in range(2000) if i % 3 == 0)
    assert all(got[i]["items"] == thirds and 20 <= got[i]["n_hit"] <= 26 and got[i]["contaminated"] for i in range(1, 300, 2))
    assert all(got[i]["items"] == [str(i)] and 26 <= got[i]["n_hit"] <= 36 for i in range(0, 300, 2))


def test_hits_without_items_and_with_clashing_columns(spark):
    items = frame(spark, [(1, "one two three")], "item_id long, text string")
    df = frame(spark, [(1, "One, two; three.", "old", 4, 1, 2, 3, 4, 5)], "doc_id long, text string, n_hit string, item_id int, a int, B int, _n int, _items int, w int")
    got = D.decontaminate(df, items).first().asDict()
    assert (got["text"], got["n_hit"], got["items"], got["item_id"], got["contaminated"]) == ("One, two; three.", 3, ["1"], 4, True)
    none = D.decontaminate(df, items.limit(0)).first()
    assert (none["n_words"], none["n_hit"], none["contaminated"]) == (3, 0, False)
    assert D.decontaminate(df.limit(0), items).count() == 0


# licences


def test_licences_own_and_inherited(spark):
    rows = [
        ("a/LICENSE", "MIT License text\nReleased under the MIT License."),
        ("a/x.py", "nothing here"),
        ("a/b/y.py", ""),
        ("a/b/c/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("a/b/c/z.py", None),
        ("a/b/c/own.py", "text\nlicensed under CC BY-NC 4.0\nmore"),
        ("other/q.py", "x"),
        ("LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
        (None, "all rights reserved"),
        (None, "nothing"),
        ("a/b/LICENSE", "not a licence at all"),
    ]
    df = frame(spark, rows, "path string, text string").withColumn("license", F.lit("clash")).selectExpr("*", "1 as _dir", "2 as _own", "3 as above", "4 as row", "5 as near")
    got = {(r["path"], r["text"]): (r["license"], r["license_from"], r["license_dir"]) for r in C.scan_licences(df).collect()}
    assert got == {
        rows[0]: ("MIT", "own", None),
        rows[1]: ("MIT", "inherited", "a"),
        rows[2]: ("MIT", "inherited", "a"),
        rows[3]: ("Apache-2.0", "own", None),
        rows[4]: ("Apache-2.0", "inherited", "a/b/c"),
        rows[5]: ("CC-BY-NC-4.0", "own", None),
        rows[6]: ("GPL-3.0", "inherited", ""),
        rows[7]: ("GPL-3.0", "own", None),
        rows[8]: ("Proprietary", "own", None),
        rows[9]: (None, "none", None),
        rows[10]: ("MIT", "inherited", "a"),
    }
    assert C.scan_licences(df.limit(0)).count() == 0


def test_inheritance_by_brute_force(spark):
    """Every row of a random tree against a walk up its directories."""
    rng = np.random.default_rng(12)
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "plain words", "", None]
    rows = []
    for i in range(400):
        parts = [f"d{x}" for x in rng.integers(0, 3, rng.integers(0, 5))]
        name = "LICENSE" if i % 9 == 0 else f"f{i}"
        rows.append(("/".join([*parts, name]) if i % 50 else None, texts[rng.integers(0, 5)]))
    own = {texts[0]: "MIT", texts[1]: "Apache-2.0"}
    given = {}
    for path, text in rows:
        if path and path.rsplit("/", 1)[-1] == "LICENSE" and text in own:
            given.setdefault(path.rpartition("/")[0], set()).add(own[text])
    got = C.scan_licences(frame(spark, rows, "path string, text string")).collect()
    assert sorted((r["path"] or "", r["text"] or "") for r in got) == sorted((p or "", t or "") for p, t in rows)
    for r in got:
        at, found = (r["path"].rpartition("/")[0], None) if r["path"] is not None else (None, None)
        while at is not None and found is None:
            found, at = (given[at], at) if at in given else (None, at.rpartition("/")[0] if at else None)
        if r["text"] in own:
            assert (r["license"], r["license_from"], r["license_dir"]) == (own[r["text"]], "own", None)
        elif found:
            assert r["license"] in found and (r["license_from"], r["license_dir"]) == ("inherited", at)
        else:
            assert (r["license"], r["license_from"], r["license_dir"]) == (None, "none", None)


def test_licences_of_a_table_by_brute_force(spark, sf, documents):
    matcher = C.Matcher(*C.term_counts(frame(spark, documents), "text"))
    counts = {t: sum(t in set(C.terms(x or "")) for _, x in documents) for t in matcher.idf}
    frequency = C.term_counts(frame(spark, documents), "text")[1]
    assert {t: n for t, n in counts.items() if n} == frequency

    def cosine(a, b):
        weight = lambda t: matcher.idf.get(t, matcher.other)
        va, vb = ({t: x.count(t) * weight(t) for t in x} for x in (C.terms(a), C.terms(b)))
        norm = lambda v: sum(w * w for w in v.values()) ** 0.5
        return sum(w * vb.get(t, 0) for t, w in va.items()) / norm(va) / norm(vb) if va else 0

    own = {r["doc_id"]: r["license"] for r in C.op6(spark, sf).where("license_from = 'own'").collect()}
    want = {}
    for doc, text in documents:
        best = max(((cosine(line, notice), name) for line in (text or "").split("\n") for name, notices in C.TEMPLATES.items() for notice in notices), default=(0, None))
        if best[0] >= C.LEAST_COSINE:
            want[doc] = best[1]
    assert own == want and want


def frequencies(texts):
    """Of every term, counted here and not by the operator."""
    return Counter(t for x in texts for t in set(C.terms(x or "")))


def brute_cosine(a, b, n, frequency):
    va, vb = ({t: x.count(t) * (math.log((1 + n) / (1 + frequency[t])) + 1) for t in x} for x in (C.terms(a), C.terms(b)))
    norm = lambda v: sum(w * w for w in v.values()) ** 0.5
    return sum(w * vb.get(t, 0) for t, w in va.items()) / norm(va) / norm(vb)


@pytest.mark.parametrize("size", [200, 4000])
def test_licences_weigh_ordinary_words_by_their_counts(spark, size):
    """With ordinary words the notice is as near at each size; weighed as found nowhere they would drown it in the larger."""
    notice = "This photo is licensed under CC BY-NC 4.0."
    texts = [notice, "see the photo of this\nanother photo is licensed under cc by-nc 4.0 zyx", None]
    texts += [f"a photo is here\nthis photo is number{chr(97 + i % 26)}" if i % 40 else "Licensed under CC BY-NC 4.0." for i in range(size - len(texts))]
    got = [r.asDict() for r in C.scan_licences(frame(spark, list(enumerate(texts)), "path string, text string")).where("path in ('0', '1')").orderBy("path").collect()]
    frequency = frequencies(texts)
    for text, r in zip(texts, got, strict=False):
        best = max(brute_cosine(line, x, size, frequency) for line in text.split("\n") for x in C.TEMPLATES["CC-BY-NC-4.0"])
        assert r["cosine"] is None and best < C.LEAST_COSINE or abs(r["cosine"] - best) < 2e-6
        assert r["license"] == ("CC-BY-NC-4.0" if best >= C.LEAST_COSINE else None)
    assert got[0]["license"] == "CC-BY-NC-4.0" and got[0]["cosine"] > 0.7


GNU_2 = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,"""
GNU_A = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU Affero General Public License as
 * published by the Free Software Foundation, either version 3 of the
 * License, or (at your option) any later version."""
BSD = """Copyright (c) 2020, Somebody
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
THIRD = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


def test_licences_by_headers_on_several_lines(spark):
    want = {
        "GPL-2.0": [GNU_2, "import x\n" + GNU_2 + "\nx = 1\n", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\n" + GNU_2],
        "GPL-3.0": [GNU_2.replace("version 2", "version 3")],
        "AGPL-3.0": [GNU_A],
        "LGPL-2.1": [GNU_2.replace("General", "Lesser General").replace("version 2", "version 2.1")],
        "BSD-2-Clause": [BSD.format("")],
        "BSD-3-Clause": [BSD.format(THIRD)],
        "MIT": ["Permission is hereby granted, free of charge,\nto any person obtaining a copy of this software\nand associated documentation files"],
        "Apache-2.0": ["\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions."],
        "MPL-2.0": ["Mozilla Public License Version 2.0\n==================================\n\n1. Definitions"],
        "Proprietary": ["Copyright 2020 Somebody.\nAll rights reserved.", "All rights reserved by us"],
        None: [GNU_2.split("\n")[0], "only words\nof a text", "all rights reserved to the farmers"],
    }
    want["GPL-3.0"].append("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.")
    rows = [(f"{name}/{i}", x) for name, texts in want.items() for i, x in enumerate(texts)]
    rows += [(f"w/{i}", f"ordinary words of a text\nthat is number {i} and this is software") for i in range(300)]
    got = {r["path"]: r["license"] for r in C.scan_licences(frame(spark, rows, "path string, text string")).collect()}
    assert {p: x for p, x in got.items() if p[:2] != "w/"} == {f"{name}/{i}": name for name, texts in want.items() for i in range(len(texts))}
    assert not any(x for p, x in got.items() if p[:2] == "w/")


def test_digest_of_items():
    assert D.items_digest([]) == hashlib.sha256(b"").hexdigest()
