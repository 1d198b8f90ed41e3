"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Each line of a text, and a licence file as a whole, is a sparse TF-IDF vector. Document frequencies
are counted over all texts: first those of the templates' terms, then those of every other term of
the lines that can be near enough, whatever their other terms weigh. A text has the licence of the
template nearest to any of its lines or, for a licence file, to the whole, if their cosine reaches
``LEAST_COSINE``. Runs of neighbouring lines, as long as a template, are compared like lines, and with
the full headers in ``HEADERS`` besides: where a run reaches a header, lines and runs that overlap it
have no say, as licences share sentences. A GNU licence also needs its version in the line or run.
``cosine`` is that of the nearest of what can reach it, and null where nothing can. A text without a
licence of its own inherits that of the nearest directory above it that holds a licence file with
one: directories are joined to licensed directories by the paths of all their ancestors.

Defined results: null and empty texts have no licence of their own; ties go to the licence first
in the alphabet; several licence files in a directory give it the one of highest cosine, then the
first in the alphabet; a null path inherits nothing and gives no licence to others; repeated rows
are judged alike; an empty table gives no rows; other columns pass through, those named like a
result are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from epsgrid.llm.common import release, small_batches, table
from epsgrid.staging import stage, unstage

LEAST_COSINE = 0.6
#: Short notices by which licences are declared.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["This software is released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["This software is released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "EPL-2.0": ["This program is made available under the terms of the Eclipse Public License 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "Released under the ISC License."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""
#: Headers and titles of licence texts that stand on several lines.
HEADERS = {
    "AGPL-3.0": [_GNU.format("Affero General Public License", "3"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "BSD-2-Clause": [_BSD.format("")],
    "BSD-3-Clause": [_BSD.format("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ")],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
    "GPL-2.0": [_GNU.format("General Public License", "2"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": [_GNU.format("General Public License", "3"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": [_GNU.format("Lesser General Public License", "2.1"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "LGPL-3.0": [_GNU.format("Lesser General Public License", "3"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
}
#: Licences that a line or run has only with one of these words in it.
NEEDS = {"Apache-2.0": {"2.0", "2"}, "MPL-2.0": {"2.0"}, "AGPL-3.0": {"3", "3.0"}, "GPL-2.0": {"2", "2.0"}, "GPL-3.0": {"3", "3.0"}, "LGPL-2.1": {"2.1"}, "LGPL-3.0": {"3", "3.0"}}
#: A claim of all rights ends there, or names who holds them; rights reserved to or for others are none.
_CLAIM = re.compile(r"all rights reserved(?!\s+(?!by\b)[a-z])")
#: Slots of the sieve of wanted terms, and terms that a task counts or remembers at once.
SLOTS, TERMS_AT_ONCE = 1 << 22, 200_000
_WORD = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> list[str]:
    """Words and version numbers, with pairs of neighbours, so that BY-NC and BY-SA differ in more than one term."""
    words = _WORD.findall(text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


class Matcher:
    """Cosines of TF-IDF vectors with those of the templates, over an index from terms to templates."""

    def __init__(self, documents: int, frequency: dict[str, int]):
        self.rows = [(licence, notice) for licence in sorted(TEMPLATES) for notice in TEMPLATES[licence]]
        self.notices = len(self.rows)
        self.claim = next(i for i, (licence, _) in enumerate(self.rows) if licence == "Proprietary")
        self.rows += [(licence, header) for licence in sorted(HEADERS) for header in HEADERS[licence]]
        counts = [Counter(terms(notice)) for _, notice in self.rows]
        vocabulary = sorted(set().union(*counts))
        self.idf = {t: math.log((1 + documents) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary}
        self.documents = documents
        self.other = math.log(1 + documents) + 1
        self.postings: dict[str, list[tuple[int, float]]] = {t: [] for t in vocabulary}
        for i, c in enumerate(counts):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            for t, n in c.items():
                self.postings[t].append((i, n * self.idf[t] / norm))
        self.cue = re.compile("|".join(map(re.escape, sorted(self._cues(counts[: self.notices])))))
        self.lengths = [len(_WORD.findall(notice.lower())) for _, notice in self.rows]
        self.needs = [NEEDS.get(licence) for licence, _ in self.rows]
        self.words = {w: i for i, w in enumerate(t for t in vocabulary if " " not in t)}
        #: Share of each template's squared length by word; that of a pair goes to its heavier word.
        self.shares = np.zeros((len(self.words), len(self.rows)))
        for t, found in self.postings.items():
            at = self.words[max(t.split(" "), key=lambda w: (self.idf[w], w))]
            for i, w in found:
                self.shares[at, i] += w * w

    def _cues(self, counts: list[Counter]) -> set[str]:
        """Words of which a line must hold one: without any of a template's heaviest terms, that make
        up more than 1 - LEAST_COSINE ** 2 of its squared length, no line can reach LEAST_COSINE."""
        out = set()
        for c in counts:
            squares = sorted((((n * self.idf[t]) ** 2, t) for t, n in c.items()), reverse=True)
            total, gone = sum(s for s, _ in squares), 0.0
            for s, t in squares:
                out.add(max(t.split(" "), key=lambda w: (self.idf[w], w)))
                gone += s
                if gone > (1 - LEAST_COSINE**2) * total * (1 + 1e-9):
                    break
        return out

    def unit(self, text: str, start: int, end: int, rows: int) -> Unit:
        """``text`` beside the nearest of the first ``rows`` templates, which the weights of other terms can't change."""
        own, dots, others = 0.0, [0.0] * len(self.rows), {}
        found = Counter(terms(text))
        for t, n in found.items():
            if t not in self.idf:
                others[t] = n
                continue
            weight = n * self.idf[t]
            own += weight * weight
            for i, w in self.postings[t]:
                dots[i] += weight * w
        for i, needs in enumerate(self.needs):
            if needs and dots[i] and needs.isdisjoint(found):
                dots[i] = 0.0
        if dots[self.claim] and not _CLAIM.search(text):
            dots[self.claim] = 0.0
        top = max(range(rows), key=lambda i: (dots[i], -i))
        return Unit(text, self.rows[top][0], dots[top], own, others, top >= self.notices, start, end)

    def runs(self, low: str) -> list[Unit]:
        """Runs of lines that are about as long as a template and can be near enough to one.

        A cosine of LEAST_COSINE needs terms that make up LEAST_COSINE ** 2 of the template's squared
        length, so texts and runs whose words have less are passed over."""
        least = LEAST_COSINE**2 * (1 - 1e-9)
        here = self.words.keys() & set(_WORD.findall(low))
        able = np.flatnonzero(self.shares[[self.words[w] for w in here]].sum(axis=0) >= least) if here else ()
        if not len(able):
            return []
        lines = [(i, x, found) for i, x in enumerate(low.split("\n")) if (found := _WORD.findall(x))]
        known = [{self.words[w] for w in found if w in self.words} for _, _, found in lines]
        spans = set()
        for i in able.tolist():
            share = self.shares[:, i]
            for s, at in enumerate(known):
                if not at or not share[list(at)].any():
                    continue
                n, e = len(lines[s][2]), s
                while n < self.lengths[i] and e + 1 < len(lines):
                    e += 1
                    n += len(lines[e][2])
                for end in (e, e - 1):
                    if end >= s and (end > s or i >= self.notices) and (s, end) not in spans and share[list(set().union(*known[s : end + 1]))].sum() >= least:
                        spans.add((s, end))
        made = (self.unit("\n".join(x for _, x, _ in lines[s : e + 1]), lines[s][0], lines[e][0], len(self.rows)) for s, e in sorted(spans))
        return [u for u in made if u.start < u.end or u.header]

    def scan(self, text: str, whole: bool) -> list[Unit]:
        """Of the lines with a cue, the runs, and the whole where asked for, those that can reach LEAST_COSINE."""
        low = text.lower()
        runs = [u for u in self.runs(low) if u.can()]
        if not self.cue.search(low):
            return runs
        lines = [(i, x) for i, x in enumerate(low.split("\n")) if self.cue.search(x)]
        made = {x: self.unit(x, i, i, self.notices) for i, x in lines}
        near = [replace(made[x], start=i, end=i) for i, x in lines if made[x].can()]
        if whole:
            near += [u for u in [self.unit(low, 0, low.count("\n"), self.notices)] if u.can()]
        return near + runs


@dataclass
class Unit:
    """A line, run or whole text: its product with the nearest template, its square over the templates' terms, its other terms."""

    text: str
    licence: str
    dot: float
    own: float
    others: dict[str, int]
    header: bool
    start: int
    end: int

    def cosine(self, square: float) -> float:
        return self.dot / math.sqrt(self.own + square) if self.own else 0.0

    def can(self) -> bool:
        """Whether it reaches LEAST_COSINE if its other terms are in every text, where the weight is least."""
        return self.cosine(sum(n * n for n in self.others.values())) >= LEAST_COSINE * (1 - 1e-9)


def decide(units: list[tuple[float, str, bool, int, int]]) -> tuple[float, str | None]:
    """The best cosine and, if it is near enough, its licence, of ``(cosine, licence, header, start, end)``.

    Near enough headers silence what overlaps them; ties go to the first in the alphabet."""
    spans = [(start, end) for c, _, header, start, end in units if header and c >= LEAST_COSINE]
    heard = [(-c, x) for c, x, header, start, end in units if header or not any(start <= e and s <= end for s, e in spans)]
    cosine, licence = min(heard, default=(0.0, None))
    return -cosine, licence if -cosine >= LEAST_COSINE else None


def term_counts(docs: DataFrame, text_col: str) -> tuple[int, dict[str, int]]:
    """Texts, and for each term of the templates in how many of them it is."""
    vocabulary = sorted({t for notices in [*TEMPLATES.values(), *HEADERS.values()] for n in notices for t in terms(n)})
    single = {t: i for i, t in enumerate(vocabulary) if " " not in t}
    pairs = {t: i for i, t in enumerate(vocabulary) if " " in t}
    firsts = {t.split(" ")[0] for t in pairs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                words = _WORD.findall((text or "").lower())
                here = single.keys() & set(words)
                seen = {single[w] for w in here}
                if len(here & firsts) and len(here) > 1:
                    seen |= {pairs[p] for p in {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in firsts} & pairs.keys()}
                total[list(seen)] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*total[at].tolist(), n], pa.int64())], ["t", "n"])

    rows = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    return next((r["n"] for r in rows if r["t"] < 0), 0), {vocabulary[r["t"]]: r["n"] for r in rows if r["t"] >= 0}


def other_counts(docs: DataFrame, text_col: str, wanted: DataFrame, vocabulary: set[str]) -> DataFrame:
    """``(term, n)``: in how many texts each ``term`` of ``wanted`` is, of which all words are wanted or in ``vocabulary``."""
    slots = wanted.select(F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(SLOTS)).cast("int").alias("s")).distinct().toArrow()
    sieve = np.zeros(SLOTS, bool)
    sieve[slots.column("s").to_numpy()] = True
    sieve = np.packbits(sieve).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        counts: Counter = Counter()

        def passes(t: str) -> bool:
            if (found := known.get(t)) is None:
                slot = zlib.crc32(t.encode()) % SLOTS
                found = known[t] = bool(sieve[slot >> 3] >> (7 - (slot & 7)) & 1)
            return found

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _WORD.findall((text or "").lower())
                here = {w for w in set(words) if w in vocabulary or passes(w)}
                pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in here and b in here}
                counts.update(t for t in here | pairs if t not in vocabulary and passes(t))
                if len(known) > TERMS_AT_ONCE:
                    known.clear()
                if len(counts) > TERMS_AT_ONCE:
                    yield made()
                    counts.clear()
        yield made()
        release()

    counted = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "term string, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("n")).join(wanted, "term", "left_semi")


def weighed(docs: DataFrame, text_col: str, scanned: DataFrame, matcher: Matcher) -> DataFrame:
    """``scanned`` with ``_own`` and ``_cosine`` of the rows with ``_units``, whose other terms weigh by their counts in ``docs``."""
    units = scanned.where("_units is not null").select("_row", F.explode("_units").alias("u")).select("_row", "u.*")
    held = stage(units.where("size(terms) > 0").groupBy("key").agg(F.first("terms").alias("terms"), F.first("n").alias("n")), "licence-units")
    if held.isEmpty():
        return scanned
    apart = held.select("key", F.explode(F.arrays_zip("terms", "n")).alias("x")).select("key", F.col("x.terms").alias("term"), F.col("x.n").alias("times"))
    wanted = stage(apart.select("term").distinct(), "licence-terms")
    counts = other_counts(docs, text_col, wanted, set(matcher.idf))
    weight = F.col("times") * (F.log(F.lit(1.0 + matcher.documents) / (1 + F.coalesce("n", F.lit(0)))) + 1)
    squares = apart.join(counts, "term", "left").groupBy("key").agg(F.sum(weight * weight).alias("square"))
    cosine = F.col("dot") / F.sqrt(F.col("own") + F.coalesce("square", F.lit(0.0)))
    found = units.join(squares, "key", "left").groupBy("_row").agg(F.collect_list(F.struct(cosine.alias("c"), "licence", "header", "start", "end")).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [decide([tuple(u.values()) for u in units]) for units in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for _, x in made], pa.string()), pa.array([round(c, 6) for c, _ in made], pa.float64())], ["_row", "_found", "_best"])

    found = stage(found.mapInArrow(run, "_row long, _found string, _best double"), "licence-found")
    unstage(held, wanted)
    return scanned.join(found, "_row", "left").withColumn("_own", F.coalesce("_found", "_own")).withColumn("_cosine", F.greatest("_best", "_cosine")).drop("_found", "_best")


RESULT = ["license", "cosine", "license_from", "license_dir"]
#: Lines whose cosine needs the counts of other terms.
UNITS = T.ArrayType(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("licence", T.StringType()), T.StructField("dot", T.DoubleType()), T.StructField("own", T.DoubleType()), T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.IntegerType())), T.StructField("header", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scan_licences(docs: DataFrame, path_col: str = "path", text_col: str = "text", licence_file: str = r"(?i)(^|/)(licen[sc]e|copying|unlicense)(\.[a-z]+)?$", drop_text: bool = False) -> DataFrame:
    """``docs`` with ``license, cosine, license_from`` (own, inherited, none) and ``license_dir``."""
    docs = small_batches(docs).select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULT])
    matcher = Matcher(*term_counts(docs, text_col))
    keep = [c for c in docs.columns if not (drop_text and c == text_col)]
    # the other columns go along as one, so that no name of theirs can meet one of ours
    whole = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row"))
    made = T.StructType([whole.schema["row"]] + [T.StructField("_own", T.StringType()), T.StructField("_cosine", T.DoubleType()), T.StructField("_file", T.BooleanType()), T.StructField("_dir", T.StringType()), T.StructField("_units", UNITS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, cosine, left = [], [], []
            for text, is_file in zip(batch.column("_in_text").to_pylist(), batch.column("_file").to_pylist(), strict=True):
                near = matcher.scan(text or "", bool(is_file))
                later = any(u.others for u in near)
                c, licence = decide([(u.cosine(0.0), u.licence, u.header, u.start, u.end) for u in near]) if near and not later else (None, None)
                own.append(licence)
                cosine.append(c if c is None else round(c, 6))
                left.append([{"key": hashlib.md5(u.text.encode()).digest(), "licence": u.licence, "dot": u.dot, "own": u.own, "terms": list(u.others), "n": list(u.others.values()), "header": u.header, "start": u.start, "end": u.end} for u in near] if later else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(own, pa.string()), pa.array(cosine, pa.float64()), batch.column("_file"), batch.column("_dir"), pa.array(left, to_arrow_type(UNITS))], made.names)

    path = F.col(f"`{path_col}`")
    given = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("_in_text"), F.coalesce(path.rlike(licence_file), F.lit(False)).alias("_file"), F.regexp_replace(path, "/?[^/]*$", "").alias("_dir"))
    scanned = stage(given.mapInArrow(run, made).withColumn("_row", F.monotonically_increasing_id()), "licence-scan")
    scanned = weighed(docs, text_col, scanned, matcher)
    licensed = scanned.where(F.col("_file") & F.col("_own").isNotNull() & F.col("_dir").isNotNull())
    licensed = licensed.groupBy(F.col("_dir").alias("above")).agg(F.min(F.struct((-F.col("_cosine")).alias("c"), F.col("_own").alias("o"))).alias("best")).select("above", F.col("best.o").alias("_given"))
    dirs = scanned.where("_own is null and _dir is not null").select("_dir").distinct()
    parts = F.split("_dir", "/")
    depth = F.explode(F.concat(F.array(F.lit(0)), F.when(F.col("_dir") != "", F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))))
    above = dirs.select("_dir", depth.alias("depth")).withColumn("above", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = above.join(licensed, "above").groupBy("_dir").agg(F.max_by(F.struct("above", "_given"), "depth").alias("near"))
    out = scanned.join(nearest, "_dir", "left")
    owned = F.col("_own").isNotNull()
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in keep],
        F.coalesce("_own", "near._given").alias("license"),
        F.col("_cosine").alias("cosine"),
        F.when(owned, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("license_from"),
        F.when(~owned, F.col("near.above")).alias("license_dir"),
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths, so they are laid out as a tree by source and id: sixteen to a
    directory, sixteen directories to one above; the first of each directory is its LICENSE file
    and the first of all in the upper directory that of the upper one."""
    docs = table(spark, sf_dir, "documents")
    doc, upper, lower = F.col("doc_id"), F.expr("doc_id div 256"), F.expr("doc_id div 16")
    tree = F.when(doc % 256 == 0, F.concat_ws("/", F.col("source"), upper, F.lit("LICENSE"))).when(doc % 16 == 0, F.concat_ws("/", F.col("source"), upper, lower, F.lit("LICENSE")))
    path = F.coalesce(tree, F.concat_ws("/", F.col("source"), upper, lower, doc.cast("string")))
    found = scan_licences(docs.select("doc_id", "text", path.alias("path")), drop_text=True)
    return found.select("doc_id", "license", "cosine", "license_from", "license_dir")
