"""The pipeline against brute force, and the queries that have SQL against it."""

import glob
import os
import zlib

import duckdb
import pytest
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from epsgrid.llm import entry
from tests.llm.conftest import frame
from tests.llm.test_models import PIECES
from tests.llm.test_text_ops import brute_components, brute_hits, brute_lines


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_by_brute_force(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = corpus_pipeline.language_stage(spark, docs, d).select("doc_id").collect()
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert len(kept) == len(rows)  # all of these are in a language
    rows = [(i, t) for i, t, _, _ in brute_lines(rows) if t.strip()]
    first = {i for i, _, _, stays in brute_components_by_shingle(rows) if stays}
    rows = [r for r in rows if r[0] in first]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    bad = {x[0] for x in brute_hits(rows, items) if x[-1]}
    other = SentencePieceProcessor(model_file=PIECES)
    want = {i: other.encode(t) for i, t in rows if i not in bad}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert {i: r["ids"] for i, r in got.items()} == want
    assert all(r["round_trip"] and r["n_differ"] == 0 for r in got.values())
    assert bad and len(first) < len(kept)


def brute_components_by_shingle(rows):
    """Components of the whole table, by those of rows that share some shingle."""
    return brute_components(rows, 5, 80, 100)


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12 34", None, "s", 5), (None, "words of a text", "en", None, 3), (5, "words of a text", "en", "s", 9), (5, "words of a text", "en", "s", 9)]
    odd = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as n_hit", "'x' as score")
    for name, step in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, odd.limit(0)):
            out = step(spark, docs, sf)
            assert out.columns == corpus_pipeline.COLUMNS, name
            assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sf).count() == len(rows)


def test_language_stage_without_a_language_to_learn(spark, sf):
    rows = [(1, "words of a text", None, "s", 3), (None, "Wörter", None, None, 3), (3, "12 34", None, "s", 5), (4, None, None, "s", 0)]
    held_out = next(i for i in range(10, 99) if zlib.crc32(str(i).encode()) % 3 == 1)
    out = corpus_pipeline.language_stage(spark, frame(spark, [*rows, (held_out, "held out", "en", "s", 8)], SCHEMA), sf)
    assert sorted((r["doc_id"] or 0, r["text"], r["lang"]) for r in out.collect()) == [(0, "Wörter", None), (1, "words of a text", None), (held_out, "held out", "en")]


def test_language_stage_rejects_what_is_in_no_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(90_001, "12 34 ½ !", "en", "s", 9), (90_002, None, None, "s", 0), (90_003, "", "en", "s", 0)]
    out = corpus_pipeline.language_stage(spark, docs.select(*corpus_pipeline.COLUMNS).union(frame(spark, rows, SCHEMA)), sf)
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r["doc_id"] for r in out.select("doc_id").collect()}


def test_near_dup_stage_keeps_rows_without_an_id(spark, sf):
    rows = [(None, "words of a text", "en", None, 3), (None, "words of a text", "en", None, 3), (5, "words of a text", "en", "s", 9), (6, "words of a text", "en", "s", 9), (7, "quite another one", "en", "s", 9)]
    out = corpus_pipeline.near_dup_stage(spark, frame(spark, rows, SCHEMA), sf)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, "words of a text")] * 2 + [(5, "words of a text"), (7, "quite another one")]


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.sql(entry.SQL[name]).df()
    got = entry.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in entry.QUERIES] == [f"op{i}" for i in range(1, 11)]
