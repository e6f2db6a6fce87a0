"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from revlens.llm import (binary_codes, count_rtree, decontam, katz, langid, packing, patience, quality, token_files,
                         wrappers)
from revlens.llm.common import fold

PROSE = "The rain in the north fell on the old roof and the river rose over its banks that night. "
GERMAN = "Der Regen fiel auf das alte Dach und der Fluss stieg in der Nacht weit über seine Ufer. "
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, PROSE * 3, "en", "a", 1), (2, PROSE * 3, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0),
    (5, " \t\n ", "de", "b", 4), (6, GERMAN * 3, "de", "b", 1), (6, GERMAN * 3, "de", "b", 1),
    (None, PROSE + "x", "en", "a", 1), (7, PROSE * 3000, "en", None, 1), (8, "12 34 !!", None, "a", 8),
    (9, "word", "en", "a", 4), (10, "é中文 \U0001f600", None, "b", 6),
]
#: Names that operators use inside.
CLASHING = ["label", "key", "keys", "block", "blocks", "score", "n", "s", "member", "doc", "h", "salt", "host", "shard",
            "learned", "part", "words", "m", "start", "mark", "copies", "component_id", "leak_key", "h1", "dim", "y"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, DOCS)
    return df.withColumns({c: F.lit("other") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 1, 0), (None, 0, 0), (9, None, 0), (8, 0, 0)],
                                 "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.collect())


ALL_IDS = sorted((r[0] is not None, r[0] or 0) for r in ROWS)


def test_quality(spark, docs, empty, labels):
    model = quality.fit(docs, labels, F.lit(True), quality.Settings(epochs=2))
    got = quality.score_quality(docs, model)
    assert ids(got) == ALL_IDS
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.collect())
    assert quality.score_quality(empty, model).count() == 0
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert quality.fit(empty, labels, F.lit(True)).network is None


def test_language(docs, empty):
    model = langid.fit(docs, F.lit(True))
    got = langid.predict_language(docs, model).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == ALL_IDS
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 8))
    assert by[1]["lang_pred"] == "en" and by[6]["lang_pred"] == "de" and by[7]["lang_pred"] == "en"
    assert langid.predict_language(empty, model).count() == 0
    blank = langid.fit(empty, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict_language(docs, blank).collect()} == {"und"}


def test_packing(docs, empty):
    got = packing.best_fit_pack(packing.with_lengths(docs), capacity=64, shard_docs=3).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in ROWS}
    assert packing.best_fit_pack(packing.with_lengths(empty)).count() == 0


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, PROSE, "x"), (2, None, "x"), (3, "", "x"), (None, GERMAN, "x"), (1, PROSE, "x")],
                                  "item_id long, text string, doc string")
    got = decontam.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 1), (None, 1), (7, 1), (6, None)}
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and ids(kept) == [(True, i) for i in (3, 4, 5, 8, 9, 10)]
    assert decontam.find_leaks(empty, bench).count() == 0
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0


def test_katz(docs, empty):
    learn = docs.withColumns({"learn": F.col("doc_id") != 7, "held_out": F.col("doc_id") == 7})
    got = katz.katz_scores(learn).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == ALL_IDS
    by = {r["doc_id"]: r for r in got}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == by[5]["n_tokens"] == 1
    assert by[7]["held_out"] and not by[None]["held_out"] and all(r["score"] <= 0 for r in got)
    none = katz.katz_scores(docs.withColumns({"learn": F.lit(False), "held_out": F.lit(True)})).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in none)
    assert katz.katz_scores(empty.withColumns({"learn": F.lit(True), "held_out": F.lit(False)})).count() == 0


def test_licenses(spark, docs, empty):
    extra = docs.limit(1).withColumn("text", F.lit("x " * 300_000 + patience.TEMPLATES["GPL-3.0"]))
    got = patience.scan_licenses(docs.unionByName(extra)).collect()
    assert [(r["license"], r["first_word"]) for r in got] == [("GPL-3.0", 300_000)]
    assert patience.scan_licenses(empty).count() == 0


def test_token_files(docs, empty):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = token_files.token_files(docs, path, shards=3).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in got) == ALL_IDS
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4)} == {1}
    assert token_files.token_files(empty, path).count() == 0


def test_jaccard(docs, empty):
    got = {}
    for r in count_rtree.jaccard_components(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert got[3] == [(0, 3)] and got[4] == [(0, 4)] and got[5] == [(0, 5)]
    assert got[1][0][1] == got[2][0][1] == 1 and got[6] == [got[6][0]] * 2 and got[9] == [(1, 9)]
    assert sum(map(len, got.values())) == len(ROWS)
    assert count_rtree.jaccard_components(empty).count() == 0


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [], 1),
            (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (11, [1.0, 0.0], None),
            (None, [0.0, 1.0], 1), (14, [1.0, 0.0, 0.0], 1), (12, [0.0, -1.0], 1), (12, [0.0, -1.0], 1), (13, [0.0, -3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df = df.withColumns({c: F.lit("other") for c in CLASHING if c != "label"})
    got = {}
    for r in binary_codes.near_duplicates(df).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert got[1] == [(2, 1, True)] and got[2] == [(2, 1, False)] and got[3] == [(2, 1, False)]
    assert all(got[i] == [(0, i, True)] for i in (4, 5, 6, 7, 8, 9, 10, 11)) and got[13] == [(2, 12, False)]
    assert got[12] == [(2, 12, True)] * 2 and got[14] == [(0, 14, True)] and len(got[None]) == 1
    assert binary_codes.near_duplicates(df.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "http://a.b/x", "<article><p>One</p></article>"), (2, None, "<p>Two"), (3, "no url", ""),
            (4, "http://a.b/y", None), (None, "http://a.b/z", "<div>" * 3000 + "deep"), (5, "http://a.b/x", "<<<&&&"),
            (1, "http://a.b/x", "<article><p>One</p></article>"), (6, "http://a.b/w", "<p>" + "long " * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("other") for c in ["host", "salt", "wrapper", "way", "tree", "text"]})
    got = wrappers.main_texts(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "One" and by[2] == "Two" and by[3] == by[4] == "" and by[None] == "deep" and by[6].count("long") == 200_000
    assert wrappers.main_texts(df.limit(0)).count() == 0


def test_stages_on_odd_rows(spark, docs, empty, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, GERMAN)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[1:]:
        kept = stage(spark, kept, str(tmp_path))
        if name == "language":
            assert ids(kept) == [(False, 0), *[(True, i) for i in (1, 2, 6, 6, 7, 9, 10)]]
        if name == "near_duplicates":
            assert ids(kept) == [(False, 0), *[(True, i) for i in (1, 6, 9, 10)], ] or (True, 7) in ids(kept)
        if name == "decontamination":
            assert (True, 6) not in ids(kept)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_fold(spark):
    got = spark.range(5).select(fold(F.col("id"), 3).alias("f")).collect()
    import zlib
    assert [r["f"] for r in got] == [zlib.crc32(str(i).encode()) % 3 for i in range(5)]
