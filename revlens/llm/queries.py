"""Queries of the operators in this package, one ``opN_<name>`` each, and the pipeline's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import (binary_codes, count_rtree, decontam, disclosure, katz, langid, packing, patience, periodic_runs, quality,
                         token_alignment, token_files, wrappers)
from revlens.llm.common import bound, fold, stored, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", _held_out(3, 1), "score", "predicted")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, fold(F.col("doc_id"), 3) != 1)
    return langid.predict_language(docs, model).select(
        "doc_id", _held_out(3, 1), "lang_pred", "score", F.size("spans").alias("n_spans"))


def _held_out(n: int, remainder: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), n) == remainder, F.lit(False)).alias("held_out")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                table(spark, sf_dir, "benchmark"))
    return leaks.drop("doc")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(packing.with_lengths(table(spark, sf_dir, "documents")))


def op5_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.katz_scores(docs.select("*", (fold(F.col("doc_id"), 10) != 0).alias("learn"), _held_out(10, 0)))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patience.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rtree.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_disclosure_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"] != "term")
    kinds = F.transform("spans", lambda x: x["kind"])
    without = {kind: F.size(F.array_remove(kinds, kind)) for kind in disclosure.KINDS}
    count = [(F.size("spans") - n).cast("long").alias(f"n_{kind}") for kind, n in without.items()]
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *count, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.find_runs(docs.select("doc_id", _with_repeats(F.col("doc_id"), F.col("text")).alias("text")))
    # The greatest exact length / period; the first of equal ones, as runs are sorted.
    ahead = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(ahead(r, a), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                      F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _with_repeats(doc_id: Column, text: Column) -> Column:
    """The contract's test input: in a tenth of the documents the words repeat from a place on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        return bound(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), lambda v: F.array_join(
            F.transform(w, lambda x, i: F.when(i < v["a"], x).otherwise(F.get(w, (v["a"] + (i - v["a"]) % v["p"]).cast("int")))), " "))

    return F.when(h % 10 == 0, bound(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(text))).otherwise(text)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = stored(aligned.select("block", "doc_id", *token_alignment.NUMBERS, digest, "links", "pairs", "holders"), "aligned")
    return token_alignment.with_link_counts(aligned).select(
        "doc_id", *token_alignment.NUMBERS, "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_classifier, op2_benchmark_decontamination, op3_best_fit_packing, op4_language_id, op5_katz_lm, op6_embedding_dedup,
                               op7_license_scan, op8_wrapper_extraction, op9_token_files, op10_ngram_jaccard,
                               op11_disclosure_control, op12_periodic_runs, op13_token_alignment)}
#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {}
