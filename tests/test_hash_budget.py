"""Exact values of the location hash and token budget (reference unit cases)."""
import hashlib

from pyspark.sql import functions as F

from revlens.functions.hashing import location_hash
from revlens.functions.scoring import budget_total, token_budget


def _lh(spark, repo, path, sym, cat):
    df = spark.createDataFrame([(repo, path, sym, cat)], "r string, p string, s string, c string")
    return df.select(location_hash("r", "p", "s", "c").alias("h")).first().h


def test_location_hash_matches_hashlib_and_is_hex(spark):
    h = _lh(spark, "org/repo", "internal/auth/token.go", "ValidateToken", "security")
    want = hashlib.sha256(b"org/repo\x00internal/auth/token.go\x00ValidateToken\x00security").hexdigest()
    assert h == want and len(h) == 64


def test_location_hash_sensitive_to_each_input(spark):
    base = ("org/repo", "a.go", "F", "logic")
    h0 = _lh(spark, *base)
    for i in range(4):
        changed = list(base)
        changed[i] = changed[i] + "x"
        assert _lh(spark, *changed) != h0


def test_separator_prevents_collision_and_empty_symbol_ok(spark):
    assert _lh(spark, "ab", "cd", "", "logic") != _lh(spark, "a", "bcd", "", "logic")
    assert len(_lh(spark, "org/repo", "deploy.yaml", "", "logic")) == 64
    assert _lh(spark, "org/repo", "deploy.yaml", None, "logic") == _lh(spark, "org/repo", "deploy.yaml", "", "logic")


def _budget(spark, total, tt, appr):
    df = spark.createDataFrame([(total, tt, appr)], "t long, tt string, a boolean")
    b = df.select(token_budget("t", "tt", "a").alias("b")).select("b.*", budget_total(F.col("b")).alias("total"))
    return b.first()


def test_budget_splits_at_16000(spark):
    cases = {("logic", False): (9600, 4000, 2400), ("logic", True): (11200, 2720, 2080),
             ("security", False): (8000, 5600, 2400), ("test_coverage", False): (9600, 800, 5600),
             ("style", False): (16000, 0, 0)}
    for (tt, appr), want in cases.items():
        r = _budget(spark, 16000, tt, appr)
        assert (r.diff_hunk, r.call_graph, r.tests) == want, (tt, appr)


def test_zero_budget_and_negative_raw_cap(spark):
    r = _budget(spark, 0, "logic", False)
    assert (r.diff_hunk, r.call_graph, r.tests, r.total) == (0, 0, 0, 0)
    r = _budget(spark, 16000, "test_coverage", True)
    assert r.call_graph_raw == -480 and r.call_graph == 0
    assert r.total == r.diff_hunk + r.call_graph_raw + r.tests
