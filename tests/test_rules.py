"""J7 with rules as data against trying every pattern on every line."""
import random
import re

import pytest
from pyspark.sql import functions as F

from revlens.operators.rules import refused_rules, scan_lines

RULES = "rule_id string, category string, severity string, pattern string, fragments array<string>"


def test_a_thousand_rules_equal_plain_search(spark):
    random.seed(6)
    words = ["".join(random.choices("abcde", k=random.randint(3, 5))) for _ in range(400)]
    lines = [(k, " ".join(random.choices([*words, "x@y.zz", "10.2.3.4", "é", "=", "TOKEN"], k=random.randint(0, 12)))) for k in range(500)]
    lines += [(500, ""), (501, None), (502, "aé " * 5000 + "needle"), (502, "aé " * 5000 + "needle")]
    rules = [(f"w{k}", "logic", "low", rf"\b{w}\b", [w]) for k, w in enumerate(words)]
    rules += [(f"two{k}", "style", "low", f"(?i){a} +{b}", [a.upper()]) for k, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    rules += [("mail", "security", "high", r"[a-z]+@[a-z]+\.[a-z]+", ["@"]), ("ip", "security", "low", r"\b\d+\.\d+\.\d+\.\d+\b", ["0.0"]),
              ("either", "logic", "low", "(?i)token|needle", ["token", "needle"])]
    got = scan_lines(spark.createDataFrame(lines, "no int, line string").repartition(3), spark.createDataFrame(rules, RULES)).collect()
    want = {(no, r[0]) for no, line in lines for r in rules if re.search(r[3], line or "")}
    assert sorted((r.no, r.rule_id) for r in got) == sorted(want) and len(want) > 1000


def test_rules_without_a_usable_fragment_are_told(spark):
    rules = spark.createDataFrame([("a", "x", "low", ".", ["ab"]), ("b", "x", "low", ".", []), ("c", "x", "low", ".", ["abc", "a"]),
                                   ("d", "x", "low", ".", None), ("e", "x", "low", "%", ["%"])], RULES)
    assert sorted(r.rule_id for r in refused_rules(rules).collect()) == ["a", "b", "d"]
    lines = spark.createDataFrame([(1, "abc %")], "no int, line string")
    assert sorted(r.rule_id for r in scan_lines(lines, rules).collect()) == ["c", "e"]
    assert scan_lines(lines, rules.limit(0)).count() == 0


def test_too_many_keys_are_an_error(spark, monkeypatch):
    from revlens.operators import rules as R
    monkeypatch.setattr(R, "MOST_KEYS", 1)
    rules = spark.range(5).select(F.col("id").cast("string").alias("rule_id"), F.lit("c").alias("category"), F.lit("s").alias("severity"),
                                  F.lit(".").alias("pattern"), F.array(F.concat(F.lit("k"), F.char(F.col("id") + 65), F.lit("z"))).alias("fragments"))
    with pytest.raises(ValueError):
        scan_lines(spark.createDataFrame([(1, "a")], "no int, line string"), rules)
