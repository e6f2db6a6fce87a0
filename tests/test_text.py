"""Diff, answer and code-index parsing on tiny inputs."""
from pyspark.sql import functions as F

from revlens.functions.text import extract_json
from revlens.operators import code_index as X
from revlens.plans.planner import pack_lines, truncate_to_tokens


def test_hunk_header_without_counts_means_one(spark):
    diff = ("diff --git a/x.go b/x.go\n--- a/x.go\n+++ b/x.go\n@@ -3 +5 @@\n+a\n"
            "diff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py\n@@ -1,2 +10,4 @@\n+b")
    df = spark.createDataFrame([(1, "org/r", diff)], "pull_request_id long, repo_full_name string, diff string")
    got = sorted((r.path, r.start, r.end) for r in X.parse_hunks(df).collect())
    assert got == [("x.go", 5, 6), ("y.py", 10, 14)]
    exact = sorted((r.path, r.start, r.end) for r in X.parse_hunks(df, exact_end=True).collect())
    assert exact == [("x.go", 5, 5), ("y.py", 10, 13)]


def test_extract_json_whole_then_fence(spark):
    rows = [('{"findings": []}',), ('Sure.\n```json\n{"findings": [1]}\n```\nbye',), ("no json here",),
            ('```json {"findings": [2]} ```',), (None,)]
    got = [r.j for r in spark.createDataFrame(rows, "raw string").select(extract_json("raw").alias("j")).collect()]
    assert got == ['{"findings": []}', '{"findings": [1]}', "no json here", '{"findings": [2]}', None]


def test_truncate_to_whole_lines(spark):
    df = spark.createDataFrame([("aaa\nbbb\nccc",)], "t string")
    got = [df.select(truncate_to_tokens(F.col("t"), F.lit(n)).alias("x")).first().x for n in (0, 1, 2, 3, 4)]
    # 1 token ~ 3.33 bytes: 1 -> 3 bytes "aaa"; 2 -> 6 bytes; 3 -> 9 bytes "aaa\nbbb"; 4 -> all
    assert got == ["", "aaa", "aaa", "aaa\nbbb", "aaa\nbbb\nccc"]
    # a first line that doesn't fit is cut at a character
    one = spark.createDataFrame([("\u00e9\u00e9\u00e9\u00e9 end\nnext",)], "t string")
    assert one.select(truncate_to_tokens(F.col("t"), F.lit(1)).alias("x")).first().x == "\u00e9"


def test_pack_lines_returns_every_line(spark):
    lines = spark.range(40_000).select(F.lit(1).alias("g"), F.col("id").alias("pos"), F.lit("").alias("line"))
    got = pack_lines(lines, ["g"], ["pos"], "line", F.lit(16_000), F.floor(F.col("pos") / 4096))
    r = got.agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.max("running_tokens").alias("t")).first()
    assert (r.n, r.kept, r.t) == (40_000, 40_000, -(-39_999 * 100 // 333))


def test_range_join_equals_brute_force(spark):
    import random
    rnd = random.Random(7)
    hunks = [(1, "org/r", "f.go", s, s + rnd.randint(0, 30)) for s in (rnd.randint(1, 400) for _ in range(60))]
    syms = []
    for i in range(40):
        s = rnd.randint(1, 400)
        syms.append(("f.go", f"F{i}", s, s + rnd.randint(0, 150), 0, True, "func", "go", "org/r"))
    h = spark.createDataFrame(hunks, "pull_request_id long, repo_full_name string, path string, start int, `end` int")
    s = spark.createDataFrame(syms, "path string, name string, start_line int, end_line int, param_count int, "
                                    "exported boolean, kind string, ext string, repo_full_name string")
    got = {(r.name, r.changed_lines) for r in X.overlapping_symbols(h, s, bucket=16).collect()}
    want = {}
    for *_, hs, he in hunks:
        for _, n, ss, se, *_ in syms:
            if ss <= he and se >= hs:
                want[n] = want.get(n, 0) + min(se, he) - max(ss, hs) + 1
    assert got == set(want.items())


def test_definitions_imports_calls(spark):
    content = 'package m1\nimport "org/repo-1/pkg/util/m2"\nfunc Handle(a int, b int) error {\n    m2.Do(a)\n}'
    files = spark.createDataFrame([("org/repo-1", "cmd/m1/f.go", "go", content, False)],
                                  "repo_full_name string, path string, ext string, content string, is_test boolean")
    from revlens.sources.synth import file_lines
    lines = file_lines(files)
    d = X.definitions(lines).first()
    assert (d.name, d.param_count, d.exported, d.start_line) == ("Handle", 2, True, 3)
    i = X.imports(lines).first()
    assert (i.package, i.alias) == ("pkg/util/m2", "m2")
    c = X.calls(lines).filter("qualified").first()
    assert (c.alias, c.name, c.line_no) == ("m2", "Do", 4)


def test_answer_format_and_reject_reasons(spark):
    import json

    from revlens.plans.findings_flow import parse_findings
    good = {"title": "t", "body": "b", "suggestion": "s", "category": "logic", "severity": "high",
            "confidence_tier": "high", "confidence_score": 0.9, "start_line": 12, "end_line": 14}
    cases = [({}, None), ({"start_line": None, "end_line": None}, None), ({"category": "other"}, "bad_category"),
             ({"severity": "blocker"}, "bad_severity"), ({"confidence_score": 1.2}, "confidence_out_of_range"),
             ({"confidence_tier": "low"}, "tier_mismatch"), ({"start_line": 2}, "line_outside_diff"),
             ({"end_line": 40}, "line_outside_diff")]
    raw = "```json " + json.dumps({"findings": [good | c for c, _ in cases]}) + "```"
    answers = spark.createDataFrame([(1, 7, "a.go", raw), (2, 7, "a.go", "sorry"), (3, 7, "a.go", None)],
                                    "task_id long, pull_request_id long, file_path string, raw string")
    hunks = spark.createDataFrame([(7, "a.go", 10, 20)], "pull_request_id long, path string, start int, `end` int")
    got = parse_findings(answers, hunks).orderBy("task_id", "ordinal").collect()
    assert [r.reason for r in got] == [r for _, r in cases] + ["invalid_json", "no_json"]
    assert {r.file_path for r in got} == {"a.go"}


def test_two_definitions_of_one_name_stay_two(spark):
    h = spark.createDataFrame([(1, "org/r", "f.go", 1, 50)], "pull_request_id long, repo_full_name string, path string, start int, `end` int")
    s = spark.createDataFrame([("f.go", "F", a, a + 9, 0, True, "func", "go", "org/r") for a in (1, 21)],
                              "path string, name string, start_line int, end_line int, param_count int, "
                              "exported boolean, kind string, ext string, repo_full_name string")
    assert sorted(r.start_line for r in X.overlapping_symbols(h, s).collect()) == [1, 21]


def test_merge_meta_keeps_values(spark):
    from revlens.operators.maintenance import merge_meta
    df = spark.createDataFrame([('{"slice":{"diff":3},"n":5,"ok":true,"none":null}', "x"), (None, None)],
                               "metadata string, e string")
    got = [r.metadata for r in merge_meta(df, {"e": F.col("e"), "n": F.col("e")}).collect()]
    assert got == ['{"slice":{"diff":3},"ok":true,"none":null,"e":"x","n":"x"}', "{}"]
