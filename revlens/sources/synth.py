"""Source files, diffs and model answers derived from the driver tables
(A13, A14 inputs; FIXTURES section 3).

Built by string concatenation and array functions only, row by row (files
from ``part``, diffs and answers from ``lineitem``), so the same text comes
out of DuckDB for the oracle.  Layout rules:

* part p is file k = p//25 of repository p%25: ``TOP[k%6]/m{k%7}/file{k}.{ext}``; ext by ``k%4`` (go, py,
  ts, php), except ``deploy/helm`` files which are YAML (no grammar);
* file k imports the package of file ``k//2`` and calls its ``Handle_*_1``;
  functions ``Handle_k_j`` (odd j) and ``helper_k_j`` (even j), ``1+k%3`` of
  them, ``(k+j)%7`` parameters and ``2+(k*j)%40`` body lines;
* every third code file has a test file (same folder, or mirrored under
  ``tests/`` for odd k outside Go);
* the diff of PR (order) o has one file section per line item, hunk at line
  ``1+(3*floor(qty))%60`` with ``2*linenumber`` lines (count omitted when the
  line number is a multiple of 4);
* the answer of task (o, linenumber) is a JSON findings list, raw, fenced,
  after prose, or unclosed and sent again, by ``o%4``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORIES, SEVERITIES
from ..functions.arrays import bound
from .tables import grows, read_table
from .views import pick, review_tasks, s

# ---------------------------------------------------------------------------
# FIXED VALUES of the synthetic-source layout (shared with the SQL oracle)
# ---------------------------------------------------------------------------
TOP_DIRS = ["internal/auth", "api/handler", "cmd", "deploy/helm", "pkg/util", "migration"]
LANG_EXT = ["go", "py", "ts", "php"]
N_REPOS = 25
FILE_SHARES = 8  # tasks that one file's versions are dealt out to
# ---------------------------------------------------------------------------


def _file_parts(k: Column) -> dict[str, Column]:
    top = pick(TOP_DIRS, k % 6)
    ext = F.when(k % 6 == 3, F.lit("yaml")).otherwise(pick(LANG_EXT, k % 4))
    sub = F.concat(F.lit("m"), s(k % 7))
    base = F.concat(F.lit("file"), s(k))
    path = F.concat(top, F.lit("/"), sub, F.lit("/"), base, F.lit("."), ext)
    return {"top": top, "ext": ext, "sub": sub, "base": base, "path": path}


def file_number(part_key: Column) -> Column:
    """Which of its repository's files a part is: parts go round the repositories, so a path
    occurs in many of them."""
    return F.floor(part_key / N_REPOS)


def repo_of_order(o: Column) -> Column:
    return F.concat(F.lit("org/repo-"), s(F.floor(o / 3) % N_REPOS))


def file_path_of(part_key: Column) -> Column:
    return _file_parts(file_number(part_key))["path"]


def _code_lines(k: Column, ext: Column, sub: Column, base: Column, repo: Column) -> Column:
    k2 = F.floor(k / 2)
    dep_top = pick(TOP_DIRS, k2 % 6)
    dep_sub = F.concat(F.lit("m"), s(k2 % 7))
    header = (F.when(ext == "go", F.concat(F.lit("package "), sub))
              .when(ext == "py", F.concat(F.lit("# module "), base))
              .when(ext == "ts", F.concat(F.lit("// module "), base))
              .otherwise(F.lit("<?php")))
    imp = (F.when(ext == "go", F.concat(F.lit('import "'), repo, F.lit("/"), dep_top, F.lit("/"), dep_sub,
                                        F.lit('"')))
           .when(ext == "py", F.concat(F.lit("from "), F.translate(dep_top, "/", "."), F.lit(" import "),
                                       dep_sub))
           .when(ext == "ts", F.concat(F.lit("import * as "), dep_sub, F.lit(' from "'), dep_top,
                                       F.lit("/"), dep_sub, F.lit('"')))
           .otherwise(F.concat(F.lit("use "), F.translate(dep_top, "/", "\\"), F.lit("\\"), dep_sub,
                               F.lit(";"))))

    def fn_lines(j: Column) -> Column:
        name = F.concat(F.when(j % 2 == 1, F.lit("Handle")).otherwise(F.lit("helper")), F.lit("_"),
                        s(k), F.lit("_"), s(j))
        np_ = (k + j) % 7
        qs = F.filter(F.sequence(F.lit(1), F.greatest(np_, F.lit(1))), lambda q: q <= np_)
        params = F.array_join(F.transform(qs, lambda q: (
            F.when(ext == "go", F.concat(F.lit("a"), s(q), F.lit(" int")))
            .when(ext == "ts", F.concat(F.lit("a"), s(q), F.lit(": number")))
            .when(ext == "php", F.concat(F.lit("$a"), s(q)))
            .otherwise(F.concat(F.lit("a"), s(q))))), ", ")
        defline = (F.when(ext == "go", F.concat(F.lit("func "), name, F.lit("("), params, F.lit(") error {")))
                   .when(ext == "py", F.concat(F.lit("def "), name, F.lit("("), params, F.lit("):")))
                   .when(ext == "ts", F.concat(F.lit("export function "), name, F.lit("("), params,
                                               F.lit(") {")))
                   .otherwise(F.concat(F.lit("public function "), name, F.lit("("), params, F.lit(") {"))))
        nbody = 2 + (k * j) % 40
        body = F.transform(F.sequence(F.lit(1), nbody.cast("int")), lambda i: (
            F.when(i == 1, F.concat(F.lit("    "), dep_sub, F.lit(".Handle_"), s(k2), F.lit("_1(a)")))
            .when(i == 2, F.concat(F.lit("    helper_"), s(k), F.lit("_2(a)")))
            .otherwise(F.concat(F.lit("    v"), s(i), F.lit(" = "), s(i)))))
        closing = F.when(ext == "py", F.array().cast("array<string>")).otherwise(F.array(F.lit("}")))
        return F.concat(F.array(defline), body, closing)

    nfun = (1 + k % 3).cast("int")
    return F.concat(F.array(header, imp), F.flatten(F.transform(F.sequence(F.lit(1), nfun), fn_lines)))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per part plus test files: repo, path, language, content."""
    # a part is a few bytes, its file's text and lines are thousands: dealt out before they are written, else one split writes all
    p = read_table(spark, sf_dir, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    key = F.col("p_partkey")
    k = file_number(key)
    fp = _file_parts(k)
    repo = F.concat(F.lit("org/repo-"), s(key % N_REPOS))
    yaml = F.array(F.lit("kind: Deployment"), F.lit("metadata:"), F.concat(F.lit("  name: "), fp["base"]),
                   F.lit("spec:"), F.concat(F.lit("  replicas: "), s(1 + k % 5)))
    lines = F.when(fp["ext"] == "yaml", yaml).otherwise(_code_lines(k, fp["ext"], fp["sub"], fp["base"], repo))
    src = p.select(key.alias("part_key"), repo.alias("repo_full_name"), fp["path"].alias("path"),
                   fp["ext"].alias("ext"), F.array_join(lines, "\n").alias("content"),
                   F.lit(False).alias("is_test"))
    ext = fp["ext"]
    test_name = (F.when(ext == "go", F.concat(fp["base"], F.lit("_test.go")))
                 .when(ext == "py", F.concat(F.lit("test_"), fp["base"], F.lit(".py")))
                 .when(ext == "ts", F.concat(fp["base"], F.lit(".test.ts")))
                 .otherwise(F.concat(fp["base"], F.lit("Test.php"))))
    folder = F.concat(fp["top"], F.lit("/"), fp["sub"], F.lit("/"))
    test_path = F.when((k % 2 == 0) | (ext == "go"), F.concat(folder, test_name)) \
        .otherwise(F.concat(F.lit("tests/"), folder, test_name))
    tests = p.filter((k % 3 == 0) & (k % 6 != 3)).select(
        key.alias("part_key"), repo.alias("repo_full_name"), test_path.alias("path"), ext.alias("ext"),
        F.concat(F.lit("// tests for "), fp["base"], F.lit("\nassert Handle_"), s(k),
                 F.lit("_1")).alias("content"),
        F.lit(True).alias("is_test"))
    return src.unionByName(tests)


def _more_kinds(k: Column, ext: Column) -> Column:
    """Eleven lines with other kinds of symbols than functions, per language."""
    n, call = s(k), F.concat(F.lit("m"), s(F.floor(k / 2) % 7), F.lit(".Handle_"), s(F.floor(k / 2)), F.lit("_1(a)"))

    def lines(*parts) -> Column:
        return F.array(*[F.concat(*[F.lit(x) if isinstance(x, str) else x for x in (p if isinstance(p, tuple) else (p,))]) for p in parts])

    return (F.when(ext == "go", lines(
        ("const Max", n, " = 1"), ("type Box", n, " struct {"), "    size int", "}",
        ("func (b *Box", n, ") Grow", n, "(a int, c int) int {"), "    if a {", "        v1 = 1", "    }", "    v2 = 2", ("    ", call), "}"))
        .when(ext == "py", lines(
            ("MAX_", n, " = 1"), ("class Box", n, ":"), ("    def grow", n, "(self, a):"), "        if a:", "            v1 = 1",
            "        v2 = 2", ("        ", call), ("    class Inner", n, ":"), ("        def deep", n, "(self):"), "            v3 = 3", ""))
        .when(ext == "ts", lines(
            ("export interface Shape", n, " {"), "    area(): number;", "}", ("export class Box", n, " {"),
            ("    grow", n, "(a: number): number {"), "        if (a) {", "            v1 = 1", "        }", "        v2 = 2", "    }", "}"))
        .otherwise(lines(
            ("interface Shape", n, " {"), "}", ("class Box", n), "{", ("    const SIZE", n, " = 3;"),
            ("    public function grow", n, "($a) {"), "        v1 = 1", "        v2 = 2", "    }", "}", "")))


def source_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13 by head: file versions, valid from head ``from_head`` of a PR up to ``to_head`` (null: its
    last); rows without a PR are the base, valid where the PR has no version of the file.

    A PR has a version of a file from each head whose diff touches it; assignments in the lines
    where its hunks begin are edited, so a touched file may as well stay as it was."""
    files = source_files(spark, sf_dir).filter(~F.col("is_test"))
    lines = F.split("content", "\n")
    k = file_number(F.col("part_key"))
    content = F.when(F.col("ext") == "yaml", F.col("content")).otherwise(F.array_join(F.concat(
        F.slice(lines, 1, 2), _more_kinds(k, F.col("ext")), F.slice(lines, F.lit(3), F.size(lines))), "\n"))
    files = files.select("part_key", "repo_full_name", "path", "ext", content.alias("content"))
    li = read_table(spark, sf_dir, "lineitem")
    o, ln = F.col("l_orderkey"), F.col("l_linenumber")
    pr = F.floor(o / 3)
    edits = li.select(pr.alias("external_pr_id"), (file_number(F.col("l_partkey")) * N_REPOS + pr % N_REPOS).alias("part_key"),
                      F.struct(o.alias("o"), ln.alias("ln"), (1 + (3 * F.floor(F.col("l_quantity"))) % 60).alias("c")).alias("e"))
    edits = edits.groupBy("external_pr_id", "part_key").agg(F.collect_set("e").alias("edits"))  # one PR's edits of a file
    heads = F.array_sort(F.array_distinct(F.transform("edits", lambda e: e["o"])))
    at = edits.withColumn("heads", heads).select("external_pr_id", "part_key", "edits", "heads", F.posexplode("heads").alias("pos", "from_head")) \
        .withColumn("to_head", F.get("heads", F.col("pos") + 1)).drop("pos", "heads")
    assigned = r"^(\s+v[0-9]+ = ).*$"

    def edited(x: Column, i: Column) -> Column:
        mine = F.array_max(F.transform(F.filter("edits", lambda e: (e["o"] <= F.col("from_head")) & (e["c"] == i + 1)), lambda e: F.struct(e["o"], e["ln"])))
        return bound(mine, lambda e: F.when(e.isNotNull() & x.rlike(assigned), F.concat(
            F.regexp_extract(x, assigned, 1), F.lit("edited "), s(e["o"]), F.lit("-"), s(e["ln"]))).otherwise(x))

    # texts are folded line by line afterwards: keep them dealt out, however few bytes they are; a version's text
    # doesn't travel, its file's does, to each of the shares that the PRs of a much touched file are dealt out to
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = at.withColumn("share", F.pmod("external_pr_id", F.lit(FILE_SHARES))).repartition(width, "part_key", "share")
    shares = files.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(FILE_SHARES - 1)))).withColumn("share", F.col("share").cast("bigint"))
    touched = at.join(grows(shares), ["part_key", "share"]).withColumn("content", F.array_join(F.transform(F.split("content", "\n"), edited), "\n"))
    own = ["repo_full_name", "path", "ext", "external_pr_id", "from_head", "to_head", "content"]
    none = F.lit(None).cast("bigint")
    base = files.withColumns({"external_pr_id": none, "from_head": none, "to_head": none})
    return base.select(*own).unionByName(touched.select(*own))


def task_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of the tasks that ran per PR head and file: that of its first line item's review task."""
    li = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pull_request_id"), file_path_of(F.col("l_partkey")).alias("path")) \
        .agg(F.min("l_linenumber").alias("ln"))
    tasks = review_tasks(spark, sf_dir).select("id", "status")
    return li.withColumn("id", F.col("pull_request_id") * 10 + F.col("ln")).join(tasks, "id").select("pull_request_id", "path", "status")


def scan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7 rules as rows: the fixed scanner rules with their fragments, and for every benchmark item
    a rule that finds its first three words."""
    from ..plans.findings_flow import SCAN_RULES

    fragments = {"hardcoded_secret": ["key", "token", "secret", "password"], "email_address": ["@"], "ipv4_address": ["0.0"],
                 "license_line": ["license", "licence"]}
    fixed = spark.createDataFrame([(r, c, sev, p, fragments[r]) for r, p, c, sev in SCAN_RULES],
                                  "rule_id string, category string, severity string, pattern string, fragments array<string>")
    start = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    items = read_table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("benchmark_"), s(F.col("item_id"))).alias("rule_id"), F.lit("logic").alias("category"), F.lit("low").alias("severity"),
        F.concat(F.lit("\\Q"), start, F.lit("\\E")).alias("pattern"), F.array(start).alias("fragments"))
    return fixed.unionByName(items)


def file_lines(files: DataFrame) -> DataFrame:
    """Files exploded to (path, line_no, text); row-local, no shuffle."""
    return files.select("repo_full_name", "path", "ext", "is_test",
                        F.posexplode(F.split("content", "\n")).alias("pos", "text")) \
        .select("repo_full_name", "path", "ext", "is_test", (F.col("pos") + 1).alias("line_no"), "text")


def _hunk_header(c: Column, d: Column, ln: Column) -> Column:
    return F.when(ln % 4 == 0, F.concat(F.lit("@@ -"), s(c), F.lit(" +"), s(c), F.lit(" @@"))) \
        .otherwise(F.concat(F.lit("@@ -"), s(c), F.lit(","), s(d), F.lit(" +"), s(c), F.lit(","), s(d),
                            F.lit(" @@")))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unified diff text per PR (order): one file section per line item.

    One text per PR is the reference's data model (a PR carries one diff); the
    per-PR list is bounded by that PR's line items."""
    li = read_table(spark, sf_dir, "lineitem")

    # written after the shuffle: a line item's numbers are a fraction of its text
    def section(x: Column) -> Column:
        ln, path = x["ln"], file_path_of(x["pk"])
        c = 1 + (3 * F.floor(x["q"])) % 60
        return F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path,
                        F.lit("\n+++ b/"), path, F.lit("\n"), _hunk_header(c, 2 * ln, ln),
                        F.lit("\n+changed line "), s(ln))

    rows = li.select(F.col("l_orderkey").alias("pull_request_id"),
                     F.struct(F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
                              F.col("l_quantity").alias("q")).alias("x"))
    return rows.groupBy("pull_request_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("x")), section), "\n").alias("diff")) \
        .withColumn("repo_full_name", repo_of_order(F.col("pull_request_id")))


def _json_str(x: Column) -> Column:
    return F.concat(F.lit('"'), x, F.lit('"'))


def _finding_json(x: Column) -> Column:
    """The finding object of a line item (pk, sk, q, ln, discount); without a supplier or a number it takes the last name."""
    def named(values: list[str], i: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.coalesce((i + 1).cast("int"), F.lit(-1)))

    pk, sk, ln = x["pk"], x["sk"], x["ln"]
    c = 1 + (3 * F.floor(x["q"])) % 60
    cat = F.when(pk % 17 == 0, F.lit("bogus")).otherwise(named(CATEGORIES, sk % 5))
    conf = F.when(pk % 19 == 0, F.lit(1.5)).otherwise(F.round(x["discount"] * 10, 2))
    tier = F.when(pk % 29 == 0, "low").when(conf >= 0.8, "high").when(conf >= 0.5, "medium").otherwise("low")
    start = F.when(pk % 23 == 0, c + 500).when(pk % 31 != 0, c + ln % 2)
    end = F.when(pk % 37 == 0, start + 500).otherwise(start + 1)
    return F.concat(
        F.lit('{"category":'), _json_str(cat),
        F.lit(',"severity":'), _json_str(named(SEVERITIES, ln % 5)),
        F.lit(',"confidence_tier":'), _json_str(tier),
        F.lit(',"confidence_score":'), s(conf),
        F.lit(',"start_line":'), F.coalesce(s(start), F.lit("null")),
        F.lit(',"end_line":'), F.coalesce(s(end), F.lit("null")),
        F.lit(',"title":'), _json_str(F.concat(F.lit("Issue "), s(sk))),
        F.lit(',"body":'), _json_str(F.concat(F.lit("Check value "), s(F.floor(x["q"])))),
        F.lit("}"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model answer per review task: task_id, file_path (of the task), raw, completion tokens.

    Each line item of the task is one finding object; answers come as raw
    JSON (o%4=0), fenced (1), prose then fence (2) or without its last bracket
    (3); the last kind comes once more, fenced and whole, but for o%20=3."""
    li = read_table(spark, sf_dir, "lineitem")

    # written after the shuffle: a line item's numbers are a fraction of its text
    rows = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task_id"), F.col("l_orderkey").alias("o"),
                     F.struct(F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_quantity").alias("q"),
                              F.col("l_linenumber").alias("ln"), F.col("l_discount").alias("discount")).alias("x"))
    g = rows.groupBy("task_id", "o").agg(
        file_path_of(F.min("x.pk")).alias("file_path"),
        F.array_join(F.transform(F.array_sort(F.transform(F.collect_list("x"), lambda x: F.struct(
            x["pk"].alias("pk"), x["sk"].alias("sk"), x["q"].alias("q"), _finding_json(x).alias("obj")))), lambda x: x["obj"]), ",").alias("objs"))
    payload = F.concat(F.lit('{"findings":['), F.col("objs"), F.lit("]}"))
    unclosed = F.concat(F.lit('{"findings":['), F.col("objs"), F.lit("]"))
    kind = F.col("o") % 4
    raw = (F.when(kind == 0, payload)
           .when(kind == 1, F.concat(F.lit("```json\n"), payload, F.lit("\n```")))
           .when(kind == 2, F.concat(F.lit("Here is my review.\n```json\n"), payload, F.lit("\n```\nDone.")))
           .when(F.col("o") % 20 == 3, unclosed)
           .otherwise(F.concat(unclosed, F.lit("\n```json\n"), payload, F.lit("\n```"))))
    return g.select("task_id", (F.col("o")).alias("pull_request_id"), "file_path", raw.alias("raw"),
                    F.ceil(F.octet_length(raw) / F.lit(3.33)).cast("bigint").alias("completion_tokens"))
