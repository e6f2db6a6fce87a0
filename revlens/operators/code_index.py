"""Approximate code index as Spark jobs.

Re-aims the syntax-tree index: definitions, imports and calls come from
per-language regular expressions over exploded file lines (always flagged
approximate).  Everything is row-local except the joins that connect files:
hunks to symbols (a line-bucketed range join), calls to imports to changed
symbols (two equi joins, output-sized), and test-file candidates to files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import grows

# ---------------------------------------------------------------------------
# FIXED VALUES: definition / import patterns per language (our own rules)
# ---------------------------------------------------------------------------
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
DEF_PATTERNS = {
    "go": rf"^func\s+({IDENT})\s*\(([^)]*)\)",
    "py": rf"^\s*def\s+({IDENT})\s*\(([^)]*)\)",
    "ts": rf"^\s*(?:export\s+)?(?:async\s+)?function\s+({IDENT})\s*\(([^)]*)\)",
    "php": rf"^\s*(?:public\s+|private\s+|protected\s+)?(?:static\s+)?function\s+({IDENT})\s*\(([^)]*)\)",
}
QUALIFIED_CALL = rf"{IDENT}\.{IDENT}\("
UNQUALIFIED_CALL = rf"(?:^|[^.A-Za-z0-9_])({IDENT})\("
HUNK_HEADER = r"@@ -[0-9]+(?:,[0-9]+)? \+[0-9]+(?:,[0-9]+)? @@"
RANGE_BUCKET_LINES = 64
# ---------------------------------------------------------------------------


def _by_ext(ext: Column, exprs: dict[str, Column]) -> Column:
    out = None
    for e, x in exprs.items():
        out = F.when(ext == e, x) if out is None else out.when(ext == e, x)
    return out


def parse_hunks(diffs: DataFrame, exact_end: bool = False) -> DataFrame:
    """Unified diff -> one row per hunk (pull_request_id, path, start, end).

    A missing count means 1.  ``end = start + count`` reproduces the
    reference's range (Q16); ``exact_end`` gives ``start + count - 1``.
    File sections come from splitting on the ``diff --git`` marker; no window.
    """
    sec = diffs.select("pull_request_id", "repo_full_name", F.explode(F.split("diff", "diff --git ")).alias("section")) \
        .filter(F.col("section") != "")
    sec = sec.select("pull_request_id", "repo_full_name", F.regexp_extract("section", r"\+\+\+ b/(\S+)", 1).alias("path"),
                     F.explode(F.regexp_extract_all("section", F.lit(HUNK_HEADER), 0)).alias("header"))
    start = F.regexp_extract("header", r"\+([0-9]+)", 1).cast("int")
    cnt = F.coalesce(F.nullif(F.regexp_extract("header", r"\+[0-9]+,([0-9]+)", 1), F.lit("")),
                     F.lit("1")).cast("int")
    end = start + cnt - (1 if exact_end else 0)
    return sec.select("pull_request_id", "repo_full_name", "path", start.alias("start"), end.alias("end"))


def diff_sections(diffs: DataFrame) -> DataFrame:
    """Per (PR, path) the diff section text (the slice's diff content)."""
    sec = diffs.select("pull_request_id", "repo_full_name", F.explode(F.split("diff", "diff --git ")).alias("section")) \
        .filter(F.col("section") != "")
    return sec.select("pull_request_id", "repo_full_name", F.regexp_extract("section", r"\+\+\+ b/(\S+)", 1).alias("path"),
                      F.concat(F.lit("diff --git "), F.col("section")).alias("section"))


def changed_files(diffs: DataFrame) -> DataFrame:
    """Distinct changed paths per PR."""
    return diff_sections(diffs).select("pull_request_id", "repo_full_name", "path").distinct()


def definitions(lines: DataFrame) -> DataFrame:
    """H28 (defs): function definitions with parameter count and exported flag."""
    ext = F.col("ext")
    name = _by_ext(ext, {e: F.regexp_extract("text", p, 1) for e, p in DEF_PATTERNS.items()})
    params = _by_ext(ext, {e: F.regexp_extract("text", p, 2) for e, p in DEF_PATTERNS.items()})
    d = lines.filter(~F.col("is_test")).select("repo_full_name", "path", "ext", "line_no",
                                               name.alias("name"), params.alias("params"))
    d = d.filter(F.coalesce(F.col("name"), F.lit("")) != "")
    pc = F.when(F.trim("params") == "", 0).otherwise(F.size(F.split("params", ",")))
    return d.select("repo_full_name", "path", "ext", F.col("line_no").alias("start_line"), "name",
                    pc.alias("param_count"), F.col("name").rlike("^[A-Z]").alias("exported"),
                    F.lit("func").alias("kind"))


def imports(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """H28 (imports): importer path -> imported package folder and alias; ``keep`` names more key columns."""
    ext, t = F.col("ext"), F.col("text")
    pkg = _by_ext(ext, {
        "go": F.regexp_replace(F.regexp_extract(t, r'^import\s+"([^"]+)"', 1), r"^[^/]+/[^/]+/", ""),
        "py": F.concat_ws("/", F.translate(F.regexp_extract(t, r"^from\s+([A-Za-z0-9_.]+)\s+import\s+", 1), ".", "/"),
                          F.regexp_extract(t, r"^from\s+[A-Za-z0-9_.]+\s+import\s+([A-Za-z0-9_]+)", 1)),
        "ts": F.regexp_extract(t, r'^import\s+\*\s+as\s+[A-Za-z0-9_]+\s+from\s+"([^"]+)"', 1),
        "php": F.translate(F.regexp_extract(t, r"^use\s+([A-Za-z0-9_\\]+);", 1), "\\", "/"),
    })
    # every pattern begins so: most lines are told by that
    lines = lines.filter(t.startswith("import") | t.startswith("from") | t.startswith("use"))
    d = lines.select("repo_full_name", *keep, F.col("path").alias("importer"), pkg.alias("package"))
    d = d.filter(F.regexp_extract("package", r"([^/]+)$", 1) != "")
    return d.select("repo_full_name", *keep, "importer", "package", F.regexp_extract("package", r"([^/]+)$", 1).alias("alias")).distinct()


def calls(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """H28 (calls): qualified ``alias.Name(`` and unqualified ``Name(`` uses,
    outside definition lines; ``keep`` names more key columns."""
    ext = F.col("ext")
    is_def = _by_ext(ext, {e: F.col("text").rlike(p) for e, p in DEF_PATTERNS.items()})
    # both kinds have an opening bracket; they are found in one pass, so the lines are made once
    body = lines.filter(F.col("text").contains("(")).filter(~F.coalesce(is_def, F.lit(False)))
    q = F.transform(F.regexp_extract_all("text", F.lit(QUALIFIED_CALL), 0), lambda m: F.struct(
        F.split(m, r"\.").getItem(0).alias("alias"), F.regexp_replace(F.split(m, r"\.").getItem(1), r"\($", "").alias("name"),
        F.lit(True).alias("qualified")))
    u = F.transform(F.regexp_extract_all("text", F.lit(UNQUALIFIED_CALL), 1), lambda m: F.struct(
        F.lit(None).cast("string").alias("alias"), m.alias("name"), F.lit(False).alias("qualified")))
    return body.select("repo_full_name", *keep, "path", "line_no", "text", F.explode(F.concat(q, u)).alias("c")) \
        .select("repo_full_name", *keep, "path", "line_no", "text", "c.*")


def symbol_ranges(defs: DataFrame, lines: DataFrame) -> DataFrame:
    """A definition ends on the line before the next one, the last one at
    the end of the file.  Windows are per file (bounded by file size)."""
    n = lines.groupBy("repo_full_name", "path").agg(F.max("line_no").alias("n_lines"))
    w = Window.partitionBy("repo_full_name", "path").orderBy("start_line", "name")
    return defs.join(grows(n), ["repo_full_name", "path"]).withColumn(
        "end_line", F.coalesce(F.lead("start_line").over(w) - 1, F.col("n_lines"))).drop("n_lines")


def _buckets(lo: Column, hi: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / size), F.floor(F.greatest(lo, hi) / size)))


def overlapping_symbols(hunks: DataFrame, symbols: DataFrame, bucket: int = RANGE_BUCKET_LINES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Symbols whose line range meets a changed range of the same file.

    Range join as an equi join on (repository, path, line bucket) plus the interval test;
    a pair is reported only in the bucket of its first common line, so there
    are no duplicates and no all-pairs blow-up inside a hot file.
    Returns one row per (PR, symbol) with the number of changed lines inside it; ``keep`` names more of the symbols' columns.
    """
    h = hunks.select("pull_request_id", "repo_full_name", "path", F.col("start").alias("h_start"), F.col("end").alias("h_end"),
                     _buckets(F.col("start"), F.col("end"), bucket).alias("b"))
    s = symbols.select("path", "name", "start_line", "end_line", "param_count", "exported", "kind", "ext",
                       "repo_full_name", *keep, _buckets(F.col("start_line"), F.col("end_line"), bucket).alias("b"))
    j = h.join(grows(s), ["repo_full_name", "path", "b"]).filter(
        (F.col("start_line") <= F.col("h_end")) & (F.col("end_line") >= F.col("h_start")) &
        (F.col("b") == F.floor(F.greatest("start_line", "h_start") / bucket)))
    overlap = F.least("end_line", "h_end") - F.greatest("start_line", "h_start") + 1
    # a definition is its path, name and place: two of one name stay two
    return j.groupBy("pull_request_id", "path", "name", "start_line", "end_line", "param_count", "exported", "kind",
                     "ext", "repo_full_name", *keep).agg(F.sum(overlap).alias("changed_lines"))


def package_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]+$", 1)


def symbol_references(symbols: DataFrame, imps: DataFrame, cls: DataFrame) -> DataFrame:
    """References to each symbol (repository, path, name) from files importing its package,
    once per symbol, however many PRs changed it.

    Pass 1 (package filter): calls are resolved against the importer's own
    imports -- qualified by alias, unqualified through any imported package.
    Pass 2 (symbol match): resolved (package, name) meets the symbols.
    Both are equi joins whose output is the set of real references.
    """
    resolved_q = cls.filter("qualified").join(
        grows(imps.withColumnRenamed("importer", "path")), ["repo_full_name", "path", "alias"]) \
        .select("repo_full_name", F.col("path").alias("importer"), "line_no", "text", "package", "name")
    resolved_u = cls.filter(~F.col("qualified")).join(
        grows(imps.withColumnRenamed("importer", "path").drop("alias")), ["repo_full_name", "path"]) \
        .select("repo_full_name", F.col("path").alias("importer"), "line_no", "text", "package", "name")
    resolved = resolved_q.unionByName(resolved_u)
    wanted = symbols.select("repo_full_name", "path", "name").distinct().withColumn("package", package_of(F.col("path")))
    return wanted.join(grows(resolved), ["repo_full_name", "package", "name"]).select(
        "repo_full_name", "path", "name", "importer", "line_no", "text").distinct()


def change_cone(changed: DataFrame, imps: DataFrame, cls: DataFrame) -> DataFrame:
    """C8 per PR: the map of PRs to changed symbols, with each symbol's references."""
    pr_symbols = changed.select("pull_request_id", "repo_full_name", "path", "name").distinct()
    return pr_symbols.join(grows(symbol_references(changed, imps, cls)), ["repo_full_name", "path", "name"]).select(
        "pull_request_id", "path", "name", "importer", "line_no", "text")


def test_file_map(files: DataFrame) -> DataFrame:
    """Source file -> first existing test file by ordered naming rules;
    mirrored ``tests/`` fallback except for Go."""
    src = files.filter(~F.col("is_test") & F.col("ext").isin("go", "py", "ts", "php"))
    d = package_of(F.col("path"))
    base = F.regexp_extract("path", r"([^/]+)\.[A-Za-z0-9]+$", 1)
    same = F.concat(d, F.lit("/"))
    mirror = F.concat(F.lit("tests/"), d, F.lit("/"))

    def cand(*pairs):
        return F.array(*[F.struct(F.lit(i + 1).alias("priority"), p.alias("candidate"))
                         for i, p in enumerate(pairs)])

    cands = (F.when(F.col("ext") == "go", cand(F.concat(same, base, F.lit("_test.go"))))
             .when(F.col("ext") == "py", cand(F.concat(same, F.lit("test_"), base, F.lit(".py")),
                                              F.concat(same, base, F.lit("_test.py")),
                                              F.concat(mirror, F.lit("test_"), base, F.lit(".py"))))
             .when(F.col("ext") == "ts", cand(F.concat(same, base, F.lit(".test.ts")),
                                              F.concat(same, base, F.lit(".spec.ts")),
                                              F.concat(mirror, base, F.lit(".test.ts"))))
             .otherwise(cand(F.concat(same, base, F.lit("Test.php")),
                             F.concat(mirror, base, F.lit("Test.php")))))
    c = src.select("repo_full_name", "path", F.explode(cands).alias("c")) \
        .select("repo_full_name", "path", "c.priority", "c.candidate")
    existing = files.select("repo_full_name", F.col("path").alias("candidate"))
    hit = c.join(grows(existing), ["repo_full_name", "candidate"])
    return hit.groupBy("repo_full_name", "path").agg(F.min_by("candidate", "priority").alias("test_path"))
