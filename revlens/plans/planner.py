"""Planner and context assembly.

Task generation is a chain of joins over whole tables: changed symbols ->
test map -> risk -> threshold -> typed tasks, plus file-level tasks.  Slice
building works on lengths first (token counts are sums, combined map-side)
and materialises text last, each section cut to its allocation.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BYTES_PER_TOKEN, DEFAULT, MODEL_BUDGETS, ReviewConfig
from ..functions.hashing import prompt_hash
from ..functions.scoring import (budget_total, language_of, model_budget, path_risk, risk_score,
                                 route_model, task_types, token_budget, token_count)
from ..functions.text import TRUNCATED_MARKER
from ..operators import code_index as X
from ..operators.windows import keyed_running_sum
from ..sources.synth import file_lines
from ..sources.tables import grows

NUL = "\x00"


def task_id(pr, path, symbol, task_type) -> Column:
    """Deterministic task id: retries and re-runs produce the same ids."""
    return F.sha2(F.concat_ws(NUL, F.col(pr).cast("string"), F.col(path),
                              F.coalesce(F.col(symbol), F.lit("")), F.col(task_type)), 256)


class Index:
    """The approximate index of one file snapshot (lazy DataFrames)."""

    def __init__(self, files: DataFrame, diffs: DataFrame, cfg: ReviewConfig = DEFAULT,
                 persist: bool = True):
        # Symbols, changed symbols and the test map are read by several
        # consumers; they are persisted once (memory, spilling to disk).  Identical plans
        # share the cached blocks; lost blocks are recomputed from lineage.
        keep = (lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)) if persist else (lambda df: df)
        # Files, diffs and lines are not: their texts outgrow memory, fill the disk,
        # and cost less to derive again, each time only the columns read. Nor are hunks:
        # the changed symbols, which are kept, are all that most queries read them for.
        self.files, self.diffs = files, diffs
        self.lines = file_lines(self.files)
        self.defs = X.definitions(self.lines)
        self.symbols = keep(X.symbol_ranges(self.defs, self.lines))
        self.imports = X.imports(self.lines)
        self.calls = X.calls(self.lines)
        self.hunks = X.parse_hunks(self.diffs, cfg.exact_hunk_end)
        self.tests = keep(X.test_file_map(self.files))
        # symbols are few beside their changes: they meet their tests, not each change its own
        tested = self.symbols.join(grows(self.tests), ["repo_full_name", "path"], "left").withColumn("has_tests", F.col("test_path").isNotNull())
        self.changed = keep(X.overlapping_symbols(self.hunks, tested, keep=("has_tests",)))

    def release(self) -> None:
        """Drop the persisted index tables once the consumers are done."""
        for df in (self.symbols, self.changed, self.tests):
            df.unpersist()


def scored_symbols(ix: Index, cfg: ReviewConfig = DEFAULT) -> DataFrame:
    """H8: changed symbols with has_tests and risk score."""
    return ix.changed.withColumn("risk_score", F.round(risk_score("path", "exported", "kind", "param_count",
                                                         "has_tests", "changed_lines"), 4))


def above_threshold(scored: DataFrame, cfg: ReviewConfig = DEFAULT) -> DataFrame:
    """Drop risk below the low threshold unless the PR changed fewer than
    ``small_pr_symbols`` symbols (Q17).  The per-PR count is an aggregation
    joined back, not a window, so a huge PR is not one task."""
    n = scored.groupBy("pull_request_id").agg(F.count(F.lit(1)).alias("changed_symbols"))
    d = scored.join(grows(n), "pull_request_id")
    return d.filter((F.col("risk_score") >= cfg.low_risk) | (F.col("changed_symbols") < cfg.small_pr_symbols))


def file_level_tasks(ix: Index, cfg: ReviewConfig = DEFAULT) -> DataFrame:
    """H13 (+H12): one logic task per changed file that has no grammar or no
    changed symbol; risk from the path only."""
    no_grammar = ~F.coalesce(F.col("ext").isin("go", "py", "ts", "php"), F.lit(False))
    with_sym = ix.changed.select("pull_request_id", "path").distinct()
    # most files have one: the few that are left meet their languages
    no_symbols = X.changed_files(ix.diffs).join(grows(with_sym), ["pull_request_id", "path"], "left_anti")
    no_symbols = no_symbols.join(grows(ix.files.filter(~F.col("is_test")).select("repo_full_name", "path", "ext")), ["repo_full_name", "path"], "left")
    return no_symbols.select(
        "pull_request_id", "repo_full_name", "path", F.lit("").alias("symbol"), F.lit("logic").alias("task_type"),
        path_risk("path").alias("risk_score"), route_model(F.lit("logic"), cfg).alias("model_id"),
        F.lit(True).alias("file_level"), no_grammar.alias("no_grammar"))


def generate_tasks(ix: Index, cfg: ReviewConfig = DEFAULT, by_type: bool = True) -> DataFrame:
    """Scored, thresholded, typed and routed tasks plus file-level tasks.

    Without ``by_type`` a row holds the ``task_types`` of one symbol or file: what is joined to them
    travels once, and ``per_type`` makes the tasks of them afterwards."""
    s = above_threshold(scored_symbols(ix, cfg), cfg)
    typed = s.select("pull_request_id", "repo_full_name", "path", F.col("name").alias("symbol"), "risk_score",
                     task_types("path", "name", "exported", "start_line", "end_line", "param_count", "has_tests").alias("task_types"),
                     F.lit(False).alias("file_level"), F.lit(False).alias("no_grammar"))
    files = file_level_tasks(ix, cfg).withColumn("task_types", F.array("task_type")).drop("task_type", "model_id")
    out = typed.unionByName(files)
    return per_type(out, cfg) if by_type else out


def per_type(tasks: DataFrame, cfg: ReviewConfig = DEFAULT) -> DataFrame:
    """One row per task: its type, model and id."""
    return tasks.withColumn("task_type", F.explode("task_types")).drop("task_types").withColumn("model_id", route_model("task_type", cfg)) \
        .withColumn("task_id", task_id("pull_request_id", "path", "symbol", "task_type"))


def truncate_to_tokens(text: Column, tokens: Column) -> Column:
    """Longest whole-line prefix whose token estimate fits (Q19), row-local:
    cut at the byte bound, then drop the trailing partial line."""
    max_bytes = F.floor(tokens * F.lit(BYTES_PER_TOKEN)).cast("int")
    fits = F.octet_length(text) <= max_bytes
    # one byte more than the bound: a line ending exactly at the bound keeps its newline
    room = F.greatest(max_bytes, F.lit(0))
    cut = _utf8_prefix(text, room + 1)
    prefix = F.regexp_replace(cut, r"\n[^\n]*$", "")
    # not even the first line fits: it is cut at the bound, at a character
    prefix = F.when(F.instr(cut, "\n") == 0, F.regexp_replace(_utf8_prefix(text, room), "\uFFFD+$", "")) \
        .otherwise(prefix)
    return F.when(text.isNull(), F.lit(None)).when(fits, text).otherwise(prefix)


def _utf8_prefix(text: Column, n_bytes: Column) -> Column:
    """The first bytes of a text; a character cut in two becomes U+FFFD."""
    return F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, n_bytes).cast("string"))


def pack_lines(lines: DataFrame, group: list[str], order: list[str], text: str, cap: Column,
               bucket: Column) -> DataFrame:
    """Every line with its running token estimate and whether the joined
    prefix up to it stays under ``cap`` (``kept``).

    ``bucket`` must not decrease along ``order`` inside a group: the running
    sum goes bucket by bucket, so a group of any length is spread over tasks.
    """
    d = lines.withColumn("_cap", cap).withColumn("_bytes", F.octet_length(text) + 1)
    d = keyed_running_sum(d, group, [F.col(c) for c in order], F.col("_bytes"), bucket, "_cum")
    d = d.withColumn("running_tokens", F.ceil((F.col("_cum") - 1) / F.lit(BYTES_PER_TOKEN)).cast("bigint"))
    return d.withColumn("kept", F.coalesce(F.col("running_tokens") <= F.col("_cap"), F.lit(True))) \
        .drop("_bytes", "_cum", "_cap")


def allocate(diff_t, cg_t, test_t, cap_d, cap_cg, cap_t, total) -> Column:
    """J4 fill rule on token counts: diff -> call graph -> tests, remainder
    handed back to the diff; returns struct of allocations + truncated."""
    d0 = F.least(diff_t, cap_d)
    rem = total - d0
    cg = F.greatest(F.least(cg_t, cap_cg, rem), F.lit(0))
    rem2 = rem - cg
    t = F.greatest(F.least(test_t, cap_t, rem2), F.lit(0))
    rem3 = rem2 - t
    extra = F.when((rem3 > 0) & (diff_t > d0), F.least(diff_t - d0, rem3)).otherwise(0)
    return F.struct((d0 + extra).alias("diff_tokens"), cg.alias("call_graph_tokens"),
                    t.alias("test_tokens"), (diff_t > total).alias("truncated"))


def build_slices(ix: Index, tasks: DataFrame, cfg: ReviewConfig = DEFAULT) -> DataFrame:
    """Per task the budget (H3/H5), available tokens per section, the
    allocation and the three section texts cut to it.

    ``tasks``: those of ``generate_tasks``, better not yet by type: their types share what they meet."""
    sec = X.diff_sections(ix.diffs).groupBy("pull_request_id", "path").agg(
        F.array_join(F.array_sort(F.collect_list("section")), "\n").alias("diff_text")) \
        .withColumn("diff_available", token_count("diff_text"))
    # references are kept per symbol; tasks read them through their own (repository, path, symbol)
    cone = X.symbol_references(ix.changed, ix.imports, ix.calls)
    of_symbol = ["repo_full_name", "path", "symbol"]
    ref_line = F.concat(F.col("importer"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "),
                        F.trim("text"))
    refs = cone.select("repo_full_name", "path", F.col("name").alias("symbol"), "importer", "line_no",
                       ref_line.alias("ref"))
    # call-graph text: running tokens depend only on the symbol's reference
    # list, not on the task, so lines are packed once per symbol and
    # each task keeps the prefix under its own allocation, row-locally. Lines
    # beyond the largest model budget are in no task's prefix.
    packed = pack_lines(refs, of_symbol, ["importer", "line_no"], "ref", F.lit(None).cast("bigint"), F.col("importer"))
    ranked = packed.groupBy(*of_symbol).agg(
        (F.sum(F.octet_length("ref") + 1) - 1).alias("cg_bytes"),
        F.array_sort(F.collect_list(F.when(F.col("running_tokens") <= max(MODEL_BUDGETS.values()), F.struct(
            "running_tokens", "importer", "line_no", "ref")))).alias("_refs")) \
        .withColumn("_refs", F.when(F.size("_refs") > 0, F.col("_refs")))
    test_text = ix.tests.join(grows(ix.files.select(
        "repo_full_name", F.col("path").alias("test_path"), F.col("content").alias("test_text"), token_count("content").alias("test_available"))),
        ["repo_full_name", "test_path"]).select("repo_full_name", "path", "test_text", "test_available")
    # what a symbol's (or, without one, a file's) tasks share is put together first: tasks travel once by
    # diff and once by symbol, and their lengths are known before, so that allocations alone take no text along
    named = ix.symbols.select("repo_full_name", "path", F.col("name").alias("symbol")).unionByName(
        ix.files.filter(~F.col("is_test")).select("repo_full_name", "path", F.lit("").alias("symbol"))).distinct()
    shared = named.join(grows(test_text), ["repo_full_name", "path"]).join(grows(ranked), of_symbol, "full")
    t = tasks.join(grows(sec), ["pull_request_id", "path"], "left").join(grows(shared), of_symbol, "left")
    if "task_types" in t.columns:
        t = per_type(t, cfg)
    appr = F.coalesce(language_of("path")["approximate"], F.lit(False))
    if cfg.approximate_index == "always":
        appr = F.lit(True)
    t = t.withColumn("budget", token_budget(model_budget("model_id"), F.col("task_type"), appr))
    # clamped caps can add up to more than the model's budget, which bounds the whole slice
    total = F.least(F.col("budget.diff_hunk") + F.col("budget.call_graph") + F.col("budget.tests"),
                    model_budget("model_id"))
    none = token_count(F.lit(None).cast("string"))
    diff_t = F.coalesce("diff_available", none)
    cg_t = F.ceil(F.coalesce(F.col("cg_bytes"), F.lit(0)) / F.lit(BYTES_PER_TOKEN)).cast("bigint")
    test_t = F.coalesce("test_available", none)
    t = t.withColumn("alloc", allocate(diff_t, cg_t, test_t, F.col("budget.diff_hunk"),
                                       F.col("budget.call_graph"), F.col("budget.tests"), total))
    cg_cap = F.col("alloc.call_graph_tokens")
    t = t.withColumn("call_graph_text", F.when(cg_cap > 0, F.array_join(F.transform(
        F.filter("_refs", lambda x: x["running_tokens"] <= cg_cap), lambda x: x["ref"]), "\n")))
    diff_cut = truncate_to_tokens(F.col("diff_text"), F.col("alloc.diff_tokens"))
    test_cut = truncate_to_tokens(F.col("test_text"), F.col("alloc.test_tokens"))
    return t.select(
        "task_id", "pull_request_id", "path", "symbol", "task_type", "model_id",
        F.col("budget.diff_hunk").alias("cap_diff"), F.col("budget.call_graph").alias("cap_call_graph"),
        F.col("budget.tests").alias("cap_tests"), budget_total(F.col("budget")).alias("cap_total"),
        diff_t.alias("diff_available"), cg_t.alias("call_graph_available"), test_t.alias("test_available"),
        "alloc.diff_tokens", "alloc.call_graph_tokens", "alloc.test_tokens", "alloc.truncated",
        F.when(F.col("alloc.diff_tokens") < diff_t, F.concat(diff_cut, F.lit("\n" + TRUNCATED_MARKER)))
        .otherwise(F.col("diff_text")).alias("diff_hunk"),
        F.when(F.col("alloc.call_graph_tokens") > 0, F.col("call_graph_text")).alias("call_graph"),
        F.when(F.col("alloc.test_tokens") <= 0, F.lit(None))
        .when(F.col("alloc.test_tokens") < test_t, F.concat(test_cut, F.lit("\n" + TRUNCATED_MARKER)))
        .otherwise(F.col("test_text")).alias("test_context"))


# ---------------------------------------------------------------------------
# Prompt texts (our own wording of the specification's prompt structure)
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = ("You review one change of a pull request. Report only concrete problems "
                 "in the changed code as JSON: {\"findings\": [...]}.")
FRAMING = {
    "security": "Focus: security -- injection, authentication, secrets, unsafe input handling.",
    "logic": "Focus: correctness -- control flow, error handling, edge cases.",
    "test_coverage": "Focus: missing or weak tests for the changed behaviour.",
    "style": "Focus: readability and structure of large or complex functions.",
}
APPROXIMATE_NOTICE = "Note: call graph and test context come from an approximate index."


def build_prompts(slices: DataFrame, cfg: ReviewConfig = DEFAULT) -> DataFrame:
    """One prompt per task; NULL sections drop out of ``concat_ws``."""
    fr = None
    for k, v in FRAMING.items():
        fr = F.when(F.col("task_type") == k, v) if fr is None else fr.when(F.col("task_type") == k, v)
    notice = F.when((F.coalesce(F.col("call_graph_tokens"), F.lit(0)) + F.coalesce(F.col("test_tokens"), F.lit(0)) > 0)
                    & F.lit(cfg.approximate_index == "always"), F.lit(APPROXIMATE_NOTICE))
    prompt = F.concat_ws(
        "\n\n", F.lit(SYSTEM_PROMPT), fr, notice,
        F.concat(F.lit("## Target\n"), F.col("path"), F.lit(" "), F.coalesce(F.col("symbol"), F.lit(""))),
        F.when(F.col("diff_hunk").isNotNull(), F.concat(F.lit("## Diff\n"), F.col("diff_hunk"))),
        F.when(F.col("call_graph").isNotNull(), F.concat(F.lit("## Callers\n"), F.col("call_graph"))),
        F.when(F.col("test_context").isNotNull(), F.concat(F.lit("## Tests\n"), F.col("test_context"))))
    return slices.select("task_id", "pull_request_id", "task_type", "model_id", prompt.alias("prompt")) \
        .withColumn("prompt_hash", prompt_hash("prompt")).withColumn("prompt_tokens", token_count("prompt"))
