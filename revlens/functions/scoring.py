"""Scalar scoring and classification expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (BUDGET_BP_APPROXIMATE, BUDGET_BP_EXACT, BYTES_PER_TOKEN, DEFAULT,
                      INFRA_EXTENSIONS, INFRA_PATH_WORDS, LANGUAGES, MODEL_BUDGETS,
                      PATH_RISK_PATTERNS, SECURITY_PATH_PATTERNS, SEVERITY_RANK,
                      ReviewConfig)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tier_from_score(score, cfg: ReviewConfig = DEFAULT) -> Column:
    """>= high -> high, >= medium -> medium, else low."""
    s = _c(score)
    return F.when(s >= cfg.high_tier, "high").when(s >= cfg.medium_tier, "medium") \
        .otherwise("low")


def tier_rank(tier) -> Column:
    t = _c(tier)
    return F.when(t == "high", 3).when(t == "medium", 2).when(t == "low", 1).otherwise(0)


def round_confidence(x) -> Column:
    """4 decimals, half away from zero: round(x*10000)/10000."""
    return F.round(_c(x) * 10000) / 10000


def tier_ok(tier, score, cfg: ReviewConfig = DEFAULT) -> Column:
    """The tier must match the score range."""
    return tier_from_score(score, cfg) == _c(tier)


def severity_rank(sev) -> Column:
    """Critical 5 .. info 1, unknown 0."""
    s = _c(sev)
    expr = None
    for name, rank in SEVERITY_RANK.items():
        expr = F.when(s == name, rank) if expr is None else expr.when(s == name, rank)
    return expr.otherwise(0)


def escalates(category, severity, cfg: ReviewConfig = DEFAULT) -> Column:
    """Security findings of escalating severity always go inline."""
    return F.coalesce((_c(category) == "security") &
                      _c(severity).isin(*cfg.escalate_severities), F.lit(False))


def path_risk(path) -> Column:
    """H7: best score over case-sensitive path substrings, 0 when none."""
    p = _c(path)
    return F.greatest(F.lit(0.0), *[F.when(p.contains(pat), F.lit(score)).otherwise(0.0)
                                    for pat, score in PATH_RISK_PATTERNS])


def is_security_path(path) -> Column:
    p = _c(path)
    out = F.lit(False)
    for pat in SECURITY_PATH_PATTERNS:
        out = out | p.contains(pat)
    return out


def is_handler_like(name) -> Column:
    """Q19: a name containing handler/handle/serve, case-insensitive."""
    return F.lower(_c(name)).rlike("handle|serve")


def risk_score(path, exported, kind, param_count, has_tests, changed_lines) -> Column:
    """H8: additive risk signals, capped at 1.0."""
    pc = F.coalesce(_c(param_count), F.lit(0))
    cl = F.coalesce(_c(changed_lines), F.lit(0))
    score = (path_risk(path)
             + F.when(_c(exported), 0.1).otherwise(0.0)
             + F.when(_c(kind).isin("func", "method"), 0.05).otherwise(0.0)
             + F.when(pc > 5, 0.1).when(pc > 3, 0.05).otherwise(0.0)
             + F.when(~F.coalesce(_c(has_tests), F.lit(False)), 0.15).otherwise(0.0)
             + F.when(cl > 50, 0.2).when(cl > 20, 0.1).otherwise(0.0))
    return F.least(score, F.lit(1.0))


def task_types(path, name, exported, start_line, end_line, param_count, has_tests) -> Column:
    """H9: array of task types for a changed symbol, in the fixed order."""
    pc = F.coalesce(_c(param_count), F.lit(0))
    span = F.coalesce(_c(end_line) - _c(start_line), F.lit(0))
    return F.array_compact(F.array(
        F.when(is_security_path(path) |
               (F.coalesce(_c(exported), F.lit(False)) & is_handler_like(name)), F.lit("security")),
        F.lit("logic"),
        F.when(~F.coalesce(_c(has_tests), F.lit(False)), F.lit("test_coverage")),
        F.when((span > 30) | (pc > 5), F.lit("style")),
    ))


def is_infra_yaml(path) -> Column:
    """yaml/yml/tpl file under an infrastructure path word."""
    words = "|".join(INFRA_PATH_WORDS)
    exts = "|".join(INFRA_EXTENSIONS)
    return _c(path).rlike(rf"\.({exts})$") & _c(path).rlike(f"({words})")


def token_budget(total, task_type, approximate) -> Column:
    """H3: per-section caps from basis points, integer division toward zero.

    Returns struct<diff_hunk, call_graph_raw, call_graph, tests>; ``call_graph_raw``
    keeps the possibly negative value of the reference rule (Q3), ``call_graph``
    is clamped at zero for use by the slice builder.
    """
    tt = _c(task_type)
    appr = F.coalesce(_c(approximate), F.lit(False))
    d0 = F.when(appr, BUDGET_BP_APPROXIMATE[0]).otherwise(BUDGET_BP_EXACT[0])
    c0 = F.when(appr, BUDGET_BP_APPROXIMATE[1]).otherwise(BUDGET_BP_EXACT[1])
    t0 = F.when(appr, BUDGET_BP_APPROXIMATE[2]).otherwise(BUDGET_BP_EXACT[2])
    d = F.when(tt == "security", d0 - 1000).when(tt == "style", 10000).otherwise(d0)
    c = (F.when(tt == "security", c0 + 1000).when(tt == "test_coverage", c0 - 2000)
         .when(tt == "style", 0).otherwise(c0))
    t = F.when(tt == "test_coverage", t0 + 2000).when(tt == "style", 0).otherwise(t0)
    tot = _c(total).cast("bigint")

    def cap(bp):
        # integer division truncating toward zero (negative caps round up)
        prod = tot * bp
        return F.when(prod >= 0, F.floor(prod / 10000)).otherwise(F.ceil(prod / 10000)) \
            .cast("bigint")

    raw_cg = cap(c)
    return F.struct(cap(d).alias("diff_hunk"), raw_cg.alias("call_graph_raw"),
                    F.greatest(raw_cg, F.lit(0)).alias("call_graph"), cap(t).alias("tests"))


def budget_total(budget) -> Column:
    """H4: sum of section caps (raw call-graph cap, as in the reference)."""
    b = _c(budget)
    return b["diff_hunk"] + b["call_graph_raw"] + b["tests"]


def model_class(model_id) -> Column:
    m = F.lower(_c(model_id))
    return F.when(m.contains("haiku"), "haiku").when(m.contains("sonnet"), "sonnet") \
        .when(m.contains("opus"), "opus").otherwise("opus")


def model_budget(model_id) -> Column:
    """H5: total token budget per model class."""
    cls = model_class(model_id)
    expr = None
    for name, total in MODEL_BUDGETS.items():
        expr = F.when(cls == name, total) if expr is None else expr.when(cls == name, total)
    return expr.otherwise(MODEL_BUDGETS["opus"]).cast("bigint")


def token_count(text) -> Column:
    """H6: ceil(bytes / 3.33)."""
    return F.ceil(F.octet_length(F.coalesce(_c(text), F.lit(""))) / F.lit(BYTES_PER_TOKEN)) \
        .cast("bigint")


def route_model(task_type, cfg: ReviewConfig = DEFAULT) -> Column:
    """Task type -> model id from the (overridable) routing map."""
    tt = _c(task_type)
    expr = None
    for k, v in cfg.model_routing.items():
        expr = F.when(tt == k, v) if expr is None else expr.when(tt == k, v)
    return expr.otherwise(cfg.model_routing.get("logic"))


def language_of(path) -> Column:
    """struct<language, approximate, has_grammar> from the file extension."""
    ext = F.lower(F.regexp_extract(_c(path), r"\.([A-Za-z0-9]+)$", 1))
    lang = None
    appr = None
    for e, (name, a) in LANGUAGES.items():
        lang = F.when(ext == e, name) if lang is None else lang.when(ext == e, name)
        appr = F.when(ext == e, a) if appr is None else appr.when(ext == e, a)
    return F.struct(lang.alias("language"), appr.alias("approximate"),
                    lang.isNotNull().alias("has_grammar"))


def retryable(status_code, error_kind) -> Column:
    """429, 5xx and timeouts are retryable."""
    sc = _c(status_code)
    return F.coalesce((sc == 429) | (sc >= 500) | (_c(error_kind) == "timeout"), F.lit(False))
