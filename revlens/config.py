"""Review configuration and fixed values.

Values in the FIXED VALUES block must equal the specification's own constants
for results to match; they are listed plainly, in the specification's order.
Everything else is a tunable parameter of :class:`ReviewConfig`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the specification)
# ---------------------------------------------------------------------------
CATEGORIES = ["security", "logic", "test_coverage", "style", "performance"]
CONFIDENCE_TIERS = ["high", "medium", "low"]
SEVERITIES = ["critical", "high", "medium", "low", "info"]
PR_STATES = ["open", "closed", "merged"]
TASK_STATUSES = ["pending", "running", "completed", "failed"]
RUN_STATUSES = ["running", "completed", "failed"]
TASK_TYPES = ["security", "logic", "test_coverage", "style"]
SUPPRESSION_REASONS = ["duplicate", "low_confidence", "dismissed_fingerprint"]
ADDRESSED_STATUSES = ["unaddressed", "likely_addressed", "confirmed"]
EVENT_TYPES = ["thumbs_up", "thumbs_down", "created", "posted", "suppressed",
               "addressed", "dismissed", "resolved", "confidence_adjusted",
               "tier_changed"]
REACTION_TYPES = ["thumbs_up", "thumbs_down"]
# severity rank: critical 5, high 4, medium 3, low 2, info 1, unknown 0
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
# path risk substrings and scores, case-sensitive, in specification order
PATH_RISK_PATTERNS = [
    ("auth", 0.4), ("security", 0.4), ("crypto", 0.4), ("migration", 0.35),
    ("middleware", 0.3), ("handler", 0.25), ("api", 0.25), ("cmd", 0.2),
    ("internal", 0.1), ("config", 0.2), ("deploy", 0.15), ("helm", 0.15),
    ("k8s", 0.15), ("kubernetes", 0.15),
]
# path substrings that make a symbol security relevant
SECURITY_PATH_PATTERNS = ["auth", "security", "crypto", "token", "session",
                          "password", "secret", "middleware"]
# YAML files under these path words become file-level logic tasks
INFRA_PATH_WORDS = ["helm", "chart", "k8s", "kubernetes", "deploy", "manifests"]
INFRA_EXTENSIONS = ["yaml", "yml", "tpl"]
# token budget split in basis points: (diff, call graph, tests)
BUDGET_BP_EXACT = (6000, 2500, 1500)
BUDGET_BP_APPROXIMATE = (7000, 1700, 1300)
# default model routing by task type
DEFAULT_MODEL_ROUTING = {
    "security": "claude-opus-4-6",
    "logic": "claude-opus-4-6",
    "test_coverage": "claude-sonnet-4-6",
    "style": "claude-haiku-4-5-20251001",
}
# total token budget per model class
MODEL_BUDGETS = {"opus": 16000, "sonnet": 16000, "haiku": 8000}
# bytes per token for the token estimate
BYTES_PER_TOKEN = 3.33
# extension -> (language, approximate index)
LANGUAGES = {"go": ("go", False), "py": ("python", True), "ts": ("typescript", True),
             "tsx": ("typescript", True), "php": ("php", True)}
PENALTY_FACTOR = 0.85
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ReviewConfig:
    """Thresholds and switches (Q-decisions of the blueprint) as parameters."""

    high_tier: float = 0.80
    medium_tier: float = 0.50
    high_risk: float = 0.7
    low_risk: float = 0.3
    small_pr_symbols: int = 5
    escalate_severities: tuple = ("critical", "high")
    prior_scope: str = "repo"            # Q1: 'repo' (code) or 'pr' (spec)
    inline_cap: int | None = None        # Q12: no cap
    penalty_factor: float = PENALTY_FACTOR
    # the regex index (H28) is always approximate; 'by_language' uses LANGUAGES
    approximate_index: str = "always"
    stale_after_hours: float | None = None  # Q7: None = every running row
    window_days: int = 7
    accepted_actions: tuple = ("opened", "synchronize")  # Q4
    include_deleted: bool = True         # Q14
    reaction_key: str = "spec"           # Q6
    exact_hunk_end: bool = False         # Q16
    # time bucket used to split hot keys in ordered windows (seconds)
    order_bucket_seconds: int = 86400
    model_routing: dict = field(default_factory=lambda: dict(DEFAULT_MODEL_ROUTING))


DEFAULT = ReviewConfig()
