"""J7 with rules as data: pattern rules over lines, looked up by literal fragments.

A rule is a row: rule_id, category, severity, pattern, and ``fragments`` of which a line must
hold one for its pattern to be tried (for a secret rule: token, password, ...).  Fragments
are compared in lower case with digits as 0, so that ``0.0`` stands for any digits around a dot.
Each fragment is looked up by one key: three characters of it, or itself if it is a single sign.

A line's keys are found in one pass; only those that some rule has meet the rules in an equi join,
and only lines that hold the whole fragment meet the pattern.  So a line costs its length and its
few candidates, not the number of rules, and there is no expression per rule.  Rules that were
measured to be small go to the lines, which then stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import grows

#: Rules are configuration: their distinct keys go to every task as one array, up to this many.
MOST_KEYS = 200_000
#: Rules up to so many bytes go to every task; more of them meet the lines in a sorted join.
MOST_BYTES = 16_000_000
KEY = 3


def comparable(text: Column) -> Column:
    return F.translate(F.lower(text), "123456789", "000000000")


def keys_of(text: Column) -> Column:
    """All keys a fragment inside ``text`` may be looked up by."""
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{KEY}}}))"), F.lit(1)),
                                     F.regexp_extract_all(text, F.lit(r"[^\p{L}\p{N}\s]"), F.lit(0))))


def fragment_index(rules: DataFrame) -> DataFrame:
    """rule columns with key and fragment, one row per fragment; rules without a usable fragment
    (see ``refused_rules``) have none."""
    f = rules.withColumn("fragment", F.explode("fragments")).withColumn("fragment", comparable(F.col("fragment")))
    # of a fragment's keys the one whose hash is least: spread over the alphabet
    marked = F.transform(F.filter(keys_of(F.col("fragment")), lambda k: (F.length(k) == KEY) | (F.length("fragment") == 1)),
                         lambda k: F.struct(F.xxhash64(k).alias("h"), k.alias("key")))
    return f.withColumn("key", F.array_min(marked)["key"]).filter("key is not null").drop("fragments")


def refused_rules(rules: DataFrame) -> DataFrame:
    """Rules that could only be tried on every line: no fragment, or only too short ones."""
    return rules.join(fragment_index(rules).select("rule_id").distinct(), "rule_id", "left_anti")


def scan_lines(lines: DataFrame, rules: DataFrame, text: str = "line") -> DataFrame:
    """Hits: the columns of ``lines`` but its text, with rule_id, category and severity; once per line and rule."""
    index = fragment_index(rules)
    keys = index.select("key").distinct()
    if keys.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        raise ValueError(f"more than {MOST_KEYS} keys: scan with parts of the rules")
    known = keys.agg(F.coalesce(F.array_sort(F.collect_set("key")), F.array().cast("array<string>"))).scalar()
    own = [c for c in lines.columns if c != text]
    plain = comparable(F.col(text))
    candidates = lines.withColumn("_plain", plain).withColumn("key", F.explode(F.array_intersect(keys_of(F.col("_plain")), known)))
    size = index.agg(F.sum(F.lit(100) + sum(F.coalesce(F.octet_length(c), F.lit(0)) for c in ("rule_id", "pattern", "fragment")))).first()[0] or 0
    if size <= MOST_BYTES:
        met = candidates.join(F.broadcast(index), "key")
    else:  # a line travels once per key: without its comparable form, which is made again
        met = candidates.drop("_plain").join(grows(index), "key").withColumn("_plain", plain)
    hits = met.filter(F.contains("_plain", F.col("fragment")) & F.rlike(F.col(text), F.col("pattern")))
    return hits.select(*own, "rule_id", "category", "severity").distinct()
