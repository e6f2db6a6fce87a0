"""D14 on regions: one-to-one matching equals going through the sorted pairs."""
import random

import pytest

from revlens.operators.evaluation import matched_eval, one_to_one, overlapping_pairs

F_SCHEMA = "finding_id string, pr long, path string, category string, start_line int, end_line int, tokens long, repo string"
L_SCHEMA = "label_id string, pr long, path string, category string, start_line int, end_line int, repo string"


def plain(findings, labels):
    pairs = sorted((-(f[3] == g[3] and f[3] is not None), -(min(max(f[4], f[5]), max(g[4], g[5])) - max(f[4], g[4]) + 1), f[0], g[0])
                   for f in findings for g in labels if f[1:3] == g[1:3] and f[4] is not None and g[4] is not None
                   and f[4] <= max(g[4], g[5]) and g[4] <= max(f[4], f[5]))
    used, out = set(), set()
    for *_, f, g in pairs:
        if f not in used and g not in used:
            used |= {f, g}
            out.add((f, g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matching_equals_the_sorted_list(spark, seed):
    random.seed(seed)

    def region(k, kind):
        a = random.choice([None, *range(1, 200)]) if random.random() < 0.1 else random.randint(1, 40)
        row = (f"{kind}{k}", random.randrange(3), random.choice("pq"), random.choice(["x", "y", None]), a, None if a is None else a + random.randrange(-1, 90))
        return row + ((random.randrange(100), f"r{row[1]}") if kind == "f" else (f"r{row[1]}",))

    findings, labels = [region(k, "f") for k in range(120)], [region(k, "g") for k in range(90)]
    f, g = spark.createDataFrame(findings, F_SCHEMA), spark.createDataFrame(labels, L_SCHEMA)
    want = plain(findings, labels)
    got = {(r.finding_id, r.label_id) for r in one_to_one(overlapping_pairs(f, g, ["pr", "path"])).collect()}
    assert got == want and len(want) > 30
    for r in matched_eval(f, g, ["pr", "path"], "repo").collect():
        mine, theirs = [x for x in findings if x[-1] == r.repo], [x for x in labels if x[-1] == r.repo]
        tp = sum(x[0] in {a for a, _ in want} for x in mine)
        assert (r.tp, r.fp, r.fn) == (tp, len(mine) - tp, len(theirs) - tp)
        assert r.precision == round(tp / len(mine), 4) and r.cost_per_tp == round(sum(x[6] for x in mine) / tp, 4)


def test_nothing_to_match(spark):
    f, g = spark.createDataFrame([("a", 1, "p", "x", 1, 2, None, "r")], F_SCHEMA), spark.createDataFrame([], L_SCHEMA)
    assert tuple(matched_eval(f, g, ["pr", "path"], "repo").first()) == ("r", 0, 1, 0, 0.0, None, None)
