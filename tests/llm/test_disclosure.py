"""Operator 11 against regular expressions of plain Python, and planted terms that give an entity away."""
import hashlib
import random
import re

from pyspark.sql import functions as F

from revlens.llm import disclosure as D
from revlens.llm import queries

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split("."))
                    or kind == "card" and not (14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0)
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), no, m.end(), kind))
    return [(k, a, b) for a, _, b, k in sorted(out)]


def replaced(text, spans):
    out, at = "", 0
    for start, end, put in spans:
        out += text[at:start] if start > at else ""
        out += put if end > at else ""
        at = max(at, end)
    return out + text[at:]


def test_base_spans_and_text_equal_plain_python(spark):
    random.seed(11)
    signs = ["a", "b", ".", "@", "@", "1", "2", "0", "+", " ", "-", "(", ")", "%", "é", "😀", "\n", "_", "1.2.3.4", "a@b.c",
             "+1 (555) 123-4567", "4111111111111111", "255", "256", "00"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 50))) for _ in range(1500)]
    texts += ["", None, "1" * 500 + "@" + ".a" * 500, "x@y.zz " * 300 + "é" * 9000 + " +1 (555) 123-4567"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = D.base_spans(F.col("text"))
    seen = 0
    for r in docs.select("text", spans.alias("s"), D.sanitised(F.col("text"), spans).alias("t")).collect():
        want = plain_spans(r.text)
        seen += len(want)
        assert [(s.kind, s.start, s.end) for s in r.s] == want, r.text
        assert r.t == (None if r.text is None else replaced(r.text, [(a, b, f"[{k.upper()}]") for k, a, b in want]))
    assert seen > 2000


def plain_disclosures(texts, s):
    """term -> entity -> disclosure, counted word by word; entities here are e-mail addresses only."""
    import math
    from collections import Counter
    f, n, near, contexts = Counter(), Counter(), Counter(), {}
    for text in texts:
        f.update(w.lower() for w in re.findall(r"[^\W_]+", text))
        marks = list(re.finditer(PATTERNS[0][1], text))
        for k, m in enumerate(marks):
            left = re.findall(r"[^\W_]+", text[marks[k - 1].end() if k else 0:m.start()])[-s.reach:]
            right = re.findall(r"[^\W_]+", text[m.end():marks[k + 1].start() if k + 1 < len(marks) else len(text)])[:s.reach]
            e, words = m.group().lower(), tuple(w.lower() for w in left)
            context = (words, tuple(w.lower() for w in right))
            n[e] += 1
            for w in (w.lower() for w in left + right):
                near[e, w] += 1
                contexts.setdefault((e, w), set()).add(context)
    total = sum(f.values())
    return {(e, w): 1 + math.log2(min(1, c / f[w])) / math.log2(total / n[e])
            for (e, w), c in near.items() if len(contexts[e, w]) >= s.contexts}


def test_terms_that_give_an_entity_away(spark):
    random.seed(5)
    common = [f"w{k}" for k in range(40)]
    texts = [" ".join(random.choices(common, k=30)) for _ in range(60)]
    for k in range(6):  # the name stands near the address only, w1 everywhere
        a, b = random.choices(common, k=8), random.choices(common, k=8)
        texts.append(" ".join([*a, "Quentin w1 ann@host.org", *b]))
    texts += [" ".join(["copied", "passage", "bob@host.org"])] * 9  # one neighbourhood
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    s = D.Settings()
    want = {k: v for k, v in plain_disclosures(texts, s).items() if v >= s.generalise}
    rows = D.row_key(docs)
    near = D.occurrences(rows, s)
    got = {(r.entity.removeprefix("email:"), r.term): r.disclosure for r in D.disclosures(docs, near, s).collect()}
    assert got.keys() == want.keys() and ("ann@host.org", "quentin") in got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    for r in D.sanitise(docs).collect():
        terms = {(r.doc_id, texts[r.doc_id][x.start:x.end]) for x in r.spans if x.kind == "term"}
        assert all(("ann@host.org", t.lower()) in want for _, t in terms)
        assert ("Quentin" in texts[r.doc_id]) == any(t == "Quentin" for _, t in terms)
        assert "Quentin" not in r.text and "@" not in r.text
        assert ("copied" in texts[r.doc_id]) == ("copied" in r.text)


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, "mail a.b@c.de now", "x"), (1, None, "x"), (2, "", None), (3, "same a@b.cd", "x"),
                                  (3, "same a@b.cd", "x"), (None, None, None)], "doc_id long, text string, spans string")
    got = D.find_spans(docs).collect()
    assert len(got) == 6
    assert sorted((r.doc_id or -1, [(x.start, x.end) for x in r.spans]) for r in got) == [
        (-1, []), (-1, [(5, 13)]), (1, []), (2, []), (3, [(5, 11)]), (3, [(5, 11)])]
    assert D.sanitise(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op11_disclosure_control(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = plain_spans(d.text)
        r = got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind, _ in PATTERNS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_no_python_in_the_plan(spark, sf_dir, capsys):
    queries.op11_disclosure_control(spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)
