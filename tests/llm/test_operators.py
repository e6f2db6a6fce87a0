"""The operators against brute force, exact round trips and held-out accuracy."""
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import (binary_codes, components, count_rtree, decontam, katz, langid, packing, patience, quality,
                         queries, token_files, wrappers)

MID = "/root/testdata/sf0.01"


def words(rnd, n, size=400):
    return [f"w{rnd.randrange(size)}" for _ in range(n)]


# ------------------------------------------------------------------ quality, language
def test_quality_held_out(spark):
    got = queries.op1_quality_classifier(spark, MID)
    labels = spark.read.parquet(f"{MID}/labels.parquet").where("quality is not null")
    r = got.join(labels, "doc_id").where("held_out").agg(
        F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 50 and r.right > 0.93


def test_quality_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    s = quality.Settings(epochs=3)
    one, two = (quality.fit(d, labels, F.lit(True), s) for d in (docs, docs.repartition(7)))
    assert one.vocabulary.words == two.vocabulary.words and np.array_equal(one.vectors, two.vectors)
    assert np.allclose(one.network.w1, two.network.w1)


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(quality.fit_temperature(z * 3, y) - 3) < 0.3


def test_language_held_out(spark):
    got = queries.op4_language_id(spark, MID)
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang")
    r = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()
    assert r[0] > 0.97


def test_viterbi_equals_plain_search():
    rng = np.random.default_rng(2)
    scores = rng.normal(0, 2, (50, 3))
    sizes = np.array([0, 5, 1, 9, 5])
    rows = rng.integers(0, 50, sizes.sum())
    begins = np.concatenate(([0], sizes.cumsum()[:-1]))
    path = langid.viterbi(scores, rows, begins, sizes, 1.5)

    def value(labels, s):
        return s[np.arange(len(s)), labels].sum() - 1.5 * (np.diff(labels) != 0).sum()

    for b, n in zip(begins, sizes):
        if n:
            s = scores[rows[b:b + n]]
            best = max(value(np.array(np.unravel_index(i, (3,) * n)), s) for i in range(3**n))
            assert value(path[b:b + n], s) == pytest.approx(best)


def test_mixed_text_spans(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    model = langid.fit(docs, F.lit(True))
    by = {r["lang"]: r["text"].split()[:40] for r in docs.where("lang in ('en', 'de') and n_chars > 600").collect()}
    path, _ = model.label([" ".join(by["en"] + by["de"])])
    labels = [model.languages[i] for i in path[0]]
    assert labels[:30].count("en") > 27 and labels[-30:].count("de") > 27
    script, _ = langid.script_of(*langid.code_points(["привет", "12", "hello", "漢字"]))
    assert [langid.SCRIPTS[i] if i >= 0 else None for i in script] == ["Cyrillic", None, "Latin", "Han"]


# ------------------------------------------------------------------ decontamination
def test_leaks_equal_brute_force(spark):
    rnd = random.Random(3)
    items = [(i, " ".join(words(rnd, rnd.randint(6, 40), 60))) for i in range(25)]
    docs = []
    for d in range(150):
        text = words(rnd, rnd.randint(0, 120), 60)
        if d % 2:
            leak = items[rnd.randrange(25)][1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                leak[rnd.randrange(len(leak))] = "edited"
            at = rnd.randint(0, len(text))
            text[at:at] = [w.upper() + rnd.choice(["", ",", "."]) for w in leak]
        docs.append((d, " ".join(text)))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    plain = lambda t: [w.lower().strip(",.") for w in t.split()]
    shingles = {i: {tuple(plain(t)[k:k + 5]) for k in range(len(plain(t)) - 4)} for i, t in items}
    held = Counter(s for x in shingles.values() for s in x)
    weight = lambda x: sum(math.log(1 + len(items) / held[s]) for s in x)
    want = {}
    for d, t in docs:
        w = plain(t)
        for i, item in items:
            m = len(plain(item))
            best = max((weight(shingles[i] & {tuple(w[a + k:a + k + 5]) for k in range(min(m, len(w) - a) - 4)})
                        for a in range(max(1, len(w) - m + 1))), default=0) / weight(shingles[i])
            if best >= 0.8:
                want[d, i] = best
    assert len(want) > 30 and {k: pytest.approx(v, abs=1e-5) for k, v in want.items()} == got


def test_far_wordings_of_items_equal_brute_force(spark):
    """Passages at the threshold: cut, shifted, with words inserted, without the items' preamble."""
    rnd = random.Random(15)
    preamble = [f"p{i}" for i in range(14)]
    items = [(i, " ".join((preamble if i % 2 else []) + words(rnd, rnd.randint(24, 40), 5000))) for i in range(60)]
    docs, kinds = [], ["tail", "both", "insert", "preamble"]
    for d in range(400):
        i = rnd.randrange(60)
        w, kind = items[i][1].split(), kinds[d % 4]
        cut = rnd.randint(1, len(w) // 4)
        if kind == "tail":
            w[-cut:] = words(rnd, cut, 5000)
        elif kind == "both":
            w[:cut // 2], w[len(w) - cut // 2:] = words(rnd, cut // 2, 5000), words(rnd, cut // 2, 5000)
        elif kind == "insert":
            at = rnd.randrange(len(w))
            w[at:at] = words(rnd, rnd.randint(1, 6), 5000)
        elif i % 2:
            w = w[14:]
        docs.append((d, " ".join(words(rnd, rnd.randint(0, 60), 5000) + w + words(rnd, rnd.randint(0, 60), 5000))))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string")).collect()}
    shingles = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in items}
    held = Counter(s for x in shingles.values() for s in x)
    weights = {s: math.log(1 + len(items) / n) for s, n in held.items()}
    want = {}
    for d, t in docs:
        w = t.split()
        of = [tuple(w[a:a + 5]) for a in range(len(w) - 4)]
        for i, item in items:
            if shingles[i].isdisjoint(of):
                continue
            m = len(item.split())
            best = max(sum(weights[s] for s in shingles[i] & set(of[a:a + m - 4])) for a in range(max(1, len(w) - m + 1)))
            if (best := best / sum(weights[s] for s in shingles[i])) >= 0.8 - 1e-9:
                want[d, i] = best
    assert len(want) > 150 and {k: pytest.approx(v, abs=1e-5) for k, v in want.items()} == got


def test_decontamination_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = decontam.find_leaks(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_simhash_blocks_find_all_within_radius(spark):
    rnd = random.Random(4)
    base = rnd.getrandbits(64)
    near = [base ^ sum(1 << b for b in rnd.sample(range(64), n)) for n in range(16) for _ in range(5)]
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in [base, *near]]
    df = spark.createDataFrame(signed, "f long").select("f", F.inline(decontam.blocks_of(F.col("f"), 15)))
    met = df.alias("a").where(F.col("f") == signed[0][0]).join(df.alias("b"), ["block", "bits"]).select("b.f").distinct()
    assert met.count() == len(set(signed))


# ------------------------------------------------------------------ packing
def test_packing_is_constrained_best_fit(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["hot", "hot", "a", "b", "c", None]), rnd.choice([None, 1, 2, rnd.randrange(500)]),
             rnd.randint(0, 150)) for i in range(600)]
    got = packing.best_fit_pack(spark.createDataFrame(rows, "doc_id long, source string, cluster long, n_tokens long"),
                                capacity=100, shard_docs=150).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for rs in bins.values():
        assert sum(r["n_tokens"] for r in rs) == rs[0]["bin_tokens"] <= 100
        if len(rs) > 1:
            for c in ("source", "cluster"):
                known = [r[c] for r in rs if r[c] is not None]
                assert len(known) == len(set(known))
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
    assert dict(total) == {i: n for i, _, _, n in rows}
    # One shard against a plain search of the tightest compatible bin.
    import pandas as pd
    pdf = pd.DataFrame([(i, s, None if c is None else str(c), n) for i, s, c, n in rows],
                       columns=["doc_id", "source", "cluster", "n_tokens"])
    out = packing.pack_shard(pdf, 100).sort_values(["n_tokens"], ascending=False, kind="stable")
    plain: list[tuple[int, set, set]] = []
    placed = {}
    for n, i, s, c in sorted(((n, i, s, c) for i, s, c, n in rows if n % 100 or not n), key=lambda r: (-(r[0] % 100), -r[0], r[1])):
        n %= 100
        fit = [k for k, (free, ss, cs) in enumerate(plain) if free >= n and s not in ss and c not in cs and free > 0]
        k = min(fit, key=lambda k: plain[k][0], default=None)
        if k is None:
            plain.append((100, set(), set()))
            k = len(plain) - 1
        free, ss, cs = plain[k]
        plain[k] = (free - n, ss | ({s} - {None}), cs | ({c} - {None}))
        placed[i] = k
    rest = out[out["n_tokens"] < 100]
    assert rest.groupby("bin_id")["n_tokens"].sum().sort_values().tolist() == sorted(100 - p[0] for p in plain)


# ------------------------------------------------------------------ language model
def katz_brute_force(docs, learn):
    toks = {i: t.encode().lower().split() + [None] for i, t in docs}
    c1, c2, ch = Counter(), Counter(), Counter()
    for i, ws in toks.items():
        if learn(i):
            hs = ["start", *ws[:-1]]
            c1.update(ws)
            c2.update(zip(hs, ws))
            ch.update(hs)
    n, k = sum(c1.values()), katz.K
    d1, d2 = (katz.discounts(np.array([Counter(c.values())[r] for r in range(1, k + 2)])) for c in (c1, c2))
    p1 = {w: d1[min(c, k + 1)] * c / n for w, c in c1.items()}
    unknown = 1 - sum(p1.values())
    after = defaultdict(dict)
    for (h, w), c in c2.items():
        after[h][w] = d2[min(c, k + 1)] * c / ch[h]
    alpha = {h: (1 - sum(ws.values())) / (1 - sum(p1[w] for w in ws)) for h, ws in after.items()}

    def p(h, w):
        if w in after[h]:
            return after[h][w]
        return alpha.get(h, 1) * p1.get(w, unknown)

    return toks, c1, n, p


@pytest.mark.parametrize("parts", [1, 5])
def test_katz_equals_brute_force(spark, parts):
    rnd = random.Random(6)
    docs = [(i, " ".join(words(rnd, rnd.randint(0, 60), 80)) + " the The THE" * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {"learn": F.col("doc_id") % 4 != 0, "held_out": F.col("doc_id") % 4 == 0})
    got = {r["doc_id"]: r for r in katz.katz_scores(df, parts).collect()}
    toks, c1, n, p = katz_brute_force(docs, lambda i: i % 4 != 0)
    assert len(got) == len(docs)
    for i, ws in toks.items():
        score = sum(math.log10(p(h, w)) for h, w in zip(["start", *ws[:-1]], ws))
        base = sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (len(c1) + 1))) for w in ws)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in c1 for w in ws), n)
        assert r["score"] == pytest.approx(score) and r["base_score"] == pytest.approx(base)
    for h in ["start", b"the", b"w1"]:
        assert sum(p(h, w) for w in c1) + p(h, "unknown") == pytest.approx(1)


# ------------------------------------------------------------------ embeddings
def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(60, 32))
    x = np.concatenate([base, np.repeat(base[:10], 40, 0) + rng.normal(0, 0.18, (400, 32)), base[:5], base[:5]])
    rows = [(i, v.tolist(), int(i % 3 == 0)) for i, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in binary_codes.near_duplicates(df, binary_codes.Settings(
        group_rows=16, block_rows=24)).collect()}
    u = np.array([r[1] for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    near = (u @ u.T >= 0.93) & (lab[:, None] == lab)
    np.fill_diagonal(near, False)
    n_links = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (n_links <= near.sum(1)).all() and n_links.sum() >= 0.97 * near.sum() > 1000


def test_estimates_are_unbiased():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(2, 400, 64))
    b = a + 0.3 * b
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    errors = []
    for seed in range(20):
        rot = binary_codes.rotations(64, 128, seed)
        turned, signs, f = binary_codes.encode(a, rot)
        assert np.allclose(np.linalg.norm(turned, axis=1), 1)
        errors.append((signs * (b @ rot.T)).sum(1) / (math.sqrt(128) * f) - (a * b).sum(1))
    errors = np.array(errors)
    assert abs(errors.mean()) < 0.005
    assert (np.abs(errors) < 4 * np.sqrt(1 - f * f) / f / math.sqrt(127)).mean() > 0.999


def test_components(spark):
    rnd = random.Random(9)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(0, i) for i in range(400, 600)]
    root = list(range(600))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == {x: find(x) for a, b in links for x in (a, b) if a != b}


# ------------------------------------------------------------------ licences
def test_patience_alignment():
    a, b = "the quick brown fox jumps over the lazy dog".split(), "a quick red fox leaps over the dog".split()
    pairs = patience.align(a, b)
    assert [(a[i], b[j]) for i, j in pairs] == [(w, w) for w in ("quick", "fox", "over", "the", "dog")]
    assert patience.longest_increasing([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]


def test_license_scan(spark):
    rnd = random.Random(10)
    rows, want = [], set()
    for i, (name, text) in enumerate(patience.TEMPLATES.items()):
        w = patience.words_of(text)
        for k in range(0, len(w), 12) if len(w) > 20 else ():
            w[k + 5 if k + 5 < len(w) - 1 else k] = "changed"
        rows.append((i, " ".join(words(rnd, 50) + w + words(rnd, 50) + w + words(rnd, 5))))
        want |= {(i, name, 50, len(w)), (i, name, 100 + len(w), len(w))}
    got = {(r["doc_id"], r["license"], r["first_word"], r["n_words"]) for r in patience.scan_licenses(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("text, want", [
    (patience.TEMPLATES["GPL-3.0"].replace("GNU", "GNU Affero"), ["AGPL-3.0"]),
    (patience.TEMPLATES["GPL-3.0"].replace("GNU", "GNU Lesser"), ["LGPL-3.0"]),
    (patience.TEMPLATES["GPL-3.0"].replace("version 3", "version 2"), ["GPL-2.0"]),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0-statement"]),
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-statement"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
    ("Released under the BSD License.", ["BSD-statement"]), ("Licensed under CC BY 4.0.", ["CC-BY-statement"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-statement"]), ("Released under the Foo License.", []),
    ("This work is licensed under the GNU General Public License, version 7.", []),
    (patience.TEMPLATES["MIT"].replace("Permission", "Right", 1) * 3, ["MIT"] * 3),
    ("Released under the MIT License. " * 4, ["MIT-statement"] * 4)])
def test_licenses_are_told_apart(text, want):
    got = patience.matches(patience.words_of("some words before " + text + " and after"),
                           patience.prepared(patience.TEMPLATES, patience.LEAST), patience.LEAST)
    assert [m[0] for m in got] == want


def test_inserted_words_count_against_a_match():
    known = patience.prepared(patience.TEMPLATES, patience.LEAST)
    w = patience.words_of(patience.TEMPLATES["ISC"])
    few, many = ([x for i, v in enumerate(w) for x in [v, *["more"] * (i % k == 0)]] for k in (10, 3))
    assert [m[0] for m in patience.matches(few, known, patience.LEAST)] == ["ISC"]
    assert patience.matches(few, known, patience.LEAST)[0][1] < 1 and not patience.matches(many, known, patience.LEAST)


def test_license_lines_of_documents(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    line = "Released under the MIT License."
    want = docs.select(F.sum(F.regexp_count("text", F.lit(line.replace(".", "[.]"))))).first()[0]
    got = queries.op7_license_scan(spark, MID).where("license = 'MIT-statement' and coverage = 1").count()
    assert got == want


# ------------------------------------------------------------------ pages
def page(i, body):
    menu = "".join(f"<li><a href='/{k}'>Menu {k}</a></li>" for k in range(4))
    return (f"<!doctype html><html><head><title>T{i}</title><style>p{{}}</style></head><body><div id=top class='header'>Site"
            f"</div><nav><ul>{menu}</ul></nav><div class='cookie-notice'>We use cookies {i}</div>{body}"
            f"<div class=sidebar><p>Popular {i}</div><div id='comments'><p>Nice post {i}</div><footer>&copy; {i}</footer>")


@pytest.mark.parametrize("most", [0, 16 << 20])
def test_main_texts(spark, monkeypatch, most):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", most)
    rows, want = [], {}
    for i in range(12):
        body = (f"<div class='col'><h2>Title &amp; {i}</h2><p>First  <b>bold</b> part {i}.<br>Next line<p>Second part {i}, long "
                f"enough to matter.<script>var a = '</p>';</script><div class=ad>Buy {i}</div><p>Third part {i}.</p>"
                f"<form><input name=q> Search {i}</form></div>")
        rows.append((i, f"https://blog.example.org/{i}", page(i, body)))
        want[i] = f"Title & {i}\n\nFirst bold part {i}. Next line\n\nSecond part {i}, long enough to matter.\n\nThird part {i}."
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize("pages", [1, 8])
@pytest.mark.parametrize("opening, closing", [
    ('<div class="content has-sidebar">', "</div>"), ('<main class="site-main no-sidebar">', "</main>"),
    ('<article class="post share-enabled">', "</article>"), ('<div class="sidebar-right"><article>', "</article></div>"),
    ('<article class="notice">', "</article>"), ('<div class="widget">', "</div>"), ('<main id="search">', "</main>")])
def test_words_of_layout_classes_do_not_drop_the_content(spark, pages, opening, closing):
    rows, want = [], {}
    for i in range(pages):
        inner = (f"<h1>Title {i}</h1><p>First part {i}, which is long enough to be the text.</p><h2 id='related-work'>Related work</h2>"
                 f"<p>Other part {i}, which is long as well.</p><h2 id='navigation'>Navigation</h2><p>Third part {i}.</p>")
        rows.append((i, f"https://a.example.org/{i}", f"<html><body><nav>Menu</nav>{opening}{inner}{closing}"
                     f"<div class='sidebar'><p>Popular {i}</p></div><div id='comments'><p>{'Nice post ' * 60}{i}</p></div></body></html>"))
        want[i] = (f"Title {i}\n\nFirst part {i}, which is long enough to be the text.\n\nRelated work\n\nOther part {i}, which is long "
                   f"as well.\n\nNavigation\n\nThird part {i}.")
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_sections_with_titles_as_ids(spark):
    rows = []
    for i in range(6):
        extra = "<section id='search'><h2>Search</h2><p>How pages are searched.</p></section>" if i == 2 else ""
        rows.append((i, f"https://a.example.org/{i}", f"<body><article><p>Part {i} is the text.</p>{extra}<section id='related'><a href=x>See "
                     f"page {i}</a></section><section id='newsletter'><p>Subscribe to us</p></section></article></body>"))
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Part {i} is the text." + "\n\nSearch\n\nHow pages are searched." * (i == 2) for i in range(6)}


def test_text_after_deep_elements_stays_in_the_article(spark):
    deep = "<div>" * 200 + "<p>Deep one</p><div class='ad'>Buy</div><p>Deep two</p>" + "</div>" * 200
    rows = [(i, f"https://a.example.org/{i}", f"<body><div><article><p>Before {i}</p>{deep}<p>After {i}</p></article></div>"
             f"<nav>Menu</nav></body>") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in wrappers.main_texts(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Before {i}\n\nDeep one\n\nDeep two\n\nAfter {i}" for i in range(3)}
    wrappers.skeleton([wrappers.parse("<nav>" * 5000 + "x")])


def test_article_of_sample_pages(spark):
    import html
    import re
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in queries.op8_wrapper_extraction(spark, "/root/testdata/sf0.001").collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1])
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_simple_tree_matching():
    def tree(x):
        s = wrappers.Slot(x[0], False)
        s.children = [tree(c) for c in x[1:]]
        return s

    a = tree(["a", ["b"], ["c", ["b"]], ["d"]])
    b = tree(["a", ["c", ["b"], ["e"]], ["b"], ["d"]])
    assert wrappers.tree_match(a, b, {}) == 4  # a, c, b below c, d


# ------------------------------------------------------------------ token files
def test_token_files_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = token_files.token_files(docs, path, shards=5, with_ids=True).collect()
    t = Tokenizer.from_file(path)
    at = 0
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    by = {r["doc_id"]: r for r in got}
    for i in sorted(texts):
        ids = t.encode(texts[i], add_special_tokens=False).ids + [0]
        r = by[i]
        assert r["ids"] == ids and (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_pieces_put_together_are_the_text(spark):
    import public_tokenizers

    rnd = random.Random(11)
    bits = ["a", "b ", "  ", " ", "\n", "\t", "é", "1", "'s", "don't", "…", "!", "中文", "<|endoftext|>", "\xa0", "_", "ª",
            "\x00", "\x1c", "Ⅷ", "़", "ſ", "\r\n", "Word", "\n\n"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    e = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), cache_pieces=500)
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(e.encode(t), e.dtype).tolist() for t in texts] == want


def test_added_tokens_are_encoded_as_by_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, rnd = Tokenizer.from_file(path), random.Random(16)
    bits = ["a", " b", "  ", "\n", "<|endoftext|>", "<|endoftext", "|>", " <|endoftext|> ", "Word", "\xa0", "é", "."]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x"]
    texts += ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 15))) for _ in range(2000)]
    e = token_files.PieceEncoder(path)
    assert [np.frombuffer(e.encode(t), e.dtype).tolist() for t in texts] == [
        plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert np.frombuffer(e.encode(texts[0]), e.dtype).tolist() == [64, 220, 50256, 275]


# ------------------------------------------------------------------ Jaccard join
def jaccard_brute_force(docs, cfg):
    sets = {}
    for i, t in docs:
        w = t.encode().lower().split()
        k = cfg.k
        sets[i] = {tuple(w[a:a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if cfg.den * both >= cfg.num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("cfg", [count_rtree.Settings(), count_rtree.Settings(k=5, num=80)])
def test_jaccard_equals_brute_force(spark, cfg, monkeypatch):
    monkeypatch.setattr(count_rtree, "BLOCK", 8)
    rnd = random.Random(12)
    docs = []
    for g in range(40):
        base = words(rnd, rnd.choice([2, 4, 9, 20, 40, 90, 130, 300]), 3000)
        shared = words(rnd, 8, 10)
        for _ in range(rnd.randint(1, 9)):
            w = list(base) + (shared if g % 3 == 0 else [])
            for _ in range(rnd.choice([0, 0, 1, 2, 3]) * len(w) // 60):
                at = rnd.randrange(len(w))
                w[at:at + rnd.choice([0, 1])] = [f"x{rnd.randrange(9999)}"]
            docs.append((len(docs), " ".join(w)))
    got = count_rtree.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), cfg)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == jaccard_brute_force(docs, cfg)


def test_rows_of_null_and_repeated_ids_are_linked_by_their_texts(spark):
    import corpus_pipeline

    rnd = random.Random(17)
    rows, want, kept = [], [], []
    for g in range(12):
        base = words(rnd, 100, 5000)
        near = [" ".join([*base[:k], f"x{g}", *base[k + 1:]]) for k in (2, 97, 98)]
        # A null id in each group, 500 in every third one with another text; groups 10 and 11 have no id.
        group = [(None, near[0]), (None, near[0]), (None, " ".join(base))]
        group += [(10 + g, near[1]), (500 if g % 3 == 0 else 30 + g, near[2])] if g < 10 else []
        rows += group
        least = 10 + g if g < 10 else None
        want += [(i, least) for i, _ in group]
        kept.append((least, near[1] if g < 10 else None))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["component_id"]) for r in count_rtree.jaccard_components(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    docs = df.withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.length("text")})
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    assert sorted(i for i, _ in left if i is not None) == list(range(10, 20))
    assert {t for i, t in left if i is not None} == {t for i, t in kept if i is not None} and len(left) == 12


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(13)
    for cfg in (count_rtree.Settings(), count_rtree.Settings(num=80)):
        for n in [1, 5, 6, 20, 23, 24, 27, 30, 95, 96, 110, 120, 400, 1500, 1536, 1800]:
            for _ in range(30):
                a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
                drop = rng.integers(0, cfg.differ(len(a)) + 1)
                b = np.unique(np.concatenate([rng.permutation(a)[drop // 2:], rng.integers(0, 1 << 63, drop - drop // 2).astype(np.uint64)]))
                if len(b) and count_rtree.linked(a, b, cfg):
                    (ka, enough), (kb, also) = (count_rtree.routing_keys(x, cfg) for x in (a, b))
                    assert np.intersect1d(ka, kb).size or not (enough and also)


def test_sets_without_enough_groups_are_still_found(spark, monkeypatch):
    """With one routing group for all shingles, all sets must fall back to single-shingle keys."""
    plain = count_rtree.keys_in
    monkeypatch.setattr(count_rtree, "keys_in", lambda s, low, differ: plain(s, 1, differ) if low == 1 else (plain(
        s, 1, 0)[0][:1] * np.uint64(0) + np.uint64(len(s)), False))
    s = np.arange(100, dtype=np.uint64)
    keys, enough = count_rtree.routing_keys(s, count_rtree.Settings())
    assert not enough and len(count_rtree.routing_keys(s, count_rtree.Settings(), single=True)[0]) > len(keys)


def test_tree_rules_out_no_link():
    rng = np.random.default_rng(14)
    cfg = count_rtree.Settings()
    base = [np.unique(rng.integers(0, 1 << 60, 120).astype(np.uint64)) for _ in range(20)]
    sets = base + [np.unique(np.concatenate([b[: len(b) - 4], rng.integers(0, 1 << 60, 4).astype(np.uint64)])) for b in base * 3]
    points, sizes = count_rtree.points_of([count_rtree.counts(s) for s in sets]), np.array(list(map(len, sets)))
    found = set()
    for i, j in count_rtree.CountTree(points, sizes).search(points, sizes, cfg):
        found.update(zip(i.tolist(), j.tolist()))
    links = {(i, j) for i in range(80) for j in range(80) if count_rtree.linked(sets[i], sets[j], cfg)}
    assert links <= found and len(found) < 80 * 80 / 4


def test_points_bound_overlaps_at_every_size():
    """Packed points of any width, folded or not, never bound an overlap below the true one, and fine
    ones tell sets apart that share little."""
    rng = np.random.default_rng(18)
    for n in (1, 15, 16, 100, 1535, 1536, 40_000):
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        for share in (0.0, 0.5, 0.9, 1.0):
            b = np.unique(np.concatenate([a[: int(len(a) * share)], rng.integers(0, 1 << 60, max(1, n // 4)).astype(np.uint64)]))
            both, p = len(np.intersect1d(a, b)), [count_rtree.fine_point(x) for x in (a, b)]
            assert both <= count_rtree.fine_overlap(*p) <= min(len(a), len(b))
        other = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        assert n < 100 or count_rtree.fine_overlap(count_rtree.fine_point(a), count_rtree.fine_point(other)) < 0.75 * n
    same = np.full(70_000, 7, np.uint64) + np.arange(70_000, dtype=np.uint64) * np.uint64(1 << 32)  # one group
    for x in (same[:15], same[:16], same[:256], same[:70_000]):
        coarse = count_rtree.points_of([count_rtree.counts(x), count_rtree.counts(same[:3])])
        assert coarse[0].max() >= len(x) and coarse[1].sum() == 3
        assert count_rtree.fine_overlap(count_rtree.fine_point(x), count_rtree.fine_point(x)) >= len(x)


def test_links_across_point_widths_equal_brute_force(spark):
    """Groups on both sides of ``MORE_FROM`` shingles: cells hold points of both widths."""
    cfg, rnd, docs = count_rtree.Settings(), random.Random(19), []
    for g in range(6):
        base = words(rnd, count_rtree.MORE_FROM + 40, 50_000)
        for cut in range(9):
            docs.append((len(docs), " ".join(base[cut * rnd.choice([1, 12, 60]):])))
    got = count_rtree.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), cfg)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == jaccard_brute_force(docs, cfg)


def test_wrappers_attributes_and_formulas(spark):
    """An apostrophe in an unquoted value opens nothing; formulas are text."""
    rows = [(1, "http://a.example/1", "<article><p data-x=it's>Hello world one two three.</p><p>It's a second.</p><p>third don't</p></article>"),
            (2, "http://b.example/1", "<article><p>Formula <math><mi>x</mi><mo>=</mo><mn>2</mn></math> ends.</p><p>And <object>its own</object> text.</p></article>"),
            (3, "http://c.example/1", "<article><p title = 'a > b' class=\"c>d\" x=y\"z>One more.</p><p a='' b>Two.</p></article>")]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Hello world one two three.\n\nIt's a second.\n\nthird don't",
                   2: "Formula x=2 ends.\n\nAnd its own text.", 3: "One more.\n\nTwo."}
    assert wrappers.attributes(" a=it's b='x y' c") == {"a": "it's", "b": "x y", "c": ""}
