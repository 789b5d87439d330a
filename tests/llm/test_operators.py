"""The training-data operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables and
clashing columns; results against brute force, round trips or held-out rows."""

import random
import re
import zlib

import numpy as np
import pytest

from docweave.llm import kneser_ney, licenses, main_text, mixing, ngram_join, pseudonyms, pu_quality, sharding, spherical_caps, winnowing

DOCS = "doc_id long, text string, n long, component_id string, score string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def frame(spark, texts, ids=None):
    """Documents with further columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, 1, "c", "s") for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- n-gram join --------------------------------------------------------------------------


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(ids, sets, linked):
    root = list(range(len(ids)))
    for _ in ids:
        for i in range(len(ids)):
            for j in range(len(ids)):
                if linked(sets[i], sets[j]) and i != j:
                    root[i] = root[j] = min(root[i], root[j])
    return {ids[i]: min(ids[j] for j in range(len(ids)) if root[j] == root[i]) for i in range(len(ids))}


def near_copies():
    base = prose(1, 120).split()
    texts = [" ".join(base)]
    for i in range(30):  # one large group, so that long runs and rounds are used
        w = list(base)
        r = random.Random(i)
        for _ in range(r.randrange(1, 7)):
            w[r.randrange(len(w))] = f"edit{i}"
        texts.append(" ".join(w))
    return texts


def test_ngram_join_equals_brute_force(spark):
    texts = near_copies() + [None, "", "  ", "One two", "one TWO", "three", prose(2, 300), prose(2, 300), prose(3, 90), prose(4, 20_000)]
    got = {r.doc_id: r for r in ngram_join.ngram_jaccard_join(frame(spark, texts)).collect()}
    sets = [shingles(t) for t in texts]
    want = brute_components(list(range(len(texts))), sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b))
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    kept = [r.doc_id for r in ngram_join.keep_one_of_each(frame(spark, texts)).collect()]
    assert sorted(kept) == sorted(i for i, c in want.items() if i == c)


def test_ngram_join_edges(spark):
    assert ngram_join.ngram_jaccard_join(empty(spark)).count() == 0
    rows = ngram_join.ngram_jaccard_join(frame(spark, ["a b c d e f", "a b c d e f", "q"], [None, 7, 7])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.n_shingles) for r in rows) == [(False, 7, 1), (False, 7, 2), (True, 7, 2)]


# -- spherical caps -----------------------------------------------------------------------


def test_spherical_caps_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + rng.normal(size=32) * rng.choice([0.05, 0.25, 0.4])).tolist(), i % 2) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 1), (302, [0.0] * 32, 0), (303, None, 0), (304, [None] * 32, 0), (305, [float("nan")] * 32, 0), (306, rows[0][1], None), (307, rows[0][1][:8], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = {r.vec_id: r for r in spherical_caps.cap_near_duplicates(df).collect()}
    assert len(got) == len(rows)
    ok = [r for r in rows if r[2] is not None and r[1] is not None and len(r[1]) == 32 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    x = np.array([r[1] for r in ok])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in ok])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    found = sum(got[r[0]].n_links for r in ok)
    assert link.sum() > 100 and 0.99 * link.sum() <= found <= link.sum()
    for r in rows[302:304] + rows[304:]:
        assert got[r[0]].n_links == 0 and got[r[0]].kept
    assert got[300].component_id == 0 and not got[300].kept
    assert spherical_caps.cap_near_duplicates(df.limit(0)).count() == 0


# -- main text ----------------------------------------------------------------------------


def test_main_text_cases(spark):
    page = "<html><head><title>T</title><script>x<p>y</script></head><body><nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p>one <b>tw</b>o<br>three</p><div class='ad'>buy</div><p>four\n\n five</p></article><footer>foot words here</footer></body></html>"
    assert main_text.main_text(page) == "A & B one two three four five"
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<nav>only menu</nav>") == ""
    assert main_text.main_text("<article><p>cut off <b") == "cut off"
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = main_text.extract_main_text(df).collect()
    assert sorted(r.n_chars for r in rows) == [0, 29, 29]
    assert main_text.extract_main_text(df.limit(0)).count() == 0


# -- quality and mixing -------------------------------------------------------------------


def quality_docs(spark):
    good = [prose(i, 60 + i % 40).replace("1", "one") for i in range(300)]
    bad = [" ".join(w + "***" for w in prose(i, 60).split()) for i in range(100)]
    toxic = [g + " scum trash scum" for g in good[:80]]
    texts = good + bad + toxic
    labels = [(i, int(i < 300 or i >= 400), int(i >= 400)) for i in range(len(texts)) if i % 2 or i % 3 == 0]
    return frame(spark, texts), spark.createDataFrame([*labels, (None, 1, 0), (10_000, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = quality_docs(spark)
    rows = {r.doc_id: r for r in pu_quality.quality_report(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    wrong = [i for i, r in rows.items() if r.predicted != int(not 300 <= i < 400)]
    assert not [i for i in wrong if 300 <= i < 400] and len(wrong) <= 0.08 * len(rows)  # few rows to learn from here
    kept = {r.doc_id for r in pu_quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in rows.items() if r.predicted}


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pu_quality.quality_report(empty(spark), labels).count() == 0
    rows = pu_quality.quality_report(frame(spark, [None, "", "x"], [None, 1, 1]), labels).collect()
    assert [r.predicted for r in rows] == [1, 1, 1]


def test_mixing_reaches_targets(spark):
    docs, labels = quality_docs(spark)
    rows = mixing.document_rates(docs, labels).collect()
    total = {x: sum(r.n_tokens * r.rate * r[f"p_{x}"] for r in rows) for x in mixing.DOMAINS}
    share = {x: v / sum(total.values()) for x, v in total.items()}
    assert all(abs(share[x] - mixing.TARGETS[x]) < 0.02 for x in mixing.DOMAINS)
    assert all(r.copies == 1 for r in rows if r.p_clean > 0.999)
    out = mixing.apply_mixture(docs, labels)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)


@pytest.mark.parametrize("bad", [4, 1])
def test_mixing_keeps_clean_documents_where_a_domain_is_scarce(spark, bad):
    """0.2 % and 0.05 % of low quality: that domain falls short, clean documents stay."""
    clean = 2000 - 98 - bad
    texts = [prose(i, 60) for i in range(clean)] + [prose(i, 57) + " scum trash scum" for i in range(98)] + [" ".join(w + "***" for w in prose(i, 60).split()) for i in range(bad)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i < 2000 - bad), int(clean <= i < 2000 - bad)) for i in range(2000)], "doc_id long, quality int, toxic int")
    rows = mixing.document_rates(docs, labels).collect()
    have = {x: sum(r.n_tokens * r[f"p_{x}"] for r in rows) for x in mixing.DOMAINS}
    total = {x: sum(r.n_tokens * r.rate * r[f"p_{x}"] for r in rows) for x in mixing.DOMAINS}
    assert have["low_quality"] < 0.004 * sum(have.values())
    assert all(r.copies == 1 for r in rows if r.doc_id < clean or r.doc_id >= 2000 - bad)
    assert abs(total["toxic"] / sum(total.values()) - 0.01) < 0.005
    assert {r.doc_id for r in mixing.apply_mixture(docs, labels).collect()} >= set(range(clean))


def test_size_of_the_mixture():
    def goal(*have):
        return [round(float(x), 6) for x in mixing.goals(np.array(have), np.array([0.98, 0.01, 0.01]))]

    assert goal(0.949, 0.049, 0.002) == [0.949, 0.009684, 0.002]
    assert goal(0.949, 0.0501, 0.0009) == [0.949, 0.009684, 0.0009]  # no step at 0.1 %
    assert goal(0.1, 0.8, 0.1) == [0.1, 0.00102, 0.00102]
    assert goal(0.99, 0.01, 0.0) == [0.99, 0.01, 0.0] and goal(0, 0.4, 0.6) == [0, 0.4, 0.4] and goal(0, 0, 0) == [0, 0, 0]
    assert [float(x) for x in mixing.goals(np.array([9.0, 8.0, 1.0]), np.ones(3) / 3)] == [8.0, 8.0, 1.0]


def test_mixing_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mixing_report(empty(spark), labels).count() == 0
    assert [r.copies for r in mixing.mixing_report(frame(spark, [None, "", "x"]), labels).collect()] == [1, 1, 1]


# -- pseudonyms ---------------------------------------------------------------------------


def test_pseudonyms_round_trip(spark):
    names = pseudonyms.Pseudonyms("k")
    r = random.Random(5)
    for _ in range(200):
        card = "4" + "".join(r.choice("0123456789") for _ in range(14))
        card += next(c for c in "0123456789" if pseudonyms.luhn(card + c))
        text = f"a{r.randrange(99)}.x@mail{r.randrange(9)}.example.com {card} +1 (2{r.randrange(10, 99)}) 555-{r.randrange(1000, 9999)} {r.randrange(256)}.{r.randrange(256)}.1.2 {r.randrange(1950, 2020)}-02-28 AKIA{r.randrange(10**15, 10**16)} password={r.randrange(10**9, 10**10)} {r.randrange(1, 29)}/{r.randrange(1, 13)}/1999"
        new, found = names.apply(text)
        assert len(found) == 8 and names.apply(new, back=True)[0] == text and names.apply(text)[0] == new
        assert pseudonyms.luhn(re.findall(r"\b4\d{15}\b", new)[0])
    assert names.apply("version 3.14, 1,000 and 12345678, CC BY 4.0") == ("version 3.14, 1,000 and 12345678, CC BY 4.0", [])


def test_pseudonyms_are_permutations():
    c = pseudonyms.Cipher("k")
    for size in (1, 2, 7, 100, 1000):
        assert sorted(c.permute(x, size, "t") for x in range(size)) == list(range(size))


def test_pseudonym_edges(spark):
    rows = pseudonyms.pseudonym_report(frame(spark, [None, "", "a@b.example.com"] * 2)).collect()
    assert [r.n_values for r in rows] == [0, 0, 1] * 2 and rows[0].text is None and rows[2].text == rows[5].text != "a@b.example.com"
    assert pseudonyms.pseudonym_report(empty(spark)).count() == 0


# -- sharding -----------------------------------------------------------------------------


@pytest.mark.parametrize("texts", [[prose(i, i % 90) for i in range(700)], ["same"] * 500 + [prose(i, 30) for i in range(200)], [None, "", "é"] * 5, []])
def test_sharding(spark, texts):
    rows = sharding.shard_report(frame(spark, texts)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    if len(texts) > 100:
        sizes = [sum(r.size for r in x) for x in by.values()]
        assert len(by) == 24 and max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)


# -- winnowing ----------------------------------------------------------------------------


def test_winnowing_equals_brute_force(spark):
    r = random.Random(3)
    items = [(i, prose(100 + i, 14 + i)) for i in range(12)] + [(50, "Short item here"), (51, None), (52, "..."), (53, "x y z " * 6)]
    docs = []
    for i in range(60):
        w = prose(i, r.randrange(0, 80)).split()
        _, t = items[i % 12]
        t = t.split()
        a = r.randrange(len(t))
        w[len(w) // 2 : len(w) // 2] = t[a : a + r.randrange(4, 24)]
        docs.append(" ".join(w).upper() if i % 3 else ", ".join(w))
    docs += [None, "", "a short item here b", "x y z " * 9, items[3][1] + " " + items[3][1]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x) for x in winnowing.decontamination_report(frame(spark, docs), bench).orderBy("doc_id").collect()]
    assert got == winnowing.report_by_brute_force(list(enumerate(docs)), items)
    kept = winnowing.drop_contaminated(frame(spark, docs), bench)
    assert kept.columns == frame(spark, docs).columns and {x.doc_id for x in kept.collect()} == {x[0] for x in got if not x[5]}
    assert winnowing.decontamination_report(empty(spark), bench).count() == 0
    assert winnowing.decontamination_report(frame(spark, docs), bench.limit(0)).where("contaminated").count() == 0


# -- languages ----------------------------------------------------------------------------


def test_languages_held_out(spark):
    tongues = {"a": "the and ing tion ough ish", "b": "der und sch ung heit keit", "c": "que ción los aje mente ito"}
    r = random.Random(1)
    rows = [(i, " ".join("".join(r.choice(p.split()) for _ in range(r.randrange(1, 4))) for _ in range(40)), x) for i, (x, p) in enumerate(sorted(tongues.items()) * 60)]
    rows += [(1000, None, "a"), (1001, "12 34 !", "a"), (1002, "und heit", None), (None, "the and", "a")]
    out = {x.doc_id: x for x in kneser_ney.language_report(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].lang_pred == x for i, _, x in rows[:180])
    assert out[1000].lang_pred == out[1001].lang_pred == "und" and out[1000].score == 0 and out[1002].lang_pred == "b"
    assert out[5].held_out == (zlib.crc32(b"5") % 4 == 2)
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert kneser_ney.language_report(none).count() == 0


def test_language_probabilities_sum_to_one(spark):
    counts = spark.createDataFrame([("abab aab", "x"), ("bba", "x")], "text string, lang string").mapInArrow(kneser_ney._count, "lang string, n int, gram long, context long, suffix long, count long")
    model = kneser_ney.Model.fit(counts.groupBy("lang", "n", "gram").agg({"count": "sum", "context": "first", "suffix": "first"}).toDF("lang", "n", "gram", "count", "context", "suffix"))
    every = ["".join(x) for n in range(1, 3) for x in __import__("itertools").product("ab", repeat=n)]
    scores, _ = model.word_scores(every)
    assert 0 < np.exp(scores[:, 0]).sum() <= 1.001


def test_languages_without_a_cap(spark, monkeypatch):
    """Kneser-Ney over all n-grams, computed by hand, for an open alphabet with more than
    100,000 n-grams of a language and order; the same from one block and from many."""
    r = random.Random(7)
    rows = [(i, " ".join("".join(chr(0x4E00 + 700 * (i % 2) + r.randrange(900)) for _ in range(r.randrange(1, 6))) for _ in range(2000)), "xy"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one = sorted(tuple(x) for x in kneser_ney.identify_languages(df).collect())
    monkeypatch.setattr(kneser_ney, "BLOCK", 200_000)
    many = sorted(tuple(x) for x in kneser_ney.identify_languages(df).collect())
    assert [x[1] for x in one] == [x[1] for x in many] == [x[2] for x in rows]
    grams = {(x, n): {} for x in "xy" for n in range(1, 5)}
    for _, t, x in rows:
        for w in t.split():
            w = "^" + w + "$"
            for e in range(1, len(w)):
                for n in range(1, min(4, e + 1) + 1):
                    g = w[e - n + 1 : e + 1]
                    grams[x, n][g] = grams[x, n].get(g, 0) + 1
    for n in range(1, 4):
        for x in "xy":
            more = {}
            for g in grams[x, n + 1]:
                more[g[1:]] = more.get(g[1:], 0) + 1
            grams[x, n] = {g: more.get(g, c) for g, c in grams[x, n].items()}
    d, context = {}, {}
    for n in range(1, 5):
        n1, n2 = (sum(c == k for x in "xy" for c in grams[x, n].values()) for k in (1, 2))
        d[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        for x in "xy":
            for g, c in grams[x, n].items():
                total, kinds = context.get((x, n, g[:-1]), (0, 0))
                context[x, n, g[:-1]] = total + c, kinds + 1

    def prob(x, g):
        if not g:
            return 1e-6
        total, kinds = context.get((x, len(g), g[:-1]), (0, 0))
        return prob(x, g[1:]) if not total else max(grams[x, len(g)].get(g, 0) - d[len(g)], 0) / total + d[len(g)] * kinds / total * prob(x, g[1:])

    assert max(map(len, grams.values())) > 100_000
    for (_, t, x), a, b in zip(rows, one, many):
        places = [("^" + w + "$")[max(0, e - 3) : e + 1] for w in t.split() for e in range(1, len(w) + 2)]
        want = -sum(np.log(prob(x, g)) for g in places) / len(places)
        assert abs(a[3] - want) < 1e-5 and abs(b[3] - want) < 1e-5


# -- licenses -----------------------------------------------------------------------------


def test_licenses(spark):
    assert sum(len(g) for _, g in licenses.rules()) >= 200
    texts = [
        "Licensed under CC BY-NC 4.0. All rights\nreserved.",
        "This is under the GNU General Public License, version 3.",
        "Released under the MIT License.",
        None,
        "",
        "nothing here, occ by and all rights",
        "Licensed under the Apache License, Version 2.0. " + prose(1, 20_000),
    ]
    rows = {r.doc_id: r for r in licenses.license_report(frame(spark, texts)).collect()}
    assert rows[0].base_labels == "cc-by,reserved" and "cc-by-nc-4.0" in rows[0].labels and (rows[0].n_base, rows[0].first_word, rows[0].last_word) == (2, 2, 7)
    assert rows[1].labels == "gpl,gpl-3.0" and rows[2].labels == "mit" and rows[6].labels == "apache-2.0"
    for i in (3, 4, 5):
        assert (rows[i].n_base, rows[i].first_word, rows[i].labels, rows[i].score) == (0, None, "", 0.0)
    assert licenses.license_report(empty(spark)).count() == 0
    assert [x[2] for x in licenses.detections(b"gnu general public license, version 2")] == ["gpl-2.0"]


def test_containment_equals_quadratic():
    class R:
        def __init__(self, order, priority):
            self.order, self.priority, self.label = order, priority, str(order)

    r = random.Random(2)
    for _ in range(200):
        found = [(s := r.randrange(20), s + r.randrange(1, 8), R(n, r.randrange(1, 4))) for n in range(8)]  # noqa: F841
        first = {}
        for s, e, x in sorted(found, key=lambda f: (f[2].priority, f[2].order)):
            first.setdefault((s, e), (s, e, x))
        left = list(first.values())
        want = sorted((s, e, x.label) for s, e, x in left if not any(o is not x and a <= s and e <= b and (a, b) != (s, e) and o.priority <= x.priority for a, b, o in left))
        assert sorted((s, e, label) for s, e, label, _ in licenses.suppress(found)) == want


def test_quality_sample_shuffles_no_text(spark, monkeypatch):
    from docweave.llm import pu_quality

    docs = spark.createDataFrame([(i, f"a text of number {i}, as good as any") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)], "doc_id long, quality int")
    plans, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), collect(self))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert pu_quality.fit_quality(docs, labels) is not None
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    texts = [p for p in plans if "MapInArrow" in p]
    assert len(texts) == 2 and all("BroadcastHashJoin" in p for p in texts)
