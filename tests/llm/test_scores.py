"""License scan, classifier, toxicity and quality rules: brute force, exactness, held-out accuracy, edge cases."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from vitals.llm import licenses, nbsvm, quality_rules, toxicity

DOCS = "doc_id long, text string, label int, token string, words string, key string, score double"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, "t", "w", "k", 0.0) for i, t in texts], DOCS)


# ---- licenses


def brute_scan(text):
    w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, name) for phrase, name in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    best = {}
    for n in licenses.notices():
        for b in range(0, max(len(w), 1), n["step"]):
            held = set(w[b : b + 2 * n["step"]]) & set(n["tokens"])
            if len(held) >= n["need"]:
                best[n["label"]] = max(best.get(n["label"], 0), len(held) / len(n["tokens"]))
    own = sorted({name for _, name in places})
    at = [i for i, _ in places]
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(own), ",".join(sorted({*own, *best})), 1.0 if at else max(best.values(), default=0.0))


def test_licenses_against_brute_force(spark):
    isc = dict(licenses.NOTICES)["isc"]
    bsd = dict(licenses.NOTICES)["bsd"]
    texts = ["Released under the MIT License.", "mit\n-- LICENSE, mit license! submit license", "CC-BY cc by CC BY-NC 4.0", "a " * 300 + isc + " b" * 300, bsd.replace("modification", "x").upper(), "Licensed under the Apache\tLicense, Version 2.0.", "été mit licenseé", "", None, "permission", isc[:60]]
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.license_scan(frame(spark, list(enumerate(texts)))).collect()}
    assert got == {k: brute_scan(t) for k, t in enumerate(texts)}
    assert got[3][5] == "isc" and got[4][5] == "bsd"


def test_notices_of_any_length(spark):
    """A notice of 170 words, and one of 700, whole or with a tenth of the words gone."""
    long = [" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 170), ("b", 700))]
    texts = ["x " * 50 + long[0] + " y" * 500, " ".join(long[1].split()[70:]), " ".join(long[0].split()[:120]), "z " * 3000 + long[1]]
    given = (("one", long[0]), ("two", long[1]))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.license_scan(frame(spark, list(enumerate(texts))), given=given).collect()}
    assert got == {0: ("one", 1.0), 1: ("two", 0.9), 2: ("", 0.0), 3: ("two", 1.0)}


def test_license_edge_cases(spark):
    assert licenses.license_scan(frame(spark, [])).count() == 0
    got = licenses.license_scan(frame(spark, [(1, "MIT License"), (1, "MIT License"), (None, "MIT License"), (1, "other")])).collect()
    assert sorted(r["labels"] for r in got) == ["", "mit", "mit", "mit"]


def test_license_scan_is_native(spark):
    plan = licenses.license_scan(frame(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- quality classifier


def training(spark, n=160):
    rng = np.random.default_rng(7)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat", "while", "it", "rained."], 40))
    bad = lambda: " ".join(x.upper() + "!!" for x in rng.choice(["buy", "now", "win"], 40))
    rows = [(k, good() if k % 2 else bad()) for k in range(n)]
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(n)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rows, labels = training(spark)
    model = nbsvm.fit(frame(spark, rows), labels)
    more = [(1000, None), (1001, ""), (None, "the cat sat"), (1002, "THE!!"), (1002, "THE!!")]
    got = nbsvm.score_quality(frame(spark, rows + more), model).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == len(rows) + len(more)
    assert all((r["score"] >= 0.3) == bool(r["doc_id"] % 2) for r in got if r["doc_id"] is not None and r["doc_id"] < 1000)
    assert nbsvm.score_quality(frame(spark, []), model).count() == 0


def test_classifier_without_labels(spark):
    rows, labels = training(spark, 20)
    model = nbsvm.fit(frame(spark, rows), labels.limit(0))
    assert [r["score"] for r in nbsvm.score_quality(frame(spark, rows), model).collect()] == [pytest.approx(0.5)] * 20


def test_dual_coordinate_descent_is_optimal():
    """No small step from the solution lowers the primal objective."""
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(12, 5, replace=False)) for _ in range(60)]
    y = np.where(np.array([(0 in r) or (1 in r) for r in rows]), 1, -1)
    values, cost = rng.uniform(0.5, 2, 12), np.full(60, 0.7)
    w = nbsvm.dual_coordinate_descent(rows, values, y, cost, 12, passes=4000)

    def primal(w):
        margin = np.array([values[r] @ w[r] + w[-1] for r in rows])
        return w @ w / 2 + (cost * np.maximum(0, 1 - y * margin)).sum()

    least = primal(w)
    for _ in range(300):
        assert primal(w + rng.normal(0, 0.05, 13)) > least - 1e-2


def test_classifier_scores_against_brute_force():
    """Log-count ratios by counting, and the dual by very many small steps of projected gradient."""
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 2, 40)
    rows = [np.flatnonzero(rng.random(15) < np.where(np.arange(15) < 5, 0.2 + 0.5 * y, 0.4)) for y in labels]
    hold = np.array([[f in r for f in range(15)] for r in rows], float)
    model = nbsvm.fit_arrays(rows, np.arange(15) * 7, hold[labels == 1].sum(0), hold.sum(0), labels, 0.4)
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    ratio = np.array([np.log((sum(hold[i, f] for i in range(40) if labels[i]) + 1) / (n1 + 2)) - np.log((sum(hold[i, f] for i in range(40) if not labels[i]) + 1) / (n0 + 2)) for f in range(15)])
    x = hold * ratio
    x = np.hstack([x / max(1.0, (x**2).sum(1).mean()) ** 0.5, np.ones((40, 1))])
    y, cost = np.where(labels == 1, 1, -1), 40 / (2 * np.where(labels == 1, n1, n0))
    q, alpha = (y[:, None] * x) @ (y[:, None] * x).T, np.zeros(40)
    top = np.linalg.eigvalsh(q).max()
    for _ in range(60_000):
        alpha = np.clip(alpha - (q @ alpha - 1) / top, 0, cost)
    margins = x @ (x.T @ (alpha * y))
    doc = np.repeat(np.arange(40), [len(r) for r in rows])
    got = model.margins(doc, (np.concatenate(rows) * 7).astype(np.uint64), 40)
    assert got == pytest.approx(margins, abs=2e-2)
    assert model.scores(got) == pytest.approx(1 / (1 + np.exp(-model.slope * margins - model.intercept)), abs=2e-2)


# ---- toxicity


def index_of(weights, idf, labels, drawn=None):
    rows = [(np.flatnonzero(w), w[w > 0]) for w in weights]
    return toxicity.Index(np.arange(len(idf)), idf, *toxicity.inverted(rows, len(idf)), labels, np.arange(len(labels)), 0.1, drawn)


def test_nearest_is_exact():
    rng = np.random.default_rng(9)
    weights = np.where(rng.random((300, 50)) < 0.1, rng.random((300, 50)), 0)
    weights[:, 0] += 0.01
    weights /= np.linalg.norm(weights, axis=1, keepdims=True)
    idf = rng.uniform(1, 3, 50)
    index = index_of(weights, idf, rng.integers(0, 2, 300))
    for _ in range(100):
        terms = np.sort(rng.choice(50, rng.integers(1, 8), replace=False))
        q = np.zeros(50)
        q[terms] = idf[terms]
        cosine = weights @ (q / np.linalg.norm(q))
        i, s = toxicity.nearest(index, terms)
        assert s == pytest.approx(np.sort(cosine[cosine > 0])[::-1][: toxicity.NEIGHBOURS], abs=1e-9)
        assert toxicity.nearest(index, terms, without=int(i[0]))[0].tolist() == np.lexsort((np.arange(300), -np.where(np.arange(300) == i[0], 0, cosine)))[: len(i)].tolist()


def test_blocks_below_the_kth_stay_shut(monkeypatch):
    weights = np.eye(3)[np.repeat([0, 1], [64, 640])] + 0.01 * np.eye(3)[2]
    weights /= np.linalg.norm(weights, axis=1, keepdims=True)
    index = index_of(weights, np.ones(3), np.zeros(704, np.int64))
    seen = []
    ranges = toxicity._ranges
    monkeypatch.setattr(toxicity, "_ranges", lambda a, b: (seen.append(int((b - a).sum())), ranges(a, b))[1])
    assert toxicity.nearest(index, np.array([0, 2]))[0].tolist() == list(range(16))
    assert sum(seen[1:]) == 128  # postings of one block of eleven


def test_terms_count_as_often_as_they_come():
    d, t, c, n = toxicity.chunk_terms(pa.array(["bad good bad", None, "bad"]))
    assert n == 3 and d.tolist() == [0, 0, 2] and sorted(c[:2].tolist()) == [1, 2] and c[2] == 1
    index = index_of(np.eye(2), np.array([1.0, 2.0]), np.array([0, 1]))
    i, s = toxicity.nearest(index, np.arange(2), np.array([6, 4]))
    assert i.tolist() == [1, 0] and s == pytest.approx([0.8, 0.6])
    assert toxicity.nearest(index, np.arange(2), np.array([10, 1]))[0].tolist() == [0, 1]


def test_votes_do_not_follow_the_share_drawn():
    """Of 1:9 rows all are drawn, or 1:1; the neighbourhood holds classes as drawn."""
    def score(n1, n0, drawn):
        index = index_of(np.ones((n1 + n0, 1)), np.ones(1), np.repeat([1, 0], [n1, n0]), drawn)
        return toxicity.vote(index, np.arange(n1 + n0), np.ones(n1 + n0))

    assert score(1, 9, 0.1) == pytest.approx(score(5, 5, 0.5)) == pytest.approx(0.1)


def test_toxicity_scores_against_brute_force(spark):
    """From terms to scores, with dictionaries and every pair of a text and an example."""
    rng = np.random.default_rng(12)
    plain = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("lan", "mer", "nit", "pol", "ras")]
    texts = {}
    for k in range(240):
        t = list(rng.choice(plain, 25)) + (list(rng.choice(["vorxile", "vorxant", "quagg"], 3)) if k % 4 == 0 else [])
        texts[k] = " ".join(rng.permutation(t))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(240)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(frame(spark, list(texts.items())), labels)
    known = set(index.vocabulary.tolist())
    bags = {}
    for k, t in texts.items():
        _, term, count, _ = toxicity.chunk_terms(pa.array([t]))
        bags[k] = {x: 1 + np.log(int(c)) for x, c in zip(term.view(np.int64).tolist(), count, strict=True) if x in known}
    df = collections.Counter(x for b in bags.values() for x in b)
    unit = {}
    for k, b in bags.items():
        w = {x: c * (np.log((len(texts) + 1) / (df[x] + 1)) + 1) for x, c in b.items()}
        unit[k] = {x: v / sum(y * y for y in w.values()) ** 0.5 for x, v in w.items()}
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(frame(spark, list(texts.items())), index).collect()}
    place = {int(i): n for n, i in enumerate(index.ids)}
    for k, u in unit.items():
        near = sorted(((-sum(v * unit[i].get(x, 0) for x, v in u.items()), n, i) for i, n in place.items()))[: index.k]
        near = [(-s, i) for s, _, i in near if s < 0]
        one = sum(s for s, i in near if i % 4 == 0) * index.prior / index.drawn
        zero = sum(s for s, i in near if i % 4) * (1 - index.prior) / (1 - index.drawn)
        total = sum(s for s, _ in near)
        vote = ((total * one / (one + zero) if total else 0) + toxicity.PRIOR_WEIGHT * index.prior) / (total + toxicity.PRIOR_WEIGHT)
        assert got[k]["score"] == pytest.approx(1 / (1 + np.exp(-index.curve[0] * vote - index.curve[1])), abs=1e-9)
        assert [s for s, _ in near] == pytest.approx(got[k]["cosines"], abs=1e-9) and len(got[k]["evidence"]) == index.k
    assert known == {x for i in index.ids.tolist() for x in toxicity.chunk_terms(pa.array([texts[i]]))[1].view(np.int64).tolist()}


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    plain = [f"{a}{b}" for a in ("ba", "ce", "di", "fo") for b in ("lan", "mer", "nit", "pol", "ras")]
    rows, marks = [], []
    for k in range(300):
        t = list(rng.choice(plain, 30))
        if k % 3 == 0:
            for at in rng.integers(0, 30, 4):
                t[at] = "vorx" + str(rng.choice(["ile", "ant", "um", "esk"]))
        rows.append((k, " ".join(t)))
        marks.append((k, 1, int(k % 3 == 0)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    index = toxicity.fit(frame(spark, rows), labels)
    more = [(1000, None), (1001, ""), (None, "vorxile"), (1002, "vorxunseen vorxnew"), (1002, "vorxunseen vorxnew")]
    got = toxicity.score_toxicity(frame(spark, rows + more), index).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= r["score"] <= 1 for r in got)
    wrong = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and (r["score"] >= 0.7) != (r["doc_id"] % 3 == 0)]
    assert len(wrong) <= 3
    assert all(r["score"] >= 0.7 for r in got if r["doc_id"] == 1002)
    assert all(r["score"] < 0.7 and not r["evidence"] for r in got if r["doc_id"] in (1000, 1001))
    none = toxicity.fit(frame(spark, []), labels.limit(0))
    assert toxicity.score_toxicity(frame(spark, []), none).count() == 0


# ---- quality rules


def test_variety_votes_whatever_the_length(spark):
    """(words, distinct words): few of them are bad in long texts too, as many as a novel has aren't."""
    rows = [(4999, 20), (5000, 20), (5000, 499), (5000, 500), (1_000_000, 20), (1_000_000, 20_000)]
    table = spark.createDataFrame([tuple({"n_words": n, "n_distinct_words": d}.get(c, 0) for c in quality_rules.COUNTS) for n, d in rows], ", ".join(f"{c} long" for c in quality_rules.COUNTS))
    got = {(r["n_words"], r["n_distinct_words"]): r["v"] for r in table.withColumn("v", quality_rules.votes()["variety"]).collect()}
    assert [got[x] for x in rows] == [-1, -1, -1, 0, -1, 0]


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {i for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_counts_against_brute_force():
    rng = np.random.default_rng(8)
    texts = [None, "", " ", "\n\n", "é# 日本 |<>\nx\nx\n x", "a b c d e f g h " * 3, "one\n\none\n \none"]
    texts += ["".join(rng.choice(["ab", "c", " ", "\n", "#", "é ", "\t", "d e f "], 200)) for _ in range(80)]
    c = quality_rules.count_chunk(pa.array(texts))
    for k, t in enumerate(texts):
        assert tuple(int(c[n][k]) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(t)


def test_rules_keep_prose(spark):
    rng = np.random.default_rng(6)
    prose = [" ".join(rng.choice([f"word{k}" for k in range(200)], 120)) for _ in range(60)]
    junk = ["buy " * 100, "### $$$ " * 60, " ".join(f"SHOUT{k}!! ###" for k in range(60))]
    texts = [*enumerate(prose), *enumerate(junk, 100), (200, None), (201, ""), (None, prose[0]), (0, prose[0])]
    got = quality_rules.quality_rules(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert all(kept[k] for k in range(60)) and not any(kept[k] for k in (100, 101, 102, 200, 201)) and kept[None]
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


def test_em_finds_accurate_rules():
    """Rules that err at known rates: the good one weighs more than the poor one."""
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.9
    rates = [0.97, 0.95, 0.9, 0.7]
    votes = np.array([np.where(rng.random(20_000) < r, np.where(good, 1, -1), np.where(good, -1, 1)) for r in rates]).T
    patterns, which, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, found = quality_rules.expectation_maximisation(patterns, n)
    assert np.mean((posterior[which.ravel()] >= 0.5) == good) > 0.97
    assert found["accuracy"][0] > found["accuracy"][3]


def test_posterior_and_kept_against_brute_force(spark):
    """EM over single documents in plain Python, not over counted patterns."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"word{k}" for k in range(60)], int(n))) for n in rng.integers(5, 90, 40)]
    texts += ["# $ " * 40, "buy now " * 30, " ".join(f"LOUD{k}" for k in range(40)), "a\n" * 30, "", "longwordlongword " * 25]
    df = frame(spark, [*enumerate(texts), (99, None)])
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    rules = quality_rules.votes()
    votes = {r["doc_id"]: [r[k] for k in rules] for r in quality_rules.text_counts(df).withColumns(rules).collect()}
    good = {i: 0.1 if min(v) < 0 else 0.9 for i, v in votes.items()}
    pull = quality_rules.PULL * len(votes) + 1
    for _ in range(100):
        chance = []
        for sign, trust in ((1, quality_rules.TRUST[0]), (0, quality_rules.TRUST[1])):
            table = []
            for k in range(len(rules)):
                c = [pull * t for t in trust]
                for i, v in votes.items():
                    c[v[k] + 1] += good[i] if sign else 1 - good[i]
                table.append([x / sum(c) for x in c])
            chance.append(table)
        prior = (sum(good.values()) + 1) / (len(good) + 2)
        new = {}
        for i, v in votes.items():
            a, b = prior, 1 - prior
            for k, x in enumerate(v):
                a, b = a * chance[0][k][x + 1], b * chance[1][k][x + 1]
            new[i] = a / (a + b)
        moved = max(abs(new[i] - good[i]) for i in good)
        good = new
        if moved < 1e-9:
            break
    for i, r in got.items():
        n, _, _, _, again = brute_counts(texts[i] if i != 99 else None)
        failed = n < 20 or 100 * again > 30 * n
        assert r["posterior"] == pytest.approx(good[i], abs=1e-6)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and good[i] >= 0.5)
