"""Exact, near and substring deduplication against brute force; nulls, empty texts, ties, repeats, clashing columns."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitals.llm import exact, minhash, substring
from vitals.llm.components import connected_components

DOCS = "doc_id long, text string, hash string, kept boolean, n long"


def frame(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "h", True, 1) for i, t in texts], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- exact


def test_exact_groups(spark):
    texts = [(5, "a  b"), (2, "a\tb"), (9, "a b "), (1, None), (3, ""), (None, "a b"), (7, "x"), (7, "x")]
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact.exact_duplicates(frame(spark, texts)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[5, sha("a b")]["keep_id"], got[5, sha("a b")]["group_size"], got[5, sha("a b")]["kept"]) == (2, 3, False)
    assert got[2, sha("a b")]["kept"] and not got[None, sha("a b")]["kept"]
    assert got[9, sha("a b ")]["group_size"] == 1
    assert (got[3, sha("")]["keep_id"], got[3, sha("")]["group_size"]) == (1, 2)
    assert got[7, sha("x")]["group_size"] == 2 and got[7, sha("x")]["kept"]
    assert exact.exact_duplicates(frame(spark, [])).count() == 0


def test_exact_collisions_stay_apart(spark):
    """A hash of two values: bytes tell texts apart."""
    df = frame(spark, [(1, "aa"), (2, "bb"), (3, "aa"), (4, "c"), (5, "d")])
    got = {r["doc_id"]: r["keep_id"] for r in exact.exact_duplicates(df, content_hash=lambda t: F.length(t)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_common_keys_are_dealt_in_parts(spark, monkeypatch):
    """One key with nine tenths of the rows, with the bound for splitting lowered."""
    from vitals.llm import tables

    rows = spark.range(1000).select(F.col("id").alias("v"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("k"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    want = sorted((r["v"], r["top"]) for r in rows.join(table, "k").collect())
    monkeypatch.setattr(tables, "LEAST", 50)
    out = tables.spread_join(rows, table, ["k"], ["v"])
    assert sorted((r["v"], r["top"]) for r in out.collect()) == want
    assert "_part" in out._jdf.queryExecution().toString()
    monkeypatch.setattr(tables, "LEAST", 5000)
    assert sorted((r["v"], r["top"]) for r in tables.spread_join(rows, table, ["k"], ["v"]).collect()) == want
    docs = frame(spark, [(k, "same" if k % 4 else f"t{k}") for k in range(400)])
    monkeypatch.setattr(tables, "LEAST", 50)
    assert sum(r["kept"] for r in exact.exact_duplicates(docs).collect()) == 101


def test_exact_drop_keeps_columns(spark):
    df = frame(spark, [(1, "a"), (2, "a"), (None, "a"), (3, "b")])
    out = exact.drop_exact_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out.collect()) == [(False, 1), (False, 3), (True, None)]


# ---- components


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got}
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- near copies


def shingle_set(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts, percent):
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def corpus(seed=3, copies=40):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(900)]
    text = lambda n: [vocabulary[k] for k in rng.integers(0, 900, n)]
    base, out = text(150), []
    for k in range(copies):
        t = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 7))):
            t[at] = vocabulary[rng.integers(0, 900)]
        out.append(" ".join(t))
    out += [" ".join(text(int(n))) for n in rng.integers(1, 200, 30)]
    out += [out[3], out[3].upper(), "", None, "one two", "One\ttwo", "only"]
    return [(10 + 3 * k, t) for k, t in enumerate(out)]


@pytest.mark.parametrize(("percent", "block"), [(85, 512), (85, 4), (80, 16)])
def test_near_components_against_brute_force(spark, percent, block):
    texts = corpus()
    want, sizes = brute_components(texts, percent)
    got = minhash.near_duplicates(frame(spark, texts), percent, block_rows=block).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_edge_cases(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    t = " ".join(f"w{k}" for k in range(30))
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, [(4, t), (4, t), (6, t), (None, t), (8, " \n")])).collect()}
    assert got == {(4, 4, True), (6, 4, False), (None, None, True), (8, 8, True)}


def test_circulant_signature():
    """Coordinate k is the smallest order over places shifted by k; equal sets agree, like ones nearly."""
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(0, 2**62, 500).astype(np.uint64))
    other = np.concatenate([s[50:], rng.integers(0, 2**62, 50).astype(np.uint64)])
    _, sig = minhash.signatures(np.repeat([0, 1, 2], [len(s), len(s), len(other)]), np.concatenate([s, s[::-1], other]), 216)
    order = np.random.default_rng(20220901).permutation(minhash.PLACES)
    place = (minhash.mix(s, 31) >> np.uint64(44)).astype(np.int64)
    tie = (minhash.mix(s, 31) >> np.uint64(32)).astype(np.int64) % 4096
    assert sig[0].tolist() == [int((order[(place + k) % minhash.PLACES] * 4096 + tie).min()) for k in range(216)]
    assert (sig[0] == sig[1]).all()
    assert np.mean(sig[0] == sig[2]) == pytest.approx(450 / 550, abs=0.12)


def test_sets_larger_than_the_places_have_their_own_signatures():
    rng = np.random.default_rng(6)
    sets = [rng.integers(0, 2**62, 3 << 20).astype(np.uint64) for _ in range(2)]
    _, sig = minhash.signatures(np.repeat([0, 1], 3 << 20), np.concatenate(sets), 8)
    assert (sig[0] != sig[1]).sum() >= 7


def test_a_large_cluster_of_low_similarity(spark):
    """Filled-in forms: half of each text is the form, so all share band buckets and none is linked; copies with one word changed are."""
    rng = np.random.default_rng(14)
    form = [f"f{k}" for k in range(150)]
    texts = []
    for k in range(1500):
        t = [*form, *(f"w{x}" for x in rng.integers(0, 10**6, 40))]
        texts += [(3 * k, " ".join(t))]
        if k % 100 == 0:
            t[170] = "other"
            texts += [(3 * k + 1, " ".join(t))]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, texts), 90, bands=60, block_rows=64).collect()}
    assert got == {i: i - i % 3 for i, _ in texts}


# ---- passages


def test_compact_windows_partition_long_runs():
    rng = np.random.default_rng(2)
    for n, t in ((60, 7), (200, 20), (30, 30), (5, 9)):
        h = rng.integers(1, 40 if n == 60 else 2**60, n).astype(np.uint64)
        lo, c, hi = substring.compact_windows(h, t)
        for a in range(n):
            for b in range(a + t - 1, n):
                inside = np.flatnonzero((lo <= a) & (a <= c) & (c <= b) & (b <= hi))
                assert len(inside) == 1
                assert c[inside[0]] == a + int(np.argmin(h[a : b + 1]))


def test_passages_against_brute_force(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"v{k}" for k in range(700)]
    text = lambda n: [vocabulary[k] for k in rng.integers(0, 700, n)]
    passages = [text(n) for n in (50, 55, 80, 120)]
    docs = []
    for k in range(60):
        t = text(int(rng.integers(30, 250)))
        if k % 3:
            p = passages[int(rng.integers(0, 4))]
            at = int(rng.integers(0, len(t)))
            t = t[:at] + p + t[at:]
        docs.append((k * 2, " ".join(t)))
    docs += [(500, docs[7][1]), (501, "be " * 300), (502, "be " * 300), (503, None), (504, ""), (None, docs[7][1])]
    found = substring.repeated_passages(frame(spark, docs))
    rows = found.collect()
    spans = {}
    for r in rows:
        assert r["source_id"] < r["doc_id"] and r["n_words"] >= 50 and r["similarity"] >= 0.8
        spans.setdefault(r["doc_id"], []).append((r["start"], r["start"] + r["n_words"]))
    seen, want = {}, set()
    for i, t in docs:
        if i is None:
            continue
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if seen.setdefault(key, i) != i:
                want.add(i)
                assert any(a <= k and k + 50 <= b for a, b in spans.get(i, [])), (i, k)
    assert set(spans) == want
    cut = {r["doc_id"]: r["text"] for r in substring.cut_passages(frame(spark, docs), found).collect()}
    assert 500 not in cut and 502 not in cut and cut[0] == docs[0][1] and cut[504] == "" and cut[503] is None and cut[None] == docs[7][1]
    for i, t in docs:
        if i in spans and i in cut:
            gone = set().union(*(range(a, b) for a, b in spans[i]))
            assert words(cut[i]) == [x for k, x in enumerate(words(t)) if k not in gone]


def test_changed_words_inside_a_passage(spark):
    rng = np.random.default_rng(4)
    text = lambda n: [f"v{k}" for k in rng.integers(0, 700, n)]
    p = text(100)
    changed = p[:50] + ["new"] + p[51:]
    docs = [(1, " ".join(text(40) + p + text(40))), (2, " ".join(text(60) + changed + text(10)))]
    (r,) = substring.repeated_passages(frame(spark, docs)).collect()
    assert (r["doc_id"], r["source_id"], r["start"], r["n_words"]) == (2, 1, 60, 100) and 0.8 <= r["similarity"] < 1


def shared_passage(seed, holders, n, others=0):
    """Documents of chance words, `holders` of them with one passage of n words, and the places of these."""
    rng = np.random.default_rng(seed)
    text = lambda n: [f"v{k}" for k in rng.integers(0, 30_000, n)]
    p, docs, at = text(n), [], {}
    for k in range(holders + others):
        t = text(int(rng.integers(20, 90)))
        if k >= others:
            at[k] = int(rng.integers(0, len(t)))
            t[at[k] : at[k]] = p
        docs.append((k, t))
    return docs, p, at


@pytest.mark.parametrize(("holders", "seeds"), [(3, 40), (30, 10), (1000, 2)])
def test_short_passage_in_many_documents(spark, holders, seeds):
    docs, want = [], {}
    for seed in range(seeds):
        n = 50 + seed % 11
        some, _, at = shared_passage(seed, holders, n)
        docs += [(seed * 10_000 + i, " ".join(t)) for i, t in some]
        want |= {seed * 10_000 + i: (x, n) for i, x in at.items() if i}
    got = {}
    for r in substring.repeated_passages(frame(spark, docs)).collect():
        assert r["source_id"] // 10_000 == r["doc_id"] // 10_000 and r["source_id"] < r["doc_id"]
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    assert {i for i, (x, n) in want.items() if not set(range(x, x + n)) <= got.get(i, set())} == set()


def test_smaller_ids_that_hold_some_words_of_a_passage(spark):
    """The first of a key shares too little: the others are tied to each other."""
    docs, p, at = shared_passage(5, 6, 80, others=40)
    changed = [x for k, x in enumerate(p)]
    changed[40] = "new"
    docs = [(i, t + p[2 * i : 2 * i + 25] if i < 28 else t) for i, t in docs]
    docs = [(i, t[: at[i]] + changed + t[at[i] + 80 :] if i == 45 else t) for i, t in docs]
    spans = {}
    for r in substring.repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in docs])).collect():
        spans.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    assert set(spans) == set(range(41, 46))
    assert all(set(range(at[i], at[i] + 80)) <= spans[i] for i in spans)


@pytest.mark.parametrize("parts", [[(0, 49)], [(1, 50)], [(0, 49), (3, 52)]])
def test_smaller_ids_that_hold_all_but_a_word_of_a_passage(spark, parts):
    """In each of 200 triples the first document has the passage of the others but for a word at an end."""
    rng = np.random.default_rng(21)
    text = lambda n: [f"v{k}" for k in rng.integers(0, 30_000, n)]
    n, docs, want = max(50, parts[-1][1]), [], {}
    for k in range(200):
        p = text(n)
        docs.append((10 * k + 1, text(20) + [x for a, b in parts for x in p[a:b] + text(20)]))
        for i in (2, 3):
            before = int(rng.integers(0, 60))
            docs.append((10 * k + i, text(before) + p + text(30)))
            if i == 3:
                want[10 * k + 3] = before
    found = substring.repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in docs])).collect()
    exact = {(r["doc_id"], r["source_id"], r["start"]) for r in found if r["similarity"] == 1.0 and r["n_words"] >= n}
    assert {i for i, x in want.items() if (i, i - 1, x) not in exact} == set()


def spans_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    return out


def test_common_passages_dealt_by_run(spark):
    """The same words found whether keys are hot or not, and however the rows are cut."""
    docs, want = [], {}
    for seed in range(3):
        some, _, at = shared_passage(seed, 120, 56)
        docs += [(seed * 1000 + i, " ".join(t)) for i, t in some]
        want |= {seed * 1000 + i: set(range(x, x + 56)) for i, x in at.items() if i}
    docs += [(9000 + k, docs[5][1]) for k in range(60)]
    found = [
        spans_of(substring.repeated_passages(df, sample=sample, hot=hot).collect())
        for df, sample, hot in ((frame(spark, docs), 1, 20), (frame(spark, docs).repartition(16), 1, 20), (frame(spark, docs).coalesce(1), 64, 10**9))
    ]
    assert all(want[i] <= found[0].get(i, set()) for i in want) and all(9000 + k in found[0] for k in range(60))
    assert found[0] == found[1] == found[2]


def test_windows_of_common_keys_are_tied_to_the_head_once(spark, monkeypatch):
    """The links of _tied; a row of the join for each run is made only of runs that the head of the key lacks."""
    rng = np.random.default_rng(3)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = some(120)
    texts = [" ".join(some(30) + passage[: 60 + 20 * (k % 4)] + some(30)) for k in range(40)]
    windows = substring.chunk_windows(substring.Words(pa.array(texts)), np.arange(len(texts)))
    order = np.lexsort((windows[2], windows[1], windows[0]))
    windows = [x[order] for x in windows]
    several = np.isin(windows[0], [k for k, n in zip(*np.unique(windows[0], return_counts=True), strict=True) if n > 1])
    made, real = [], substring.spread_join

    def counted(rows, table, keys, by):
        out = real(rows, table, keys, by)
        if keys == ["run"]:
            made.append(out.where("id > first.id").count())
        return out

    monkeypatch.setattr(substring, "spread_join", counted)
    df = spark.createDataFrame(zip(*(x[several].tolist() for x in windows), strict=True), substring._WINDOWS)
    got = [tuple(r) for r in substring.hot_links(df).collect()]
    assert len(got) == len(set(got)) > 0
    assert set(got) == set(zip(*(x.tolist() for x in substring._tied(windows)), strict=True))
    assert made[0] < 8 * several.sum()


def test_runs_beyond_a_common_passage_make_few_rows(spark, monkeypatch):
    """Runs that reach into other words have no holders by chance, and one row stands for all runs with the same holders; every text keeps its links."""
    rng = np.random.default_rng(5)
    some = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = some(60)
    beside = [some(40) for _ in range(50)]  # of three texts each
    texts = [" ".join(some(40) + passage + beside[k // 3]) for k in range(150)]
    key, ids, *_ = substring.chunk_windows(substring.Words(pa.array(texts)), np.arange(len(texts)))
    holders = {}
    for k, i in zip(key.tolist(), ids.tolist(), strict=True):
        holders.setdefault(k, set()).add(i)
    hot = np.array(sorted(k for k, some in holders.items() if len(some) > 20), np.int64)
    made, real = [], substring.spread_join

    def counted(rows, table, keys, by):
        out = real(rows, table, keys, by)
        if keys == ["run"]:
            made.append(out.where("id > first.id").count())
        return out

    monkeypatch.setattr(substring, "spread_join", counted)
    got = substring.window_links(frame(spark, enumerate(texts)).select("doc_id", "text"), hot=hot).collect()
    assert len(hot) and made[0] < 3 * len(texts)
    whole = {(r["b"], r["a"]) for r in got if r["hash"] >= substring.WHOLE}
    assert {(k, 0) for k in range(1, 150)} <= whole and {(k, k - k % 3) for k in range(150) if k % 3} <= whole


def test_near_passages_are_mostly_found(spark):
    """Passages of 60 to 120 words with one to three words changed, five holders each."""
    rng = np.random.default_rng(21)
    text = lambda n: [f"v{k}" for k in rng.integers(0, 30_000, n)]
    docs, want = [], set()
    for seed in range(60):
        n = int(rng.integers(60, 121))
        p = text(n)
        for k in range(5):
            q = list(p)
            if k:
                for at in rng.integers(0, n, int(rng.integers(1, 1 + n // 40))):
                    q[at] = f"z{rng.integers(0, 10**6)}"
                want.add(seed * 10 + k)
            docs.append((seed * 10 + k, " ".join(text(30) + q + text(30))))
    docs += [(5000 + k, " ".join(text(120))) for k in range(200)]
    got = set(spans_of(substring.repeated_passages(frame(spark, docs)).collect()))
    assert got <= want and len(got) >= 0.9 * len(want), len(got) / len(want)


def test_long_texts_and_far_places(spark):
    """Texts beyond a chunk, and places beyond 2^23."""
    rng = np.random.default_rng(3)
    words_ = [f"q{k}" for k in rng.integers(0, 10**6, 120_000)]
    p = [f"p{k}" for k in range(70)]
    docs = [(1, " ".join(words_[:100_000] + p + words_[100_000:])), (2, " ".join(["x"] + p + ["y"]))]
    (r,) = substring.repeated_passages(frame(spark, docs)).collect()
    assert (r["doc_id"], r["start"], r["n_words"], r["source_start"]) == (2, 1, 70, 100_000)
    at = np.array([(9_000_000 << 24) | (50 << 12) | 50])
    b, a, _, lo, hi, shift = substring._linked([np.array([4]), np.array([7]), at], [np.array([4]), np.array([2]), at - (1 << 24)])
    assert (b[0], a[0], lo[0], hi[0], shift[0]) == (7, 2, 8_999_950, 9_000_050, 1)


def test_links_of_one_document_are_spread(spark):
    rows = [(1000, a, k, 10, 80, 5) for a in range(200) for k in range(2)]
    links = spark.createDataFrame(rows, ", ".join(f"`{c}` long" for c in ("b", "a", "hash", "from", "to", "shift")))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = substring.candidates(links).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted((r["b"], r["a"], r["from"], r["to"]) for r in got) == [(1000, a, 10, 80) for a in range(200)]
    assert len({r["task"] for r in got}) > 1


def test_every_copy_in_a_document_is_found(spark):
    rng = np.random.default_rng(8)
    text = lambda n: [f"v{k}" for k in rng.integers(0, 30_000, n)]
    p, q, docs, want = text(60), text(70), [], {}
    docs.append((1, text(30) + p + text(40) + q + text(9)))
    docs.append((2, text(12) + p + text(35) + p + text(7)))
    want[2] = {*range(12, 72), *range(107, 167)}
    docs.append((3, text(5) + q[15:55] + text(20) + q + text(11)))
    want[3] = set(range(65, 135))
    docs += [(4, text(20) + ["to", "be"] * 60 + text(5)), (5, text(3) + ["to", "be"] * 45 + text(4) + ["to", "be"] * 40)]
    want[5] = {*range(3, 93), *range(97, 177)}
    spans = {}
    for r in substring.repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in docs])).collect():
        spans.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["n_words"]))
    assert set(spans) == set(want)
    assert all(want[i] <= spans[i] for i in want)


@pytest.mark.parametrize("side", ["left", "right", "both"])
def test_near_passage_beside_loosely_edited_text(side):
    rng = np.random.default_rng(9)
    a = rng.permutation(100_000)[:180].astype(np.int32)
    b = a.copy()
    b[88:93] = -np.arange(1, 6)  # one word changed in places 60 to 115
    edits = ([54 - 8 * k for k in range(6)] if side != "right" else []) + ([116 + 8 * k for k in range(7)] if side != "left" else [])
    for at in edits:
        b[at : at + 6] = -np.arange(100 * at, 100 * at + 6)
    # nothing in common beyond the edited side
    if side == "right":
        b[:60] = -np.arange(50_000, 50_060)
    if side == "left":
        b[116:] = -np.arange(60_000, 60_064)
    runs = substring.same_passages(a, b, 0, 0, 46)
    assert any(x0 <= 60 and x1 >= 115 and s >= 0.8 for x0, x1, _, _, s in runs)


def test_many_links_at_once(spark):
    """Tasks send links in parts."""
    p = " ".join(f"p{k}" for k in range(52))
    docs = spark.range(30_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("a"), "id"), F.lit(p), F.concat(F.lit("b"), "id")).alias("text"))
    assert substring.repeated_passages(docs).select("doc_id").distinct().count() == 29_999


def test_cut_with_clashing_columns(spark):
    p = " ".join(f"p{k}" for k in range(60))
    df = spark.createDataFrame([(1, "a " + p, 0, "x", "y", 5), (2, "é b\n" + p + "  c d", 0, "x", "y", 5)], "doc_id int, text string, _own int, _key string, _body string, n_chars int")
    out = {r["doc_id"]: r for r in substring.drop_repeated_passages(df).collect()}
    assert out[1]["text"] == "a " + p and out[2]["text"] == "é b\nc d" and out[2]["n_chars"] == 7 and out[2]["_body"] == "y"


def test_passages_of_nothing(spark):
    assert substring.repeated_passages(frame(spark, [])).count() == 0
    assert substring.repeated_passages(frame(spark, [(1, "a b"), (2, None)])).count() == 0
