"""Class-based language-model scores against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vitals.llm import brown

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def texts(n=120, seed=1):
    """Two languages, each with words that come in a fixed order of kinds."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        side = "ab"[i % 2]
        kinds = [[f"{side}{kind}{k}" for k in range(12)] for kind in "xyz"]
        words = [rnd.choice(kinds[j % 3]) if rnd.random() < 0.97 else f"Rare{rnd.random()}" for j in range(rnd.randint(0, 60))]
        out.append((i, " ".join(words)))
    return out + [(500, None), (501, ""), (502, " \t\n"), (503, "x"), (503, "x"), (None, "ax1 ay1"), (504, "ax1 " * 3000)]


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def held(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 7 == 2


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)


def name_of(word):
    return int(brown.chunk_tokens(pa.array([word or ""]))[0][0])


def test_scores_are_those_of_the_counts(spark):
    docs = texts()
    df = spark.createDataFrame(docs, DOCS)
    options = dict(k=6, top=40, hot=50, rounds=6, parts=2)
    got = rows(brown.score_texts(df, **options))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    ready = df.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.coalesce(fold != 2, F.lit(False)).alias("learn"), (fold == 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model, rare, _ = brown.fit(ready, **options)

    learnt = [tokens(t) for i, t in docs if held(i) is False]
    c = Counter(w for ws in learnt for w in ws)
    n, v = sum(c.values()), len(c)
    by_hash = {name_of(w): w for w in c}
    # the most frequent words, and the class of every word
    rank = {by_hash[h]: int(r) for h, r in zip(model.hashes.tolist(), model.rank.tolist(), strict=True)}
    of = {w: int(model.classes[r]) for w, r in rank.items()} | {by_hash[r["word"]]: r["class"] for r in rare.collect()}
    assert set(of) == set(c) and len(rank) < len(c)
    top = {w for w, r in rank.items() if r < 40}
    assert min(c[w] for w in top) >= max(k for w, k in c.items() if w not in top)
    context = lambda w: of[w] if w in top else 6
    follow, total = defaultdict(Counter), Counter()
    for ws in learnt:
        for a, b in zip([None, *ws], ws, strict=False):
            follow[context(a)][of[b]] += 1
            if c[b] == 1:
                follow[context(a)][6] += 1
    for w, k in c.items():
        total[of[w]] += k
    counts = np.array([[follow[a][b] for b in range(7)] for a in range(7)], float)
    share = counts.sum(0) + np.array([0] * 6 + [1])
    share = share / share.sum()
    kinds = np.maximum((counts > 0).sum(1), 1)[:, None]
    chance = (counts + kinds * share) / (counts.sum(1)[:, None] + kinds)

    def p(a, w):
        base = (c[w] + 1) / (n + v + 1)
        ours = chance[context(a)][of[w]] * c[w] / total[of[w]] if w in c else chance[context(a)][6]
        return base, (1 - brown.SMOOTH) * ours + brown.SMOOTH * base

    want = []
    for i, t in docs:
        ws = tokens(t)
        pairs = [p(a, w) for a, w in zip([None, *ws], ws, strict=False)]
        want.append((i, held(i), len(ws), sum(w in c for w in ws), n, sum(math.log10(x) for x, _ in pairs), sum(math.log10(x) for _, x in pairs)))
    want.sort(key=str)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for x, y in zip(got, want, strict=True):
        assert math.isclose(x[5], y[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(x[6], y[6], rel_tol=1e-9, abs_tol=1e-9)
    for a in (None, "ax1", "rare of no text"):
        assert math.isclose(sum(p(a, w)[1] for w in [*c, "never"]), 1, rel_tol=1e-9)


def test_where_counts_are_looked_up_changes_nothing(spark):
    df = spark.createDataFrame(texts(), DOCS).repartition(3, "doc_id")
    one, two = (rows(brown.score_texts(df, k=6, top=20, hot=h, rounds=4)) for h in (24, 100_000))
    assert [x[:5] for x in one] == [x[:5] for x in two]
    assert np.allclose([x[5:] for x in one], [x[5:] for x in two], rtol=1e-9)


def test_exchange_finds_the_kinds(spark):
    df = spark.createDataFrame([(i, t) for i, t in texts(600) if i is not None], DOCS)
    scores = rows(brown.score_texts(df, k=8, top=73, hot=1000))
    out = [x for x in scores if x[1] and x[2] > 1]
    assert sum(x[6] for x in out) / sum(x[2] for x in out) > sum(x[5] for x in out) / sum(x[2] for x in out) + 0.5


def test_gains_are_differences_of_the_likelihood():
    rnd = np.random.default_rng(3)
    k = 5
    follow = rnd.integers(0, 30, (k + 1, k + 1)).astype(float)
    # a word of class 2 that stands beside words of other classes only
    left, right = np.array([[3.0, 0, 0, 2, 1, 1]]), np.array([[0, 4.0, 0, 0, 2, 1]])
    follow[:, 2] += left[0]
    follow[2, :] += right[0]
    gone = follow.copy()
    gone[:, 2] -= left[0]
    gone[2, :] -= right[0]
    got = brown.gains(follow, left, right, np.array([2]))[0]
    for b in range(k):
        if left[0][b] or right[0][b]:
            continue
        there = gone.copy()
        there[:, b] += left[0]
        there[b, :] += right[0]
        assert math.isclose(got[b] - got[2], brown.likelihood(there) - brown.likelihood(follow), abs_tol=1e-9)


def test_nothing_to_learn_from(spark):
    assert rows(brown.score_texts(spark.createDataFrame([], DOCS))) == []
    out = next(i for i in range(100) if held(i))
    got = rows(brown.score_texts(spark.createDataFrame([(out, "a b"), (None, "c")], DOCS)))
    assert [x[1:] for x in got] == [(True, 3, 0, 0, 0.0, 0.0), (None, 2, 0, 0, 0.0, 0.0)]
    one = next(i for i in range(100) if not held(i))
    assert len(rows(brown.score_texts(spark.createDataFrame([(one, None)], DOCS)))) == 1
