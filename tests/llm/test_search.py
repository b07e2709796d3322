"""Spelling variants and ranked search against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from vitals.llm import ranked_search, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelled(docs, every=97, length=5, count=3):
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    words = {w: k for w, k in n.items() if len(w) >= length and k >= count}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w in words:
        r = w
        while r in form:
            r = form[r]
        out.append((w, form.get(w), r, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_of_every_kind(spark):
    base = "station auction señores élevage Straße aaaaa aaaaaa aaaaaaa baaaaaaa planet planets plane lanet xlanet plxnet planex planetx plannet"
    docs = [(k, f"{base} x{base}x, {base.upper()}!\n{base[: 7 * k]}") for k in range(12)]
    docs += [(100, None), (101, ""), (102, "1234 -- ??"), (None, base), (5, "÷×÷×÷ repeated id"), (5, "÷×÷×÷ ÷×÷×÷")]
    assert found(spelling.spelling_variants(spark.createDataFrame(docs, DOCS))) == spelled(docs)
    assert found(spelling.spelling_variants(spark.createDataFrame(docs, DOCS), every=3, count=2)) == spelled(docs, 3, count=2)


def test_words_that_are_very_long_or_that_nest(spark):
    long = "ab" * 3000
    words = [long, long[:-1], "x" + long, long + "y", long[:2000] + "q" + long[2001:]] + ["a" * k for k in range(5, 70)]
    docs = [(k, " ".join(words)) for k in range(3)]
    got = found(spelling.spelling_variants(spark.createDataFrame(docs, DOCS), every=10**9))
    assert got == spelled(docs, 10**9)


def test_a_hot_node_is_dealt_in_parts(spark, monkeypatch):
    from vitals.llm import tables

    monkeypatch.setattr(tables, "LEAST", 20)
    words = [a + b + c + "ing" for a in "bcdfg" for b in "aeiou" for c in "lmnr"]
    docs = [(k, " ".join(words)) for k in range(3)]
    assert found(spelling.spelling_variants(spark.createDataFrame(docs, DOCS))) == spelled(docs)


def test_no_words(spark):
    assert found(spelling.spelling_variants(spark.createDataFrame([], DOCS))) == []
    assert found(spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "one two three")], DOCS))) == []


def ranked(docs, items, best=20):
    term = re.compile(ranked_search.TERM)
    terms = [Counter(term.findall((t or "").translate(LOWER))) for _, t in docs]
    n, length = sum(1 for t in terms if t), sum(sum(t.values()) for t in terms)
    df = Counter(w for t in terms for w in t)
    wanted = defaultdict(Counter)
    for i, t in items:
        if i is not None:
            wanted[i].update(term.findall((t or "").translate(LOWER)))
    out = []
    for i, words in wanted.items():
        rows = []
        for (d, _), t in zip(docs, terms, strict=True):
            m = 75 + 25 * sum(t.values()) * n // length if length else 0
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * t[w] // (1000 * t[w] + 12 * m)) for w, k in words.items() if w in t)
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if gone else d, -s) for r, (s, gone, d) in enumerate(sorted(rows)[:best])]
    return sorted(out, key=str)


def searched(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


SOME = [(k, f"Alpha beta-{k % 7} gamma{k % 3} {'delta ' * (k % 5)}ünï {'x' * k}") for k in range(60)]
SOME += [(70, None), (71, ""), (72, "--- \0 \0"), (None, "alpha beta rare"), (3, SOME[3][1]), (3, "rare RARE rare"), (80, "beta " * 20_000 + "rare")]
ITEMS = [(1, "alpha beta beta"), (2, "RARE ünï"), (3, None), (4, "nowhere"), (5, "delta gamma1 0"), (5, "x"), (None, "alpha"), (6, "alphabeta lpha")]


@pytest.mark.parametrize("pairs", [100_000, 2])
def test_ranks_are_those_of_brute_force(spark, pairs):
    docs, items = spark.createDataFrame(SOME, DOCS).withColumnRenamed("text", "text"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for best in (20, 2):
        assert searched(ranked_search.ranked_search(docs, items, best, pairs)) == ranked(SOME, ITEMS, best)


def test_small_blocks_of_scores_change_nothing(spark, monkeypatch):
    docs, items = spark.createDataFrame(SOME, DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(ranked_search, "CELLS", 8)
    assert searched(ranked_search.ranked_search(docs.coalesce(1), items)) == ranked(SOME, ITEMS)


def test_items_or_documents_without_terms(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert searched(ranked_search.ranked_search(docs, items)) == []
    assert searched(ranked_search.ranked_search(spark.createDataFrame(SOME, DOCS), items.where("item_id = 3"))) == []
    named = items.select(items["item_id"].cast("string"), "text")
    assert [r[0] for r in searched(ranked_search.ranked_search(spark.createDataFrame(SOME, DOCS), named, 1))] == ["1", "2", "5"]
