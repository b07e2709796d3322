"""Quality rules as weak supervision: rules vote or abstain, EM weighs them.

Each rule says good, bad or nothing about a text. Expectation-maximisation over the vote
patterns of all documents estimates how often each rule is right (the labels are latent),
and a document stays if the posterior probability that it is good is high enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.llm.tables import saved
from vitals.llm.textkernel import Words, chunks, distinct, flat, mix, signed

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Chances that a rule votes bad, abstains, votes good: on good texts, on bad texts; and their weight.
TRUST = ((0.002, 0.098, 0.9), (0.3, 0.2, 0.5))
PULL = 0.1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper_words", "n_lines")


def count_chunk(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""
    w = Words(texts, lower=False)
    n = w.n_docs
    data, offsets = w.data, w.offsets
    doc_of = lambda at: np.searchsorted(offsets, at, "right") - 1
    out = {"n_words": w.counts.astype(np.int64)}

    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out["word_chars"] = np.bincount(w.doc, heads[w.end] - heads[w.start], minlength=n).astype(np.int64)
    out["n_symbols"] = np.bincount(doc_of(np.flatnonzero(_SYMBOL[data])), minlength=n).astype(np.int64)

    # lines: a text of k newlines has k + 1; those without a word don't count
    breaks = np.flatnonzero(data == 10)
    begins = np.concatenate([offsets[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(n), doc_of(breaks)])
    order = np.lexsort((begins, line_doc))
    begins, line_doc = begins[order], line_doc[order]
    last = np.append(line_doc[1:] != line_doc[:-1], True) if len(begins) else np.empty(0, bool)
    ends = np.where(last, offsets[line_doc + 1], np.append(begins[1:], 0) - 1)
    worded = np.searchsorted(w.start, ends) > np.searchsorted(w.start, begins)
    begins, ends, line_doc = begins[worded], ends[worded], line_doc[worded]
    lines = _line_hashes(w, begins, ends)
    d, _ = distinct(line_doc, lines)
    total = np.bincount(line_doc, minlength=n)
    out["n_lines"] = total.astype(np.int64)
    out["n_dup_lines"] = (total - np.bincount(d, minlength=n)).astype(np.int64)

    d, _ = distinct(w.doc, w.hash)
    out["n_distinct_words"] = np.bincount(d, minlength=n).astype(np.int64)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    out["n_upper_words"] = np.bincount(w.doc[(upper[w.end] - upper[w.start]) >= 2], minlength=n).astype(np.int64)

    # words in windows of eight that come twice or more in the text
    h, at = w.ngrams(8)
    covered = np.zeros(len(w.hash) + 1, np.int64)
    if len(h):
        d = w.doc[at]
        order = np.lexsort((h, d))
        same = (h[order][1:] == h[order][:-1]) & (d[order][1:] == d[order][:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + 8, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(covered)[:-1] > 0], minlength=n).astype(np.int64)
    return out


def _line_hashes(w: Words, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of whole lines, blanks and all."""
    if not len(begins):
        return np.empty(0, np.uint64)
    return mix(w.hashed(begins, ends), 5) ^ (ends - begins).astype(np.uint64)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of COUNTS, one row per input row; a map without a shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            counts = count_chunk(chunk["text"])
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], *(pa.array(counts[c]) for c in COUNTS)], names=["doc_id", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    words, chars = F.col("n_words"), F.col("word_chars")

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")

    return {
        "length": rule(words < 20, words >= 50),
        "repeats": rule(100 * F.col("n_repeat_words") > 30 * words, 100 * F.col("n_repeat_words") <= 10 * words),
        "lines": rule(2 * F.col("n_dup_lines") > F.col("n_lines"), 10 * F.col("n_dup_lines") <= F.col("n_lines")),
        "symbols": rule(10 * F.col("n_symbols") > 3 * words, 100 * F.col("n_symbols") <= 5 * words),
        # a mark for every other word is another matter than some
        "marks": rule(10 * F.col("n_symbols") > 4 * words, 100 * F.col("n_symbols") <= 20 * words),
        "word_length": rule((chars < 2 * words) | (chars > 12 * words), (chars >= 3 * words) & (chars <= 9 * words)),
        "shouting": rule(2 * F.col("n_upper_words") > words, 20 * F.col("n_upper_words") <= words),
        # distinct words grow with the root of the length in long texts; both limits meet at 5,000 words
        "variety": rule((words >= 20) & (10 * F.col("n_distinct_words") < words) & (F.col("n_distinct_words") * F.col("n_distinct_words") < 50 * words), (10 * F.col("n_distinct_words") >= 3 * words)),
    }


def expectation_maximisation(patterns: np.ndarray, weights: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, dict]:
    """Posterior probability of good for each vote pattern, and the estimates.

    patterns: one row per pattern, one column per rule, of -1, 0, 1. weights: documents with
    the pattern. Rules are taken as independent given the latent label; each has its own
    chance of each vote under either label. Rules that measure like things would otherwise
    bend the labels to what they have in common, so the estimates start from, and are held
    near, TRUST: what rules do on good and bad texts, which counts as PULL of all documents.
    """
    if not len(patterns):
        return np.empty(0), {"prior": 0.5}
    votes_ = np.array([-1, 0, 1])
    one_hot = (patterns[:, :, None] == votes_).astype(float)
    weight = weights.astype(float)
    start = np.array(TRUST)
    pull = PULL * weight.sum() + 1
    good = np.where((patterns < 0).any(1), 0.1, 0.9)
    for _ in range(rounds):
        chance = []
        for q, held in zip((good, 1 - good), start, strict=True):
            c = np.einsum("p,prv->rv", weight * q, one_hot) + pull * held
            chance.append(c / c.sum(1, keepdims=True))
        prior = ((weight * good).sum() + 1) / (weight.sum() + 2)
        log = [np.einsum("prv,rv->p", one_hot, np.log(c)) for c in chance]
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + log[0] - log[1], -500, 500)))
        moved = float(np.abs(new - good).max())
        good = new
        if moved < 1e-9:
            break
    said = 1 - chance[0][:, 1] * prior - chance[1][:, 1] * (1 - prior)
    right = (chance[0][:, 2] * prior + chance[1][:, 0] * (1 - prior)) / np.maximum(said, 1e-12)
    return good, {"prior": prior, "accuracy": right}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, posterior, kept.

    Votes of all documents are counted by pattern (at most 3 to the number of rules, whatever
    the input), EM runs over these counts on the driver, and each document takes its pattern's
    posterior by a broadcast of that bounded table. Counts are saved once in the shared
    checkpoint folder, so texts are read once.

    A null or empty text has no words, so it fails the base; posterior is then still its
    pattern's. Repeated rows count as often as they stand and get equal results; a null id
    stays null; other columns are left out; an empty table gives an empty table.
    """
    counts = saved(text_counts(docs, id_col, text_col))
    rules = votes()
    voted = counts.withColumns(rules)
    seen = voted.groupBy(*rules).agg(F.count(F.lit(1)).alias("n")).orderBy(*rules).collect()
    posterior, _ = expectation_maximisation(np.array([[r[k] for k in rules] for r in seen]).reshape(len(seen), len(rules)), np.array([r["n"] for r in seen]))
    spark = docs.sparkSession
    table = spark.createDataFrame([(*(r[k] for k in rules), float(p)) for r, p in zip(seen, posterior, strict=True)], ", ".join(f"{k} int" for k in rules) + ", posterior double")
    return (
        voted.join(F.broadcast(table), list(rules))
        .withColumn("base_failed", base_failed())
        .select("doc_id", *COUNTS, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= keep_at)).alias("kept"))
    )


__all__ = ["COUNTS", "base_failed", "count_chunk", "expectation_maximisation", "quality_rules", "text_counts", "votes", "flat", "signed"]
