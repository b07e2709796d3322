"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and the first four to six bytes of longer words (lower-cased), so that
forms of a stem which no example holds still match. A bounded sample of labelled rows is the
index, with every term it has: for each the examples that hold it, in blocks with their
largest weight. Document frequencies are counted over all documents; a term that stands n
times in a text counts 1 + ln n, so that no text is its commonest words. Each document takes
its k nearest examples; their labels vote, weighted by cosine. k, and what a vote is worth,
are learnt from the votes that the examples get from one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.llm.tables import saved
from vitals.llm.textkernel import ALNUM_WORDS, Words, chunks, distinct, mix, signed

#: Examples per class in the index at most.
EXAMPLES = 1024
#: Distinct terms of an example at most; longer texts are scored, but not learnt from.
EXAMPLE_TERMS = 8192
#: Neighbours that vote, by default, and those that the examples choose from.
NEIGHBOURS, CHOICES = 16, (8, 16, 32, 64)
#: Weight of the prior against the neighbours' cosines.
PRIOR_WEIGHT = 1.5
BLOCK = 64
SKETCH = 8
#: Terms held as rows with a place for every example, at most; the share of the examples that such a term stands in.
DENSE, OFTEN = 4096, 1 / 64
#: Documents whose common terms are multiplied at once.
ROWS = 64


def fold(id_col: Column, folds: int) -> Column:
    """The fold of a row: crc32 of its id as text."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def chunk_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct (row, term) of a chunk, sorted, how often each comes, and the number of rows."""
    w = Words(texts, ALNUM_WORDS)
    doc, terms = [w.doc], [w.hash]
    size = w.end - w.start
    for n in (4, 5, 6):
        longer = size > n
        doc.append(w.doc[longer])
        terms.append(mix(w.hashed(w.start[longer], w.start[longer] + n), n))
    d, t = np.concatenate(doc), np.concatenate(terms)
    order = np.lexsort((t, d))
    d, t = d[order], t[order]
    first = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))) if len(d) else np.empty(0, np.int64)
    return d[first], t[first], np.diff(np.append(first, len(d))), w.n_docs


def sample_terms(rows: DataFrame) -> DataFrame:
    """(label, doc_id, terms, counts, sketch) of labelled rows; the sketch is the SKETCH smallest hashes of five words in a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            d, t, c, n = chunk_terms(chunk["text"])
            offsets = np.searchsorted(d, np.arange(n + 1)).astype(np.int32)
            w = Words(chunk["text"])
            h, at = w.ngrams(5)
            sd, sh = distinct(w.doc[at], h)
            cuts = np.searchsorted(sd, np.arange(n + 1))
            sketch = [signed(sh[a : min(b, a + SKETCH)]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [chunk["doc_id"], chunk["label"], *(pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (signed(t), c.astype(np.int32))), pa.array(sketch, pa.list_(pa.int64()))], names=["doc_id", "label", "terms", "counts", "sketch"]
            )

    return rows.select("doc_id", "label", "text").mapInArrow(work, "doc_id long, label int, terms array<bigint>, counts array<int>, sketch array<bigint>")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> DataFrame:
    """Rows to learn from: labelled, outside the held-out fold, of each class the `per_class` smallest hashes of ids.

    The smallest are found per class by a top-k, which each task cuts to `per_class` rows of
    (id, label) before anything moves; texts of the chosen rows alone are read on. A row whose
    label is null, or whose id is labelled both ways, is not learnt from.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    known = known.where(fold(F.col("doc_id"), folds) != held).withColumn("order", F.xxhash64("doc_id"))
    picked = None
    for y in (0, 1):
        one = known.where(F.col("label") == y).orderBy("order", "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    # at most twice per_class rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(picked.select("doc_id", "label")), "doc_id")


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges in a row, and the range of each."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(which)), which


@dataclass
class Index:
    """The fitted examples: everything that a scoring task needs, of bounded size."""

    vocabulary: np.ndarray  # sorted term hashes
    idf: np.ndarray
    example: np.ndarray  # postings by term, then example
    weight: np.ndarray  # of each posting; those of an example have length 1
    entry: np.ndarray  # by term and one more: where its blocks begin in the next four
    block: np.ndarray  # blocks of BLOCK examples in which a term stands
    top: np.ndarray  # its largest weight there
    begin: np.ndarray  # and its postings
    end: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    prior: float
    drawn: float | None = None  # how common label 1 was among the rows drawn, before any were left out
    curve: tuple[float, float] | None = None  # slope and intercept from votes to chances
    k: int = NEIGHBOURS  # how many vote
    common: np.ndarray | None = None  # the row of each term in the next, or -1
    dense: np.ndarray | None = None  # weights of the commonest terms, an example in each column

    def __post_init__(self) -> None:
        self.lists = np.append(self.begin, len(self.example))[self.entry]  # by term and one more: where its postings begin


def inverted(rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> tuple[np.ndarray, ...]:
    """example, weight, entry, block, top, begin, end of an index over rows of (terms, weights)."""
    term = np.concatenate([t for t, _ in rows]) if rows else np.empty(0, np.int64)
    weight = np.concatenate([w for _, w in rows]) if rows else np.empty(0)
    example = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows]).astype(np.int64)
    order = np.lexsort((example, term))
    term, weight, example = term[order], weight[order], example[order]
    if not len(term):
        return example, weight, np.zeros(n_terms + 1, np.int64), *(np.empty(0, np.int64),), np.empty(0), *(np.empty(0, np.int64),) * 2
    of = example // BLOCK
    begin = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (of[1:] != of[:-1])))
    end = np.append(begin[1:], len(term))
    return example, weight, np.searchsorted(term[begin], np.arange(n_terms + 1)), of[begin], np.maximum.reduceat(weight, begin), begin, end


def with_dense(index: Index) -> Index:
    """index with the lists of its commonest terms as rows too: they would fill nearly every block, so a product is faster than opening them."""
    held = index.lists[1:] - index.lists[:-1]
    often = np.flatnonzero(held > OFTEN * len(index.ids))
    often = np.sort(often[np.argsort(-held[often], kind="stable")[:DENSE]])
    index.common = np.full(len(held), -1)
    index.common[often] = np.arange(len(often))
    index.dense = np.zeros((len(often), len(index.ids)))
    posting, row = _ranges(index.lists[often], index.lists[often + 1])
    index.dense[row, index.example[posting]] = index.weight[posting]
    return index


def common_part(index: Index, row: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """What the common terms add to the cosine of each of n rows with each example."""
    q = counts * index.idf[terms]
    q = q / np.sqrt(np.bincount(row, q * q, minlength=n))[row]
    at = index.common[terms]
    some = at >= 0
    wide = np.zeros((n, len(index.dense)))
    wide[row[some], at[some]] = q[some]
    return wide @ index.dense


def no_near_copies(sketches: list[np.ndarray]) -> np.ndarray:
    """Numbers of the examples left when one that shares half of its sketch with an earlier one goes.

    Copies of a text in the sample would make its chance words look like signs of a class.
    """
    owner: dict[int, int] = {}
    left = []
    for i, t in enumerate(sketches):
        least = t.tolist()
        seen = [owner[x] for x in least if x in owner]
        if seen and 2 * max(seen.count(o) for o in set(seen)) >= len(least):
            continue
        left.append(i)
        for x in least:
            owner.setdefault(x, i)
    return np.array(left, np.int64)


def damped(counts: np.ndarray) -> np.ndarray:
    """What a term counts that stands so often in a text."""
    return 1 + np.log(counts)


def looked_up(vocabulary: np.ndarray, doc: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (doc, term) pairs those in the vocabulary, terms as numbers."""
    if not len(vocabulary) or not len(terms):
        return doc[:0], np.empty(0, np.int64)
    t = signed(terms)
    at = np.minimum(np.searchsorted(vocabulary, t), len(vocabulary) - 1)
    hit = vocabulary[at] == t
    return doc[hit], at[hit]


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many documents of all each term stands, and the number of documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(vocabulary) + 1, np.int64)
        for chunk in chunks(batches, "text"):
            d, t, _, n = chunk_terms(chunk["text"])
            _, at = looked_up(vocabulary, d, t)
            counts[:-1] += np.bincount(at, minlength=len(vocabulary))
            counts[-1] += n
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen])], names=["term", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text"))
    df = np.zeros(len(vocabulary) + 1, np.int64)
    found = rows.mapInArrow(work, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # one row per term of the vocabulary
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    return df[:-1], int(df[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, per_class: int = EXAMPLES) -> Index:
    """Learn the index from a bounded sample; document frequencies cover all documents.

    The driver gets at most EXAMPLE_TERMS numbers of each example, whatever the texts' length.
    """
    sample = sample_terms(labelled_sample(docs, labels, label, folds, held, per_class)).where(F.size("terms") <= EXAMPLE_TERMS)
    sample = saved(sample.dropDuplicates(["doc_id"]))
    drawn_rows = sample.select("doc_id", "label", "sketch").toPandas().sort_values("doc_id", ignore_index=True)
    drawn = float((drawn_rows["label"] == 1).mean()) if len(drawn_rows) else None
    chosen = drawn_rows.iloc[no_near_copies([np.asarray(t, np.int64) for t in drawn_rows["sketch"]])]
    named = docs.sparkSession.createDataFrame([(int(i),) for i in chosen["doc_id"]], "doc_id long")
    kept = sample.join(F.broadcast(named), "doc_id")  # at most twice per_class ids
    vocabulary = np.sort(kept.select(F.explode("terms").alias("term")).distinct().toArrow()["term"].to_numpy())
    df, n = document_frequencies(docs, vocabulary)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.searchsorted(known.value, batch["terms"].flatten().to_numpy(zero_copy_only=False))
            ends = np.concatenate([[0], np.cumsum(batch["terms"].value_lengths().to_numpy(zero_copy_only=False))])
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), x) for x in (pa.array(numbers.astype(np.int32)), batch["counts"].flatten())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], *lists], names=["doc_id", "label", "terms", "counts"])

    rows = kept.select("doc_id", "label", "terms", "counts").mapInArrow(numbered, "doc_id long, label int, terms array<int>, counts array<int>").toArrow().combine_chunks().sort_by("doc_id")
    examples = [tuple(rows[c][i].values.to_numpy(zero_copy_only=False) for c in ("terms", "counts")) for i in range(rows.num_rows)]
    return build(vocabulary, df, n, examples, rows["label"].to_numpy().astype(np.int64), rows["doc_id"].to_numpy(), base_rate(labels, label, folds, held), drawn)


def build(vocabulary: np.ndarray, df: np.ndarray, n: int, examples: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, ids: np.ndarray, prior: float, drawn: float | None) -> Index:
    """The index over examples of (terms, counts), and the curve through the votes that each gets from the others.

    Of the CHOICES of k the one counts under which the curve gives the labels of the examples
    the largest likelihood, both classes as common as among all rows to learn from.
    """
    idf = np.log((n + 1) / (df + 1)) + 1
    # examples without a term can't be near anything; like examples share a block, so block maxima are tight
    some = np.array([i for i, (t, _) in enumerate(examples) if len(t)], np.int64)
    rows = [(t, damped(c) * idf[t]) for t, c in (examples[i] for i in some)]
    rows = [(t, w / np.linalg.norm(w)) for t, w in rows]
    main = np.array([t[np.argmax(w)] for t, w in rows], np.int64)
    order = np.lexsort((ids[some], main, y[some])) if len(some) else some
    index = Index(vocabulary, idf, *inverted([rows[i] for i in order], len(vocabulary)), y[some][order], ids[some][order], prior, drawn)
    if drawn is not None and 0 < drawn < 1:
        place = np.full(len(examples), -1)
        place[some[order]] = np.arange(len(order))
        with_dense(index)
        near = []
        for at in range(0, len(examples), ROWS):
            part = examples[at : at + ROWS]
            row = np.repeat(np.arange(len(part)), [len(t) for t, _ in part])
            start = common_part(index, row, *(np.concatenate(x) for x in ([t for t, _ in part], [damped(c) for _, c in part])), len(part))
            near += [nearest(index, t, damped(c), max(CHOICES), int(i), s) for (t, c), i, s in zip(part, place[at : at + ROWS], start, strict=True)]
        of_class = np.where(y == 1, prior / max((y == 1).sum(), 1), (1 - prior) / max((y == 0).sum(), 1)) * len(y)
        least = np.inf
        for k in CHOICES:
            votes = np.array([vote(index, i[:k], s[:k]) for i, s in near])
            curve = calibrate(votes, np.where(y == 1, 1, -1), of_class)
            p = np.clip(1 / (1 + np.exp(-np.clip(curve[0] * votes + curve[1], -60, 60))), 1e-12, 1 - 1e-12)
            loss = -float((of_class * np.log(np.where(y == 1, p, 1 - p))).sum())
            if loss < least:
                least, index.curve, index.k = loss, curve, k
        index.common = index.dense = None  # each worker makes its own
    return index


def calibrate(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through margins, by Newton steps on smoothed targets."""
    n1, n0 = weight[y > 0].sum(), weight[y <= 0].sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        m = np.array([[(h * margins * margins).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, [(g * margins).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def base_rate(labels: DataFrame, label: str, folds: int, held: int) -> float:
    """How common label 1 is among all rows to learn from, kept off 0 and 1."""
    y = F.col(label).cast("int")
    r = labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id").cast("long"), folds) != held)).agg(F.sum(y).alias("a"), F.count(F.lit(1)).alias("n")).first()
    return ((r["a"] or 0) + 1) / (r["n"] + 2)


def nearest(index: Index, terms: np.ndarray, counts: np.ndarray | int = 1, k: int = NEIGHBOURS, without: int = -1, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k examples of largest cosine above 0 to a document with these terms, each counted so much, ties by index order.

    Block maxima bound what any example of a block can reach. Blocks are opened in order of
    their bounds, a few at a time and then more, and those whose bound is below the k-th cosine
    found stay shut: exact, whatever is left out. `without` leaves one example out. start: what
    the common terms add to each cosine; then only the others are looked up. Cosines that
    differ by less than 1e-12 tie.
    """
    best_i, best_s = np.empty(0, np.int64), np.empty(0)
    if not len(terms):
        return best_i, best_s
    q = counts * index.idf[terms]
    q = q / np.linalg.norm(q)
    if start is not None:
        rare = index.common[terms] < 0
        terms, q = terms[rare], q[rare]
    entry, of = _ranges(index.entry[terms], index.entry[terms + 1])
    block, weight = index.block[entry], q[of]
    bound = np.bincount(block, weight * index.top[entry], minlength=-(-len(index.ids) // BLOCK))
    if start is not None:
        bound = bound + np.maximum.reduceat(start, np.arange(0, len(start), BLOCK))
    order = np.argsort(-bound, kind="stable")
    lists = index.lists
    at, step, least = 0, 1, 0.0
    if start is not None and len(start) > k:  # no cosine is below what the common terms make
        step, least = len(order), float(np.partition(start, -k - 1)[-k - 1])
    while at < len(order) and bound[order[at]] > 0:
        least = max(least, best_s[-1]) if len(best_s) == k else least
        take = order[at : at + step]
        take = take[bound[take] >= least - 1e-9]
        if not len(take):
            break
        opened = np.zeros(len(order), bool)
        opened[take] = True
        if 2 * len(take) > len(order):  # most are open: lists are read whole, and what isn't open put aside
            posting, of_term = _ranges(lists[terms], lists[terms + 1])
            s = np.bincount(index.example[posting], index.weight[posting] * q[of_term], minlength=len(index.ids))
            s = np.where(np.repeat(opened, BLOCK)[: len(s)], s, 0.0)
        else:
            e = opened[block]
            posting, of_entry = _ranges(index.begin[entry[e]], index.end[entry[e]])
            s = np.bincount(index.example[posting], index.weight[posting] * weight[e][of_entry], minlength=len(index.ids))
        if start is not None:
            s = s + np.where(np.repeat(opened, BLOCK)[: len(s)], start, 0.0)
        if without >= 0:
            s[without] = 0
        s = np.round(s, 12)
        hit = np.flatnonzero(s > 0)
        best_i, best_s = np.concatenate([best_i, hit]), np.concatenate([best_s, s[hit]])
        top = np.lexsort((best_i, -best_s))[:k]
        best_i, best_s = best_i[top], best_s[top]
        at, step = at + step, 4 * step
    return best_i, best_s


def vote(index: Index, best_i: np.ndarray, best_s: np.ndarray) -> float:
    """Votes weighted by cosine against the base rate.

    A class's votes count by its share of all rows to learn from over its share of those
    drawn, so the score doesn't follow how many of each class the index takes.
    """
    total = float(best_s.sum())
    toxic = float((best_s * (index.labels[best_i] == 1)).sum())
    if total and index.drawn is not None and 0 < index.drawn < 1:
        one, zero = toxic * index.prior / index.drawn, (total - toxic) * (1 - index.prior) / (1 - index.drawn)
        toxic = total * one / (one + zero)
    return (toxic + PRIOR_WEIGHT * index.prior) / (total + PRIOR_WEIGHT)


def chance(index: Index, votes: np.ndarray) -> np.ndarray:
    """Votes as chances of label 1."""
    if index.curve is None:
        return votes
    return 1 / (1 + np.exp(-np.clip(index.curve[0] * votes + index.curve[1], -60, 60)))


def score_toxicity(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), evidence (ids of the nearest examples), cosines.

    A null or empty text, or one without any term of an example, has no neighbour and
    scores by the vote that the base rate makes. A very long text is a chunk of its own.
    Repeated rows score alike; neighbours that tie come in order of the index; a null id stays
    null; other columns are left out; an empty table gives an empty table, and without labels
    of both classes every score is the base rate. The index goes to every task once; it has
    EXAMPLES texts of each class at most, and EXAMPLE_TERMS terms of each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if model.curve is not None and model.dense is None:
            with_dense(model)
        for chunk in chunks(batches, "text"):
            d, t, c, n = chunk_terms(chunk["text"])
            which, at = looked_up(model.vocabulary, np.arange(len(d)), t)
            d, c = d[which], c[which]
            cuts = np.searchsorted(d, np.arange(n + 1))
            scores, ids, cosines = np.full(n, vote(model, np.empty(0, np.int64), np.empty(0))), [[]] * n, [[]] * n
            c = damped(c)
            for first in range(0, n if model.common is not None else 0, ROWS):
                last = min(first + ROWS, n)
                part = slice(cuts[first], cuts[last])
                start = common_part(model, d[part] - first, at[part], c[part], last - first)
                for row in np.unique(d[part]).tolist():
                    own = slice(cuts[row], cuts[row + 1])
                    i, s = nearest(model, at[own], c[own], model.k, start=start[row - first])
                    scores[row] = vote(model, i, s)
                    ids[row], cosines[row] = model.ids[i].tolist(), s.tolist()
            yield pa.RecordBatch.from_arrays([chunk["doc_id"], pa.array(chance(model, scores)), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], names=["doc_id", "score", "evidence", "cosines"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, score double, evidence array<bigint>, cosines array<double>")
