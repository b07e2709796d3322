"""Ranked lexical search: the terms of all items as one Aho-Corasick automaton that reads the documents.

No index of the documents is built. Terms are the pattern's words between two boundary marks;
the automaton over them goes to every task, texts go through it byte by byte, and each hit
names a term, which names its items. One scan counts how many documents hold each term, the
next adds up scores and keeps what may still be among the best of an item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitals.llm.textkernel import ALNUM_WORDS, LOWER, chunks, flat

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 20
#: Pairs of an item and a term in one automaton; items beyond that go through the documents in further blocks.
BLOCK_PAIRS = 100_000
#: Scores of documents by items that are held at once.
CELLS = 1 << 21
_MARK = "\0"
_TO_MARKS = bytes(np.where(ALNUM_WORDS, LOWER, 0).astype(np.uint8))


@dataclass
class Lexicon:
    """The automaton over the terms of a block of items, and the items of each term; its size is bounded by BLOCK_PAIRS, or one item."""

    automaton: ahocorasick.Automaton
    items: list  # ids
    entry: np.ndarray  # by term and one more: where its items begin in the next two
    item: np.ndarray
    times: np.ndarray

    @property
    def n_terms(self) -> int:
        return len(self.entry) - 1


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, times) of all items; rows with the same id are one item, those with a null id are left out."""
    lower = F.translate(F.col(text_col).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))
    return items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), words.alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def lexicon(pairs: list[tuple]) -> Lexicon:
    """The automaton of (item, term, times) rows."""
    items = sorted({p[0] for p in pairs})
    terms = sorted({p[1] for p in pairs})
    of_item, of_term = {x: i for i, x in enumerate(items)}, {x: i for i, x in enumerate(terms)}
    rows = np.array([(of_term[t], of_item[i], n) for i, t, n in pairs], np.int64).reshape(-1, 3)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, t in enumerate(terms):
        # bytes as characters, so that a hit ends at a byte
        automaton.add_word(_MARK + t.encode().decode("latin-1") + _MARK, k)
    automaton.make_automaton()
    return Lexicon(automaton, items, np.searchsorted(rows[:, 0], np.arange(len(terms) + 1)), rows[:, 1].copy(), rows[:, 2].copy())


def scan(texts: pa.Array, automaton: ahocorasick.Automaton) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of the automaton's terms in a chunk, sorted, and the number of all terms of each row."""
    raw, offsets = flat(texts)
    n = len(offsets) - 1
    marked = np.zeros(len(raw) + n + 1, np.uint8)
    marked[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = raw
    data = marked.tobytes().translate(_TO_MARKS)
    inside = np.frombuffer(data, np.uint8) > 0
    begin = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    edges = offsets + np.arange(n + 1)  # the mark before each row
    n_terms = np.diff(np.searchsorted(begin, edges))
    # each hit is the place of its last mark and the number of its term
    hits = np.fromiter(chain.from_iterable(automaton.iter(data.decode("latin-1"))), np.int64).reshape(-1, 2)
    row = np.searchsorted(edges, hits[:, 0], "left") - 1
    code, tf = np.unique((row << 32) | hits[:, 1], return_counts=True)
    return code >> 32, code & 0xFFFFFFFF, tf, n_terms


def statistics(docs: DataFrame, lex: Lexicon) -> tuple[np.ndarray, int, int]:
    """df of each term, N and L over all documents (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        counts = np.zeros(lex.n_terms + 2, np.int64)  # the last two: N and L
        for chunk in chunks(batches, "text"):
            _, term, _, n = scan(chunk["text"], lex.automaton)
            counts[:-2] += np.bincount(term, minlength=lex.n_terms)
            counts[-2:] += int((n > 0).sum()), int(n.sum())
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["term", "n"])

    out = np.zeros(lex.n_terms + 2, np.int64)
    for r in docs.select("text").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row per term of the block
        out[r["term"]] = r["n"]
    return out[:-2], int(out[-2]), int(out[-1])


class _Best:
    """The best rows of each item so far, ties by smaller id, null ids last."""

    def __init__(self, n_items: int, best: int):
        self.best, self.least = best, np.ones(n_items, np.int64)
        self.kept = [np.empty(0, np.int64) for _ in range(3)] + [np.empty(0, bool)]
        self.new: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, gone: np.ndarray) -> None:
        """scores: documents by items."""
        d, i = np.nonzero(scores >= self.least)
        if len(d):
            self.new.append((i, scores[d, i], ids[d], gone[d]))
            self.waiting += len(d)
        if self.waiting > max(1 << 14, 2 * self.best * len(self.least)):
            self.cut()

    def cut(self) -> None:
        if not self.new:
            return
        columns = [np.concatenate(x) for x in zip(self.kept, *self.new, strict=True)]
        item, score, ids, gone = columns
        order = np.lexsort((ids, gone, -score, item))
        first = np.searchsorted(item[order], np.arange(len(self.least)))
        rank = np.arange(len(item)) - first[item[order]]
        self.kept = [x[order[rank < self.best]] for x in columns]
        full = order[rank == self.best - 1]
        self.least[item[full]] = score[full]
        self.new, self.waiting = [], 0


def best_by_task(docs: DataFrame, lex: Lexicon, df: np.ndarray, n: int, length: int, best: int, id_type) -> DataFrame:
    """(item_id, doc_id, score): of each task the best documents of each item."""
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((lex, weights))
    kind = pa.string() if id_type.typeName() == "string" else pa.int64()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, weights = shared.value
        some = len(lex.items)
        found = _Best(some, best)
        for chunk in chunks(batches, "text"):
            row, term, tf, terms = scan(chunk["text"], lex.automaton)
            m = 75 + (25 * terms * n) // length
            part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
            gone = chunk["doc_id"].is_null().to_numpy(zero_copy_only=False)
            ids = chunk["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            step = max(1, CELLS // some)
            for a in range(0, chunk.num_rows, step):
                b = min(a + step, chunk.num_rows)
                x, y = np.searchsorted(row, [a, b])
                size = lex.entry[term[x:y] + 1] - lex.entry[term[x:y]]
                of = np.repeat(np.arange(x, y), size)
                at = np.repeat(lex.entry[term[x:y]] - (np.cumsum(size) - size), size) + np.arange(len(of))
                cell = (row[of] - a) * some + lex.item[at]
                value = part[of] * lex.times[at]
                # doubles hold sums of either half exactly
                scores = sum(np.bincount(cell, v.astype(np.float64), minlength=(b - a) * some).astype(np.int64) << s for v, s in ((value >> 24, 24), (value & 0xFFFFFF, 0)))
                found.add(scores.reshape(b - a, some), ids[a:b], gone[a:b])
        found.cut()
        item, score, ids, gone = found.kept
        yield pa.RecordBatch.from_arrays([pa.array([lex.items[i] for i in item.tolist()], kind), pa.array(ids, mask=gone), pa.array(score)], names=["item_id", "doc_id", "score"])

    return docs.mapInArrow(work, f"item_id {'string' if kind == pa.string() else 'long'}, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, best: int = BEST, block_pairs: int = BLOCK_PAIRS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The `best` documents of each item: item_id, rank (from 1), doc_id, score.

    Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A score adds
    up, over an item's terms with repeats, weights that fall with the number of documents
    that hold the term, times a measure that grows with its count in the document and shrinks
    with the document's length; all in 64-bit integers. Documents with a score of 0 are left
    out, so an item may have fewer rows, or none. Equal scores go by ascending doc_id, null
    ids last.

    Items are dealt in blocks of about block_pairs pairs of an item and a term (an item with
    more is a block of its own), each block reads all documents twice. Each task holds the
    best of each item of a block only, and the best of all tasks meet in two steps.

    Null or empty texts have no term: such a document counts nowhere, such an item has no
    row. A very long text is a chunk of its own, as memory goes. Repeated rows of documents
    are documents each; rows of items with one id are one item, those with a null id are left
    out. Other columns are left out; empty tables give an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    terms = item_terms(items, item_col, item_text)
    id_type = terms.schema["item_id"].dataType
    total = terms.count()
    blocks = max(1, -(-total // block_pairs))
    out = None
    for k in range(blocks if total else 0):
        own = terms if blocks == 1 else terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        pairs = [tuple(r) for r in own.collect()]  # about block_pairs rows
        if not pairs:
            continue
        lex = lexicon(pairs)
        df, n, length = statistics(docs, lex)
        if n:
            rows = best_by_task(docs, lex, df, n, length, best, id_type)
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"item_id {'string' if id_type.typeName() == 'string' else 'long'}, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = out.withColumn("_part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
    first = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("item_id", "_part").orderBy(*order))).where(F.col("_rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.select("item_id", "rank", "doc_id", "score")


def ranked_search_sql(best: int = BEST) -> str:
    """The same in DuckDB."""
    words = f"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}'))"
    return f"""
        WITH q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {words} AS term FROM benchmark) GROUP BY ALL),
        t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {words} AS term FROM documents) GROUP BY ALL),
        d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY ALL),
        c AS (SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS l FROM d),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(c.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term),
        m AS (SELECT doc_id, 75 + (25 * d.n * c.n) // c.l AS m FROM d, c),
        s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
        r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM r WHERE rank <= {best}"""
