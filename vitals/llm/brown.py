"""Language-model scores by Brown's class-based bigrams.

Words are counted over all texts to learn from. The most frequent are put into classes by
exchange: in rounds, a part of them at a time, each word goes to the class in which the
bigrams of classes are likeliest, given the classes of its neighbours. Every other word takes
the best class once, by the same measure. A text then has the probability that its words'
classes follow one another, times that of each word in its class, smoothed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.llm.tables import saved
from vitals.llm.textkernel import U, Words, chunks, groups, mix, signed
from vitals.llm.toxicity import fold

CLASSES = 64
#: Words that exchange classes, and that stand as contexts by their class; words whose counts every task knows.
TOP, HOT = 1 << 16, 1 << 19
#: Rounds of exchange, and parts of the words that take turns.
ROUNDS, PARTS = 12, 4
#: Weight of single words against classes.
SMOOTH = 0.05
#: Entries that a task holds before it sends them on; of one bucket of rarer words.
HELD, BUCKET = 1 << 21, 2_000_000
#: Rows in which the counts of one round's words travel.
SLICES = 32
END = int(signed(mix(np.zeros(1, U), 4242))[0])


@dataclass
class Model:
    """What a scoring task needs; bounded by HOT words and CLASSES squared."""

    hashes: np.ndarray  # of the hot words, sorted
    rank: np.ndarray  # of each of these, by falling count
    count: np.ndarray  # by rank
    tokens: int
    words: int
    classes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))  # by rank
    totals: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))  # tokens of each class
    follow: np.ndarray = field(default_factory=lambda: np.ones((1, 1)))  # by context, with a last row for rarer words; by class, with a last column for words never seen
    top: int = TOP
    smooth: float = SMOOTH

    @property
    def n_classes(self) -> int:
        return len(self.totals)

    def contexts(self) -> np.ndarray:
        """The context of a word by rank; the last is that of words without one, so -1 finds it."""
        out = np.full(len(self.count) + 1, self.n_classes)
        n = min(self.top, len(self.count))
        out[:n] = self.classes[:n]
        return out


def chunk_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a chunk, each text followed by an end, and how many each text has."""
    w = Words(texts)
    n = w.counts + 1
    out = np.full(int(n.sum()), END, np.int64)
    last = np.cumsum(n) - 1
    words = np.ones(len(out), bool)
    words[last] = False
    out[words] = signed(w.hash)
    return out, n


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, n): each token of all texts (text), by its hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, n, new, waiting = np.empty(0, np.int64), np.empty(0, np.int64), [], 0
        for chunk in chunks(batches, "text"):
            new.append(np.unique(chunk_tokens(chunk["text"])[0], return_counts=True))
            waiting += len(new[-1][0])
            if waiting > HELD // 4:
                word, n = _merged([(word, n), *new])
                new, waiting = [], 0
                if len(word) > HELD // 2:
                    yield _counted(word, n)
                    word, n = word[:0], n[:0]
        yield _counted(*_merged([(word, n), *new]))

    return texts.select("text").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    word, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return word, np.bincount(which, np.concatenate([p[1] for p in parts]), minlength=len(word)).astype(np.int64)


def frequent(counts: DataFrame, hot: int) -> tuple[Model, int]:
    """The words that are frequent enough for at most `hot` to be so, and the count they need; ties are in or out together."""
    step = F.floor(F.log2("n") * 8).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least")).collect()  # a row for each eighth of a doubling
    steps.sort(key=lambda r: -r["step"])
    total, least = 0, max((r["least"] for r in steps), default=0) + 1
    for r in steps:
        total += r["words"]
        if total > hot:
            break
        least = r["least"]
    rows = counts.where(F.col("n") >= least).toPandas()
    word, n = rows["word"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    order = np.lexsort((word, -n))
    word, n = word[order], n[order]
    by_hash = np.argsort(word)
    return Model(word[by_hash], by_hash, n, sum(r["tokens"] for r in steps), sum(r["words"] for r in steps)), least


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """docs (uid, doc_id, held_out, text) with ids (ranks of its tokens, -1 for a word that isn't hot) and cold (hashes of those) for text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.hashes, model.rank))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rank = shared.value
        for chunk in chunks(batches, "text"):
            word, n = chunk_tokens(chunk["text"])
            ids = np.full(len(word), -1, np.int32)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, word), len(hashes) - 1)
                hit = hashes[at] == word
                ids[hit] = rank[at[hit]]
            cold = ids < 0
            ends = np.append(0, np.cumsum(n))
            lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v)) for o, v in ((ends, ids), (np.append(0, np.cumsum(cold))[ends], word[cold]))]
            yield pa.RecordBatch.from_arrays([chunk["uid"], chunk["doc_id"], chunk["held_out"], *lists], names=["uid", "doc_id", "held_out", "ids", "cold"])

    return docs.select("uid", "doc_id", "held_out", "text").mapInArrow(work, "uid long, doc_id long, held_out boolean, ids array<int>, cold array<bigint>")


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where each list ends."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))


def _pairs(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token of the batch and the one before it; texts begin after an end."""
    ids, ends = _flat(batch["ids"], np.int64)
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[np.append(0, ends[:-1])[np.diff(np.append(0, ends)) > 0]] = end
    return before, ids


# ---- exchange


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(follow: np.ndarray) -> float:
    """Log likelihood of the classes' bigrams, up to what no exchange changes."""
    return float(_f(follow).sum() - _f(follow.sum(0)).sum() - _f(follow.sum(1)).sum())


def gains(follow: np.ndarray, left: np.ndarray, right: np.ndarray, now: np.ndarray) -> np.ndarray:
    """What each class gains by each word (words by classes), the word taken out of its class now.

    follow: counts of class bigrams; left, right: how often each class stands before and after
    each word. Words beside words of their own class are counted as if these stayed.
    """
    k = follow.shape[0] - 1
    out = np.zeros((len(left), k))
    for table, own in ((follow, left), (follow.T, right)):
        f = _f(table)[:, :k]
        w, c = np.nonzero(own)
        v = own[w, c]
        for a in range(0, len(w), 1 << 14):
            b = slice(a, a + (1 << 14))
            x = table[c[b], :k]
            part = _f(x + v[b, None]) - f[c[b]]
            stay = now[w[b]]
            at = np.arange(len(part))
            part[at, stay] = f[c[b], stay] - _f(np.maximum(x[at, stay] - v[b], 0))
            heads = np.flatnonzero(np.append(True, w[b][1:] != w[b][:-1]))
            out[w[b][heads]] += np.add.reduceat(part, heads)
        n, total = own.sum(1)[:, None], table.sum(0)[None, :k]
        part = _f(total + n) - _f(total)
        at = np.arange(len(left))
        part[at, now] = _f(total[0, now]) - _f(np.maximum(total[0, now] - n[:, 0], 0))
        out -= part
    return out


def neighbour_counts(enc: DataFrame, contexts: np.ndarray, k: int, end: int, members: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(bucket, cells): how often each class stands before and after each member, in SLICES rows; and the counts of class bigrams.

    Each task adds up all its texts; its counts travel as arrays, so their number doesn't
    follow that of the texts.
    """
    size, wide = len(contexts), k + 1
    slot = np.full(size, -1, np.int64)
    slot[members] = np.arange(len(members))
    shared = enc.sparkSession.sparkContext.broadcast((contexts.astype(np.int64), slot))
    step = -(-max(len(members), 1) // SLICES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, slot = shared.value
        cells = np.zeros(SLICES * step * 2 * wide, np.int64)
        follow = np.zeros(wide * wide, np.int64)
        codes: list[np.ndarray] = []

        def add() -> None:
            if codes:
                np.add(cells, np.bincount(np.concatenate(codes), minlength=len(cells)), out=cells)
                codes.clear()

        for batch in batches:
            p, q = _pairs(batch, end)
            cp, cq = context[p], context[q]
            follow += np.bincount(cp * wide + cq, minlength=wide * wide)
            for word, other, side in ((q, cp, 0), (p, cq, wide)):
                s = slot[word]
                own = np.flatnonzero(s >= 0)
                codes.append(s[own] * (2 * wide) + side + other[own])
            if sum(map(len, codes)) > HELD:
                add()
        add()
        rows = [*cells.reshape(SLICES, -1), *follow.reshape(wide, wide)]
        for i, row in enumerate(rows):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row.astype(np.int32)], pa.list_(pa.int32()))], names=["bucket", "cells"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch["bucket"].to_pylist(), batch["cells"], strict=True):
                row = row.values.to_numpy(zero_copy_only=False)
                if i in sums:
                    sums[i] += row
                else:
                    sums[i] = row.astype(np.int64)
        for i, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row], pa.list_(pa.int64()))], names=["bucket", "cells"])

    out = saved(enc.select("ids").mapInArrow(count, "bucket int, cells array<int>").repartition("bucket").mapInArrow(total, "bucket int, cells array<bigint>"))
    follow = np.zeros((wide, wide))
    for r in out.where(F.col("bucket") >= SLICES).collect():  # a row for each class
        follow[r["bucket"] - SLICES] = r["cells"]
    return out.where(F.col("bucket") < SLICES), follow


def exchanged(enc: DataFrame, model: Model, rounds: int, parts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the top words by exchange, and the counts of class bigrams (with a last class for all other words).

    In each round one part of the words moves, so that most neighbours stay as they were
    counted; the classes of the likeliest round are kept.
    """
    top = min(model.top, len(model.count))
    classes = np.arange(top) % k
    part = (np.arange(top) // k) % parts
    end = _end(model)
    best = None
    for r in range(rounds + 1):
        members = np.flatnonzero(part == r % parts)
        contexts = np.append(np.full(len(model.count), k), k)
        contexts[:top] = classes
        cells, follow = neighbour_counts(enc, contexts, k, end, members)
        now = likelihood(follow)
        if best is None or now > best[0]:
            best = (now, classes.copy(), follow)
        if r == rounds or not len(members):
            break
        step = -(-len(members) // SLICES)
        shared = enc.sparkSession.sparkContext.broadcast((follow, classes[members]))

        def move(batches: Iterator[pa.RecordBatch], shared=shared, step=step, n=len(members)) -> Iterator[pa.RecordBatch]:
            follow, now = shared.value
            for batch in batches:
                for i, row in zip(batch["bucket"].to_pylist(), batch["cells"], strict=True):
                    at = np.arange(i * step, min((i + 1) * step, n))
                    if len(at):
                        x = row.values.to_numpy(zero_copy_only=False).reshape(step, -1)[: len(at)].astype(float)
                        to = gains(follow, x[:, : k + 1], x[:, k + 1 :], now[at]).argmax(1)
                        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(to)], names=["member", "class"])

        for x in cells.mapInArrow(move, "member long, class long").collect():  # a part of the top words
            classes[members[x["member"]]] = x["class"]
    return best[1], best[2]


def _end(model: Model) -> int:
    """The rank of the end token; -1 if nothing was learnt."""
    at = int(np.searchsorted(model.hashes, END))
    return int(model.rank[at]) if at < len(model.hashes) and model.hashes[at] == END else -1


# ---- rarer words


def rarer_words(enc: DataFrame, model: Model, classes: np.ndarray, follow: np.ndarray, k: int) -> DataFrame:
    """(word, class, n) of all words beyond the top ones, each in the class that gains most by it; and how these classes follow contexts.

    Rows with class -1 say how often (n) class or column word % (k + 1) follows context
    word // (k + 1), where column k is that of words seen once. Where a word stands is
    dealt by word in buckets whose number follows the words; the gain is that of one
    occurrence, times their number.
    """
    top = min(model.top, len(model.count))
    contexts = np.append(np.full(len(model.count), k), k)
    contexts[:top] = classes
    by_rank = np.empty(len(model.hashes), np.int64)
    by_rank[model.rank] = model.hashes
    end = _end(model)
    tail = model.tokens - int(model.count[:top].sum())
    buckets = max(1, -(-tail // BUCKET))
    wide = k + 1
    one = _f(follow + 1) - _f(follow)
    size = np.log(np.maximum(follow.sum(0), 1))[:k], np.log(np.maximum(follow.sum(1), 1))[:k]
    shared = enc.sparkSession.sparkContext.broadcast((contexts.astype(np.int64), by_rank, one[:, :k].astype(np.float32), one.T[:, :k].astype(np.float32), (size[0] + size[1] + 2).astype(np.float32)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, by_rank, *_ = shared.value
        held: list[list[np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            word, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            word, place, n = _places(word, place, np.ones(len(word), np.int64), wide * wide)
            of = (mix(word.view(U), 9) % U(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
            ends = pa.array(np.append(cuts, len(order)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (word, place.astype(np.int16 if wide * wide < 1 << 15 else np.int32), n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(of[order][cuts]), *lists], names=["bucket", "word", "place", "n"])

        for batch in batches:
            p, q = _pairs(batch, end)
            nxt = np.append(q[1:], -1)
            cold, _ = _flat(batch["cold"], np.int64)
            word = np.empty(len(q), np.int64)
            word[q < 0], word[q >= 0] = cold, by_rank[q[q >= 0]]
            rare = np.flatnonzero((q < 0) | (q >= top))  # a text ends with an end, so something follows
            held.append([word[rare], context[p[rare]] * wide + context[nxt[rare]]])
            if sum(len(x[0]) for x in held) > HELD:
                yield from out()
        if held and sum(len(x[0]) for x in held):
            yield from out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, before, after, size = shared.value
        seen = np.zeros((wide, wide), np.int64)
        for bucket in groups(batches, ["bucket"]):
            word, place, n = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            for x in bucket.to_batches():
                new = [_flat(x[c], np.int64)[0] for c in ("word", "place", "n")]
                word, place, n = (np.concatenate(y) for y in zip((word, place, n), new, strict=True))
                if len(word) > 2 * BUCKET:
                    word, place, n = _places(word, place, n, wide * wide)
            word, place, n = _places(word, place, n, wide * wide)
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.empty(0, np.int64)
            many = np.add.reduceat(n, heads) if len(heads) else n
            best = np.empty(len(heads), np.int64)
            for a in range(0, len(heads), 1 << 12):
                own = heads[a : a + (1 << 12)]
                lo, hi = own[0], heads[a + (1 << 12)] if a + (1 << 12) < len(heads) else len(word)
                x = (before[place[lo:hi] // wide] + after[place[lo:hi] % wide]) * n[lo:hi, None].astype(np.float32)
                best[a : a + len(own)] = (np.add.reduceat(x, own - lo) - many[a : a + len(own), None] * size).argmax(1)
            of = np.repeat(best, np.diff(np.append(heads, len(word))))
            once = np.repeat(many == 1, np.diff(np.append(heads, len(word))))
            np.add.at(seen, (place // wide, of), n)
            np.add.at(seen, (place[once] // wide, np.full(int(once.sum()), k)), 1)
            yield pa.RecordBatch.from_arrays([pa.array(word[heads]), pa.array(best), pa.array(many)], names=["word", "class", "n"])
        a, b = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(a * wide + b), pa.array(np.full(len(a), -1)), pa.array(seen[a, b])], names=["word", "class", "n"])

    dealt = enc.select("ids", "cold").mapInArrow(deal, "bucket long, word array<bigint>, place array<smallint>, n array<int>" if wide * wide < 1 << 15 else "bucket long, word array<bigint>, place array<int>, n array<int>")
    return saved(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(choose, "word long, class long, n long"))


def _places(word: np.ndarray, place: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by word and place, those of the same put together."""
    words, which = np.unique(word, return_inverse=True)
    code, back = np.unique(which * size + place, return_inverse=True)
    return words[code // size] if len(words) else words, code % size, np.bincount(back, n, minlength=len(code)).astype(np.int64)


# ---- the model


def followed(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Chances of each class (and of a word never seen) after each context, smoothed by how many classes follow it."""
    whole = counts.sum(0)
    whole[-1] += 1
    whole[:-1][totals <= 0] = 0
    share = whole / whole.sum()
    kinds = np.maximum((counts > 0).sum(1, keepdims=True), 1)
    return (counts + kinds * share) / (counts.sum(1, keepdims=True) + kinds)


def fit(docs: DataFrame, k: int = CLASSES, top: int = TOP, hot: int = HOT, rounds: int = ROUNDS, parts: int = PARTS) -> tuple[Model, DataFrame, DataFrame]:
    """The model, learnt from docs (uid, doc_id, learn, held_out, text) where learn; (word, class, n) of rarer words; all docs encoded."""
    counts = saved(token_counts(docs.where("learn")))
    model, least = frequent(counts, hot)
    model.top = top
    enc = saved(encoded(docs, model))
    known = enc.where(F.col("held_out").isNotNull() & ~F.col("held_out"))
    classes, follow = exchanged(known, model, rounds, parts, k)
    rare = rarer_words(known, model, classes, follow, k)
    model.classes = np.zeros(len(model.count), np.int64)
    model.classes[: len(classes)] = classes
    if len(model.hashes) > len(classes):
        middle = rare.where((F.col("class") >= 0) & (F.col("n") >= least)).select("word", "class").toPandas()  # at most `hot` words
        model.classes[model.rank[np.searchsorted(model.hashes, middle["word"].to_numpy(np.int64))]] = middle["class"].to_numpy(np.int64)
    counted = np.zeros((k + 1, k + 1))
    counted[:, :k] = follow[:, :k]
    for r in rare.where("class < 0").groupBy("word").agg(F.sum("n").alias("n")).collect():  # classes squared
        counted[r["word"] // (k + 1), r["word"] % (k + 1)] += r["n"]
    totals = np.bincount(model.classes, model.count, minlength=k)[:k]
    for r in rare.where((F.col("class") >= 0) & (F.col("n") < least)).groupBy("class").agg(F.sum("n").alias("n")).collect():
        totals[r["class"]] += r["n"]
    model.totals = totals
    model.follow = followed(counted, totals)
    return model, rare.where((F.col("class") >= 0) & (F.col("n") < least)), enc


def chances(model: Model, context: np.ndarray, of: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of each token's base and model probability: its context, its class (-1 if never seen) and its count."""
    base = (n + 1) / (model.tokens + model.words + 1)
    seen = of >= 0
    word = np.where(seen, n / np.maximum(model.totals[of], 1), 1.0)
    return np.log10(base), np.log10((1 - model.smooth) * model.follow[context, np.where(seen, of, model.n_classes)] * word + model.smooth * base)


def scored(enc: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of encoded docs. Words that no task knows meet their counts in a join."""
    shared = enc.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        context, end = model.contexts(), _end(model)
        classes = np.append(model.classes, -1)
        count = np.append(model.count, 0)
        for batch in batches:
            p, q = _pairs(batch, end)
            _, ends = _flat(batch["ids"], np.int64)
            begin = np.append(0, ends[:-1])
            known = q >= 0
            base, score = chances(model, context[p], classes[q], count[q])
            cold, cold_ends = _flat(batch["cold"], np.int64)
            sums = [np.add.reduceat(np.where(known, x, 0), begin) for x in (base, score, known.astype(np.int64))] if len(ends) else [np.empty(0), np.empty(0), np.empty(0, np.int64)]
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, cold_ends).astype(np.int32)), pa.array(x)) for x in (cold, context[p][~known].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch["uid"], batch["doc_id"], batch["held_out"], pa.array(ends - begin), *(pa.array(x) for x in sums), *lists], names=["uid", "doc_id", "held_out", "n_tokens", "base", "score", "known", "cold", "context"])

    rows = saved(enc.mapInArrow(work, "uid long, doc_id long, held_out boolean, n_tokens long, base double, score double, known long, cold array<bigint>, context array<int>"))
    cold = rows.where(F.size("cold") > 0).select("uid", F.explode(F.arrays_zip("cold", "context")).alias("x")).groupBy("uid", F.col("x.cold").alias("word"), F.col("x.context").alias("context")).agg(F.count(F.lit(1)).alias("times"))
    met = cold.join(rare, "word", "left").select("uid", "context", "times", F.coalesce("class", F.lit(-1)).alias("class"), F.coalesce("n", F.lit(0)).alias("n"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            context, times, of, n = (batch[c].to_numpy(zero_copy_only=False) for c in ("context", "times", "class", "n"))
            base, score = chances(model, context, of, n)
            yield pa.RecordBatch.from_arrays([batch["uid"], pa.array(base * times), pa.array(score * times), pa.array(np.where(of >= 0, times, 0))], names=["uid", "more_base", "more_score", "more_known"])

    more = met.mapInArrow(rest, "uid long, more_base double, more_score double, more_known long").groupBy("uid").agg(*(F.sum(c).alias(c) for c in ("more_base", "more_score", "more_known")))
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return rows.join(more, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", add("known", "more_known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), add("base", "more_base").alias("base_score"), add("score", "more_score").alias("score")
    )


def score_texts(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words between blanks, A-Z lower-cased, and an end after each text. Texts
    whose crc32 of the id leaves `held` by `folds` are held out, the others learnt from.
    base_score adds up log10 of (c + 1) / (N + V + 1), where c is a token's count, N that of
    all and V that of different ones among those learnt from; score is the model's log10
    probability of the text. Both share out 1 among the V words and one that was never seen.

    The counts cover all texts to learn from. The TOP most frequent words get their classes
    by exchange, in rounds over all texts, every other word its class once; as contexts,
    these others stand in one class of their own. Words never seen are learnt from those seen
    once. Words are told by 64-bit hashes.

    A null or empty text is an end alone. A very long text is a chunk of its own. Repeated
    rows count and score each. A row with a null id is scored, with held_out null, and not
    learnt from. Other columns are left out; an empty table gives an empty table; with nothing
    to learn from, all scores are 0.
    """
    fold_of = fold(F.col(id_col).cast("long"), folds)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold_of != held, F.lit(False)).alias("learn"), (fold_of == held).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    model, rare, enc = fit(rows, **options)
    return scored(enc, model, rare)
