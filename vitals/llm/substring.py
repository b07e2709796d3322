"""Near-duplicate passages across documents by compact windows.

A text is its sequence of five-word shingles. Under one hash function, a Cartesian tree over
the hashes splits the text into compact windows: every run of shingles whose smallest hash
stands at place c, and which is t long or longer, lies in the window of c. Windows with the
same smallest hash in two documents are joined; where windows of enough hash functions cover
the same places, that is a candidate passage, and its shingles are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitals.llm.tables import saved, spread_join
from vitals.llm.textkernel import U, Words, chunks, flat, mix, powers, signed

#: Words of the shortest passage, words of a shingle.
PASSAGE, SHINGLE = 50, 5
#: Hash functions, and how many must agree on a place.
HASHES, ENOUGH = 4, 2
#: Places by which a passage may shift inside, as words are added or left out.
SHIFT = 16
SIMILARITY = 0.8
#: Lengths of runs of shingles around a smallest hash, and the step between the runs of a
#: length that are tied to their first holder. The first is the shortest passage: of that
#: every run, under as many hash functions as must agree.
RUNS = ((PASSAGE - SHINGLE + 1, 1), (32, 4), (23, 4), (12, 3), (1, 1))
#: Keys are dealt by their runs that one in HOT_SHARE of the sampled documents holds and HOT
#: of them at least, or that by the sample have HOT_ROWS windows: a task holds fewer of a key.
HOT, HOT_SHARE, HOT_ROWS, HOT_SAMPLE = 8, 100, 2_000_000, 64
#: Windows of such a key that the others are tied to before runs are rows of their own.
HEADS = 16
#: Shingles to which the ends of a source's slice are rounded.
ROUND = 64
#: Shingles beside a smallest hash, on each side, that a run may have.
FAR = PASSAGE - SHINGLE
_WIDE = (1 << 12) - 1
#: Marks links by a run of a passage's length: one hash function is enough for them.
WHOLE = 4


def _slide(x: np.ndarray, t: int, best: np.ufunc, pad: int) -> np.ndarray:
    """best of each t values in a row."""
    n = len(x)
    m = -(-n // t) * t
    y = np.full(m, U(pad))
    y[:n] = x
    y = y.reshape(-1, t)
    ahead = best.accumulate(y, axis=1).reshape(-1)
    back = best.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return best(back[: n - t + 1], ahead[t - 1 : n])


def compact_windows(h: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (left, place of the smallest, right), inclusive and t long or longer; a 0 in h ends a text.

    Of equal hashes the leftmost counts as the smallest. A place whose window has t places is
    the smallest of some t in a row; only such places are looked at, and a smaller hash that
    is t or more away from one is itself such a place, so the tree over them is enough.
    """
    n = len(h)
    if n < t:
        return (np.empty(0, np.int64),) * 3
    least = _slide(h, t, np.minimum, 0xFFFFFFFFFFFFFFFF)
    spread = np.concatenate([np.zeros(t - 1, U), least, np.zeros(t - 1, U)])
    q = np.flatnonzero(_slide(spread, t, np.maximum, 0) == h)
    values = h[q].tolist()
    left, right, stack = [-1] * len(q), [len(q)] * len(q), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        if stack:
            left[i] = stack[-1]
        stack.append(i)
    ends = np.concatenate([[-1], q, [n]])
    lo, hi = ends[np.array(left, np.int64) + 1], ends[np.array(right, np.int64) + 1]
    for side, step in ((lo, -1), (hi, 1)):  # smaller hashes nearer than t
        open_ = np.arange(len(q))
        for d in range(1, t):
            at = q[open_] + step * d
            inside = (at > side[open_]) if step < 0 else (at < side[open_])
            open_, at = open_[inside], at[inside]
            if not len(open_):
                break
            hit = h[at] <= h[q[open_]] if step < 0 else h[at] < h[q[open_]]
            side[open_[hit]] = at[hit]
            open_ = open_[~hit]
    wide = (hi - lo - 1 >= t) & (h[q] > 0)
    return lo[wide] + 1, q[wide], hi[wide] - 1


def _sequence(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, the text of each, the place in the text of each.

    Where a text goes round at a period shorter than a passage ('be be be') for a passage or
    longer, the number of the round is counted in, as every place would have a window of its own.
    """
    s, at = w.ngrams(SHINGLE)
    doc = w.doc[at]
    t = PASSAGE - SHINGLE + 1
    turn = np.zeros(len(s), np.int64)
    for p in range(1, t):
        same = np.concatenate([[False], (s[p:] == s[:-p]) & (doc[p:] == doc[:-p]), [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= t and not turn[a + p : b + p].any():  # places a to b + p - 1
                turn[a : b + p] = np.arange(b - a + p) // p
    with np.errstate(over="ignore"):
        return s + turn.astype(U) * U(0x9FB21C651E98DF25), doc, at - w.first[doc]


def _bits(s: np.ndarray) -> np.ndarray:
    """For each place one bit of its shingle and of the 63 after it, the nearest first."""
    x = mix(s, 77) & U(1)
    for k in (1, 2, 4, 8, 16, 32):
        x = (x << U(k)) | np.append(x[k:], np.zeros(min(k, len(x)), U))
    return x


def _far(s: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of some places 16 bits of each shingle that a run around it may have: those before it, the nearest first, then those after it; 0 beyond the text."""
    beside = np.arange(1, FAR + 1)
    near = at[:, None] + np.concatenate([-beside, beside])
    inside = np.clip(near, 0, len(s) - 1)
    small = (mix(s, 78) & U(0xFFFF)).astype("<u2")
    return np.where((near == inside) & (doc[inside] == doc[at][:, None]), small[inside], 0).astype("<u2")


def chunk_windows(w: Words, ids: np.ndarray, hashes: int = HASHES, hot: np.ndarray | None = None) -> list[np.ndarray]:
    """Columns key, id, place (packed), left and right (bits of the shingles beside the smallest) of all windows of a chunk.

    With hot (sorted keys), windows of these keys have the key's complement, and two columns more
    follow: where such windows are, and their shingles (see _far).
    """
    t = PASSAGE - SHINGLE + 1
    s, doc, place = _sequence(w)
    if not len(s):
        return [np.empty(0, np.int64)] * 5 + ([np.empty(0, np.int64), np.empty((0, 2 * FAR), "<u2")] if hot is not None else [])
    ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1
    gap = np.arange(len(s)) + np.searchsorted(ends, np.arange(len(s)), "right")
    n = len(s) + len(ends)
    number = np.zeros(n, np.int64)
    number[gap] = np.arange(len(s))
    after, before = (signed(x << U(1)) for x in (_bits(s), _bits(s[::-1])[::-1]))
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    centre = []
    for k in range(hashes):
        h = np.zeros(n, U)
        h[gap] = mix(s, 500 + k) | U(1)
        lo, c, hi = compact_windows(h, t)
        i = number[c]
        out[0].append(signed(((h[c] >> U(1)) & ~U(3)) | U(k)))
        out[1].append(ids[doc[i]])
        out[2].append((place[i] << 24) | (np.minimum(c - lo, _WIDE) << 12) | np.minimum(hi - c, _WIDE))
        out[3].append(before[i])
        out[4].append(after[i])
        centre.append(i)
    rows = [np.concatenate(x) for x in out]
    if hot is None:
        return rows
    found = np.flatnonzero(np.isin(rows[0], hot))
    rows[0][found] = ~rows[0][found]  # set apart by the sign
    return [*rows, found, _far(s, doc, np.concatenate(centre)[found])]


def _linked(first: list[np.ndarray], second: list[np.ndarray], whole: np.ndarray | int = 0) -> list[np.ndarray]:
    """Columns b, a, hash, from, to, shift for windows that share a key: what both cover, in b's places; b is the larger id.

    Where they also share a run of a passage's length (whole), hash has WHOLE added.
    """
    key, id1, at1 = first
    _, id2, at2 = second
    swap = id1 < id2
    b, a = np.where(swap, id2, id1), np.where(swap, id1, id2)
    pb, pa_ = np.where(swap, at2, at1), np.where(swap, at1, at2)
    cb, ca = pb >> 24, pa_ >> 24
    before = np.minimum((pb >> 12) & _WIDE, (pa_ >> 12) & _WIDE)
    after = np.minimum(pb & _WIDE, pa_ & _WIDE)
    keep = (b != a) & (before + after + 1 >= PASSAGE - SHINGLE + 1)
    return [x[keep] for x in (b, a, (key & 3) + WHOLE * whole, cb - before, cb + after, cb - ca)]


def _first(code: np.ndarray) -> np.ndarray:
    """For each row the first row with the same code."""
    which, values = pd.factorize(code)
    first = np.empty(len(values), np.int64)
    first[which[::-1]] = np.arange(len(code))[::-1]
    return first[which]


def _runs(key: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, enough: int = ENOUGH, far: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each run of RUNS the windows that have it, and a hash of its key and shingles, odd for the first length.

    Shingles are told by one bit each, with far (see _far) by 16.
    """
    before, after = (at >> 12) & _WIDE, at & _WIDE
    every = np.arange(len(key))
    left, right, key = left.view(U), right.view(U), key.astype(U)
    sums = []
    for side in () if far is None else (far[:, :FAR], far[:, FAR:]):
        with np.errstate(over="ignore"):
            sums.append(np.cumsum((side.astype(U) + U(1)) * powers(FAR)[0][:FAR], axis=1))

    def nearest(side: int, rows: np.ndarray, k: int) -> np.ndarray:
        """A number that tells the k nearest shingles of a side."""
        if not k:
            return np.zeros(len(rows), U)
        return sums[side][rows, k - 1] if sums else (left, right)[side][rows] >> U(64 - k)

    for length, step in RUNS:
        for i in range(0, length, step):
            j = length - 1 - i
            rows = every
            if length == RUNS[0][0]:
                rows = np.flatnonzero((before >= i) & (after >= j) & (key & U(3) < U(enough)))
            x, y = nearest(0, rows, i), nearest(1, rows, j)
            with np.errstate(over="ignore"):
                code = signed(mix(key[rows] * U(0x9FB21C651E98DF25) + x * U(0xD6E8FEB86659FD93) + mix(y, length << 8 | i)))
            yield rows, code & ~1 | (length == RUNS[0][0])


def _tied(columns: list[np.ndarray], enough: int = ENOUGH) -> list[np.ndarray]:
    """Links of windows sorted by key, id and place: each run of each window with its first holder.

    The first holder of a run is the smallest id that has it, and the same one under every
    hash function, but for holders that differ where the bits don't. A window whose surroundings
    all are those of a smaller id's is tied to that.
    """
    key, ids, at, left, right = columns
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    several = np.append(ids[heads[1:] - 1], ids[-1:]) != ids[heads]
    key, ids, at, left, right = (x[np.repeat(several, np.diff(np.append(heads, len(key))))] for x in (key, ids, at, left, right))
    with np.errstate(over="ignore"):
        same = _first(signed(mix(mix(key.view(U), 1) + mix(left.view(U), 2) + mix(right.view(U), 3))))
    own = np.flatnonzero(ids[same] == ids)
    gone = np.flatnonzero(ids[same] != ids)
    pairs = [gone << 32 | same[gone]]
    whole = [pairs[0]]
    for rows, code in _runs(key[own], at[own], left[own], right[own], enough):
        to = rows[_first(code)]
        other = ids[own[to]] != ids[own[rows]]
        pairs.append(own[rows[other]] << 32 | own[to[other]])
        whole.append(pairs[-1][code[other] & 1 == 1])
    p = np.sort(np.concatenate(pairs))
    p = p[np.append(True, p[1:] != p[:-1])[: len(p)]]
    b, a = p >> 32, p & 0xFFFFFFFF
    return _linked([key[b], ids[b], at[b]], [key[a], ids[a], at[a]], np.isin(p, np.concatenate(whole)))


_LINK = ["b", "a", "hash", "from", "to", "shift"]
_LINKS = ", ".join(f"`{c}` long" for c in _LINK)


#: Rows of a batch.
BATCH = 50_000


def _batches(columns: list[np.ndarray], names: list[str], rows: int = BATCH) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + rows]) for x in columns], names=names)


def _whole(batches: Iterator[pa.RecordBatch], names: list[str], keys: int, least: int = 50_000) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, about `least` at once, cut only where one of the first `keys` columns changes."""
    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch[c].to_numpy(zero_copy_only=False) for c in names])
        count += batch.num_rows
        if count < least or all(x[0] == y[-1] for x, y in zip(held[0][:keys], held[-1], strict=False)):
            continue  # too few, or nothing but one key
        rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        cut = int(np.flatnonzero(np.any([x != x[-1] for x in rows[:keys]], axis=0))[-1]) + 1
        yield [x[:cut] for x in rows]
        held = [[x[cut:] for x in rows]]
        count -= cut
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


_WINDOW = ["key", "id", "at", "left", "right"]
_WINDOWS = ", ".join(f"`{c}` long" for c in _WINDOW)


def hot_keys(docs: DataFrame, hashes: int = HASHES, sample: int = HOT_SAMPLE, hot: int = HOT) -> np.ndarray:
    """Keys of windows that very many documents hold, estimated from one document in `sample`.

    How rows are dealt depends on it, and which near passages are tied by equal bits (see hot_links). There are at most HOT_SHARE times the windows of a
    document, and one for HOT_ROWS windows of all documents (8 MB for 2 * 10^12 windows).
    """
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(sample)) == 0)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            key, ids, *_ = chunk_windows(Words(chunk["text"]), chunk["doc_id"].to_numpy(zero_copy_only=False), hashes)
            pairs = pd.DataFrame({"key": key, "id": ids}).drop_duplicates()
            yield pa.RecordBatch.from_pandas(pairs, preserve_index=False)
            yield pa.RecordBatch.from_arrays([pa.nulls(chunk.num_rows, pa.int64()), chunk["doc_id"]], names=["key", "id"])

    seen = some.mapInArrow(find, "key long, id long").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    seen = saved(seen.where((F.col("n") >= hot) | F.col("key").isNull()))
    total = seen.where("key IS NULL").agg(F.max("n").alias("n")).first()["n"] or 0
    return np.sort(np.array([r["key"] for r in seen.where(F.col("key").isNotNull() & (F.col("n") >= min(total / HOT_SHARE, HOT_ROWS / sample))).collect()], np.int64))


def window_links(docs: DataFrame, hashes: int = HASHES, enough: int = ENOUGH, hot: np.ndarray | None = None) -> DataFrame:
    """Links of windows with the same smallest hash (see _tied): b, a, hash, from, to, shift (b's place less a's).

    Windows are dealt by key, those of `hot` keys by their runs, which 16 bits of each shingle tell.
    """
    known = docs.sparkSession.sparkContext.broadcast(hot if hot is not None else np.empty(0, np.int64))
    some = hot is not None and len(hot) > 0

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            rows = chunk_windows(Words(chunk["text"]), chunk["doc_id"].to_numpy(zero_copy_only=False), hashes, known.value if some else None)
            if not some:
                yield from _batches(rows, _WINDOW)
                continue
            *rows, found, far = rows
            sizes = np.zeros(len(rows[0]) + 1, np.int32)
            sizes[found + 1] = far.itemsize * far.shape[1]
            given = np.zeros(len(rows[0]), bool)
            given[found] = True
            buffers = [pa.array(given).buffers()[1], pa.py_buffer(np.cumsum(sizes, dtype=np.int32)), pa.py_buffer(far.tobytes())]
            beside = pa.Array.from_buffers(pa.binary(), len(given), buffers)
            for k, batch in enumerate(_batches(rows, _WINDOW)):
                yield batch.append_column("far", beside.slice(k * BATCH, batch.num_rows))

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: Iterator[pa.RecordBatch] = iter(())
        for batch in batches:
            n = int(np.searchsorted(batch["key"].to_numpy(zero_copy_only=False), 0))
            if n:
                columns = [*(batch[c].slice(0, n) for c in _WINDOW), pa.nulls(n, pa.int64()), batch["far"].slice(0, n)]
                yield pa.RecordBatch.from_arrays(columns, names=[*_LINK, "far"])
            if n < batch.num_rows:
                rest = chain([batch.slice(n)], batches)
                break
        for columns in _whole(rest, _WINDOW, 1):
            for x in _batches(_tied(columns, enough), _LINK):
                yield x.append_column("far", pa.nulls(x.num_rows, pa.binary())) if some else x

    more = ", far binary" if some else ""
    rows = docs.mapInArrow(find, _WINDOWS + more)
    deal = F.when(F.col("key") < 0, F.xxhash64("key", "id", "at")).otherwise(F.col("key"))
    links = rows.repartition(deal).sortWithinPartitions("key", "id", "at").mapInArrow(tie, _LINKS + more)
    if not some:
        return links
    links = saved(links)
    apart = links.where("far IS NOT NULL").select(F.bitwise_not("b").alias("key"), *(F.col(c).alias(n) for c, n in zip(_LINK[1:5], _WINDOW[1:], strict=True)), "far")
    return links.where("far IS NULL").drop("far").unionByName(hot_links(apart, enough))


def _coded(columns: list[np.ndarray], far: np.ndarray | None, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window and each run of RUNS its hash (see _runs), and whether the window has the run."""
    key, _, at, left, right = columns
    n = sum(len(range(0, length, step)) for length, step in RUNS)
    codes, has = np.zeros((len(key), n), np.int64), np.zeros((len(key), n), bool)
    for k, (rows, code) in enumerate(_runs(key, at, left, right, enough, far)):
        codes[rows, k], has[rows, k] = code, True
    return codes, has


def hot_links(windows: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """As _tied, for windows of keys that no task should have whole: by equal surroundings, to the heads of the key, then by run.

    The heads are the HEADS windows of a key with the smallest ids, so the first of them that has
    a run is the run's first holder. A window is tied to each of them at most once for all runs
    that both have; only runs that no head has are rows of their own. Keys are as few as in
    hot_keys, so heads are broadcast. With a column far (see _far) shingles of a run are told by
    16 bits: by one bit alone, of the very many holders of a key some have the same bits by chance
    in each run that reaches a few words beyond what they have in common, and each such run is a
    row.
    """
    around = ["key", "left", "right"]
    window = [*_WINDOW, "far"] if "far" in windows.columns else _WINDOW
    where = F.struct("id", "at")
    same = saved(windows.groupBy(*around).agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")))
    tied = saved(spread_join(windows, same, around, ["id", "at"]).select(*window, "first"))
    own = tied.where("id = first.id").select(*window)
    number = F.row_number().over(Window.partitionBy("key").orderBy("id", "at"))
    listed = own.withColumn("n", number).where(F.col("n") <= HEADS).collect()
    known = windows.sparkSession.sparkContext.broadcast(sorted(tuple(r[c] for c in ("key", "n", *window[1:])) for r in listed))

    def of_heads() -> tuple[np.ndarray, ...]:
        """Keys, the row of each key's first head, and ids, places and coded runs of heads; a key's heads follow one another."""
        rows = list(zip(*known.value, strict=True)) or [()] * (len(window) + 1)
        key, _, ids, at, left, right = (np.array(x, np.int64) for x in rows[:6])
        far = np.frombuffer(b"".join(rows[6]), "<u2").reshape(len(key), 2 * FAR) if len(rows) > 6 else None
        return *np.unique(key, return_index=True), np.append(key, 0), ids, at, *_coded([key, ids, at, left, right], far, enough)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]]:
        """Columns of windows, their coded runs, those that no head has, and for each number of a head: windows with runs of it first, ids and places of it, and whether one is whole."""
        keys, first, of, ids2, at2, codes2, has2 = of_heads()
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                columns = [part[c].to_numpy(zero_copy_only=False) for c in _WINDOW]
                far = flat(part["far"])[0].view("<u2").reshape(part.num_rows, -1) if len(window) > len(_WINDOW) else None
                codes, rest = _coded(columns, far, enough)
                key = columns[0]
                start = first[np.searchsorted(keys, key)]
                found = []
                for k in range(HEADS):
                    rows = np.flatnonzero(of[np.minimum(start + k, len(of) - 1)] == key)
                    head = start[rows] + k
                    common = rest[rows] & has2[head] & (codes[rows] == codes2[head])
                    rest[rows] &= ~common
                    some = common.any(axis=1)
                    found.append((rows[some], ids2[head[some]], at2[head[some]], (common[some] & (codes[rows[some]] & 1 == 1)).any(axis=1).astype(np.int64)))
                yield columns, codes, rest, found

    def to_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, ids, at, _, _), _, _, found in compared(batches):
            for rows, id2, at2, whole in found:
                k = ids[rows] > id2
                yield from _batches([key[rows[k]], ids[rows[k]], at[rows[k]], id2[k], at2[k], whole[k]], ["key", "id", "at", "id2", "at2", "whole"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, ids, at, _, _), codes, rest, _ in compared(batches):
            rows, run = np.nonzero(rest)
            yield from _batches([codes[rows, run], key[rows], ids[rows], at[rows]], ["run", "key", "id", "at"])

    of_head = F.struct(F.col("id2").alias("id"), F.col("at2").alias("at")).alias("first")
    pairs = own.mapInArrow(to_head, "key long, id long, at long, id2 long, at2 long, whole long").select("key", "id", "at", of_head, "whole")
    runs = own.mapInArrow(split, "run long, key long, id long, at long")
    # of runs that the same windows have, one is joined for all: a window has up to 65 runs, but seldom as many circles of holders
    held = [F.bit_xor(F.xxhash64("id", "at")).alias("h1"), F.sum(F.xxhash64("at", "id").cast("decimal(20)")).alias("h2")]
    runs_of = runs.groupBy("run").agg(F.min(where).alias("first"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), *held).where("most > first.id")
    first = saved(runs_of.groupBy("key", "first", "n", "h1", "h2").agg(F.min("run").alias("run"), F.max(F.col("run").bitwiseAND(1)).alias("whole")).select("run", "first", "n", "whole"))
    pairs = pairs.unionByName(spread_join(runs, first, ["run"], ["id", "at"]).where("id > first.id").select("key", "id", "at", "first", "whole"))
    pairs = pairs.unionByName(tied.where("id > first.id").select("key", "id", "at", "first", F.lit(1).cast("long").alias("whole")))
    pairs = pairs.groupBy("key", "id", "at", "first").agg(F.max("whole").alias("whole"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, ids, at, id2, at2, whole = (batch[c].to_numpy(zero_copy_only=False) for c in ("key", "id", "at", "id2", "at2", "whole"))
            yield from _batches(_linked([key, ids, at], [key, id2, at2], whole), _LINK)

    return pairs.select("key", "id", "at", F.col("first.id").alias("id2"), F.col("first.at").alias("at2"), "whole").mapInArrow(link, _LINKS)


def covered(group: np.ndarray, kind: np.ndarray, lo: np.ndarray, hi: np.ndarray, enough: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (group, from, to) of t places or more that intervals of `enough` kinds cover: the interval join."""
    order = np.lexsort((lo, kind, group))
    group, kind, lo, hi = group[order], kind[order], lo[order], hi[order] + 1
    new = np.append(True, (group[1:] != group[:-1]) | (kind[1:] != kind[:-1]))
    part = np.cumsum(new)
    big = int(hi.max()) + 2 if len(hi) else 1
    reach = np.maximum.accumulate(part * big + hi) - part * big
    start = new | np.append(True, lo[1:] > reach[:-1])  # unions of the intervals of a kind
    last = np.append(start[1:], True)
    g = np.concatenate([group[start], group[last]])
    x = np.concatenate([lo[start], reach[last]])
    d = np.concatenate([np.ones(start.sum(), np.int64), -np.ones(last.sum(), np.int64)])
    order = np.lexsort((d, x, g))
    g, x, d = g[order], x[order], d[order]
    level = np.cumsum(d)
    up = np.flatnonzero((level >= enough) & (level - d < enough))
    down = np.flatnonzero((level < enough) & (level - d >= enough))
    long = x[down] - x[up] >= t
    return g[up][long], x[up][long], x[down][long] - 1


def candidates(links: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """Candidate passages b, a, from, to (b's shingles), low, high (least and most shift).

    Links are dealt by pair, so a document that has very many partners is not one task's work.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[np.ndarray]) -> pa.RecordBatch:
            b, a, kind, lo, hi, shift = rows
            order = np.lexsort((shift, a, b))
            b, a, kind, lo, hi, shift = (x[order] for x in (b, a, kind, lo, hi, shift))
            new = np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]) | (shift[1:] - shift[:-1] > SHIFT))
            group = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(b)) - 1
            alone = np.flatnonzero(kind >= WHOLE)  # these count as often as is enough
            every = np.concatenate([np.arange(len(kind)), np.tile(alone, enough - 1)])
            kinds = np.concatenate([kind % WHOLE, np.repeat(np.arange(1, enough), len(alone)) * WHOLE + np.tile(kind[alone], enough - 1)])
            g, x, y = covered(group[every], kinds, lo[every], hi[every], enough, PASSAGE - SHINGLE + 1)
            columns = [b[heads][g], a[heads][g], x, y, shift[heads][g], shift[tails][g]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["b", "a", "from", "to", "low", "high"])

        for rows in _whole(batches, _LINK, 2):
            yield out(rows)

    return links.repartition("b", "a").sortWithinPartitions("b", "a").mapInArrow(work, "b long, a long, `from` long, `to` long, low long, high long")


def _spans(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, spans, text): wanted spans (doc_id, from, to) of each document, each once, with its text."""
    listed = wanted.groupBy("doc_id").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    # by a merge at every size: texts are no side to broadcast to, and few spans wouldn't stay few
    return docs.join(listed.hint("merge"), "doc_id").select("doc_id", "spans", "text")


def _cuts(chunk: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of a chunk; of each span its row, where it begins and ends in them, and where its text begins."""
    w = Words(chunk["text"])
    s, at = w.ngrams(SHINGLE)
    doc = w.doc[at]
    spans = chunk["spans"]
    row = np.repeat(np.arange(chunk.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    lo, hi = (spans.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(2))
    begin, end = np.searchsorted(doc, row, "left"), np.searchsorted(doc, row, "right")
    a = np.minimum(begin + np.maximum(lo, 0), end)
    return s, row, a, np.maximum(np.minimum(begin + hi + 1, end), a), begin


def _labelled(chunk: pa.RecordBatch, row: np.ndarray) -> list[pa.Array]:
    """doc_id, from and to of each span."""
    return [chunk["doc_id"].take(pa.array(row)), *(chunk["spans"].flatten().field(k) for k in range(2))]


def span_hashes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, from, to, h1, h2): a 128-bit hash of the shingles of each wanted span."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            s, row, a, b, _ = _cuts(chunk)
            up, down = powers(len(s) + 1)
            h = []
            with np.errstate(over="ignore"):
                for seed in (31, 32):
                    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(s, seed) * up[: len(s)])])
                    h.append(pa.array(signed(mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U), seed))))
            yield pa.RecordBatch.from_arrays([*_labelled(chunk, row), *h], names=["doc_id", "from", "to", "h1", "h2"])

    return _spans(docs, wanted).mapInArrow(work, "doc_id long, `from` long, `to` long, h1 long, h2 long")


def slices(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, from, to, begin, shingles): the shingles of each wanted span, and the place of the first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            s, row, a, b, begin = _cuts(chunk)
            offsets = np.concatenate([[0], np.cumsum(b - a)])
            take = np.repeat(a - offsets[:-1], b - a) + np.arange(offsets[-1])
            shingles = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(s[take])))
            yield pa.RecordBatch.from_arrays([*_labelled(chunk, row), pa.array(a - begin), shingles], names=["doc_id", "from", "to", "begin", "shingles"])

    return _spans(docs, wanted).mapInArrow(work, "doc_id long, `from` long, `to` long, begin long, shingles array<bigint>")


def same_passages(a: np.ndarray, b: np.ndarray, low: int, high: int, t: int, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """Runs of b's shingles that a has too: (b from, b to, a from, a to, similarity), t long or longer.

    low, high: the least and most that a place in b lies behind its match in a. Runs are
    joined over gaps that one changed word makes where the whole still is similar enough, by
    Jaccard similarity of shingle sets; else its longest parts that are similar enough count.
    """
    order = np.argsort(a, kind="stable")
    sorted_a = a[order]
    i = np.arange(len(b))
    # the match nearest to the expected place
    first, last = np.searchsorted(sorted_a, b, "left"), np.searchsorted(sorted_a, b, "right")
    has = last > first
    at = np.full(len(b), -1)
    want = i - (low + high) / 2
    one = has & (last - first == 1)
    at[one] = order[first[one]]
    for k in np.flatnonzero(has & ~one).tolist():
        options = order[first[k] : last[k]]
        at[k] = options[np.argmin(np.abs(options - want[k]))]
    has &= (i - at >= low - 2 * SHIFT) & (i - at <= high + 2 * SHIFT)
    if has.sum() < t // 2:
        return []
    k = np.flatnonzero(has)
    joined = np.flatnonzero(np.append(True, (k[1:] - k[:-1] > 2 * SHINGLE) | (np.abs((k[1:] - k[:-1]) - (at[k[1:]] - at[k[:-1]])) > SHIFT) | (at[k[1:]] <= at[k[:-1]])))
    out = []
    for s, e in zip(joined.tolist(), [*joined[1:].tolist(), len(k)], strict=True):
        part = k[s:e]
        if part[-1] - part[0] + 1 < t:
            continue
        found = _judged(a, b, part, at)
        if found[4] >= similarity:
            out.append(found)
            continue
        out += _similar_runs(a, b, part, at, t, similarity)
    return out


def _similar_runs(a: np.ndarray, b: np.ndarray, part: np.ndarray, at: np.ndarray, t: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """The longest run of a chain of matches, from one exact run to another, that is similar enough, then those left and right of it."""
    starts = np.flatnonzero(np.append(True, (part[1:] != part[:-1] + 1) | (at[part[1:]] != at[part[:-1]] + 1)))
    ends = np.append(starts[1:], len(part)) - 1
    first, last = part[starts], part[ends]
    gaps = np.append((first[1:] - last[:-1] - 1) + (at[first[1:]] - at[last[:-1]] - 1), 0)
    # shingles in common may be outnumbered by those that aren't by 1 / similarity - 1
    gain = (1 / similarity - 1) * (last - first + 1)
    before = np.append(0, np.cumsum(gain - gaps))[:-1]
    out, todo = [], [(0, len(starts))]
    while todo:
        lo, hi = todo.pop()
        if hi <= lo or last[hi - 1] - first[lo] + 1 < t:
            continue
        # the last exact run with which a run from each stays similar enough
        high = before[lo:hi] + gain[lo:hi]
        most = np.maximum.accumulate(high[::-1])[::-1]
        reach = np.searchsorted(-most, -(before[lo:hi] - 1e-9), "right") - 1
        size = last[lo + reach] - first[lo:hi] + 1
        i = int(np.argmax(size))
        x, y = lo + i, lo + int(reach[i])
        if size[i] < t:
            continue
        found = _judged(a, b, part[starts[x] : ends[y] + 1], at)
        if found[4] >= similarity:
            out.append(found)
            todo += [(lo, x), (y + 1, hi)]
        elif y > x:  # shingles that come more than once count less
            cut = x + int(np.argmax(gaps[x:y])) + 1
            todo += [(lo, cut), (cut, hi)]
    return out


def _judged(a: np.ndarray, b: np.ndarray, part: np.ndarray, at: np.ndarray) -> tuple[int, int, int, int, float]:
    x0, x1, y0, y1 = int(part[0]), int(part[-1]), int(at[part[0]]), int(at[part[-1]])
    x, y = np.unique(b[x0 : x1 + 1]), np.unique(a[y0 : y1 + 1])
    common = len(np.intersect1d(x, y, assume_unique=True))
    return x0, x1, y0, y1, common / (len(x) + len(y) - common)


_PASSAGE = ["doc_id", "start", "n_words", "source_id", "source_start", "similarity"]
_PASSAGES = "doc_id long, start long, n_words long, source_id long, source_start long, similarity double"


def _of_source(found: DataFrame, counted: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """found with the columns of its source span (a, a_from, a_to) in table (doc_id, from, to); a source may serve any number of rows.

    counted: the same rows, or more, to count by source.
    """
    source = counted.groupBy("a", "a_from", "a_to").agg(F.count(F.lit(1)).alias("n"))
    own = table.select(F.col("doc_id").alias("a"), F.col("from").alias("a_from"), F.col("to").alias("a_to"), *(F.col(c).alias(f"a_{c}") for c in columns))
    return spread_join(found, saved(source.join(own, ["a", "a_from", "a_to"])), ["a", "a_from", "a_to"], ["b", "from", "to"])


def verified(text: DataFrame, found: DataFrame) -> DataFrame:
    """The passages (columns of repeated_passages) among candidates, by their shingles.

    A candidate whose two sides are the same, place by place, shows by hashes of the two spans;
    for the others the shingles of both sides are brought together.
    """
    found = saved(found.distinct())
    wanted = lambda df: df.select(F.col("b").alias("doc_id"), "from", "to").unionByName(df.select(F.col("a").alias("doc_id"), F.col("a_from").alias("from"), F.col("a_to").alias("to")))
    of_b = lambda table, *columns: table.select(F.col("doc_id").alias("b"), "from", "to", *columns)

    still = found.where("low = high").withColumns({"a_from": F.col("from") - F.col("high"), "a_to": F.col("to") - F.col("high")})
    hashes = saved(span_hashes(text, wanted(still)))
    same = _of_source(still.join(of_b(hashes, "h1", "h2"), ["b", "from", "to"]), still, hashes, ["h1", "h2"]).where("h1 = a_h1 AND h2 = a_h2")
    same = saved(same.select("b", "a", "from", "to", "low", "high", "a_from"))

    rest = found.join(same.drop("a_from"), ["b", "a", "from", "to", "low", "high"], "left_anti")
    down, up = F.floor((F.col("from") - F.col("high") - SHIFT) / ROUND) * ROUND, F.ceil((F.col("to") - F.col("low") + SHIFT) / ROUND) * ROUND
    rest = saved(rest.withColumns({"a_from": F.greatest(down, F.lit(0).cast("long")), "a_to": up}))
    parts = saved(slices(text, wanted(rest)))
    pairs = _of_source(rest.join(of_b(parts, "begin", "shingles"), ["b", "from", "to"]), rest, parts, ["begin", "shingles"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            numbers = zip(*(batch[c].to_pylist() for c in ("b", "a", "low", "high", "begin", "a_begin")), strict=True)
            for k, (b, a, low, high, at_b, at_a) in enumerate(numbers):
                of = [batch[c][k].values.to_numpy(zero_copy_only=False) for c in ("a_shingles", "shingles")]
                behind = at_b - at_a
                for x0, x1, y0, _, s in same_passages(*of, low - behind, high - behind, t):
                    rows.append((b, at_b + x0, x1 - x0 + SHINGLE, a, at_a + y0, s, None, None))
                of = [x.view(U) for x in of]
                at = _misled(*of, low - behind, high - behind, t)
                if len(at):
                    rows += [(b, at_b + x, PASSAGE, None, None, None, h1, h2) for x, h1, h2 in zip(at.tolist(), *(h.tolist() for h in _run_hashes(of[1], at, t)), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*_PASSAGE, "h1", "h2"])

    t = PASSAGE - SHINGLE + 1
    kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 2
    shown = saved(pairs.select("b", "a", "low", "high", "begin", "a_begin", "shingles", "a_shingles").mapInArrow(verify, _PASSAGES + ", h1 long, h2 long"))
    exact = same.select(F.col("b").alias("doc_id"), F.col("from").alias("start"), (F.col("to") - F.col("from") + SHINGLE).alias("n_words"), F.col("a").alias("source_id"), F.col("a_from").alias("source_start"), F.lit(1.0).alias("similarity"))
    passages = saved(exact.unionByName(shown.where("h1 IS NULL").select(_PASSAGE)).distinct())
    misled = shown.where("h1 IS NOT NULL").select("h1", "h2", F.col("doc_id").alias("id"), F.col("start").alias("at"))
    return passages.unionByName(tied_again(misled, passages))


def _misled(a: np.ndarray, b: np.ndarray, low: int, high: int, t: int) -> np.ndarray:
    """Where runs of t shingles of b begin that have the bits of a's at a shift of low to high, but not its shingles."""
    bits_a, bits_b = mix(a, 77) & U(1), mix(b, 77) & U(1)
    found = [np.empty(0, np.int64)]
    for shift in range(low, high + 1):
        x, y = max(0, shift), min(len(b), len(a) + shift)
        if y - x < t:
            continue
        other, differ = (np.concatenate([[0], np.cumsum(u[x:y] != v[x - shift : y - shift])]) for u, v in ((bits_b, bits_a), (b, a)))
        found.append(x + np.flatnonzero((other[t:] == other[:-t]) & (differ[t:] > differ[:-t])))
    return np.unique(np.concatenate(found))


def _run_hashes(s: np.ndarray, at: np.ndarray, t: int) -> list[np.ndarray]:
    """128-bit hashes of the t shingles from each place on."""
    up, down = powers(len(s) + 1)
    out = []
    with np.errstate(over="ignore"):
        for seed in (31, 32):
            sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(s, seed) * up[: len(s)])])
            out.append(signed(mix((sums[at + t] - sums[at]) * down[at], seed)))
    return out


def tied_again(misled: DataFrame, passages: DataFrame) -> DataFrame:
    """Exact passages (columns of repeated_passages) among runs (h1, h2, id, at) whose first holder by bits lacks them.

    All that hold a run are tied to one first holder of its bits; as each of them differs from
    that one, each is among the runs. So runs are grouped by 128-bit hashes of all their
    shingles: the smallest id of a group has the run, and nothing is left to verify.
    """
    runs = saved(misled.distinct())
    first = runs.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("first"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n"))
    first = saved(first.where("most > first.id").drop("most"))
    ties = spread_join(runs, first, ["h1", "h2"], ["id", "at"]).where("id > first.id")
    ties = ties.select(F.col("id").alias("b"), F.col("first.id").alias("a"), (F.col("at") - F.col("first.at")).alias("shift"), "at")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, a, shift, at in _whole(batches, ["b", "a", "shift", "at"], 2):
            new = np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] != at[:-1] + 1))
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(b)) - 1
            yield from _batches([b[heads], at[heads], at[tails] - at[heads] + PASSAGE, a[heads], at[heads] - shift[heads], np.ones(len(heads))], _PASSAGE)

    exact = ties.repartition("b", "a").sortWithinPartitions("b", "a", "shift", "at").mapInArrow(joined, _PASSAGES)
    known = passages.select(F.col("doc_id").alias("of"), F.col("start").alias("from"), (F.col("start") + F.col("n_words")).alias("to"))
    inside = (F.col("doc_id") == F.col("of")) & (F.col("from") <= F.col("start")) & (F.col("to") >= F.col("start") + F.col("n_words"))
    return exact.join(known, inside, "left_anti")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: int = HASHES, enough: int = ENOUGH, sample: int = HOT_SAMPLE, hot: int = HOT) -> DataFrame:
    """Passages of PASSAGE words or more that stand in a document with a smaller id too.

    Every run of PASSAGE words that a smaller id has is found, with the smallest id that has it
    as source. Near passages are found where enough hash functions agree with the first holder
    of a run of some length around the smallest hash. sample and hot decide how rows of
    common passages are dealt (see hot_keys), not which exact runs are found; near passages that
    only equal bits would tie may be found beside rare keys and not beside common ones.

    One row per passage: doc_id, start and n_words (words from 0), source_id, source_start,
    similarity (Jaccard of shingle sets, SIMILARITY or more; exact runs have 1). Words stand
    between blanks, A-Z lower-cased. A passage that many documents share is reported in each
    of them but the first, with a source or a few, not with every other document; a word
    beside it that some further document happens to share is not added. Of places of a source
    that tie, the one nearest to the expected place counts, then the first.

    Null or empty texts, and those of fewer words than a passage, have none. A very long text
    is a chunk of its own; places are counted up to 2^39. Rows that repeat an id are one
    document (with different texts, each of them is searched and held against others);
    rows with a null id are left out, as are other columns; an empty table gives an empty
    table. Repeats inside a document don't count.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return verified(text, candidates(window_links(text, hashes, enough, hot_keys(text, hashes, sample, hot)), enough))


def cut_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the passages (doc_id, start, n_words); a text that has no word left goes.

    Texts without a passage stay as they are, byte for byte; where one is cut out, the blanks
    after it go with it. Columns stay; n_chars, if there, follows the new text. A text that
    had no word before stays.
    """
    own, key, body, listed = (_unused(x, docs.columns) for x in ("own", "key", "body", "listed"))
    spans = passages.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("start", "n_words")).alias(listed))
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.withColumn(own, F.col(id_col).cast("long")).join(spans, F.col(own) == F.col(key), "left").select(*rest, F.col(text_col).cast("string").alias(body), listed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, body):
            w = Words(chunk[body], lower=False, hashed=False)
            texts = chunk[body].to_pylist()
            keep = [True] * len(texts)
            for k, some in enumerate(chunk[listed].to_pylist()):
                if some and w.counts[k]:
                    texts[k], keep[k] = _without(texts[k], w, k, some)
            out = chunk.set_column(chunk.schema.get_field_index(body), body, pa.array(texts, pa.string()))
            yield out.filter(pa.array(keep, pa.bool_())).drop_columns([listed])

    out = rows.mapInArrow(work, rows.drop(listed).schema)
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.when(F.col(body).isNotNull(), F.char_length(body)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumnRenamed(body, text_col).select(docs.columns)


def _unused(name: str, columns: list[str]) -> str:
    """A column name that the table doesn't have."""
    lower = {c.lower() for c in columns}
    while f"_{name}" in lower:
        name += "_"
    return f"_{name}"


def _without(text: str, w: Words, k: int, spans: list[dict]) -> tuple[str, bool]:
    """The text of row k of a chunk without the words of the spans, and whether it has any left."""
    n, base, first = int(w.counts[k]), int(w.offsets[k]), int(w.first[k])
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        edge[min(s["start"], n)] += 1
        edge[min(s["start"] + s["n_words"], n)] -= 1
    gone = np.cumsum(edge)[:n] > 0
    raw = text.encode()
    starts = np.append(w.start[first : first + n] - base, len(raw))
    pieces = [raw[: int(starts[0])]]
    run = np.flatnonzero(np.append(True, gone[1:] != gone[:-1]))
    for a, b in zip(run.tolist(), [*run[1:].tolist(), n], strict=True):
        if not gone[a]:
            pieces.append(raw[int(starts[a]) : int(starts[b])])
    return b"".join(pieces).decode(), not gone.all()


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in which each repeated passage stands in its first document only."""
    return cut_passages(docs, repeated_passages(docs, id_col, text_col), id_col, text_col)
