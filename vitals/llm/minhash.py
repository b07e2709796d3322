"""Near-duplicates: circulant MinHash signatures, banding, exact Jaccard on full shingle sets.

Two permutations give a whole signature: one moves every shingle to a place, the other
orders the places, and coordinate k looks at that order shifted by k. Bands of coordinates
put likely pairs together; every link is then confirmed on the full sets.

Texts with equal shingle sets are one class and count once from there on. Classes that share
a band bucket are tied to one of the bucket's members, which gives loose clusters without
listing pairs; inside a cluster, sets are compared in blocks of bounded size by matrix
products, and only a spanning forest of the true links leaves a block. A cluster larger than
a block first compares all its blocks with one; what isn't one component by then is put into
closer clusters by its rarest shingles, one of which any two sets similar enough share.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitals.llm.components import connected_components
from vitals.llm.tables import saved, spread_join
from vitals.llm.textkernel import U, Words, chunks, distinct, groups, mix, signed

#: Coordinates of a band, and with what probability a pair just at the threshold may be missed.
ROWS, MISS = 6, 5e-8
#: Places of the second permutation, by the first LOW bits of a shingle's place; the TIE bits after them decide within a place.
LOW, TIE = 20, 12
PLACES = 1 << LOW
#: Classes, and shingles, that one side of a comparison holds at most (about).
BLOCK_ROWS, BLOCK_SHINGLES = 4096, 1 << 20

_orders: dict[int, np.ndarray] = {}


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """How many bands a threshold needs: 36 for 85 percent, 56 for 80."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def _windows(k: int) -> np.ndarray:
    """Row p: the order of places p, p + 1, ..., p + k - 1, around the circle, before TIE free bits."""
    if k not in _orders:
        order = np.random.default_rng(20220901).permutation(PLACES).astype(np.uint32) << np.uint32(TIE)
        _orders[k] = sliding_window_view(np.concatenate([order, order[: k - 1]]), k)
    return _orders[k]


def signatures(doc: np.ndarray, shingles: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their k coordinates; doc is sorted.

    Several shingles at a place (a set of millions has some at each) are told apart by the
    bits that follow, so sets larger than the number of places have signatures of their own.
    """
    windows = _windows(k)
    spread = mix(shingles, 31)
    place = (spread >> U(64 - LOW)).astype(np.int64)
    tie = ((spread >> U(64 - LOW - TIE)) & U((1 << TIE) - 1)).astype(np.uint32)[:, None]
    rows = np.flatnonzero(np.bincount(doc)) if len(doc) else doc
    out = np.full((len(rows), k), np.iinfo(np.uint32).max, np.uint32)
    number = np.searchsorted(rows, doc)
    step = 8192
    for a in range(0, len(place), step):
        part = windows[place[a : a + step]] | tie[a : a + step]
        n = number[a : a + step]
        starts = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        least = np.minimum.reduceat(part, starts, axis=0)
        out[n[starts]] = np.minimum(out[n[starts]], least)
    return rows, out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per signature and band."""
    with np.errstate(over="ignore"):
        h = np.zeros((len(sig), bands), U)
        for r in range(rows):
            h = h * U(0xD6E8FEB86659FD93) + mix(sig[:, r::rows][:, :bands].astype(U), 7)
        return mix(h + np.arange(bands, dtype=U)[None, :] * U(0x9E3779B97F4A7C15), 11)


def _digests(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two columns: the MD5 of each set, whose shingles stand one after another in ascending order."""
    ends = np.cumsum(size)
    data = memoryview(h.astype("<u8").tobytes())
    code = b"".join([hashlib.md5(data[8 * a : 8 * b], usedforsecurity=False).digest() for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(code, np.int64).reshape(-1, 2)


def fingerprints(docs: DataFrame, bands: int, rows: int = ROWS, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the shingle set (h1, h2), band keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            w = Words(chunk["text"])
            h, doc = w.shingles(n)
            doc, h = distinct(doc, h)
            size = np.bincount(doc, minlength=w.n_docs)
            code = _digests(h, size)
            which, sig = signatures(doc, h, bands * rows)
            keys = signed(band_keys(sig, bands, rows).reshape(-1))
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [chunk["doc_id"], pa.array(size.astype(np.int64)), pa.array(code[:, 0]), pa.array(code[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
                names=["doc_id", "n_shingles", "h1", "h2", "bands"],
            )

    return docs.mapInArrow(work, "doc_id long, n_shingles long, h1 long, h2 long, bands array<bigint>")


def shingle_sets(docs: DataFrame, n: int = 5) -> DataFrame:
    """id and its distinct shingles, of the rows of docs (id, h1, h2, text) whose set has that hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            w = Words(chunk["text"])
            h, doc = w.shingles(n)
            doc, h = distinct(doc, h)
            offsets = np.searchsorted(doc, np.arange(w.n_docs + 1))
            code = _digests(h, np.diff(offsets))
            out = pa.RecordBatch.from_arrays([chunk["id"], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(signed(h)))], names=["id", "shingles"])
            yield out.filter(pa.array((code[:, 0] == chunk["h1"].to_numpy()) & (code[:, 1] == chunk["h2"].to_numpy())))

    return docs.select("id", "h1", "h2", "text").mapInArrow(work, "id long, shingles array<bigint>")


def links(left: np.ndarray, right: np.ndarray, shingles: np.ndarray, owner: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a of left, b of right) with 100 * intersection >= percent * union.

    owner: of each shingle the set it is from; sizes: of each set. Shingles of one set only
    meet nothing and are left out; the others are taken in runs of columns, and the counts
    of common shingles add up exactly.
    """
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    new = np.append(True, shingles[1:] != shingles[:-1])
    column = np.cumsum(new) - 1
    count = np.bincount(column)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    column = np.searchsorted(np.unique(column), column)
    side_l, side_r = np.full(len(sizes), -1), np.full(len(sizes), -1)
    side_l[left], side_r[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    total = int(column[-1]) + 1 if len(column) else 0
    same = left is right
    for a in range(0, total, width):
        i, j = np.searchsorted(column, [a, a + width])
        c, o = column[i:j] - a, owner[i:j]
        wide = min(width, total - a)
        x = np.zeros((len(left), wide), np.float32)
        on = side_l[o] >= 0
        x[side_l[o[on]], c[on]] = 1
        y = x
        if not same:
            y = np.zeros((len(right), wide), np.float32)
            on = side_r[o] >= 0
            y[side_r[o[on]], c[on]] = 1
        common += x @ y.T
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for k in range(0, len(left), 256):
        part = common[k : k + 256]
        union = sizes[left[k : k + 256]][:, None] + sizes[right][None, :] - part
        a, b = np.nonzero((100 * part >= percent * union) & (part > 0))
        found.append((left[k + a], right[b]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest: each node that isn't the first of its component, and that first one."""
    root = np.arange(n)
    if len(a):
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        while True:
            least = root.copy()
            np.minimum.at(least, a, root[b])
            least = least[least]
            if (least == root).all():
                break
            root = least
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def confirmed(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members (k1, k2, k3, side, id, shingles) of the same keys: a spanning forest per comparison.

    k2 and k3 are the two blocks compared, side the block of a member; equal blocks compare
    all their members, others those of one block with those of the other.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["k1", "k2", "k3"]):
            t = t.combine_chunks()
            ids = t["id"].to_numpy()
            if len(ids) < 2:
                continue
            lists = t["shingles"].combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(ids)), sizes)
            k2, k3, side = t["k2"][0].as_py(), t["k3"][0].as_py(), t["side"].to_numpy()
            left = np.flatnonzero(side == k2)
            right = left if k2 == k3 else np.flatnonzero(side == k3)
            if len(left) and len(right):
                a, b = forest(len(ids), *links(left, right, flat, owner, sizes, percent))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    dealt = members.repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3")
    return dealt.select("k1", "k2", "k3", "side", "id", "shingles").mapInArrow(work, "a long, b long")


def _compare(sets: DataFrame, placed: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links within the block pairs (k1, k2, k3), for ids placed (id, k1, block) and sets (id, shingles)."""
    first = placed.join(pairs, (placed["k1"] == pairs["p1"]) & (placed["block"] == pairs["k2"]))
    second = placed.join(pairs.where("k2 <> k3"), (placed["k1"] == pairs["p1"]) & (placed["block"] == pairs["k3"]))
    at = first.unionByName(second).select("k1", "k2", "k3", F.col("block").alias("side"), "id")
    return confirmed(at.join(sets, "id"), percent)


def near_duplicates(
    docs: DataFrame, percent: int = 85, bands: int | None = None, rows: int = ROWS, n: int = 5, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, class_id.

    Documents are linked when 100 * intersection >= percent * union of their sets of n-word
    shingles (words between blanks, A-Z lower-cased; with fewer words, the whole sequence is
    the one shingle). component_id is the smallest doc_id reachable over links, class_id the
    smallest doc_id with the same set.

    A null or empty text, or one without words, has no shingle and is linked with nothing; a
    very long text is a chunk of its own. Repeated rows, and rows that repeat an id, are one
    document; of different texts with one id, the one whose set has the smallest hash is
    compared, and n_shingles is each row's own. A row with a null id keeps null component_id
    and class_id and is kept, as nothing can name it. Links at just the threshold count. Other
    columns are left out; an empty table gives an empty table.

    No bucket, cluster or group is capped. A cluster that is larger than a block first
    compares every block with the first one; the sets that then are in different components
    are compared where they share their rarest shingles, or chains of those (see _rest).
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = saved(fingerprints(text, bands or bands_for(percent, rows), rows, n))
    key = ["h1", "h2", "n_shingles"]
    some = prints.where("n_shingles > 0 AND doc_id IS NOT NULL")
    one = saved(some.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("set")).select("doc_id", "set.*"))
    classes = saved(one.groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")))
    member = spread_join(one, classes, key, ["doc_id"]).select("doc_id", "class_id")
    heads = some.join(classes.select(*key, F.col("class_id").alias("doc_id")), ["doc_id", *key]).dropDuplicates(["doc_id"])
    heads = saved(heads.select(F.col("doc_id").alias("id"), *key, "bands"))

    # loose clusters: every member of a bucket with the bucket's smallest
    keyed = heads.select("id", F.explode("bands").alias("key"))
    pivots = saved(keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    tied = spread_join(keyed, pivots, ["key"], ["id"]).where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    loose = saved(connected_components(tied).join(heads.drop("bands"), "id"))

    sizes = loose.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.select("component", F.ceil(F.greatest(F.col("n") / block_rows, F.col("s") / block_shingles)).alias("blocks"))
    placed = loose.join(sizes, "component").select("id", F.col("component").alias("k1"), "blocks", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id"), F.col("blocks"))).otherwise(F.lit(0)).alias("block"))
    # by a merge at every size: texts are no side to broadcast to, and few ids wouldn't stay few
    sets = saved(shingle_sets(text.withColumnRenamed("doc_id", "id").join(loose.select("id", "h1", "h2").hint("merge"), "id"), n).dropDuplicates(["id"]))

    # every block with block 0: the whole of a cluster that fits one block
    first_pairs = sizes.select(F.col("component").alias("p1"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k3")).select("p1", F.lit(0).cast("long").alias("k2"), "k3")
    found = saved(_compare(sets, placed.select("id", "k1", "block"), first_pairs, percent))
    large = placed.where("blocks > 1").select("id", "k1")
    if not large.isEmpty():
        found = found.unionByName(_rest(sets, large, found, percent, block_rows, block_shingles))
    joined = connected_components(found)

    named = classes.select("class_id", "n").join(joined.withColumnRenamed("id", "class_id"), "class_id", "left")
    named = named.select("class_id", "n", F.coalesce("component", "class_id").alias("component_id"))
    out = spread_join(member, named, ["class_id"], ["doc_id"]).select("doc_id", "class_id", "component_id")
    return (
        prints.select("doc_id", "n_shingles")
        .join(out, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))
    )


def _closer(sets: DataFrame, own: DataFrame, percent: int, most: int) -> DataFrame:
    """(id, k1): the sets of clusters (id, k1, c) that may still be linked over the components c, in new clusters.

    Two sets with percent in common share one of the first |set| - percent |set| + 1 shingles
    of each in any common order; here the rarest of the cluster come first. Sets that share
    such a shingle, where more than one component has it, are in one new cluster. Text from
    one template shares common shingles and has rare ones of its own, so it falls apart.
    """
    rows = own.join(sets, "id").select("k1", "id", "c", F.size("shingles").alias("size"), F.explode("shingles").alias("s"))
    common = saved(rows.groupBy("k1", "s").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")))
    ranked = spread_join(rows, common, ["k1", "s"], ["id"], at_most=most).withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("n", "s")))
    least = F.col("size") - F.ceil(F.col("size") * percent / F.lit(100) - F.lit(1e-9)) + 1
    first = saved(ranked.where((F.col("rank") <= least) & (F.col("lo") != F.col("hi"))).select("k1", "s", "id", "c"))
    lists = first.groupBy("k1", "s").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    tied = spread_join(first.select("k1", "s", "id"), saved(lists.select("k1", "s", "pivot", "n")), ["k1", "s"], ["id"], at_most=most)
    return connected_components(tied.select(F.col("id").alias("a"), F.col("pivot").alias("b"))).withColumnRenamed("component", "k1")


def _rest(sets: DataFrame, large: DataFrame, found: DataFrame, percent: int, block_rows: int, block_shingles: int) -> DataFrame:
    """The links in large clusters (id, k1) between what `found` has left in different components.

    Clusters are drawn closer (see _closer); then all pairs of their blocks are compared but
    those inside one component.
    """
    done = connected_components(found)
    own = saved(large.join(done, "id", "left").select("id", "k1", F.coalesce("component", "id").alias("c")))
    most = own.count()
    mixed = own.groupBy("k1").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("k1")
    own = own.join(mixed, "k1", "left_semi")
    close = _closer(sets, own, percent, most)
    sized = saved(close.join(own.select("id", "c"), "id").join(sets.select("id", F.size("shingles").cast("long").alias("size")), "id"))
    many = F.ceil(F.greatest(F.col("n") / block_rows, F.col("s") / block_shingles))
    sums = (F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    # a component of some size has blocks of its own; the others share blocks (`of` is null)
    within = (sized.groupBy("k1", "c").agg(*sums).select("k1", "c", "n", (F.col("n") >= block_rows // 4).alias("own"), many.alias("blocks")))
    seen = saved(spread_join(sized, within, ["k1", "c"], ["id"], at_most=most).select("id", "k1", "c", "size", "own", "blocks"))
    shared = seen.where("NOT own").groupBy("k1").agg(*sums).select("k1", "n", many.alias("blocks"))
    number = lambda: F.xxhash64(F.coalesce("of", F.lit(-1).cast("long")), F.col("of").isNull(), "part")
    alone = seen.where("own").select("id", "k1", F.col("c").alias("of"), "blocks")
    others = spread_join(seen.where("NOT own").select("id", "k1"), shared, ["k1"], ["id"], at_most=most).select("id", "k1", F.lit(None).cast("long").alias("of"), "blocks")
    placed = (alone.unionByName(others).withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("id", "k1", number().alias("block")))
    blocks = within.where("own").select("k1", F.col("c").alias("of"), "blocks").unionByName(shared.select("k1", F.lit(None).cast("long").alias("of"), "blocks"))
    listed = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("k1", "of", number().alias("block"))
    other = listed.select(F.col("k1").alias("p1"), F.col("of").alias("of3"), F.col("block").alias("k3"))
    pairs = listed.join(other, (F.col("k1") == F.col("p1")) & (F.col("block") <= F.col("k3")) & (F.col("of").isNull() | F.col("of3").isNull() | (F.col("of") != F.col("of3"))))
    return _compare(sets, placed, pairs.select("p1", F.col("block").alias("k2"), "k3"), percent)


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps, one document of each component, with all their columns."""
    dropped = near_duplicates(docs, percent, id_col=id_col, text_col=text_col).where("NOT kept").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(dropped, id_col, "left_anti").select(docs.columns)
