"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie.

The trie is a table of edges over all words, with paths that don't branch as one edge. A state
is a word, a place in it, a node and whether the edit has been made. Where a word leaves a node
of its own path by an edge that needs one edit, a state begins; level by level, all states meet
the edge table and keep the edge that goes on as the word does. States at the end of their
word, in a node where a word ends, are neighbours.

The trie holds every word forwards and backwards (behind a mark), as an edit in the first half
of a word is in the second half of the other: edits are only tried there, far from the root,
where a node has few edges.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitals.llm.tables import saved, spread_join
from vitals.llm.textkernel import LOWER, U, chunks, flat, mix, powers, signed

#: Every word whose hash this divides loses a code point; code points and occurrences that a word needs.
EVERY, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: Code points of a short label.
SHORT = 2
#: What stands before a word that is turned round; no letter.
BACK = "<"
#: Words of one task that are held before their counts go on.
HELD = 400_000

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (A-Z lower-cased) of a chunk; row, start and end (in bytes) of each run of letters.

    Letters are A-Z, a-z and U+00C0 to U+00FF, which are the byte C3 and one after it.
    """
    raw, offsets = flat(texts)
    lead = raw == 0xC3
    inside = _ASCII[raw] | lead
    inside[1:] |= lead[:-1]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~cut[:-1] if len(raw) else inside
    after = np.concatenate([inside[1:], [False]]) & ~cut[1:] if len(raw) else inside
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return LOWER[raw], np.searchsorted(offsets, start, "right") - 1, start, end


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """crc32 of byte ranges, each carried on from a crc32 of what stands before it."""
    crc = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(start - end, kind="stable")  # the longest first
    at, size, crc = start[order], (end - start)[order], crc[order]
    for k in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -k, "left"))
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty(len(crc), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def chunk_words(chunk: pa.RecordBatch, every: int = EVERY, length: int = LEAST_LENGTH) -> list[tuple[str, int]]:
    """(word, count) of a chunk of (doc_id, text): its runs, where one that the hash picks has lost a code point; none of fewer bytes than length."""
    data, row, start, end = runs(chunk["text"])
    ids = chunk["doc_id"].to_pylist()
    begin = np.array([zlib.crc32(f"{i}:".encode()) if i is not None else 0 for i in ids], np.uint32)
    named = np.array([i is not None for i in ids], bool)
    h = crc32s(data, start, end, begin[row])
    picked = (h % every == 0) & named[row]
    raw = data.tobytes()
    out: dict[str, int] = {}
    for i in np.flatnonzero(picked).tolist():
        w = raw[start[i] : end[i]].decode()
        k = int(h[i]) % len(w)
        out[w[:k] + w[k + 1 :]] = out.get(w[:k] + w[k + 1 :], 0) + 1
    # the others by hash and length, so that a run is decoded once a chunk
    rest = np.flatnonzero(~picked & (end - start >= length))
    start, end = start[rest], end[rest]
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
        code = mix((sums[end] - sums[start]) * down[start] ^ ((end - start).astype(U) << U(40)))
    _, first, n = np.unique(code, return_index=True, return_counts=True)
    for a, b, k in zip(start[first].tolist(), end[first].tolist(), n.tolist(), strict=True):
        w = raw[a:b].decode()
        out[w] = out.get(w, 0) + k
    return list(out.items())


def vocabulary(docs: DataFrame, every: int = EVERY, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of documents (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for chunk in chunks(batches, "text"):
            for w, n in chunk_words(chunk, every, length):
                if len(w) >= length:
                    held[w] = held.get(w, 0) + n
            if len(held) > HELD:
                yield out()
        yield out()

    return docs.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


# ---- the trie


def prefixes(words: DataFrame) -> DataFrame:
    """(word, id, pos, node, next, one, two, last, size, own) for every prefix of every word.

    node hashes the prefix, so a node may stand for two prefixes, which can't lose a neighbour
    (all edges of both are there) and adds none (neighbours are compared). next is the code
    point after the prefix, -1 at the end; the rest are bits of the next two and the last code
    points and of the word's length, to tell early where a walk can't end well; own packs the
    numbers of the first three bits (6 binary digits each, 63 where there is none).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(iter([batch]), "word", 1 << 17):
                words = chunk["word"]
                size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
                points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
                first = np.cumsum(size) - size
                up, down = powers(len(points) + 1)
                with np.errstate(over="ignore"):
                    sums = np.zeros(len(points) + 1, U)
                    np.cumsum((points.astype(U) + U(1)) * up[: len(points)], out=sums[1:])
                    row = np.repeat(np.arange(len(size)), size + 1)
                    pos = np.arange(len(row)) - np.repeat(first + np.arange(len(size)), size + 1)
                    at = first[row] + pos
                    node = signed(mix((sums[at] - sums[first[row]]) * down[first[row]] ^ (pos.astype(U) << U(40)), 11))
                    whole = signed(mix((sums[first + size] - sums[first]) * down[first] ^ (size.astype(U) << U(40)), 11))
                padded = np.append(points, [0, 0])
                bit = lambda code, has: np.where(has, np.left_shift(1, bucket(code)), 0)
                number = lambda code, has: np.where(has, bucket(code), 63)
                left = size[row] - pos
                columns = [
                    words.take(pa.array(row)),
                    *(pa.array(x) for x in (whole[row], pos.astype(np.int32), node, np.where(left > 0, padded[at], -1).astype(np.int32), bit(padded[at], left > 0), bit(padded[at + 1], left > 1), bit(points[(first + size - 1)[row]], left > 0), np.left_shift(1, np.minimum(size[row], 62)), (number(padded[at], left > 0) | number(padded[at + 1], left > 1) << 6 | number(points[(first + size - 1)[row]], left > 0) << 12).astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=_PREFIX)

    return words.select("word").mapInArrow(work, "word string, id long, pos int, node long, next int, one long, two long, last long, size long, own int")


_PREFIX = ["word", "id", "pos", "node", "next", "one", "two", "last", "size", "own"]


def bucket(code: np.ndarray) -> np.ndarray:
    """One of 62 bits for a code point; a-z have one each."""
    return np.where((code >= 97) & (code <= 122), code - 97, 26 + code % 36).astype(np.int64)


def _code(word: Column, place: Column) -> Column:
    """The code point at a place (from 0) of a word."""
    return F.ascii(F.substring(word, place + 1, F.lit(1)))


def _has(mask: Column, number: Column) -> Column:
    return F.getbit(mask, number) == 1


def _has_code(mask: Column, code: Column) -> Column:
    return _has(mask, F.when(code.between(97, 122), code - 97).otherwise(26 + F.pmod(code, F.lit(36))))


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """paths (word, pos, node, own): the nodes on the way to each word that branch or end one; edges (node, next, label, child, ends, one, two, last, size); names (word, node) of all words.

    Nodes in which nothing begins and nothing ends are left out, so an edge has a label of any length.
    """
    rows = saved(prefixes(words))
    bits = ["one", "two", "last", "size"]
    nodes = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.min("next").alias("least"), F.max("next").alias("most"), F.min("id").alias("first"), *(F.bit_or(c).alias(c) for c in bits)
    )
    nodes = saved(nodes.where("least < most OR least < 0").withColumn("ends", F.col("least") < 0).drop("least", "most"))
    # an edge is written by one of its words
    shown = F.col("id") == F.col("first")
    kept = spread_join(rows.where("pos > 0").select("word", "id", "pos", "node", "own"), nodes, ["node"], ["word"])
    kept = kept.select("word", "pos", "node", "own", shown.alias("shown"), F.when(shown, F.col("ends")).alias("ends"), *(F.when(shown, F.col(c)).alias(c) for c in bits))
    root = rows.where("pos = 0").select("word", "pos", "node", "own", F.lit(False).alias("shown"), F.lit(None).cast("boolean").alias("ends"), *(F.lit(None).cast("long").alias(c) for c in bits))
    # a word has as many rows as nodes on its way
    before = lambda c: F.lag(c).over(Window.partitionBy("word").orderBy("pos"))
    chain = saved(kept.unionByName(root).withColumns({"parent": before("node"), "from": before("pos")}))
    size = F.col("pos") - F.col("from")
    edges = chain.where("shown").select(
        F.col("parent").alias("node"), _code(F.col("word"), F.col("from")).alias("next"), F.substring("word", F.col("from") + 1, size).alias("label"), F.col("node").alias("child"), "ends", *bits
    )
    return chain.select("word", "pos", "node", "own"), saved(edges.distinct()), rows.where("next < 0").select("word", "node")


def _goes_on(edge: Column, word: Column, pos: Column, goal: Column) -> Column:
    """Whether a word that has its edit behind it may end below an edge's child, pos of its places done."""
    left = F.length(word) - pos
    return (
        _has(edge["size"], F.least(goal, F.lit(62)))
        & F.when(left == 0, edge["ends"]).otherwise(_has_code(edge["one"], _code(word, pos)))
        & F.when(left > 1, _has_code(edge["two"], _code(word, pos + 1))).otherwise(True)
        & F.when(left > 0, _has_code(edge["last"], _code(word, F.length(word) - 1))).otherwise(True)
    )


def _may_fit(edge: Column, word: Column, pos: Column, own: Column) -> Column:
    """A quick look whether one edit could lead on through an edge, by the packed numbers of a path's row: false only if none can."""
    digit = lambda k: F.shiftright(own, 6 * k).bitwiseAND(63)
    left = F.length(word) - pos
    same, longer = F.least(F.length(word), F.lit(62)), F.least(F.length(word) + 1, F.lit(62))
    # with a label of one code point, the next two places of the word are known; a place behind the end has no bit
    single = F.length(edge["label"]) == 1
    other = _has(edge["size"], same) & F.when(single, F.when(left == 1, edge["ends"]).otherwise(_has(edge["one"], digit(1)))).otherwise(True)
    more = _has(edge["size"], longer) & F.when(single, F.when(left == 0, edge["ends"]).otherwise(_has(edge["one"], digit(0)) & ((left < 2) | _has(edge["two"], digit(1))))).otherwise(True)
    return (other | more) & (~single | (left < 2) | _has(edge["last"], digit(2)))


_STATE = ["word", "pos", "node", "goal"]


def first_edits(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """States after the edit (word, pos, node, goal, ends): each word leaves each node of its way by each edge that one edit fits.

    Edges that end in the first half of the word are left out. The edit replaces a code point
    by a larger one or adds one; the other neighbours come from the other side. goal is the
    length of the neighbour.
    """
    e, word, half = F.col("e"), F.col("word"), F.floor(F.length("word") / 2)
    met = None
    # short edges matter to nodes near the middle and behind it; of nodes before, which all words pass, a few long edges do
    for own, ways in ((F.length("label") <= SHORT, paths.where(F.col("pos") + SHORT > half)), (F.length("label") > SHORT, paths)):
        listed = F.collect_list(F.struct("label", "child", "ends", "one", "two", "last", "size"))  # one for each code point that follows a node
        out = edges.where(own).groupBy("node").agg(listed.alias("edges"))
        counted = saved(out.join(ways.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node"))
        at = spread_join(ways, counted, ["node"], ["word"]).select("word", "pos", "own", F.explode("edges").alias("e"))
        at = at.where((F.col("pos") + F.length("e.label") > half) & _may_fit(e, word, F.col("pos"), F.col("own")))
        met = at if met is None else met.unionByName(at)
    size = F.length(e["label"])
    part = lambda n: F.substring(word, F.col("pos") + 1, n)
    # equal lengths one edit apart differ in a place, lengths one apart in a code point more
    near = lambda n: (F.length(part(n)) == n) & (F.levenshtein(e["label"], part(n), 1) == 1)
    single = size == 1
    other, more = F.when(single, part(1) != "").otherwise(near(size)), F.when(single, True).otherwise(near(size - 1))
    met = met.withColumns({"other": (e["label"] > part(size)) & other, "more": more}).where("other OR more")
    state = lambda pos, goal: F.struct(pos.alias("pos"), goal.alias("goal"))
    made = F.array_compact(F.array(F.when(F.col("other"), state(F.col("pos") + size, F.length(word))), F.when(F.col("more"), state(F.col("pos") + size - 1, F.length(word) + 1))))
    made = met.select("word", e.alias("e"), F.explode(made).alias("s"))
    goes_on = _goes_on(e, word, F.col("s.pos"), F.col("s.goal"))
    return made.where(goes_on).select("word", "s.pos", e["child"].alias("node"), "s.goal", e["ends"].alias("ends"))


def next_level(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge on: each takes the edge that begins with its next code point, if the whole label is there."""
    word, pos = F.col("word"), F.col("pos")
    states = states.withColumn("next", _code(word, pos))
    counted = edges.join(states.groupBy("node", "next").agg(F.count(F.lit(1)).alias("n")), ["node", "next"])
    e = F.struct("ends", "one", "two", "last", "size")
    size = F.length("label")
    met = spread_join(states, saved(counted), ["node", "next"], ["word", "pos", "goal"])
    return met.where((F.substring(word, pos + 1, size) == F.col("label")) & _goes_on(e, word, pos + size, F.col("goal"))).select("word", (pos + size).alias("pos"), F.col("child").alias("node"), "goal", "ends")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near) for all pairs of words (word) that one inserted, deleted or replaced code point tells apart, both ways."""
    both = words.select("word").unionByName(words.select(F.concat(F.lit(BACK), F.reverse("word")).alias("word")))
    paths, edges, names = trie(both)
    done = F.col("pos") == F.length("word")
    states = saved(first_edits(paths, edges))
    ended = None
    while True:
        found = states.where(done & F.col("ends")).select("word", "node")
        ended = found if ended is None else ended.unionByName(found)
        left = states.where(~done).select(*_STATE)
        if left.isEmpty():
            break
        states = saved(next_level(left, edges))
    forwards = lambda c: F.when(F.startswith(c, F.lit(BACK)), F.reverse(F.substring(c, 2, 2**31 - 1))).otherwise(F.col(c)).alias(c)
    pairs = ended.distinct().join(names.withColumnRenamed("word", "near"), "node").select(forwards("word"), forwards("near")).where(F.levenshtein("word", "near", 1) == 1)
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"))).distinct()


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    near = neighbours(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    good = -F.col("best.m") >= 2 * F.col("n")
    rows = saved(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")))
    # a form is twice as frequent at least, so ways are short; each round doubles what they skip
    ways = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = saved(ways.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ways = further.select("word", "root")
        if further.where("moved").isEmpty():
            break
    return rows.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """Words of the documents with their frequent spelling: word, form, root, n, n_near, form_n.

    Words are runs of letters (A-Z and a-z, lower-cased, and U+00C0 to U+00FF as they are); a
    run whose crc32 with its document's id `every` divides loses a code point. Words of
    `length` code points and `count` occurrences count. n_near is the number of words one
    edit away; form the most frequent of them (ties: the smallest), if it has twice the
    occurrences, root what following forms leads to.

    Null and empty texts have no run. A row with a null id has its runs as they stand.
    Repeated rows count again. A word may have any length: edges hold as much of it as
    doesn't branch, so levels follow how often words branch, not how long they are. Other
    columns are left out; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return variants(saved(vocabulary(rows, every, length, count)))


def spelling_sql(every: int = EVERY, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> str:
    """The same in DuckDB: pairs by what is left when one code point goes."""
    return rf"""
        WITH RECURSIVE b(i, c, k) AS (SELECT i, i, 0 FROM range(0, 256) AS r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM b WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8),
        r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
        d AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
        h AS (SELECT run, n, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM d, crc),
        e AS (SELECT CASE WHEN h % {every} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM h),
        w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY word HAVING length(word) >= {length} AND sum(n) >= {count}),
        k AS (SELECT word, n, word AS key FROM w UNION SELECT word, n, word[:i] || word[i + 2:] FROM (SELECT *, unnest(range(0, length(word))) AS i FROM w)),
        p AS (SELECT DISTINCT x.word, y.word AS near, y.n AS m FROM k x JOIN k y USING (key) WHERE x.word <> y.word AND CASE WHEN length(x.word) = length(y.word) THEN len(list_filter(range(1, length(x.word) + 1), lambda i: x.word[i] <> y.word[i])) = 1 ELSE key IN (x.word, y.word) END),
        g AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -m, near := near)) AS best FROM p GROUP BY word),
        f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.near END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM w LEFT JOIN g USING (word)),
        o AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT o.word, f.form FROM o JOIN f ON f.word = o.root WHERE f.form IS NOT NULL),
        z AS (SELECT o.word, arg_max(o.root, w.n) AS root FROM o JOIN w ON w.word = o.root GROUP BY o.word)
        SELECT word, form, coalesce(z.root, word) AS root, n, n_near, form_n FROM f LEFT JOIN z USING (word)"""
