"""Byte-level BPE over a partition: encoding by a pair occurrence index, and decoding.

Texts are cut at blanks that always begin a token, so the same pieces come up again and
again and each is encoded once per worker. The pieces that are new in a chunk are laid
out in one list of symbols; an index maps the pairs that the vocabulary merges to all
their positions in that list, active ranks are applied in ascending order, and a merge
updates the lists of the pairs that it makes.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitals.llm.textkernel import chunks, plain

#: Fixed: the pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker remembers at most; beyond, those of the last chunk alone.
REMEMBERED = 500_000
#: Ranks that share a list of positions.
BAND = 512
#: Bytes beyond which a piece is encoded by itself.
LONG = 256
NONE = np.int64(1 << 40)
SLOTS = 1 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    return letters | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}


def hash_slots(pair: np.ndarray) -> np.ndarray:
    return ((pair * np.int64(-7046029254386353131)) >> np.int64(44)) & (SLOTS - 1)


def hashed_pairs(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """A hash table from pairs to ranks, and how many slots in a row a search looks at."""
    keys, ranks = np.full(SLOTS, -1), np.full(SLOTS, NONE)
    most = 1
    for slot, (pair, rank) in zip(hash_slots(np.array(list(pairs), np.int64)).tolist(), pairs.items(), strict=True):
        probes = 1
        while keys[slot] >= 0:
            slot, probes = (slot + 1) & (SLOTS - 1), probes + 1
        keys[slot], ranks[slot], most = pair, rank, max(most, probes)
    return keys, ranks, most


class PairIndexBpe:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token) if token not in self.specials else token.encode()
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        single = {x[0]: i for i, x in enumerate(self.token_bytes) if len(x) == 1}
        self._byte_ids = np.array([single[b] for b in range(256)], np.int64)
        pairs: dict[int, int] = {}
        merged = []
        for merge in spec["model"]["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs.setdefault(vocab[a] << 20 | vocab[b], len(merged))
            merged.append(vocab[a + b])
        self._merged = np.array(merged, np.int64)
        self._pairs, self._single = pairs, single
        self._keys, self._ranks, self._probes = hashed_pairs(pairs)
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in self.specials) + ")") if self.specials else None
        #: Ids of what follows a blank; None for what can't be encoded by itself.
        self.words: dict[str, bytes | None] = {"": None}
        lengths = np.array([len(x) for x in self.token_bytes], np.int64)
        self._lengths, self._starts = lengths, np.cumsum(lengths) - lengths
        self._flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; NONE for pairs that the vocabulary doesn't merge."""
        pair = left << 20 | right
        slot = hash_slots(pair)
        out = np.full(len(pair), NONE)
        for _ in range(self._probes):
            hit = self._keys[slot] == pair
            out[hit] = self._ranks[slot[hit]]
            slot = (slot + 1) & (SLOTS - 1)
        return out

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of pieces that the pattern has found.

        `places` is the occurrence index: from pairs, by rank, to all their positions in the
        symbols of all pieces. BAND ranks that follow one another share a list, so that it is
        an array. Bands are taken in ascending order; within one, each step applies the lowest
        rank that each piece still has there at all its positions from the left. A merge puts
        its position and the one before it into the lists of the pairs that it makes; entries
        of pairs that it takes apart are passed over. Pieces of more than LONG bytes would need
        many steps and go by `_encode_long`.
        """
        if not pieces:
            return []
        coded = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        if sizes.max() > LONG:
            some = iter(self.encode_pieces([p for p, x in zip(pieces, coded, strict=True) if len(x) <= LONG]))
            return [next(some) if len(x) <= LONG else self._encode_long(x) for x in coded]
        n = int(sizes.sum())
        ends = np.cumsum(sizes)
        begins = ends - sizes
        piece = np.repeat(np.arange(len(pieces)), sizes)
        # one more of each, for what isn't there: beyond the ends of pieces
        symbols = np.append(self._byte_ids[np.frombuffer(b"".join(coded), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1], before[begins], after[n], before[n] = n, n, n, n
        pair = np.full(n + 1, NONE)
        inner = np.flatnonzero(after[:n] < n)
        pair[inner] = self.ranks(symbols[inner], symbols[inner + 1])
        places: list[list[np.ndarray]] = [[] for _ in range(len(self._merged) // BAND + 1)]
        self._listed(places, inner, pair[inner])
        for band in range(len(places)):
            top = (band + 1) * BAND
            todo, places[band] = places[band], []
            while todo:
                i = np.concatenate(todo)
                i = np.sort(i[pair[i] < top])  # the others are entries of pairs that a merge took apart
                i = i[np.append(True, i[1:] != i[:-1])[: len(i)]]
                if not len(i):
                    break
                r, left, right = pair[i], before[i], after[i]
                own = np.flatnonzero(np.append(True, piece[i[1:]] != piece[i[:-1]]))
                apply = r == np.repeat(np.minimum.reduceat(r, own), np.diff(np.append(own, len(i))))
                follows = np.append(False, (left[1:] == i[:-1]) & apply[1:] & apply[:-1])
                if follows.any():  # of pairs that overlap, as in "aaa", every second applies
                    heads = np.flatnonzero(~follows)
                    apply &= (np.arange(len(i)) - heads[np.cumsum(~follows) - 1]) % 2 == 0
                a, j = i[apply], right[apply]
                k = after[j]
                symbols[a], symbols[j], pair[j] = self._merged[r[apply]], -1, NONE
                after[a], before[k] = k, a
                after[n], before[n] = n, n
                made = np.concatenate([a, before[a]])
                made = made[made < n]
                beside = after[made]
                new = np.where(beside < n, self.ranks(symbols[made], symbols[beside]), NONE)
                pair[made] = new
                here = new < top
                todo = [i[~apply], made[here]]
                self._listed(places, made[~here], new[~here])
        alive = symbols[:n] >= 0
        cuts = 4 * np.cumsum(np.add.reduceat(alive, begins, dtype=np.int64))
        ids = symbols[:n][alive].astype("<u4").tobytes()
        return [ids[a:b] for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def _encode_long(self, data: bytes) -> bytes:
        """The same for one long piece: one list of positions for each rank, active ranks in a heap."""
        symbols = [self._single[x] for x in data]
        n = len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        places: dict[int, list[int]] = {}
        for i in range(n - 1):
            r = self._pairs.get(symbols[i] << 20 | symbols[i + 1])
            if r is not None:
                places.setdefault(r, []).append(i)
        active = sorted(places)
        while active:
            r = heappop(active)
            made = int(self._merged[r])
            for i in sorted(places.pop(r)):
                j = after[i]
                if j < 0 or symbols[i] < 0 or self._pairs.get(symbols[i] << 20 | symbols[j]) != r:
                    continue
                symbols[i], symbols[j] = made, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                for x, y in ((i, k), (before[i], i)):
                    if x >= 0 and y >= 0:
                        new = self._pairs.get(symbols[x] << 20 | symbols[y])
                        if new is not None:
                            if new not in places:
                                heappush(active, new)
                            places.setdefault(new, []).append(x)
        return np.array([x for x in symbols if x >= 0], "<u4").tobytes()

    @staticmethod
    def _listed(places: list[list[np.ndarray]], at: np.ndarray, ranks: np.ndarray) -> None:
        """Put positions into the lists of their ranks."""
        some = np.flatnonzero(ranks < NONE)
        at, band = at[some], ranks[some] // BAND
        order = np.argsort(band.astype(np.int16), kind="stable")
        at, band = at[order], band[order]
        cuts = np.flatnonzero(np.append(True, band[1:] != band[:-1])) if len(band) else band
        for b, x in zip(band[cuts].tolist(), np.split(at, cuts[1:]), strict=False):
            places[b].append(x)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, as little-endian unsigned 32-bit integers.

        A single blank between two characters that are no blanks always begins a token, so
        texts are cut there. A text with other blanks beside a cut goes to the pattern whole.
        """
        known, whole = self.words, {}
        cut: list[list] = []
        unknown: set[str] = set()
        for text in texts:
            spans = self.special.split(text) if self.special and any(x in text for x in self.specials) else [text]
            row: list = []
            for span in spans:
                if span in self.specials:
                    row.append(self.specials[span].to_bytes(4, "little"))
                elif span:
                    head, *rest = span.split(" ")
                    unknown.update(rest)
                    row.append((span, head, rest))
            cut.append(row)
        every = unknown
        unknown = every.difference(known)
        # of letters a to z alone: one token with the blank before it
        words = [p for p in unknown if p.isascii() and p.isalpha()]
        unknown.difference_update(words)
        fresh = self._after_blanks([p for p in unknown if not (p[0].isspace() or p[-1].isspace())])
        known.update(zip(words, self.encode_pieces([f" {p}" for p in words]), strict=True))
        known.update(dict.fromkeys(unknown))
        known.update(fresh)
        get = known.__getitem__
        # what stands before the first blank, and texts that can't be cut
        for row in cut:
            for k, x in enumerate(row):
                if not isinstance(x, bytes):
                    span, head, rest = x
                    try:
                        if rest and (not head or head[-1].isspace()):
                            raise TypeError
                        row[k] = (head, b"".join(map(get, rest)))
                    except TypeError:
                        row[k] = (span, b"")
                    whole[row[k][0]] = b""
        if len(known) > REMEMBERED:
            self.words = {p: known[p] for p in every} | {"": None}
        found = {x: self.find(x) for x in whole}
        tokens = list({q for qs in found.values() for q in qs})
        ids = dict(zip(tokens, self.encode_pieces(tokens), strict=True))
        for x, qs in found.items():
            whole[x] = b"".join([ids[q] for q in qs])
        return [b"".join([x if isinstance(x, bytes) else whole[x[0]] + x[1] for x in row]) for row in cut]

    def _after_blanks(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of parts with a blank before each. Only the first token of a part begins with a blank."""
        if not parts:
            return {}
        tokens = self.find(" " + " ".join(parts))
        distinct = list(dict.fromkeys(tokens))
        ids = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        coded = [ids[q] for q in tokens]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        first = np.array([q[0] == " " for q in tokens])
        begins = (np.cumsum(sizes) - sizes)[first].tolist()
        body = b"".join(coded)
        return {p: body[a:b] for p, a, b in zip(parts, begins, [*begins[1:], len(body)], strict=True)}

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids; bytes that are no text become the replacement character."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        lengths = self._lengths[i]
        total = int(lengths.sum())
        at = np.repeat(self._starts[i] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        raw = self._flat[at].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


_loaded: dict[str, PairIndexBpe] = {}


def tokenizer(path: str) -> PairIndexBpe:
    """The vocabulary of a file, read once in a worker."""
    if path not in _loaded:
        _loaded[path] = PairIndexBpe(path)
    return _loaded[path]


def encoded(batches: Iterator[pa.RecordBatch], column: str, path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Chunks of the batches with the ids of their texts; null counts as empty."""
    bpe = tokenizer(path)
    for chunk in chunks(batches, column, 4 << 20):
        yield chunk, bpe.encode([x or "" for x in chunk[column].to_pylist()])


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text, decode the ids again, and return ids, decoded text and digests.

    One output row per input row, in any order. A null or empty text has no ids and decodes
    to the empty text; repeated rows and ties give equal rows; a very long text is a chunk of
    its own, and a long run without a break in it one piece; a null id stays null; other
    columns, whatever their names, are left out; an empty table gives an empty table. Map
    only: no shuffle, memory bounded by one chunk of texts and the remembered pieces.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for chunk, ids in encoded(batches, "text", path):
            decoded = [bpe.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk["doc_id"],
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array([x.decode() for x in decoded], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids binary, decoded string, ids_sha256 string, decoded_sha256 string")


#: Parts that each bucket is dealt in.
PARTS = 4096


def pack_powers_of_two(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Split each document's ids into pieces of power-of-two lengths; a piece is a sequence.

    A document is its ids and `end_id` after them. It is cut into as many pieces of `length`
    (a power of two) as it fills and then by the binary digits of what is left, longest
    first. No sequence crosses documents and none is padded. Pieces of equal length share a
    bucket (log2 of the length): rows are dealt by bucket, in PARTS parts each, and stand
    bucket by bucket, so batches read in order hold sequences of one length. sequence_id counts
    within bucket and part by document and start; it doesn't depend on how the input is cut.

    One row per piece: doc_id, start, length, doc_tokens, ids (unless with_ids is off),
    ids_crc32 (of little-endian unsigned 32-bit ids), bucket, sequence_id, offset. A null or
    empty text is the one id `end_id`; a very long text is a chunk of its own, and its pieces
    are spread over the parts; repeated rows give their own pieces and sequences, and of rows
    that tie in everything either may come first; a null id stays null; other columns are left
    out; an empty table gives none.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids in encoded(batches, "text", path):
            n = np.array([len(x) // 4 + 1 for x in ids], np.int64)
            full = n // length
            tail = n - full * length
            sizes = []
            for f, t in zip(full.tolist(), tail.tolist(), strict=True):
                sizes.append([length] * f + [1 << k for k in range(t.bit_length() - 1, -1, -1) if t >> k & 1])
            pieces = np.array([len(s) for s in sizes], np.int64)
            lens = np.array([x for s in sizes for x in s], np.int64)
            at = np.cumsum(lens) - lens
            starts = at - np.repeat(np.cumsum(n) - n, pieces)
            doc = np.repeat(np.arange(len(ids)), pieces)
            body = end.join(ids) + end
            for a in range(0, len(lens), 4096):
                s = slice(a, a + 4096)
                cuts = np.append(at[s], at[s][-1:] + lens[s][-1:])
                part = memoryview(body)[4 * cuts[0] : 4 * cuts[-1]]
                cuts -= cuts[0]
                crc = [zlib.crc32(part[4 * x : 4 * y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                columns = [chunk["doc_id"].take(pa.array(doc[s])), pa.array(starts[s]), pa.array(lens[s]), pa.array(n[doc[s]]), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(np.frombuffer(part, "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    pieces = rows.mapInArrow(work, schema).withColumns({"bucket": F.log2("length").cast("int"), "part": F.pmod(F.xxhash64("doc_id", "start"), F.lit(PARTS))})
    number = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("doc_id", "start", "ids_crc32"))
    sequence = F.shiftleft(F.col("bucket").cast("long"), 52) + F.shiftleft("part", 40) + number - 1
    return pieces.select(*names, "bucket", sequence.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
