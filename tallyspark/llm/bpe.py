"""Byte-level BPE, encoding and decoding, by numpy merges of many pieces at once.

A text is split by the tokenizer's pattern; each distinct piece of a batch is encoded
once. Pieces of like length form a padded matrix of token ids. Every round looks up all
adjacent pairs of all rows in a hash table of ranks, merges in each row the leftmost pair
of least rank, and moves the rest of the row up, until no row has a pair left. Pieces
beyond LONG bytes, for which a matrix would cost the square of their length, go through a
heap of pairs instead, with the same result.

Null or empty text: no tokens. Repeated rows are encoded each; ties of rank are merged
leftmost first; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread
from .arrays import batches, mix, release, slices, small_batches

NO_RANK = np.int32(2**31 - 1)
LONG = 256
#: Matrix cells worked on at once.
CELLS = 1 << 19
#: Pieces that a worker remembers between batches.
REMEMBERED = 150_000


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder of one rank file (lines of base64 bytes and rank) and pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.decimal = {r: str(r) for r in self.tokens}
        self.byte_rank = np.array([self.ranks[bytes([k])] for k in range(256)], np.int32)
        self._build_pairs()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.said: dict[str, tuple[int, str, bytes]] = {}

    def _build_pairs(self) -> None:
        """Open-addressing table from a pair of ids to the id of both joined."""
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        size = 1 << (2 * len(keys)).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.made = np.full(size, NO_RANK, np.int32)
        slot = mix(keys) & self.mask
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            _, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slot[placed]] = keys[placed]
            self.made[slot[placed]] = np.array(made, np.int32)[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair joined; NO_RANK where there is none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = mix(keys) & self.mask
        found = self.keys[slot]
        out = np.where(found == keys, self.made[slot], NO_RANK)
        on = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(on):
            slot[on] = (slot[on] + np.uint64(1)) & self.mask
            found = self.keys[slot[on]]
            hit = found == keys[on]
            out[on[hit]] = self.made[slot[on[hit]]]
            on = on[~hit & (found != np.uint64(2**64 - 1))]
        return out

    def _encode_matrix(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Pieces of one length bucket."""
        length = np.array([len(p) for p in pieces])
        ids = np.zeros((len(pieces), int(length.max())), np.int32)
        inside = np.arange(ids.shape[1]) < length[:, None]
        ids[inside] = self.byte_rank[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(ids.shape, NO_RANK, np.int32)
        if ids.shape[1] > 1:
            both = inside[:, 1:]
            ranks[:, :-1][both] = self.pair_ranks(ids[:, :-1][both], ids[:, 1:][both])
        done: list[tuple[int, ...]] = [()] * len(pieces)
        rows = np.arange(len(pieces))
        column = np.arange(ids.shape[1])
        while len(rows):
            at = ranks.argmin(axis=1)
            k = np.arange(len(rows))
            least = ranks[k, at]
            ended = least == NO_RANK
            if ended.any():
                for r, row, n in zip(rows[ended].tolist(), ids[ended].tolist(), length[ended].tolist(), strict=True):
                    done[r] = tuple(row[:n])
                on = ~ended
                rows, ids, ranks, length, at, least = rows[on], ids[on], ranks[on], length[on], at[on], least[on]
                if not len(rows):
                    break
                widest = int(length.max())
                ids, ranks, column = ids[:, :widest], ranks[:, :widest], column[:widest]
                k = np.arange(len(rows))
            # merge at ``at`` and move what follows up by one
            source = np.minimum(column + (column > at[:, None]), len(column) - 1)
            ids = np.take_along_axis(ids, source, 1)
            ranks = np.take_along_axis(ranks, source, 1)
            ids[k, at] = least
            length = length - 1
            ranks[k, np.maximum(length - 1, 0)] = NO_RANK
            for where, inner in ((at - 1, at > 0), (at, at + 1 < length)):
                r, c = k[inner], where[inner]
                ranks[r, c] = self.pair_ranks(ids[r, c], ids[r, c + 1])
        return done

    def _encode_long(self, piece: bytes) -> tuple[int, ...]:
        ids = self.byte_rank[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        rank = self.pair_ranks(ids[:-1], ids[1:])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        heap = [(int(rank[k]), k, int(ids[k]), int(ids[k + 1])) for k in np.flatnonzero(rank != NO_RANK).tolist()]
        heapq.heapify(heap)
        ids = ids.copy()
        while heap:
            made, k, a, b = heapq.heappop(heap)
            nxt = int(after[k])
            if ids[k] != a or nxt >= n or ids[nxt] != b:
                continue
            ids[k], ids[nxt] = made, -1
            after[k] = nxt2 = int(after[nxt])
            if nxt2 < n:
                before[nxt2] = k
            for i, j in ((int(before[k]), k), (k, nxt2)):
                if i >= 0 and j < n:
                    r = int(self.pair_ranks(ids[i : i + 1], ids[j : j + 1])[0])
                    if r != NO_RANK:
                        heapq.heappush(heap, (r, i, int(ids[i]), int(ids[j])))
        return tuple(ids[ids >= 0].tolist())

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece, by matrices of pieces of like length."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if len(p) > LONG:
                out[k] = self._encode_long(p)
            elif p:
                n = len(p)
                buckets.setdefault(n if n <= 16 else 1 << (n - 1).bit_length(), []).append(k)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for k, ids in zip(part, self._encode_matrix([pieces[k] for k in part]), strict=True):
                    out[k] = ids
        return out

    def split(self, texts: list[str | None]) -> list[list[str]]:
        """The pieces of each text, whose ids are in ``pieces`` afterwards."""
        found = [self.pattern.findall(t) if t else [] for t in texts]
        known = self.pieces
        if len(known) > REMEMBERED:
            known.clear()
            self.said.clear()
        new = list(set().union(*found) - known.keys())
        known.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        return found

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        known = self.pieces
        return [[i for p in pieces for i in known[p]] for pieces in self.split(texts)]

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Of each text the number of ids, the hash of these in decimal, and the hash of what they decode to.

        Ids are written out, and decoded, once for each distinct piece: texts are their pieces' one after the other.
        """
        split, known, said = self.split(texts), self.pieces, self.said
        for p in set().union(*split) - said.keys():
            ids = known[p]
            said[p] = len(ids), " ".join([self.decimal[i] for i in ids]), self.decode(ids)
        out = []
        for pieces in split:
            of = [said[p] for p in pieces]
            n, decimal, data = zip(*of, strict=True) if of else ((), (), ())
            out.append((sum(n), hashlib.sha256(" ".join(decimal).encode()).hexdigest(), hashlib.sha256(b"".join(data)).hexdigest()))
        return out

    def decode(self, ids: list[int] | tuple[int, ...]) -> bytes:
        token = self.tokens
        return b"".join([token[i] for i in ids])


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """The codec of this process for a rank file: built once per worker."""
    key = hashlib.sha256(rank_file).hexdigest(), pattern
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def _sent(spark: SparkSession, path: str):
    """The rank file, read by the driver and broadcast: its size is fixed by the vocabulary."""
    return spark.sparkContext.broadcast(read_ranks(path))


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_column(spark: SparkSession, path: str, pattern: str):
    """A function of a text column that gives array<int> of ids."""
    sent = _sent(spark, path)

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        own = codec(sent.value, pattern)
        return pa.array(own.encode(text.to_pylist()), pa.list_(pa.int32()))

    return encode


def decode_column(spark: SparkSession, path: str, pattern: str):
    """A function of an array<int> column that gives the decoded bytes."""
    sent = _sent(spark, path)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        own = codec(sent.value, pattern)
        return pa.array([None if x is None else own.decode(x) for x in ids.to_pylist()], pa.binary())

    return decode


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row: encoded, then decoded from the ids."""
    small_batches(docs.sparkSession)
    sent = _sent(docs.sparkSession, path)

    def run(iterator):
        own = codec(sent.value, pattern)
        for b in batches(iterator, ["doc_id", "text"]):
            texts = b["text"].to_pylist()
            for s in slices(texts, 2 << 20):
                columns = list(zip(*own.digests(texts[s]), strict=True))
                yield pa.RecordBatch.from_arrays([b["doc_id"][s], *(pa.array(c, f.type) for c, f in zip(columns, list(_DIGESTS)[1:], strict=True))], schema=_DIGESTS)
                release()

    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
