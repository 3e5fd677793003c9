"""Vector code compression: product codes whose codebooks come from delta-maintained Lloyd rounds.

Components become integers, floor(4096 x); vectors are cut into PARTS consecutive parts, and
each part position has a codebook of ENTRIES entries, at first those parts of the vectors with
the smallest vec_ids. A round assigns all parts to the nearest entry and moves each entry to
the floor of its parts' mean. Vectors are packed in blocks, a row each, which keep the codes
of the round before. A task finds the new codes of a block and writes them with the block and
with its deltas: for each entry that a changed part left or joined, what the block adds to
and takes from its count and sums. Only the deltas of blocks with changes are read back and
shuffled, summed by entry; the driver keeps running sums of PARTS * ENTRIES entries, whatever
the number of vectors. All arithmetic is in integers, so no order of work changes a result.

Each round's table is written before the next begins and the one before it goes, so a lost
executor costs a part of a round and two copies of the packed integers exist at most (16 bits
a component where a block's components allow it, else 32).

Rows take no part if their vector is null or holds null or non-finite components, or if its
length differs from that of most others (ties: the shorter). If the length is no multiple of
PARTS the parts differ by one component at most. Components beyond REACH count as REACH, so
that sums stay exact. Of repeated vec_ids one entry starts (the least vector); null vec_ids
come last. With fewer distinct vec_ids than ENTRIES the codebooks are as much shorter.
Repeated rows are coded each. An empty table gives no rows. Other columns than vec_id,
embedding and label are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import batches
from .saved import drop, saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Integer components beyond this count as this: 16,384 before scaling.
REACH = 1 << 26
#: Vectors of a block.
BLOCK = 1 << 12
#: Distances worked out at a time.
CELLS = 1 << 20

_DELTA = "struct<part: int, entry: int, n: bigint, sums: array<bigint>>"


class Codebooks:
    """Entries as integers, by part an (entries, width) matrix, with their parts' running counts and sums."""

    def __init__(self, seeds: np.ndarray, parts: int):
        cuts = [seeds.shape[1] * k // parts for k in range(parts + 1)]
        self.spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        self.entries = [seeds[:, a:b].copy() for a, b in self.spans]
        self.sums = [np.zeros_like(e) for e in self.entries]
        self.counts = np.zeros((parts, len(seeds)), np.int64)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, parts) and summed squared distances; the lower index among ties."""
        codes, errors = np.zeros((len(vectors), len(self.spans)), np.uint8), np.zeros(len(vectors), np.int64)
        step = max(1, CELLS // max(self.counts.shape[1] * vectors.shape[1], 1))
        for at in range(0, len(vectors), step):
            rows = vectors[at : at + step]
            for part, ((a, b), book) in enumerate(zip(self.spans, self.entries, strict=True)):
                far = ((rows[:, None, a:b] - book) ** 2).sum(axis=2)
                near = far.argmin(axis=1)
                codes[at : at + step, part] = near
                errors[at : at + step] += far[np.arange(len(rows)), near]
        return codes, errors

    def deltas(self, vectors: np.ndarray, before: np.ndarray | None, after: np.ndarray) -> list[dict]:
        """What the parts whose code changed take from their old entries and add to their new ones."""
        found = []
        for part, (a, b) in enumerate(self.spans):
            moved = np.arange(len(vectors)) if before is None else np.flatnonzero(before[:, part] != after[:, part])
            if not len(moved):
                continue
            counts, sums = np.zeros(self.counts.shape[1], np.int64), np.zeros((self.counts.shape[1], b - a), np.int64)
            touched = np.zeros(self.counts.shape[1], bool)
            for sign, codes in ((1, after), (-1, before)):
                if codes is not None:
                    of = codes[moved, part]
                    touched[of] = True
                    np.add.at(counts, of, sign)
                    np.add.at(sums, of, sign * vectors[moved, a:b])
            found += [{"part": part, "entry": int(e), "n": int(counts[e]), "sums": sums[e].tolist()} for e in np.flatnonzero(touched)]
        return found

    def add(self, part: int, entry: int, n: int, sums: list[int]) -> None:
        self.counts[part, entry] += n
        self.sums[part][entry] += np.array(sums, np.int64)

    def move(self) -> None:
        """Every used entry goes to the floor of its parts' mean."""
        for part, book in enumerate(self.entries):
            used = self.counts[part] > 0
            book[used] = self.sums[part][used] // self.counts[part][used, None]

    def digest(self) -> str:
        """Of all components in decimal, by part, entry and place."""
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()


def usable(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, vector) of rows that take part, and their dimension; one count of lengths."""
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = kept.where(F.col("vector").isNotNull() & ~bad)
    common = kept.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return (kept.where(F.size("vector") == common.d), common.d) if common else (kept, 0)


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.clip(np.floor(vectors * scale), -REACH, REACH).astype(np.int64)


def _matrix(column: pa.Array, dim: int, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, dim)


def first_entries(kept: DataFrame, dim: int, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray:
    """The integer vectors of the smallest vec_ids, in their order: ``entries`` rows at most."""
    order = F.col("vec_id").asc_nulls_last()
    ids = [r.vec_id for r in kept.select("vec_id").distinct().orderBy(order).limit(entries).collect()]
    among = F.col("vec_id").isin([i for i in ids if i is not None])
    if None in ids:
        among = among | F.col("vec_id").isNull()
    seeds = kept.where(among).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy(order).collect()
    return integers(np.array([r.vector for r in seeds], np.float64).reshape(len(seeds), dim), scale)


def packed(kept: DataFrame, dim: int, scale: int = SCALE) -> DataFrame:
    """Blocks of vectors: (ids, labels, wide, vectors), the integers as bytes of 16 or 32 bits."""
    label = kept.schema["label"].dataType.simpleString()

    def block(held: list[tuple[pa.Array, pa.Array, np.ndarray]]) -> pa.RecordBatch:
        ids, labels = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
        ints = np.concatenate([h[2] for h in held])
        wide = bool(len(ints) and ints.size and np.abs(ints).max() >= 1 << 15)
        ends = pa.array([0, len(ids)], pa.int32())
        columns = [pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels), pa.array([wide]), pa.array([ints.astype(np.int32 if wide else np.int16).tobytes()])]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "wide", "vectors"])

    def work(iterator):
        held, n = [], 0
        for got in batches(iterator, ["vec_id", "label", "vector"]):
            size = len(got["vec_id"])
            ints = integers(_matrix(got["vector"], dim, size), scale)
            for at in range(0, size, BLOCK):
                held.append((got["vec_id"][at : at + BLOCK], got["label"][at : at + BLOCK], ints[at : at + BLOCK]))
                n += len(held[-1][0])
                if n >= BLOCK:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return kept.select("vec_id", "label", "vector").mapInArrow(work, f"ids array<long>, labels array<{label}>, wide boolean, vectors binary")


def _vectors(wide: bool, raw: bytes, dim: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if wide else np.int16).reshape(rows, dim).astype(np.int64)


_PACKED = ["ids", "labels", "wide", "vectors"]


def reassigned(blocks: DataFrame, books: Codebooks, dim: int) -> DataFrame:
    """The blocks with their new codes and the deltas against the codes that they had."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    coded = "codes" in blocks.columns
    fields = [blocks.schema[c] for c in _PACKED]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + f", codes binary, deltas array<{_DELTA}>"
    deltas = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    def work(iterator):
        books = shared.value
        for got in batches(iterator, [*_PACKED, *(["codes"] if coded else [])]):
            for k in range(len(got["wide"])):
                rows = len(got["ids"][k])
                vectors = _vectors(got["wide"][k].as_py(), got["vectors"][k].as_py(), dim, rows)
                before = np.frombuffer(got["codes"][k].as_py(), np.uint8).reshape(rows, -1) if coded else None
                codes, _ = books.assign(vectors)
                columns = [got[c][k : k + 1] for c in _PACKED]
                columns += [pa.array([codes.tobytes()]), pa.array([books.deltas(vectors, before, codes)], deltas)]
                yield pa.RecordBatch.from_arrays(columns, names=[*_PACKED, "codes", "deltas"])

    return blocks.select(*_PACKED, *(["codes"] if coded else [])).mapInArrow(work, schema)


def _take_deltas(blocks: DataFrame, books: Codebooks) -> int:
    """Adds the deltas that the blocks hold, summed by entry; the number of entries that changed."""
    delta = blocks.where(F.size("deltas") > 0).select(F.explode("deltas").alias("d")).select("d.part", "d.entry", "d.n", F.posexplode_outer("d.sums").alias("place", "x"))
    sums = delta.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = sums.groupBy("part", "entry").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "x"))).alias("sums"))
    rows = whole.collect()
    for r in rows:
        books.add(r.part, r.entry, r.n, [s.x for s in r.sums if s.place is not None])
    return len(rows)


def fitted(kept: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """The packed blocks, as last written, and the codebooks after ``rounds`` rounds."""
    books = Codebooks(first_entries(kept, dim, entries, scale), parts)
    blocks = saved(packed(kept, dim, scale))
    for _ in range(rounds):
        last, blocks = blocks, saved(reassigned(blocks, books, dim))
        drop(last)
        if not _take_deltas(blocks, books):
            break  # no part changed its entry, so none ever will
        books.move()
    return blocks, books


def decoded(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """(vec_id, approximation): the vectors that the codes stand for."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def work(iterator):
        for got in batches(iterator, ["vec_id", "code"]):
            digits = np.frombuffer(bytes.fromhex("".join(got["code"].to_pylist())), np.uint8).reshape(len(got["code"]), -1)
            near = np.concatenate([book[digits[:, part]] for part, book in enumerate(shared.value.entries)], axis=1) / scale
            yield pa.RecordBatch.from_arrays([got["vec_id"], pa.array(list(near), pa.list_(pa.float64()))], names=["vec_id", "approximation"])

    return codes.select("vec_id", "code").mapInArrow(work, "vec_id long, approximation array<double>")


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of the rows that take part, and the codebooks (None without such rows)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    kept, dim = usable(rows)
    label = kept.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    blocks, books = fitted(kept, dim, parts, entries, rounds, scale)
    if not books.counts.shape[1]:
        drop(blocks)
        return rows.sparkSession.createDataFrame([], schema), None
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def work(iterator):
        for got in batches(iterator, _PACKED):
            for k in range(len(got["wide"])):
                ids, labels = got["ids"][k].values, got["labels"][k].values
                codes, errors = shared.value.assign(_vectors(got["wide"][k].as_py(), got["vectors"][k].as_py(), dim, len(ids)))
                digits = codes.tobytes().hex()
                width = 2 * codes.shape[1]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([digits[j * width : (j + 1) * width] for j in range(len(ids))]), pa.array(errors)], names=["vec_id", "label", "code", "error"])

    found = saved(blocks.select(*_PACKED).mapInArrow(work, schema))
    drop(blocks)
    return found, books


def code_report(rows: DataFrame, **how) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): codes with the error of their whole label."""
    found, books = vector_codes(rows, **how)
    by_label = saved(found.groupBy("label").agg(F.sum("error").alias("label_error")))
    of = by_label.select(F.col("label").alias("same"), "label_error")
    digest = F.lit(books.digest() if books else None).cast("string")
    return found.join(of, found["label"].eqNullSafe(of["same"]), "left").select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
