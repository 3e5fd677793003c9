"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: text with A-Z lower-cased, words, 3-word shingles with repeats, XXH64
(seed 42) of each; a bit is set if over half of the hashes have it. Fewer words: the
whole sequence is the one shingle. No words, or null text: fingerprint zero.

Distinct fingerprints are put in cells by the bit counts of their four 16-bit parts.
Two fingerprints that differ in r bits have part counts that differ by r or less in sum,
so only cells that near are compared; a cell's fingerprints are dealt into tiles of
bounded size, and each tile meets each near fingerprint once, by exclusive-or and bit
counts of small blocks. A large tile means that a fingerprint is sent to few of them. A
comparison task passes on links that join what it hasn't joined yet, never all
pairs of a group. Components then follow from the links of distinct fingerprints.

Exact copies, ties and repeated rows share a fingerprint and so a component. Rows with
null doc_id take part; a component of such rows alone has a null component_id. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import spread
from .arrays import LOWER, as_bytes, batches, fresh, release, small_batches
from .components import connected_components
from .saved import saved

SHINGLE = 3
SEED = 42
PARTS = 4
#: Fingerprints of a tile: half a megabyte.
TILE = 1 << 16
#: Fingerprints compared with each other at a time.
NEAR_BLOCK, HOME_BLOCK = 512, 2048
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16


def shingle_hashes(text: bytes | None) -> np.ndarray:
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: -SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - SHINGLE + 1)


def fingerprint(text: bytes | None) -> int:
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        ones += np.unpackbits(hashes[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def text_key(text: Column) -> Column:
    """A hash that tells texts apart which share a fingerprint; null and empty text are two."""
    return F.xxhash64(text.cast("string"), F.lit(83))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp): fp is the 64-bit fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(iterator):
        for b in batches(iterator, ["doc_id", "text_key", "text"]):
            fps = np.array([fingerprint(t) for t in as_bytes(b["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_key"], pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])
            release()

    rows = spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _cell(fp):
    """Bit counts of the parts, 8 bits each, as one number."""
    width = 64 // PARTS
    mask = (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit(mask))).cast("long") for k in range(PARTS)]
    return sum((c * (1 << (8 * k)) for k, c in enumerate(counts[1:], 1)), counts[0])


def near_offsets(radius: int) -> list[int]:
    """Differences of cell numbers of cells within the radius, one of each opposite two, the cell itself first."""
    found = [()]
    for _ in range(PARTS):
        found = [x + (d,) for x in found for d in range(-radius, radius + 1) if sum(map(abs, x)) + abs(d) <= radius]
    half = [x for x in found if x > (0,) * PARTS]
    return [0] + [sum(d << (8 * k) for k, d in enumerate(x)) for x in half]


class _Tile:
    """A tile's fingerprints, and which of them the links passed on so far have joined: ``up`` leads each to its group's root."""

    def __init__(self):
        self.home = np.empty(0, np.uint64)
        self.up = np.empty(0, np.int64)

    def add(self, fps: np.ndarray) -> None:
        self.up = np.concatenate([self.up, np.arange(len(self.home), len(self.home) + len(fps))])
        self.home = np.concatenate([self.home, fps])

    def _roots(self, at: np.ndarray) -> np.ndarray:
        root = self.up[at]
        while (higher := self.up[root] != root).any():
            root[higher] = self.up[root[higher]]
        self.up[at] = root
        return root

    def links(self, near: np.ndarray, radius: int) -> list[tuple[int, int]]:
        """Links of ``near`` to the tile: one for each that is near any, and those that join parts of the tile."""
        out: list[tuple[int, int]] = []
        for at in range(0, len(near), NEAR_BLOCK):
            block = near[at : at + NEAR_BLOCK]
            hits = [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for begin in range(0, len(self.home), HOME_BLOCK):
                of, home = np.nonzero(np.bitwise_count(block[:, None] ^ self.home[None, begin : begin + HOME_BLOCK]) <= radius)
                hits.append((of, home + begin))
            of, home = (np.concatenate(c) for c in zip(*hits, strict=True))
            order = np.argsort(of, kind="stable")
            of, home = of[order], home[order]
            edges = np.flatnonzero(np.diff(of)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(of)], strict=True) if len(of) else ():
                fp, own = int(block[of[begin]]), home[begin:end]
                roots, which = np.unique(self._roots(own), return_index=True)
                out += [(fp, int(self.home[own[k]])) for k in (which if len(roots) > 1 else [0])]
                self.up[roots] = roots[0]
        return [(a, b) for a, b in out if a != b]


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough to join whatever is within the radius."""
    cells = fps.select("fp", _cell(F.col("fp")).alias("cell"))
    tiles = cells.groupBy("cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    homes = cells.join(tiles, "cell").select("cell", F.pmod(F.xxhash64("fp"), F.col("tiles").cast("long")).cast("int").alias("tile"), "fp", F.lit(0).alias("visits"))
    offsets = F.array(*[F.lit(d).cast("long") for d in near_offsets(radius)])
    visits = cells.select("fp", F.explode(offsets).alias("by"), "cell").select("fp", (F.col("cell") + F.col("by")).alias("cell"))
    visits = visits.join(tiles, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), "fp", F.lit(1).alias("visits"))
    met = homes.unionByName(visits).repartition("cell", "tile").sortWithinPartitions("cell", "tile", "visits")

    def compare(iterator):
        key, tile_ = None, _Tile()
        for b in batches(iterator, ["cell", "tile", "fp", "visits"]):
            cell, tile, fp, visit = (b[c].to_numpy() for c in ("cell", "tile", "fp", "visits"))
            fp = fp.view(np.uint64)
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(tile) != 0)) + 1
            out: list[tuple[int, int]] = []
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(fp)], strict=True):
                if key != (cell[begin], tile[begin]):
                    key, tile_ = (cell[begin], tile[begin]), _Tile()
                own = visit[begin:end] == 0
                tile_.add(fp[begin:end][own])
                out += tile_.links(fp[begin:end][~own], radius)
            if out:
                ab = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def _rooted(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) of every row, and (fp, root, component_id) of every fingerprint."""
    prints = saved(fingerprints(docs))
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = saved(connected_components(fingerprint_links(distinct.select("fp"), radius)))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicate_components(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id and root (the component's least fingerprint) for every row of (doc_id, text)."""
    prints, of = _rooted(docs, radius)
    return prints.join(of, "fp").select("doc_id", "fp", "component_id", "root")


def one_per_component(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component exactly one row.

    It is the row with the least doc_id; of rows that share it, the one of the least
    fingerprint and then text hash; of equal rows, any. A row without doc_id stays only
    where its component has no id at all.
    """
    prints, of = _rooted(docs, radius)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "text_key")
    each = prints.groupBy("doc_id", "text_key", "fp").agg(F.count("*").alias("n"))
    best = each.join(of, "fp").groupBy("root").agg(F.min_by(F.struct("doc_id", "text_key", "n"), order).alias("best"))
    own_id, own_key, rows = fresh(docs, "kept_id"), fresh(docs, "kept_key"), fresh(docs, "kept_rows")
    kept = saved(best.select(F.col("best.doc_id").alias(own_id), F.col("best.text_key").alias(own_key), F.col("best.n").alias(rows)))
    # the keys are hashed and the texts stream past them, so no task sorts whole texts
    met = docs.join(kept.hint("shuffle_hash"), docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)) & (text_key(docs["text"]) == F.col(own_key)))
    if kept.where(F.col(rows) > 1).isEmpty():
        return met.select(*docs.columns)
    again = met.where(F.col(rows) > 1).dropDuplicates([own_id, own_key])
    return met.where(F.col(rows) == 1).select(*docs.columns).unionByName(again.select(*docs.columns))
