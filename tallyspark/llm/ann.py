"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each codebook;
codebooks are fitted one after the other to the residuals of a bounded sample
(``sample_rows``), and a vector's codes are found by a beam search over all of them. The
index holds codes, the norm of the approximation and the norm of what it misses.

Every query block is sent to all parts of the index: PARTS of them, or as many as the
cluster's cores need up to MOST_PARTS, whatever the number of rows or partitions. A task streams over one part, block by block, and keeps each query's ``k``
best so far, so it passes on ``k`` rows a query at most. Lookup tables of query and
codeword products give all approximate scores of a block; its candidates are all vectors
whose approximate score is no further below the query's ``k``-th best exact score than
DEVIATIONS times the error that such a miss usually makes (norms and dimension give it);
they are reranked by exact products in double precision. Where many vectors are about as
near, all of them are reranked; their number has no cap. A last step takes the ``k`` best
of the parts' ``k`` each.

Vectors that are null, zero, hold null or non-finite components, or differ in length from
most take no part; rows with null vec_id neither. Ties go to the smaller vec_id. Repeated
rows are candidates each (a query's own vec_id never), but ask once: of different vectors
with one vec_id the least, component by component, asks. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import batches, mix

BOOKS, WORDS, BEAM = 12, 256, 4
DEVIATIONS = 3.0
FIRST = 64
#: Parts of the index, at least and at most, which bound the rows that a query's search passes on.
PARTS, MOST_PARTS = 8, 256
#: Vectors that are scored at a time, and queries against them.
INDEX_BLOCK, QUERY_BLOCK = 1 << 12, 1 << 9
#: Queries that a task holds, about: each such group reads the index once.
QUERY_GROUP = 1 << 13
#: Exact products worked out at a time.
PAIRS = 1 << 15


class Quantiser:
    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)
        self.norms = (self.books**2).sum(axis=2)

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, books) and approximations (n, dim) by beam search over residuals."""
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        near = np.zeros_like(x)
        for at in range(0, len(x), 2048):
            codes[at : at + 2048], near[at : at + 2048] = self._encode(x[at : at + 2048], beam)
        return codes, near

    def _encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        residual, held = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
        error = (x**2).sum(axis=1)[:, None]
        row = np.arange(n)[:, None]
        for book, norms in zip(self.books, self.norms, strict=True):
            left = error[:, :, None] - 2 * (residual @ book.T) + norms
            flat = left.reshape(n, -1)
            m = min(beam, flat.shape[1])
            best = np.argpartition(flat, m - 1, axis=1)[:, :m]
            from_, word = np.divmod(best, len(book))
            error = flat[row, best]
            residual = residual[row, from_] - book[word]
            held = np.concatenate([held[row, from_], word[:, :, None].astype(np.uint8)], axis=2)
        best = error.argmin(axis=1)
        k = np.arange(n)
        return held[k, best], x - residual[k, best]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(books, words, queries) products."""
        return self.books @ queries.T


def fit(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 3) -> Quantiser:
    """k-means codebooks on successive residuals; fewer codewords where the sample is small."""
    rng = np.random.default_rng(seed)
    residual = sample.astype(np.float32).copy()
    found = np.zeros((books, words, sample.shape[1]), np.float32)
    for book in found:
        if not len(residual):
            continue
        book[:] = residual[rng.choice(len(residual), words, replace=len(residual) < words)]
        for _ in range(rounds):
            near = (-2 * (residual @ book.T) + (book**2).sum(axis=1)).argmin(axis=1)
            n = np.bincount(near, minlength=words)
            total = np.zeros_like(book)
            np.add.at(total, near, residual)
            book[n > 0] = total[n > 0] / n[n > 0, None]
        near = (-2 * (residual @ book.T) + (book**2).sum(axis=1)).argmin(axis=1)
        residual -= book[near]
    return Quantiser(found)


def usable(rows: DataFrame, every: int) -> tuple[DataFrame, int, int, int]:
    """(vec_id, vector) rows that take part, their dimension, their number and the number of those that ask; one count."""
    v = F.col("embedding").cast("array<double>")
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = kept.where(~bad & F.exists("vector", lambda x: x != 0))
    sizes = kept.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asked"))
    common = sizes.orderBy(F.desc("n"), "d").first()
    if not common:
        return kept, 0, 0, 0
    return kept.where(F.size("vector") == common.d), common.d, common.n, common.asked


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


_PACKED = ["part", "ids", "vectors", "codes", "norms", "missed"]


def _blocks(rows: DataFrame, dim: int, size: int, parts: int, model) -> DataFrame:
    """(part, ids, vectors, codes, norms, missed): rows where they are, dealt by a hash of vec_id, ``size`` or fewer to a block."""

    def block(part: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        codes, near = model.value.encode(x.astype(np.float32)) if model else (np.zeros(0, np.uint8), x[:0])
        missed = np.sqrt(((x - near) ** 2).sum(axis=1)) if model else np.zeros(0)
        norms = np.sqrt((near**2).sum(axis=1)).astype(np.float64)
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in (ids, x, codes, norms, missed.astype(np.float64))]], names=_PACKED)

    def pack(iterator):
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(parts)]
        for b in batches(iterator, ["vec_id", "vector"]):
            ids, x = b["vec_id"].to_numpy(), _matrix(b["vector"], dim)
            of = (mix(ids.view(np.uint64) + np.uint64(977)) % np.uint64(parts)).astype(np.int64)
            for part in np.unique(of).tolist():
                held[part].append((ids[of == part], x[of == part]))
                if sum(len(i) for i, _ in held[part]) >= size:
                    ids_, x_ = (np.concatenate(c) for c in zip(*held[part], strict=True))
                    for at in range(0, len(ids_) - size + 1, size):
                        yield block(part, ids_[at : at + size], x_[at : at + size])
                    rest = len(ids_) % size
                    held[part] = [(ids_[-rest:], x_[-rest:])] if rest else []
        for part, left in enumerate(held):
            if left:
                yield block(part, *(np.concatenate(c) for c in zip(*left, strict=True)))

    return rows.mapInArrow(pack, "part int, ids binary, vectors binary, codes binary, norms binary, missed binary")


class Search:
    """The ``k`` best of some queries over index blocks that come one after the other.

    The score is the inner product, or for ``l2`` the squared distance below 0; the latter's
    approximation takes the stored norms of the approximations.
    """

    def __init__(self, quantiser: Quantiser, queries: np.ndarray, query_ids: np.ndarray, k: int, metric: str = "ip"):
        order = np.argsort(query_ids, kind="stable")
        self.quantiser, self.queries, self.query_ids, self.k, self.metric = quantiser, queries[order], query_ids[order], k, metric
        self.size = np.sqrt((self.queries**2).sum(axis=1))
        self.score = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, missed: np.ndarray) -> None:
        """Takes an index block in."""
        for at in range(0, len(self.queries), QUERY_BLOCK):
            part = slice(at, at + QUERY_BLOCK)
            approx, slack = self._approximate(part, codes, norms, missed)
            own = self.query_ids[part, None] == ids[None, :]
            approx[own] = -np.inf
            m = min(max(FIRST, 2 * self.k), len(ids))
            first = np.argpartition(-approx, m - 1, axis=1)[:, :m]
            seen = np.zeros(approx.shape, bool)
            np.put_along_axis(seen, first, True, axis=1)
            seen &= ~own
            self._rerank(part, seen, ids, vectors)
            # then whatever may still be among the best
            self._rerank(part, (approx + slack >= self.score[part, -1][:, None]) & ~seen & ~own, ids, vectors)

    def _approximate(self, part: slice, codes: np.ndarray, norms: np.ndarray, missed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        queries, size = self.queries[part], self.size[part, None]
        approx = np.zeros((len(codes), len(queries)), np.float32)
        for table, code in zip(self.quantiser.tables(queries.astype(np.float32)), codes.T, strict=True):
            approx += table[code]
        approx = np.ascontiguousarray(approx.T)
        spread = (DEVIATIONS / np.sqrt(queries.shape[1])) * missed[None, :]
        if self.metric != "l2":
            return approx, (size * spread).astype(np.float32)
        approx = 2 * approx - (norms**2)[None, :] - size**2
        return approx, 2 * np.sqrt(np.maximum(-approx, 0)) * spread

    def _rerank(self, part: slice, chosen: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        of, at = np.nonzero(chosen)
        for begin in range(0, len(of), PAIRS):
            q, x = self.queries[part][of[begin : begin + PAIRS]], vectors[at[begin : begin + PAIRS]]
            exact = -((x - q) ** 2).sum(axis=1) if self.metric == "l2" else (x * q).sum(axis=1)
            self._merge(part.start + of[begin : begin + PAIRS], exact, ids[at[begin : begin + PAIRS]])

    def _merge(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(of)
        every = np.concatenate([np.repeat(rows, self.k), of])
        scores, names = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.ids[rows].ravel(), ids])
        order = np.lexsort((names, -scores, every))
        begins = np.searchsorted(every[order], rows)
        best = order[begins[:, None] + np.arange(self.k)]
        self.score[rows], self.ids[rows] = scores[best], names[best]

    def found(self) -> pa.RecordBatch:
        some = np.isfinite(self.score)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.query_ids, some.sum(axis=1))), pa.array(self.ids[some]), pa.array(self.score[some])], names=["query_id", "vec_id", "score"])


def nearest(rows: DataFrame, every: int = 20, k: int = 20, sample_rows: int = 8192, books: int = BOOKS, metric: str = "ip") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest, by inner product or ``l2``, of every row whose vec_id ``every`` divides."""
    spark = rows.sparkSession
    vectors, dim, n, n_asked = usable(rows, every)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coin = F.pmod(F.xxhash64("vec_id", F.lit(71)), F.lit(1 << 30)) / float(1 << 30)
    sample = vectors.where(coin < min(1.0, sample_rows / n)).select("vector").limit(2 * sample_rows)
    quantiser = fit(_sorted_rows(np.array([r.vector for r in sample.toLocalIterator()], np.float32).reshape(-1, dim)), books)
    model = spark.sparkContext.broadcast(quantiser)
    asked = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    groups = max(1, -(-n_asked // QUERY_GROUP))
    # as many parts as the cores need; a task that packs the index holds about as much whatever their number
    parts = max(PARTS, min(MOST_PARTS, -(-spark.sparkContext.defaultParallelism // groups)))
    # The stated queries against all rows: a query group goes to each part of the index, a block of the index to each query group.
    queries = _blocks(asked, dim, INDEX_BLOCK, groups, None).withColumnRenamed("part", "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    index = _blocks(vectors, dim, INDEX_BLOCK * PARTS // parts, parts, model).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    columns = ["group", "part", "late", "ids", "vectors", "codes", "norms", "missed"]
    met = queries.withColumn("late", F.lit(False)).select(columns).union(index.withColumn("late", F.lit(True)).select(columns))
    dealt = met.repartition(groups * parts, "group", "part").sortWithinPartitions("group", "part", "late")

    def search(iterator):
        key, state = None, None
        asked_: list[tuple[np.ndarray, np.ndarray]] = []
        block: list[tuple[np.ndarray, ...]] = []

        def take_in():
            nonlocal state
            if state is None and asked_:
                ids, x = (np.concatenate(c) for c in zip(*asked_, strict=True))
                state = Search(model.value, x, ids, k, metric)
            if block and state is not None:
                state.add(*(np.concatenate(c) for c in zip(*block, strict=True)))
            block.clear()

        for b in batches(iterator, columns):
            for group, part, late, ids, x, codes, norms, missed in zip(*(b[c] for c in columns), strict=True):
                if key != (group.as_py(), part.as_py()):
                    take_in()
                    if state is not None:
                        yield state.found()
                    key, state = (group.as_py(), part.as_py()), None
                    asked_.clear()
                ids, x = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(x.as_buffer(), np.float64).reshape(-1, dim)
                if not late.as_py():
                    asked_.append((ids, x))
                    continue
                block.append((ids, x, np.frombuffer(codes.as_buffer(), np.uint8).reshape(len(ids), -1), np.frombuffer(norms.as_buffer(), np.float64), np.frombuffer(missed.as_buffer(), np.float64)))
                if sum(len(i) for i, *_ in block) >= INDEX_BLOCK:
                    take_in()
        take_in()
        if state is not None:
            yield state.found()

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sorted_rows(x: np.ndarray) -> np.ndarray:
    """In an order that doesn't depend on how the rows arrived."""
    return x[np.lexsort(x.T)] if len(x) else x
