"""Spelling variants: words one edit apart, each led to its far more frequent form.

Words are maximal runs of the letters ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, counted
over whole texts. Every distinct deletion, replacement and insertion of a word over the
letters that the vocabulary holds is emitted as a 128-bit hash, worked out from running sums
of the word's own letters; whatever meets the vocabulary in a hash join is a near word, and
no distance is verified. A filter of the vocabulary's hashes, of FILTER_BITS at most whatever
the vocabulary, is broadcast and stops nearly all emitted hashes that are no word before the
shuffle; past its size it stops fewer, never a word.

A word's candidates are about twice its length times the letters, so no key of the joins is
hot. Forms grow by ``ratio`` at least with every step, so a chain's length is bounded by the
logarithm of the largest count, and roots follow in the logarithm of that by pointer doubling.

A null text has no words; a null doc_id is written as an empty one in the planted check. Rows
count each, repeated ones too. Of near words with the same count the smallest in code-point
order is the form. Runs of any length are words: long ones are worked through by pieces. An
empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import spread
from .arrays import batches, mix
from .lines import lowered
from .saved import saved

RUN = "[A-Za-zÀ-ÿ]+"
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: The most that the filter takes: 32 MB.
FILTER_BITS = 1 << 28
BITS_A_WORD = 24
#: Candidates worked out at a time.
CELLS = 1 << 19
#: Words of a task, about.
TASK_WORDS = 20_000

_RNG = np.random.default_rng(20240307)
#: Two independent hashes: values of the letters (Latin-1) and the base of their powers, all odd.
_VALUES = _RNG.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(np.uint64(pow(b, -1, 2**64)) for b in _BASES)
_PROBES = np.array([1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def counted_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, planted_every: int = 0) -> DataFrame:
    """(word, n) of words long and frequent enough.

    With ``planted_every`` a word loses one letter where that number divides the crc32 of
    ``<doc_id>:<word>``; the crc32 modulo the word's length says which.
    """
    runs = spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.where(F.length("run") >= least_chars).select("doc_id", lowered(F.col("run")).alias("word"))
    if planted_every:
        words = words.withColumn("h", F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("word"))))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(F.col("h") % planted_every == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _powers(which: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), np.uint64(_BASES[which]))
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and letters (rows, length) of words of equal length, CELLS letters at a time."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        step = max(1, CELLS // max(int(size), 1))
        for at in range(0, len(places), step):
            of = places[at : at + step]
            yield of, np.frombuffer(b"".join(words[k] for k in of), np.uint8).reshape(len(of), size)


def _sums(which: int, letters: np.ndarray) -> np.ndarray:
    """(rows, length + 1) running sums of the letters' values times the powers of their places."""
    sums = np.zeros((len(letters), letters.shape[1] + 1), np.uint64)
    np.cumsum(_VALUES[which][letters] * _powers(which, letters.shape[1]), axis=1, out=sums[:, 1:])
    return sums


def _finished(sums: np.ndarray, size: int) -> np.ndarray:
    return mix(sums + np.uint64(size))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """(2, words) hashes of words in Latin-1."""
    found = np.zeros((2, len(words)), np.uint64)
    with np.errstate(over="ignore"):
        for of, letters in _by_length(words):
            for which in (0, 1):
                found[which, of] = _finished(_sums(which, letters)[:, -1], letters.shape[1])
    return found


def _deleted(which: int, sums: np.ndarray, row, at) -> np.ndarray:
    return sums[row, at] + (sums[row, -1] - sums[row, at + 1]) * _INVERSES[which]


def _replaced(which: int, sums: np.ndarray, row, at, letter) -> np.ndarray:
    return sums[row, at] + _VALUES[which][letter] * _powers(which, sums.shape[1])[at] + sums[row, -1] - sums[row, at + 1]


def _inserted(which: int, sums: np.ndarray, row, at, letter) -> np.ndarray:
    return sums[row, at] + _VALUES[which][letter] * _powers(which, sums.shape[1])[at] + (sums[row, -1] - sums[row, at]) * np.uint64(_BASES[which])


def neighbourhood(letters: np.ndarray, alphabet: np.ndarray, passes=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, hash, second hash) of all distinct words one edit from each row that ``passes`` by the first hash.

    Of equal neighbours one is emitted: a deletion where the letter differs from the one
    before, a replacement by another letter, an insertion of another letter than the one before.
    """
    n, size = letters.shape
    sums = [_sums(which, letters) for which in (0, 1)]
    step = max(1, CELLS // max(n * len(alphabet), 1))
    rows = np.arange(n)[:, None, None]
    ways = ((_deleted, size, size - 1), (_replaced, size, size), (_inserted, size + 1, size + 1))
    for way, places, length in ways:
        for begin in range(0, places, step):
            at = np.arange(begin, min(begin + step, places))[None, :, None]
            before = letters[:, np.maximum(at[0, :, 0] - 1, 0)][:, :, None]
            if way is _deleted:
                given, valid = (), (at == 0) | (before != letters[:, at[0, :, 0]][:, :, None])
            elif way is _replaced:
                given, valid = (alphabet[None, None, :],), letters[:, at[0, :, 0]][:, :, None] != alphabet
            else:
                given, valid = (alphabet[None, None, :],), (at == 0) | (before != alphabet)
            first = _finished(way(0, sums[0], rows, at, *given), length)
            kept = valid if passes is None else valid & passes(first)
            row, place, letter = np.nonzero(np.broadcast_to(kept, first.shape))
            given = (alphabet[letter],) if given else ()
            second = _finished(way(1, sums[1], row, at[0, place, 0], *given), length)
            yield row, first[row, place, letter], second


def _places(hashes: np.ndarray, bits: int, probe: int) -> np.ndarray:
    return (hashes * _PROBES[probe]) >> np.uint64(64 - int(bits).bit_length() + 1)


def in_filter(words: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash passes the filter, given as 64-bit words."""
    flat = hashes.ravel()
    left = np.arange(len(flat))
    for probe in range(len(_PROBES)):
        at = _places(flat[left], bits, probe)
        left = left[(words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    found = np.zeros(len(flat), bool)
    found[left] = True
    return found.reshape(hashes.shape)


def _signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _latin(column: pa.Array) -> list[bytes]:
    return [w.encode("latin-1") for w in column.to_pylist()]


def _with_hashes(words: DataFrame) -> DataFrame:
    def work(iterator):
        for held in batches(iterator, ["word", "n"]):
            first, second = word_hashes(_latin(held["word"]))
            yield pa.RecordBatch.from_arrays([held["word"], held["n"], _signed(first), _signed(second)], names=["word", "n", "h1", "h2"])

    return words.select("word", "n").mapInArrow(work, "word string, n long, h1 long, h2 long")


def vocabulary_filter(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """The filter's 64-bit words: set by tasks, united by Spark; ``bits`` / 64 rows at most come back."""

    def work(iterator):
        for held in batches(iterator, ["h1"]):
            hashes = held["h1"].to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_places(hashes, bits, probe) for probe in range(len(_PROBES))]))
            block, begin = np.unique(at >> np.uint64(6), return_index=True)
            ones = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), begin)
            yield pa.RecordBatch.from_arrays([_signed(block), _signed(ones)], names=["block", "ones"])

    parts = vocabulary.select("h1").mapInArrow(work, "block long, ones long")
    table = parts.groupBy("block").agg(F.bit_or("ones").alias("ones")).toArrow()
    words = np.zeros(max(bits // 64, 1), np.uint64)
    words[table["block"].to_numpy()] = table["ones"].to_numpy().view(np.uint64)
    return words


def near_candidates(vocabulary: DataFrame, alphabet: bytes, bits: int, n_words: int) -> DataFrame:
    """(w1, w2, h1, h2): each word's hashes with those of its neighbours that pass the filter."""
    spark = vocabulary.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary_filter(vocabulary, bits))
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(n_words / TASK_WORDS))

    def work(iterator):
        letters_of = np.frombuffer(alphabet, np.uint8)
        words = shared.value
        with np.errstate(over="ignore"):
            for held in batches(iterator, ["word", "h1", "h2"]):
                own = [held[c].to_numpy() for c in ("h1", "h2")]
                for of, letters in _by_length(_latin(held["word"])):
                    step = max(1, CELLS // max(letters.shape[1] * len(letters_of), 1))
                    for at in range(0, len(of), step):
                        for row, first, second in neighbourhood(letters[at : at + step], letters_of, lambda h: in_filter(words, bits, h)):
                            if len(row):
                                k = of[at + row]
                                columns = [pa.array(own[0][k]), pa.array(own[1][k]), _signed(first), _signed(second)]
                                yield pa.RecordBatch.from_arrays(columns, names=["w1", "w2", "h1", "h2"])

    spread = vocabulary.select("word", "h1", "h2").repartition(tasks, "h1")
    return spread.mapInArrow(work, "w1 long, w2 long, h1 long, h2 long")


def _roots(forms: DataFrame, most_steps: int) -> DataFrame:
    """(word, root) of words with a form: chains of ``most_steps`` at most are halved each round."""
    links = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(most_steps, 1)))):
        links = saved(links)
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return links


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct (word, n) rows whose words are letters of Latin-1."""
    vocabulary = saved(_with_hashes(words))
    whole = vocabulary.agg(F.count("*").alias("words"), F.max("n").alias("most"), F.min("n").alias("least")).first()
    alphabet = sorted(r[0] for r in vocabulary.select(F.explode(F.split("word", ""))).distinct().collect())
    bits = min(FILTER_BITS, 1 << max(6, (BITS_A_WORD * whole.words - 1).bit_length())) if whole.words else 64
    pairs = near_candidates(vocabulary, "".join(alphabet).encode("latin-1"), bits, whole.words)
    near = pairs.join(vocabulary.select("h1", "h2", F.col("word").alias("near"), F.col("n").alias("near_n")), ["h1", "h2"])
    best = near.groupBy("w1", "w2").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    judged = vocabulary.join(best, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")), "left")
    leads: Column = -F.col("best.n") >= ratio * F.col("n")
    forms = saved(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("best.word")).alias("form"), F.when(leads, -F.col("best.n")).alias("form_n")))
    steps = int(math.log(whole.most / whole.least, ratio) + 1e-9) + 1 if whole.words else 1
    roots = _roots(forms, steps)
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
