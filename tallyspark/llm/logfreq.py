"""N-gram language model whose counts sit in a log-frequency Bloom filter.

Counts of word unigrams and bigrams are gathered over all training texts by a shuffle;
tasks merge what they have counted before they pass it on. A count is quantised to a
level: itself up to EXACT, beyond that the nearest of STEPS levels for each doubling, so it
is off by half of 1/STEPS of a doubling at most (1.1 %), and a larger count never has the
lower level. The filter then holds the items (n-gram, 1) ... (n-gram, level). It is built
shard by shard on the executors, and a reader recovers a level by repeated membership
probes: for 1, 2, 4, ... until one fails, then between the last two by halving; what a probe
claims is confirmed on the level below it. The filter answers too high at times, never
too low; no n-gram is left out of it. Most n-grams are rare and pay for few levels.

Its size follows the corpus: at least BITS_EACH bits an item, so that with PROBES probes at
most 40% of the bits are set and an item not held is found in at most 2.5% of the lookups
(scores hence change a little with ``filter_bytes``, within that rate). The items are
foretold from all n-grams of a hash class (one of CLASSES) and counted when the filter is
built; where they are more than foretold, it is built again. It consists of groups of shards
with ``filter_bytes`` each, which bounds what a task holds; a small corpus has one smaller
group of about ROOMY_BITS an item. One group is broadcast and looked
up while scoring. With more, texts are packed and written, the distinct n-grams of each pack
go to the tasks that hold their group, and levels come back to the pack: a fixed number of
shuffles, whatever the number of groups. The fill is logged.

P(w | v) = (min(c(v w), c(v)) + prior * P(w)) / (c(v) + prior), P(w) = (c(w) + 0.5) / M, where
c is read from the filter and M is the sum of c(w) + 0.5 over all words and an unseen one.
So no probability exceeds 1, and equal counts give equal ones. As c(v w) sums to the count
of v over all w, P sums to 1 in each context, up to rounding and to what the filter answers
too high.

The exact add-half unigram score stands beside it. Words with at least N / ``frequent``
occurrences number at most ``frequent``, so their counts are broadcast; occurrences of the
others are joined with the counts by word hash, and no such key can be hot.

Null text: empty, so its only token is the end. Null doc_id: hashed as the empty string.
Repeated rows are scored (and learned from) each; an empty table gives no rows. Ties do
not arise. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import spread
from .arrays import as_bytes, batches, mix, release, small_batches, slices, word_hashes
from .saved import drop, saved

LOG = logging.getLogger(__name__)

END = np.uint64(0xE17A1B2C3D4E5F61)
BEGIN = np.uint64(0xB3617A1B2C3D4E5F)
SHARDS = 256
PROBES = 4
#: Bits of the filter for each (n-gram, level) held.
BITS_EACH = 8
#: The bits for each where one group has room for them, and the least that a group takes.
ROOMY_BITS, LEAST_BYTES = 32, 1 << 20
#: Counts that have a level of their own, and levels for each doubling beyond.
EXACT, STEPS = 48, 32
#: The count that stands for a level.
LEVEL_COUNT = np.concatenate([np.arange(EXACT + 1.0), EXACT * 2.0 ** (np.arange(1, 36 * STEPS + 1) / STEPS)])
LEVELS = len(LEVEL_COUNT) - 1
#: Bytes of text that are looked up together where the filter has several groups, hashes that travel in a row, and copies of a group.
PACK, ASKED, COPIES = 1 << 18, 1 << 14, 8
#: Distinct n-grams that a task gathers before it passes them on, and tokens that it merges into them at a time.
GATHERED, MERGED = 3_000_000, 1_000_000
#: Hash classes of n-grams; one of them foretells how many items there are.
CLASSES = 256


def held_out(doc_id, of: int, remainder: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of == remainder


def token_stream(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of the texts one after the other, the token before each, and each one's text number."""
    words, counts = word_hashes(texts)
    of = np.repeat(np.arange(len(texts)), counts + 1)
    last = np.cumsum(counts + 1) - 1
    tokens = np.empty(len(of), np.uint64)
    is_word = np.ones(len(of), bool)
    is_word[last] = False
    tokens[is_word] = words
    tokens[last] = END
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[last - counts] = BEGIN
    return tokens, before, of


def bigram_hashes(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0x9FB21C651E98DF25) + tokens * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7))


_COUNTED = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("n", pa.int64())])
WORD_KIND, PAIR_KIND = 0, 1


class _Gathered:
    """Counts of hashes, merged as they come."""

    def __init__(self):
        self.keys, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        self.held.append(hashes)
        self.size += len(hashes)
        if self.size > MERGED:
            self.merge()

    def merge(self) -> None:
        keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *self.held]), return_counts=True)
        every, counts = np.concatenate([self.keys, keys]), np.concatenate([self.n, n])
        order = np.argsort(every, kind="stable")
        every, counts = every[order], counts[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
        self.keys, self.n = every[first], np.add.reduceat(counts, first) if len(first) else counts
        self.held, self.size = [], 0

    def taken(self, kind: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        for at in range(0, len(self.keys), 200_000):
            keys, n = self.keys[at : at + 200_000], self.n[at : at + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys.view(np.int64)), pa.array(n)], schema=_COUNTED)
        self.__init__()


def ngram_counts(docs: DataFrame, words: bool = True, pairs: bool = True, classes: int = 1) -> DataFrame:
    """(kind, h, n): occurrences of words (and of BEGIN, where bigrams count) and bigrams in ``text``, merged by task.

    Of bigrams only those of one hash class of ``classes``.
    """

    def gather(iterator):
        one, two = _Gathered(), _Gathered()
        for b in batches(iterator, ["text"]):
            texts = as_bytes(b["text"])
            for s in slices(texts):
                tokens, before, _ = token_stream(texts[s])
                if words:
                    one.add(np.concatenate([tokens, before[before == BEGIN]]) if pairs and classes == 1 else tokens)
                if pairs:
                    h = bigram_hashes(before, tokens)
                    two.add(h if classes == 1 else h[h % np.uint64(classes) == 0])
                for held, kind in ((one, WORD_KIND), (two, PAIR_KIND)):
                    if len(held.keys) > GATHERED:
                        yield from held.taken(kind)
        yield from one.taken(WORD_KIND)
        yield from two.taken(PAIR_KIND)
        release()

    return docs.select("text").mapInArrow(gather, "kind byte, h long, n long")


class _Places:
    """Where the probes of (n-gram, level) items lie: in the shard of the n-gram, a step from one to the next."""

    def __init__(self, h: np.ndarray, level: int | np.ndarray, bits: int, base: np.ndarray | None = None):
        with np.errstate(over="ignore"):
            self.first = mix(h + np.uint64(0xA24BAED4963EE407) * np.asarray(level, np.uint64))
            self.step = mix(self.first) | np.uint64(1)
            self.base = (h % np.uint64(SHARDS)) * np.uint64(bits) if base is None else base
        self.bits = bits

    def at(self, probe: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self.base + ((self.first + np.uint64(probe) * self.step) & np.uint64(self.bits - 1))

    def keep(self, some: np.ndarray) -> None:
        self.first, self.step, self.base = self.first[some], self.step[some], self.base[some]


def quantised(n: np.ndarray) -> np.ndarray:
    """The level of each count, the nearest by ratio."""
    n = np.asarray(n, np.float64)
    far = EXACT + np.rint(STEPS * np.log2(np.maximum(n, EXACT) / EXACT)).astype(np.int64)
    return np.minimum(np.where(n <= EXACT, n.astype(np.int64), far), LEVELS)


def insert(flags: np.ndarray, h: np.ndarray, level: np.ndarray, bits: int, slot: np.ndarray | None = None) -> None:
    """Sets the flags, one for each bit, of each n-gram's items up to its level.

    ``slot``: which of the shards that ``flags`` holds each of ``h`` belongs to, where these aren't all of a group.
    """
    order = np.argsort(-level, kind="stable")
    h, level = h[order], level[order]
    base = None if slot is None else slot[order] * np.uint64(bits)
    for q in range(1, int(level.max(initial=0)) + 1):
        reached = np.searchsorted(-level, -q, "right")
        places = _Places(h[:reached], q, bits, None if base is None else base[:reached])
        for probe in range(PROBES):
            flags[places.at(probe).astype(np.int64)] = True


def _held(filter_: np.ndarray, h: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
    """Whether each (n-gram, level) is found in the filter."""
    alive, places = np.arange(len(h)), _Places(h, level, bits)
    for probe in range(PROBES):
        at = places.at(probe)
        hit = np.flatnonzero((filter_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1)
        if len(hit) < len(alive):
            alive = alive[hit]
            places.keep(hit)
    found = np.zeros(len(h), bool)
    found[alive] = True
    return found


def levels_of(filter_: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """The level of each n-gram, by membership probes: doubled until one fails, then halved between."""
    low, high = np.zeros(len(h), np.int64), np.full(len(h), LEVELS + 1)

    def probe(at: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Moves the bounds of the n-grams at ``at`` by what the filter says of ``level``; which of them it holds."""
        held = _held(filter_, h[at], level, bits)
        claimed = np.flatnonzero(held & (level - 1 > low[at]))
        held[claimed] = _held(filter_, h[at[claimed]], level[claimed] - 1, bits)
        low[at[held]] = level[held]
        high[at[~held]] = level[~held]
        return held

    alive, level = np.arange(len(h)), 1
    while len(alive) and level <= LEVELS:
        alive = alive[probe(alive, np.full(len(alive), level))]
        level *= 2
    alive = np.flatnonzero(high - low > 1)
    while len(alive):
        probe(alive, (low[alive] + high[alive]) // 2)
        alive = alive[high[alive] - low[alive] > 1]
    return low


def lookup(filter_: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """The quantised count of each n-gram."""
    return LEVEL_COUNT[levels_of(filter_, h, bits)]


def groups_for(items: int, filter_bytes: int) -> int:
    """How many groups of ``filter_bytes`` hold that many items at BITS_EACH: a power of two."""
    need = -(-items * BITS_EACH // (filter_bytes * 8))
    return 1 << max(0, need - 1).bit_length()


def group_of(h: np.ndarray, groups: int) -> np.ndarray:
    return (h % np.uint64(SHARDS * groups)) // np.uint64(SHARDS)


def _large(iterator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(h, n) of many small batches at a time."""
    held, size = [], 0
    for b in batches(iterator, ["h", "n"]):
        held.append((b["h"].to_numpy().view(np.uint64), b["n"].to_numpy()))
        size += len(held[-1][0])
        if size >= 200_000:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def build_slices(counts: DataFrame, filter_bytes: int, groups: int) -> DataFrame:
    """(group, k, items, bits): shards of the filter over all (h, n), built and written by the executors."""
    bits = filter_bytes * 8 // SHARDS
    if bits & (bits - 1):
        raise ValueError("filter_bytes must be a power of two")
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # more tasks than usual: a task gets whole slices, and few of them vary much in number
    by_slice = counts.select("h", "n", F.pmod("h", F.lit(SHARDS * groups)).alias("slice")).repartition(min(4 * max(parts, groups), SHARDS * groups), "slice")
    summed = by_slice.groupBy("slice", "h").agg(F.sum("n").alias("n"))

    def build(iterator):
        own = np.zeros(bits, bool)
        slots: dict[int, int] = {}
        items: dict[int, int] = {}
        for h, n in _large(iterator):
            level = quantised(n)
            found, at = np.unique(h % np.uint64(SHARDS * groups), return_inverse=True)
            held = np.array([slots.setdefault(k, len(slots)) for k in found.tolist()], np.uint64)
            if len(slots) * bits > len(own):
                own = np.concatenate([own, np.zeros(max(len(own), len(slots) * bits - len(own)), bool)])
            insert(own, h, level, bits, held[at])
            for k, size in zip(found.tolist(), np.bincount(at, weights=level).tolist(), strict=True):
                items[k] = items.get(k, 0) + int(size)
        for k, slot in slots.items():
            yield pa.RecordBatch.from_arrays([pa.array([k // SHARDS], pa.int32()), pa.array([k % SHARDS], pa.int32()), pa.array([items[k]], pa.int64()), pa.array([np.packbits(own[slot * bits : (slot + 1) * bits], bitorder="little").tobytes()], pa.binary())], names=["group", "k", "items", "bits"])

    # written first: fetching partition by partition would otherwise also build them one after the other
    return saved(summed.select("h", "n").mapInArrow(build, "group int, k int, items long, bits binary"))


def foretold_items(counts: DataFrame) -> int:
    """About how many items the filter will hold, from counts with bigrams of one class of CLASSES."""
    level = F.when(F.col("n") <= EXACT, F.col("n")).otherwise(EXACT + F.rint(STEPS * F.log2(F.col("n") / EXACT)))
    return int(counts.agg(F.coalesce(F.sum(F.when(F.col("kind") == PAIR_KIND, CLASSES * level).otherwise(level)), F.lit(0.0))).first()[0])


def sized_slices(counts: DataFrame, filter_bytes: int, foretold: int = 0) -> tuple[DataFrame, int]:
    """The shards and the number of groups: as many as the foretold items need, and built again as more if those counted then do."""
    groups = groups_for(foretold, filter_bytes)
    while True:
        made = build_slices(counts, filter_bytes, groups)
        items = made.agg(F.coalesce(F.sum("items"), F.lit(0))).first()[0]
        if groups_for(items, filter_bytes) <= groups:
            fill = 1 - np.exp(-PROBES * items / (groups * filter_bytes * 8))
            LOG.info("filter: %d items (%d foretold) in %d groups of %d bytes, fill %.3f, false answers %.4f an item", items, foretold, groups, filter_bytes, fill, fill**PROBES)
            return made, groups
        drop(made)
        groups = groups_for(items, filter_bytes)


def quantised_mass(counts: DataFrame) -> float:
    """The sum of the quantised counts of all (h, n)."""

    def added(iterator):
        for b in batches(iterator, ["h", "n"]):
            yield pa.RecordBatch.from_arrays([pa.array([LEVEL_COUNT[quantised(b["n"].to_numpy())].sum()])], names=["mass"])

    return counts.select("h", "n").mapInArrow(added, "mass double").agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]


def group_filter(made: DataFrame, group: int, filter_bytes: int) -> np.ndarray:
    """One group's bits: all that comes to the driver at a time."""
    whole = np.zeros(filter_bytes, np.uint8)
    each = filter_bytes // SHARDS
    for row in made.where(F.col("group") == group).select("k", "bits").toLocalIterator():
        whole[row.k * each : (row.k + 1) * each] = np.frombuffer(row.bits, np.uint8)
    return whole


def distinct_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """The text number of each token, the distinct hashes of tokens and bigrams, and the places among them of each token, its context and its bigram."""
    tokens, before, of_text = token_stream(texts)
    pairs = bigram_hashes(before, tokens)
    distinct, at = np.unique(np.concatenate([tokens, pairs, np.array([BEGIN])]), return_inverse=True)
    n = len(tokens)
    left = np.empty(n, np.int64)
    left[1:] = at[: n - 1]
    left[before == BEGIN] = at[-1]
    return of_text, distinct, at[:n], left, at[n : 2 * n]


_ASK = "pack long, grp int, seq int, body binary"
_REPLY = pa.schema([("pack", pa.int64()), ("grp", pa.int32()), ("seq", pa.int32()), ("body", pa.binary())])


def _asks(distinct: np.ndarray, groups: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(group, number, places) of a pack's distinct hashes, ASKED at a time; the same for the same hashes."""
    of = group_of(distinct, groups)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(groups + 1))
    for group in range(groups):
        for seq, at in enumerate(range(ends[group], ends[group + 1], ASKED)):
            yield group, seq, order[at : min(at + ASKED, ends[group + 1])]


def packed_texts(rows: DataFrame) -> DataFrame:
    """(pack, row_ids, doc_ids, held, texts): rows of about PACK bytes of text together, written once."""

    def pack(iterator):
        for b in batches(iterator, ["row_id", "doc_id", "text", "held_out"]):
            texts = as_bytes(b["text"])
            for s in slices(texts, PACK):
                ends = pa.array([0, s.stop - s.start], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.concat_arrays([b[c][s]])) for c in ("row_id", "doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([texts[s]], pa.list_(pa.binary()))], names=["row_ids", "doc_ids", "held", "texts"])

    packs = rows.mapInArrow(pack, "row_ids array<long>, doc_ids array<long>, held array<boolean>, texts array<binary>")
    return saved(packs.select(F.monotonically_increasing_id().alias("pack"), "*"))


def pack_levels(packs: DataFrame, made: DataFrame, groups: int, filter_bytes: int) -> DataFrame:
    """(pack, replies): the levels of each pack's distinct hashes, in the order in which they were asked.

    Asks go to the tasks of their group, COPIES at most; a task reads its group's shards, sorted
    before the asks, and streams over these. Levels are two bytes.
    """
    bits = filter_bytes * 8 // SHARDS
    each = filter_bytes // SHARDS
    parts = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = min(COPIES, -(-parts // groups))

    def ask(iterator):
        for b in batches(iterator, ["pack", "texts"]):
            for pack, texts in zip(b["pack"].to_pylist(), b["texts"], strict=True):
                distinct = distinct_hashes(texts.as_py())[1]
                found = list(_asks(distinct, groups))
                yield pa.RecordBatch.from_arrays([pa.array([pack] * len(found), pa.int64()), *(pa.array([f[k] for f in found], pa.int32()) for k in (0, 1)), pa.array([distinct[f[2]].tobytes() for f in found], pa.binary())], schema=_REPLY)
            release()

    def answer(iterator):
        whole, own = np.zeros(filter_bytes, np.uint8), None
        for b in batches(iterator, ["grp", "copy", "kind", "pack", "seq", "body"]):
            keys = list(zip(b["grp"].to_pylist(), b["copy"].to_pylist(), strict=True))
            out = []
            for key, kind, pack, seq, body in zip(keys, b["kind"].to_pylist(), b["pack"].to_pylist(), b["seq"].to_pylist(), b["body"], strict=True):
                if key != own:
                    own = key
                    whole[:] = 0
                if kind == 0:
                    whole[pack * each : (pack + 1) * each] = np.frombuffer(body.as_buffer(), np.uint8)
                else:
                    levels = levels_of(whole, np.frombuffer(body.as_buffer(), np.uint64), bits)
                    out.append((pack, key[0], seq, levels.astype(np.uint16).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _REPLY, strict=True)], schema=_REPLY)

    asks = packs.select("pack", "texts").mapInArrow(ask, _ASK).select("grp", F.pmod(F.xxhash64("pack"), F.lit(copies)).cast("int").alias("copy"), F.lit(1).alias("kind"), "pack", "seq", "body")
    shards = made.select(F.col("group").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), F.col("k").cast("long").alias("pack"), F.lit(0).alias("seq"), F.col("bits").alias("body"))
    met = asks.union(shards).repartition(groups * copies, "grp", "copy").sortWithinPartitions("grp", "copy", "kind")
    return met.mapInArrow(answer, _ASK).groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("grp", "seq", "body"))).alias("replies"))


_SCORED = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
_SCORED_TYPE = "row_id long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, times array<int>"


class _Scorer:
    """Scores of texts from the levels of their n-grams, and the base score of their frequent words."""

    def __init__(self, top_h: np.ndarray, top_n: np.ndarray, mass: float, floor: float, prior: float):
        self.top_h, self.top_n, self.mass, self.floor, self.prior = top_h, top_n, mass, floor, prior

    def __call__(self, ids: list[pa.Array], texts: list[bytes | None], levels_for) -> pa.RecordBatch:
        """``ids``: row_id, doc_id and held_out of the texts; ``levels_for`` gives the levels of distinct hashes."""
        n = len(texts)
        of_text, distinct, single, left, pair = distinct_hashes(texts)
        count = LEVEL_COUNT[levels_for(distinct)]
        # what the filter answers too high must not put a bigram above the words in it
        both = np.minimum(count[pair], np.minimum(count[left], count[single]))
        p = (both + self.prior * (count[single] + 0.5) / self.mass) / (count[left] + self.prior)
        score = np.bincount(of_text, weights=np.log10(np.minimum(p, 1.0)), minlength=n)
        # the exact counts: frequent words here, the others by a join
        is_top, log = np.zeros(len(distinct), bool), np.zeros(len(distinct))
        if len(self.top_h):
            is_top[single] = True
            words = np.flatnonzero(is_top)
            near = np.minimum(np.searchsorted(self.top_h, distinct[words]), len(self.top_h) - 1)
            is_top[words] = self.top_h[near] == distinct[words]
            log[words] = np.where(is_top[words], np.log10((self.top_n[near] + 0.5) / self.floor), 0.0)
        top = is_top[single]
        base = np.bincount(of_text, weights=log[single], minlength=n)
        known = np.bincount(of_text, weights=top, minlength=n).astype(np.int64)
        keys, times = np.unique(of_text[~top] * np.int64(len(distinct)) + single[~top], return_counts=True)
        owner, word = np.divmod(keys, len(distinct))
        offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
        rare = [pa.ListArray.from_arrays(offsets, pa.array(distinct[word].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
        return pa.RecordBatch.from_arrays([*ids, pa.array(np.bincount(of_text, minlength=n)), pa.array(known), pa.array(base), pa.array(score), *rare], schema=_SCORED)


def scored_by_broadcast(rows: DataFrame, scorer: _Scorer, filter_: np.ndarray, filter_bytes: int) -> DataFrame:
    """Scores of (row_id, doc_id, text, held_out) where the filter is one group."""
    sent = rows.sparkSession.sparkContext.broadcast((filter_, scorer))
    bits = filter_bytes * 8 // SHARDS

    def score(iterator):
        filter_, scorer = sent.value
        for b in batches(iterator, ["row_id", "doc_id", "text", "held_out"]):
            texts = as_bytes(b["text"])
            for s in slices(texts, 4 << 20):
                yield scorer([b[c][s] for c in ("row_id", "doc_id", "held_out")], texts[s], lambda h: levels_of(filter_, h, bits))
                release()

    return rows.mapInArrow(score, _SCORED_TYPE)


def scored_by_packs(rows: DataFrame, scorer: _Scorer, made: DataFrame, groups: int, filter_bytes: int) -> DataFrame:
    """The same where it has several, by packs and what their groups reply."""
    packs = packed_texts(rows)
    sent = rows.sparkSession.sparkContext.broadcast(scorer)

    def score(iterator):
        scorer = sent.value
        for b in batches(iterator, ["row_ids", "doc_ids", "held", "texts", "replies"]):
            for k in range(len(b["texts"])):
                replies = [np.frombuffer(r["body"].as_buffer(), np.uint16) for r in b["replies"][k]]

                def levels_for(distinct, replies=replies):
                    levels = np.zeros(len(distinct), np.int64)
                    for (_, _, at), found in zip(_asks(distinct, groups), replies, strict=True):
                        levels[at] = found
                    return levels

                yield scorer([b[c][k].values for c in ("row_ids", "doc_ids", "held")], b["texts"][k].as_py(), levels_for)
            release()

    met = packs.join(pack_levels(packs, made, groups, filter_bytes), "pack")
    return met.select("row_ids", "doc_ids", "held", "texts", "replies").mapInArrow(score, _SCORED_TYPE)


def lm_scores(docs: DataFrame, of: int = 5, remainder: int = 1, filter_bytes: int = 128 << 20, prior: float = 64.0, frequent: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id"), of, remainder).alias("held_out"))
    train = rows.where(~F.col("held_out"))

    gathered = saved(ngram_counts(train, classes=CLASSES).groupBy("kind", "h").agg(F.sum("n").alias("n")))
    counts = gathered.where(F.col("kind") == WORD_KIND).select("h", "n")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = counts.where(F.col("n") * frequent >= total).toArrow()
    order = np.argsort(known_h := known.column("h").to_numpy().view(np.uint64))
    floor = total + 0.5 * (distinct + 1)
    scorer = _Scorer(known_h[order], known.column("n").to_numpy()[order], quantised_mass(counts) + 0.5 * (distinct + 1), floor, prior)
    items = foretold_items(gathered)
    filter_bytes = min(filter_bytes, max(LEAST_BYTES, 1 << max(0, items * ROOMY_BITS // 8 - 1).bit_length()))
    made, groups = sized_slices(ngram_counts(train), filter_bytes, items)
    numbered = rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text", "held_out")
    found = scored_by_broadcast(numbered, scorer, group_filter(made, 0, filter_bytes), filter_bytes) if groups == 1 else scored_by_packs(numbered, scorer, made, groups, filter_bytes)
    scored = saved(found)
    drop(made)

    pairs = scored.select("row_id", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row_id", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    met = pairs.join(counts.where(F.col("n") * frequent < total), "h", "left")
    more = met.groupBy("row_id").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(floor))).alias("more_base"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
    )
    return scored.join(more, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score",
    )
