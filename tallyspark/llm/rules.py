"""Quality rules as a short-circuit cascade.

A bounded sample of documents tells each rule's cost (seconds a byte of text) and
selectivity (share of documents it rejects); rules then run in order of rejections per
cost, each on the documents that all rules before it kept. A document is kept if no rule
rejects it, so the order, which depends on timings, never changes a verdict.

Words are runs of bytes outside 0x20 and 0x09-0x0D. Null or empty text: no words, which
the word-count rule rejects. Repeated rows get the same verdict each; ties can't occur;
an empty table gives no rows and keeps the order in which rules were given. Long texts
are cut into blocks at spaces for hashing, and statistics are of the whole text.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import spread
from .arrays import PLAIN, SPACE, as_bytes, batches, mix, release, small_batches, slices, span_hashes, word_blocks

#: Fixed set of the symbols that count.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Documents of the sample, about; twice as many at most.
SAMPLE_ROWS = 512
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further statistics that rules may ask for.
MORE_STATS = ("n_stutter_words",)


class TextStats:
    """Statistics of some texts as arrays, each worked out when a rule first asks for it."""

    def __init__(self, texts: list[bytes | None]):
        self.texts = [t or b"" for t in texts]
        self.n = len(texts)
        self._known: dict[str, np.ndarray] = {}
        self._words: tuple[np.ndarray, np.ndarray] | None = None

    def take(self, keep: np.ndarray) -> TextStats:
        """Of the texts that a mask keeps, with what is known already."""
        out = TextStats([t for t, k in zip(self.texts, keep, strict=True) if k])
        out._known = {k: v[keep] for k, v in self._known.items()}
        if self._words is not None:
            hashes, of = self._words
            inside = keep[of]
            out._words = hashes[inside], (np.cumsum(keep) - 1)[of[inside]]
        return out

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_") or name not in STATS + MORE_STATS:
            raise AttributeError(name)
        if name not in self._known:
            getattr(self, f"_find_{'words' if name in ('n_words', 'word_chars') else name[2:]}")()
        return self._known[name]

    def _find_words(self) -> None:
        words = np.zeros(self.n, np.int64)
        chars = np.zeros(self.n, np.int64)
        hashes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for data, starts, ends, of in word_blocks(self.texts, PLAIN):
            heads = np.zeros(len(data) + 1, np.int32)
            np.cumsum(((data & 0xC0) != 0x80) & (data != 32), out=heads[1:])
            words += np.bincount(of, minlength=self.n)
            chars += np.bincount(of, weights=heads[ends] - heads[starts], minlength=self.n).astype(np.int64)
            hashes.append(span_hashes(data, starts, ends))
            owners.append(of)
        self._words = np.concatenate(hashes), np.concatenate(owners).astype(np.int64)
        self._known |= {"n_words": words, "word_chars": chars}

    def _find_symbols(self) -> None:
        self._known["n_symbols"] = np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in self.texts], np.int64)

    def _find_dup_lines(self) -> None:
        out = np.zeros(self.n, np.int64)
        for k, text in enumerate(self.texts):
            lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
            out[k] = len(lines) - len(set(lines))
        self._known["n_dup_lines"] = out

    def _find_stutter_words(self) -> None:
        """Words that equal the word before them."""
        if self._words is None:
            self._find_words()
        hashes, of = self._words
        same = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
        self._known["n_stutter_words"] = np.bincount(of[1:][same], minlength=self.n).astype(np.int64)

    def _find_repeat_words(self) -> None:
        """Words that lie in an 8-word window whose text occurs twice or more in the document."""
        if self._words is None:
            self._find_words()
        hashes, of = self._words
        out = np.zeros(self.n, np.int64)
        n = len(hashes) - WINDOW + 1
        if n > 0:
            with np.errstate(over="ignore"):
                key = of[:n].astype(np.uint64)
                for k in range(WINDOW):
                    key = mix(key * np.uint64(0x9FB21C651E98DF25) + hashes[k : n + k])
            whole = of[:n] == of[WINDOW - 1 :]
            at = np.flatnonzero(whole)
            order = at[np.argsort(key[at], kind="stable")]
            same = key[order][1:] == key[order][:-1]
            again = np.zeros(n, bool)
            again[order[1:][same]] = again[order[:-1][same]] = True
            edges = np.zeros(len(hashes) + 1, np.int32)
            np.add.at(edges, np.flatnonzero(again), 1)
            np.add.at(edges, np.flatnonzero(again) + WINDOW, -1)
            covered = np.cumsum(edges)[:-1] > 0
            out = np.bincount(of[covered], minlength=self.n)
        self._known["n_repeat_words"] = out.astype(np.int64)


@dataclass(frozen=True)
class Rule:
    name: str
    #: True for the texts that it rejects.
    rejects: Callable[[TextStats], np.ndarray]


def few_words(s: TextStats) -> np.ndarray:
    return s.n_words < 20


def repeated_windows(s: TextStats) -> np.ndarray:
    return 100 * s.n_repeat_words > 30 * s.n_words


def repeated_lines(s: TextStats) -> np.ndarray:
    lines = np.array([t.count(b"\n") + 1 for t in s.texts], np.int64)
    return (s.n_dup_lines > 2) & (10 * s.n_dup_lines > 3 * lines)


def symbol_heavy(s: TextStats) -> np.ndarray:
    return 10 * s.n_symbols > s.n_words


def odd_word_length(s: TextStats) -> np.ndarray:
    return (s.word_chars < 2 * s.n_words) | (s.word_chars > 15 * s.n_words)


def stuttering(s: TextStats) -> np.ndarray:
    return 10 * s.n_stutter_words > 3 * s.n_words


#: Rules of the cascade. The first two decide base_failed.
RULES = (Rule("few_words", few_words), Rule("repeated_windows", repeated_windows), Rule("repeated_lines", repeated_lines), Rule("symbol_heavy", symbol_heavy), Rule("odd_word_length", odd_word_length), Rule("stuttering", stuttering))
_PROFILE = pa.schema([("rule", pa.int32()), ("rejected", pa.int64()), ("rows", pa.int64()), ("seconds", pa.float64())])


def rule_profile(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[int, float, float]]:
    """(rule's number, share rejected, seconds a document) on a sample; measured on the executors."""
    n = docs.count()
    sample = docs.select("text").sample(fraction=min(1.0, sample_rows / max(n, 1)), seed=11).limit(2 * sample_rows)

    def measure(iterator):
        for b in batches(iterator, ["text"]):
            texts = as_bytes(b["text"])
            for s in slices(texts):
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected = int(rule.rejects(TextStats(texts[s])).sum())
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([rejected]), pa.array([s.stop - s.start]), pa.array([time.perf_counter() - began])], schema=_PROFILE)

    found = sample.mapInArrow(measure, "rule int, rejected long, rows long, seconds double").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds")).collect()
    return [(r.rule, r.rejected / r.rows, r.seconds / r.rows) for r in sorted(found)]


def cascade_order(profile: list[tuple[int, float, float]], n_rules: int) -> list[int]:
    """Rules by rejections per cost, highest first; ties and rules without figures as given."""
    rate = {k: share / max(cost, 1e-9) for k, share, cost in profile}
    return sorted(range(n_rules), key=lambda k: (-rate.get(k, 0.0), k))


def run_cascade(stats: TextStats, rules: list[Rule]) -> tuple[np.ndarray, TextStats, np.ndarray]:
    """The number in ``rules`` of the rule that rejected each text (-1: kept), and the statistics and mask of those kept."""
    verdict = np.full(stats.n, -1, np.int32)
    alive = np.arange(stats.n)
    left = stats
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        rejected = rule.rejects(left)
        verdict[alive[rejected]] = k
        if rejected.any():
            alive, left = alive[~rejected], left.take(~rejected)
    return verdict, left, alive


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, statistics: bool = False) -> DataFrame:
    """doc_id, kept, rejected_by for every row; with ``statistics`` also STATS, for all documents.

    rejected_by names the rule that rejected first in this run's order, so it may vary
    between runs where more than one rule applies; kept does not.
    """
    small_batches(docs.sparkSession)
    order = cascade_order(rule_profile(docs, rules), len(rules))
    chosen = [rules[k] for k in order]
    names = np.array([r.name for r in chosen] + [None], object)
    fields = [("doc_id", pa.int64()), ("kept", pa.bool_()), ("rejected_by", pa.string())] + [(c, pa.int64()) for c in STATS if statistics]
    schema = pa.schema(fields)

    def judge(iterator):
        for b in batches(iterator, ["doc_id", "text"]):
            texts = as_bytes(b["text"])
            for s in slices(texts):
                stats = TextStats(texts[s])
                verdict, left, alive = run_cascade(stats, chosen)
                columns = [b["doc_id"][s], pa.array(verdict < 0), pa.array(names[verdict], pa.string())]
                if statistics:
                    lost = verdict >= 0
                    rest = stats.take(lost)
                    for c in STATS:
                        values = np.zeros(stats.n, np.int64)
                        values[alive] = getattr(left, c)
                        values[lost] = getattr(rest, c)
                        columns.append(pa.array(values))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)
                release()

    kinds = "doc_id long, kept boolean, rejected_by string" + "".join(f", {c} long" for c in STATS if statistics)
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(judge, kinds)
