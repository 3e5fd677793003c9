"""Token counts of greedy word-piece tokenization, in time linear in the text.

The vocabulary is a trie with failure links: where no edge goes on, the automaton pops
the longest pieces found so far (their number is stored with the state) and goes on from
the state that the rest of the text leads to. So a word's number of pieces comes from one
pass over its bytes, without building pieces. All distinct words of a batch go through it
together, one byte column after the other.

A word without a full split counts as one unknown token. Words are runs of bytes outside
0x20 and 0x09-0x0D. Null or empty text: no words, no tokens. Repeated rows are counted
each; ties can't arise; an empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import spread
from .arrays import as_bytes, batches, mix, release, slices, small_batches

DEAD = -1
#: Words that a worker remembers between batches.
REMEMBERED = 200_000
CELLS = 1 << 20


def vocabulary(rank_file: bytes) -> tuple[list[bytes], list[bytes]]:
    """(first pieces, later pieces) by rule from a byte-level rank file.

    A token with a leading space begins a word; one without continues it. Single bytes
    are both, so that any word has a split.
    """
    tokens = [base64.b64decode(line.split()[0]) for line in rank_file.splitlines() if line]
    first = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1 and b" " not in t[1:]}
    later = {t for t in tokens if b" " not in t}
    return sorted(first | {bytes([k]) for k in range(256)}), sorted(later)


class Automaton:
    """Trie of first pieces (below state 0) and later pieces (below state 1) with failure links."""

    def __init__(self, first: list[bytes], later: list[bytes]):
        edges: dict[tuple[int, int], int] = {}
        is_piece = [False, False]
        parent = [(0, -1), (1, -1)]
        for root, pieces in ((0, first), (1, later)):
            for piece in pieces:
                at = root
                for c in piece:
                    nxt = edges.get((at, c))
                    if nxt is None:
                        nxt = edges[(at, c)] = len(is_piece)
                        is_piece.append(False)
                        parent.append((at, c))
                    at = nxt
                is_piece[at] = True
        n = len(is_piece)
        fail, pops = [DEAD] * n, [0] * n
        # breadth first: a state's failure is known before its children's
        depth = [0] * n
        for k in range(2, n):
            depth[k] = depth[parent[k][0]] + 1
        for k in sorted(range(2, n), key=depth.__getitem__):
            up, c = parent[k]
            if is_piece[k]:
                fail[k], pops[k] = 1, 1
                continue
            at, popped = fail[up], pops[up]
            while at != DEAD and (at, c) not in edges:
                popped += pops[at]
                at = fail[at]
            if at != DEAD:
                fail[k], pops[k] = edges[(at, c)], popped
        self.fail, self.pops = np.array(fail, np.int32), np.array(pops, np.int32)
        # at a word's end: pops until nothing is left, or DEAD
        end = np.full(n, DEAD, np.int32)
        end[1] = 0
        for k in sorted(range(2, n), key=depth.__getitem__):
            at, popped = k, 0
            while at not in (DEAD, 1):
                popped += pops[at]
                at = fail[at]
            end[k] = popped if at == 1 else DEAD
        self.end = end
        keys = np.array([(s << 8) | c for s, c in edges], np.uint64)
        size = 1 << (2 * len(keys)).bit_length()
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.to = np.full(size, DEAD, np.int32)
        to = np.array(list(edges.values()), np.int32)
        slot, todo = mix(keys) & self.mask, np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            _, one = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][one]
            self.keys[slot[placed]], self.to[slot[placed]] = keys[placed], to[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
        self.known: dict[bytes, int] = {}

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        keys = (state.astype(np.uint64) << np.uint64(8)) | byte.astype(np.uint64)
        slot = mix(keys) & self.mask
        out = np.full(len(state), DEAD, np.int32)
        on = np.arange(len(state))
        while len(on):
            found = self.keys[slot[on]]
            hit = found == keys[on]
            out[on[hit]] = self.to[slot[on[hit]]]
            on = on[~hit & (found != np.uint64(2**64 - 1))]
            slot[on] = (slot[on] + np.uint64(1)) & self.mask
        return out

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word, DEAD for a word without a split."""
        out = np.zeros(len(words), np.int64)
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        at = 0
        while at < len(order):
            width = max(len(words[order[at]]), 1)
            part = order[at : at + max(1, CELLS // width)]
            out[part] = self._counts_of([words[k] for k in part])
            at += len(part)
        return out

    def _counts_of(self, words: list[bytes]) -> np.ndarray:
        """``words`` are in order of falling length."""
        length = np.array([len(w) for w in words])
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        state, count = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64)
        for column in range(int(length[0]) if len(words) else 0):
            n = int(np.searchsorted(-length, -column, "left"))
            on = np.flatnonzero(state[:n] != DEAD)
            byte = text[begin[on] + column]
            while len(on):
                to = self.step(state[on], byte)
                ok = to != DEAD
                state[on[ok]] = to[ok]
                on, byte = on[~ok], byte[~ok]
                count[on] += self.pops[state[on]]
                state[on] = self.fail[state[on]]
                live = state[on] != DEAD
                on, byte = on[live], byte[live]
        last = np.where(state == DEAD, DEAD, self.end[state])
        return np.where(last == DEAD, DEAD, count + last)

    def text_counts(self, text: bytes | None) -> tuple[int, int, int]:
        """(words, tokens, unknown words) of a text."""
        words = (text or b"").split()
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = list({w for w in words if w not in known})
        known.update(zip(new, self.counts(new).tolist(), strict=True))
        found = [known[w] for w in words]
        unknown = found.count(DEAD)
        return len(words), sum(found) + 2 * unknown, unknown


_automata: dict[bytes, Automaton] = {}
_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row, with the vocabulary of a rank file."""
    small_batches(docs.sparkSession)
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(iterator):
        if sent.value not in _automata:
            _automata.clear()
            _automata[sent.value] = Automaton(*vocabulary(sent.value))
        own = _automata[sent.value]
        for b in batches(iterator, ["doc_id", "text"]):
            texts = as_bytes(b["text"])
            for s in slices(texts):
                words = set().union(*((t or b"").split() for t in texts[s])) - own.known.keys()
                new = list(words)
                own.known.update(zip(new, own.counts(new).tolist(), strict=True))
                found = np.array([own.text_counts(t) for t in texts[s]], np.int64)
                yield pa.RecordBatch.from_arrays([b["doc_id"][s], *(pa.array(found[:, k]) for k in range(3))], schema=_COUNTS)
                release()

    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
