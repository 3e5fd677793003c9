"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word's input is its own hashed embedding beside the mean embedding of its character
n-grams (beginnings and inner 4-grams). Two GRUs read a window of words in both
directions, attention pools their states, and a logistic output gives the window's
score. A text is cut into windows of WINDOW words, each STRIDE words on from the one
before; its score is the calibrated score of its highest window.

The network is trained in numpy on a bounded sample of labelled rows (``sample_rows``,
a third of them toxic where there are as many), whatever their length; a toxic text
teaches through its highest window, a clean one through its highest and a random one,
among all its windows. What comes to the driver is bounded by rows and by TRAIN_WORDS of
each label: where the sample has more, fewer rows are learned from, in the order of a hash
of their ids. (Only a text of more than a quarter of that, half a million words, teaches by
windows spread over it.) Scores are of whole texts.

Null or empty text: the score of a window without words. Null labels aren't learned
from; of several labels of one doc_id the highest holds. Repeated rows are scored each;
scores have no ties to break; without both labels in the sample all scores are 0; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import spread
from .arrays import LETTERS, as_lower_bytes, batches, mix, release, small_batches, slices, span_hashes, word_blocks
from .logfreq import held_out
from .saved import drop, saved

WINDOW, STRIDE = 48, 24
#: Windows scored at a time.
WINDOWS = 1 << 12
#: Words whose n-grams are looked up at a time.
WORD_BLOCK = 1 << 14
HIDDEN, EMBED = 8, 8
WORDS, GRAMS = 1 << 15, 1 << 15
PREFIXES = (3, 4, 5, 6)
INNER = 4
#: Words of each label that are learned from.
TRAIN_WORDS = 2_000_000
EPOCHS = 7
#: Epochs after which all windows are scored again, to find the highest ones.
LOOKED_EVERY = 2
THRESHOLD = 0.7


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Words:
    """Distinct words of some texts with their buckets, and where they occur."""

    def __init__(self, texts: list[bytes | None]):
        hashes, ids, owners = [np.empty(0, np.uint64)], [], [np.empty(0, np.int64)]
        prefix = [np.empty((0, len(PREFIXES)), np.int32)]
        inner, inner_n = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for data, starts, ends, of in word_blocks(texts, LETTERS):
            h = span_hashes(data, starts, ends)
            distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
            ids.append((back + sum(map(len, hashes))).astype(np.int32))
            owners.append(of)
            hashes.append(distinct)
            s, e = starts[first], ends[first]
            begin = [mix(span_hashes(data, s, np.minimum(s + n, e)) + np.uint64(n)) % np.uint64(GRAMS) for n in PREFIXES]
            prefix.append(np.stack(begin, axis=1).astype(np.int32) if len(s) else prefix[0])
            many = np.maximum(e - s - INNER + 1, 0)
            at = np.repeat(s - (np.cumsum(many) - many), many) + np.arange(many.sum())
            inner.append((span_hashes(data, at, at + INNER) % np.uint64(GRAMS)).astype(np.int32))
            inner_n.append(many)
        self.word = (np.concatenate(hashes) % np.uint64(WORDS)).astype(np.int64)
        self.prefix, self.inner, self.inner_n = np.concatenate(prefix), np.concatenate(inner), np.concatenate(inner_n)
        self.ids = np.concatenate(ids) if ids else np.empty(0, np.int32)
        self.counts = np.bincount(np.concatenate(owners).astype(np.int64), minlength=len(texts))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, length and text number of each window; a text without words has one of length 0."""
        n = np.maximum(1, -(-np.maximum(self.counts - (WINDOW - STRIDE), 1) // STRIDE))
        of = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        begin = (np.cumsum(self.counts) - self.counts)[of] + k * STRIDE
        return begin, np.minimum(WINDOW, self.counts[of] - k * STRIDE), of


def _mean_rows(table: np.ndarray, words: Words) -> np.ndarray:
    """The mean of each word's n-gram rows, for a block of words at a time."""
    total = np.zeros((len(words.word), table.shape[1]), np.float32)
    edges = np.append(0, np.cumsum(words.inner_n, dtype=np.int64))
    for at in range(0, len(total), WORD_BLOCK):
        end = min(at + WORD_BLOCK, len(total))
        block, some = total[at:end], words.inner_n[at:end] > 0
        for k in range(len(PREFIXES)):
            block += table[words.prefix[at:end, k]]
        if some.any():
            block[some] += np.add.reduceat(table[words.inner[edges[at] : edges[end]]], (edges[at:end] - edges[at])[some], axis=0)
    return total / (len(PREFIXES) + words.inner_n)[:, None].astype(np.float32)


class Network:
    """Parameters and passes of the network. Windows come in order of falling length."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        wide, h = 2 * EMBED, HIDDEN
        self.p = {"words": normal(WORDS, EMBED, scale=0.1), "grams": normal(GRAMS, EMBED, scale=0.3), "look": normal(2 * h, scale=0.3), "out": normal(2 * h, scale=0.3), "out_b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"in_{d}": normal(wide, 3 * h, scale=wide**-0.5), f"u_{d}": normal(h, 3 * h, scale=h**-0.5), f"b_{d}": np.zeros(3 * h, np.float32)}
        self.slope, self.offset = 1.0, 0.0

    def inputs(self, words: Words) -> np.ndarray:
        return np.concatenate([self.p["words"][words.word], _mean_rows(self.p["grams"], words)], axis=1)

    def _steps(self, ids: np.ndarray, length: np.ndarray, direction: str):
        active = [int(np.searchsorted(-length, -t, "left")) for t in range(ids.shape[1])]
        order = range(ids.shape[1]) if direction == "f" else range(ids.shape[1] - 1, -1, -1)
        return [(t, active[t]) for t in order if active[t]]

    def run(self, x: np.ndarray, ids: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows of word numbers ``ids`` (windows, steps) into the word inputs ``x``."""
        n, steps, h = len(ids), ids.shape[1], HIDDEN
        states = np.zeros((2, steps, n, h), np.float32)
        columns = np.ascontiguousarray(ids.T)
        for k, d in enumerate("fb"):
            table, u = x @ self.p[f"in_{d}"] + self.p[f"b_{d}"], self.p[f"u_{d}"]
            now = np.zeros((n, h), np.float32)
            for t, m in self._steps(ids, length, d):
                a, before = table[columns[t, :m]], now[:m]
                b = before @ u
                gates = a[:, : 2 * h] + b[:, : 2 * h]
                np.clip(gates, -30, 30, out=gates)
                np.negative(gates, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
                if keep is not None:
                    keep[d, t] = before.copy(), gates, new, b[:, 2 * h :]
                states[k, t, :m] = now[:m] = new + z * (before - new)
        look = states[0] @ self.p["look"][:h] + states[1] @ self.p["look"][h:]
        look = np.where(np.arange(steps)[:, None] < length[None, :], look, -1e9)
        share = np.exp(look - look.max(axis=0)) if steps else look
        share *= np.arange(steps)[:, None] < length[None, :]
        share /= np.maximum(share.sum(axis=0), 1e-9)
        pooled = np.concatenate([np.einsum("tn,tnh->nh", share, states[k]) for k in range(2)], axis=1)
        if keep is not None:
            keep["pool"] = states, share, pooled
        return pooled @ self.p["out"] + self.p["out_b"]

    def gradients(self, x: np.ndarray, ids: np.ndarray, length: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weighted logistic loss by parameter, and by word input."""
        keep: dict = {}
        slope = (_sigmoid(self.run(x, ids, length, keep)) - label) * weight / weight.sum()
        states, share, pooled = keep["pool"]
        h, g = HIDDEN, {"out": slope @ pooled, "out_b": slope.sum(keepdims=True)}
        d_pooled = slope[:, None] * self.p["out"][None]
        from_share = sum(np.einsum("nh,tnh->tn", d_pooled[:, k * h : (k + 1) * h], states[k]) for k in range(2))
        d_look = share * (from_share - (share * from_share).sum(axis=0))
        g["look"] = np.concatenate([np.einsum("tn,tnh->h", d_look, states[k]) for k in range(2)])
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, w = self.p[f"u_{d}"], self.p[f"in_{d}"]
            du, d_now = np.zeros_like(u), np.zeros((len(ids), h), np.float32)
            seen, taken = [], []
            for t, m in reversed(self._steps(ids, length, d)):
                before, gates, new, b = keep[d, t]
                z, r = gates[:, :h], gates[:, h:]
                dh = d_now[:m] + share[t, :m, None] * d_pooled[:m, k * h : (k + 1) * h] + d_look[t, :m, None] * self.p["look"][k * h : (k + 1) * h]
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (before - new) * z * (1 - z)
                d_r = d_new * b * r * (1 - r)
                da = np.concatenate([d_z, d_r, d_new], axis=1)
                db = np.concatenate([d_z, d_r, d_new * r], axis=1)
                du += before.T @ db
                d_now[:m] = dh * z + db @ u.T
                seen.append(ids[:m, t])
                taken.append(da)
            d_table = _sums_of(np.concatenate(seen), np.concatenate(taken), len(x)) if seen else np.zeros((len(x), 3 * h), np.float32)
            g |= {f"u_{d}": du, f"b_{d}": d_table.sum(axis=0), f"in_{d}": x.T @ d_table}
            dx += d_table @ w.T
        return g, dx

    def window_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logit, first word, length and text number of every window; inputs are held for the words of WINDOWS windows."""
        begin, length, of = words.windows()
        logits = np.empty(len(begin), np.float32)
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), WINDOWS):
            part = order[at : at + WINDOWS]
            ids, n = _rows(words, begin[part], length[part])
            own, local = np.unique(ids, return_inverse=True)
            logits[part] = self.run(self.inputs(_subset(words, own)), local.reshape(ids.shape), n)
        return logits, begin, length, of

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        logits, _, _, of = self.window_logits(Words(texts))
        highest = np.full(len(texts), -np.inf)
        np.maximum.at(highest, of, logits)
        return _sigmoid(self.slope * highest + self.offset)


def _rows(words: Words, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = int(length.max(initial=0))
    at = begin[:, None] + np.minimum(np.arange(steps)[None, :], np.maximum(length - 1, 0)[:, None])
    # a window without words may stand at the end; its row is never read
    return (words.ids[np.minimum(at, len(words.ids) - 1)] if steps else np.zeros((len(begin), 0), np.int64)), length


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> Network:
    """Trains on whole texts with a label each; the empty text is learned as clean."""
    net = Network(seed)
    texts, labels = [*texts, b""], np.append(labels, 0)
    words, rng = Words(texts), np.random.default_rng(seed)
    release()
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    balance = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1)).astype(np.float32)
    for epoch in range(EPOCHS):
        if epoch % LOOKED_EVERY == 0:
            logits, begin, length, of = net.window_logits(words)
        shaken = np.lexsort((logits + rng.standard_normal(len(logits)) * 0.01, of))
        highest = shaken[np.append(np.flatnonzero(np.diff(of[shaken])), len(of) - 1)]
        clean = np.flatnonzero(labels[of] == 0)
        picked = np.concatenate([highest, rng.choice(clean, min(len(clean), len(texts)), replace=False)])
        rng.shuffle(picked)
        for at in range(0, len(picked), 128):
            part = picked[at : at + 128]
            part = part[np.argsort(-length[part], kind="stable")]
            ids, n = _rows(words, begin[part], length[part])
            own, local = np.unique(ids, return_inverse=True)
            sub = _subset(words, own)
            x = net.inputs(sub)
            g, dx = net.gradients(x, local.reshape(ids.shape), n, labels[of[part]].astype(np.float32), balance[of[part]])
            step += 1
            for key, grad in g.items():
                first[key] += 0.1 * (grad - first[key])
                second[key] += 0.01 * (grad * grad - second[key])
                net.p[key] -= 0.02 * (first[key] / (1 - 0.9**step)) / (np.sqrt(second[key] / (1 - 0.99**step)) + 1e-7)
            _step_rows(net.p["words"], second["words"], sub.word, dx[:, :EMBED])
            each = dx[:, EMBED:] / (len(PREFIXES) + sub.inner_n)[:, None]
            at_grams = np.concatenate([sub.prefix.ravel(), sub.inner])
            _step_rows(net.p["grams"], second["grams"], at_grams, np.concatenate([np.repeat(each, len(PREFIXES), axis=0), np.repeat(each, sub.inner_n, axis=0)]))
    _calibrate(net, words, labels)
    return net


def _sums_of(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, width) sums of the rows of ``values`` by their number in ``at``."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        own = at[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _subset(words: Words, own: np.ndarray) -> Words:
    out = object.__new__(Words)
    out.word, out.prefix, out.inner_n = words.word[own], words.prefix[own], words.inner_n[own]
    begin = (np.cumsum(words.inner_n) - words.inner_n)[own]
    out.inner = words.inner[np.repeat(begin - (np.cumsum(out.inner_n) - out.inner_n), out.inner_n) + np.arange(out.inner_n.sum())]
    return out


def _step_rows(table: np.ndarray, squares: np.ndarray, at: np.ndarray, grad: np.ndarray) -> None:
    """Adagrad on the rows that a batch used."""
    rows, back = np.unique(at, return_inverse=True)
    total = _sums_of(back, grad, len(rows))
    squares[rows] += total * total
    table[rows] -= 0.1 * total / (np.sqrt(squares[rows]) + 1e-7)


def _calibrate(net: Network, words: Words, labels: np.ndarray) -> None:
    """Fits score = sigmoid(slope * highest logit + offset) to the sample, slightly ridged."""
    logits, _, _, of = net.window_logits(words)
    highest = np.full(len(labels), -np.inf)
    np.maximum.at(highest, of, logits)
    weight = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1))
    a, b = 1.0, 0.0
    for _ in range(300):
        slope = (_sigmoid(a * highest + b) - labels) * weight
        a -= 0.3 * ((slope * highest).sum() + 0.001 * (a - 1))
        b -= 0.3 * (slope.sum() + 0.001 * b)
    net.slope, net.offset = float(max(a, 0.1)), float(b)


def excerpt(text: bytes, most: int) -> bytes:
    """The text, or where it has more than ``most`` words, windows evenly spread over it, first and last included."""
    words = text.split()
    if len(words) <= most:
        return text
    blocks = -(-len(words) // WINDOW)
    chosen = np.unique(np.linspace(0, blocks - 1, most // WINDOW).round().astype(int))
    return b" ".join(b" ".join(words[k * WINDOW : (k + 1) * WINDOW]) for k in chosen.tolist())


def train(docs: DataFrame, labels: DataFrame, of: int = 3, remainder: int = 1, sample_rows: int = 3600) -> Network | None:
    """Fits on at most about ``sample_rows`` labelled texts outside the held-out part; None without both labels."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), of, remainder)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    n = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    coin = F.pmod(F.xxhash64("doc_id", F.lit(53)), F.lit(1 << 30)) / float(1 << 30)
    part = lambda k, share: min(1.0, share * sample_rows / max(n.get(k, 0), 1))
    sample = own.where(coin < F.when(F.col("label") == 1, part(1, 1 / 3)).otherwise(part(0, 2 / 3))).limit(2 * sample_rows)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "label", coin.alias("coin")).limit(2 * sample_rows)

    def cut(iterator):
        for b in batches(iterator, ["text", "label", "coin"]):
            texts = [excerpt(t, TRAIN_WORDS // 4) for t in as_lower_bytes(b["text"])]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), b["label"], b["coin"], pa.array([len(t.split()) for t in texts], pa.int64())], names=["text", "label", "coin", "n"])

    sampled = saved(rows.mapInArrow(cut, "text binary, label int, coin double, n long"))
    upto = F.sum("n").over(Window.partitionBy("label").orderBy("coin", "n").rowsBetween(Window.unboundedPreceding, 0))
    last = sampled.select("label", "coin", "n", upto.alias("upto")).where(F.col("upto") <= TRAIN_WORDS).groupBy("label").agg(F.max("coin").alias("last"))
    found = sorted({(bytes(r.text), r.label) for r in sampled.join(F.broadcast(last), "label").where(F.col("coin") <= F.col("last")).select("text", "label").collect()})
    drop(sampled)
    release()
    if len({label for _, label in found}) < 2:
        return None
    net = fit([text for text, _ in found], np.array([label for _, label in found]))
    release()
    return net


def toxicity_column(net: Network | None, spark):
    """A function of a text column that gives its score."""
    sent = spark.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        texts = as_lower_bytes(text)
        if sent.value is None:
            return pa.array(np.zeros(len(texts)))
        parts = [sent.value.scores(texts[s]) for s in slices(texts, 2 << 20)]
        release()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, of: int = 3, remainder: int = 1, sample_rows: int = 3600) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of (doc_id, text)."""
    small_batches(docs.sparkSession)
    score = toxicity_column(train(docs, labels, of, remainder, sample_rows), docs.sparkSession)
    rows = spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), of, remainder).alias("held_out"), score(F.col("text").cast("string")).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
