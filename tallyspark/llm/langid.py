"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier per bit, logistic in hashed byte
bigram and trigram frequencies, predicts that bit. A text's language is the codeword of
least loss, where each bit's logistic loss weighs as much as the bit was right for that
language in training. A text whose nearest codeword leads the next by less than MARGIN of
what texts of that language usually lead by, as one of two languages in like parts, is
flagged. What is found for a text depends on no other text and on no partitioning.

Fitting takes a bounded sample of the labelled rows: ``sample_rows`` evenly over
languages, but about LEAST_ROWS and never less than one of each, so a rare language is
learned too; with many languages there are fewer rows of each, and of more than
``languages`` of them the most frequent are learned, since the sample and the code come to
the driver. Predictions are of whole texts. Null text or one without a letter: ``und``,
score 0. Null lang isn't learned from. Ties between codewords go to the smaller language
name. Repeated rows are predicted each; without any labelled row all texts are ``und``;
an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import spread
from .arrays import LETTERS, as_lower_bytes, batches, mix, release, small_batches, slices, text_blocks
from .logfreq import held_out

BUCKETS = 1 << 13
SCALE = 40.0
EPOCHS = 80
#: Share of a language's usual lead below which a text counts as ambiguous.
MARGIN = 0.5
UNDETERMINED = "und"
#: Languages that are learned, the most frequent ones.
LANGUAGES = 2000
#: Sampled rows of a language, about, where that comes to MOST_ROWS of all or less.
LEAST_ROWS, MOST_ROWS = 8, 8000


def ngram_buckets(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each letter byte: its place, and the buckets of the bigram and trigram that end there."""
    at = np.flatnonzero(data != 32)
    padded = np.concatenate([np.full(2, 32, np.uint8), data]).astype(np.uint64)
    two = (padded[at + 1] << np.uint64(8)) | padded[at + 2]
    three = (padded[at] << np.uint64(16)) | two
    low = np.uint64(BUCKETS - 1)
    return at, (mix(two + np.uint64(1 << 40)) & low).astype(np.int64), (mix(three) & low).astype(np.int64)


def _grams(texts: list[bytes | None]):
    """Blocks of (text number of each letter byte, bigram bucket, trigram bucket); two spaces part texts, so no gram joins two."""
    for block, numbers, begins in text_blocks([(t or b"").translate(LETTERS) for t in texts], b"  "):
        at, two, three = ngram_buckets(np.frombuffer(block, np.uint8))
        yield np.asarray(numbers)[np.searchsorted(begins, at, "right") - 1], two, three


def frequencies(texts: list[bytes | None]) -> np.ndarray:
    """Dense feature rows of a few texts."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    n = np.zeros(len(texts))
    for of, two, three in _grams(texts):
        np.add.at(out, (of, two), 1)
        np.add.at(out, (of, three), 1)
        n += np.bincount(of, minlength=len(texts))
    return out * (SCALE / np.maximum(n, 1))[:, None].astype(np.float32)


def codewords(k: int) -> np.ndarray:
    """A +1/-1 row for each of k classes: all splits for few, else the best of some random codes."""
    if k < 2:
        return np.ones((k, 1), np.float32)
    if k <= 5:
        return np.array([x for x in itertools.product((1, -1), repeat=k) if x[0] == 1 and -1 in x], np.float32).T
    rng = np.random.default_rng(k)
    best, far = None, -1
    for _ in range(max(2, min(200, 20_000 // k))):
        code = rng.choice([-1.0, 1.0], (k, int(np.ceil(10 * np.log2(k)))))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        # of two rows of ones and minus ones, the product says how many places differ
        like = code @ code.T
        np.fill_diagonal(like, -code.shape[1])
        apart = int(code.shape[1] - like.max()) // 2
        if apart > far:
            best, far = code, apart
    return best.astype(np.float32)


class Model:
    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust
        self.usual_lead = np.zeros(len(languages))

    def margins(self, texts: list[bytes | None]) -> np.ndarray:
        """Each bit's signed score for each text."""
        total = np.zeros((len(texts), self.weights.shape[1]))
        n = np.zeros(len(texts))
        for of, two, three in _grams(texts):
            if len(of):
                change = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
                total[of[change]] += np.add.reduceat(self.weights[two] + self.weights[three], change, axis=0, dtype=np.float64)
                n += np.bincount(of, minlength=len(texts))
        return total * (SCALE / np.maximum(n, 1))[:, None] + self.bias

    def distances(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each text to each codeword."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (loss * self.trust[None]).sum(axis=2)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        distance = self.distances(self.margins(texts))
        best = distance.argmin(axis=1)
        p = np.exp(-4 * (distance - distance.min(axis=1, keepdims=True)))
        score = p.max(axis=1) / p.sum(axis=1)
        ambiguous = lead(distance) < MARGIN * self.usual_lead[best]
        lettered = np.array([has_letter(t) for t in texts])
        return [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0), ambiguous & lettered


def lead(distance: np.ndarray) -> np.ndarray:
    """How much further away the next codeword is than the nearest one."""
    if distance.shape[1] < 2:
        return np.zeros(len(distance))
    two = np.partition(distance, 1, axis=1)
    return two[:, 1] - two[:, 0]


_ASCII_LETTERS = bytes(k for k in range(128) if chr(k).isalpha())


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return len(text.translate(None, _ASCII_LETTERS)) < len(text) or any(c.isalpha() for c in text.decode())


def fit(features: np.ndarray, labels: list[str]) -> Model:
    """Fits one logistic classifier per codeword bit by full-batch Adam."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    kind = np.array([languages.index(x) for x in labels], np.int64)
    bits = code.shape[1] if len(languages) else 1
    weights, bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    if len(languages) > 1:
        aim = code[kind]
        each = (1 / np.bincount(kind))[kind][:, None].astype(np.float32) / len(languages)
        state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(bias), np.zeros_like(bias)]
        for t in range(1, EPOCHS + 1):
            slope = -aim / (1 + np.exp(np.clip(aim * (features @ weights + bias), -30, 30))) * each
            for value, g, m, v in ((weights, features.T @ slope + 1e-5 * weights, *state[:2]), (bias, slope.sum(axis=0), *state[2:])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        right = np.sign(features @ weights + bias) == aim
        trust = np.array([right[kind == k].mean(axis=0) for k in range(len(languages))])
    else:
        trust = np.ones((len(languages), bits))
    model = Model(languages, code, weights, bias, trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9))
    if len(languages) > 1:
        leads = lead(model.distances(features @ weights + bias))
        model.usual_lead = np.array([np.median(leads[kind == k]) for k in range(len(languages))])
    return model


def train(docs: DataFrame, of: int = 4, remainder: int = 2, sample_rows: int = 2000, languages: int = LANGUAGES) -> Model:
    """Fits on about ``sample_rows`` labelled rows outside the held-out part; only their feature counts come to the driver."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), of, remainder)).select(F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").cast("string").alias("text"))
    coin = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 30)) / float(1 << 30)
    n = {r.lang: r for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(coin).alias("least")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not n:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    share = max(sample_rows / len(n), min(LEAST_ROWS, MOST_ROWS / len(n)))
    part = F.create_map(*[F.lit(x) for k, r in n.items() for x in (k, max(share / r.n, r.least))])
    sample = rows.where(coin <= F.try_element_at(part, F.col("lang"))).limit(int(2 * share * len(n)) + len(n))

    def features(iterator):
        for b in batches(iterator, ["lang", "text"]):
            texts = as_lower_bytes(b["text"])
            for s in slices(texts, 1 << 20):
                for lang, row in zip(b["lang"][s].to_pylist(), frequencies(texts[s]), strict=True):
                    at = np.flatnonzero(row).astype(np.uint16)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.tobytes()], pa.binary()), pa.array([row[at].astype(np.float16).tobytes()], pa.binary())], names=["lang", "at", "value"])

    found = sorted((r.lang, r.at, r.value) for r in sample.select("lang", "text").mapInArrow(features, "lang string, at binary, value binary").collect())
    dense = np.zeros((len(found), BUCKETS), np.float32)
    for k, (_, at, value) in enumerate(found):
        dense[k, np.frombuffer(at, np.uint16)] = np.frombuffer(value, np.float16)
    return fit(dense, [x[0] for x in found])


def language_column(model: Model, spark):
    """A function of a text column that gives struct<lang_pred, score, ambiguous>."""
    sent = spark.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    @F.arrow_udf("struct<lang_pred: string, score: double, ambiguous: boolean>")
    def predict(text: pa.Array) -> pa.Array:
        texts = as_lower_bytes(text)
        parts = []
        for s in slices(texts):
            lang, score, ambiguous = sent.value.predict(texts[s])
            parts.append(pa.StructArray.from_arrays([pa.array(lang), pa.array(score), pa.array(ambiguous)], fields=list(kind)))
        release()
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return predict


def predict_languages(docs: DataFrame, of: int = 4, remainder: int = 2, sample_rows: int = 2000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row; learns from rows outside the held-out part."""
    predict = language_column(train(docs, of, remainder, sample_rows), docs.sparkSession)
    rows = spread(docs.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), of, remainder).alias("held_out"), predict(F.col("text").cast("string")).alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.ambiguous")
