"""Texts of megabytes through every text operator, ties that must be told apart, and columns whose names clash."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tallyspark.llm import ann, bpe, langid, lines, logfreq, mixing, rules, simhash, toxicity, variants, wordpiece

from .test_operators import RANKS, SOUND, fingerprint_of, sounded
from .test_pipeline import folder  # noqa: F401

MEGABYTES = 4


@pytest.fixture(scope="module")
def texts():
    """A text of megabytes: prose with many lines, and one without any white space for a million characters."""
    rng = np.random.default_rng(30)
    prose = "\n".join(sounded(rng, SOUND, "xx", 40) for _ in range(400))
    long_ = (prose + "\n") * (MEGABYTES * (1 << 20) // len(prose) + 1) + "ab1" * 350_000
    return {1: long_, 2: prose, 3: "short text", 4: None}


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "xx" if k < 3 else None, "s", "extra") for k, t in texts.items()] + [(10 + k, sounded(np.random.default_rng(k), SOUND, "yy" if k % 2 else "xx", 30), "yy" if k % 2 else "xx", "s", "extra") for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").repartition(3)


def test_counts_of_a_long_text(texts, docs):
    words = {k: len((t or "").split()) for k, t in texts.items()}
    scored = {r.doc_id: r for r in logfreq.lm_scores(docs, filter_bytes=1 << 20).collect()}
    judged = {r.doc_id: r for r in rules.quality_verdicts(docs, statistics=True).collect()}
    sizes = {r.doc_id: r.size for r in mixing.repetition_plan(docs, [1.0]).collect()}
    for k, n in words.items():
        assert scored[k].n_tokens == n + 1 and scored[k].score < 0 and judged[k].n_words == n and sizes[k] == n


def test_fingerprint_of_a_long_text(texts, docs):
    found = {r.doc_id: r.fp for r in simhash.near_duplicate_components(docs).collect()}
    for k, t in texts.items():
        assert found[k] & (1 << 64) - 1 == fingerprint_of(t)


def test_tokens_of_a_long_text(texts, docs):
    import tiktoken

    path = RANKS
    got = {r.doc_id: r for r in bpe.token_digests(docs, path, public_tokenizers.PATTERN).collect()}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Codec(bpe.read_ranks(path), public_tokenizers.PATTERN).ranks, special_tokens={})
    for k in (2, 3, 4):
        ids = own.encode_ordinary(texts[k] or "")
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(texts[1].encode()).hexdigest() and got[1].n_tokens > 1_000_000
    pieces = {r[0]: tuple(r)[1:3] for r in wordpiece.piece_counts(docs, path).collect()}
    # the same words a known number of times, and one that is all its own
    times = texts[1].count(texts[2] + "\n")
    assert pieces[1][0] == times * pieces[2][0] + 1 and pieces[1][1] > times * pieces[2][1]


def test_models_on_a_long_text(docs):
    found = {r.doc_id: r for r in langid.predict_languages(docs, sample_rows=40).collect()}
    assert found[1].lang_pred == found[2].lang_pred == "xx" and found[4].lang_pred == "und"
    labels = docs.sparkSession.createDataFrame([(k, int(k % 2)) for k in range(50)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(scores) == 44 and all(0 <= s <= 1 for s in scores.values())


def test_lines_and_words_of_a_long_text(texts, docs):
    kept = {r.doc_id: r for r in lines.drop_shared_lines(docs, 40, 2).collect()}
    assert kept[1].n_lines == texts[1].count("\n") + 1 and kept[1].n_dropped == texts[1].count("\n") and kept[1].kept_text == texts[1][-1_050_000:]
    assert kept[2].n_dropped == 0
    counted = {r.word: r.n for r in variants.counted_words(docs).collect()}
    want = Counter(w for t in texts.values() for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split() if len(w) >= 6)
    assert all(counted[w] >= n for w, n in want.most_common(20))


@pytest.mark.parametrize("parts", [8, 1])
def test_ties_go_to_the_smaller_id(spark, monkeypatch, parts):
    """Vectors that are equal, or equally near: exactly the smallest ids are found, in their order, however many parts there are."""
    monkeypatch.setattr(ann, "PARTS", parts)
    rng = np.random.default_rng(31)
    base = rng.integers(-3, 4, (12, 16)).astype(float)
    rows = [(int(i), base[k % 12].tolist()) for k, i in enumerate(rng.permutation(600))]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
    by = dict(rows)
    for q in [i for i in by if i % 20 == 0]:
        want = sorted((-float(np.dot(by[q], v)), i) for i, v in rows if i != q)[:20]
        assert [got[q][k] for k in range(1, 21)] == [i for _, i in want]


def test_pipeline_with_columns_that_clash(spark, folder, tmp_path):  # noqa: F811
    """Columns that bear the names that stages use for their own pass through."""
    path, rows = folder
    docs = spark.createDataFrame([(*r, "a", 0.5, 7, "c") for r in rows[:200]], "doc_id long, text string, lang string, source string, n_chars long, language_found string, toxicity_score double, copy_ long, component_id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        held = out.collect()
        assert held and {(r.language_found, r.toxicity_score, r.copy_, r.component_id) for r in held} == {("a", 0.5, 7, "c")}
        docs = spark.createDataFrame(held, docs.schema)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
