"""The corpus pipeline, stage by stage, against plain versions on a small table."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tallyspark.llm import bpe, mixing

from .test_operators import RANKS, components_of, fingerprint_of

MISLABELLED = range(3000, 3006)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    sound = {"xx": "ka ro mi ta nu".split(), "yy": "the wh ing er sh".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(sound[lang], 3)) for _ in range(n))
    rows, marks = [], []
    for k in range(500):
        lang = "xx" if k % 2 else "yy"
        body = text(lang, int(rng.integers(30, 90)))
        if k % 5 == 0:
            body += " gzorpal gzorpen " + text(lang, 10)
        rows.append((k, body, lang, f"s{k % 4}", len(body)))
        marks.append((k, 1, int(k % 5 == 0)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(1000 + k, r[1], r[2], r[3], r[4]) for k, r in enumerate(clean[:60])] + [clean[0], (None, clean[1][1], None, None, None), (2000, None, None, "s1", 0), (2001, "", None, "s1", 0), (2002, "12 34", None, None, 5)]
    # these say that they are in the other language; the last names one that nothing is learned of
    rows += [(k, text("xx", 60), "yy", "s2", 0) for k in MISLABELLED] + [(4000, text("xx", 60), "zz-unknown", "s2", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        kept[name] = [tuple(r) for r in out.collect()]
        if name != "byte_bpe":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(kept[name], COLUMNS)
    assert Counter(kept["language_id"]) == Counter(r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and r[0] not in MISLABELLED)
    gone = Counter(kept["language_id"]) - Counter(kept["toxicity"])
    toxic = Counter(r for r in kept["language_id"] if "gzorp" in r[1])
    assert sum((gone - toxic).values()) <= 3 and sum((toxic - gone).values()) <= 5
    want = components_of([(r[0], fingerprint_of(r[1])) for r in kept["toxicity"]])
    left = kept["simhash_dedup"]
    assert sorted(r[0] for r in left if r[0] is not None) == sorted({c for _, _, c in want if c is not None})
    assert not [r for r in left if r[0] is None]
    plan = mixing.repetition_plan(spark.createDataFrame(left, COLUMNS), corpus_pipeline.MIX_WEIGHTS).collect()
    assert Counter(r[0] for r in kept["source_mixing"]) == +Counter({r.doc_id: r.copies for r in plan})
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN).ranks, special_tokens={})
    ids = {r[0]: own.encode_ordinary(r[1]) for r in left}
    assert Counter(kept["byte_bpe"]) == Counter((r[0], len(ids[r[0]]), hashlib.sha256(" ".join(map(str, ids[r[0]])).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()) for r in kept["source_mixing"])


def test_run_and_empty_table(spark, folder, tmp_path):
    path, rows = folder
    assert 0 < corpus_pipeline.run(spark, path).count() < 2 * len(rows)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
