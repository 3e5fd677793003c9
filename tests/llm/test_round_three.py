"""Line dedup, spelling variants and vector codes against plain versions, on small tables with awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import lines, queries, variants, vectorcodes

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "This Notice Appears At The Foot Of Many Pages, ÄÖ Included"


# line dedup


def line_rows() -> list[tuple]:
    rows = [(k, f"own line of {k}, which is long enough to count as well\n  {LONG}\t\nend", "x", k) for k in range(7)]
    rows += [(2, rows[2][1], "again", 0), (20, LONG.translate(ASCII_LOWER) + "\n\n" + LONG + "\n", None, None)]
    rows += [(None, f"{LONG}\nkept", "n", 1), (None, None, "n", 1), (30, None, "", 2), (31, "", "", 2), (32, "\n\n", "", 2), (33, "x" * 50_000, "", 3)]
    rows += [(40 + k, "short line\n" + "y" * 39, "", 3) for k in range(9)]
    rows += [(50 + k, "z" * 40 + "\v\n a", "", 3) for k in range(5)] + [(60, "Z" * 40, "", 3), (61, "É" * 45, "", 3)]
    rows += [(70 + k, "é" * 45 if k else "É" * 45, "", 3) for k in range(5)]
    return rows


def plain_line_dedup(rows, least_chars=40, least_docs=5):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(ASCII_LOWER)
    held = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    shared = {k: max(i for i in ids if i is not None) for k, ids in held.items() if len(k) >= least_chars and len(ids) >= least_docs}
    found = []
    for i, text, *_ in rows:
        parts = (text or "").split("\n")
        stay = [p for p in parts if shared.get(key(p), i) == i]
        found.append((i, "\n".join(stay), len(parts), len(parts) - len(stay)))
    return sorted(found, key=repr)


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_line_dedup(spark, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        docs = spark.createDataFrame(line_rows(), "doc_id long, text string, kept_text string, h1 long").repartition(3)
        got = lines.drop_shared_lines(docs)
        assert got.columns == ["doc_id", "text", "kept_text", "h1", "kept_text_", "n_lines", "n_dropped"]
        found = sorted(((r.doc_id, r.kept_text_, r.n_lines, r.n_dropped) for r in got.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == plain_line_dedup(line_rows())
    assert sum(r[3] for r in found) > 8


def test_line_dedup_of_nothing(spark):
    assert lines.drop_shared_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_of_a_text_of_megabytes(spark):
    """A long text that loses every other line, in time that grows with its length."""
    many = "\n".join(f"{LONG}\nline {k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, many)] + [(k, LONG) for k in range(2, 8)], "doc_id long, text string")
    (found,) = lines.drop_shared_lines(docs).where("doc_id = 1").collect()
    assert (found.n_lines, found.n_dropped) == (120_000, 60_000)
    assert found.kept_text == "\n".join(f"line {k}" for k in range(60_000))


def test_line_dedup_with_other_bounds(spark):
    rows = [(k, f"a b\nline {k}\n A B ", None, 0) for k in range(3)]
    got = lines.drop_shared_lines(spark.createDataFrame(rows, "doc_id long, text string, a string, b long"), 3, 3)
    assert sorted((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got.collect()) == plain_line_dedup(rows, 3, 3)


def test_line_dedup_stays_native(spark, sf_dir):
    text = queries.QUERIES["op12_line_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|MapInPandas|MapInArrow|ExistingRDD", text)


# spelling variants


def plain_words(rows, planted=0, least_chars=6, least=5):
    n = Counter()
    for i, text, *_ in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if planted and h % planted == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= least_chars and k >= least}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(words, ratio=5):
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and one_apart(v, w)] for w in words}
    best = {w: min(of, key=lambda v: (-words[v], v)) if of else None for w, of in near.items()}
    form = {w: b if b and words[b] >= ratio * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def groups(spark, words, **how):
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r.word: tuple(r) for r in variants.variant_groups(table, **how).collect()}


def test_variant_chains_and_ties(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15_625, "ébbbbb": 3, "ébbbb": 70_000}
    words |= {"colour": 50, "color": 10, "colours": 50, "colourz": 9, "xolour": 9, "bookkeeper": 100, "bokkeeper": 20, "bookkeepers": 20, "÷×÷×÷×": 7, "÷×÷×÷": 40, "alone": 5}
    assert groups(spark, words) == plain_groups(words)
    assert groups(spark, words, ratio=2) == plain_groups(words, 2)
    assert plain_groups(words)["aaaaaa"][2] == "abbbbb"


def test_variants_of_random_words(spark, monkeypatch):
    rng = np.random.default_rng(11)
    for cells, bits in ((1 << 19, 1 << 28), (50, 64)):
        monkeypatch.setattr(variants, "CELLS", cells)
        monkeypatch.setattr(variants, "FILTER_BITS", bits)
        words = {"".join(rng.choice(list("abcé"), rng.integers(1, 6))): int(rng.integers(5, 2000)) for _ in range(250)}
        assert groups(spark, words) == plain_groups(words)


def test_neighbours_are_all_and_distinct():
    alphabet = b"abc"
    for word in (b"a", b"aab", b"abcabc", b"bbbbb"):
        text = word.decode()
        want = {text[:k] + text[k + 1 :] for k in range(len(text))} | {text[:k] + c + text[k + 1 :] for k in range(len(text)) for c in "abc"} - {text}
        want |= {text[:k] + c + text[k:] for k in range(len(text) + 1) for c in "abc"}
        with np.errstate(over="ignore"):
            got = list(variants.neighbourhood(np.frombuffer(word, np.uint8)[None, :], np.frombuffer(alphabet, np.uint8)))
        pairs = list(zip(np.concatenate([g[1] for g in got]).tolist(), np.concatenate([g[2] for g in got]).tolist(), strict=True))
        hashes = variants.word_hashes([w.encode() for w in sorted(want)])
        assert len(pairs) == len(want) and set(pairs) == set(zip(*hashes.tolist(), strict=True))


def test_counted_words(spark):
    rows = [(None, "Ärger ÄRGER ärgern Ärgern", 0), (None, None, 0), (3, "", 0), (4, "naïve-naïve don't ÀÀÀÀÀÀ×÷", 0), (5, "wörterbuch " * 40 + "ſſſſſſſſ İstanbul", 0)]
    rows += [(k, "spelling Spelling SPELLING variants ab " * (1 + k % 3), 0) for k in range(300)] * 2 + [(9, "q" * 50_000 + " ", 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, word long").repartition(3)
    for planted in (0, 7, 199):
        assert {r.word: r.n for r in variants.counted_words(docs, planted_every=planted).collect()} == plain_words(rows, planted)


def test_variants_with_very_long_words(spark):
    words = {"ab" * 3000: 500, "ab" * 2999 + "a": 50, "ab" * 2999 + "ac": 60, "b" * 6000: 9}
    assert groups(spark, words) == plain_groups(words)


def test_variants_of_nothing(spark):
    assert variants.variant_groups(variants.counted_words(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_variants_query_like_a_plain_version(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain_groups(plain_words([tuple(r) for r in rows], queries.PLANTED_EVERY))
    assert {r.word: tuple(r) for r in queries.QUERIES["op13_spelling_variants"](spark, sf_dir).collect()} == want


# vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(sorted output rows, digest) by a loop over Python integers."""
    good = [(i, e, l) for i, e, l in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not good:
        return [], None
    sizes = Counter(len(e) for _, e, _ in good)
    dim = min(sizes, key=lambda d: (-sizes[d], d))
    good = [(i, e, l) for i, e, l in good if len(e) == dim]
    reach = vectorcodes.REACH
    ints = [[max(-reach, min(reach, math.floor(4096 * x))) for x in e] for _, e, _ in good]
    cuts = [dim * k // parts for k in range(parts + 1)]
    least = {}
    for (i, e, _), v in zip(good, ints, strict=True):
        if i not in least or e < least[i][0]:
            least[i] = (e, v)
    first = sorted(least, key=lambda i: (i is None, i or 0))[:entries]
    books = [[least[i][1][a:b] for i in first] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def nearest():
        found = []
        for v in ints:
            of = []
            for (a, b), book in zip(zip(cuts[:-1], cuts[1:], strict=True), books, strict=True):
                of.append(min((sum((x - y) ** 2 for x, y in zip(v[a:b], e, strict=True)), k) for k, e in enumerate(book)))
            found.append(of)
        return found

    for _ in range(rounds):
        near = nearest()
        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            for k in range(len(first)):
                held = [v[a:b] for v, of in zip(ints, near, strict=True) if of[p][1] == k]
                if held:
                    books[p][k] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    near = nearest()
    errors = [sum(far for far, _ in of) for of in near]
    by = Counter()
    for (_, _, label), error in zip(good, errors, strict=True):
        by[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in of), error, by[l], digest) for (i, _, l), of, error in zip(good, near, errors, strict=True)), key=repr), digest


def vector_rows(n=400, dim=16, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dim))
    data = [[float(np.float32(x)) for x in centres[k % 9] * 0.3 + rng.standard_normal(dim) * 0.1] for k in range(n)]
    return [(k * 3 % 1009, v, None if k % 7 == 0 else k % 4) for k, v in enumerate(data)]


SCHEMA = "vec_id long, embedding array<float>, label int"


def coded(spark, rows, schema=SCHEMA, parts_of=5, **how):
    found = vectorcodes.code_report(spark.createDataFrame(rows, schema).repartition(parts_of), **how).collect()
    return sorted((tuple(r) for r in found), key=repr)


def awkward_vectors():
    rows = vector_rows()
    odd = [(1, None, 1), (2, [None] * 16, 1), (4, [math.nan] * 16, 1), (5, [math.inf] + [0.0] * 15, 2), (7, [0.5] * 4, 2), (8, [], 2)]
    odd += [(None, [0.25] * 16, None), (None, [0.5] * 16, 3), (0, [-0.9] * 16, 1), (0, [-0.9] * 16, 1), (3, [1.0] * 16, 0), (2000, [1e30] * 16, 0), (2001, [-20.0] * 16, 0)]
    return rows + odd + [(3001, [0.125] * 16, 2)] * 200


def test_vector_codes(spark, monkeypatch):
    want, digest = plain_codes(awkward_vectors())
    assert coded(spark, awkward_vectors()) == want
    monkeypatch.setattr(vectorcodes, "CELLS", 300)
    assert coded(spark, awkward_vectors(), parts_of=2) == want


@pytest.mark.parametrize("dim", [3, 13, 24])
def test_vector_codes_of_any_length(spark, dim):
    rows = vector_rows(90, dim)
    assert coded(spark, rows, entries=5, rounds=3) == plain_codes(rows, entries=5, rounds=3)[0]


def test_few_and_no_vectors(spark):
    rows = vector_rows(4)
    assert coded(spark, rows) == plain_codes(rows)[0]
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1), (2, [math.nan], 1)]) == []


def test_only_null_ids(spark):
    rows = [(None, v, k) for _, v, k in vector_rows(30)]
    found = coded(spark, rows)
    assert found == plain_codes(rows)[0] and {r[0] for r in found} == {None}


def test_other_columns_with_clashing_names(spark):
    rows = [(*r, 7, "x") for r in vector_rows(40)]
    assert coded(spark, rows, SCHEMA + ", code long, error string") == plain_codes([r[:3] for r in rows])[0]


def test_sums_from_deltas_are_those_of_all_parts(spark):
    rows = vector_rows(300)
    kept, dim = vectorcodes.usable(spark.createDataFrame(rows, SCHEMA))
    blocks, books = vectorcodes.fitted(kept, dim, rounds=4)
    ints = vectorcodes.integers(np.array([e for _, e, _ in rows]))
    held = [r for b in blocks.collect() for r in zip(b.ids, np.frombuffer(b.codes, np.uint8).reshape(-1, 8), strict=True)]
    codes = {i: c for i, c in held}
    for part, (a, b) in enumerate(books.spans):
        of = np.array([codes[i][part] for i, _, _ in rows])
        assert books.counts[part].tolist() == np.bincount(of, minlength=16).tolist()
        assert books.sums[part].tolist() == [ints[of == k, a:b].sum(axis=0).tolist() for k in range(16)]


def test_only_changed_parts_give_deltas(spark):
    rows = vector_rows(300)
    kept, dim = vectorcodes.usable(spark.createDataFrame(rows, SCHEMA))
    blocks, books = vectorcodes.fitted(kept, dim, rounds=2)
    again = vectorcodes.reassigned(vectorcodes.reassigned(blocks, books, dim), books, dim)
    assert again.agg(F.max(F.size("deltas"))).first()[0] == 0


def test_codes_stand_for_near_vectors(spark):
    rows = [(k, v, l) for k, (_, v, l) in enumerate(vector_rows(500))]
    found, books = vectorcodes.vector_codes(spark.createDataFrame(rows, SCHEMA))
    near = {r.vec_id: r.approximation for r in vectorcodes.decoded(found, books).collect()}
    whole = {r.vec_id: r.error for r in found.collect()}
    ints = vectorcodes.integers(np.array([v for _, v, _ in rows]))
    for k, v in enumerate(ints):
        assert int(((v - np.array(near[k]) * 4096) ** 2).sum()) == whole[k]
    mean = np.array([v for _, v, _ in rows]).mean(axis=0)
    assert sum(whole.values()) / 4096**2 < 0.4 * sum(float(((np.array(v) - mean) ** 2).sum()) for _, v, _ in rows)


@pytest.mark.parametrize("name, table", [("op11_vector_codes", "embeddings"), ("op12_line_dedup", "documents")])
def test_like_sql(spark, sf_dir, name, table):
    got = queries.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
