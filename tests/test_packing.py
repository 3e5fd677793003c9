"""Packing by borders against plain versions that take one unit after the other."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import chunks as chk
from tallyspark.operators import documents as docs
from tallyspark.operators import packing as pk

tokens_of = docs.TOKEN.findall


@pytest.fixture(params=[pk.LOCAL, 3], ids=["in one row", "by joins"])
def followed(request, monkeypatch):
    monkeypatch.setattr(pk, "LOCAL", request.param)


def plain_packs(sizes, target):
    out = []
    for k, n in enumerate(sizes):
        if out and sum(out[-1][1]) + n <= target:
            out[-1][1].append(n)
        else:
            out.append((k, [n]))
    return [(first, first + len(held) - 1, len(held), sum(held)) for first, held in out]


def test_greedy_chunks(spark, followed):
    rng = random.Random(4)
    made = {d: [rng.choice([0, 1, 3, 9, 10, 11, 40]) for _ in range(rng.randint(1, 60))] for d in range(40)}
    made |= {100: [0] * 7, 101: [10] * 9, 102: [1] * 50, 103: [99]}
    units = spark.createDataFrame([(d, 2 * k, n) for d, of in made.items() for k, n in enumerate(of)], "doc_id long, unit int, n long").repartition(4)
    got = {}
    for r in docs.greedy_chunks(units, 10).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append((r.first_unit // 2, r.last_unit // 2, r.n_units, r.n_tokens))
    assert got == {d: plain_packs(of, 10) for d, of in made.items()}


def test_nothing_to_pack(spark, followed):
    assert docs.greedy_chunks(spark.createDataFrame([], "doc_id long, unit int, n long")).count() == 0
    assert docs.overlap_chunks(spark.createDataFrame([(1, None), (2, ""), (3, " \n\t")], "doc_id long, text string")).count() == 0


def plain_parts(lines, limit, overlap):
    """(text, first page, last page): one line after the other, the part that is being made as [(page, text)]."""
    out, held, new = [], [], False

    def end(text, first, last):
        out.append((text, first, last))
        tail = tokens_of(text)[-overlap:] if overlap else []
        return [(last, " ".join(tail))] if tail else []

    done = lambda: end("\n".join(t for _, t in held), held[0][0], held[-1][0])
    for page, line in lines:
        own = tokens_of(line)
        if len(own) > limit:
            if held:
                done()
            for at in range(0, len(own), max(1, limit - overlap)):
                held = end(" ".join(own[at : at + limit]), page, page)
            new = False
        else:
            if held and sum(len(tokens_of(t)) for _, t in held) + len(own) > limit:
                held = done()
            held.append((page, line))
            new = True
    if new:
        done()
    return out


def made_lines(rng, n):
    return [(1 + k // 4, " ".join(rng.choice(["söz", "a-b", "x.", "(1)", "word"]) + str(k) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 30, 47])))) for k in range(n)]


@pytest.mark.parametrize("limit, overlap", [(12, 4), (20, 0), (9, 9), (7, 30), (30, 1), (1000, 50)])
def test_overlapping_parts(spark, followed, limit, overlap):
    rng = random.Random(limit * 31 + overlap)
    made = {d: made_lines(rng, rng.randint(1, 40)) for d in range(25)}
    rows = [(d, page, k, text, limit) for d, of in made.items() for k, (page, text) in enumerate(of)]
    got = {}
    table = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, limit int").repartition(3)
    for r in docs.overlapping_parts(table, overlap).orderBy("doc_id", "chunk").collect():
        assert r.n_tokens == len(tokens_of(r.body)) and r.chunk == len(got.get(r.doc_id, [])) + 1
        got.setdefault(r.doc_id, []).append((r.body, r.page_start, r.page_end))
    assert got == {d: plain_parts(of, limit, overlap) for d, of in made.items()}


def test_limits_of_documents_differ(spark):
    rng = random.Random(8)
    made = {d: (made_lines(rng, 20), 5 + 3 * d) for d in range(8)}
    rows = [(d, page, k, text, limit) for d, (of, limit) in made.items() for k, (page, text) in enumerate(of)]
    table = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, limit int")
    got = {r.doc_id: [x.body for x in r.u] for r in docs.overlapping_parts(table, 4).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "body"))).alias("u")).collect()}
    assert got == {d: [t for t, *_ in plain_parts(of, limit, 4)] for d, (of, limit) in made.items()}


def plain_articles(articles, target):
    """(pack of each article) by writing every candidate's header and text."""
    size = lambda held: len(tokens_of("\n".join(x for x in (
        "Kanun: K\nKanun No: 1", *(f"{label}: {' / '.join(sorted(names))}" for label, names in (("Kısım", {a[0] for a in held if a[0]}), ("Bölüm", {a[1] for a in held if a[1]})) if names),
        "Maddeler: " + ", ".join(a[2] for a in held), *(a[3] for a in held)) if x)))
    packs, held = [], []
    for a in articles:
        if a[4]:
            packs.append((packs[-1] if packs else 0) + 1)
            held = []
        elif held and size([*held, a]) <= target:
            held.append(a)
            packs.append(packs[-1])
        else:
            held = [a]
            packs.append((packs[-1] if packs else 0) + 1)
    return packs


def test_articles_with_recurring_headings(spark, followed):
    rng = random.Random(6)
    made = {}
    for d in range(12):
        rows = []
        for k in range(rng.randint(2, 30)):
            names = [rng.choice([None, "BİRİNCİ KISIM", "İKİNCİ KISIM"]), rng.choice([None, "A", "B BÖLÜM", "C / D"])]
            rows.append((*names, f"{k}/A" if k % 5 == 4 else str(k), " ".join(["söz,"] * rng.randint(1, 12)), rng.random() < 0.1))
        made[d] = rows
    table = [(d, k, a[2], None, a[0], a[1], a[3], "K", "1", "single_article_long" if a[4] else None) for d, rows in made.items() for k, a in enumerate(rows)]
    frame = spark.createDataFrame(table, "doc_id long, ordinal long, article_no string, article_title string, chapter_name string, section_name string, text string, official_name string, law_no string, given string")
    sizes = chk.measured(frame, 10_000, 20_000).withColumn("own_kind", F.col("given"))
    got = {}
    for r in chk.packed(sizes, 60).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append(r.pack)
    assert got == {d: plain_articles(rows, 60) for d, rows in made.items()}


def test_a_document_of_a_million_lines(spark):
    """Far more units than one row follows: borders by joins, and each part whole."""
    n = 1_000_000
    units = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("unit"), (F.col("id") % 7 + 1).alias("n"))
    got = docs.greedy_chunks(units, 1024).agg(F.count("*").alias("k"), F.sum("n_units").alias("u"), F.sum("n_tokens").alias("t"), F.max("n_tokens").alias("most"), F.min("n_tokens").alias("least"), F.max("last_unit").alias("end")).first()
    assert (got.u, got.t, got.end) == (n, sum(k % 7 + 1 for k in range(n)), n - 1) and got.most <= 1024 and got.k <= got.t // (1024 - 7) + 1


def test_a_long_line_of_very_many_pieces_meets_its_text_once(spark):
    """With an overlap beyond the limit a line has a piece for each token; its text isn't repeated for each."""
    words = [f"w{k}" for k in range(20_000)]
    table = spark.createDataFrame([(1, 1, 1, "before", 30, "x"), (1, 1, 2, " ".join(words), 30, "x"), (1, 1, 3, "after", 30, "x")], "doc_id long, page int, line_no int, text string, limit int, about string")
    got = docs.overlapping_parts(table, 40, "about").orderBy("chunk").collect()
    assert [r.chunk for r in got] == list(range(1, len(got) + 1)) and {r.about for r in got} == {"x"}
    pieces = [r for r in got if r.body.startswith("w")]
    assert got[0].body == "before" and len([r for r in pieces if "\n" not in r.body]) >= 20_000
    assert [r.body for r in got[1:20_001]] == [" ".join(words[k : k + 30]) for k in range(20_000)]
    assert all(r.n_tokens == len(r.body.split()) for r in got)
