"""Article state carried through blocks of lines, against one line after the other."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import documents as docs

HEADS = {"BİRİNCİ KISIM": "chapter", "İKİNCİ KISIM": "chapter", "GİRİŞ": "chapter", "BİRİNCİ BÖLÜM": "section", "İKİNCİ BÖLÜM": "section"}


def plain_lines(lines):
    """(line, ordinal, number, title, prefix, chapter, section) of the lines that stay."""
    kinds = []
    for line in lines:
        m = re.match(r"((?:(?:Geçici|Ek) )?Madde) (\d+)", line)
        kinds.append(("head", HEADS[line]) if line in HEADS else ("start", m.groups()) if m else ("title", line.rstrip(":")) if line.startswith("Konu") else ("body", None))
    out, state, n = [], {"chapter": None, "section": None}, 0
    own = (None, None, None, None, None)
    for k, (line, (kind, value)) in enumerate(zip(lines, kinds, strict=True)):
        if kind == "head":
            state[value] = line
            continue
        if kind == "title" and k + 1 < len(lines) and kinds[k + 1][0] == "start":
            continue
        if kind == "start":
            n += 1
            own = (value[1], kinds[k - 1][1] if k and kinds[k - 1][0] == "title" else None, value[0], state["chapter"], state["section"])
        out.append((line, n, *own) if n else (line, 0, None, None, None, state["chapter"], state["section"]))
    return out


def made(rng, n):
    return [rng.choice([*HEADS, f"Konu {k}:", f"Konu {k}:", f"Madde {k} - söz;", f"Geçici Madde {k} - söz;", f"satır {k} burada biter.", f"satır {k} sürer;"]) for k in range(n)]


@pytest.mark.parametrize("block, page", [(1, 1000), (3, 7), (2048, 5), (2048, 1000)])
def test_any_blocks(spark, monkeypatch, block, page):
    monkeypatch.setattr(docs, "BLOCK_LINES", block)
    rng = random.Random(block * 7 + page)
    texts = {d: made(rng, rng.randint(1, 45)) for d in range(30)}
    rows = [(d, k // page, k, line, "kept") for d, lines in texts.items() for k, line in enumerate(lines)]
    table = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, form string").repartition(3)
    got = {}
    for r in docs.article_lines(table).orderBy("doc_id", "page", "line_no").collect():
        assert r.form == "kept"
        got.setdefault(r.doc_id, []).append((r.text, r.ordinal, r.article_no, r.article_title, r.prefix, r.chapter_name, r.section_name))
    assert got == {d: found for d, lines in texts.items() if (found := plain_lines(lines))}


def test_lines_numbered_by_page(spark, monkeypatch):
    monkeypatch.setattr(docs, "BLOCK_LINES", 2)
    lines = ["GİRİŞ", "Konu a:", "Madde 1 - x;", "y", "BİRİNCİ BÖLÜM", "z", "Konu b:", "Madde 2 - x;", "son."]
    table = spark.createDataFrame([(1, 1 + k // 3, k % 3, t) for k, t in enumerate(lines)], "doc_id long, page int, line_no int, text string")
    got = [(r.text, r.ordinal, r.article_no, r.article_title, r.prefix, r.chapter_name, r.section_name) for r in docs.article_lines(table).orderBy("page", "line_no").collect()]
    assert got == plain_lines(lines)


def test_texts_of_a_document_are_spread(spark):
    """No window holds all texts of a document, and a million lines come through."""
    n = 1_000_000
    line = F.when(F.col("id") % 500 == 0, F.concat(F.lit("Madde "), F.col("id") / 500 + 1, F.lit(" - söz;"))).otherwise(F.concat(F.lit("satır "), "id", F.lit(";")))
    rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.floor(F.col("id") / 40) + 1).cast("int").alias("page"), F.col("id").cast("int").alias("line_no"), line.alias("text"))
    found = docs.article_lines(rows)
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", found._jdf.queryExecution().optimizedPlan().toString())
    alone = [w for w in windows if re.fullmatch(r"doc_id#\w+|_w\d+|", w)]
    assert windows and len(alone) <= 2
    r = found.agg(F.count("*").alias("n"), F.max("ordinal").alias("articles"), F.count_distinct("article_no").alias("numbers")).first()
    assert (r.n, r.articles, r.numbers) == (n, n // 500, n // 500)
