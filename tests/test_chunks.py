"""Chunk rows against a plain version that builds every candidate text and counts its tokens."""

from __future__ import annotations

import re

import pytest

from tallyspark.operators import chunks as chk
from tallyspark.operators import documents as docs

count = lambda text: len(docs.TOKEN.findall(text))
cut = lambda text, a, b=None: " ".join(docs.TOKEN.findall(text)[a:b])
LAW = "Kanun: 213 Sayılı Vergi Usul Kanunu\nKanun No: 213"


def headed(group, part=None):
    lines = [LAW]
    for label, key in (("Kısım", "chapter"), ("Bölüm", "section")):
        names = sorted({a[key] for a in group if a[key]})
        lines += [f"{label}: {' / '.join(names)}"] if names else []
    if len(group) == 1:
        lines += [f"Madde: {group[0]['no']}"] + ([f"Madde Başlığı: {group[0]['title']}"] if group[0]["title"] else [])
    else:
        lines.append("Maddeler: " + ", ".join(a["no"] for a in group))
    if part:
        lines.append("Madde Parçası: %d/%d" % part[:2])
    return "\n".join(lines) + "\n\n" + (part[2] if part else "\n\n".join(a["text"] for a in group))


def parts_of(article, model, overlap):
    room_for = max(256, model - count(headed([article], (1, 1, ""))) - 32)
    room = max(128, room_for - overlap)
    units = re.split(r"\n(?=[ \t]*(?:\(\d+\)|\d+\.)[ \t]+)", article["text"])
    if len(units) == 1:
        units = [x for x in re.split(r"\n\s*\n|\n(?=[A-ZÇĞİÖŞÜ0-9])", article["text"]) if x.strip()]
    raw, held = [], []
    for unit in (u.strip() for u in units):
        if count(unit) > room:
            raw += ["\n\n".join(held)] if held else []
            held = []
            raw += [cut(unit, k, k + room) for k in range(0, count(unit), room)]
        elif count("\n\n".join([*held, unit])) <= room:
            held.append(unit)
        else:
            raw += ["\n\n".join(held)] if held else []
            held = [unit]
    raw += ["\n\n".join(held)] if held else []
    bodies = [part if k == 0 else f"{cut(raw[k - 1], -overlap)}\n\n{part}" for k, part in enumerate(raw)]
    return [headed([article], (k, len(raw), body)) for k, body in enumerate(bodies, 1)]


def plain(articles, target, model, overlap):
    out, group = [], []

    def flush():
        if group:
            out.append(("single_article" if len(group) == 1 else "multi_article", [a["no"] for a in group], headed(group)))
            group.clear()

    for a in articles:
        n = count(headed([a]))
        if n > target:
            flush()
            out.extend([("article_part", [a["no"]], t) for t in parts_of(a, model, overlap)] if n > model else [("single_article_long", [a["no"]], headed([a]))])
        else:
            if group and count(headed([*group, a])) > target:
                flush()
            group.append(a)
    flush()
    return out


def law():
    words = lambda k, n: " ".join(f"söz{k}x{j}" + ("," if j % 7 == 3 else "") for j in range(n))
    sizes = [10, 15, 90, 20, 5, 700, 30, 8, 8, 8, 260, 12, 400, 6]
    articles, lines, chapter, section = [], [], None, None
    for k, n in enumerate(sizes, 1):
        if k in (3, 8, 9):
            chapter = {3: "BİRİNCİ KISIM", 8: "İKİNCİ KISIM", 9: "ÜÇÜNCÜ KISIM"}[k]
            lines.append(chapter)
        if k in (4, 9):
            section = {4: "BİRİNCİ BÖLÜM", 9: "İKİNCİ BÖLÜM"}[k]
            lines.append(section)
        title = f"Konu {k}" if k % 3 == 1 else None
        lines += [f"Konu {k}:"] if title else []
        no = f"{k}/A" if k == 5 else str(k)
        first = f"MADDE {no} - {words(k, min(n, 40))}"
        rest = [f"({j}) {words(100 * k + j, 37)}" for j in range(1, (n - 40) // 40 + 1)] if k != 13 else [words(1300, n - 40)]
        lines += [first, *rest]
        articles.append({"no": no, "title": title, "chapter": chapter, "section": section, "text": "\n".join([first, *rest])})
    return articles, "\n".join(lines)


@pytest.fixture(scope="module")
def metadata(spark):
    return spark.createDataFrame([(k, f"law_213_{k}", "213", "213 Sayılı Vergi Usul Kanunu") for k in range(1, 6)], "doc_id long, document_id string, law_no string, official_name string")


@pytest.mark.parametrize("target, model, overlap", [(60, 300, 20), (120, 400, 30), (1024, 8192, 200)])
def test_article_chunks_like_a_plain_version(spark, metadata, target, model, overlap):
    articles, text = law()
    rows = docs.body_lines(docs.lines(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    found = docs.articles(docs.article_lines(rows)).join(metadata, "doc_id")
    got = sorted(chk.article_chunks(found, target, model, overlap).collect(), key=lambda r: r.chunk_index)
    want = plain(articles, target, model, overlap)
    assert [(r.chunk_type, r.included_articles, r.text) for r in got] == [(kind, ",".join(numbers), t) for kind, numbers, t in want]
    assert [r.token_count for r in got] == [count(t) for *_, t in want] and [r.chunk_index for r in got] == list(range(1, len(want) + 1))
    assert all(r.token_count <= (model if r.chunk_type == "article_part" else target) or r.chunk_type == "single_article_long" for r in got)
    for r, (kind, numbers, _) in zip(got, want, strict=True):
        middle = f"_article_{numbers[0]}_part_{r.article_part}" if kind == "article_part" else f"_article_{numbers[0]}" if len(numbers) == 1 else f"_articles_{numbers[0]}_{numbers[-1]}"
        assert r.id == f"law_213_1{middle}_chunk_{r.chunk_index}" and r.included_articles_padded == "|" + "|".join(numbers) + "|"


def test_documents_with_and_without_articles(spark, metadata):
    _, text = law()
    plain_text = "\n".join(" ".join(f"w{k}x{j}" for j in range(40)) for k in range(20))
    rows = [(1, text), (2, plain_text), (3, "MADDE 1 - tek madde\nbir satır daha"), (4, ""), (5, None)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = chk.document_chunks(docs.lines(documents), metadata, 140, 400).cache()
    kinds = {r.doc_id: set(r.kinds) for r in chunks.groupBy("doc_id").agg(__import__("pyspark").sql.functions.collect_set("chunk_type").alias("kinds")).collect()}
    assert kinds[2] == kinds[3] == {"fallback_text_chunk"} and "fallback_text_chunk" not in kinds[1] and set(kinds) == {1, 2, 3}
    header = "Kaynak: 213 Sayılı Vergi Usul Kanunu\nKanun No: 213\n\n"
    own = sorted((r for r in chunks.collect() if r.doc_id == 2), key=lambda r: r.chunk_index)
    limit = max(128, 140 - count(header) - 8)
    assert [r.id for r in own] == [f"law_213_2_fallback_chunk_{k}" for k in range(1, len(own) + 1)]
    # a line follows what is carried over, whatever that comes to
    assert all(r.text.startswith(header) and r.token_count <= limit + docs.LINE_OVERLAP + count(header) for r in own)
    for a, b in zip(own, own[1:]):
        tail = cut(a.text[len(header) :], -docs.LINE_OVERLAP)
        assert b.text[len(header) :].startswith(tail)
    report = {r.doc_id: (r.n_chunks, r.failed) for r in chk.document_report(documents, chunks).collect()}
    assert report[4] == report[5] == (0, True) and report[3] == (1, False)
