"""Regulatory text: lines, running headers, articles, chunks, metadata, deduplication and retrieval."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..sources.files import spread
from ..sources.scratch import drop, written
from . import packing as pk

PAGE_LINES = 40
# Token limits of chunks.
TARGET_TOKENS, MODEL_TOKENS, SPLIT_OVERLAP, LINE_OVERLAP = 1024, 8192, 200, 150
# The heading grammar of laws.
ORDINALS = "BİRİNCİ|İKİNCİ|ÜÇÜNCÜ|DÖRDÜNCÜ|BEŞİNCİ|ALTINCI|YEDİNCİ|SEKİZİNCİ|DOKUZUNCU|ONUNCU"
ARTICLE = r"(?iu)^\s*((?:(?:mükerrer|geçici|ek)\s+)?madde)\s+(\d+[/A-Za-zÇĞİÖŞÜçğıöşü]*)\s*[-–—:]?"
CHAPTER = rf"(?iu)^\s*((?:{ORDINALS})\s+KISIM|BAŞLANGIÇ|GİRİŞ)\s*$"
SECTION = rf"(?iu)^\s*((?:{ORDINALS})\s+BÖLÜM)\s*$"
TOKEN = re.compile(r"\w+|[^\w\s]")
LAW_NAMES = {"193": "Gelir Vergisi Kanunu", "213": "Vergi Usul Kanunu", "3065": "Katma Değer Vergisi Kanunu", "5237": "Türk Ceza Kanunu", "5510": "Sosyal Sigortalar ve Genel Sağlık Sigortası Kanunu", "6102": "Türk Ticaret Kanunu"}


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, page, text): one row per line, cleaned; pages are PAGE_LINES lines.

    A text is cleaned whole: no cleaning step reaches over a line's end, and the one space
    that it may leave at either end of a line goes with the split.
    """
    out = spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(F.split(X.clean_line(F.col("text")), " ?\n ?")).alias("pos", "text"))
    return out.select("doc_id", (F.col("pos") + 1).alias("line_no"), (F.floor(F.col("pos") / PAGE_LINES) + 1).cast("int").alias("page"), "text")


def repeated_lines(rows: DataFrame, ratio: float = 0.35) -> DataFrame:
    """(doc_id, form, n_pages): lines at the edges of many of a document's pages (four pages at least)."""
    page = Window.partitionBy("doc_id", "page")
    placed = rows.withColumn("a", F.row_number().over(page.orderBy("line_no"))).withColumn("b", F.row_number().over(page.orderBy(F.desc("line_no")))).where("a <= 3 or b <= 3")
    form = X.repeated_form(F.col("text"))
    seen = placed.select("doc_id", "page", form.alias("form")).where(F.length("form").between(5, 140)).distinct().groupBy("doc_id", "form").agg(F.count("*").alias("n_pages"))
    pages = rows.groupBy("doc_id").agg(F.count_distinct("page").alias("pages")).where("pages >= 4")
    return seen.join(pages, "doc_id").where(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(F.col("pages") * ratio))).select("doc_id", "form", "n_pages")


def body_lines(rows: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Lines that are neither blank, page numbers nor running headers."""
    out = rows.where((F.col("text") != "") & ~X.is_page_number(F.col("text")))
    if repeated is None:
        return out
    return out.withColumn("form", X.repeated_form(F.col("text"))).join(repeated.select("doc_id", "form"), ["doc_id", "form"], "left_anti").drop("form")


def article_prefix(c: Column) -> Column:
    up = F.upper(X.fold(c))
    return F.when(up.contains("GEC"), "Geçici Madde").when(up.contains("MUK"), "Mükerrer Madde").when(up.startswith("EK"), "Ek Madde").otherwise("Madde")


def is_title(c: Column) -> Column:
    """Short lines that may be the title of the article below them."""
    t = F.trim(c)
    bare = F.trim(F.regexp_replace(t, ":+$", ""))
    blocked = t.rlike(ARTICLE) | t.rlike(CHAPTER) | t.rlike(SECTION) | t.rlike(r"(?iu)Kanun\s+Numarası\s*:\s*\d+") | F.upper(t).rlike("RESMİ GAZETE|YAYIMLANDIĞI|KABUL TARİHİ|KANUN NUMARASI")
    short = (F.size(F.split(bare, r"\s+")) <= 12) & ~t.rlike("[.;,]$")
    return F.length(bare).between(3, 140) & ~blocked & (t.endswith(":") | short)


#: Lines of a page that one block holds, if pages are that long.
BLOCK_LINES = 1 << 11
_BLOCK = ("doc_id", "page", "_block")


def article_lines(rows: DataFrame, article: str = ARTICLE, chapter: str = CHAPTER, section: str = SECTION, titles: bool = True, heading_chars: int = 60) -> DataFrame:
    """Each body line with its article's ordinal, number, title, chapter and section, carried forward.

    A title line belongs to the article below it, not to the one above. Lines before the
    first article have ordinal 0 and no number; an article keeps the chapter and section that
    it began in. doc_id, page and line_no together name one line. A cleaned line longer than ``heading_chars`` is no heading of a chapter or section.

    A scan in segments: lines are sorted within blocks (a page, or BLOCK_LINES of it), which
    say what they last saw; these few rows are scanned along their document, and what comes
    into a block is joined to its lines. So a document's texts are spread over tasks. What a
    line says by itself is written first, since the blocks are read twice: for what they last
    saw, without texts, and to be completed.
    """
    found = lambda p, g: F.nullif(F.regexp_extract("text", p, g), F.lit(""))
    short = lambda c: F.when(F.length("text") <= heading_chars, c)
    out = rows.select("*", F.floor(F.col("line_no") / BLOCK_LINES).alias("_block"), short(found(chapter, 1)).alias("_chapter"), short(found(section, 1)).alias("_section"), found(article, 2).alias("_no"), found(article, 1).alias("_prefix"))
    out = out.withColumn("_heading", F.coalesce("_chapter", "_section").isNotNull())
    out = out.withColumn("_starts", F.col("_no").isNotNull() & ~F.col("_heading"))
    said = F.when(~F.col("_heading") & ~F.col("_starts") & is_title(F.col("text")), F.trim(F.regexp_replace(F.trim("text"), ":+$", ""))) if titles else F.lit(None).cast("string")
    out = written(out.withColumn("_said", said))

    block = Window.partitionBy(*_BLOCK).orderBy("line_no")
    upto = block.rowsBetween(Window.unboundedPreceding, 0)
    seen = lambda c: F.last(c, ignorenulls=True).over(upto)
    out = out.select("*", F.row_number().over(block).alias("_at"), F.lead("_starts").over(block).alias("_before_start"), F.lag("_said").over(block).alias("_title"), seen("_chapter").alias("_chapter_seen"), seen("_section").alias("_section_seen"), F.sum(F.col("_starts").cast("int")).over(upto).alias("_n"))
    begun = F.struct(F.col("_no").alias("no"), F.col("_prefix").alias("prefix"), F.col("_title").alias("title"), F.col("_chapter_seen").alias("chapter"), F.col("_section_seen").alias("section"), (F.col("_at") == 1).alias("first"))
    out = out.withColumn("_article", seen(F.when(F.col("_starts"), begun)))

    last = lambda c, name: F.max_by(c, "_at").alias(name)
    edges = out.groupBy(*_BLOCK).agg(last("_chapter_seen", "chapter"), last("_section_seen", "section"), last("_n", "n"), last("_said", "said"), last("_article", "article"), F.min_by("_starts", "_at").alias("starts"))
    doc = Window.partitionBy("doc_id").orderBy("page", "_block")
    past = doc.rowsBetween(Window.unboundedPreceding, -1)
    come = lambda c: F.last(c, ignorenulls=True).over(past)
    edges = edges.select("*", come("chapter").alias("_chapter_in"), come("section").alias("_section_in"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("_n_in"), F.lag("said").over(doc).alias("_said_in"), F.lead("starts").over(doc).alias("_starts_out"))
    edges = edges.withColumn("_article_in", come(F.when(F.col("article").isNotNull(), _whole(F.col("article")))))

    # a line's article began in its block, or came into it
    whole = F.when(F.col("_article").isNotNull(), _whole(F.col("_article"))).otherwise(F.col("_article_in"))
    placed = out.join(edges.select(*_BLOCK, "_chapter_in", "_section_in", "_n_in", "_said_in", "_starts_out", "_article_in").hint("merge"), list(_BLOCK)).withColumn("_own", whole)
    above = F.coalesce("_before_start", "_starts_out", F.lit(False)) & F.col("_said").isNotNull()
    placed = placed.where(~F.col("_heading") & ~above)
    ordinal = F.col("_n_in") + F.col("_n")
    kept = lambda own, seen_, come_: F.when(ordinal > 0, F.col(f"_own.{own}")).otherwise(F.coalesce(seen_, come_))
    return placed.select(
        *rows.columns, ordinal.alias("ordinal"), F.col("_own.no").alias("article_no"), F.col("_own.title").alias("article_title"), F.col("_own.prefix").alias("prefix"),
        kept("chapter", "_chapter_seen", "_chapter_in").alias("chapter_name"), kept("section", "_section_seen", "_section_in").alias("section_name"),
    )


def _whole(begun: Column) -> Column:
    """An article as it began in a block, completed by what came into the block."""
    return F.struct(
        begun["no"].alias("no"), begun["prefix"].alias("prefix"), F.when(begun["first"], F.col("_said_in")).otherwise(begun["title"]).alias("title"),
        F.coalesce(begun["chapter"], F.col("_chapter_in")).alias("chapter"), F.coalesce(begun["section"], F.col("_section_in")).alias("section"),
    )


def articles(placed: DataFrame) -> DataFrame:
    """One row per article from article_lines: its text in order, pages and headings."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "text"))), lambda x: x["text"]), "\n")
    grouped = placed.where("ordinal > 0").groupBy("doc_id", "ordinal").agg(F.first("article_no", True).alias("article_no"), F.first("article_title", True).alias("article_title"), article_prefix(F.first("prefix", True)).alias("article_prefix"), F.first("chapter_name", True).alias("chapter_name"), F.first("section_name", True).alias("section_name"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.trim(text).alias("text"))
    return grouped.where("text <> ''")


def written_articles(body: DataFrame) -> DataFrame:
    """``articles`` of body lines as a written table, with the tokens of their texts (n_body); what was written of the lines on the way is removed."""
    placed = article_lines(body)
    found = written(articles(placed).withColumn("n_body", X.token_count(F.col("text"))))
    drop(placed)
    return found


def greedy_chunks(units: DataFrame, target: int = TARGET_TOKENS) -> DataFrame:
    """(doc_id, chunk, n_units, n_tokens, first_unit, last_unit): units (doc_id, unit, n) packed in order while they fit."""
    rows = pk.placed(units.select("doc_id", F.col("unit").cast("int").alias("unit"), F.col("n").cast("long").alias("n")), "unit")
    rows = pk.first_beyond(rows, F.col("upto") - F.col("n") + target, "found")
    packed = pk.packs(rows.withColumn("nxt", pk.next_border(F.col("found"))), "unit", "n", "upto")
    n_tokens = F.col("last.upto") - F.col("first.upto") + F.col("first.n")
    return packed.select("doc_id", F.col("pack").alias("chunk"), (F.col("last_at") - F.col("first_at") + 1).alias("n_units"), n_tokens.alias("n_tokens"), F.col("first.unit").alias("first_unit"), F.col("last.unit").alias("last_unit"))


def chunk_kind(n_units: Column, n_tokens: Column, target: int = TARGET_TOKENS) -> Column:
    return F.when(n_tokens > target, "single_article_long").when(n_units == 1, "single_article").otherwise("multi_article")


def quality_report(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.col("kind") == "single_article").alias("n_single"), F.count_if(F.col("kind") == "multi_article").alias("n_multi"), F.count_if(F.col("kind") == "single_article_long").alias("n_long"), F.max("n_tokens").alias("max_tokens"), F.round(F.avg("n_tokens"), 4).alias("avg_tokens"))


#: Pieces of a long line that are made in one row.
BLOCK_PIECES = 1 << 10


def overlapping_parts(rows: DataFrame, overlap: int, *keep: str) -> DataFrame:
    """(doc_id, chunk, body, n_tokens, page_start, page_end, and ``keep``): lines packed to a limit, each part beginning with the end of the one before.

    ``rows`` are (doc_id, page, line_no, text, limit, and ``keep``); ``limit`` and ``keep`` are the
    same for all lines of a document, and doc_id, page and line_no together name one line.
    A part begins with the last tokens that came before it, ``overlap`` at most, and takes
    lines while they fit, one at least. A line beyond the limit is cut by tokens into pieces
    that overlap likewise; after it only the last piece is carried on, and is a part of its
    own where the next line doesn't fit beside it. All parts are runs of the document's
    tokens, so their borders and the lines that each takes tokens from follow from numbers.
    A long line meets its text and is made tokens once, however many pieces it gives.
    """
    units = rows.select("doc_id", "page", "line_no", F.col("limit").cast("long").alias("limit"), X.token_count(F.col("text")).cast("long").alias("n"))
    # numbers only, which the packing and the texts' places both read
    units = written(pk.placed(units, "page", "line_no"))
    places = units.select("doc_id", "at", "page", "line_no")
    doc = Window.partitionBy("doc_id").orderBy("at")
    step = F.greatest(F.lit(1), F.col("limit") - overlap)
    long_, before = F.col("n") > F.col("limit"), F.col("upto") - F.col("n")
    pieces = F.when(long_, F.floor((F.col("n") - 1) / step) + 1)
    left = F.least(F.lit(overlap), F.least("limit", F.col("n") - (pieces - 1) * step))
    # what may be carried into a line: the tokens since the document's begin, or since what a long line left
    since = F.coalesce(F.last(F.when(long_, F.col("upto") - left), ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = units.select("*", pieces.alias("pieces"), F.least(F.lit(overlap), before - since).cast("long").alias("carried"), F.coalesce(F.lag(long_).over(doc), F.lit(False)).alias("cut_before"), F.lag("page").over(doc).alias("page_before"))
    units = pk.first_beyond(units, before + F.col("limit") - F.col("carried"), "found")
    units = pk.first_beyond(units, before - F.col("carried"), "tail_at")
    packed = pk.packs(units.withColumn("nxt", pk.next_border(F.col("found"))), "n", "upto", "limit", "page", "pieces", "carried", "cut_before", "page_before", "tail_at")

    own = F.col("first")
    alone = own["cut_before"] & (own["carried"] > 0) & (own["pieces"].isNotNull() | (own["carried"] + own["n"] > own["limit"]))
    # a pack's parts: what is carried, if it stands alone, then the pack's lines or its long line's pieces
    n_alone, n_pieces = F.when(alone, 1).otherwise(0), own["pieces"]
    parts = packed.select("doc_id", "pack", "first_at", "last_at", "first", "last", n_alone.alias("n_alone"), (n_alone + F.coalesce(n_pieces, F.lit(1))).alias("n_parts"))
    earlier = Window.partitionBy("doc_id").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.select("*", F.coalesce(F.sum("n_parts").over(earlier), F.lit(0)).alias("earlier")))

    kinds = F.array_compact(F.array(F.when(F.col("n_alone") > 0, F.lit(True)), F.when(n_pieces.isNull(), F.lit(False))))
    runs = parts.select("doc_id", "first_at", "last_at", "first", "last", "n_alone", "earlier", F.explode(kinds).alias("only_tail"))
    only, tail = F.col("only_tail"), own["carried"] > 0
    size = F.when(only, own["carried"]).otherwise(own["carried"] + F.col("last.upto") - own["upto"] + own["n"])
    taken = F.sequence(F.when(tail, own["tail_at"]).otherwise(F.col("first_at")), F.when(only, F.col("first_at") - 1).otherwise(F.col("last_at")))
    held = runs.select(
        "doc_id", (F.col("earlier") + F.when(only, 1).otherwise(F.col("n_alone") + 1)).cast("int").alias("chunk"), "first_at", own["carried"].alias("carried"), size.alias("n_tokens"),
        F.when(tail, own["page_before"]).otherwise(own["page"]).alias("page_start"), F.when(only, own["page_before"]).otherwise(F.col("last.page")).alias("page_end"), F.explode(taken).alias("at"),
    )
    line_keys = ["doc_id", "page", "line_no"]
    texts = held.join(places.hint("merge"), ["doc_id", "at"]).join(rows.select(*line_keys, "text", *keep).hint("merge"), line_keys)
    before_it = F.col("at") < F.col("first_at")
    # of a line before the part no more than can be carried
    end = F.when(X.token_count(F.col("text")) > overlap, F.array_join(F.slice(X.tokens(F.col("text")), -overlap, overlap), " ")).otherwise(F.col("text"))
    line = F.struct("at", F.when(before_it, end).alias("end"), F.when(~before_it, F.col("text")).alias("text"))
    same = ("carried", "n_tokens", "page_start", "page_end", *keep)
    whole = texts.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(line)).alias("u"), *[F.first(c).alias(c) for c in same])
    carried = F.flatten(F.transform(F.array_compact(F.col("u.end")), lambda x: X.tokens(x)))
    whole = whole.select("*", carried.alias("t"))
    carried = F.when(F.size("t") > 0, F.array_join(F.slice("t", (-F.col("carried")).cast("int"), F.col("carried").cast("int")), " "))
    body = F.concat_ws("\n", carried, F.nullif(F.array_join(F.col("u.text"), "\n"), F.lit("")))
    out = ["doc_id", "chunk", "body", F.col("n_tokens").cast("int").alias("n_tokens"), F.col("page_start").cast("int").alias("page_start"), F.col("page_end").cast("int").alias("page_end"), *keep]
    runs_ = whole.withColumn("body", body).select(*out)

    cut = parts.where(n_pieces.isNotNull()).select("doc_id", F.col("first_at").alias("at"), (F.col("earlier") + F.col("n_alone")).alias("earlier"), own["n"].alias("n"), own["limit"].alias("limit"), n_pieces.alias("pieces"), F.greatest(F.lit(1), own["limit"] - overlap).alias("step"))
    cut = cut.join(places.hint("merge"), ["doc_id", "at"]).join(rows.select(*line_keys, "text", *keep).hint("merge"), line_keys).select("*", X.tokens(F.col("text")).alias("t"))
    # the tokens of a block of pieces, then its pieces, so that no row holds all of a line's
    begins = F.sequence(F.lit(0).cast("long"), F.floor((F.col("pieces") - 1) / BLOCK_PIECES))
    block = F.transform(begins, lambda b: F.struct((b * BLOCK_PIECES).alias("k"), F.slice("t", (b * BLOCK_PIECES * F.col("step") + 1).cast("int"), ((BLOCK_PIECES - 1) * F.col("step") + F.col("limit")).cast("int")).alias("t")))
    blocks = cut.select("doc_id", "page", "earlier", "n", "limit", "pieces", "step", *keep, F.explode(block).alias("b"))
    within = F.sequence(F.lit(0).cast("long"), F.least(F.lit(BLOCK_PIECES), F.col("pieces") - F.col("b.k")) - 1)
    made = F.transform(within, lambda k: F.array_join(F.slice(F.col("b.t"), (k * F.col("step") + 1).cast("int"), F.col("limit").cast("int")), " "))
    pieces_ = blocks.select("doc_id", "page", "earlier", "n", "limit", "step", *keep, F.col("b.k").alias("k"), F.posexplode(made).alias("j", "body")).withColumn("k", F.col("k") + F.col("j"))
    chunk, size = (F.col("earlier") + F.col("k") + 1).cast("int").alias("chunk"), F.least("limit", F.col("n") - F.col("k") * F.col("step"))
    return runs_.unionByName(pieces_.select("doc_id", chunk, "body", size.alias("n_tokens"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), *keep).select(*out))


def overlap_chunks(docs: DataFrame, limit: int = TARGET_TOKENS, overlap: int = LINE_OVERLAP) -> DataFrame:
    """(doc_id, chunk, text, n_tokens): documents without articles, in overlapping parts of their lines that hold anything."""
    rows = spread(docs.select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).where(F.col("text").rlike(r"(?U)\S"))
    parts = overlapping_parts(rows.select("doc_id", F.lit(1).alias("page"), "line_no", "text", F.lit(limit).alias("limit")), overlap)
    return parts.select("doc_id", "chunk", F.col("body").alias("text"), "n_tokens")


def new_chunks(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Of incoming (id, content_hash) those in the store by neither, one per hash (the least id)."""
    fresh = incoming.join(stored.select("id"), "id", "left_anti").join(stored.select("content_hash"), "content_hash", "left_anti")
    return fresh.groupBy("content_hash").agg(F.min("id").alias("id"))


def exact_articles(chunks: DataFrame, law_no: str | None, law: str | None, article_no: str) -> DataFrame:
    """An article's chunks by law number, else by law name, in reading order."""
    key = F.col("law_no") == law_no if law_no else F.col("law_name_normalized") == law
    return reading_order(chunks.where(key & (F.col("article_no") == article_no)))


def included_articles(chunks: DataFrame, law_no: str, article_no: str) -> DataFrame:
    """The wider lookup: chunks of a law that include an article among others."""
    return reading_order(chunks.where((F.col("law_no") == law_no) & F.array_contains("included_articles", article_no)))


def reading_order(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy(F.coalesce(F.col("page"), F.lit(0)), F.coalesce(F.col("chunk_index"), F.lit(0)), "id")


def nearest_vectors(vectors: DataFrame, query: DataFrame, k: int = 7) -> DataFrame:
    """The k vectors nearest by squared distance to one query row; ties to the smaller id. The one row is broadcast."""
    one = query.limit(1).select(F.col("embedding").alias("q"))
    distance = F.round(V.squared_distance(F.col("embedding"), F.col("q")), 6)
    return vectors.crossJoin(F.broadcast(one)).select("vec_id", "label", distance.alias("distance")).orderBy("distance", "vec_id").limit(k)


# The words of a question about an article, and how an article's number is written.
ASKED = {"law": "sayili kanunun", "article": "madde", "of": ("si", "yi"), "owned": "maddesi"}
ARTICLE_NUMBER = r"(\d+[/A-Za-zÇĞİÖŞÜçğıöşü]*)"
LETTERS = "A-Za-zÇĞİÖŞÜçğıöşü0-9"


def _asks(subject: str, *rest: str) -> str:
    """A form of question: who is meant, then the words that follow, divided by white space."""
    return rf"(?iu)\b{subject}\s+" + r"\s+".join(rest) + r"\b"


#: By number, by name before the article's number, and by name before the word for article; the first that fits counts.
QUERY_FORMS = (
    _asks(r"(\d{3,5})", *ASKED["law"].split(), rf"{ARTICLE_NUMBER}\.?", ASKED["owned"]),
    _asks(rf"([{LETTERS} ]+?)", rf"{ARTICLE_NUMBER}\.?", rf"{ASKED['article']}(?:{'|'.join(ASKED['of'])})?"),
    _asks(rf"([{LETTERS} ]+?)", ASKED["article"], ARTICLE_NUMBER),
)


def parse_article_query(question: Column) -> list[Column]:
    """law_no, law_name and article_no of a question, by the first form that fits."""
    q = F.trim(F.regexp_replace(F.regexp_replace(question, "[’']", " "), r"\s+", " "))
    law = article = F.lit(None).cast("string")
    for form in reversed(QUERY_FORMS):
        hit = q.rlike(form)
        law, article = F.when(hit, F.trim(F.regexp_extract(q, form, 1))).otherwise(law), F.when(hit, F.regexp_extract(q, form, 2)).otherwise(article)
    return [F.nullif(F.regexp_extract(law, r"\b(\d{3,5})\b", 1), F.lit("")).alias("law_no"), X.law_name(law).alias("law_name"), article.alias("article_no")]


def parsed_queries(rows: DataFrame, question: str) -> DataFrame:
    """``rows`` with law_no, law_name and article_no as parse_article_query finds them; each form is sought once a row."""
    out = rows.select("*", F.trim(F.regexp_replace(F.regexp_replace(question, "[’']", " "), r"\s+", " ")).alias("_q"))
    which = F.lit(None).cast("int")
    for k, form in reversed(list(enumerate(QUERY_FORMS))):
        which = F.when(F.col("_q").rlike(form), k).otherwise(which)
    out = out.select("*", which.alias("_form"))

    def group(g: int) -> Column:
        found = F.lit(None).cast("string")
        for k, form in enumerate(QUERY_FORMS):
            found = F.when(F.col("_form") == k, F.regexp_extract("_q", form, g)).otherwise(found)
        return found

    out = out.select("*", F.trim(group(1)).alias("_law"), group(2).alias("article_no")).select("*", X.upper_form(F.col("_law")).alias("_name"))
    number = F.nullif(F.regexp_extract("_law", r"\b(\d{3,5})\b", 1), F.lit(""))
    return out.select(*rows.columns, number.alias("law_no"), X.full_law_name(F.col("_name")).alias("law_name"), "article_no")


# How a chunk's text names its law and article.
SAID_LAW = r"(?iu)\bkanun\s*(?:no|numarasi|numarası)?\s*[:\-]?\s*(\d{3,5})"
SAID_ARTICLE = r"(?iu)\bmadde\s*[:\-]?\s*(\d+[/A-Z0-9a-zçğıöşü]*)"


def scalar_metadata(rows: DataFrame) -> DataFrame:
    """Every column as a store of scalars takes it: null as empty text, truth values and numbers as they are (unless null), all else as text."""
    plain = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")

    def scalar(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in plain:
            return c
        text = F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")
        return F.coalesce(text, F.lit("")).alias(name)

    return rows.select(*[scalar(name, kind) for name, kind in rows.dtypes])


def standard_metadata(rows: DataFrame) -> DataFrame:
    """Law number, name and article of chunks: what is given first, else what the text says."""
    given = lambda c: X.blank_to_null(F.col(c))
    said = lambda p: F.nullif(F.regexp_extract("text", p, 1), F.lit(""))
    number = F.coalesce(given("law_no"), said(SAID_LAW))
    named = F.coalesce(given("law_name"), F.element_at(F.create_map(*[F.lit(x) for pair in LAW_NAMES.items() for x in pair]), number))
    article = F.coalesce(given("article_no"), said(SAID_ARTICLE))
    return rows.select("id", number.alias("law_no"), X.law_name(named).alias("law_name_normalized"), article.alias("article_no"), X.content_hash(F.col("id"), number, article, F.col("text")).alias("content_hash"))
