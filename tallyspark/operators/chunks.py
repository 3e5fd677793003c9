"""Chunk rows of regulatory documents: article-aware where a document has articles, else overlapping parts.

Sizes are tokens of ``text.token_count``; parts of a text that white space divides add up, so
packing works on numbers and only what belongs to one chunk is ever put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.scratch import written
from . import documents as docs
from . import packing as pk

# The least tokens that are left to a body, and what is kept free.
LEAST_BODY, LEAST_PACK, LEAST_FALLBACK, FREE, FREE_FALLBACK = 256, 128, 128, 32, 8
# The labels of a chunk's header.
LAW, LAW_NO, CHAPTER, SECTION, ARTICLE, ARTICLES, TITLE, PART, SOURCE = "Kanun", "Kanun No", "Kısım", "Bölüm", "Madde", "Maddeler", "Madde Başlığı", "Madde Parçası", "Kaynak"
ARTICLES_NEEDED = 2


def _line(label: str, value: Column) -> Column:
    """A header line; null without a value."""
    return F.concat(F.lit(f"{label}: "), X.blank_to_null(value))


def _law_lines() -> list[Column]:
    return [F.concat(F.lit(f"{LAW}: "), F.coalesce("official_name", F.lit(""))), F.concat(F.lit(f"{LAW_NO}: "), F.coalesce("law_no", F.lit("")))]


def measured(articles: DataFrame, target: int, model: int) -> DataFrame:
    """Articles (with their text, or n_body, its tokens) with the token counts that packing needs: of their parts, and of the chunk that one alone makes."""
    n = lambda c: X.token_count(F.coalesce(F.col(c), F.lit("")))
    label = lambda text: X.token_count(F.lit(f"{text}:"))
    out = articles.select("*", X.token_count(F.concat_ws("\n", *_law_lines())).alias("n_law"), n("article_no").alias("n_no"), n("article_title").alias("n_title"), n("chapter_name").alias("n_chapter"), n("section_name").alias("n_section"), *([] if "n_body" in articles.columns else [n("text").alias("n_body")]))
    optional = [F.when(F.col(c) > 0, label(x) + F.col(c)).otherwise(0) for x, c in ((CHAPTER, "n_chapter"), (SECTION, "n_section"), (TITLE, "n_title"))]
    header = sum(optional, F.col("n_law") + label(ARTICLE) + F.col("n_no"))
    out = out.select("*", header.alias("n_header"))
    alone = F.col("n_header") + F.col("n_body")
    return out.select("*", alone.alias("n_alone"), F.when(alone > model, "article_part").when(alone > target, "single_article_long").alias("own_kind"))


def packed(sizes: DataFrame, target: int) -> DataFrame:
    """(doc_id, ordinal, pack): articles in order, put together while header and texts come to ``target`` or less.

    An article with a kind of its own stands alone. A header names each chapter and section
    once, so what an article adds depends on where the pack began: for each article the ones
    that a pack from there could reach by their texts alone are looked at, a pack's worth.
    """
    label = lambda text: X.token_count(F.lit(f"{text}:"))
    # an article that stands alone counts as more than a pack holds
    n = F.col("n_no") + F.col("n_body") + 1 + F.when(F.col("own_kind").isNotNull(), F.lit(target) + 1).otherwise(0)
    rows = pk.placed(sizes.select("doc_id", "ordinal", "n_law", "chapter_name", "n_chapter", "section_name", "n_section", "own_kind", n.cast("long").alias("n")), "ordinal")
    for name in ("chapter", "section"):
        same = Window.partitionBy("doc_id", f"{name}_name").orderBy("at")
        rows = rows.select("*", F.when(F.col(f"{name}_name").isNotNull(), F.coalesce(F.lag("at").over(same), F.lit(0))).alias(f"{name}_before"))
    fixed = F.col("n_law") + label(ARTICLES) - 1
    rows = pk.first_beyond(rows, F.col("upto") - F.col("n") + target - fixed, "found").withColumn("reach", pk.next_border(F.col("found")))
    begun = rows.where("reach > at + 1").select("doc_id", F.col("at").alias("begin"), (F.col("upto") - F.col("n")).alias("until"), fixed.alias("fixed"), F.explode(F.sequence("at", F.col("reach") - 1)).alias("at"))
    pairs = begun.join(rows.select("doc_id", "at", "upto", "chapter_before", "n_chapter", "section_before", "n_section").hint("merge"), ["doc_id", "at"])
    grown = Window.partitionBy("doc_id", "begin").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)

    def named(name: str, title: str) -> Column:
        """Tokens of the header line: its label and colon, the names that came since the pack began, marks between them."""
        new = F.coalesce(F.col(f"{name}_before") < F.col("begin"), F.lit(False)).cast("long")
        some = F.sum(new).over(grown)
        return F.when(some > 0, label(title) + F.sum(new * (F.col(f"n_{name}") + 1)).over(grown) - 1).otherwise(0)

    size = F.col("fixed") + F.col("upto") - F.col("until") + named("chapter", CHAPTER) + named("section", SECTION)
    over = pairs.select("doc_id", "begin", "at", size.alias("size")).where((F.col("at") > F.col("begin")) & (F.col("size") > target))
    ends = over.groupBy("doc_id", F.col("begin").alias("at")).agg(F.min("at").alias("end"))
    steps = rows.join(ends.hint("merge"), ["doc_id", "at"], "left").withColumn("nxt", F.coalesce("end", "reach"))
    found = pk.members(pk.packs(steps))
    return found.join(rows.select("doc_id", "at", "ordinal").hint("merge"), ["doc_id", "at"]).select("doc_id", "ordinal", "pack")


def paragraphs(text: Column) -> Column:
    """An article's paragraphs: a marker such as (1) or 2. opens one; without markers blank lines and capitals or digits do."""
    blank = r"[^\S\n]"
    by_marker = F.split(text, rf"\n(?={blank}*(?:\(\d+\)|\d+\.){blank}+)")
    by_form = F.filter(F.transform(F.split(text, r"\n\s*\n|\n(?=[A-ZÇĞİÖŞÜ0-9])"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(by_marker) > 1, F.transform(by_marker, lambda p: F.trim(p))).otherwise(by_form)


def split_parts(long_: DataFrame, overlap: int = docs.SPLIT_OVERLAP) -> DataFrame:
    """(doc_id, ordinal, part, parts, body): articles of (doc_id, ordinal, text, limit) in parts of ``limit`` tokens or fewer.

    Paragraphs are packed to limit - overlap; what is longer is cut by tokens and stands
    alone. Each part but the first begins with the last ``overlap`` tokens of the one before.
    """
    room = F.greatest(F.lit(LEAST_PACK), F.col("limit") - overlap)
    units = long_.select("doc_id", "ordinal", "limit", room.alias("room"), F.posexplode(paragraphs(F.col("text"))).alias("unit", "said"))
    units = units.select("*", X.tokens(F.col("said")).alias("t")).select("*", F.size("t").alias("n"))
    alone, n = F.col("n") > F.col("room"), F.size("t")
    # a piece and its tokens
    cut = lambda k: F.struct(F.array_join(F.slice("t", k * F.col("room") + 1, F.col("room")), " ").alias("said"), F.least(F.col("room"), n - k * F.col("room")).alias("n"))
    cuts = F.when(alone, F.transform(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("room")).cast("int")), cut)).otherwise(F.array(F.struct(F.col("said").alias("said"), n.alias("n"))))
    pieces = units.select("doc_id", "ordinal", "limit", "room", "unit", alone.alias("alone"), F.posexplode(cuts).alias("cut", "p"))
    # written, since the packing reads its numbers and the parts its texts
    pieces = written(pieces.select("doc_id", "ordinal", "limit", "room", "unit", "alone", "cut", "p.said", "p.n"))
    key = F.struct("doc_id", "ordinal").alias("key")
    size = F.when(F.col("alone"), F.col("room") + 1).otherwise(F.col("n"))
    sizes = pk.placed(pieces.select(key, "unit", "cut", "room", size.cast("long").alias("n")), "unit", "cut", key="key")
    sizes = pk.first_beyond(sizes, F.col("upto") - F.col("n") + F.col("room"), "found", key="key")
    packs_ = pk.packs(sizes.select("key", "at", "m", "unit", "cut", pk.next_border(F.col("found")).alias("nxt")), "unit", "cut", key="key")
    # a part's first piece begins it; the pieces after it follow in the order of units and cuts
    first = packs_.select("key.doc_id", "key.ordinal", "first.unit", "first.cut", F.col("pack").alias("part"))
    upto = Window.partitionBy("doc_id", "ordinal").orderBy("unit", "cut").rowsBetween(Window.unboundedPreceding, 0)
    dealt = pieces.join(first.hint("merge"), ["doc_id", "ordinal", "unit", "cut"], "left").select("doc_id", "ordinal", "limit", "unit", "cut", "said", "n", F.max("part").over(upto).alias("part"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "cut", "said"))), lambda x: x["said"]), "\n\n")
    raw = dealt.groupBy("doc_id", "ordinal", "part").agg(F.first("limit").alias("limit"), F.sum("n").alias("n"), F.trim(body).alias("raw"))
    raw = raw.select("*", X.tokens(F.col("raw")).alias("t")).select("doc_id", "ordinal", "part", "limit", "n", "raw", F.when(F.size("t") > overlap, F.slice("t", -overlap, overlap)).otherwise(F.col("t")).alias("t"))
    raw = raw.select("doc_id", "ordinal", "part", "limit", "n", "raw", F.size("t").alias("n_tail"), F.array_join("t", " ").alias("tail"))
    article = Window.partitionBy("doc_id", "ordinal").orderBy("part")
    whole = raw.select("*", F.count("*").over(Window.partitionBy("doc_id", "ordinal")).cast("int").alias("parts"), F.lag("tail").over(article).alias("before"), F.lag("n_tail").over(article).alias("n_before"))
    text = F.when(F.col("before").isNotNull(), F.concat("before", F.lit("\n\n"), "raw")).otherwise(F.col("raw"))
    # white space divides the two, so that their tokens add up
    over = F.col("n") + F.coalesce("n_before", F.lit(0)) > F.col("limit")
    return whole.select("doc_id", "ordinal", "part", "parts", F.when(over, head(text, F.col("limit"))).otherwise(text).alias("body"))


def head(text: Column, limit: Column) -> Column:
    """The text, or where it has more than ``limit`` tokens, the first of them."""
    return F.when(X.token_count(text) > limit, F.array_join(F.slice(X.tokens(text), F.lit(1), limit.cast("int")), " ")).otherwise(text)


#: What metadata may say of a document besides its id, law number and official name.
OPTIONAL = ("document_type", "law_name", "source_file", "source_url")
# Types of documents.
LAW_TYPE, UNKNOWN_TYPE, NOTE_TYPE = "law", "unknown", "standard_or_note"
_ABOUT = ["document_id", "document_type", "law_no", "law_name", "official_name", "source_file", "source_url"]
_COLUMNS = [
    "doc_id", "id", *_ABOUT, "chunk_index", "chunk_type", "article_no", "article_title", "included_articles", "included_articles_padded", "start_article", "end_article",
    "is_article_split", "article_part", "article_part_total", "chapter_name", "section_name", "page_start", "page_end", "token_count", "text",
]


def described(rows: DataFrame) -> DataFrame:
    """Rows of metadata with all columns that chunks name; a document with a law number is a law unless its type is given."""
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in OPTIONAL if c not in rows.columns})
    return rows.withColumn("document_type", F.coalesce("document_type", F.when(F.col("law_no").isNotNull(), LAW_TYPE).otherwise(UNKNOWN_TYPE)))


def article_chunks(articles: DataFrame, target: int = docs.TARGET_TOKENS, model: int = docs.MODEL_TOKENS, overlap: int = docs.SPLIT_OVERLAP, metadata: DataFrame | None = None) -> DataFrame:
    """Chunk rows of ``articles`` (documents.articles with document_id, law_no and official_name, and what else metadata says): text with header, id and metadata.

    ``metadata`` (with doc_id) is joined where it is given, and names the documents that are taken.

    Articles go together while they fit ``target``; a longer one stands alone, and one
    beyond ``model`` is split. Numbers run through a document. Texts are left aside until
    their packs are known, so that they are dealt twice only: to their pack's row, and into it.
    """
    # counted before the metadata is joined, which then takes no text along
    articles = articles if "n_body" in articles.columns else articles.withColumn("n_body", X.token_count(F.coalesce("text", F.lit(""))))
    texts, counted = articles.select("doc_id", "ordinal", "n_body", "text"), articles.drop("text")
    if metadata is not None:
        counted = counted.join(metadata.hint("merge"), "doc_id")
    sizes = written(measured(described(counted), target, model))
    packed_ = written(packed(sizes, target))
    placed = sizes.join(packed_.hint("merge"), ["doc_id", "ordinal"])
    met = lambda some, own: some.join(own.drop("n_body").hint("merge"), ["doc_id", "ordinal"])
    whole = met(placed.where(F.coalesce(F.col("own_kind") != "article_part", F.lit(True))), texts)
    ordered = lambda *names: F.array_sort(F.collect_list(F.struct("ordinal", *names)))
    grouped = whole.groupBy("doc_id", "pack").agg(
        *[F.min_by(c, "ordinal").alias(c) for c in (*_ABOUT, "article_title", "own_kind")],
        *[F.min_by(c, "ordinal").alias(f"first_{c}") for c in ("chapter_name", "section_name")],
        ordered("article_no", "text").alias("u"),
        F.array_join(F.array_sort(F.collect_set("chapter_name")), " / ").alias("chapters"),
        F.array_join(F.array_sort(F.collect_set("section_name")), " / ").alias("sections"),
        F.min("page_start").alias("page_start"),
        F.max("page_end").alias("page_end"),
    )
    numbers, single = F.col("u.article_no"), F.size("u") == 1
    named = F.when(single, F.concat_ws("\n", F.concat(F.lit(f"{ARTICLE}: "), numbers[0]), _line(TITLE, F.col("article_title")))).otherwise(F.concat(F.lit(f"{ARTICLES}: "), F.array_join(numbers, ", ")))
    body = F.array_join(F.transform("u.text", lambda t: F.trim(t)), "\n\n")
    text = F.concat(F.concat_ws("\n", *_law_lines(), _line(CHAPTER, F.col("chapters")), _line(SECTION, F.col("sections")), named), F.lit("\n\n"), body)
    kind = F.coalesce("own_kind", F.when(single, "single_article").otherwise("multi_article"))
    none = F.lit(None).cast("int")
    chunks = grouped.select("doc_id", *_ABOUT, "pack", kind.alias("chunk_type"), numbers.alias("numbers"), F.when(single, F.col("article_title")).alias("article_title"), F.lit(False).alias("is_article_split"), none.alias("article_part"), none.alias("article_part_total"), F.col("first_chapter_name").alias("chapter_name"), F.col("first_section_name").alias("section_name"), "page_start", "page_end", F.trim(text).alias("text"))

    part_header = F.concat_ws("\n", *_law_lines(), _line(CHAPTER, F.col("chapter_name")), _line(SECTION, F.col("section_name")), F.concat(F.lit(f"{ARTICLE}: "), "article_no"), _line(TITLE, F.col("article_title")))
    n_header = F.col("n_header") + X.token_count(F.lit(f"{PART}: 1/1"))
    # with the longest header that there is, no shorter text is split
    longest = sizes.agg(F.max("n_header")).first()[0] or 0
    long_ = met(placed.where(F.col("own_kind") == "article_part"), texts.where(F.col("n_body") > model - longest)).select("*", part_header.alias("header"), n_header.alias("n_part_header"), F.greatest(F.lit(LEAST_BODY), model - n_header - FREE).alias("limit"))
    # written, since numbers of chunks follow from how many parts there are, and the rows hold the parts
    made = written(split_parts(long_, overlap))
    split = long_.drop("text").join(made.hint("merge"), ["doc_id", "ordinal"])
    over = F.col("n_part_header") + X.token_count(F.col("body")) - model
    trimmed = F.when(over > 0, head(F.col("body"), F.greatest(F.lit(LEAST_PACK), F.col("limit") - over - FREE_FALLBACK))).otherwise(F.col("body"))
    part_text = F.concat("header", F.lit(f"\n{PART}: "), "part", F.lit("/"), "parts", F.lit("\n\n"), trimmed)
    parts = split.select("doc_id", *_ABOUT, "pack", F.lit("article_part").alias("chunk_type"), F.array("article_no").alias("numbers"), "article_title", F.lit(True).alias("is_article_split"), F.col("part").alias("article_part"), F.col("parts").alias("article_part_total"), "chapter_name", "section_name", "page_start", "page_end", F.trim(part_text).alias("text"))

    # a pack is one chunk but for the parts of a long article
    more = packed_.join(made.where("part = 1").select("doc_id", "ordinal", "parts").hint("merge"), ["doc_id", "ordinal"], "left").groupBy("doc_id", "pack").agg((F.coalesce(F.max("parts"), F.lit(1)) - 1).alias("more"))
    earlier = F.sum("more").over(Window.partitionBy("doc_id").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1))
    numbers_ = more.select("doc_id", "pack", (F.col("pack") + F.coalesce(earlier, F.lit(0))).alias("first_index"))
    # before the union, since packs' rows lie by pack already
    every = chunks.join(numbers_.hint("merge"), ["doc_id", "pack"]).unionByName(parts.join(numbers_.hint("merge"), ["doc_id", "pack"]))
    index = (F.col("first_index") + F.coalesce(F.col("article_part") - 1, F.lit(0))).cast("int")
    every = every.select("*", index.alias("chunk_index"), F.element_at("numbers", 1).alias("start_article"), F.element_at("numbers", -1).alias("end_article"))
    middle = F.when(F.col("article_part").isNotNull(), F.concat(F.lit("_article_"), "start_article", F.lit("_part_"), "article_part")).when(F.size("numbers") == 1, F.concat(F.lit("_article_"), "start_article")).otherwise(F.concat(F.lit("_articles_"), "start_article", F.lit("_"), "end_article"))
    article_no = F.when(F.size("numbers") == 1, F.col("start_article")).alias("article_no")
    return every.select("*", article_no, F.concat("document_id", middle, F.lit("_chunk_"), "chunk_index").alias("id"), F.array_join("numbers", ",").alias("included_articles"), F.concat(F.lit("|"), F.array_join("numbers", "|"), F.lit("|")).alias("included_articles_padded"), X.token_count(F.col("text")).alias("token_count")).select(*_COLUMNS)


def fallback_chunks(rows: DataFrame, metadata: DataFrame, target: int = docs.TARGET_TOKENS, overlap: int = docs.LINE_OVERLAP) -> DataFrame:
    """Chunk rows of documents without articles, from their body lines: overlapping parts below a source header."""
    header = F.concat_ws("\n", F.concat(F.lit(f"{SOURCE}: "), F.coalesce("official_name", "document_id")), _line(LAW_NO, F.col("law_no")))
    met = described(metadata).select("doc_id", *_ABOUT, header.alias("header"), X.token_count(header).alias("n_header"))
    limit = F.greatest(F.lit(LEAST_FALLBACK), target - F.col("n_header") - FREE_FALLBACK)
    # a row a document is small to send but not to hold at once, so it is never broadcast
    body = rows.where(F.col("text").rlike(r"(?U)\S")).join(met.hint("merge"), "doc_id").select("doc_id", "page", "line_no", "text", limit.alias("limit"), F.struct(*_ABOUT, "header", "n_header").alias("met"))
    # written, since the packing reads its numbers and the parts its texts; parts keep their document's row, since there may be very many
    parts = docs.overlapping_parts(written(body), overlap, "met")
    out = parts.select("doc_id", F.col("chunk").alias("chunk_index"), "page_start", "page_end", "met.*", (F.col("met.n_header") + F.col("n_tokens")).alias("token_count"), F.trim(F.concat("met.header", F.lit("\n\n"), "body")).alias("text"))
    kind = F.when(X.blank_to_null(F.col("law_no")).isNull(), NOTE_TYPE).otherwise(F.col("document_type"))
    none = {c: F.lit(None).cast("string") for c in ("article_no", "article_title", "start_article", "end_article", "chapter_name", "section_name")}
    said = {"id": F.concat("document_id", F.lit("_fallback_chunk_"), "chunk_index"), "document_type": kind, "chunk_type": F.lit("fallback_text_chunk"), "included_articles": F.lit(""), "included_articles_padded": F.lit("")}
    said |= {"is_article_split": F.lit(False), "article_part": F.lit(None).cast("int"), "article_part_total": F.lit(None).cast("int")}
    return out.withColumns(none | said).select(*_COLUMNS)


def document_chunks(lines: DataFrame, metadata: DataFrame, target: int = docs.TARGET_TOKENS, model: int = docs.MODEL_TOKENS) -> DataFrame:
    """Chunk rows of all documents: by articles where there are two or more, else by lines.

    ``lines`` are documents.lines, ``metadata`` has a row per document (doc_id, document_id,
    law_no, official_name, and OPTIONAL as known). A document without body lines has no rows; ``document_report``
    lists it.
    """
    body = docs.body_lines(lines)
    found = docs.written_articles(body)
    many = found.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") >= ARTICLES_NEEDED).select("doc_id")
    # a row a document is small to send but not to hold at once, so none of these is broadcast
    return article_chunks(found, target, model, metadata=metadata.join(many.hint("merge"), "doc_id")).unionByName(fallback_chunks(body.join(many.hint("merge"), "doc_id", "left_anti"), metadata, target))


def document_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per document: its chunks by kind, their sizes, and ``failed`` where nothing came of it."""
    kinds = ("multi_article", "single_article", "single_article_long", "article_part", "fallback_text_chunk")
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), *[F.count_if(F.col("chunk_type") == k).alias(f"n_{k}") for k in kinds], F.max("token_count").alias("max_tokens"), F.round(F.avg("token_count"), 2).alias("avg_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return documents.select("doc_id").join(per.hint("merge"), "doc_id", "left").select("doc_id", *[zero(c) for c in per.columns[1:]], F.col("n_chunks").isNull().alias("failed"))
