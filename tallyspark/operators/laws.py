"""Laws: what a document says it is, and the cascade that answers questions about articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .documents import LAW_NAMES, exact_articles, included_articles, nearest_vectors


def title_case(c: Column) -> Column:
    """Turkish capitals: dotted and dotless i keep their own forms."""
    low = F.lower(F.translate(c, "Iİ", "ıi"))
    head = lambda w: F.upper(F.translate(F.left(w, F.lit(1)), "iı", "İI"))
    return F.array_join(F.transform(F.split(F.trim(low), r"\s+"), lambda w: F.concat(head(w), F.substr(w, F.lit(2)))), " ")


def slug(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(X.fold(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(out == "", "document").otherwise(out)


def law_metadata(pages: DataFrame) -> DataFrame:
    """One row per document from (doc_id, page, line_no, text, stem): number, name, official name and document id.

    The number comes from the first two pages' heading, else from the file's name; the
    name is the longest of the first lines that says it is a law, else the known name.
    """
    first = pages.where("page <= 2")
    said = F.nullif(F.regexp_extract("text", r"(?iu)Kanun\s+Numarası\s*:\s*(\d+)", 1), F.lit(""))
    up = F.upper(X.fold(F.col("text")))
    named = F.when(up.contains("KANUNU") & ~up.contains("KANUN NUMARASI") & F.length(F.trim("text")).between(8, 160) & (F.col("line_no") <= 80), F.trim("text"))
    found = first.groupBy("doc_id").agg(F.first("stem").alias("stem"), F.min_by(said, F.when(said.isNotNull(), F.struct("page", "line_no"))).alias("said"), F.min_by(named, F.when(named.isNotNull(), F.struct((-F.length("text")).alias("l"), "page", "line_no"))).alias("named"))
    number = F.coalesce("said", F.nullif(F.regexp_extract("stem", r"\d+", 0), F.lit("")))
    known = F.element_at(F.create_map(*[F.lit(x) for pair in LAW_NAMES.items() for x in pair]), F.col("law_no"))
    out = found.withColumn("law_no", number).withColumn("law_name", F.coalesce(title_case(F.col("named")), known, F.initcap(F.translate("stem", "_-", "  "))))
    return out.select("doc_id", "law_no", "law_name", F.when(F.col("law_no").isNotNull(), F.concat("law_no", F.lit(" Sayılı "), "law_name")).otherwise(F.col("law_name")).alias("official_name"), F.when(F.col("law_no").isNotNull(), F.concat(F.lit("law_"), "law_no", F.lit("_"), slug(F.col("law_name")))).otherwise(F.concat(F.lit("doc_"), slug(F.col("stem")))).alias("document_id"))


def retrieve(chunks: DataFrame, law_no: str | None, law: str | None, article_no: str | None, query: DataFrame | None = None) -> tuple[str, DataFrame]:
    """One question's first strategy with rows: the exact article, chunks that include it, vectors of that law, all vectors; ``retrieval.answers`` takes many."""
    if article_no:
        for name, found in (("exact_metadata", exact_articles(chunks, law_no, law, article_no)), ("metadata_filter", included_articles(chunks, law_no or "", article_no))):
            if not found.isEmpty():
                return name, found
        if query is not None:
            found = nearest_vectors(chunks.where((F.col("law_no") == law_no) if law_no else (F.col("law_name_normalized") == law)), query, 5)
            if not found.isEmpty():
                return "semantic_fallback", found
    return "semantic", nearest_vectors(chunks, query, 7) if query is not None else chunks.limit(0)


def corpus_report(chunks: DataFrame) -> DataFrame:
    """Documents, chunks and tokens in all; ``chunks.document_report`` lists documents, those without chunks included."""
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    return per.agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_chunks"), F.sum("t").alias("n_tokens"), F.max("n").alias("most_chunks"))
