"""Line dedup: lines that many documents share stay in one of them only.

Whole texts are split at ``\\n``. A line's key is the line without white space
(``[\\x20\\x09-\\x0D]``) at both ends and with A-Z lower-cased. Long keys are exploded and
hashed (128 bits); distinct documents are counted for each hash; the positions that a
document loses are gathered and its text is put together from the runs between them. Only
hashes and positions are shuffled for the counts, texts once for the last join, and not
even then while the positions are few.

Distinct documents are counted in two steps, by hash and document and then by hash, so a
line that most documents hold is spread over all tasks. Lines meet the counts, and
documents their positions, as joins of a written table with an exchange, which Spark splits
where one key is hot, and turns to a broadcast while the table is small.

A null text is one empty line. A null doc_id counts as one document, below all others.
Rows of one doc_id are one document to the counts; each row is answered, repeated ones
alike. An empty table gives no rows; other columns are passed on, and new ones step aside
from names that are taken.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import spread
from .arrays import fresh
from .saved import saved

LEAST_CHARS, LEAST_DOCS = 40, 5
SPACE = " \t\n\v\f\r"


def bare(line: Column) -> Column:
    """The line without white space at its ends."""
    return F.btrim(line, F.lit(SPACE))


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; plain ASCII by the quicker built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def hashed(*columns: Column) -> list[Column]:
    """Two 64-bit hashes, which together stand for the value."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, r1, r2, pos, h1, h2): the row, the place and the key of every line whose key is long enough."""
    r1, r2 = hashed(F.col("doc_id"), F.col("text"))
    lines = docs.select("doc_id", r1.alias("r1"), r2.alias("r2"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", bare(F.col("line"))).where(F.length("line") >= least_chars)
    h1, h2 = hashed(lowered(F.col("line")))
    return lines.select("doc_id", "r1", "r2", "pos", h1.alias("h1"), h2.alias("h2"))


def shared_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """(h1, h2, n_docs, keeper): keys of enough documents and the largest doc_id that holds them."""
    held = lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n_lines"))
    found = held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    return found.where(F.col("n_docs") >= least_docs)


def between(lines: Column, gone: Column) -> Column:
    """The elements of ``lines`` but those at the sorted places ``gone``; each element is copied once."""
    ends = F.concat(gone, F.array(F.size(lines)))

    def runs(bound: Column) -> Column:
        before = lambda k: F.when(k == 0, -1).otherwise(F.get(bound.ends, k - 1))
        return F.flatten(F.transform(bound.ends, lambda end, k: F.slice(bound.lines, before(k) + 2, end - before(k) - 1)))

    # a one-element array binds both values, so that they are worked out once for a row
    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), ends.alias("ends"))), runs), 0)


def drop_shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All columns of ``docs`` with ``kept_text``, ``n_lines`` (before) and ``n_dropped``."""
    named = {c: fresh(docs, c) for c in ("kept_text", "n_lines", "n_dropped")}
    texts = spread(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    lines = long_lines(texts, least_chars)
    shared = saved(shared_lines(lines, least_docs))
    lost = lines.join(shared.select("h1", "h2", "keeper"), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = saved(lost.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("gone")))

    text, r1, r2, held = (fresh(docs, c) for c in ("whole_text", "row_hash_1", "row_hash_2", "gone_lines"))
    rows = spread(docs).withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = rows.withColumns(dict(zip((r1, r2), hashed(F.col("doc_id"), F.col(text)), strict=True)))
    rows = rows.join(gone.select(F.col("r1").alias(r1), F.col("r2").alias(r2), F.col("gone").alias(held)), [r1, r2], "left")
    split = F.split(text, "\n")
    kept = F.when(F.col(held).isNull(), F.col(text)).otherwise(F.array_join(between(split, F.col(held)), "\n"))
    breaks = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    return rows.select(
        *docs.columns,
        kept.alias(named["kept_text"]),
        (breaks + 1).cast("long").alias(named["n_lines"]),
        F.coalesce(F.size(held), F.lit(0)).cast("long").alias(named["n_dropped"]),
    )
