"""Chunks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate


def line_windows(docs: DataFrame, id_col: str, text: Column, size: int = 120, overlap: int = 20) -> DataFrame:
    """Windows of ``size`` lines that overlap; the window that reaches the end is the last.

    Size is at least 2 and overlap below it. A document's windows are made from its own row,
    so nothing is shuffled.
    """
    size = max(2, size)
    step = max(1, size - min(overlap, size - 1))
    n = F.size("_lines")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.ceil((n - size) / step) * step).cast("int"), F.lit(step)))
    rows = docs.select(F.col(id_col), F.split(text, "\n", -1).alias("_lines")).withColumn("_at", F.explode(starts))
    end = F.least(F.col("_at") + size, n)
    body = F.array_join(F.slice("_lines", F.col("_at") + 1, end - F.col("_at")), "\n")
    out = rows.select(id_col, (F.col("_at") + 1).alias("start_line"), end.alias("end_line"), body.alias("document"))
    return out.withColumn("n_chars", F.length("document").cast("long")).withColumn("est_tokens", token_estimate(F.col("n_chars")))


def header_chunks(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """A chunk for each heading of level 1 to 4 with what follows it; text before the
    first heading is a chunk titled Introduction. Front matter and headings that nothing
    follows are left out; a text of which nothing is left then is one chunk titled Full
    Document. Splitting keeps the heading lines, so a chunk is a piece of its document's row."""
    body = F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n(?:---|\.\.\.)\s*(?:\n|\z)", "")
    pieces = F.filter(F.split(body, r"\n(?=#{1,4}\s)", -1), lambda p: F.trim(F.regexp_replace(p, r"\A\s*#{1,4}\s[^\n]*", "")) != "")
    whole = F.when(F.trim(text) != "", F.array(text)).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(id_col), (F.size(pieces) == 0).alias("_whole"), F.posexplode(F.when(F.size(pieces) > 0, pieces).otherwise(whole)).alias("chunk_idx", "document"))
    title = F.regexp_extract("document", r"^#{1,4}\s+([^\n]*)", 1)
    return rows.select(id_col, "chunk_idx", F.when(F.col("_whole"), "Full Document").when(title == "", "Introduction").otherwise(F.trim(title)).alias("title"), "document", F.length("document").cast("long").alias("n_chars"))
