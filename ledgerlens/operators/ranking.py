"""Sparse, dense and hybrid scores."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.scratch import fresh

K1, B = 1.5, 0.75


def query_terms(query: str) -> list[str]:
    """The words of a query of two letters or more, in lower case, repeats kept."""
    return [t.lower() for t in re.findall(r"\w+", query) if len(t) > 1]


def _unique(terms: list[str]) -> list[str]:
    return list(dict.fromkeys(terms))


def term_counts(chunks: DataFrame, terms: list[str], text: str = "document") -> DataFrame:
    """Adds the length and the count of each query term to every chunk: the words are split
    once and nothing is shuffled."""
    words = tokens(F.col(text))
    out = chunks.withColumn("_words", words).withColumn("_dl", F.size("_words"))
    for i, t in enumerate(_unique(terms)):
        out = out.withColumn(f"_tf{i}", F.size("_words") - F.size(F.array_remove("_words", t)))
    return out.drop("_words")


def corpus_stats(counted: DataFrame, terms: list[str]) -> DataFrame:
    """A4: one row with n_docs, avg_len and the document frequency of each term."""
    return counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(_unique(terms)))])


def bm25_weight(tf: Column, df: Column, n: Column, dl: Column, avg: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1.0)
    return F.when(tf > 0, idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / F.greatest(avg, F.lit(1.0))))).otherwise(0.0)


def sparse_scores(chunks: DataFrame, query: str, text: str = "document") -> DataFrame:
    """Chunks with ``sparse``, BM25 over the whole corpus divided by the best score.

    One pass writes what each chunk's words come to, a few numbers a row: statistics and the best score are
    aggregates of these. A second pass scores the chunks in their rows, so no text and no posting is shuffled.
    """
    terms = query_terms(query)
    counted = term_counts(chunks, terms, text)
    if not terms:
        return counted.withColumn("sparse", F.lit(0.0)).drop("_dl")
    at = {t: i for i, t in enumerate(_unique(terms))}
    aside = fresh(chunks.sparkSession, "counted")
    numbers = ["_dl", *(f"_tf{i}" for i in at.values())]
    counted.select(*numbers).write.parquet(aside)
    kept = chunks.sparkSession.read.parquet(aside)
    s = corpus_stats(kept, terms).head()
    raw = sum((bm25_weight(F.col(f"_tf{at[t]}"), F.lit(s[f"_df{at[t]}"]), F.lit(s["_n"]), F.col("_dl"), F.lit(s["_avg"])) for t in terms), F.lit(0.0))
    best = kept.agg(F.max(raw)).head()[0] or 0.0
    return counted.select(*chunks.columns, (raw / best if best > 0 else raw).alias("sparse"))


def cosine(a: Column, b: Column) -> Column:
    """in double precision; 0 for a zero norm; the longer vector is cut to the shorter."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a.cast("array<double>"), 1, n), F.slice(b.cast("array<double>"), 1, n)

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)

    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)


def literal_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def recency(age_days: Column) -> Column:
    """1 for a time that is unknown or ahead."""
    return F.coalesce(F.exp(-0.05 * F.greatest(F.lit(0.0), age_days)), F.lit(1.0))


def importance(c: Column) -> Column:
    """F11"""
    return F.when(F.lower(c) == "critical", 1.0).when(F.lower(c) == "high", 0.7).when(F.lower(c) == "low", 0.2).otherwise(0.5)


def blend(dense: Column | None, sparse: Column, recent: Column, important: Column) -> Column:
    """With a dense score .45, .30, .15, .10; without .75, .15, .10."""
    if dense is None:
        return 0.75 * sparse + 0.15 * recent + 0.10 * important
    return 0.45 * dense + 0.30 * sparse + 0.15 * recent + 0.10 * important


def postings(docs: DataFrame, id_col: str, text: str, wanted: DataFrame) -> DataFrame:
    """(id, term, tf, dl) of the terms in ``wanted`` (term), for tables of queries. Documents
    are counted on their own rows and only wanted terms leave them."""
    words = docs.select(id_col, tokens(F.col(text)).alias("_w")).withColumn("dl", F.size("_w"))
    rows = words.select(id_col, "dl", F.explode("_w").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    return rows.groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))


def top_k(df: DataFrame, k: int, *order: Column, partition: list[str] | None = None) -> DataFrame:
    """The first k by a total order, of each partition if named, with their rank."""
    if partition is None:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("rank") <= k)
