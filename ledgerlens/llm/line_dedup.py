"""Line deduplication by an exact set-similarity join."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import setjoin as sj
from .shared import drop_table, materialize

SLACK = 1  # of 20
LEAST_WORDS = 1


def repeated_classes(sets: DataFrame) -> DataFrame:
    """(cid): the line classes that link with a class that stands earlier in the corpus.

    Pivots settle most: a class that links with the earliest of its bucket is repeated. The
    rest, and only these, meet all earlier lines that share one of their rarest shingles,
    under the length and positional filters, and each candidate's Jaccard is verified.
    """
    done = sj.pivot_links(sets).select(F.col("a").alias("cid")).distinct().withColumn("done", F.lit(True))
    done = materialize(done, "settled")
    place = sets.select("cid", "n", "pos").join(done, "cid", "left").select("cid", "n", "pos", F.isnull("done").alias("open"))
    rows = materialize(sj.rare_prefixes(sets, sj.rarity(sets)).join(place, "cid"), "prefixes")
    alive = rows.groupBy("s").agg(F.count("*").alias("c"), F.max("open").alias("any")).where("c > 1 and any").select("s")
    rows = materialize(rows.join(alive, "s"), "prefixes-shared")
    late = rows.where("open").select("s", F.col("cid").alias("a"), F.col("n").alias("n"), F.col("at").alias("i"), F.col("pos").alias("p"))
    early = rows.select("s", F.col("cid").alias("b"), F.col("n").alias("m"), F.col("at").alias("j"), F.col("pos").alias("q"))
    met = late.join(early, "s").where((F.col("q") < F.col("p")) & sj.may_link(F.col("n"), F.col("m"), F.col("i"), F.col("j")))
    found = sj.verify(met.select("a", "b").distinct(), sets)
    return done.select("cid").unionByName(found.select(F.col("a").alias("cid"))).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, drop array<int>): the numbers, from 0, of each text's lines to take out."""
    units = sj.scan(docs, True, SLACK, LEAST_WORDS, id_col, text_col)
    places = sj.Places(units)
    found = sj.classes(units, places, SLACK)
    lines = materialize(units.select("id", "line", "cid"), "lines")
    drop_table(units)
    sets = sj.full_sets(docs, found.where("open"), True, LEAST_WORDS, id_col=id_col, text_col=text_col)
    late = repeated_classes(sets).withColumn("late", F.lit(True))
    marked = found.select("cid", "pos", "c").join(late, "cid", "left").where("c > 1 or late").select("cid", "pos", "late")
    gone = lines.join(marked, "cid").where(F.col("late") | (places.of() != F.col("pos")))
    return materialize(gone.groupBy("id").agg(F.collect_set("line").alias("drop")), "dropped-lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs with their repeated lines taken out, and n_lines, n_removed.

    A line (between newlines) is taken out if a line earlier in the corpus, by id and then by
    place, has a Jaccard similarity of 0.75 or more by shingles of five words; a line
    of fewer words is one shingle, so it goes if an earlier one has the same words. Blank lines
    stay. A null text stays null and has no lines; an
    empty one has one. Ids must be distinct for a text's lines to be told apart: of rows that
    repeat an id, or have none, lines of the same number share their fate. Very long texts and
    lines are read whole, hashed by blocks. Other columns are kept, but for any that are named
    as the two new ones; an empty table gives no rows.
    """
    key, drop = (f"_{name}_{uuid.uuid4().hex}" for name in ("id", "drop"))  # no column of docs
    gone = repeated_lines(docs, id_col, text_col).select(F.col("id").alias(key), F.col("drop").alias(drop))
    if (gone.agg(F.sum(F.size(drop) + 1)).head()[0] or 0) <= broadcast_rows:
        gone = F.broadcast(gone)
    joined = docs.join(gone, docs[id_col].eqNullSafe(F.col(key)), "left")
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col(drop), i))
    text = F.when(F.col(drop).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_removed"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, n_chars of what is left, text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")
