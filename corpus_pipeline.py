"""A training corpus from raw documents: toxic ones and those of no known language go, lines
that repeat go, one document of each group of near copies stays, and the rest is packed.

Counted as part of the llm subpackage. Each stage takes (spark, docs, sf_dir), works on all
rows its predecessor kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import langid_crf, line_dedup, ngram_join, packing, toxicity
from ledgerlens.llm.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_LOST, LEAST_KEPT = 250, 0.25  # characters of about fifty words; what a similarity of 0.75 leaves


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier, fitted to the labelled rows of the source
    table, takes for toxic (op6)."""
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, model, tuple(COLUMNS)).where("predicted = 0").select(COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that op3 names no language for. A score is the share of one language,
    so a document spread over several known ones stays, however low its best."""
    crf = langid_crf.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = langid_crf.identify(docs, crf, tuple(COLUMNS))
    return found.where(F.col("lang_pred") != langid_crf.UNKNOWN).select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that match an earlier line (op7), and documents of which no word is left
    or that are near copies by lines: they lose at least LEAST_LOST characters and keep less than
    LEAST_KEPT of their distinct lines' characters, so what they have of their own is too little
    to be told from what others have. A document's own repeated lines don't count for that.
    Documents that lose nothing stay as they are; null texts stay; n_chars follows the text."""
    lines = F.split("text", "\n", -1)
    own = docs.select(COLUMNS).withColumn("_own", F.length(F.array_join(F.array_distinct(lines), "")))
    out = line_dedup.dedup_lines(own)
    touched = F.col("n_removed") > 0
    left = F.length(F.translate("text", "\n", ""))
    copied = (F.col("_own") - left >= LEAST_LOST) & (left < LEAST_KEPT * F.col("_own"))
    out = out.where(~touched | (F.col("text").rlike(r"\S") & ~copied))
    return out.withColumn("n_chars", F.when(touched, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of similarity 0.75 connect, the one of the least
    doc_id stays (op1), with all rows that repeat that doc_id."""
    grouped = ngram_join.ngram_join(docs).select("doc_id", "component_id")
    gone = materialize(grouped.where("doc_id != component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens (op4)."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("best_two_fit_packing", pack),
]

# Learned models and tokenizers: no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
