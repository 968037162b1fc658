"""Token counts through a digest cache."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_bytes, scratch_path, small_batches, worker_state
from .wordbpe import ByteCounter, load

CACHE_SCHEMA = "text_digest binary, tokenizer_digest string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer: its library's version and its file."""
    with open(path, "rb") as f:
        content = hashlib.sha256(f.read()).hexdigest()
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    return f"{lib.__version__}:{content}"


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    spec = load(path)
    if type(spec.pre_tokenizer).__name__ == "ByteLevel" and spec.normalizer is None:
        return ByteCounter(spec).count
    return lambda texts: [len(x.ids) for x in spec.encode_batch(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) per row, encoding each text that the cache at
    ``cache_path`` (a Parquet folder of CACHE_SCHEMA in shared storage) lacks once.

    The content is normalised only as far as counts allow: a null text is the empty
    text; everything else is kept as it is, since case and white space change counts.
    Key: SHA-256 of the UTF-8 text, and the digest of the tokenizer's version. Repeated
    rows and ids give a row each, null ids stay null; very long texts are counted whole; other
    columns are ignored; an empty table gives none.

    Rows meet their counts by a join on the digest, whose large groups Spark can split.
    Texts are shuffled once, after each task has merged the copies it has.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version = tokenizer_digest(tokenizer_path)
    keyed = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keyed = keyed.withColumn("_digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)))
    misses = keyed.groupBy("_digest").agg(F.first("_text").alias("_text"))
    old = read_cache(spark, cache_path)
    if old is not None:
        known = old.where(F.col("tokenizer_digest") == version).select(F.col("text_digest").alias("_digest")).distinct()
        misses = misses.join(known, "_digest", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = worker_state(("counts", version), lambda: _counter(tokenizer_path))
        for b in batches:
            texts = b["_text"].tolist()
            yield pd.DataFrame({"text_digest": b["_digest"], "tokenizer_digest": version, "n_tokens": [n for s in by_bytes(texts, 1 << 20) for n in count(texts[s])]})

    misses.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # Two writers at once may both have stored a digest: one row of it is enough.
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
    counts = counts.groupBy(F.col("text_digest").alias("_digest")).agg(F.max("n_tokens").alias("n_tokens"))
    rows = keyed.select("_id", "_digest", F.octet_length("_text").cast("long").alias("n_bytes"))
    return rows.join(counts, "_digest").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens")


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens. The query starts from a fresh cache, so that it encodes
    all distinct texts whenever it runs; a deployment passes one lasting path."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-cache"))
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)
