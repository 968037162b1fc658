"""Stored chunks and their index: tables that searches read in part.

A store is a folder of Parquet, its rows dealt over buckets by source. A change rewrites the
buckets that it touches and no others. The index beside it holds postings by buckets of terms:
a search reads the buckets of its own words.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.ranking import bm25_weight, query_terms
from .scratch import delete, exists, file_system, fresh, shared_dir


class ChunkStore:
    """Chunks (chunk_id, source, document, ...) by source."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(self.buckets)).cast("int")

    def scan(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def _rewrite(self, keep: DataFrame, touched: list[int]) -> None:
        """Replaces the touched buckets by the rows of ``keep``. These are written aside, by bucket, before what they are
        read from goes; then their folders take the places of the old ones, and no row is written twice."""
        aside = fresh(self.spark, "store")
        keep.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(aside)
        for b in touched:
            fs, new = file_system(self.spark, f"{aside}/bucket={b}")
            delete(self.spark, f"{self.path}/bucket={b}")
            if fs.exists(new) and not fs.rename(new, file_system(self.spark, f"{self.path}/bucket={b}")[1]):
                raise OSError(f"bucket {b} of {self.path} is left in {aside}")
        delete(self.spark, aside)

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()]  # at most self.buckets

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of their chunk_id (of their source); others stay."""
        if not exists(self.spark, self.path):
            rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(self.path)
            return
        touched = self._touched(rows)
        old = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched)).drop("bucket")
        self._rewrite(old.join(rows.select("chunk_id").distinct(), "chunk_id", "left_anti").select(old.columns).unionByName(rows, allowMissingColumns=True), touched)

    def replace_source(self, rows: DataFrame) -> None:
        """All chunks of the sources of rows go, rows come."""
        self._drop_then(rows.select("source").distinct(), rows)

    def delete(self, keys: DataFrame) -> None:
        """Chunks by ``chunk_id`` or all chunks by ``source``, whichever column keys has."""
        if "source" in keys.columns:
            self._drop_then(keys.select("source").distinct(), None)
        else:
            hit = self.scan().join(keys.select("chunk_id").distinct(), "chunk_id", "left_semi")
            touched = self._touched(hit)
            if touched:
                old = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched)).drop("bucket")
                self._rewrite(old.join(keys.select("chunk_id").distinct(), "chunk_id", "left_anti").select(old.columns), touched)

    def _drop_then(self, sources: DataFrame, rows: DataFrame | None) -> None:
        touched = self._touched(sources)
        old = self.spark.read.parquet(self.path).where(F.col("bucket").isin(touched)).drop("bucket")
        keep = old.join(sources, "source", "left_anti").select(old.columns)
        self._rewrite(keep if rows is None else keep.unionByName(rows, allowMissingColumns=True), touched)

    def of_source(self, source: str) -> DataFrame:
        """The chunks of one source, from its bucket alone."""
        b = zlib.crc32(source.encode()) % self.buckets
        return self.spark.read.parquet(self.path).where((F.col("bucket") == b) & (F.col("source") == source)).drop("bucket")

    def count(self) -> int:
        return self.scan().count()

    def count_by_source(self) -> DataFrame:
        return self.scan().where("source IS NOT NULL AND source != ''").groupBy("source").agg(F.count("*").alias("n_chunks"))


def index_update(store: ChunkStore, files: DataFrame, chunk) -> DataFrame:
    """Brings the store up to files (source, content_hash, document): ``chunk``
    makes chunks of the files that are new or changed; chunks of files that are gone go. Only
    hashes are compared. (state, n_files) of the pass."""
    spark = store.spark
    new = files.select("source", F.col("content_hash").alias("new_hash"))
    old = store.scan().groupBy("source").agg(F.first("content_hash").alias("old_hash")) if exists(spark, store.path) else spark.createDataFrame([], "source string, old_hash string")
    state = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "updated").otherwise("unchanged")
    aside = fresh(spark, "delta")
    new.join(old, "source", "full").select("source", state.alias("state")).write.parquet(aside)
    delta = spark.read.parquet(aside)
    changed = files.join(delta.where("state IN ('new', 'updated')").select("source"), "source", "left_semi")
    if exists(spark, store.path):
        gone = delta.where("state IN ('deleted', 'updated')").select("source")
        if not gone.isEmpty():
            store.delete(gone)
    if not changed.isEmpty():
        store.upsert(chunk(changed))
    return delta.groupBy("state").agg(F.count("*").alias("n_files"))


def counted(words: Column) -> Column:
    """(term, tf) of a list of words: sorted, a word's count is the distance from its first place to the next word's."""
    at = lambda w: F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
    end = lambda s, w, j: F.coalesce(F.get(s, j + 1), F.size(w))
    runs = lambda w: F.transform(F.array(at(w)), lambda s: F.transform(s, lambda i, j: F.struct(F.get(w, i).alias("term"), (end(s, w, j) - i).cast("int").alias("tf"))))[0]
    return F.transform(F.array(F.sort_array(F.filter(words, lambda x: x.isNotNull()))), lambda w: F.when(F.size(w) > 0, runs(w)))[0]


class SearchIndex:
    """Postings (term, chunk_id, tf, dl) and document frequencies by buckets
    of terms, and the corpus statistics; a generation is complete once its statistics, written
    last, are there."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets, self._stats = spark, path.rstrip("/"), buckets, None

    def ready(self) -> bool:
        return exists(self.spark, f"{self.path}/stats/_SUCCESS")

    def build(self, chunks: DataFrame, text: str = "document") -> SearchIndex:
        """Each chunk's words are counted where it is read; a term that very many chunks have is
        dealt over several files of its bucket."""
        words = chunks.select("chunk_id", tokens(F.col(text)).alias("_w")).withColumn("dl", F.size("_w"))
        rows = words.select("chunk_id", "dl", F.inline(counted(F.col("_w"))))
        rows = rows.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(self.buckets)).cast("int")).withColumn("_d", F.pmod(F.xxhash64("chunk_id"), F.lit(4)))
        # chunks that share an id count as one; the keys include what rows are dealt by, so they aren't shuffled again
        dealt = rows.repartition("bucket", "_d").groupBy("bucket", "_d", "chunk_id", "dl", "term").agg(F.sum("tf").cast("int").alias("tf")).select("chunk_id", "dl", "term", "tf", "bucket")
        dealt.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        stored = self.spark.read.parquet(f"{self.path}/postings")
        stored.groupBy("bucket", "term").agg(F.count("*").alias("df")).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/terms")
        words.agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/stats")
        return self

    def stats(self):
        if self._stats is None:
            self._stats = self.spark.read.parquet(f"{self.path}/stats").head()
        return self._stats

    def _of(self, name: str, terms: list[str]) -> DataFrame:
        at = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("bucket").isin(at) & F.col("term").isin(terms))

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """How many chunks have each of a query's terms."""
        return {r["term"]: r["df"] for r in self._of("terms", terms).collect()}

    def sparse_scores(self, query: str) -> DataFrame:
        """(chunk_id, sparse) of the chunks that have a word of the query: BM25 divided by the
        best. Words that repeat count as often."""
        terms = query_terms(query)
        df, s = self.frequencies(sorted(set(terms))), self.stats()
        if not df:
            return self.spark.createDataFrame([], "chunk_id string, sparse double")
        times = F.element_at(F.create_map(*[F.lit(x) for t in df for x in (t, float(terms.count(t)))]), F.col("term"))
        freq = F.element_at(F.create_map(*[F.lit(x) for t, n in df.items() for x in (t, n)]), F.col("term"))
        weight = times * bm25_weight(F.col("tf"), freq, F.lit(s["n"]), F.col("dl"), F.lit(s["avg"]))
        raw = self._of("postings", list(df)).groupBy("chunk_id").agg(F.sum(weight).alias("_raw"))
        return raw.crossJoin(F.broadcast(raw.agg(F.max("_raw").alias("_best")))).select("chunk_id", (F.col("_raw") / F.col("_best")).alias("sparse"))


def fingerprint(spark: SparkSession, path: str) -> str:
    """What a table's files are now: their names, sizes and times."""
    fs, at = file_system(spark, path)
    parts = [fs.getFileStatus(at)] if not fs.getFileStatus(at).isDirectory() else list(fs.listStatus(at))
    return f"{zlib.crc32('|'.join(sorted(f'{p.getPath()}:{p.getLen()}:{p.getModificationTime()}' for p in parts)).encode()):08x}"


def index_of(spark: SparkSession, name: str, path: str, chunks) -> SearchIndex:
    """The index of the table at ``path``, built from ``chunks()`` unless the shared folder has
    one of the same files."""
    index = SearchIndex(spark, f"{shared_dir(spark)}/indexes/{name}-{fingerprint(spark, path)}")
    return index if index.ready() else index.build(chunks())


def export_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """A folder with a Parquet table for each entity and a manifest of their rows."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    rows = [(name, spark.read.parquet(f"{path}/{name}").count()) for name in tables]
    spark.createDataFrame(rows, "entity string, n long").coalesce(1).write.json(f"{path}/manifest")


def import_bundle(spark: SparkSession, path: str, known: dict[str, DataFrame], keys: dict[str, str]) -> dict[str, DataFrame]:
    """The rows of a bundle that the known tables lack, by each entity's key; an entity
    without a known table comes whole. Entities are those of the manifest."""
    out = {}
    for r in spark.read.schema("entity string, n long").json(f"{path}/manifest").collect():
        name = r["entity"]
        df = spark.read.parquet(f"{path}/{name}").dropDuplicates([keys[name]])
        out[name] = df.join(known[name].select(keys[name]).distinct(), keys[name], "left_anti") if name in known else df
    return out


def save_version(df: DataFrame, path: str, least_share: float = 0.5) -> int:
    """A table's next version beside the earlier ones; raises if it has less than
    ``least_share`` of the rows before. Readers take the highest complete version."""
    spark, last = df.sparkSession, latest_version(df.sparkSession, path)
    if last is not None and df.count() < least_share * spark.read.parquet(f"{path}/v{last:08d}").count():
        raise ValueError("the new version has lost too many rows")
    df.write.parquet(f"{path}/v{(last or 0) + 1:08d}")
    return (last or 0) + 1


def latest_version(spark: SparkSession, path: str) -> int | None:
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return None
    names = [p.getPath().getName() for p in fs.listStatus(at)]
    done = [int(n[1:]) for n in names if n.startswith("v") and exists(spark, f"{path}/{n}/_SUCCESS")]
    return max(done, default=None)


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table, the last if none is named."""
    return spark.read.parquet(f"{path}/v{version or latest_version(spark, path):08d}")
