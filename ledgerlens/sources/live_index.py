"""A search index that takes changes: segments, signed counts, compaction.

An update compares hashes and writes one segment: the words of the chunks that came by buckets of
source (so that they can be taken back), their postings, a row per source that changed, and the
differences of document frequencies. Postings are written by the tasks that read the words, in order
of term: no posting is shuffled, and a search passes over the pages of other terms. Sums over segments are the statistics of what is live. A source that
a later segment names is dead in earlier ones; readers leave its postings out. What is written
is in proportion to the change; compaction merges the newest segments when they have grown.

A commit names the segments that count, so an update is seen whole or not at all.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import settle, tokens
from .commits import CommitLog
from .scratch import delete, file_system, fresh, reads_of
from .store import SearchIndex
from .store import counted as word_counts

SCHEMAS = {
    "postings": "term string, source string, chunk_id string, tf int, dl int",
    "terms": "term string, df long, bucket int",
    "words": "source string, chunk_id string, dl int, terms array<struct<term: string, tf: int>>, bucket int",
    "files": "source string, content_hash string, n_chunks long, bucket int",
}
BUCKET_FILES = 1 << 12  # of a segment, in a bucket
SORTED_BYTES = 1 << 25  # of words, whose postings a task sorts: a word takes about 15 times its size there
FEW = 500_000  # sources that are broadcast; more are shuffled
Chunker = Callable[[DataFrame], DataFrame]


class LiveIndex(SearchIndex):
    """An index of chunks (source, chunk_id, document) under ``path``, in at most ``buckets`` (a power of two) of a
    segment. ``config`` is whatever chunks depend on: an update under another one takes every file
    for changed."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1024, config: str = ""):
        super().__init__(spark, path, buckets)
        self.log, self.config = CommitLog(spark, f"{self.path}/commits"), config
        self._none = {"segments": [], "n": 0, "length": 0, "config": config}

    def record(self) -> dict:
        return self.log.read() or self._none

    def ready(self) -> bool:
        return self.log.last() > 0

    def build(self, chunks: DataFrame, text: str = "document") -> LiveIndex:
        raise NotImplementedError("a live index is built by updates")

    def stats(self) -> dict:
        """A4: n chunks and their average length."""
        r = self.record()
        return {"n": r["n"], "avg": r["length"] / r["n"] if r["n"] else None}

    def _hashed(self, c: str) -> Column:
        return F.crc32(F.coalesce(c, F.lit("")).cast("binary"))

    def _read(self, kind: str, segments: list[dict], hashes: list[int] | None = None) -> DataFrame:
        """The rows of a kind with the version of their segment, of all buckets or those of hashes of keys."""
        out = self.spark.createDataFrame([], f"{SCHEMAS[kind]}, version long")
        for s in segments:
            rows = self.spark.read.schema(SCHEMAS[kind]).parquet(f"{self.path}/{kind}/{s['name']}")
            if hashes is not None:
                rows = rows.where(F.col("bucket").isin(sorted({h % s["buckets"] for h in hashes})))
            out = out.unionByName(rows.withColumn("version", F.lit(s["version"]).cast("long")))
        return out

    def _bucketed(self, rows: DataFrame, segment: dict, key: str) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(self._hashed(key), F.lit(segment["buckets"])).cast("int"))

    def _dealt(self, rows: DataFrame, segment: dict, key: str) -> DataFrame:
        """Rows by buckets of a key; Spark splits a bucket that very many rows fall into over several tasks."""
        return self._bucketed(rows, segment, key).hint("rebalance", F.col("bucket"))

    def _write(self, kind: str, rows: DataFrame, segment: dict, key: str) -> DataFrame:
        """Writes rows that are dealt by buckets of a key, and reads them."""
        path = f"{self.path}/{kind}/{segment['name']}"
        self._bucketed(rows, segment, key).sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(path)
        return self.spark.read.schema(SCHEMAS[kind]).parquet(path)

    def _write_postings(self, words: DataFrame, segment: dict) -> DataFrame:
        """Writes the postings of a segment's words where these are read, and reads them."""
        rows = words.select("source", "chunk_id", "dl", F.inline("terms"))
        if not words.groupBy("source", "chunk_id", "dl").count().where("count > 1").isEmpty():  # ids that a chunker repeats count as one
            rows = rows.groupBy("source", "chunk_id", "dl", "term").agg(F.sum("tf").cast("int").alias("tf"))
        path = f"{self.path}/postings/{segment['name']}"
        with reads_of(self.spark, SORTED_BYTES):
            rows.select("term", "source", "chunk_id", "tf", "dl").sortWithinPartitions("term").write.parquet(path)
        return self.spark.read.schema(SCHEMAS["postings"]).parquet(path)

    def _segment(self, version: int, files: int) -> dict:
        """A new segment: a power of two of buckets, as many as its files ask for, up to ``buckets``."""
        buckets = 1
        while buckets < self.buckets and buckets * BUCKET_FILES < files:
            buckets *= 2
        return {"name": f"{version:08d}-{uuid.uuid4().hex}", "version": version, "files": files, "buckets": buckets}

    def _live(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """The rows whose source no later segment names. Only segments after the oldest are asked."""
        if len(segments) < 2:
            return rows
        later = self._read("files", segments[1:]).groupBy("source").agg(F.max("version").alias("_newest"))
        if sum(s["files"] for s in segments[1:]) <= FEW:
            later = F.broadcast(later)
        newest = F.coalesce("_newest", F.lit(0))
        return rows.join(later, "source", "left").where(F.col("version") >= newest).drop("_newest")

    def files(self) -> DataFrame:
        """(source, content_hash, n_chunks) of the sources that are live."""
        rows = self._read("files", self.record()["segments"])
        last = rows.groupBy("source").agg(F.max_by(F.struct("content_hash", "n_chunks"), "version").alias("f"))
        return last.select("source", "f.*").where("content_hash IS NOT NULL")

    def _of(self, name: str, terms: list[str]) -> DataFrame:
        segments = self.record()["segments"]
        if name == "postings":
            return self._live(self._read(name, segments).where(F.col("term").isin(terms)), segments)
        return self._read(name, segments, [zlib.crc32(t.encode()) for t in terms]).where(F.col("term").isin(terms))

    def frequencies(self, terms: list[str]) -> dict[str, int]:
        """How many chunks have each of a query's terms."""
        rows = self._of("terms", terms).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return {r["term"]: r["df"] for r in rows.collect()}

    def update(self, files: DataFrame, chunk: Chunker, whole: bool = True) -> DataFrame:
        """Brings the index up to files (source, content_hash, document). ``chunk`` makes chunks
        (source, chunk_id, document) of those that are new or changed; if ``whole``, sources that files lacks go.
        (state, n_files, n_chunks) of the pass: chunks written, or taken out for deleted files.

        Files without source are rejected; of rows that repeat a source the one of the greatest
        hash counts. The registry of files is part of the commit: it never names a file whose
        chunks are not there. Nothing is written where nothing changed.
        """
        n = self.log.last()
        record = self.log.read(n) or self._none
        version, forced = n + 1, record["config"] != self.config
        aside = fresh(self.spark, "index-update")
        listed = files.where("source IS NOT NULL").select("source", F.coalesce("content_hash", F.lit("")).alias("new_hash"), "document")
        hashes = listed.groupBy("source").agg(F.max("new_hash").alias("new_hash"), F.count("*").alias("rows"))
        old = self.files().select("source", F.col("content_hash").alias("old_hash"), F.col("n_chunks").alias("old_chunks"))
        state = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted" if whole else "unchanged").when((F.col("old_hash") != F.col("new_hash")) | F.lit(forced), "updated").otherwise("unchanged")
        hashes.join(old, "source", "full").select("source", "new_hash", "rows", "old_chunks", state.alias("state")).write.parquet(f"{aside}/delta")
        delta = self.spark.read.parquet(f"{aside}/delta")
        moved = delta.where("state != 'unchanged'")
        states = {r["state"]: r for r in delta.groupBy("state").agg(F.count("*").alias("n"), F.max("rows").alias("rows")).collect()}
        if not states.keys() - {"unchanged"}:
            if forced:
                self.log.publish(version, record | {"config": self.config})
            return delta.groupBy("state").agg(F.count("*").alias("n_files"), F.sum("old_chunks").alias("n_chunks"))
        n_of = lambda *names: sum(states[k]["n"] for k in names if k in states)
        segment = self._segment(version, n_of("new", "updated", "deleted"))
        came = self._dealt(self._came(listed, moved, states), segment, "source").drop("bucket")
        words = settle(chunk(came).select("source", "chunk_id", "document"), {"_w": tokens(F.col("document"))})
        words = self._write("words", words.select("source", "chunk_id", F.size("_w").alias("dl"), word_counts(F.col("_w")).alias("terms")), segment, "source")
        counted = self._write_postings(words, segment)
        won = words.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).head()
        segment["chunks"] = won["n"]
        sizes = words.groupBy("source").agg(F.count("*").alias("n_chunks"))
        named = moved.select("source", F.when(F.col("state") != "deleted", F.col("new_hash")).alias("content_hash"), "state", "old_chunks").join(sizes, "source", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
        self._write("files", self._dealt(named.select("source", "content_hash", "n_chunks"), segment, "source"), segment, "source")

        left = moved.where("state IN ('deleted', 'updated')").select("source")
        gone = self._taken_back(F.broadcast(left) if n_of("deleted", "updated") <= FEW else left, record["segments"])
        lost = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).head()
        plus = counted.groupBy("term").agg(F.count("*").alias("df"))
        minus = gone.select(F.explode("terms.term").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
        change = plus.unionByName(minus).groupBy("term").agg(F.sum("df").alias("df")).where("df != 0")
        self._write("terms", self._dealt(change.select("term", "df"), segment, "term"), segment, "term")

        self.log.publish(version, {"segments": [*record["segments"], segment], "n": record["n"] + won["n"] - lost["n"], "length": record["length"] + won["length"] - lost["length"], "config": self.config})
        chunks = F.when(F.col("state") == "deleted", F.col("old_chunks")).otherwise(F.col("n_chunks"))
        done = named.groupBy("state").agg(F.count("*").alias("n_files"), F.sum(chunks).alias("n_chunks"))
        same = delta.where("state = 'unchanged'").groupBy("state").agg(F.count("*").alias("n_files"), F.sum("old_chunks").alias("n_chunks"))
        return done.unionByName(same)

    def _came(self, listed: DataFrame, moved: DataFrame, states: dict) -> DataFrame:
        """(source, content_hash, document) of the files that are new or changed. Texts are not looked at if there are
        none, and not joined if all rows are; a source's rows meet only if some source has several."""
        ones = [states[k] for k in ("new", "updated") if k in states]
        if not ones:
            return self.spark.createDataFrame([], "source string, content_hash string, document string")
        rows, once = listed.withColumnRenamed("new_hash", "content_hash"), max(s["rows"] for s in ones) == 1
        if not (once and "unchanged" not in states):
            keys = moved.where("state != 'deleted'").select("source", F.col("new_hash").alias("_hash"))
            rows = rows.join(F.broadcast(keys) if sum(s["n"] for s in ones) <= FEW else keys, "source").where("content_hash = _hash")
        if not once:
            rows = rows.groupBy("source", "content_hash").agg(F.max("document").alias("document"))
        return rows.select("source", "content_hash", "document")

    def _taken_back(self, sources: DataFrame, segments: list[dict]) -> DataFrame:
        """The live words of sources, from their buckets alone."""
        most = max([s["buckets"] for s in segments], default=1)
        at = [r["b"] for r in sources.select(F.pmod(self._hashed("source"), F.lit(most)).alias("b")).distinct().collect()]  # at most self.buckets
        rows = self._read("words", segments, at).join(sources, "source", "left_semi")
        return self._live(rows, segments)

    def compact(self, keep: int = 0) -> None:
        """Merges all segments but the ``keep`` oldest. Dead postings and counts that cancel out go;
        sources that are gone stay named as long as older segments may have them."""
        n = self.log.last()
        record = self.log.read(n) or self._none
        old, merged = record["segments"][:keep], record["segments"][keep:]
        if not merged:
            return
        segment = self._segment(n + 1, sum(s["files"] for s in merged))
        live = self._live(self._read("words", merged), merged).drop("version", "bucket")
        words = self._write("words", self._dealt(live, segment, "source"), segment, "source")
        self._write_postings(words, segment)
        segment["chunks"] = words.count()
        files = self._read("files", merged).groupBy("source").agg(F.max_by(F.struct("content_hash", "n_chunks"), "version").alias("f")).select("source", "f.*")
        self._write("files", self._dealt(files if old else files.where("content_hash IS NOT NULL"), segment, "source"), segment, "source")
        self._write("terms", self._dealt(self._read("terms", merged).groupBy("term").agg(F.sum("df").alias("df")).where("df != 0"), segment, "term"), segment, "term")
        self.log.publish(n + 1, record | {"segments": [*old, segment]})

    def compact_small(self, factor: int = 4) -> bool:
        """Compacts the newest segments up to one that has over ``factor`` times the chunks of all that
        are newer: each chunk is rewritten a logarithmic number of times, and few segments stay."""
        segments = self.record()["segments"]
        keep, newer = len(segments), 0
        while keep and (keep == len(segments) or segments[keep - 1]["chunks"] <= factor * newer):
            newer += segments[keep - 1]["chunks"]
            keep -= 1
        if len(segments) - keep < 2:
            return False
        self.compact(keep)
        return True

    def vacuum(self) -> int:
        """Deletes the segments that the last commit doesn't name, such as those of failed or losing updates.
        Not while others read earlier commits or write."""
        live, gone = {s["name"] for s in self.record()["segments"]}, 0
        for kind in SCHEMAS:
            fs, at = file_system(self.spark, f"{self.path}/{kind}")
            for f in fs.listStatus(at) if fs.exists(at) else []:
                if f.getPath().getName() not in live:
                    delete(self.spark, f.getPath().toString())
                    gone += 1
        return gone


def event_documents(events: DataFrame, scope: str = "project") -> tuple[DataFrame, DataFrame]:
    """((source, content_hash, chunk_id, document), (reason, n)): events as files of one chunk each, by
    event_id, and how many were rejected. An event needs an id and a summary (or evidence), and
    must not be noise. User events have the source ``user#<id>`` and no concept."""
    from ..operators.events import is_noise

    def given(c: str) -> Column:
        return F.col(c) if c in events.columns else F.lit(None).cast("string")

    noise = is_noise(F.col("event_type"), F.col("source"), given("source_type"), F.col("summary"), F.col("evidence"), given("path"), given("ingestion_eligible").cast("boolean"))
    body = F.coalesce(F.when(F.col("summary") != "", F.col("summary")), F.col("evidence"), F.lit(""))
    kind = F.coalesce("event_type", F.lit("observation"))
    reason = F.when(F.coalesce("event_id", F.lit("")) == "", "missing id").when(body == "", "no summary").when(noise, "noise")
    rows = events.withColumn("_reason", reason)
    if scope == "user":
        document, key = F.concat(F.lit("Type: "), kind, F.lit("\n"), body), F.concat(F.lit("user#"), F.col("event_id"))
    else:
        document = F.concat(F.lit("Concept: "), F.col("concept"), F.lit("\nEvent: "), body, F.lit("\nType: "), kind, F.lit("\nSource: "), F.coalesce("source", F.lit("unknown")))
        key = F.concat(F.col("concept"), F.lit("#event_"), F.col("event_id"))
    good = rows.where("_reason IS NULL").select(key.alias("source"), document.alias("document")).where("source IS NOT NULL")
    good = good.groupBy("source").agg(F.max("document").alias("document"))
    return good.select("source", F.sha2("document", 256).alias("content_hash"), "document"), rows.where("_reason IS NOT NULL").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


def whole_documents(files: DataFrame) -> DataFrame:
    """A chunk per file, named as it is."""
    return files.select("source", F.col("source").alias("chunk_id"), "document")
