"""Views of registries, indexes and the maintenance around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import identifiers, ngrams, phrases, token_estimate, tokens
from ..sources.tables import concept_registry, table
from .registry import query


@query("SELECT p_partkey AS key, coalesce(s_name, p_name) AS title, CASE WHEN s_suppkey IS NULL THEN 'registry' ELSE 'wiki' END AS origin FROM part LEFT JOIN supplier ON p_partkey = s_suppkey UNION ALL SELECT s_suppkey, s_name, 'wiki' FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part)")
def registry_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry and documents, documents win."""
    r, w = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    j = r.join(w, r.p_partkey == w.s_suppkey, "full")
    return j.select(F.coalesce("s_suppkey", "p_partkey").alias("key"), F.coalesce("s_name", "p_name").alias("title"), F.when(F.col("s_suppkey").isNull(), "registry").otherwise("wiki").alias("origin"))


@query(
    """WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 1), b AS (SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN sha256(text || ' edited') ELSE sha256(text) END AS h, CAST(ceil(length(text) / 400.0) AS BIGINT) AS c FROM documents WHERE doc_id % 10 <> 3)
SELECT CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'updated' ELSE 'unchanged' END AS state, count(*) AS n_files, CAST(sum(coalesce(c, 0)) AS BIGINT) AS n_chunks FROM a FULL JOIN b ON a.doc_id = b.doc_id GROUP BY 1"""
)
def index_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots by content hash; hashes, not texts, are joined."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    a = d.where(k % 10 != 1).select("doc_id", F.sha2("text", 256).alias("h"), F.lit(True).alias("old"))
    b = d.where(k % 10 != 3).select("doc_id", F.when(k % 10 == 2, F.sha2(F.concat("text", F.lit(" edited")), 256)).otherwise(F.sha2("text", 256)).alias("g"), F.ceil(F.length("text") / 400).alias("c"), F.lit(True).alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("h") != F.col("g"), "updated").otherwise("unchanged")
    return a.join(b, "doc_id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n_files"), F.sum(F.coalesce("c", F.lit(0))).cast("long").alias("n_chunks"))


@query("WITH s AS (SELECT doc_id, 'm1' AS model, 64 AS dim, sha256(text) AS h FROM documents), e AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'm0' ELSE 'm1' END AS model, len(embedding) AS dim FROM embeddings) SELECT CASE WHEN e.vec_id IS NULL THEN 'missing' WHEN e.model <> s.model OR e.dim <> s.dim THEN 'other_generation' ELSE 'ready' END AS state, count(*) AS n FROM s LEFT JOIN e ON s.doc_id = e.vec_id GROUP BY 1")
def embedding_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks against the embeddings of the active generation (model and dimension)."""
    s = table(spark, sf_dir, "documents").select("doc_id")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 3 == 0, "m0").otherwise("m1").alias("model"), F.size("embedding").alias("dim"))
    state = F.when(F.col("model").isNull(), "missing").when((F.col("model") != "m1") | (F.col("dim") != 64), "other_generation").otherwise("ready")
    return s.join(e, "doc_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE source IS NOT NULL AND source <> '' GROUP BY source")
def chunk_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, S27"""
    return table(spark, sf_dir, "documents").where("source IS NOT NULL AND source != ''").groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, array_to_string(list_slice(l, 2, 4), chr(10)) AS b, greatest(least(len(l), 4) - 1, 0) AS n FROM l) SELECT doc_id, substr(b, 1, 20000) AS body, CAST(1 + n AS INTEGER) AS end_line, CASE WHEN n = 0 THEN 'out_of_range' WHEN length(b) > 20000 THEN 'truncated' ELSE '' END AS warnings FROM b")
def bounded_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4 of every document, with a warning if there are none or they are too long."""
    from ..operators.source_search import read_range

    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel_path"), F.col("text").alias("document"))
    return read_range(files, None, 2, 4).select(F.col("rel_path").alias("doc_id"), "body", "end_line", F.array_join("warnings", ",").alias("warnings"))


@query(r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents) SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_distinct(w)) AS INTEGER) AS n_unique, CAST(greatest(len(w) - 3, 0) + greatest(len(w) - 4, 0) + greatest(len(w) - 5, 0) + greatest(len(w) - 6, 0) AS INTEGER) AS n_phrases, CAST(greatest(len(w) - 1, 0) AS INTEGER) AS n_bigrams FROM w")
def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F3, W7, W8"""
    w = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_unique"), F.size(phrases(F.col("w"))).alias("n_phrases"), F.size(ngrams(F.col("w"), 2)).alias("n_bigrams"))


@query("SELECT lang, count(*) AS n, CAST(sum(greatest(1, ceil(length(text) / 4.0))) AS BIGINT) AS est_tokens, CAST(max(length(text)) AS BIGINT) AS longest FROM documents GROUP BY lang")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, A20, F24"""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(token_estimate(F.length("text"))).alias("est_tokens"), F.max(F.length("text").cast("long")).alias("longest"))


@query("WITH r AS (SELECT p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS r FROM part) SELECT a.p_name AS canonical_name, a.p_partkey AS survivor, CAST(count(b.p_partkey) AS BIGINT) AS absorbed, CAST(a.p_size + coalesce(sum(b.p_size), 0) AS BIGINT) AS evidence FROM r a LEFT JOIN r b ON a.p_name = b.p_name AND b.r > 1 WHERE a.r = 1 GROUP BY a.p_name, a.p_partkey, a.p_size")
def merge_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of one name become the one with the most evidence."""
    g = concept_registry(spark, sf_dir).groupBy("canonical_name").agg(F.min(F.struct((-F.col("evidence_count")).alias("k"), "concept_id")).alias("b"), F.count("*").alias("n"), F.sum("evidence_count").alias("evidence"))
    return g.select("canonical_name", F.col("b.concept_id").alias("survivor"), (F.col("n") - 1).alias("absorbed"), "evidence")


@query("SELECT p_partkey AS concept_id, CASE WHEN p_partkey % 4 = 0 THEN 'merged-' || p_brand ELSE p_brand END AS candidate, count(*) OVER (PARTITION BY CASE WHEN p_partkey % 4 = 0 THEN 'merged-' || p_brand ELSE p_brand END) AS n FROM part WHERE p_size > 45")
def events_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that match are renamed, and counted again."""
    from pyspark.sql import Window

    name = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("merged-"), "p_brand")).otherwise(F.col("p_brand"))
    rows = table(spark, sf_dir, "part").where("p_size > 45").select(F.col("p_partkey").alias("concept_id"), name.alias("candidate"))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("candidate")))


@query("WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) SELECT conv_id, turn FROM t WHERE r <= 3")
def checkpoint_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three snapshots of each."""
    from ..operators.ranking import top_k

    return top_k(table(spark, sf_dir, "conversations").select("conv_id", "turn"), 3, F.desc("turn"), partition=["conv_id"]).select("conv_id", "turn")


@query(
    """WITH s AS (SELECT o_custkey AS l, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'in_progress' END AS st FROM orders),
n AS (SELECT *, CASE WHEN id % 5 = 0 THEN CASE st WHEN 'pending' THEN 'in_progress' WHEN 'in_progress' THEN 'completed' ELSE 'pending' END WHEN id % 7 = 0 THEN 'completed' ELSE st END AS new FROM s),
f AS (SELECT *, bool_or((id % 5 = 0 OR id % 7 = 0) AND new = 'completed' AND st <> 'completed') OVER (PARTITION BY l) AS done, bool_or(new = 'in_progress') OVER (PARTITION BY l) AS busy, min(CASE WHEN new = 'pending' THEN id END) OVER (PARTITION BY l) AS nxt FROM n)
SELECT id, CASE WHEN done AND NOT busy AND id = nxt THEN 'in_progress' ELSE new END AS status FROM f"""
)
def todo_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of items, each fifth moved on by one state and each seventh completed; where something was completed and nothing is in
    progress, the first pending item begins."""
    from ..operators.active_work import todo_advance as advance

    k = F.col("o_orderkey")
    s = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("in_progress")
    todos = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("list"), k.alias("ord"), k.alias("id"), s.alias("status"))
    changes = todos.where("id % 5 = 0 OR id % 7 = 0").select("list", "id", F.when(F.col("id") % 5 == 0, "").otherwise("completed").alias("status"))
    return advance(todos, changes).select("id", "status")


@query()
def identifier_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18 over page markup: Java's look-around has no RE2 form."""
    found = identifiers(F.regexp_replace("html", "<[^>]*>", " "))
    return table(spark, sf_dir, "pages").select("page_id", F.size(found).alias("n"), F.array_join(F.slice(found, 1, 5), ",").alias("first"))


@query("WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT CAST(len(l) AS INTEGER) AS n_lines, count(*) AS n FROM x GROUP BY 1")
def line_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S25"""
    return table(spark, sf_dir, "documents").groupBy(F.size(F.split("text", "\n", -1)).alias("n_lines")).agg(F.count("*").alias("n"))


