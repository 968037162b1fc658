"""Queries over indexes that change: updates, events as documents, vectors as a second phase."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ranking
from ..sources.live_index import LiveIndex, event_documents, whole_documents
from ..sources.scratch import fresh
from ..sources.tables import EVENTS_SQL, event_ledger, table
from ..sources.vectors import VectorStore, slot_embedder
from .registry import query
from .retrieval import QUERY_ITEM, _words, first_words

# Documents by three rounds of changes: at first all but each fifth, then those too, each
# seventh edited, and each eleventh gone.
FINAL_SQL = r"SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 = 0 THEN upper(lang) || ' edited again ' || text ELSE text END AS document FROM documents WHERE doc_id % 11 <> 0"
BM25_SQL = rf"""
toks AS (SELECT id, {_words("document")} AS w FROM final),
q AS (SELECT unnest(list_slice(list_transform(string_split_regex(trim(text), '\s+'), lambda x: lower(x)), 1, 6)) AS raw FROM benchmark WHERE item_id = {QUERY_ITEM}),
qt AS (SELECT t AS term, count(*) AS times FROM (SELECT unnest({_words("raw")}) AS t FROM q) WHERE length(t) > 1 GROUP BY t),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM toks),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(a, 1.0)))) AS s
  FROM post JOIN qt USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY id)
"""


def document_files(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("source"), F.sha2(F.col("text"), 256).alias("content_hash"), F.col("text").alias("document"))


def changed_documents(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The table of documents after each of three rounds of changes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat(F.upper("lang"), F.lit(" edited again "), F.col("text"))).otherwise(F.col("text"))
    whole = docs.withColumn("text", edited)
    return [document_files(docs.where("doc_id % 5 != 0")), document_files(whole), document_files(whole.where("doc_id % 11 != 0"))]


def updated_index(spark: SparkSession, sf_dir: str) -> LiveIndex:
    """An index after the three rounds, the newest two segments merged."""
    index = LiveIndex(spark, fresh(spark, "live-index"))
    for files in changed_documents(spark, sf_dir):
        index.update(files, whole_documents)
    index.compact(keep=1)
    return index


@query(f"WITH final AS ({FINAL_SQL}), {BM25_SQL} SELECT id AS chunk_id, round(s / (SELECT max(s) FROM raw), 6) AS sparse FROM raw")
def index_update_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of an index after additions, edits and deletions, as if it were built anew."""
    found = updated_index(spark, sf_dir).sparse_scores(first_words(spark, sf_dir))
    return found.select("chunk_id", F.round("sparse", 6).alias("sparse"))


@query(
    """WITH s AS (SELECT 1 AS step, CASE WHEN doc_id % 5 <> 0 THEN 'new' END AS state FROM documents UNION ALL SELECT 2, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'updated' ELSE 'unchanged' END FROM documents
UNION ALL SELECT 3, CASE WHEN doc_id % 11 = 0 THEN 'deleted' ELSE 'unchanged' END FROM documents)
SELECT CAST(step AS INTEGER) AS step, state, count(*) AS n_files, count(*) AS n_chunks FROM s WHERE state IS NOT NULL GROUP BY step, state"""
)
def index_update_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three updates found."""
    index, out = LiveIndex(spark, fresh(spark, "live-index")), None
    for step, files in enumerate(changed_documents(spark, sf_dir), 1):
        found = index.update(files, whole_documents).select(F.lit(step).alias("step"), "state", "n_files", "n_chunks")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    f"""WITH {EVENTS_SQL}, d AS (SELECT 'user#' || event_id AS id, 'Type: ' || event_type || chr(10) || summary AS document FROM ev WHERE scope = 'user' AND seq % 13 <> 0 AND seq % 17 <> 0 AND NOT (source = 'orchestrator' AND event_type = 'observation')),
toks AS (SELECT id, {_words("document")} AS w FROM d), st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM toks),
post AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT id, sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(a, 1.0)))) AS s FROM post JOIN df USING (term) CROSS JOIN st WHERE term IN ('failure', 'reviewed', 'review', 'c7') GROUP BY id)
SELECT id AS chunk_id, round(s / (SELECT max(s) FROM raw), 6) AS sparse FROM raw"""
)
def user_event_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the scope user as an index of their own: ids that are missing, empty summaries and
    noise are rejected; indexing twice changes nothing."""
    e = event_ledger(spark, sf_dir).where("scope = 'user'")
    e = e.withColumn("event_id", F.when(F.col("seq") % 13 != 0, F.col("event_id"))).withColumn("summary", F.when(F.col("seq") % 17 == 0, F.lit("Command execution: ls")).otherwise(F.col("summary"))).withColumn("event_type", F.when(F.col("seq") % 17 == 0, F.lit("telemetry")).otherwise(F.col("event_type")))
    index = LiveIndex(spark, fresh(spark, "user-events"), 16)
    for _ in range(2):
        good, _ = event_documents(e, "user")
        index.update(good, whole_documents)
    return index.sparse_scores("failure reviewed review c7").select("chunk_id", F.round("sparse", 6).alias("sparse"))


@query(
    f"""WITH {EVENTS_SQL}, u AS (SELECT * FROM ev WHERE scope = 'user') SELECT CASE WHEN seq % 13 = 0 THEN 'missing id' WHEN seq % 17 = 0 OR (source = 'orchestrator' AND event_type = 'observation') THEN 'noise' ELSE 'indexed' END AS reason, count(*) AS n FROM u GROUP BY 1"""
)
def user_event_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many user events are indexed, and why the others are not."""
    e = event_ledger(spark, sf_dir).where("scope = 'user'")
    e = e.withColumn("event_id", F.when(F.col("seq") % 13 != 0, F.col("event_id"))).withColumn("event_type", F.when(F.col("seq") % 17 == 0, F.lit("telemetry")).otherwise(F.col("event_type")))
    good, rejected = event_documents(e, "user")
    return rejected.select("reason", "n").unionByName(good.agg(F.lit("indexed").alias("reason"), F.count("*").alias("n")))


SYNONYMS = {"the": "der", "of": "que"}


def slots_sql(text: str) -> str:
    """The slots of a text's words (twice), their synonyms (thrice) and its noise, with their weights."""
    parts = rf"list_filter(flatten(list_transform(regexp_extract_all({text}, '[A-Za-z0-9]+'), lambda t: string_split(lower(substr(t, 1, 1) || regexp_replace(substr(t, 2), '([A-Z])', ' \1', 'g')), ' '))), lambda p: p <> '')"
    slot = "CAST('0x' || substr(sha256({}), 1, 8) AS BIGINT) % 64"
    other = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SYNONYMS.items()) + " ELSE p END"
    noise = f"list_transform([1, 3, 5, 7], lambda i: {{'s': CAST('0x' || substr(sha256({text}), i, 2) AS BIGINT) % 64, 'w': 0.03::DOUBLE}})"
    return f"list_concat(list_transform({parts}, lambda p: {{'s': {slot.format('p')}, 'w': 2.0::DOUBLE}}), list_transform({parts}, lambda p: {{'s': {slot.format(other)}, 'w': 3.0::DOUBLE}}), {noise})"


@query(
    rf"""WITH final AS ({FINAL_SQL}), {BM25_SQL},
qtext AS (SELECT array_to_string(list_slice(string_split_regex(trim(text), '\s+'), 1, 6), ' ') AS t FROM benchmark WHERE item_id = {QUERY_ITEM}),
slots AS (SELECT id, unnest({slots_sql("document")}) AS x FROM final), vec AS (SELECT id, x.s AS s, sum(x.w) AS v FROM slots GROUP BY ALL), norm AS (SELECT id, sqrt(sum(v * v)) AS n FROM vec GROUP BY id),
qslots AS (SELECT unnest({slots_sql("t")}) AS x FROM qtext), qvec AS (SELECT x.s AS s, sum(x.w) AS v FROM qslots GROUP BY ALL), qnorm AS (SELECT sqrt(sum(v * v)) AS n FROM qvec),
dense AS (SELECT vec.id, sum(vec.v * qvec.v) / max(norm.n) / (SELECT n FROM qnorm) AS d FROM vec JOIN qvec USING (s) JOIN norm ON norm.id = vec.id GROUP BY vec.id)
SELECT f.id AS chunk_id, round(coalesce(d, 0), 6) AS dense, round(0.45 * coalesce(d, 0) + 0.30 * coalesce(s, 0) / (SELECT max(s) FROM raw) + 0.15 + 0.05, 6) AS score
FROM final f LEFT JOIN dense USING (id) LEFT JOIN raw USING (id) ORDER BY score DESC, chunk_id LIMIT 25"""
)
def hybrid_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after its updates, with vectors of a published generation: the first embeds
    the documents of the first round, the second only what came since."""
    embed = slot_embedder(64, SYNONYMS)
    rounds, index = changed_documents(spark, sf_dir), updated_index(spark, sf_dir)
    store = VectorStore(spark, fresh(spark, "vectors"), "slots-64", 64, embed)
    for files in (rounds[0], rounds[2]):
        store.refresh(whole_documents(files))
    text = first_words(spark, sf_dir)
    q = ranking.literal_vector(list(embed([text])[0]))
    dense = store.current().select("chunk_id", ranking.cosine(F.col("vector"), q).alias("dense"))
    rows = dense.join(index.sparse_scores(text), "chunk_id", "left")
    score = ranking.blend(F.col("dense"), F.coalesce("sparse", F.lit(0.0)), F.lit(1.0), ranking.importance(F.lit("medium")))
    return ranking.top_k(rows.select("chunk_id", F.round("dense", 6).alias("dense"), F.round(score, 6).alias("score")), 25, F.desc("score"), F.asc("chunk_id"))


@query(
    rf"""WITH {EVENTS_SQL}, e AS (SELECT event_id, CASE WHEN seq % 9 = 0 THEN '' WHEN seq % 2 = 0 THEN (SELECT p_name FROM part WHERE p_partkey = seq % 10) ELSE 'note ' || seq || ' on ' || concept END AS t FROM ev WHERE seq % 3 = 0),
x AS (SELECT p_partkey AS id, p_name AS t FROM part WHERE p_partkey < 40),
es AS (SELECT event_id, unnest({slots_sql("t")}) AS s FROM e WHERE t <> ''), xs AS (SELECT id, unnest({slots_sql("t")}) AS s FROM x),
ev1 AS (SELECT event_id, s.s AS s, sum(s.w) AS v FROM es GROUP BY ALL), xv AS (SELECT id, s.s AS s, sum(s.w) AS v FROM xs GROUP BY ALL),
en AS (SELECT event_id, sqrt(sum(v * v)) AS n FROM ev1 GROUP BY ALL), xn AS (SELECT id, sqrt(sum(v * v)) AS n FROM xv GROUP BY ALL),
d AS (SELECT event_id, xv.id, round(sum(ev1.v * xv.v) / max(en.n) / max(xn.n), 9) AS c FROM ev1 JOIN xv USING (s) JOIN en USING (event_id) JOIN xn ON xn.id = xv.id GROUP BY event_id, xv.id),
b AS (SELECT event_id, max(c) AS c FROM d GROUP BY event_id)
SELECT CASE WHEN t = '' THEN 'no_evidence' WHEN coalesce(c, 0) >= 0.75 THEN 'reassign' ELSE 'low_similarity' END AS state, count(*) AS n, round(sum(CASE WHEN c >= 0.75 THEN c ELSE 0 END), 4) AS score FROM e LEFT JOIN b USING (event_id) GROUP BY 1"""
)
def split_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a general concept, told apart by what their evidence is nearest to."""
    from ..operators.reading import split_general as split

    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("canonical_name"))
    k = F.col("seq")
    e = event_ledger(spark, sf_dir).where("seq % 3 = 0").withColumn("_p", k % 10)
    named = e.join(F.broadcast(p.where("concept_id < 10").select(F.col("concept_id").alias("_p"), "canonical_name")), "_p", "left")
    text = F.when(k % 9 == 0, "").when(k % 2 == 0, F.col("canonical_name")).otherwise(F.concat(F.lit("note "), k.cast("string"), F.lit(" on "), F.col("concept")))
    found = split(named.select("event_id", text.alias("evidence")), p.where("concept_id < 40"), slot_embedder(64, SYNONYMS))
    return found.groupBy("state").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("score") >= 0.75, F.col("score")).otherwise(0.0)), 4).alias("score"))
