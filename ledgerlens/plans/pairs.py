"""Queries on pairs: resolution, duplicates, contradictions, conflicts and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from ..operators import pairs as P
from ..operators.lifecycle import numbered
from ..sources.tables import REGISTRY_SQL, concept_registry, event_ledger, table
from .registry import query


@query(f"WITH {REGISTRY_SQL}, names AS (SELECT lower(canonical_name) AS k, concept_id FROM rg UNION ALL SELECT lower(alias1), concept_id FROM rg UNION ALL SELECT lower(alias2), concept_id FROM rg), n AS (SELECT k, min(concept_id) AS concept_id FROM names GROUP BY k), t AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN p_brand ELSE p_type || 'x' END AS term FROM part) SELECT term, CAST(concept_id AS VARCHAR) AS concept_id FROM t LEFT JOIN n ON n.k = CASE p WHEN '' THEN lower(trim(term)) ELSE p END".replace("FROM t LEFT JOIN n", "FROM (SELECT term, lower(trim(regexp_replace(term, '[^\\p{L}\\p{N}_\\s-]', '', 'g'))) AS p FROM t) LEFT JOIN n"))
def resolve_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1"""
    k = F.col("p_partkey") % 3
    terms = table(spark, sf_dir, "part").select(F.when(k == 0, F.concat(F.upper("p_name"), F.lit("!"))).when(k == 1, F.col("p_brand")).otherwise(F.concat("p_type", F.lit("x"))).alias("term")).distinct()
    return P.resolve_exact(terms, concept_registry(spark, sf_dir))


@query("SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, count(*) AS n, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM part GROUP BY slug HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, F13"""
    return P.duplicate_groups(table(spark, sf_dir, "part"), slug(F.col("p_name")), "p_partkey", "slug")


RULES = [(r"rest\b", r"grpc\b", "REST vs gRPC protocol conflict"), (r"postgresql\b", r"mysql\b", "PostgreSQL vs MySQL database selection conflict"), (r"tabs\b", r"spaces\b", "Tabs vs Spaces formatting conflict"), (r"monolith\b", r"microservice\b", "Monolithic vs Microservice architecture conflict"), (r"sync\b", r"async\b", "Synchronous vs Asynchronous flow conflict")]


@query(
    r"""WITH d AS (SELECT p_partkey AS id, lower(p_name || ' ' || CASE p_partkey % 40 WHEN 0 THEN 'rest' WHEN 1 THEN 'grpc' WHEN 2 THEN 'tabs' WHEN 3 THEN 'use spaces' ELSE '' END) AS t FROM part),
h AS (SELECT id, 'REST vs gRPC protocol conflict' AS rule, 0 AS s FROM d WHERE regexp_matches(t, 'rest\b') UNION ALL SELECT id, 'REST vs gRPC protocol conflict', 1 FROM d WHERE regexp_matches(t, 'grpc\b') UNION ALL SELECT id, 'Tabs vs Spaces formatting conflict', 0 FROM d WHERE regexp_matches(t, 'tabs\b') UNION ALL SELECT id, 'Tabs vs Spaces formatting conflict', 1 FROM d WHERE regexp_matches(t, 'spaces\b'))
SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, x.rule FROM h x JOIN h y ON x.rule = y.rule AND x.s = 0 AND y.s = 1 AND x.id <> y.id"""
)
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10 over part names with words of the rules."""
    k = F.col("p_partkey") % 40
    extra = F.when(k == 0, "rest").when(k == 1, "grpc").when(k == 2, "tabs").when(k == 3, "use spaces").otherwise("")
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", extra).alias("text"))
    return P.contradictions(docs, RULES)


@query(
    """WITH d AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Always paint it' WHEN 1 THEN 'never paint it' ELSE 'paint it' END AS rule, CASE WHEN p_size % 10 = 0 THEN 'general' ELSE 'size' || CAST(p_size AS VARCHAR) END AS scope, p_brand AS tr FROM part),
p AS (SELECT *, lower(rule) LIKE '%always%' AS pos, lower(rule) LIKE '%never%' AS neg FROM d)
SELECT DISTINCT a.id AS d1, b.id AS d2 FROM p a JOIN p b ON a.id < b.id AND ((a.pos AND b.neg) OR (a.neg AND b.pos)) AND (a.tr = b.tr OR (a.scope = b.scope AND a.scope <> 'general'))"""
)
def directive_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11 over parts as directives."""
    k = F.col("p_partkey") % 5
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(k == 0, "Always paint it").when(k == 1, "never paint it").otherwise("paint it").alias("rule"), F.when(F.col("p_size") % 10 == 0, "general").otherwise(F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("scope"), F.array("p_brand").alias("triggers"))
    return P.directive_conflicts(d)


LINKS_SQL = r"lk AS (SELECT page_id AS src, CASE WHEN page_id % 3 = 0 THEN 'depends_on' WHEN page_id % 3 = 1 THEN '' ELSE 'contradicts' END AS type, unnest(regexp_extract_all(html, '<a href=\"/([^\"]+)\"', 1)) AS dst FROM pages), tg AS (SELECT dst FROM lk GROUP BY dst HAVING count(*) > 1), ed AS (SELECT DISTINCT src, CASE WHEN type = '' THEN 'relates_to' ELSE type END AS type, dst FROM lk WHERE dst IN (SELECT dst FROM tg))"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    links = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("src"), F.when(k == 0, "depends_on").when(k == 1, "").otherwise("contradicts").alias("type"), F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]+)"'), F.lit(1))).alias("dst"))
    known = links.groupBy(F.col("dst").alias("id")).count().where("count > 1")
    return P.edges(links, known)


@query(f"WITH {LINKS_SQL} SELECT CAST(src AS VARCHAR) AS src, type, dst FROM ed".replace('\\"', '"'))
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages; targets that several pages name exist."""
    return _edges(spark, sf_dir)


@query(f"WITH {LINKS_SQL} SELECT CAST(src AS VARCHAR) AS src, type, dst FROM ed UNION SELECT dst, CASE type WHEN 'depends_on' THEN 'depended_on_by' ELSE 'relates_to' END, CAST(src AS VARCHAR) FROM ed".replace('\\"', '"'))
def graph_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2"""
    return P.with_reciprocal(_edges(spark, sf_dir))


@query(f"WITH {LINKS_SQL}, o AS (SELECT CAST(src AS VARCHAR) AS src, dst, max(type) AS type FROM ed GROUP BY ALL) SELECT src, string_agg(dst || ':' || type, ',' ORDER BY dst || ':' || type) AS related, count(*) AS n FROM o GROUP BY src".replace('\\"', '"'))
def graph_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G3"""
    return P.related(_edges(spark, sf_dir))


@query("SELECT 'concept_' || lpad(CAST((SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_nationkey) AS VARCHAR), 3, '0') AS next_id, n_name FROM nation")
def id_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids after the largest; gaps are never used again."""
    top = F.broadcast(table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("top")))
    rows = numbered(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", "i")
    number = (F.col("top") + F.col("i") + 1).cast("string")
    return rows.crossJoin(top).select(F.concat(F.lit("concept_"), F.when(F.length(number) >= 3, number).otherwise(F.lpad(number, 3, "0"))).alias("next_id"), "n_name")


@query("SELECT i AS missing_id FROM (SELECT unnest(range(1, (SELECT max(l_partkey) + 1 FROM lineitem))) AS i) WHERE i NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey % 7 <> 3)")
def id_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23; the range is a generated table, not one row's array."""
    used = table(spark, sf_dir, "lineitem").select("l_partkey")
    top = used.agg(F.max("l_partkey")).head()[0] or 0
    return spark.range(1, top + 1).select(F.col("id").alias("missing_id")).join(used.where("l_partkey % 7 != 3").select(F.col("l_partkey").alias("missing_id")), "missing_id", "left_anti")


@query("WITH w AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_partkey % 9 <> 0), r AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 11 <> 0) SELECT 'orphan_wiki' AS code, k AS key FROM w WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT 'missing_wiki', k FROM r WHERE k NOT IN (SELECT k FROM w)")
def registry_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12"""
    w = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")).where("key % 9 != 0").distinct()
    r = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")).where("key % 11 != 0")
    return w.join(r, "key", "left_anti").select(F.lit("orphan_wiki").alias("code"), "key").unionByName(r.join(w, "key", "left_anti").select(F.lit("missing_wiki").alias("code"), "key"))


def _distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ord"), F.max("p_size").alias("rank"))


@query()
def fuzzy_merge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, J8"""
    return P.merge_proposals(_distinct_names(spark, sf_dir), 0.8)


@query()
def fuzzy_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as the terms of one ledger per brand."""
    terms = table(spark, sf_dir, "part").select(F.col("p_brand").alias("ledger"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("term"))
    return P.resolve_fuzzy(terms)


@query()
def event_concept_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest names for each distinct summary, evidence first in the ratio. The
    names are a table: every summary meets every name."""
    from ..functions.similarity import ratio_udf

    names = _distinct_names(spark, sf_dir).select("name")
    terms = event_ledger(spark, sf_dir).select("summary").distinct()
    rows = terms.crossJoin(names).withColumn("s", F.round(ratio_udf(F.lower("summary"), F.lower("name")), 6))
    from ..operators.ranking import top_k

    return top_k(rows, 3, F.desc("s"), F.asc("name"), partition=["summary"]).select("summary", "rank", "name", F.col("s").alias("similarity"))


@query()
def recover_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D-3 over one ledger per user."""
    e = event_ledger(spark, sf_dir)
    return P.recover_dedupe(e.select(F.col("user_id").cast("string").alias("ledger"), "seq", F.concat(F.lit("i"), (F.col("seq") % 900).cast("string")).alias("id"), F.concat_ws("|", "event_type", "evidence").alias("body"), "summary", "day", "source").withColumnRenamed("day", "ts"))


@query()
def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one label's vectors by cosine; a label is a registry."""
    from ..operators.blocks import similar_pairs

    # rounded to six digits, 0.2999995 is 0.3 already
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    p = similar_pairs(e, 0.299999).withColumn("similarity", F.round("similarity", 6)).where("similarity >= 0.3")
    return P.consolidate(p.select("grp", "a", "b", "similarity", (F.col("a") % 5).alias("qa"), (F.col("b") % 5).alias("qb")))


@query()
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the one before it of its source."""
    h = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))
    d = P.revisions(h).select(F.col("seq").alias("doc_id"), P.diff_summary("previous", "content").alias("d"))
    return d.select("doc_id", "d.n_hunks", "d.added", "d.removed")
