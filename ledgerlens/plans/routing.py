"""Queries that score, rank and decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory as M
from ..operators import routing as R
from ..operators import source_search as S
from ..sources.tables import EVENTS_SQL, event_ledger, table
from .registry import query

TASKS = ["paint the red plate", "review large steel gear workflow", "hot anvil and small bolt", "nothing of this"]
TASKS_SQL = "tk AS (SELECT unnest(['paint the red plate', 'review large steel gear workflow', 'hot anvil and small bolt', 'nothing of this']) AS task)"


def _tasks(df: DataFrame) -> DataFrame:
    """Each row with each task: the tasks are literals of the plan."""
    return df.withColumn("task", F.explode(F.array(*map(F.lit, TASKS))))


NAMES_SQL = "nm AS (SELECT DISTINCT p_name AS title FROM part)"


@query(
    f"""WITH {TASKS_SQL}, {NAMES_SQL}, s AS (SELECT task, title, string_split(title, ' ') AS w, string_split(task, ' ') AS t FROM tk, nm),
x AS (SELECT *, contains(task, title) AS ex, len(list_intersect(list_distinct(w), list_distinct(t))) AS sh, greatest(len(list_distinct(w)), len(list_distinct(t))) AS mx, w[1] AS tag FROM s)
SELECT task, title AS concept, round(CASE WHEN ex THEN 5.0 ELSE 0 END + CASE WHEN contains(task, tag) AND NOT (ex AND contains(title, tag)) THEN 3.0 ELSE 0 END + CASE WHEN sh * 1.0 / mx >= 0.2 OR sh >= 2 THEN 2.0 ELSE 0 END, 6) AS score
FROM x WHERE ex OR (contains(task, tag) AND NOT (ex AND contains(title, tag))) OR sh * 1.0 / mx >= 0.2 OR sh >= 2"""
)
def skill_concept_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts (distinct part names, their first word a tag) for each task."""
    names = _tasks(table(spark, sf_dir, "part").select(F.col("p_name").alias("title")).distinct())
    tag = F.array(F.element_at(F.split("title", " "), 1))
    score = R.concept_score(F.col("task"), F.col("title"), F.lit(""), tag, F.array().cast("array<string>"), F.lit("validated"))
    return names.select("task", F.col("title").alias("concept"), F.round(score, 6).alias("score")).where("score > 0")


TYPE_SQL = r"""CASE WHEN regexp_matches(d, '^Decision:') THEN 'decision' WHEN regexp_matches(d, '^## Failure\b') THEN 'failure' WHEN regexp_matches(d, '^\*\*Outcome\*\*:') THEN 'outcome' WHEN regexp_matches(d, '^workaround\b') THEN 'workaround'
  WHEN regexp_matches(d, '(?i)\b(prefer|like|always|never|don''t|hate|style|convention)\b') THEN 'preference' WHEN regexp_matches(d, '(?i)\b(last time|previously|tried|attempted|before)\b') THEN 'episodic' ELSE 'observation' END"""


@query(
    rf"""WITH m AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Decision: ' WHEN 1 THEN '## Failure' || chr(10) WHEN 2 THEN '**Outcome**: ' WHEN 3 THEN 'workaround for ' ELSE '' END || text AS d, length(CASE doc_id % 5 WHEN 0 THEN 'Decision: ' WHEN 1 THEN '## Failure' || chr(10) WHEN 2 THEN '**Outcome**: ' WHEN 3 THEN 'workaround for ' ELSE '' END || text) AS n FROM documents),
k AS (SELECT doc_id, d, CASE doc_id % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'failure' WHEN 2 THEN 'outcome' WHEN 3 THEN 'workaround' ELSE CASE WHEN regexp_matches(d, '(?i)\b(prefer|like|always|never|don''t|hate|style|convention)\b') THEN 'preference' WHEN regexp_matches(d, '(?i)\b(last time|previously|tried|attempted|before)\b') THEN 'episodic' ELSE 'observation' END END AS type FROM m)
SELECT type, count(*) AS n FROM k GROUP BY type"""
)
def memory_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F26 over documents with labels set before them."""
    d = _labelled(spark, sf_dir)
    return d.groupBy(R.memory_type(F.col("d")).alias("type")).agg(F.count("*").alias("n"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels set before them."""
    k = F.col("doc_id") % 5
    lead = F.when(k == 0, "Decision: ").when(k == 1, "## Failure\n").when(k == 2, "**Outcome**: ").when(k == 3, "workaround for ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, "text").alias("d"))


MEMORY_QUERY = "what of the timeout error in ther reed"
MEMORY_TOKENS = ["what", "timeout", "error", "ther", "reed"]
_LONG = MEMORY_QUERY.split()
MEMORY_PHRASES = [" ".join(_LONG[i : i + n]) for n in range(4, 8) for i in range(len(_LONG) - n + 1)]


def ranked_sql(rows: str, scale: str = "1.0") -> str:
    """The ranking of rows (id, d, base, type) for MEMORY_QUERY, which names no file, identifier or rule and is technical: the
    words that a text has, its phrases, its type and its length decide."""
    topic = " + ".join(rf"CASE WHEN regexp_matches(low, '(^|[^a-z0-9_.]){t}(s|es)?($|[^a-z0-9_.])') THEN 1 ELSE 0 END" for t in MEMORY_TOKENS)
    semantic = " + ".join(f"CASE WHEN contains(low, '{t}') THEN 1 ELSE 0 END" for t in MEMORY_TOKENS)
    phrase = " OR ".join(f"contains(pad, ' {p} ')" for p in MEMORY_PHRASES)
    return rf"""
rk0 AS (SELECT *, lower(d) AS low, ' ' || array_to_string(regexp_extract_all(lower(d), '[\p{{L}}\p{{N}}_]+'), ' ') || ' ' AS pad FROM {rows}),
rk1 AS (SELECT *, {topic} AS topic, {semantic} AS sem, {phrase} AS ph, regexp_matches(d, '(?i)\bwe decided to\b') AS dec FROM rk0),
rk2 AS (SELECT *, ph OR sem >= 2 AS eligible, length(d) > 1500 AND NOT ph AS large FROM rk1),
rk3 AS (SELECT *, CASE WHEN ph THEN 8.0::DOUBLE ELSE 0 END + CASE WHEN eligible THEN CASE type WHEN 'decision' THEN 4.0 WHEN 'failure' THEN 5.0 WHEN 'outcome' THEN 3.0 ELSE 0 END ELSE 0 END + least(2.0, 0.5 * topic)
  + CASE type WHEN 'workaround' THEN 5.0 WHEN 'technical_handoff' THEN 5.0 WHEN 'debug_note' THEN 4.0 ELSE 0 END + CASE WHEN dec THEN 5.0 ELSE 0 END AS boost, CASE WHEN large THEN 3.0::DOUBLE ELSE 0 END AS penalty FROM rk2),
rk AS (SELECT *, (base + boost - penalty) * {scale} AS final FROM rk3),
best AS (SELECT * FROM rk WHERE final > 0 AND (eligible OR type NOT IN ('decision', 'failure', 'outcome')))
"""


RANK_ORDER = "final DESC, base DESC, type NOT IN ('decision', 'failure'), ph, id"


@query(
    rf"""WITH m AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'Decision: ' WHEN 1 THEN '## Failure' || chr(10) WHEN 2 THEN '**Outcome**: ' WHEN 3 THEN 'workaround for ' ELSE '' END || text AS d, (doc_id % 7) / 10.0::DOUBLE AS base,
  CASE doc_id % 4 WHEN 0 THEN 1.3::DOUBLE WHEN 1 THEN 1.1 WHEN 2 THEN 0.9 ELSE 0.7 END AS st, doc_id % 5 + 1 AS c, doc_id % 300 AS e FROM documents),
k AS (SELECT *, {TYPE_SQL} AS type FROM m), {ranked_sql("k", "CASE WHEN e > 100 THEN greatest(0.3::DOUBLE, 1 - (e - 100) / 500.0::DOUBLE) ELSE 1.0 END * st * (0.5::DOUBLE + c / 10.0::DOUBLE)")}
SELECT id AS doc_id, type AS memory_type, round(boost, 6) AS boosts, round(penalty, 6) AS penalties, round(final, 6) AS final_score FROM best ORDER BY {RANK_ORDER} LIMIT 50"""
)
def memory_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, ranked for a technical query: type, boosts, penalties, scaled score; the first 50."""
    k = F.col("id")
    status = F.element_at(F.array(*map(F.lit, ["canonical", "validated", "emerging", "candidate"])), (k % 4 + 1).cast("int"))
    docs = _labelled(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("d").alias("document"), (F.col("doc_id") % 7 / 10).alias("base")).withColumns({"status": status, "confidence": k % 5 + 1, "evidence": k % 300})
    total = lambda m: F.round(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x), 6)
    found = M.search(docs, MEMORY_QUERY, 50)
    return found.select(F.col("id").alias("doc_id"), "memory_type", total("boosts").alias("boosts"), total("penalties").alias("penalties"), F.round("final_score", 6).alias("final_score"))


# The paths of pages as files: folders and endings by the words of the url.
PATH = r"^[a-z]+://[^/]*/([^?#]*)"
PATHS_SQL = r"""pg AS (SELECT page_id, html, regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) AS p FROM pages),
fl AS (SELECT page_id, html, CASE page_id % 11 WHEN 0 THEN 'docs/' || p || '.md' WHEN 1 THEN 'src/services/' || p || '.py' WHEN 2 THEN 'src/adapter_' || p || '.ts' WHEN 3 THEN 'tests/' || p || '.py' WHEN 4 THEN 'conf/' || p || '.toml' WHEN 5 THEN 'build/' || p || '.js' WHEN 6 THEN p || '/README.md' WHEN 7 THEN p || '/AGENTS.md' WHEN 8 THEN 'src/' || p || '/client.go' WHEN 9 THEN 'data/' || p || '.bin' ELSE 'src/' || p || '/main.rs' END AS rel_path FROM pg)"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as source files (page_id, rel_path, html); PATHS_SQL."""
    p, k = F.regexp_extract("url", PATH, 1), F.col("page_id") % 11
    forms = [("docs/", ".md"), ("src/services/", ".py"), ("src/adapter_", ".ts"), ("tests/", ".py"), ("conf/", ".toml"), ("build/", ".js"), ("", "/README.md"), ("", "/AGENTS.md"), ("src/", "/client.go"), ("data/", ".bin")]
    path = F.concat(F.lit("src/"), p, F.lit("/main.rs"))
    for i, (lead, end) in enumerate(forms):
        path = F.when(k == i, F.concat(F.lit(lead), p, F.lit(end))).otherwise(path)
    return table(spark, sf_dir, "pages").select("page_id", path.alias("rel_path"), "html")


@query(
    rf"""WITH {PATHS_SQL}, l AS (SELECT page_id, lower(rel_path) AS p, parse_filename(lower(rel_path)) AS f, regexp_extract(parse_filename(lower(rel_path)), '.(\.[^.]*)$', 1) AS e, regexp_matches(lower(html), '(^|[^\w.])ther([^\w]|$)') AS idn FROM fl)
SELECT CASE WHEN regexp_matches(p, '(generated|cache|__pycache__|build|dist|\.obsidian)/') THEN 'generated_or_cache'
  WHEN f IN ('agents.md', 'claude.md') OR regexp_matches(p, '(^|/)\.agents/') THEN 'agent_instruction' WHEN f LIKE 'readme.%' THEN 'readme_doc' WHEN regexp_matches(p, '(^|/)docs/') THEN 'project_doc'
  WHEN e IN ('.json', '.yaml', '.yml', '.toml', '.ini', '.cfg', '.conf') THEN 'config_file'
  WHEN e IN ('.py', '.ts', '.js', '.tsx', '.jsx', '.rs', '.go', '.java', '.kt') THEN CASE
    WHEN regexp_matches(p, '(^|/)tests/') OR starts_with(f, 'test_') OR regexp_matches(f, '_test\.(py|ts|js|tsx)$') THEN CASE WHEN idn THEN 'relevant_test' ELSE 'unrelated_test' END
    WHEN regexp_matches(p, '(^|/)adapter') THEN 'adapter_code' WHEN regexp_matches(p, '(^|/)service') THEN 'service_code' WHEN regexp_matches(p, '(^|/)client') THEN 'client_code' ELSE 'implementation_code' END
  ELSE 'unknown' END AS type, count(*) AS n, CAST(sum(length(p)) AS BIGINT) AS chars FROM l GROUP BY 1"""
)
def source_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files are by their paths."""
    kind = S.source_type(F.col("rel_path"), S.has_identifier(F.col("html"), "ther"))
    return page_files(spark, sf_dir).groupBy(kind.alias("type")).agg(F.count("*").alias("n"), F.sum(F.length("rel_path")).cast("long").alias("chars"))


@query()
def source_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that passes the gate, with its type and score, for a query
    that names two words and asks to fix a service."""
    intent = S.Intent.of("fix the service for tion erheit")
    files = page_files(spark, sf_dir).select(F.col("page_id").alias("chunk_id"), "rel_path", F.col("html").alias("document"))
    words = F.regexp_extract_all(F.lower("document"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    base = sum((F.when(F.array_contains(words, w), 0.25).otherwise(0.0) for w in intent.domain), F.lit(0.0))
    ranked = S.gate(S.rank_sources(files.withColumn("base", base), intent), intent)
    return ranked.select(F.col("chunk_id").alias("page_id"), F.col("source_type").alias("type"), "score")


@query(
    f"""WITH {TASKS_SQL}, d AS (SELECT p_partkey AS id, p_name AS title, CASE p_partkey % 3 WHEN 0 THEN 'workflow for the ' || p_name ELSE 'keep it' END AS rule, CASE WHEN p_partkey % 50 = 0 THEN 'global' ELSE 'shop' END AS scope, CASE WHEN p_partkey % 2 = 0 THEN 'critical' ELSE 'normal' END AS priority FROM part)
SELECT task, id FROM tk, d WHERE scope = 'global' OR contains(task, title) OR (p3 AND contains(task, 'workflow'))""".replace("SELECT task, id FROM tk, d", "SELECT task, id FROM tk, (SELECT *, id % 3 = 0 AS p3, string_split(title, ' ') AS w FROM d) d").replace("OR contains(task, title)", "OR (len(list_filter(w, lambda x: list_contains(string_split(task, ' '), x) AND x <> 'review')) >= 2)")
)
def directive_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which directives match each task."""
    return _directives(spark, sf_dir).select("task", "id")


def _directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as directives, for each task."""
    k = F.col("p_partkey")
    d = table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.col("p_name").alias("title"),
        F.when(k % 3 == 0, F.concat(F.lit("workflow for the "), "p_name")).otherwise("keep it").alias("rule"),
        F.when(k % 50 == 0, "global").otherwise("shop").alias("scope"),
        F.when(k % 2 == 0, "critical").otherwise("normal").alias("priority"),
        F.split("p_name", " ").alias("triggers"),
        F.lit(False).alias("always_on"),
    )
    # a small file is read by few tasks, and the work is in the rows: they are dealt over all cores
    return R.match_directives(d.repartition(4 * spark.sparkContext.defaultParallelism), TASKS)


@query()
def directive_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and classes."""
    return _directives(spark, sf_dir)


@query(
    f"""WITH {EVENTS_SQL}, l AS (SELECT user_id, CASE event_type WHEN 'failure' THEN 3 WHEN 'decision' THEN 3 WHEN 'validation' THEN 2 ELSE 1 END AS lv, CASE source WHEN 'chat' THEN 1.0 WHEN 'diff' THEN 2.0 ELSE 0.0 END AS sg FROM ev)
SELECT user_id, CASE max(lv) WHEN 3 THEN 'strong' WHEN 2 THEN 'medium' ELSE 'weak' END AS max_level, CAST(sum(CASE WHEN lv = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_strong, CAST(sum(CASE WHEN lv = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_medium, round(least(sum(sg), 10.0), 6) AS score FROM l GROUP BY user_id"""
)
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, A17, A18"""
    lv = F.when(F.col("event_type").isin("failure", "decision"), 3).when(F.col("event_type") == "validation", 2).otherwise(1)
    sg = F.when(F.col("source") == "chat", 1.0).when(F.col("source") == "diff", 2.0).otherwise(0.0)
    g = event_ledger(spark, sf_dir).groupBy("user_id").agg(F.max(lv).alias("m"), F.count_if(lv == 3).alias("n_strong"), F.count_if(lv == 2).alias("n_medium"), F.round(F.least(F.sum(sg), F.lit(10.0)), 6).alias("score"))
    return g.select("user_id", F.when(F.col("m") == 3, "strong").when(F.col("m") == 2, "medium").otherwise("weak").alias("max_level"), "n_strong", "n_medium", "score")


@query(
    """WITH f AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'a/../b.py' WHEN 1 THEN 'conf/.env' WHEN 2 THEN 'x/node_modules/y.js' WHEN 3 THEN 'out/gen/a.txt' WHEN 4 THEN 'web/yarn.lock' WHEN 5 THEN 'src/m.py' WHEN 6 THEN 'tmp_a.bak' ELSE 'src/n.py' END AS p, length(html) AS n, page_id % 16 = 7 AS bin FROM pages)
SELECT coalesce(CASE page_id % 8 WHEN 0 THEN 'path_traversal' WHEN 1 THEN 'mandatory' WHEN 2 THEN 'excluded_dir' WHEN 3 THEN 'ignore_file' WHEN 6 THEN 'ignore_file' WHEN 4 THEN 'lockfile' ELSE CASE WHEN n > 4000 THEN 'too_large' WHEN bin THEN 'binary' END END, 'indexed') AS reason, count(*) AS n, CAST(sum(greatest(1, ceil(n / 4.0))) AS BIGINT) AS est_tokens FROM f GROUP BY 1"""
)
def file_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10, P13, F21, A7"""
    k = F.col("page_id") % 8
    names = ["a/../b.py", "conf/.env", "x/node_modules/y.js", "out/gen/a.txt", "web/yarn.lock", "src/m.py", "tmp_a.bak", "src/n.py"]
    path = F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    n = F.length("html")
    reason = R.exclusion(path, n, F.col("page_id") % 16 == 7, ["out/**", "*.bak"], 4000)
    return table(spark, sf_dir, "pages").select(F.coalesce(reason, F.lit("indexed")).alias("reason"), F.greatest(F.lit(1), F.ceil(n / 4)).alias("t")).groupBy("reason").agg(F.count("*").alias("n"), F.sum("t").cast("long").alias("est_tokens"))


@query(
    """WITH v AS (SELECT c_nationkey AS field, 'customer' AS source, c_mktsegment AS value, 3 AS conf, c_custkey AS o FROM customer UNION ALL SELECT s_nationkey, 'supplier', 'S' || CAST(s_suppkey % 3 AS VARCHAR), 4, s_suppkey FROM supplier UNION ALL SELECT n_nationkey, 'nation', n_name, 2, n_nationkey FROM nation),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY conf DESC, source, o) AS r FROM v), c AS (SELECT field, CAST(count(DISTINCT value) AS BIGINT) AS n_values FROM v GROUP BY field)
SELECT field, value, source, n_values, CASE WHEN n_values >= 3 THEN 'error' WHEN n_values = 2 THEN 'warn' ELSE 'ok' END AS conflict FROM r JOIN c USING (field) WHERE r = 1"""
)
def active_work_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of several sources for each field; the most confident wins."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("field"), F.lit("customer").alias("source"), F.col("c_mktsegment").alias("value"), F.lit(3).alias("conf"), F.col("c_custkey").alias("o"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("field"), F.lit("supplier").alias("source"), F.concat(F.lit("S"), (F.col("s_suppkey") % 3).cast("string")).alias("value"), F.lit(4).alias("conf"), F.col("s_suppkey").alias("o"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("field"), F.lit("nation").alias("source"), F.col("n_name").alias("value"), F.lit(2).alias("conf"), F.col("n_nationkey").cast("long").alias("o"))
    best = F.min(F.struct((-F.col("conf")).alias("k"), "source", "o", "value"))
    g = c.unionByName(s).unionByName(n).groupBy("field").agg(best.alias("b"), F.count_distinct("value").alias("n_values"))
    return g.select("field", "b.value", "b.source", "n_values", F.when(F.col("n_values") >= 3, "error").when(F.col("n_values") == 2, "warn").otherwise("ok").alias("conflict"))
