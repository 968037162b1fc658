"""Queries over tables with a history, spliced documents, ignore rules, intervals of means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, ignore, related
from ..sources.history import History
from ..sources.scratch import fresh
from ..sources.tables import table
from .registry import query
from .retrieval import EVAL_SQL, evaluated

ROUNDS = [0, 2, 4]  # conversations as they stand after these turns, and at the end
ROUNDS_SQL = """
r AS (SELECT unnest([1, 2, 3, 4]) AS v, unnest([0, 2, 4, 1000000]) AS upto),
st AS (SELECT v, conv_id, count(*) AS n_turns, arg_max(role, turn) AS last_role, sum(length(text)) AS n_chars FROM conversations JOIN r ON turn <= upto WHERE NOT (v = 4 AND conv_id % 9 = 0) GROUP BY ALL),
ch AS (SELECT *, lag(n_turns) OVER (PARTITION BY conv_id ORDER BY v) AS before FROM st),
moved AS (SELECT v, conv_id, n_turns, last_role, n_chars, false AS gone FROM ch WHERE before IS NULL OR before <> n_turns
  UNION ALL SELECT 4, conv_id, n_turns, last_role, n_chars, true FROM st WHERE v = 3 AND conv_id % 9 = 0),
iv AS (SELECT *, lead(v) OVER (PARTITION BY conv_id ORDER BY v) AS valid_to FROM moved)
"""


def conversation_history(spark: SparkSession, sf_dir: str) -> History:
    """The state of each conversation, saved four times; at the last time each ninth has gone."""
    turns = table(spark, sf_dir, "conversations")
    last = None
    for version, upto in enumerate([*ROUNDS, 1_000_000], 1):
        seen = turns.where(F.col("turn") <= upto)
        if version == 4:
            seen = seen.where("conv_id % 9 != 0")
        state = seen.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text")).alias("n_chars"), F.lit(f"round {version}").alias("updated_at"))
        if last is None:
            last = History(spark, fresh(spark, "history"), state.schema, ["conv_id"])
        last.save(state, f"2024-01-0{version}")
        if version == 2:
            last.checkpoint("second", "two rounds are in")
    return last


@query(f"WITH {ROUNDS_SQL} SELECT conv_id, n_turns, last_role, n_chars::BIGINT AS n_chars, v::BIGINT AS valid_from, coalesce(valid_to, 0)::BIGINT AS valid_to FROM iv WHERE NOT gone")
def working_set_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which to which version (0: still) each state of a conversation held; only changed rows were written."""
    return conversation_history(spark, sf_dir).intervals().select("conv_id", "n_turns", "last_role", "n_chars", "valid_from", F.coalesce("valid_to", F.lit(0)).alias("valid_to"))


@query(f"WITH {ROUNDS_SQL} SELECT 'third' AS read, conv_id, n_turns, last_role FROM st WHERE v = 3 UNION ALL SELECT 'restored', conv_id, n_turns, last_role FROM st WHERE v = 2 UNION ALL SELECT 'first day', conv_id, n_turns, last_role FROM st WHERE v = 1")
def working_set_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads as of a version and of a time, and a checkpoint that is restored after compaction."""
    h = conversation_history(spark, sf_dir)
    third, first = h.as_of(3), h.as_of(at="2024-01-01")
    h.restore("second", "2024-01-05")
    rows = [(name, d.select("conv_id", "n_turns", "last_role")) for name, d in (("third", third), ("restored", h.as_of()), ("first day", first))]
    return rows[0][1].withColumn("read", F.lit("third")).unionByName(rows[1][1].withColumn("read", F.lit("restored"))).unionByName(rows[2][1].withColumn("read", F.lit("first day")))


# Parts as concept documents: each links to others, some with a relation, some have a section already.
NOTES_SQL = r"""
n AS (SELECT p_partkey AS k, printf('concept_%03d', p_partkey) AS id, p_name AS name, (SELECT count(*) FROM part) AS m FROM part),
t AS (SELECT k, id, name, (k * 7 + 3) % m AS a, (k * 5 + 1) % m AS b, m FROM n),
notes AS (SELECT k, id, name, printf('concept_%03d', a) AS a, printf('concept_%03d', b) AS b, k % 4 AS kind,
  CASE k % 4 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'implements' WHEN 2 THEN 'relates_to' ELSE 'supersedes' END AS ta, k % 3 = 0 AS sectioned, k % 11 = 10 AS bare FROM t)
"""
REVERSE_SQL = "CASE {} WHEN 'depends_on' THEN 'depended_on_by' WHEN 'implements' THEN 'implemented_by' WHEN 'supersedes' THEN 'superseded_by' WHEN 'mitigates' THEN 'mitigated_by' ELSE 'relates_to' END"
HEAD_SQL = "CASE WHEN bare THEN '' ELSE '---' || chr(10) || 'id: ' || id || chr(10) || '---' || chr(10) END || 'About ' || name || ', see [[' || CASE kind WHEN 2 THEN '' ELSE ta || ':' END || a || ']].'"
LABEL_SQL = "array_to_string(list_transform(string_split(replace(replace({0}, '-', ' '), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def concept_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    m = p.agg(F.count("*").alias("m"))
    k = F.col("p_partkey")
    named = lambda c: F.concat(F.lit("concept_"), F.when(F.length(c.cast("string")) < 3, F.lpad(c.cast("string"), 3, "0")).otherwise(c.cast("string")))
    kind = F.element_at(F.array(*map(F.lit, ["depends_on:", "implements:", "", "supersedes:"])), (k % 4 + 1).cast("int"))
    rows = p.crossJoin(F.broadcast(m)).select(named(k).alias("id"), F.col("p_name").alias("name"), named((k * 7 + 3) % F.col("m")).alias("a"), named((k * 5 + 1) % F.col("m")).alias("b"), kind.alias("kind"), (k % 3 == 0).alias("sectioned"), (k % 11 == 10).alias("bare"))
    head = F.when(F.col("bare"), F.lit("")).otherwise(F.concat(F.lit("---\nid: "), "id", F.lit("\n---\n")))
    text = F.concat(head, F.lit("About "), "name", F.lit(", see [["), "kind", "a", F.lit("]]."))
    old = F.when(F.col("sectioned"), F.concat(F.lit("\n\n## Related notes\n- [[mitigates:"), "b", F.lit("|old]]\n\n## Sources\nkept as it is\n"))).otherwise(F.lit(""))
    return rows.select("id", "name", F.concat(text, old).alias("text"))


@query(
    rf"""WITH {NOTES_SQL},
stated AS (SELECT id AS src, a AS dst, ta AS type, 3 AS p FROM notes UNION ALL SELECT id, b, 'mitigates', 2 FROM notes WHERE sectioned),
own AS (SELECT src, dst, arg_max(type, p) AS type FROM stated GROUP BY ALL),
every AS (SELECT src, dst, type, 1 AS p FROM own UNION ALL SELECT dst, src, {REVERSE_SQL.format("type")}, 0 FROM own),
rel AS (SELECT src, dst, max(struct_pack(p := p, t := type)).t AS type FROM every GROUP BY src, dst),
lines AS (SELECT src, count(*) AS n_links, string_agg('- [[' || type || ':' || dst || '|' || {LABEL_SQL.format("d.name")} || ']] — ' || {LABEL_SQL.format("d.name")} || ' (' || {LABEL_SQL.format("type")} || ')', chr(10) ORDER BY dst) AS l
  FROM rel JOIN notes d ON d.id = rel.dst GROUP BY src)
SELECT id, n_links, md5(CASE WHEN bare THEN {HEAD_SQL} || CASE WHEN sectioned THEN chr(10) || chr(10) || '## Related notes' || chr(10) || '- [[mitigates:' || b || '|old]]' || chr(10) || chr(10) || '## Sources' || chr(10) || 'kept as it is' || chr(10) ELSE '' END
  ELSE {HEAD_SQL} || chr(10) || chr(10) || '## Related Knowledge' || chr(10) || l || chr(10) || CASE WHEN sectioned THEN chr(10) || '## Sources' || chr(10) || 'kept as it is' || chr(10) ELSE '' END END) AS digest
FROM notes LEFT JOIN lines ON src = id"""
)
def related_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their section of related ones, put in twice."""
    notes = concept_notes(spark, sf_dir)
    once, _ = related.splice(notes)
    aside = fresh(spark, "spliced")
    once.join(notes.select("id", "name"), "id").select("id", "name", "text").write.parquet(aside)
    twice, edges = related.splice(spark.read.parquet(aside))
    n = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_links"))
    return twice.join(n, "id", "left").select("id", "n_links", F.md5("text").alias("digest"))


CHANCES = ", ".join(map(repr, evaluation.POISSON))


@query(
    f"""WITH {EVAL_SQL}, x AS (SELECT item_id, hit_at_5, reciprocal_rank FROM ev), v AS (SELECT 'hit_at_5' AS metric, item_id, hit_at_5::DOUBLE AS value FROM x UNION ALL SELECT 'reciprocal_rank', item_id, reciprocal_rank FROM x),
w AS (SELECT metric, rep, value, CAST('0x' || substr(md5('1729:' || item_id || ':' || rep), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM v CROSS JOIN (SELECT unnest(range(0, 2000)) AS rep)),
m AS (SELECT metric, rep, sum(value * k) / sum(k) AS mean FROM (SELECT *, len(list_filter([{CHANCES}], lambda p: u >= p)) AS k FROM w) GROUP BY ALL HAVING sum(k) > 0),
o AS (SELECT metric, mean, row_number() OVER (PARTITION BY metric ORDER BY mean) - 1 AS i, count(*) OVER (PARTITION BY metric) AS c FROM m)
SELECT v.metric, count(*) AS n, round(avg(value), 6) AS mean, round((SELECT max(mean) FROM o WHERE o.metric = v.metric AND i = floor(0.025 * c)), 6) AS low, round((SELECT max(mean) FROM o WHERE o.metric = v.metric AND i = greatest(floor(0.025 * c), floor(0.975 * c) - 1)), 6) AS high FROM v GROUP BY v.metric"""
)
def retrieval_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rates of the retrieval test with their 95 % intervals over 2,000 resamples."""
    e = evaluated(spark, sf_dir)
    metric = F.explode(F.create_map(F.lit("hit_at_5"), F.col("hit_at_5").cast("double"), F.lit("reciprocal_rank"), F.col("reciprocal_rank"))).alias("metric", "value")
    out = evaluation.interval(e.select(F.col("item_id").alias("id"), metric), ["metric"])
    return out.select("metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


# Ignore files of three folders. Their SQL twin has its own patterns, by folder and line.
RULES = [("", "*.tmp\n/en/1*\n!/en/12*\nde/\n# a comment\n\nfr/**/deep?.txt\nes/[3-5]*/\n"), ("en", "*7*\n!*77*\n2*/\n!2*/keep\n"), ("en/12", "*\n!notes.md\n")]
RULES_SQL = r"""
rules(folder, line, pattern, neg, dir) AS (VALUES ('', 0, '^(.*/)?[^/]*\.tmp$', false, false), ('', 1, '^en/1[^/]*$', false, false), ('', 2, '^en/12[^/]*$', true, false), ('', 3, '^(.*/)?de$', false, true),
  ('', 6, '^fr/([^/]+/)*deep[^/]\.txt$', false, false), ('', 7, '^es/[3-5][^/]*$', false, true), ('en', 0, '^(.*/)?[^/]*7[^/]*$', false, false), ('en', 1, '^(.*/)?[^/]*77[^/]*$', true, false), ('en', 2, '^(.*/)?2[^/]*$', false, true),
  ('en', 3, '^2[^/]*/keep$', true, false), ('en/12', 0, '^(.*/)?[^/]*$', false, false), ('en/12', 1, '^(.*/)?notes\.md$', true, false)),
u AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS p FROM pages),
f AS (SELECT DISTINCT rtrim(p, '/') || CASE page_id % 6 WHEN 0 THEN '/notes.md' WHEN 1 THEN '/keep' WHEN 2 THEN '/x.tmp' WHEN 3 THEN '/deep1.txt' WHEN 4 THEN '/a/deep2.txt' ELSE '/pic.PNG' END AS path FROM u
  UNION SELECT unnest(['../up.md', '/abs.md', 'en/12/notes.md', 'en/12/other.md', 'en/123', 'node_modules/a.js', 'en/.env', 'en/9/run.log', 'fr/deep3.txt', 'de', 'other/readme.md', 'es/31/x.md', 'es/6/x.md'])),
parts AS (SELECT path, string_split(path, '/') AS s FROM f),
pre AS (SELECT path, array_to_string(s[1 : i], '/') AS name, i < len(s) AS is_dir, i, s FROM (SELECT path, s, unnest(range(1, len(s) + 1)) AS i FROM parts)),
anc AS (SELECT path, name, is_dir, unnest(range(0, i)) AS d, s FROM pre),
hit AS (SELECT path, name, is_dir, d, line, neg FROM anc JOIN rules ON folder = array_to_string(s[1 : d], '/') AND (NOT dir OR is_dir) AND regexp_matches(CASE WHEN folder = '' THEN name ELSE substr(name, length(folder) + 2) END, pattern)),
last AS (SELECT path, name, arg_max(neg, d * 1000 + line) AS neg FROM hit GROUP BY path, name),
ign AS (SELECT DISTINCT path FROM last WHERE NOT neg)
"""
EXTRA = ["../up.md", "/abs.md", "en/12/notes.md", "en/12/other.md", "en/123", "node_modules/a.js", "en/.env", "en/9/run.log", "fr/deep3.txt", "de", "other/readme.md", "es/31/x.md", "es/6/x.md"]


@query(
    f"""WITH {RULES_SQL} SELECT path, CASE WHEN path LIKE '/%' OR list_contains(string_split(path, '/'), '..') THEN 'outside_project' WHEN list_contains(string_split(path, '/'), 'node_modules') THEN 'mandatory_excluded_directory'
WHEN path LIKE '%/.env' THEN 'secret_env_file' WHEN path LIKE '%.log' THEN 'log_file' WHEN path LIKE '%.PNG' THEN 'unsupported_binary_or_media' WHEN NOT regexp_matches(path, '^(en|fr|de|es)/|^de$') THEN 'not_included' WHEN path IN (SELECT path FROM ign) THEN 'ignore_file' END AS reason FROM f"""
)
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why paths below the pages' folders are left out, by rule files of three folders, mandatory
    exclusions and an include list; null for those that are indexed."""
    p = F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)
    names = F.array(*map(F.lit, ["/notes.md", "/keep", "/x.tmp", "/deep1.txt", "/a/deep2.txt", "/pic.PNG"]))
    paths = table(spark, sf_dir, "pages").select(F.concat(F.rtrim(p, F.lit("/")), F.element_at(names, (F.col("page_id") % 6 + 1).cast("int"))).alias("path"))
    paths = paths.unionByName(spark.createDataFrame([(x,) for x in EXTRA], "path string"))
    return ignore.eligible(paths, spark.createDataFrame(RULES, "folder string, content string"), ["en/**", "fr/**", "de", "de/**", "es/**"])
