"""The registry of concepts: staleness, materialisation, cleaning and recovery (W2, A10, L4,
L10, L11, L13, L14, L16, L19 to L21, L25, J12, J16, J23, P14, P15, P24, P27, S15, S30, F46)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import front_matter, slug
from . import lifecycle as L

# Names that belong to the system, and marks of its own output.
SYSTEM_SLUGS = ["index", "log", "inbox", "schema", "purpose", "triggers", "runtime-events", "outcomes", "session-report"]
REPORT_MARK = "session learning report"


def _empty(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def staleness(concepts: DataFrame, sessions: DataFrame, n_sessions: int = 5, tracking_since: float = 0.0, active_session: str | None = None) -> DataFrame:
    """(concept, status, confidence, sessions_since) of concepts (concept, created_at,
    last_session, last_at, last_source, sessions) whose reference is old, lost or was never there.

    sessions (session_id, idx) are the completed ones in order, from 0. Below n_sessions of
    them nothing is stale. Without any trace of a reference it is the time of creation that
    says why: before tracking, after it, or unknown.
    """
    total = sessions.agg(F.count("*").alias("_n"))
    known = sessions.select("session_id", "idx")
    legacy = concepts.select("concept", F.posexplode("sessions").alias("_at", "session_id")).join(known, "session_id")
    legacy = legacy.groupBy("concept").agg(F.max_by("idx", "_at").alias("_legacy"))
    last = known.select(F.col("session_id").alias("last_session"), F.col("idx").alias("_idx"))
    j = concepts.join(last, "last_session", "left").join(legacy, "concept", "left").crossJoin(F.broadcast(total))
    bare = _empty("last_session") & _empty("last_at") & (_empty("last_source") | (F.col("last_source") == "unknown")) & (F.coalesce(F.size("sessions"), F.lit(0)) <= 0)
    at = F.coalesce("_idx", "_legacy")
    fresh = (F.col("_n") < n_sessions) | (at >= F.col("_n") - n_sessions)
    status = (
        F.when(bare & F.col("created_at").isNull(), "reference_metadata_missing")
        .when(bare & (F.col("created_at") < tracking_since), "legacy_no_reference_metadata")
        .when(bare, "never_referenced_since_tracking_enabled")
        .when(~_empty("last_session") & (F.col("last_session") == F.lit(active_session or "")), None)
        .when(at.isNotNull() & fresh, None)
        .when(at.isNotNull(), "stale")
        .otherwise("reference_session_missing")
    )
    sure = F.when(F.col("status") != "stale", "unknown").when(F.col("_idx").isNotNull(), "high").otherwise("legacy")
    return j.withColumn("status", status).where("status IS NOT NULL").select("concept", "status", sure.alias("confidence"), F.when(F.col("status") == "stale", F.col("_n") - at - 1).alias("sessions_since"))


def suspicious(name: Column) -> Column:
    """A name that belongs to the system, or is only a number of a concept."""
    s = slug(name)
    return s.isin(SYSTEM_SLUGS) | s.rlike(r"^concept-\d+$")


def self_ingested(*fields: Column, tool: str = "kb") -> Column:
    """Whether any field shows that a row is the tool's own output."""
    marks = [REPORT_MARK, f"generated_by: {tool}", f".{tool}/"]
    return F.exists(F.array(*[F.lower(F.coalesce(f.cast("string"), F.lit(""))) for f in fields]), lambda x: F.exists(F.array(*map(F.lit, marks)), lambda m: x.contains(m)))


def concept_text(name: Column, title: Column, ident: Column) -> Column:
    """what a concept is called: its name, else its title, else its id."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(title), F.lit("")), ident)


def wiki_documents(files: DataFrame) -> DataFrame:
    """(concept_id, name, ambiguous, document) of wiki files (path, document): the name
    from the front matter, else from the first heading, else from the file, which is ambiguous."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    meta = front_matter(F.col("document"))
    given = F.coalesce(F.nullif(F.trim(F.try_element_at(meta, F.lit("canonical_name"))), F.lit("")), F.nullif(F.trim(F.try_element_at(meta, F.lit("title"))), F.lit("")))
    heading = F.nullif(F.trim(F.regexp_extract("document", r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return files.where(F.col("path").endswith(".md")).select(stem.alias("concept_id"), F.coalesce(given, heading, stem).alias("name"), (given.isNull() & heading.isNull()).alias("ambiguous"), "document")


def drift(registry: DataFrame, wiki: DataFrame, events: DataFrame) -> DataFrame:
    """(code, key) of what the registry (concept_id, canonical_name,
    source_event_ids), the wiki (as ``wiki_documents``) and the events (event_id, concept) do
    not have in common: orphans, missing files, gaps in ids, names that several concepts have,
    and events that no concept has taken up."""
    orphan = wiki.join(registry.select("concept_id"), "concept_id", "left_anti").select(F.when(F.col("ambiguous"), "AMBIGUOUS_ORPHAN").otherwise("ORPHAN_WIKI_CONCEPT").alias("code"), F.col("concept_id").alias("key"))
    missing = registry.where("concept_id LIKE 'concept%'").join(wiki.select("concept_id"), "concept_id", "left_anti").select(F.lit("MISSING_WIKI_FILE").alias("code"), F.col("concept_id").alias("key"))
    number = registry.select(F.regexp_extract("concept_id", r"^concept_(\d+)$", 1).try_cast("long").alias("n")).where("n IS NOT NULL").distinct()
    before = number.withColumn("_p", F.coalesce(F.lag("n").over(Window.orderBy("n")), F.lit(0)))  # one number per concept
    gap = before.where("n > _p + 1").select(F.explode(F.sequence(F.col("_p") + 1, F.col("n") - 1)).alias("m")).select(F.lit("ID_GAP").alias("code"), F.format_string("concept_%03d", "m").alias("key"))
    twice = registry.groupBy(F.lower(F.trim("canonical_name")).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("DUPLICATE_NAME").alias("code"), "key")
    taken = registry.select(F.explode("source_event_ids").alias("event_id")).distinct()
    loose = events.where("concept IS NOT NULL").join(taken, "event_id", "left_anti").select(F.lit("UNMATERIALIZED_EVENT").alias("code"), F.col("event_id").alias("key"))
    return orphan.unionByName(missing).unionByName(gap).unionByName(twice).unionByName(loose)


def clean(registry: DataFrame, events: DataFrame) -> DataFrame:
    """L19, D-2, P14, P15: findings (code, key, safe) over the registry (concept_id,
    canonical_name) and events (event_id, seq, body, summary, source): system names, repeated
    bodies (all but the first), and the tool's own output. Safe ones can be repaired."""
    names = registry.where(suspicious(F.col("canonical_name"))).select(F.lit("suspicious_concept").alias("code"), F.col("concept_id").cast("string").alias("key"), F.lit(False).alias("safe"))
    first = events.groupBy(F.sha2("body", 256).alias("_h")).agg(F.min("seq").alias("_f"))
    again = events.withColumn("_h", F.sha2("body", 256)).join(first, "_h").where("seq > _f").select(F.lit("duplicate_event").alias("code"), F.col("event_id").alias("key"), F.lit(True).alias("safe"))
    own = events.where(self_ingested(F.col("summary"), F.col("source"))).select(F.lit("self_ingestion").alias("code"), F.col("event_id").alias("key"), F.lit(True).alias("safe"))
    return names.unionByName(again).unionByName(own)


def repaired(events: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go with the code): the audit of a repair."""
    bad = findings.where("safe").select(F.col("key").alias("event_id"), "code").groupBy("event_id").agg(F.min("code").alias("code"))
    return events.join(bad, "event_id", "left_anti").select(events.columns), events.join(bad, "event_id")


def guard(names: list[str], allowed_root: str, forbidden: tuple[str, ...] = (".git", ".env")) -> None:
    """Raises if a change would touch something outside the root or a forbidden name."""
    for n in names:
        parts = n.split("/")
        if not n.startswith(allowed_root.rstrip("/") + "/") or ".." in parts or any(p in forbidden for p in parts):
            raise PermissionError(n)


def materialize(registry: DataFrame, events: DataFrame, noise: Column, processed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(concepts after their new events, flagged names). New are the events (seq,
    event_id, session_id, concept, event_type, evidence, summary, source) that no concept has
    taken up, of sessions not in ``processed``, neither noise nor the tool's own output. Each
    concept goes on from its state in the registry (concept, status, confidence, failures,
    evidence, sessions, source_event_ids)."""
    known = registry.select(F.explode("source_event_ids").alias("event_id")).distinct()
    fresh = events.where(F.col("concept").isNotNull() & ~F.coalesce(noise, F.lit(False)) & ~self_ingested(F.col("summary"), F.col("source"))).join(known, "event_id", "left_anti")
    if processed is not None:
        fresh = fresh.join(processed.select("session_id").distinct(), "session_id", "left_anti")
    had = registry.select("concept", F.explode("sessions").alias("session_id")).distinct().withColumn("_had", F.lit(True))
    firsts = L.first_of_sessions(fresh).join(had, ["concept", "session_id"], "left").withColumn("new", F.col("new") & F.col("_had").isNull())
    ids = fresh.groupBy("concept").agg(F.sort_array(F.collect_set("event_id")).alias("ids"))
    rows = L.histories(firsts).join(ids, "concept")
    j = registry.join(rows, "concept", "full")
    none = F.array().cast("array<string>")
    start = F.struct(F.coalesce("sessions", none).alias("sessions"), F.coalesce("confidence", F.lit(1)).cast("int").alias("confidence"), F.coalesce("failures", F.lit(0)).cast("int").alias("failures"), F.coalesce("evidence", F.lit(0)).cast("int").alias("evidence"), F.coalesce("status", F.lit("candidate")).alias("status"), F.lit(0).alias("transitions"))
    nothing = F.lit(0), F.lit(0), F.lit(None).cast("double")
    s = L.after(start.cast(L.STATE), F.coalesce("h", F.array().cast(rows.schema["h"].dataType)), *nothing)
    out = j.withColumn("_s", s).select("concept", "_s.*", F.array_sort(F.array_union(F.coalesce("source_event_ids", none), F.coalesce("ids", none))).alias("source_event_ids"), F.coalesce(F.size("ids"), F.lit(0)).alias("n_new"))
    flagged = out.where(suspicious(F.col("concept"))).select("concept")
    return out.where("status != 'deprecated'"), flagged


def dream(registry: DataFrame, as_of: float, current_sessions: int) -> DataFrame:
    """One pass of upkeep over concepts (concept, status, confidence, evidence,
    sessions, updated_at in seconds): confidence decays, then concepts are promoted or archived.
    (concept, status, confidence, action, changed)."""
    factor = L.decay_factor((F.lit(as_of) - F.col("updated_at")) / 86400.0)
    rows = registry.withColumn("_c", F.coalesce(L.decayed(F.col("confidence"), factor), F.col("confidence")))
    rows = rows.withColumn("action", L.promotion(F.col("status"), F.col("evidence"), F.size("sessions"), F.lit(current_sessions)))
    status = F.when(F.col("action") == "promote", "validated").when(F.col("action") == "archive", "archived").otherwise(F.col("status"))
    return rows.select("concept", status.alias("status"), F.col("_c").alias("confidence"), "action", ((F.col("_c") != F.col("confidence")) | (F.col("action") != "keep")).alias("changed"))


def evolved_text(body: Column, learnings: Column) -> Column:
    """L13, D-6: a concept's text with a section of its learnings, each once by its words in
    lower case without a last full stop, the first spelling kept."""
    key = lambda x: F.lower(F.regexp_replace(F.trim(x), r"\.+$", ""))
    keyed = F.transform(learnings, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), F.trim(x).alias("x")))
    ordered = F.array_sort(F.filter(keyed, lambda e: e["k"] != ""))
    once = F.element_at(F.transform(F.array(ordered), lambda r: F.filter(r, lambda e, j: (j == 0) | (F.get(r, j - 1)["k"] != e["k"]))), 1)
    lines = F.transform(F.array_sort(F.transform(once, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: F.concat(F.lit("- "), e["x"]))
    plain = F.regexp_replace(body, r"(?s)\n*## Learnings\n.*\z", "")
    return F.when(F.size(lines) > 0, F.concat(plain, F.lit("\n\n## Learnings\n"), F.array_join(lines, "\n"))).otherwise(plain)


def references(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """The last reference of each concept, from a log (concept, seq, at, session_id, source)
    of what searches and reads returned."""
    last = seen.groupBy("concept").agg(F.max_by(F.struct("at", "session_id", "source"), "seq").alias("r"))
    return registry.join(last, "concept", "left").select(registry["*"], F.col("r.at").alias("last_at"), F.col("r.session_id").alias("last_session"), F.col("r.source").alias("last_source"))


def explain(registry: DataFrame, events: DataFrame, history: DataFrame, most: int = 5) -> DataFrame:
    """Each concept with its health, its number of events, its last pieces of evidence
    in order and its revisions. Only the last ones are gathered: a hot concept's history is not."""
    newest = events.withColumn("_r", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("seq")))).where(F.col("_r") <= most)
    last = newest.groupBy("concept").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda x: x["evidence"]).alias("last_evidence"))
    n = events.groupBy("concept").agg(F.count("*").alias("n_events"))
    h = history.groupBy("concept").agg(F.count("*").alias("n_revisions"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = registry.join(n, "concept", "left").join(last, "concept", "left").join(h, "concept", "left")
    return out.select("concept", "status", F.round(L.health(F.col("evidence"), F.col("confidence"), F.col("failures"), F.col("status")), 2).alias("health"), zero("n_events"), "last_evidence", zero("n_revisions"))


def active_concepts(registry: DataFrame, recommended: DataFrame, k: int = 10) -> DataFrame:
    """Concepts by health, 50 more if recommended."""
    r = recommended.select("concept").distinct().withColumn("_r", F.lit(50.0))
    score = L.health(F.col("evidence"), F.col("confidence"), F.col("failures"), F.col("status")) + F.coalesce("_r", F.lit(0.0))
    return registry.join(r, "concept", "left").select("concept", score.alias("score")).orderBy(F.desc("score"), "concept").limit(k)


def file_concepts(files: DataFrame, names: DataFrame) -> DataFrame:
    """The concept of each changed file (path): one of whose names (ord, concept, name) is
    the file's name or path; else, of stems of four letters or more, the stem. First wins."""
    name = F.element_at(F.split(F.lower("path"), "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    keys = files.select("path", F.explode(F.array(F.struct(F.lit(0).alias("p"), name.alias("k")), F.struct(F.lit(0).alias("p"), F.lower("path").alias("k")), F.struct(F.lit(1).alias("p"), F.when(F.length(stem) >= 4, stem).alias("k")))).alias("x")).select("path", "x.p", "x.k")
    hits = keys.join(names.select("ord", "concept", F.lower("name").alias("k")), "k")
    return hits.groupBy("path").agg(F.min(F.struct("p", "ord", "concept")).alias("b")).select("path", "b.concept")


def resume(states: DataFrame) -> DataFrame:
    """Of states (key, origin, at, payload) such as a working set and a handoff, the newer
    of each key; the working set where they are as old."""
    order = Window.partitionBy("key").orderBy(F.desc_nulls_last("at"), F.when(F.col("origin") == "working_set", 0).otherwise(1), "origin")
    return states.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def report(session: Column, project: Column, events_json: Column) -> Column:
    """A session's report, with its events in a fence."""
    return F.concat(F.lit("---\ndate: "), session, F.lit("\nproject: "), project, F.lit("\n---\n# Session Learning Report - "), session, F.lit('\n\n## Knowledge Events\n```json\n{"knowledge_events": '), events_json, F.lit("}\n```\n"))


def report_events(content: Column) -> Column:
    """The events of a report; null where it has no fence that can be read."""
    return F.from_json(F.nullif(F.regexp_extract(content, r"(?s)```json\s*\n(.*?)\n```", 1), F.lit("")), "knowledge_events array<struct<type:string,concept:string,evidence:string,confidence:int>>")["knowledge_events"]


def is_empty_report(content: Column) -> Column:
    """A report without events and without text beside its frame."""
    events = report_events(content)
    rest = F.regexp_replace(content, r"(?s)\A---.*?\n---|```json.*?```|(?m)^#+.*$|\s+", "")
    return (events.isNull() | (F.size(events) == 0)) & (rest == "")
