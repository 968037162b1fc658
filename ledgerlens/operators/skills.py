"""Skills: evidence, candidates and their life (J5, F29, L17, L18, S22, S29, P16, D-9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_list, front_matter, normalize, section, slug

# Words that open a trigger or a behaviour, and the states of a skill.
TRIGGER_WORDS, BEHAVIOR_WORDS = "when|if|during|whenever|upon", "should|must|recommend|always|start with|ensure|avoid|prefer"
TRANSITIONS = {"candidate": ["approved", "rejected"], "approved": ["superseded", "deprecated"], "rejected": ["candidate"], "superseded": [], "deprecated": ["approved"]}
NEGATIVE = ["rejected", "deprecated", "superseded", "stale"]


def _first(texts: Column, words: str) -> Column:
    sentences = F.filter(F.transform(F.flatten(F.transform(F.array_compact(texts), lambda t: F.split(t, "[.!?]"))), lambda x: F.trim(x)), lambda s: s != "")
    hits = F.filter(F.transform(sentences, lambda s: F.trim(F.regexp_extract(s, rf"(?i)\b(?:{words})\b\s+[^.,;!?\n]+", 0))), lambda s: s != "")
    hit = F.coalesce(F.get(hits, 0), F.lit(""))
    return F.concat(F.upper(F.substring(hit, 1, 1)), F.regexp_replace(hit, r"(?s)\A.", ""))


def trigger(texts: Column) -> Column:
    """the first clause of the texts, in order, that says when; empty if none does."""
    return _first(texts, TRIGGER_WORDS)


def behavior(texts: Column) -> Column:
    """the first clause that says what to do, as a sentence."""
    b = _first(texts, BEHAVIOR_WORDS)
    return F.when((b == "") | b.endswith("."), b).otherwise(F.concat(b, F.lit(".")))


def evidence_outcomes(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(concept, event_id, outcome_seq, outcome) over events (concept, event_id, session_id,
    day) and outcomes (seq, session_id, day, outcome, concepts): those of the same session that
    name the concept and, where either has no session, those of the same day. Two equi-joins;
    an event of one day meets that day's outcomes without a session and, if it has none itself,
    all of that day's."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    e = events.select("concept", "event_id", F.col("session_id").alias("_es"), F.col("day").alias("_ed")).dropDuplicates(["concept", "event_id"])
    o = outcomes.select(F.col("seq").alias("outcome_seq"), F.col("session_id").alias("_os"), F.col("day").alias("_od"), "outcome", "concepts")
    named = o.where(has("_os")).select("outcome_seq", "_os", "outcome", F.explode(F.array_distinct("concepts")).alias("concept"))
    same = e.where(has("_es")).join(named, (F.col("_es") == F.col("_os")) & (e["concept"] == named["concept"])).select(e["concept"], "event_id", "outcome_seq", "outcome")
    dated = e.where(has("_ed")).join(o.where(has("_od")).drop("concepts"), F.col("_ed") == F.col("_od")).where(~has("_es") | ~has("_os")).select("concept", "event_id", "outcome_seq", "outcome")
    return same.unionByName(dated)


def evidence_counts(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(concept, n_pairs, n_success): how many pairs ``evidence_outcomes`` has for each concept, and how many of them
    with a success. Events and outcomes of a day are counted before they meet, so a day with very many of
    both costs no more than its rows."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    won = F.when(F.col("outcome") == "success", 1).otherwise(0)
    e = events.select("concept", "event_id", "session_id", "day").dropDuplicates(["concept", "event_id"])
    named = outcomes.where(has("session_id")).select("session_id", F.explode(F.array_distinct("concepts")).alias("concept"), won.alias("w"))
    named = named.groupBy("session_id", "concept").agg(F.count("*").alias("o"), F.sum("w").alias("w"))
    same = e.where(has("session_id")).groupBy("session_id", "concept").agg(F.count("*").alias("n")).join(named, ["session_id", "concept"])
    same = same.select("concept", (F.col("n") * F.col("o")).alias("n_pairs"), (F.col("n") * F.col("w")).alias("n_success"))
    days = outcomes.where(has("day")).groupBy("day").agg(F.count("*").alias("o"), F.sum(won).alias("w"), F.count_if(~has("session_id")).alias("bare_o"), F.sum(F.when(~has("session_id"), won).otherwise(0)).alias("bare_w"))
    mine = e.where(has("day")).groupBy("concept", "day").agg(F.count_if(~has("session_id")).alias("bare"), F.count_if(has("session_id")).alias("held")).join(days, "day")
    dated = mine.select("concept", (F.col("bare") * F.col("o") + F.col("held") * F.col("bare_o")).alias("n_pairs"), (F.col("bare") * F.col("w") + F.col("held") * F.col("bare_w")).alias("n_success"))
    return same.unionByName(dated).groupBy("concept").agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_success").alias("n_success")).where("n_pairs > 0")


# Where skills come from, and what the two ways ask for.
SKILL_SOURCES = ["chat", "chat-fallback", "agent_structured"]
STRICT = {"events": 2, "successes": 1, "trigger": 8, "behavior": 12}
RELAXED = {"summary": 21, "trigger": 4, "behavior": 6}


def candidates(concepts: DataFrame, events: DataFrame, outcomes: DataFrame, taken: DataFrame | None = None, limit: int = 10, relaxed: bool = True) -> DataFrame:
    """Concepts (concept, title, and status) that their events make a skill. Events of other sources than SKILL_SOURCES
    don't count, where they have one; the last row of an event id counts (D-9).

    Strictly: two events, one success among their outcomes, a trigger of 8 and a behaviour of 12 characters;
    confidence high from three events on, else medium. Concepts that fail this and are candidates or
    emerging may come with low confidence (``relaxed``): one event with a summary of over 20 characters, whose texts
    give a trigger of 4 and a behaviour of 6. Skills in ``taken`` (slug, evidence array, and fingerprint) hold back candidates of their
    slug, of half their evidence or of their fingerprint, the normalised trigger and behaviour. The strongest first.
    """
    if "source" in events.columns:
        events = events.where(F.col("source").isin(SKILL_SOURCES))
    last = events.groupBy("concept", "event_id").agg(F.max_by(F.struct("summary", "evidence", "session_id", "day", "seq"), "seq").alias("r")).select("concept", "event_id", "r.*")
    texts = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("seq", "summary", "evidence")))), lambda x: F.concat_ws(". ", x["summary"], x["evidence"]))
    told = F.coalesce(F.length("summary"), F.lit(0)) >= RELAXED["summary"]
    found = last.groupBy("concept").agg(texts(F.lit(True)).alias("_all"), texts(told).alias("_told"), F.sort_array(F.collect_list("event_id")).alias("_ids"), F.sort_array(F.collect_list(F.when(told, F.col("event_id")))).alias("_told_ids"))
    wins = evidence_counts(last, outcomes).select("concept", "n_success")
    rows = concepts.join(found, "concept").join(wins, "concept", "left").withColumn("n_success", F.coalesce("n_success", F.lit(0)))
    rows = rows.withColumns({"_t": trigger(F.col("_all")), "_b": behavior(F.col("_all")), "_rt": trigger(F.col("_told")), "_rb": behavior(F.col("_told"))})
    strict = (F.size("_ids") >= STRICT["events"]) & (F.col("n_success") >= STRICT["successes"]) & (F.length("_t") >= STRICT["trigger"]) & (F.length("_b") >= STRICT["behavior"])
    loose = F.lit(relaxed) & (F.size("_told_ids") >= 1) & (F.length("_rt") >= RELAXED["trigger"]) & (F.length("_rb") >= RELAXED["behavior"])
    loose = loose & F.col("status").isin("candidate", "emerging") if "status" in concepts.columns else F.lit(False)
    rows = rows.withColumn("_strict", strict).where(F.col("_strict") | loose)
    pick = lambda a, b: F.when(F.col("_strict"), F.col(a)).otherwise(F.col(b))
    rows = rows.select("concept", slug(F.col("title")).alias("slug"), "title", F.col("_ids").alias("ids"), pick("_ids", "_told_ids").alias("_own"), F.size("_ids").cast("long").alias("n_events"), "n_success", pick("_t", "_rt").alias("trigger"), pick("_b", "_rb").alias("behavior"), F.when(~F.col("_strict"), "low").when(F.size("_ids") >= 3, "high").otherwise("medium").alias("confidence"))
    rows = rows.withColumn("fingerprint", normalize(F.concat("trigger", "behavior")))
    if taken is not None:
        rows = rows.join(taken.select("slug").distinct(), "slug", "left_anti")
        if "fingerprint" in taken.columns:
            rows = rows.join(taken.where("fingerprint IS NOT NULL").select("fingerprint").distinct(), "fingerprint", "left_anti")
        old = taken.select(F.col("slug").alias("_s"), F.explode("evidence").alias("_e")).distinct()
        mine = rows.select("slug", F.size("_own").alias("_n"), F.explode("_own").alias("_e"))
        half = mine.join(old, "_e").groupBy("slug", "_n", "_s").agg(F.count("*").alias("c")).where("2 * c >= _n").select("slug").distinct()
        rows = rows.join(half, "slug", "left_anti")
    return rows.drop("_own").orderBy(F.desc("n_success"), F.desc("n_events"), "slug").limit(limit)


def may_become(old: Column, new: Column) -> Column:
    """Whether a skill may go from one state to another."""
    out = F.lit(False)
    for k, v in TRANSITIONS.items():
        out = out | ((old == k) & new.isin(*v)) if v else out
    return out


def transition(skills: DataFrame, changes: DataFrame) -> DataFrame:
    """Skills (slug, status) after the changes (slug, to, by): those that are not allowed
    are left with an error; a superseded skill names what took its place."""
    j = skills.join(changes.select("slug", F.col("to").alias("_to"), F.col("by").alias("_by")), "slug", "left")
    ok = F.col("_to").isNotNull() & may_become(F.col("status"), F.col("_to"))
    return j.select("slug", F.when(ok, F.col("_to")).otherwise(F.col("status")).alias("status"), F.when(ok & (F.col("_to") == "superseded"), F.col("_by")).alias("superseded_by"), F.when(F.col("_to").isNotNull() & ~ok, F.concat_ws(" ", F.lit("no way from"), "status", F.lit("to"), "_to")).alias("error"))


def usable_skills(skills: DataFrame) -> DataFrame:
    """Without those of a negative status."""
    return skills.where(~F.lower(F.coalesce("status", F.lit(""))).isin(NEGATIVE))


def scan(files: DataFrame, approved: Column | None = None) -> DataFrame:
    """Skills of markdown files (path, document): front matter, sections, and what
    stands in where they lack: the first heading, else the file's name, as title, the first
    paragraph, cut at 220 characters, as behaviour. Approved ones come first for a slug."""
    doc, meta = F.col("document"), front_matter(F.col("document"))
    body = F.regexp_replace(doc, r"(?s)\A---\s*\n.*?\n(?:---|\.\.\.)\s*(?:\n|\z)", "")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    paragraph = F.get(F.filter(F.transform(F.split(body, r"\n\s*\n"), lambda x: F.trim(x)), lambda p: (p != "") & ~p.startswith("#")), 0)
    good = F.col("path").contains("/approved/") if approved is None else approved
    rows = files.select(
        "path",
        F.coalesce(blank(F.try_element_at(meta, F.lit("slug"))), slug(name)).alias("slug"),
        F.coalesce(blank(F.try_element_at(meta, F.lit("title"))), blank(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)), name).alias("title"),
        F.coalesce(blank(section(doc, "Trigger")), blank(F.try_element_at(meta, F.lit("trigger"))), F.lit("")).alias("trigger"),
        F.substring(F.coalesce(blank(section(doc, "Behavior")), blank(F.try_element_at(meta, F.lit("behavior"))), paragraph, F.lit("")), 1, 220).alias("behavior"),
        as_list(F.regexp_replace(F.coalesce(F.try_element_at(meta, F.lit("tags")), F.lit("")), r"[\[\]\"']", "")).alias("tags"),
        F.coalesce(blank(F.try_element_at(meta, F.lit("status"))), F.when(good, "approved").otherwise("candidate")).alias("status"),
        good.alias("approved"),
    )
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("approved"), "path"))).where("_r = 1").drop("_r")


def as_markdown(title: Column, status: Column, trigger_: Column, behavior_: Column, tags: Column) -> Column:
    """A skill as a markdown document that ``scan`` reads back."""
    return F.concat(F.lit("---\ntitle: "), title, F.lit("\nstatus: "), status, F.lit("\ntags: ["), F.array_join(tags, ", "), F.lit("]\n---\n# "), title, F.lit("\n\n## Trigger\n"), trigger_, F.lit("\n\n## Behavior\n"), behavior_, F.lit("\n"))
