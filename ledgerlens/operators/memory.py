"""Search over learned memory: what a query names, types of memory, boosts, gates, order
(F26, F38, F45, O1, P7, P8, P10, P17, P21 to P23, R4 to R6, R11, R14)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import ratio_udf
from ..functions.text import phrase_normalized, settle, strip_fences
from .ranking import importance, query_terms

# Words, phrases and patterns that ranking knows.
STOP = "the a an of to in on for with from by at as is are was were be been being and or but if then than that this it its".split()
GENERIC = "current project content work continue session context file task next now state review health memory agent fix story page layout".split()
PAIRED = {"layout": "responsive frontend mobile css grid page".split(), "story": [], "page": []}
RULE_INTENT = r"(?i)\b(decision|means|workflow|should|do not|never|avoid|unless|explicit|continue working|analyze|write|modify|open project|current project)\b"
RULE_PHRASES = ["do not modify", "unless explicit", "continue working", "means analyze", "not write", "inspect understand tone propose changes", "open project", "is the open project"]
TECHNICAL = ["timeout", "error", "bug", "workaround", "adapter"]
DEBUG = ["debug", "trace", "fix", "regression", "break"]
DETAIL = r"(?i)\b(timeout|error|bug|workaround|adapter|debug|fix|explicitly)\b"
ACTIVE = r"(?i)\b(is the open project|open work item|active task|active work|working on|current project work)\b"
HANDOFF_FILE = r"(?i)session-handoff\.md"
TEMPORAL = r"(?i)\b(since|recently|recent|last|before|after|currently|today|yesterday|previous|earlier|later|now)\b"
CONTINUE = ["continue", "working on", "current project", "active task"]
STRONG_TYPES = ["decision", "failure", "outcome", "technical_handoff", "workaround", "debug_note"]
KNOWN_TYPES = ["decision", "failure", "outcome", "observation", "preference", "episodic", "technical_handoff", "debug_note", "workaround", "source_dump", "command_log", "search_log", "active_work_signal"]
# Weights of the ranking.
TYPE_BOOST = {"decision": 4.0, "failure": 5.0, "outcome": 3.0}
TECHNICAL_BOOST = {"technical_handoff": 5.0, "workaround": 5.0, "debug_note": 4.0}
LOG_PENALTY = {"search_log": 5.0, "command_log": 5.0, "source_dump": 6.0}
STATUS_FACTOR = {"canonical": 1.3, "validated": 1.1, "emerging": 0.9, "candidate": 0.7, "needs_review": 0.5}
LARGE = 1500


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ing", "ed", "es"):
        if w.endswith(end):
            return w[: -len(end)]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _once(items: list[str]) -> list[str]:
    return list({x.lower(): x for x in reversed(items)}.values())[::-1]


@dataclass(frozen=True)
class Targets:
    """what a query names, worked out once on the driver; executors see literals."""

    query: str = ""
    paths: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    dirs: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    identifiers: list[str] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    semantic: list[str] = field(default_factory=list)
    generic: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    rule_intent: bool = False
    technical: bool = False
    debug: bool = False
    strong: bool = False

    @classmethod
    def of(cls, query: str) -> Targets:
        q = query.strip()
        low, words = q.lower(), re.findall(r"\w+", q.lower())
        paths = [p for p in re.findall(r"[\w./-]+\.md", q) if "/" in p]
        files, dirs = re.findall(r"[\w-]+\.md", q), re.findall(r"[\w-]+(?:/[\w-]+)+", q)
        stems = [f[:-3] for f in files] + [s for p in paths + dirs for s in p.split("/") if len(s) > 1 and not s.endswith(".md")]
        ids = [i for i in re.findall(r"\b[A-Za-z_][A-Za-z0-9_.]{2,}\b", q) if re.search(r"_|\.\w|[a-z][A-Z]|^[A-Z0-9_]{3,}$", i) and not i.lower().endswith(".md")]
        stop = lambda w: w in STOP or _stem(w) in STOP
        generic = lambda w: w in GENERIC or _stem(w) in GENERIC
        named = bool(paths or files or dirs)
        rescued = {w for w in words for p, friends in PAIRED.items() if p in (w, _stem(w)) and (named or any(f in words for f in friends if f != w))}
        semantic = [w for w in words if not stop(w) and (not generic(w) or w in rescued)]
        strong = named or bool(ids) or any(not generic(w) for w in semantic)
        keep = [w for w in words if len(w) > 1 and not stop(w) and (strong or not generic(w) or w in semantic)]
        long = [w for w in re.findall(r"\w+", q) if len(w) > 1]
        phrases = [" ".join(long[i : i + n]) for n in range(4, min(8, len(long) + 1)) for i in range(len(long) - n + 1)] if semantic else []
        return cls(q, _once(paths), _once(files), _once(dirs), _once([s for s in stems if not stop(s.lower())]), _once(ids), _once(keep), _once(semantic), _once([w for w in words if generic(w) and w not in semantic and not stop(w)]), _once(phrases), bool(re.search(RULE_INTENT, q)), any(s in low for s in TECHNICAL) or bool(ids), any(s in low for s in DEBUG), strong)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _count(conditions) -> Column:
    return sum((F.when(c, 1).otherwise(0) for c in conditions), F.lit(0))


def _bordered(low: Column, name: str, end: str) -> Column:
    """The pattern begins with its letters, so a text is searched for them before anything else is tried."""
    x = re.escape(name.lower())
    return low.contains(name.lower()) & low.rlike(rf"{x}(?<![a-z0-9_.]{x}){end}(?![a-z0-9_.])")


def names(low: Column, name: str) -> Column:
    """an identifier that nothing of a name or a dot borders on, in a text in lower case."""
    return _bordered(low, name, "")


def word(low: Column, w: str) -> Column:
    """a word or its plural, in a text in lower case."""
    return _bordered(low, w, "(?:s|es)?")


def _if_any(needles: list[str], low: Column, text: Column, pattern: str) -> Column:
    """``text.rlike(pattern)`` for a pattern that can't match without one of the needles in the text in lower case."""
    return _any(low.contains(x) for x in needles) & text.rlike(pattern)


def _label(*labels: str) -> str:
    x = "|".join(labels)
    return rf"(?i)(?:^|\n)\s*#{{1,6}}\s*(?:{x})\b|(?:^|\n)\s*(?:[-*]\s*)?(?:\*\*|__)?(?:{x})(?:\*\*|__)?\s*:"


def memory_type(document: Column, title: Column | None = None) -> Column:
    """the type of a memory by its labels, then by the head of its text, then by its shape;
    the first rule decides. Fences are left out. The patterns are fixed values."""
    t = strip_fences(F.concat_ws("\n", title, document) if title is not None else document)
    one = F.transform(F.array(F.struct(t.alias("t"), F.lower(t).alias("low"))), lambda x: _type(x["t"], x["low"]))
    return F.element_at(one, 1)


ACTIVE_WORDS = ["is the open project", "open work item", "active task", "active work", "working on", "current project work"]
DETAIL_WORDS = ["timeout", "error", "bug", "workaround", "adapter", "fix", "explicitly"]


def _type(t: Column, low: Column) -> Column:
    """The type of a text without fences, also given in lower case: a rule is tried where the text has one of its words."""
    head = F.regexp_extract(t, r"\A\s*+([^\n]*(?:\n[^\n]*){0,2})", 1)
    rule = lambda needles, pattern, text=t: _if_any(needles, low, text, pattern)
    failure = rule(["failure"], _label("failure")) | rule(["do-not-repeat", "breaking"], r"(?i)\bdo-not-repeat\b|\bbreaking\b") | rule(["failure:", "do-not-repeat", "bug:", "regression:", "breaking"], r"(?i)(?:^|\n)\s*Failure:|Do-not-repeat|Bug:|Regression:|BREAKING", head)
    return (
        F.when(failure, "failure")
        .when(rule(["decision"], _label("decision")), "decision")
        .when(rule(["outcome"], _label("outcome")), "outcome")
        .when(rule(["handoff:", "note:"], r"(?i)(?:^|\n)\s*(Handoff|Technical\s+Note|Technical\s+Handoff):", head), "technical_handoff")
        .when(rule(["debug"], r"(?i)(?:^|\n)\s*(Debug\s+Note|Debug):", head), "debug_note")
        .when(rule(["workaround"], r"(?i)\bworkaround\b"), "workaround")
        .when(rule(["session-handoff.md"], HANDOFF_FILE) & rule(DETAIL_WORDS + ["debug"], DETAIL), "technical_handoff")
        .when(rule(["prefer", "like", "always", "never", "don't", "hate", "style", "convention"], r"(?i)\b(prefer|like|always|never|don't|hate|style|convention)\b"), "preference")
        .when(rule(["last time", "previously", "tried", "attempted", "before"], r"(?i)\b(last time|previously|tried|attempted|before)\b"), "episodic")
        .when(rule(["full source dump", "file contents:", "<<eof"], r"(?i)Full source dump|File contents:|cat\s+<<EOF"), "source_dump")
        .when(rule(["command", "shell output:"], r"(?i)Command\s+`|Command output:|Shell output:"), "command_log")
        .when(rule(["search result", "knowledge_search(", "knowledge_read("], r"(?i)Search results?:|knowledge_search\(|knowledge_read\("), "search_log")
        .when(rule(ACTIVE_WORDS, ACTIVE), "active_work_signal")
        .otherwise("observation")
    )


def _lookup(values: dict[str, float], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def rerank(rows: DataFrame, targets: Targets, typed: str | None = None) -> DataFrame:
    """Candidates (id, document, base) with memory_type, boosts, penalties, eligible and
    final_score. A column ``typed`` gives types that are kept if known. Columns status,
    confidence and evidence, where there, scale the score. What several rules need is settled
    before them."""
    doc = F.col("document")
    rows = settle(rows, {"_low": F.lower(doc), "_t": strip_fences(doc)})
    low = F.col("_low")
    # a phrase can only be where all its words are; other texts are not cut into words
    with_words = lambda phrases: _any(_all(low.contains(w) for w in p.lower().split()) for p in phrases)
    where = lambda phrases, c: F.when(with_words(phrases), c).when(low.isNotNull(), "")
    padded = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), " "), F.lit(" "))
    rows = settle(rows, {"_low_t": F.lower("_t"), "_padded": where(targets.phrases, padded), "_norm": where(RULE_PHRASES, phrase_normalized(doc))})
    found = _type(F.col("_t"), F.col("_low_t"))
    kind = F.when(F.col(typed).isin(KNOWN_TYPES[:5]), F.col(typed)).otherwise(found) if typed else found
    rows = settle(rows, {
        "memory_type": kind,
        "_path": _any(low.contains(p.lower()) for p in targets.paths),
        "_file": _any(low.contains(f.lower()) for f in targets.files),
        "_stem": _any(names(low, i) for i in [*targets.stems, *targets.identifiers] if len(i) >= 3),
        "_phrase": _any(F.contains(F.col("_padded"), F.lit(f" {p.lower()} ")) for p in targets.phrases),
        "_rule": _any(F.col("_norm").contains(p) for p in RULE_PHRASES),
        "_ids": _count(names(low, i) for i in targets.identifiers if len(i) >= 3),
        "_topic": _count(word(low, t) for t in targets.tokens),
        "_semantic": _count(low.contains(t.lower()) for t in targets.tokens if t.lower() in targets.semantic),
        "_active": _if_any(ACTIVE_WORDS, low, doc, ACTIVE),
        "_decided": _if_any(["we decided to"], low, doc, r"(?i)\bwe decided to\b"),
    }).drop("_t", "_low_t", "_padded", "_norm")
    c, on = F.col, F.lit
    exact = c("_path") | c("_file") | c("_stem") | c("_phrase")
    continues = on(any(p in targets.query.lower() for p in CONTINUE) or bool(targets.paths or targets.files))
    aligned = c("_active") & (continues | (c("_semantic") >= 2))
    floor = c("_path") | c("_file") | c("_phrase") | (c("_rule") & on(targets.rule_intent)) | (c("_ids") >= 1) | aligned | (c("_semantic") >= 2)
    rows = settle(rows, {"eligible": floor, "_exact": exact, "_signal": (c("_active") | on(targets.rule_intent)) & on(targets.strong), "aligned": aligned})
    several = F.when(c("_ids") >= 3, 7.0).when(c("_ids") == 2, 5.0).when(c("_ids") == 1, 2.5)
    large, t = F.length(doc) > LARGE, c("memory_type")
    deep = on(targets.technical or targets.debug)
    boosts = {
        "exact_path_match": F.when(c("_path"), 6.0),
        "exact_filename_match": F.when(~c("_path") & c("_file"), 4.0),
        "identifier_match": F.when(~c("_path") & ~c("_file") & c("_stem"), 2.5),
        "exact_phrase": F.when(c("_phrase"), 8.0),
        "rule_phrase": F.when(c("_rule") & on(targets.rule_intent), 3.0),
        "active_work_signal": F.when(c("_signal"), 3.0),
        "workflow_rule": F.when(c("_rule") & on(targets.strong), 4.0),
        "type": F.when(c("eligible"), _lookup(TYPE_BOOST, t)),
        "topic_match": F.when(c("_topic") > 0, F.least(F.lit(2.0), 0.5 * c("_topic"))),
        "identifier_cooccurrence": F.when(on(targets.technical), several),
        "technical": F.when(deep, _lookup(TECHNICAL_BOOST, t)),
        "session_handoff_technical": F.when(deep & doc.rlike(HANDOFF_FILE) & (c("_ids") >= 1), 4.0),
        "identifier_with_term": F.when((c("_ids") >= 1) & _if_any(DETAIL_WORDS + ["debug"], low, doc, DETAIL), 3.0),
        "temporal_match": F.when(on(bool(re.search(TEMPORAL, targets.query))) & doc.rlike(TEMPORAL), 2.0),
        "exact_decision_phrase": F.when(c("_decided"), 5.0),
    }
    penalties = {
        "log": _lookup(LOG_PENALTY, t),
        "large_low_density": F.when(large & ~c("_exact"), 3.0),
        "large_command_or_source": F.when(large & ~c("_exact") & t.isin("command_log", "source_dump"), 8.0),
        "generic_active_project_for_technical": F.when(on(targets.technical) & c("_signal") & (c("_ids") == 0), 4.0),
    }
    as_map = lambda d: F.map_filter(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v.cast("double"))]), lambda k, v: v.isNotNull())
    rows = settle(rows, {"boosts": as_map(boosts), "penalties": as_map(penalties)})
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x)
    final = c("base") + total("boosts") - total("penalties")
    if "evidence" in rows.columns:
        final = final * F.when(c("evidence") > 100, F.greatest(F.lit(0.3), 1 - (c("evidence") - 100) / 500)).otherwise(1.0)
    if "status" in rows.columns:
        final = final * F.coalesce(_lookup(STATUS_FACTOR, c("status")), F.lit(1.0))
    if "confidence" in rows.columns:
        final = final * F.coalesce(0.5 + c("confidence") / 10, F.lit(1.0))
    return settle(rows, {"final_score": final}).drop("_low", "_decided", "_path", "_file", "_stem", "_phrase", "_rule", "_ids", "_topic", "_semantic", "_active", "_exact", "_signal")


def with_registry(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates (concept_id, ...) with status, confidence and evidence of their concept in the registry (concept_id, status,
    confidence, evidence), by which ``rerank`` scales their score; null, and not scaled, without one."""
    known = registry.groupBy("concept_id").agg(F.max(F.struct("status", "confidence", "evidence")).alias("_c")).select("concept_id", "_c.*")
    return rows.drop("status", "confidence", "evidence").join(known, "concept_id", "left")


def order() -> list[Column]:
    """O1: the order of results: score, base, then among equals those without an exact hit, decisions and failures,
    those without signals, logs by their penalty, ids."""
    has = lambda k: F.map_contains_key("boosts", k)
    return [F.desc("final_score"), F.desc("base"), has("exact_path_match"), has("exact_filename_match"), (~F.col("memory_type").isin("decision", "failure")), has("active_work_signal"), has("workflow_rule"), has("exact_phrase"), *[F.when(F.col("memory_type") == k, -LOG_PENALTY[k]).otherwise(0.0) for k in ("search_log", "command_log", "source_dump")], F.col("id")]


def promote(rows: DataFrame, fields: list[str], metadata: str = "metadata") -> DataFrame:
    """Fields of a metadata map at the top where the row has none."""
    return rows.withColumns({f: F.coalesce(F.col(f) if f in rows.columns else F.lit(None).cast("string"), F.try_element_at(F.col(metadata), F.lit(f))) for f in fields})


def record_issues(rows: DataFrame) -> Column:
    """What is wrong with a record (id, document, score, memory_type, scope); those that
    begin with fatal keep it out."""
    none = F.lit(None).cast("string")
    checks = [
        (F.coalesce(F.trim("id"), F.lit("")) == "", "fatal: no id"),
        (F.coalesce(F.trim("document"), F.lit("")) == "", "fatal: no document"),
        (F.col("score").isNull() | F.isnan("score"), "fatal: no score"),
        (~F.coalesce("memory_type", F.lit("observation")).isin(KNOWN_TYPES), "warning: unknown type"),
        (~F.coalesce("scope", F.lit("project")).isin("project", "user", "global"), "warning: unknown scope"),
    ]
    return F.array_compact(F.array(*[F.when(c, m).otherwise(none) for c, m in checks]))


def search(candidates: DataFrame, query: str, k: int = 3, scope: str | None = None, memory_types: list[str] | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Candidates (id, document, base, and what ``rerank`` can use) ranked, then filtered:
    typed memory below the floor and scores of 0 or less go (P10), then by scope (null is the
    project's), type and time (a time that is missing or unreadable stays), then the first k."""
    ranked = rerank(candidates, Targets.of(query))
    out = ranked.where((F.col("final_score") > 0) & (F.col("eligible") | ~F.col("memory_type").isin(*TYPE_BOOST)))
    if scope:
        out = out.where(F.coalesce("scope", F.lit("project")) == scope)
    if memory_types:
        out = out.where(F.col("memory_type").isin(memory_types))
    for bound, ok in ((since, lambda t, b: t >= b), (until, lambda t, b: t <= b)):
        if bound:
            at = F.try_to_timestamp("timestamp")
            out = out.where(at.isNull() | ok(at, F.to_timestamp(F.lit(bound))))
    return out.orderBy(*order()).limit(max(1, k))


def debug_report(candidates: DataFrame, query: str, k: int = 5, raw: int = 50) -> tuple[DataFrame, DataFrame]:
    """The candidates before ranking, the first ``raw`` by base, and the first k after it."""
    return candidates.orderBy(F.desc("base"), "id").limit(raw), rerank(candidates, Targets.of(query)).orderBy(*order()).limit(k)


def registry_search(registry: DataFrame, query: str) -> DataFrame:
    """Search without an index over (concept_id, canonical_name, aliases, text, importance):
    1 for the name, .85 for an alias, else half the share of the query's words, or what the
    likeness of .8 or more of a name makes; above .1, blended with importance."""
    q, terms = query.lower().strip(), query_terms(query)
    all_text = F.lower(F.concat_ws(" ", "canonical_name", F.array_join("aliases", " "), "text"))
    share = 0.5 * _count(all_text.contains(t) for t in terms) / max(1, len(terms))
    like = F.explode(F.transform(F.concat(F.array("canonical_name"), "aliases"), lambda x: F.lower(x))).alias("n")
    near = registry.select("concept_id", like).select("concept_id", ratio_udf(F.lit(q), F.col("n")).alias("s")).groupBy("concept_id").agg(F.max("s").alias("_s"))
    score = F.when(F.lower("canonical_name") == q, 1.0).when(F.array_contains(F.transform("aliases", lambda x: F.lower(x)), q), 0.85).otherwise(F.greatest(share, F.when(F.col("_s") >= 0.8, 0.5 + 0.35 * F.col("_s")).otherwise(0.0)))
    out = registry.join(near, "concept_id", "left").withColumn("_score", score)
    out = out if not terms and not q else out.where("_score > 0.1")
    return out.select(F.concat("concept_id", F.lit("#fallback")).alias("id"), "canonical_name", (0.8 * F.col("_score") + 0.2 * importance(F.col("importance"))).alias("score"))


def weak(targets: Targets, title: Column | None = None) -> Column:
    """Why a ranked memory is a weak match; null if it is not."""
    b, t = F.col("boosts"), F.col("memory_type")
    has = lambda *ks: _any(F.map_contains_key(b, k) for k in ks)
    of = lambda k: F.coalesce(F.try_element_at(b, F.lit(k)), F.lit(0.0))
    rule = F.lit(targets.rule_intent)
    adjusted = F.col("final_score") - F.when(~F.col("aligned"), of("active_work_signal")).otherwise(0.0) - F.when(~rule, of("workflow_rule") + of("rule_phrase")).otherwise(0.0)
    titled = F.lit(False)
    if title is not None and targets.query:
        low = F.lower(title)
        titled = (F.length(title) >= 3) & (F.lit(targets.query.lower()).contains(low) | low.contains(targets.query.lower()))
    typed = t.isin(*TYPE_BOOST)
    strong = has("exact_path_match", "exact_filename_match", "exact_phrase", "identifier_match", "identifier_cooccurrence", "identifier_with_term", "technical", "session_handoff_technical") | (rule & has("workflow_rule", "rule_phrase")) | (typed & F.col("eligible")) | F.col("aligned")
    topic_only = (adjusted <= 1.5) & ~titled & ~strong & has("topic_match")
    overlap = has("exact_path_match", "exact_filename_match", "exact_phrase", "identifier_cooccurrence", "topic_match")
    named = bool(targets.semantic or targets.files or targets.paths or targets.identifiers)
    rest = F.when(F.lit(not named and not targets.generic), "stopword_only").when(F.lit(not named), "generic_only").when((F.size(F.map_keys(b)) == 1) & has("topic_match") & (of("topic_match") <= 0.5), "single_weak_topic")
    kept = t.isin(STRONG_TYPES) | has("exact_path_match", "exact_filename_match", "exact_phrase", "identifier_match", "identifier_cooccurrence")
    return F.when(typed & ~F.col("eligible"), "below_relevance_floor").when(topic_only, "weak_topic_only").when(~overlap, "no_overlap").when(kept, None).otherwise(rest)


def relevance(targets: Targets, continuation: bool = False) -> Column:
    """Strong, medium or weak, by type, a target in the text and what the task is about."""
    low, t = F.lower("document"), F.col("memory_type")
    hit = _any(low.contains(x.lower()) for x in [*targets.stems, *targets.identifiers, *targets.files])
    decided, technical = t.isin("decision", "failure", "outcome"), t.isin(*TECHNICAL_BOOST)
    open_work = F.col("document").rlike(ACTIVE) & F.lit(continuation)
    return F.when((decided & hit) | (technical & (hit | F.lit(targets.technical))) | open_work, "strong").when(decided | technical | hit, "medium").otherwise("weak")


def only_weak(targets: Targets) -> Column:
    """P22, an aggregate: whether all matches of a task are weak; true without any."""
    named = bool(targets.semantic or targets.files or targets.paths or targets.identifiers)
    b = F.col("boosts")
    good = F.col("memory_type").isin(STRONG_TYPES) | _any(F.map_contains_key(b, k) for k in ("exact_path_match", "exact_filename_match", "exact_phrase", "identifier_match", "identifier_cooccurrence")) | (F.coalesce(F.try_element_at(b, F.lit("topic_match")), F.lit(0.0)) > 0.5)
    return F.lit(True) if not named else F.coalesce(~F.bool_or(good), F.lit(True))


# What asks to go on with earlier work.
GENERIC_CONTINUATION = ["continue the current project", "continue current project", "continue this project", "continue the project", "resume the project", "pick up where", "what were we working on"]
CONTINUATION = ["continue", "resume", "keep going", "pick up where", "where we left off", "next step"]


def is_continuation(task: str, generic: bool = False) -> bool:
    """Whether a task asks to go on; generic if it names no more than the project."""
    return any(p in task.strip().casefold() for p in (GENERIC_CONTINUATION if generic else CONTINUATION))


def title_of(document: Column) -> Column:
    """The first heading of a chunk, else its first line, at most 80 characters."""
    heading = F.trim(F.regexp_extract(document, r"(?m)^#{1,6}\s+(.+)$", 1))
    return F.substring(F.when(heading != "", heading).otherwise(F.trim(F.regexp_extract(document, r"\A\s*([^\n]*)", 1))), 1, 80)


def reason_code(kind: Column, boosts: Column) -> Column:
    """one code for why a match is there."""
    has = lambda k: F.map_contains_key(boosts, k)
    return F.when(has("exact_path_match"), "exact_path").when(has("exact_filename_match"), "exact_file").when(has("exact_phrase"), "exact_phrase").when(has("identifier_cooccurrence") | has("identifier_match"), "identifier").when(kind.isin(*TYPE_BOOST), "typed_memory").when(has("topic_match"), "topic").otherwise("other")
