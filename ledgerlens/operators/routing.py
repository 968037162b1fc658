"""Scores and decisions that route a task to its context."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_phrase, lexical_overlap, normalize, settle, unique_tokens
from .memory import memory_type  # noqa: F401

# Weights of the scorers.
TRIGGER, TITLE, SKILL_TAG, CONCEPT_TAG, ALIAS, OVERLAP, MEMORY, PENALTY = 6.0, 5.0, 4.0, 3.0, 3.0, 2.0, 2.0, 4.0
MEMORY_TYPES = {"decision": 3.0, "failure": 2.5, "outcome": 2.0}
BAD_SKILL, BAD_CONCEPT = ["rejected", "deprecated", "superseded", "stale"], ["deprecated", "stale", "missing_file"]


def _any_phrase(task: Column, phrases: Column, unless_in: Column | None = None) -> Column:
    if unless_in is None:
        return F.exists(phrases, lambda p: contains_phrase(task, p))
    return F.exists(phrases, lambda p: contains_phrase(task, p) & ~contains_phrase(unless_in, p))


def _overlaps(task: Column, text: Column, least: float) -> Column:
    a, b = unique_tokens(normalize(task)), unique_tokens(normalize(text))
    return (lexical_overlap(a, b) >= least) | (F.size(F.array_intersect(a, b)) >= 2)


def skill_score(task: Column, title: Column, behavior: Column, triggers: Column, tags: Column, aliases: Column, status: Column) -> Column:
    """One hit for each list, lexical overlap, a penalty for a negative status, at least 0."""
    text = F.concat_ws(" ", title, behavior, tags, aliases, triggers)
    s = F.when(_any_phrase(task, triggers), TRIGGER).otherwise(0.0) + F.when(_any_phrase(task, tags), SKILL_TAG).otherwise(0.0) + F.when(_any_phrase(task, aliases), ALIAS).otherwise(0.0)
    s = s + F.when(_overlaps(task, text, 0.2), OVERLAP).otherwise(0.0) - F.when(F.lower(status).isin(BAD_SKILL), PENALTY).otherwise(0.0)
    return F.greatest(F.lit(0.0), s)


def concept_score(task: Column, title: Column, summary: Column, tags: Column, aliases: Column, status: Column) -> Column:
    """Tags and aliases that an exactly matched title holds don't count again."""
    exact = contains_phrase(task, title)
    within = F.when(exact, title).otherwise("")
    text = F.concat_ws(" ", title, summary, tags, aliases)
    s = F.when(exact, TITLE).otherwise(0.0) + F.when(_any_phrase(task, tags, within), CONCEPT_TAG).otherwise(0.0) + F.when(_any_phrase(task, aliases, within), ALIAS).otherwise(0.0)
    s = s + F.when(_overlaps(task, text, 0.2), OVERLAP).otherwise(0.0) - F.when(F.lower(status).isin(BAD_CONCEPT), PENALTY).otherwise(0.0)
    return F.greatest(F.lit(0.0), s)


def memory_score(task: Column, text: Column, kind: Column) -> Column:
    factor = F.lit(1.0)
    for k, v in MEMORY_TYPES.items():
        factor = F.when(kind == k, v).otherwise(factor)
    return F.when(_overlaps(task, text, 0.15), MEMORY * factor).otherwise(0.0)


# Words that directive matching leaves out or counts for less.
STOP = ["the", "and", "are", "was", "were", "for", "with", "from", "been", "being", "than", "that", "this", "its"]
GENERIC = ["current", "project", "content", "work", "continue", "session", "context", "file", "task", "next", "now", "state", "review", "health", "memory", "agent", "start", "working", "pick", "left", "resume", "machine", "contract", "fix"]


def directive_tokens(c: Column) -> Column:
    return F.array_except(F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z0-9_\-]{3,})\b"), F.lit(1)), F.array(*map(F.lit, STOP)))


def match_directives(df: DataFrame, tasks: list[str] | None = None) -> DataFrame:
    """R9 over (task, id, title, rule, scope, priority, triggers, always_on): score and class of
    the directives that have a positive signal. With ``tasks`` each of them meets each row, whose words are taken once."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"\b([a-z0-9_\-]{3,})\b"), F.lit(1))
    # what several rules need is worked out once for each row, and rows that share no word go before the rest
    df = settle(df.select(*(["task"] if tasks is None else []), "id", "title", "rule", "scope", "priority", "triggers", "always_on"), {"_title": F.lower("title"), "_rule": F.lower("rule"), "_scope": F.lower("scope")})
    title, rule, scope = (F.col(c) for c in ("_title", "_rule", "_scope"))
    text = F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(rule, F.lit("")), F.nullif(scope, F.lit("")))
    flows = F.contains(title, F.lit("workflow")) | F.contains(rule, F.lit("workflow")) | F.contains(scope, F.lit("workflow"))
    df = settle(df, {"_text_words": words(text), "_title_words": words(title), "_trig": F.array_except("triggers", F.array(*map(F.lit, STOP))), "_flow": flows})
    of = lambda t: F.struct(t.alias("task"), F.lower(t).alias("_task"), words(F.lower(t)).alias("_words"))
    met = F.array(*[of(F.lit(t)) for t in tasks]) if tasks is not None else F.array(of(F.col("task")))
    df = df.select(*[c for c in df.columns if c != "task"], F.explode(met).alias("_t")).select("*", "_t.*").drop("_t")
    task, flow = F.col("_task"), F.col("_flow") & (F.contains(F.col("_task"), F.lit("workflow")) | F.contains(F.col("_task"), F.lit("wf")))
    stop = F.array(*map(F.lit, STOP))
    generic = F.array(*map(F.lit, GENERIC))
    tt, dt, trig = F.array_except("_words", stop), F.array_except("_text_words", stop), F.col("_trig")
    df = settle(df, {"_both": F.array_intersect(tt, F.array_union(dt, trig)), "_tset": F.array_intersect(tt, trig)})
    both, tset = F.col("_both"), F.col("_tset")
    df = df.where(F.coalesce(F.col("always_on"), F.lit(False)) | F.coalesce(F.col("scope") == "global", F.lit(True)) | F.coalesce(flow, F.lit(True)) | F.coalesce(F.size(both) > 0, F.lit(True)))
    ordered = lambda c: F.filter(c, lambda w: ~w.isin(STOP))
    pairs = lambda c: F.when(F.size(c) >= 2, F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat_ws(" ", F.element_at(c, i), F.element_at(c, i + 1)))).otherwise(F.array().cast("array<string>"))
    df = settle(df, {"_tt": ordered(F.col("_words")), "_dt": ordered(F.col("_text_words")), "_semantic": F.array_except(both, generic), "_tsem": F.array_except(tset, generic), "_tgen": F.array_intersect(tset, generic)})
    semantic, tsem, tgen = F.col("_semantic"), F.col("_tsem"), F.col("_tgen")
    common = F.array_intersect(pairs(F.col("_tt")), pairs(F.col("_dt")))
    df = settle(df, {"_phrase": F.exists(common, lambda p: ~F.forall(F.split(p, " "), lambda w: w.isin(GENERIC))), "_title_both": F.array_intersect("_title_words", "_words")})
    phrase = F.col("_phrase")
    on = F.coalesce(F.col("always_on"), F.lit(False)) | (F.col("scope") == "global")
    sem, tsem_any = F.size(semantic) > 0, F.size(tsem) > 0
    title_in = (title != "") & F.contains(task, title)
    title_both = F.col("_title_both")
    title_generic = (F.size(title_both) > 0) & (F.size(F.array_except(title_both, generic)) == 0)
    score = F.when((F.col("priority") == "critical") & (tsem_any | phrase), 8.0).when(tsem_any | phrase, 3.0).when(F.size(tgen) > 0, 1.0).otherwise(0.0)
    score = score + F.when(flow, 6.0).otherwise(0.0)
    score = score + F.when(title_in, F.when(title_generic, 1.0).otherwise(5.0)).when(F.size(both) > 0, F.when(sem | phrase, 2.0).otherwise(1.0)).otherwise(0.0)
    score = score + F.when((scope != "") & (F.contains(task, scope) | F.contains(task, F.translate(scope, "_", " "))), 4.0).otherwise(0.0)
    score = F.when(on, F.greatest(score, F.lit(8.0))).otherwise(score)
    kind = F.when(on, "global_always_on_directive").when(sem | phrase | flow, "semantic_directive_match").when(F.size(both) > 0, "generic_lexical_match").otherwise("weak_directive_match")
    signal = on | (phrase & sem) | (F.size(semantic) >= 2) | flow
    out = df.select("task", "id", score.alias("score"), kind.alias("class"), signal.alias("_s"), F.col("priority"))
    force = (F.col("class") == "global_always_on_directive") | ((F.col("priority") == "critical") & (F.col("class") == "semantic_directive_match") & (F.col("score") >= 4))
    return out.where("_s AND score > 0").select("task", "id", "score", "class", force.alias("can_force"))


def exclusion(path: Column, size: Column, binary: Column, ignored: list[str], most_bytes: int) -> Column:
    """Why a file is left out, by an ordered cascade; null for files that stay."""
    p = F.lower(path)
    out = F.when(F.contains(p, F.lit("..")), "path_traversal").when(p.rlike(r"(^|/)\.env(\.|$)|\.log$"), "mandatory").when(p.rlike(r"(^|/)(node_modules|\.git|dist|build|__pycache__)/"), "excluded_dir")
    for g in ignored:
        out = out.when(p.rlike(glob_regex(g)), "ignore_file")
    return out.when(p.rlike(r"(^|/)(package-lock\.json|yarn\.lock|poetry\.lock|uv\.lock)$"), "lockfile").when(size > most_bytes, "too_large").when(binary, "binary")


def glob_regex(glob: str) -> str:
    """A glob as a pattern of whole paths, made once on the driver. ** spans folders, a
    glob without a slash matches at any depth, one that ends with a slash all below."""
    body = glob.rstrip("/").lstrip("/")
    out = ""
    i = 0
    while i < len(body):
        if body[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    lead = "^" if "/" in body or glob.startswith("/") else "(?:^|.*/)"
    return lead + out + ("/.*" if glob.endswith("/") else "(?:/.*)?") + "$"
