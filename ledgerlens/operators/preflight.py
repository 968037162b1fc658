"""The decision before a task and what is handed to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import memory as M

REQUIRED, SUGGEST = 8.0, 4.0  # fixed values


def clamp(limit: int | None, default: int = 8, most: int = 20) -> tuple[int, list[str]]:
    """a limit from 1 to ``most``, with a warning if it was another."""
    if limit is None:
        return default, []
    ok = min(most, max(1, limit))
    return ok, [] if ok == limit else [f"limit {limit} taken as {ok}"]


def like_any(chunks: DataFrame, query: str, most: int = 200) -> DataFrame:
    """Chunks (chunk_id, document) with any of the first eight words, the first by id."""
    terms = list(dict.fromkeys(M.query_terms(query)))[:8]
    hit = M._any(F.lower("document").contains(t) for t in terms)
    return chunks.where(hit).orderBy("chunk_id").limit(most)


def candidates(task: str, chunks: DataFrame, retriever: Callable[[str, int], DataFrame] | None = None, k: int = 20) -> DataFrame:
    """What a retriever (id, document, base) finds, else the chunks that have a word."""
    if retriever is not None:
        return retriever(task, k)
    return like_any(chunks, task).select(F.col("chunk_id").alias("id"), "document", F.lit(0.0).alias("base"))


def matched_memory(task: str, found: DataFrame) -> DataFrame:
    """Found memories ranked without their base, the weak ones left out, with
    relevance and reason; and those that were left out by reason (A16)."""
    targets = M.Targets.of(task)
    ranked = M.rerank(found.withColumn("base", F.lit(0.0)), targets).withColumn("weak", M.weak(targets)).where("final_score > 0")
    return ranked.withColumn("relevance", M.relevance(targets, M.is_continuation(task))).withColumn("title", M.title_of(F.col("document"))).withColumn("reason", M.reason_code(F.col("memory_type"), F.col("boosts")))


def sorted_matches(rows: DataFrame) -> DataFrame:
    """O3: by score, title, id and path."""
    return rows.orderBy(F.desc("score"), F.lower(F.trim("title")), "id", "path")


def decide(s: DataFrame) -> DataFrame:
    """(task, decision, reason) from one row of facts for each task; the first rule that
    fires decides.

    Facts: blocked, error, generic, n_conflicts, active_item, continuation, strong, medium,
    all_weak, best, best_kind (skill, concept or memory), best_type, forcing, semantic_directive
    (its score), work_score, n_memory, top5 (sum of the best five memories).
    """
    c = F.col
    fits = (c("best_kind") != "memory") | c("best_type").isin("decision", "failure", "outcome")
    rules = [
        (c("error"), "error", "exception"),
        (c("blocked"), "blocked", "project_unresolved"),
        (c("generic") & (c("n_conflicts") >= 3), "required", "active_work_conflict"),
        (c("generic"), "suggest", "active_work"),
        (c("strong"), "required", "strong_memory"),
        ((c("best") >= REQUIRED) & fits, "required", "strong_match"),
        (c("forcing"), "required", "forcing_directive"),
        (c("continuation") & c("active_item"), "required", "continuation_of_active_work"),
        ((c("best") >= SUGGEST) & ((c("best_kind") != "memory") | ~c("all_weak")), "suggest", "good_match"),
        (c("medium") & ~c("all_weak"), "suggest", "medium_memory"),
        (c("semantic_directive") >= SUGGEST, "suggest", "semantic_directive"),
        (c("work_score") >= 2, "suggest", "active_work_signals"),
        ((c("n_memory") >= 3) & ~c("all_weak") & (c("top5") >= REQUIRED), "suggest", "several_memories"),
        (c("n_conflicts") >= 3, "required", "active_project_conflict"),
        (c("n_conflicts") == 2, "suggest", "active_project_conflict"),
    ]
    decision, reason = F.lit("noop"), F.lit("no_relevant_context")
    for when, d, r in reversed(rules):
        decision, reason = F.when(F.coalesce(when, F.lit(False)), d).otherwise(decision), F.when(F.coalesce(when, F.lit(False)), r).otherwise(reason)
    return s.select("task", decision.alias("decision"), reason.alias("reason"))


def best_match(rows: DataFrame) -> DataFrame:
    """(task, best, best_kind, best_type) of matches (task, kind, type, ord, score): the first
    strict maximum over skills, concepts and memory, in that order."""
    turn = F.when(F.col("kind") == "skill", 0).when(F.col("kind") == "concept", 1).otherwise(2)
    b = F.min_by(F.struct("score", "kind", "type"), F.struct((-F.col("score")).alias("s"), turn.alias("k"), "ord"))
    return rows.groupBy("task").agg(b.alias("b")).select("task", F.col("b.score").alias("best"), F.col("b.kind").alias("best_kind"), F.coalesce("b.type", F.lit("")).alias("best_type"))


def memory_facts(rows: DataFrame, targets: M.Targets) -> DataFrame:
    """The facts of a task's kept memories (task, relevance, final_score, ...) in one row:
    only the best five scores are gathered."""
    level = lambda x: F.coalesce(F.bool_or(F.col("relevance") == x), F.lit(False))
    from pyspark.sql import Window

    order = Window.partitionBy("task").orderBy(F.desc("final_score"), "id")
    # filtered by its place, so tasks keep five of their rows and no more are sorted in one place
    five = rows.select("task", "final_score", "id").withColumn("_r", F.row_number().over(order)).where("_r <= 5").groupBy("task").agg(F.coalesce(F.sum("final_score"), F.lit(0.0)).alias("top5"))
    of = rows.groupBy("task").agg(level("strong").alias("strong"), level("medium").alias("medium"), M.only_weak(targets).alias("all_weak"), F.count("*").alias("n_memory"))
    return of.join(five, "task").select("task", "strong", "medium", "all_weak", "n_memory", "top5")


def render(task: Column, decision: Column, reason: Column, skills: Column, concepts: Column, memories: Column, sources: Column, caps: tuple[int, int, int, int] = (3, 5, 5, 3), most_chars: int = 6000) -> Column:
    """F42, D-10: the context of a task: sections of titles, cut at their caps, retrievals that
    suggest themselves, each once, and the whole cut at a size with a mark."""
    part = lambda name, xs, n: F.when(F.size(xs) > 0, F.concat(F.lit(f"\n\nRelevant {name}:\n"), F.array_join(F.transform(F.slice(xs, 1, n), lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    asks = F.array_distinct(F.concat(F.transform(F.slice(concepts, 1, caps[1]), lambda x: F.concat(F.lit("- search: "), x)), F.transform(F.slice(sources, 1, caps[3]), lambda x: F.concat(F.lit("- source search: "), x))))
    text = F.concat(F.lit("# Preflight context\n\nTask: "), task, F.lit("\nDecision: "), decision, F.lit("\nReason: "), reason, part("skills", skills, caps[0]), part("concepts", concepts, caps[1]), part("memory", memories, caps[2]), F.when(F.size(asks) > 0, F.concat(F.lit("\n\nSuggested next retrieval:\n"), F.array_join(asks, "\n"))).otherwise(""))
    mark = "\n\n[context truncated]"
    return F.when(F.length(text) <= most_chars, text).otherwise(F.concat(F.rtrim(F.substring(text, 1, max(0, most_chars - len(mark)))), F.lit(mark)))
