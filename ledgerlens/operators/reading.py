"""What is read of a project by scope, its health, and a general concept's events told apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPES = ["project", "recent", "skills", "health"]
BLOCK_BYTES = 1 << 26  # of concepts' vectors that tasks hold at a time


def important(registry: DataFrame, limit: int) -> DataFrame:
    """(section, ord, text) of the concepts of greatest confidence times evidence."""
    weight = (F.col("confidence") * F.col("evidence")).alias("_w")
    top = registry.select("concept_id", "canonical_name", weight).orderBy(F.desc("_w"), "concept_id").limit(limit)
    return _listed(top, "concepts", F.desc("_w"), F.concat_ws(" ", F.coalesce("canonical_name", F.col("concept_id").cast("string")), F.concat(F.lit("("), F.col("_w").cast("string"), F.lit(")"))), "concept_id")


def _listed(rows: DataFrame, section: str, first, text, then: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(first, then))  # of at most the limit's rows
    return rows.select(F.lit(section).alias("section"), place.alias("ord"), text.alias("text"))


def recent_sessions(outcomes: DataFrame, limit: int) -> DataFrame:
    """(section, ord, text) of the last sessions (seq, session_id, outcome), newest first."""
    last = outcomes.select("seq", "session_id", "outcome").orderBy(F.desc("seq")).limit(limit)
    return _listed(last, "sessions", F.desc("seq"), F.concat_ws(" ", F.col("session_id").cast("string"), "outcome"), "session_id")


def health_report(registry: DataFrame, events: DataFrame, stale: DataFrame) -> DataFrame:
    """(finding, level, n) of what data checks find: names that several concepts have (A9), concepts without evidence, events
    without a concept or with one that the registry lacks, and stale concepts (A10). A finding of none has level ok."""
    names = registry.groupBy(F.lower(F.trim("canonical_name"))).count().where("count > 1")
    known = registry.select(F.col("concept_id").alias("concept"))
    found = [
        ("duplicate names", "warn", names.agg(F.count("*").alias("n"))),
        ("no evidence", "info", registry.agg(F.count_if(F.col("evidence") == 0).alias("n"))),
        ("unassigned events", "warn", events.agg(F.count_if(F.col("concept").isNull()).alias("n"))),
        ("unknown concepts", "error", events.where("concept IS NOT NULL").select("concept").distinct().join(known, "concept", "left_anti").agg(F.count("*").alias("n"))),
        ("stale concepts", "warn", stale.where("status = 'stale'").agg(F.count("*").alias("n"))),
    ]
    out = None
    for name, level, n in found:
        row = n.select(F.lit(name).alias("finding"), F.when(F.col("n") > 0, level).otherwise("ok").alias("level"), F.col("n").cast("long").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def read_scope(scope: str, registry: DataFrame, outcomes: DataFrame, skills: DataFrame, health: DataFrame, limit: int = 10) -> DataFrame:
    """(section, ord, text) of a scope: ``project`` has the important concepts and recent sessions, ``recent`` the sessions, ``skills`` the
    approved skills (slug, title, status) by slug, ``health`` the findings that are not ok. Raises for any other; nothing is written."""
    if scope not in SCOPES:
        raise ValueError(f"scope {scope}: one of {', '.join(SCOPES)}")
    if scope == "recent":
        return recent_sessions(outcomes, limit)
    if scope == "skills":
        rows = skills.where("status = 'approved'").select("slug", "title").orderBy("slug").limit(limit)
        return _listed(rows, "skills", F.asc("slug"), F.concat_ws(": ", "slug", "title"), "title")
    if scope == "health":
        return _listed(health.where("level != 'ok'"), "health", F.asc("finding"), F.concat_ws(" ", "level", "finding", F.col("n").cast("string")), "level")
    return important(registry, limit).unionByName(recent_sessions(outcomes, limit))


def split_general(events: DataFrame, concepts: DataFrame, embed: Callable[[list[str]], list], least: float = 0.75, chars: int = 512) -> DataFrame:
    """(event_id, concept_id, score, state) for the events (event_id, evidence) of a concept that is too general: the concept (concept_id,
    canonical_name) whose name is nearest to the first ``chars`` characters of the evidence by cosine, the first by id of equals;
    reassign from ``least`` on, else low_similarity, and no_evidence without a text. Names are embedded in tasks and
    held in blocks of at most BLOCK_BYTES, so events pass once per block; an event's best block wins."""

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embed(texts.tolist())))

    spark = events.sparkSession
    names = concepts.select("concept_id", vector(F.coalesce("canonical_name", F.col("concept_id").cast("string"))).alias("v"))
    kind = concepts.schema["concept_id"].dataType.simpleString()
    told = events.where("evidence != ''").select("event_id", vector(F.substring("evidence", 1, chars)).alias("v"))
    first = names.head()
    if first is None:
        return events.select("event_id", F.lit(None).cast(kind).alias("concept_id"), F.lit(None).cast("double").alias("score"), F.when(F.coalesce("evidence", F.lit("")) == "", "no_evidence").otherwise("low_similarity").alias("state"))
    per_block = max(1, BLOCK_BYTES // (8 * len(first["v"])))
    blocks = max(1, -(-names.count() // per_block))
    best = None
    for b in range(blocks):
        rows = names.where(F.pmod(F.xxhash64("concept_id"), F.lit(blocks)) == b).orderBy("concept_id").collect()
        if not rows:
            continue
        ids, m = [r["concept_id"] for r in rows], np.array([r["v"] for r in rows])
        size = np.sqrt((m * m).sum(1))
        held = spark.sparkContext.broadcast((ids, m / np.where(size > 0, size, 1)[:, None]))

        def nearest(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, m = held.value
            for x in batches:
                if len(x):
                    v = np.stack(x["v"].tolist())
                    size = np.sqrt((v * v).sum(1))
                    score = np.round(v / np.where(size > 0, size, 1)[:, None] @ m.T, 9)
                    at = score.argmax(1)
                    yield pd.DataFrame({"event_id": x["event_id"], "concept_id": [ids[k] for k in at], "score": score[np.arange(len(x)), at]})

        found = told.mapInPandas(nearest, f"event_id {events.schema['event_id'].dataType.simpleString()}, concept_id {kind}, score double")
        best = found if best is None else best.unionByName(found)
    top = best.groupBy("event_id").agg(F.max_by(F.struct("concept_id", "score"), F.struct("score", F.lit(0))).alias("b")) if blocks == 1 else best.groupBy("event_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "concept_id", "score")).alias("b"))
    state = F.when(F.coalesce("evidence", F.lit("")) == "", "no_evidence").when(F.col("b.score") >= least, "reassign").otherwise("low_similarity")
    return events.join(top, "event_id", "left").select("event_id", F.when(state == "reassign", F.col("b.concept_id")).alias("concept_id"), "b.score", state.alias("state"))
