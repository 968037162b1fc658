"""Instruction files as directives (S12, F30, L29, L31, J14, J19, J20, R15, D-4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import front_matter

# Names of instruction files, words of rules, and words that trigger nothing.
FILES = r"(?i)(^|/)(agents|claude|gemini)\.md$|(^|/)\.github/copilot-instructions\.md$|(^|/)(rules|workflows)/[^/]+\.mdc?$"
KEYWORDS = ["must", "never", "always", "required", "forbidden", "do not", "should", "shall"]
CRITICAL = ["must", "never", "required", "forbidden"]
NO_TRIGGER = "the and for you that this with from your must never always rules rule instructions directive should shall does done will before after required forbidden about".split()


def discover(files: DataFrame, most_bytes: int = 262_144) -> DataFrame:
    """The instruction files of (path, document), up to a size, each real path once: files of equal content in two
    folders both hold, each for its own; where a column ``real_path`` says that several paths lead to one
    file, the first of them does."""
    found = files.where(F.col("path").rlike(FILES) & (F.length("document") <= most_bytes)).withColumn("hash", F.sha2("document", 256))
    real = F.coalesce("real_path", "path") if "real_path" in files.columns else F.col("path")
    first = found.groupBy(real.alias("_real")).agg(F.min("path").alias("path"))
    return found.join(first.select("path"), "path", "left_semi").dropDuplicates(["path"])


def triggers(section: Column, rule: Column) -> Column:
    """the words of three letters or more of a section's title and a rule, sorted."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", section, rule)), F.lit(r"\b([a-z0-9_\-]{3,})\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~w.isin(NO_TRIGGER))))


def globs(rule: Column) -> Column:
    """file names and patterns in a rule, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(rule, F.lit(r"\b([a-zA-Z0-9_\-.*/]+\.[a-zA-Z0-9_*]+)\b"), F.lit(1))))


def parse(files: DataFrame) -> DataFrame:
    """The directives of (path, document): list items and lines with a word of rules,
    of ten characters or more, outside fences, each with its section's title and scope. Scope,
    priority and triggers of the front matter come first. A file's lines are read in its row."""
    meta = front_matter(F.col("document"))
    body = F.regexp_replace(F.col("document"), r"(?s)\A---\s*\n.*?\n(?:---|\.\.\.)\s*(?:\n|\z)", "")
    offset = F.size(F.split("document", "\n", -1)) - F.size(F.split(body, "\n", -1))
    rows = files.select("path", meta.alias("_m"), offset.alias("_o"), F.posexplode(F.split(body, "\n", -1)).alias("_i", "_l")).withColumn("_l", F.trim("_l"))
    here = Window.partitionBy("path").orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("_l").startswith("```")
    inside = F.sum(F.when(fence, 1).otherwise(0)).over(here) % 2 == 1
    rows = rows.withColumn("_code", inside | fence)
    heading = F.when(~F.col("_code"), F.nullif(F.regexp_extract("_l", r"^#{1,6}\s+(.+)$", 1), F.lit("")))
    rows = rows.withColumn("_h", heading).withColumn("section", F.coalesce(F.last("_h", ignorenulls=True).over(here), F.lit("General")))
    item = F.regexp_extract("_l", r"^(?:[-*+]\s+(?:\[[ xX/]\]\s*)?|\d+\.\s+)(.+)$", 1)
    keyword = F.lower("_l").rlike(r"\b(" + "|".join(KEYWORDS) + r")\b")
    rows = rows.where(~F.col("_code") & F.col("_h").isNull() & (F.col("_l") != "") & ((item != "") | keyword))
    rows = rows.withColumn("rule", F.when(item != "", F.trim(item)).otherwise(F.col("_l"))).where(F.length("rule") >= 10)
    of = lambda k: F.nullif(F.try_element_at("_m", F.lit(k)), F.lit(""))
    low = F.lower("rule")
    scope = F.nullif(F.regexp_replace(F.regexp_replace(F.lower("section"), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(""))
    forbidden = F.nullif(F.regexp_replace(F.lower(F.trim(F.regexp_extract("rule", r"(?i)(?:never|do not)\s+([a-zA-Z0-9_\-\s]+)", 1))), r"\s+", "_"), F.lit(""))
    more = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(of("triggers"), F.lit("")), r"[\[\]\"']", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    critical = F.lit(False)
    for w in CRITICAL:
        critical = critical | low.contains(w)
    return rows.select(
        F.concat(F.lit("directive_"), F.substring(F.sha2(F.concat_ws("|", "path", low), 256), 1, 12)).alias("id"),
        "path",
        (F.col("_i") + F.col("_o") + 1).alias("line_no"),
        F.col("section").alias("title"),
        "rule",
        F.coalesce(of("scope"), scope, F.lit("general")).alias("scope"),
        F.coalesce(of("priority"), F.when(critical, "critical").otherwise("normal")).alias("priority"),
        F.array_sort(F.array_union(triggers(F.col("section"), F.col("rule")), more)).alias("triggers"),
        globs(F.col("rule")).alias("globs"),
        F.concat(F.array_compact(F.array(forbidden)), globs(F.col("rule"))).alias("forbidden"),
        F.coalesce(F.lower(of("always_on")).isin("true", "yes", "1"), F.lit(False)).alias("always_on"),
    )


def best_of_each(matches: DataFrame) -> DataFrame:
    """D-4: of matches (task, id, title, path, score) one for each id, title and path, the best."""
    order = Window.partitionBy("task", "id", "title", "path").orderBy(F.desc("score"), "rule")
    return matches.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def stale(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(path, state) of indexed sources (path, hash) that are gone or changed."""
    now = files.select("path", F.sha2("document", 256).alias("_now"))
    j = sources.join(now, "path", "left").where(~F.col("hash").eqNullSafe(F.col("_now")))
    return j.select("path", F.when(F.col("_now").isNull(), "missing").otherwise("changed").alias("state"))


def related_hits(directives: DataFrame, matched: Column) -> Column:
    """Whether a directive's related ids meet those of the task's skills and concepts."""
    return F.arrays_overlap(directives["related"], matched)


def applied(matches: DataFrame, directives: DataFrame, direct: DataFrame) -> DataFrame:
    """Recorded matches (task, directive_id) with their directives; a task without records
    gets its direct matches (task, id, ...)."""
    kept = matches.join(directives, matches["directive_id"] == directives["id"]).select("task", *directives.columns)
    rest = direct.join(matches.select("task").distinct(), "task", "left_anti")
    return kept.unionByName(rest.select(kept.columns), allowMissingColumns=True)


def workflow(matches: DataFrame, keyword_rules: list[tuple[list[list[str]], str]]) -> DataFrame:
    """(task, workflow) by the first matched scope that names a workflow, in order of rank;
    else by the first keyword rule: groups of words, of each of which one is in the task."""
    scoped = matches.where(F.col("scope").contains("workflow")).groupBy("task").agg(F.min_by("scope", "rank").alias("_w"))
    guess = F.lit(None).cast("string")
    for groups, name in reversed(keyword_rules):
        fits = F.lit(True)
        for group in groups:
            any_of = F.lit(False)
            for w in group:
                any_of = any_of | F.lower("task").contains(w)
            fits = fits & any_of
        guess = F.when(fits, name).otherwise(guess)
    return matches.select("task").distinct().join(scoped, "task", "left").select("task", F.coalesce("_w", guess).alias("workflow"))


def render(directives: DataFrame, most_chars: int = 6000) -> DataFrame:
    """One text with a line for each directive, critical ones first, cut at a size."""
    line = F.concat(F.lit("- ["), F.col("priority"), F.lit("] "), F.col("rule"), F.lit(" ("), F.col("path"), F.lit(":"), F.col("line_no").cast("string"), F.lit(")"))
    order = F.struct((F.col("priority") != "critical").alias("p"), "path", "line_no", line.alias("l"))
    lines = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["l"])
    text = F.array_join(lines, "\n")
    return directives.agg(F.when(F.length(text) > most_chars, F.concat(F.substring(text, 1, most_chars), F.lit("\n[truncated]"))).otherwise(text).alias("text"), F.count("*").alias("n"))


def update_candidates(changes: DataFrame) -> DataFrame:
    """Proposed changes (path, rule, reason) with an id from their content, each once."""
    return changes.withColumn("id", F.concat(F.lit("update_"), F.substring(F.sha2(F.concat_ws("|", "path", "rule"), 256), 1, 12))).dropDuplicates(["id"])
