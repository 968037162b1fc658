"""What a project is working on, from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels and the field that each fills; null: its value's shape decides.
LABELS = {
    "workspace root": "workspace_root", "project root": "workspace_root", "memory root": "memory_root",
    "active work item": "active_work_item", "active file": "active_work_item", "open file": "active_work_item", "current file": "active_work_item", "primary file": "active_work_item",
    "active project": None, "open project": None, "current project": None, "project": None, "primary objective": None,
    "active topic": "active_topic", "current topic": "active_topic", "active task": "active_task", "next action": "active_task",
}
FILE = r"([\w./-]*[\w-]\.(?:md|py|ts|tsx|js|json|ya?ml|toml|rst|txt|go|rs|java|sql|sh))\b"
VERB = r"(?i)^(add|fix|write|update|implement|review|refactor|continue|create|remove|test|check|build|run|make|finish|investigate|document)\b"
LEVEL = {"high": 3, "medium": 2, "low": 1}


def path(c: Column) -> Column:
    """slashes one way, drives and shares of another system as mounts, no slash at the end."""
    p = F.regexp_replace(F.translate(F.trim(c), "\\", "/"), "(?<!^)/{2,}", "/")
    drive = F.regexp_extract(p, r"^([A-Za-z]):/?", 1)
    p = F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.lit("/"), F.regexp_replace(p, r"^[A-Za-z]:/?", ""))).otherwise(F.regexp_replace(p, r"^//wsl(?:\$|\.localhost)/[^/]+", ""))
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)


def shape(value: Column, memory_folder: str = ".kb") -> Column:
    """F32: the field that a value fills, by its shape: roots are absolute folders, items paths
    or file names, tasks begin with a verb, topics are a few words."""
    v = F.trim(value)
    absolute = v.rlike(r"^(/|~|[A-Za-z]:[\\/])")
    name = F.element_at(F.split(F.regexp_replace(v, "/+$", ""), "/"), -1)
    return (
        F.when(F.coalesce(v, F.lit("")) == "", "unknown")
        .when(absolute & name.endswith(memory_folder), "memory_root")
        .when(absolute & ~name.contains("."), "workspace_root")
        .when(v.rlike("^" + FILE + "$") | (v.contains("/") & ~v.rlike(r"\s")), "active_work_item")
        .when(v.rlike(VERB), "active_task")
        .when(F.size(F.split(v, r"\s+")) <= 6, "active_topic")
        .otherwise("unknown")
    )


def labelled(texts: DataFrame) -> DataFrame:
    """(key, field, value, confidence) of the labels in texts (key, text): the first line
    of each. A next action fills the task, and the item if it names a file, with less
    confidence; projects and objectives fill what their shape says."""
    found = [F.struct(F.lit(label).alias("label"), F.trim(F.regexp_extract("text", rf"(?im)^\s*(?:[-*]\s+)?{label.replace(' ', r'\s+')}\s*:\s*(.+?)\s*$", 1)).alias("value")) for label in LABELS]
    rows = texts.select("key", F.explode(F.array(*found)).alias("x")).select("key", "x.*").where("value != ''")
    fixed = F.element_at(F.create_map(*[F.lit(x) for k, v in LABELS.items() for x in (k, v or "")]), F.col("label"))
    kind = shape(F.col("value"))
    guess = F.when(kind != "unknown", kind).when((F.col("label") == "primary objective") | ~F.col("value").contains("/"), "active_topic").otherwise("active_work_item")
    base = rows.select("key", "label", F.when(fixed == "", guess).otherwise(fixed).alias("field"), "value", F.when(F.col("label") == "next action", "medium").otherwise("high").alias("confidence"))
    item = rows.where("label = 'next action'").select("key", "label", F.lit("active_work_item").alias("field"), F.regexp_extract("value", FILE, 1).alias("value"), F.lit("medium").alias("confidence")).where("value != ''")
    return base.unionByName(item)


def from_json(rows: DataFrame) -> DataFrame:
    """(key, field, value, confidence) of handoffs and outcomes (key, raw) in JSON, under
    their present names and those of before."""
    names = {"active_work_item": ["active_work_item", "active_file", "current_file"], "active_topic": ["active_topic", "active_project", "project"], "active_task": ["active_task", "next_action", "task"], "workspace_root": ["workspace_root", "project_root"]}
    value = {f: F.coalesce(*[F.nullif(F.get_json_object("raw", f"$.{n}"), F.lit("")) for n in ns]) for f, ns in names.items()}
    return rows.select("key", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in value.items()])).alias("x")).select("key", "x.*", F.lit("medium").alias("confidence")).where("value IS NOT NULL")


def identity(rows: DataFrame) -> DataFrame:
    """Of candidates (key, field, source, ord, value, confidence) the most confident of
    each field, the first of these; with how many values of high confidence differ: two warn,
    three are an error."""
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVEL.items() for x in kv]), F.col("confidence")), F.lit(0))
    best = F.min(F.struct((-level).alias("l"), "ord", "source", "value")).alias("b")
    n = F.count_distinct(F.when(level >= 2, F.lower(F.trim("value")))).alias("n_values")
    g = rows.where("value IS NOT NULL AND value != ''").groupBy("key", "field").agg(best, n)
    return g.select("key", "field", "b.value", "b.source", "n_values", F.when(F.col("n_values") >= 3, "error").when(F.col("n_values") == 2, "warning").otherwise("none").alias("conflict"))


def legacy_project(picked: DataFrame) -> DataFrame:
    """(key, latest_project, selected_source, severity) as one value: the item, else the
    topic, with the worst conflict of all fields."""
    turn = F.when(F.col("field") == "active_work_item", 0).when(F.col("field") == "active_topic", 1)
    first = F.min(F.when(turn.isNotNull(), F.struct(turn.alias("t"), "value", "source"))).alias("b")
    worst = F.max(F.when(F.col("conflict") == "error", 2).when(F.col("conflict") == "warning", 1).otherwise(0)).alias("w")
    return picked.groupBy("key").agg(first, worst).select("key", F.col("b.value").alias("latest_project"), F.col("b.source").alias("selected_source"), F.when(F.col("w") == 2, "error").when(F.col("w") == 1, "warning").otherwise("none").alias("severity"))


def work_score(signals: DataFrame) -> DataFrame:
    """(key, score) of signals (key, weight): their sum, 10 at most."""
    return signals.groupBy("key").agg(F.least(F.sum("weight"), F.lit(10.0)).alias("score"))


def first_distinct(lists: DataFrame, cap: int) -> DataFrame:
    """(key, items) of lists (key, ord, items) put together in order, each item once, the
    first ``cap``."""
    return lists.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "items"))).alias("l")).select("key", F.slice(F.array_distinct(F.flatten(F.transform("l", lambda x: x["items"]))), 1, cap).alias("items"))


def todo_advance(todos: DataFrame, changes: DataFrame) -> DataFrame:
    """Todos (list, ord, id, status) after changes (list, id, status): a change sets a
    status, an empty one goes to the next (pending, in_progress, completed, pending); where
    one is completed and none is in progress, the first pending one is begun."""
    j = todos.join(changes.select("list", "id", F.col("status").alias("_to"), F.lit(True).alias("_c")), ["list", "id"], "left")
    turn = F.when(F.col("status") == "pending", "in_progress").when(F.col("status") == "in_progress", "completed").otherwise("pending")
    new = F.when(F.col("_c"), F.when(F.coalesce("_to", F.lit("")) == "", turn).otherwise(F.col("_to"))).otherwise(F.col("status"))
    rows = j.withColumn("_new", new)
    w = Window.partitionBy("list")
    done = F.max(F.coalesce(F.col("_c"), F.lit(False)) & (F.col("_new") == "completed") & (F.col("status") != "completed")).over(w)
    busy = F.max(F.col("_new") == "in_progress").over(w)
    first = F.min(F.when(F.col("_new") == "pending", F.col("ord"))).over(w)
    return rows.select("list", "ord", "id", F.when(done & ~busy & (F.col("_new") == "pending") & (F.col("ord") == first), "in_progress").otherwise(F.col("_new")).alias("status"))
