"""Ordered ignore rules in files of folders, mandatory exclusions and include lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is never indexed.
NEVER_FOLDERS = [".git", "node_modules", "dist", "build", "coverage", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".cache"]
NEVER_SUFFIXES = ["png", "jpg", "jpeg", "gif", "webp", "bmp", "ico", "mp4", "mov", "avi", "mkv", "mp3", "wav", "flac", "zip", "tar", "gz", "7z", "rar", "pdf", "exe", "dll", "so", "dylib", "class", "jar", "pyc", "wasm", "ttf", "woff", "woff2"]


def ignore_pattern(glob: str) -> str:
    """The pattern, for a path below the rule file's folder, of an ignore rule's glob: ``*`` and ``?`` stay within a folder,
    ``**`` spans folders, brackets are sets. A glob with a slash but at its end holds from that
    folder on, one without for names at any depth."""
    body = glob.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    out, i = "", 0
    while i < len(body):
        rest = body[i:]
        if rest.startswith("**/") and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif rest == "**" and (i == 0 or body[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and (close := body.find("]", i + 2)) > 0:
            inner = body[i + 1 : close].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", close + 1
        elif rest[0] == "\\" and i + 1 < len(body):
            out, i = out + re.escape(body[i + 1]), i + 2
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$"


def parse_rules(files: DataFrame) -> DataFrame:
    """(folder, rules) of ignore files (folder, content): each line's pattern, whether it takes back what others
    ignore (!), and whether it is for folders only (/ at the end), in order. Blank lines and
    comments are no rules; \\! and \\# begin names. The root's folder is the empty string."""

    @F.pandas_udf("string")
    def pattern(globs: pd.Series) -> pd.Series:
        return globs.map(ignore_pattern)

    lines = files.select("folder", "file_order", F.posexplode(F.split("content", r"\r?\n")).alias("line", "raw")) if "file_order" in files.columns else files.select("folder", F.lit(0).alias("file_order"), F.posexplode(F.split("content", r"\r?\n")).alias("line", "raw"))
    text = F.regexp_replace("raw", r"(?<!\\)\s+$", "")
    rows = lines.select("folder", "file_order", "line", text.alias("t")).where("t != '' AND NOT startswith(t, '#')")
    negated = F.col("t").startswith("!")
    rows = rows.withColumn("g", F.when(negated, F.substring("t", 2, 1 << 30)).otherwise(F.col("t"))).where("g NOT IN ('', '/')")
    rule = F.struct("file_order", "line", pattern("g").alias("pattern"), negated.alias("negated"), F.col("g").endswith("/").alias("folders_only"))
    return rows.groupBy("folder").agg(F.array_sort(F.collect_list(rule)).alias("rules"))


def ignored_by_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(path, ignored) of distinct paths (path) under rules (folder, rules): of the rules in the path's folders from the root on
    the last that matches counts; nothing below an ignored folder can be taken back.

    Each folder is judged once, however many paths it holds: paths meet their folders and
    folders their rule files by equi-joins.
    """
    parts = F.split("path", "/")
    pieces = lambda c, n: F.array_join(F.slice(c, 1, n), "/")
    upto = lambda c, most: F.when(most >= 1, F.transform(F.sequence(F.lit(1), most), lambda n: pieces(c, n))).otherwise(F.array().cast("array<string>"))
    names = paths.select("path").distinct()
    folders = names.select(F.explode(upto(parts, F.size(parts) - 1)).alias("name")).distinct().withColumn("is_folder", F.lit(True))
    every = folders.unionByName(names.select(F.col("path").alias("name"), F.lit(False).alias("is_folder")))
    of = F.split("name", "/")
    above = every.select("name", "is_folder", F.explode(F.concat(F.array(F.lit("")), upto(of, F.size(of) - 1))).alias("folder")).join(rules, "folder")
    below = F.when(F.col("folder") == "", F.col("name")).otherwise(F.substr("name", F.length("folder") + 2))
    hit = F.filter("rules", lambda r: (~r["folders_only"] | F.col("is_folder")) & F.regexp(below, r["pattern"]))
    last = above.withColumn("_h", hit).where(F.size("_h") > 0).select("name", "is_folder", F.length("folder").alias("depth"), F.element_at("_h", -1)["negated"].alias("negated"))
    judged = last.groupBy("name", "is_folder").agg(F.max_by("negated", "depth").alias("negated")).where("NOT negated")
    closed = names.select("path", F.explode(upto(parts, F.size(parts) - 1)).alias("name")).join(judged.where("is_folder").select("name"), "name").select("path").distinct()
    own = judged.where("NOT is_folder").select(F.col("name").alias("path"))
    gone = closed.unionByName(own).distinct().withColumn("_i", F.lit(True))
    return names.join(gone, "path", "left").select("path", F.coalesce("_i", F.lit(False)).alias("ignored"))


def mandatory_reason(path: Column, tool_folder: str) -> Column:
    """Why a path is never indexed, whatever the rules say; null if it may be."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    return (
        F.when(F.exists(parts, lambda p: p.isin([*NEVER_FOLDERS, tool_folder])), "mandatory_excluded_directory")
        .when((name == ".env") | name.startswith(".env.") | name.endswith(".env"), "secret_env_file")
        .when(name.endswith(".log"), "log_file")
        .when(F.regexp_extract(name, r".\.([^.]+)$", 1).isin(NEVER_SUFFIXES), "unsupported_binary_or_media")
    )


def included(path: Column, include: list[str]) -> Column:
    """Whether a path is in one of the globs of the include list; an empty list includes all."""
    out = F.lit(not include)
    for g in include:
        out = out | path.rlike(ignore_pattern(g if g.startswith("/") or "/" in g else "/" + g))
    return out


def eligible(paths: DataFrame, rule_files: DataFrame, include: list[str], tool_folder: str = ".tool") -> DataFrame:
    """(path, reason) of distinct paths, null for those to index: outside the root, mandatory, not
    included, or ignored, the first that applies."""
    outside = F.col("path").startswith("/") | F.exists(F.split("path", "/"), lambda p: p == "..")
    judged = ignored_by_rules(paths, parse_rules(rule_files))
    reason = F.when(outside, "outside_project").when(mandatory_reason(F.col("path"), tool_folder).isNotNull(), mandatory_reason(F.col("path"), tool_folder)).when(~included(F.col("path"), include), "not_included").when(F.col("ignored"), "ignore_file")
    return judged.select("path", reason.alias("reason"))
