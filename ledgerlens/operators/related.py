"""Graph update of documents (L5): links in texts become edges, edges and their reverse a section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import settle
from ..sources.scratch import fresh
from .pairs import RECIPROCAL

LINK = r"\[\[(?:([a-zA-Z0-9_]+):)?(concept_\d+)(?:\|([^\]]*))?\]\]"
HEADING = r"(?i)\n##\s+Related\b[^\n]*"


def parted(docs: DataFrame) -> DataFrame:
    """docs (text, ...) with _before (what stands before the related section), _section, and _after (what follows it from its
    next heading on), each worked out once."""
    docs = settle(docs, {"_before": F.regexp_extract("text", rf"(?s)\A(.*?)(?={HEADING}|\z)", 1)})
    docs = settle(docs, {"_rest": F.substr(F.col("text"), F.length("_before") + 1)})
    docs = settle(docs, {"_section": F.regexp_extract("_rest", r"(?s)\A(\n##\s[^\n]*.*?)(?=\n##\s|\z)", 1)})
    return settle(docs, {"_after": F.substr(F.col("_rest"), F.length("_section") + 1)}).drop("_rest")


def links(docs: DataFrame) -> DataFrame:
    """G1: (src, dst, type, own): the relation that each document (id, text) states to another that is there, the
    last one of its text; own: it stands outside of the related section, and counts before those in it."""
    ids = docs.select(F.col("id").alias("dst")).distinct()
    docs = settle(parted(docs.select("id", "text")), {"_outside": F.concat("_before", "_after")})

    def found(c: str, own: bool) -> Column:
        hits = F.regexp_extract_all(c, F.lit(LINK), F.lit(0))
        return F.transform(hits, lambda x, i: F.struct(F.coalesce(F.nullif(F.regexp_extract(x, LINK, 1), F.lit("")), F.lit("relates_to")).alias("type"), F.regexp_extract(x, LINK, 2).alias("dst"), F.lit(own).alias("own"), i.alias("at")))

    rows = docs.select(F.col("id").alias("src"), F.explode(F.concat(found("_outside", True), found("_section", False))).alias("l")).select("src", "l.*")
    rows = rows.join(ids, "dst", "left_semi")
    return rows.groupBy("src", "dst").agg(F.max(F.struct("own", "at", "type")).alias("l")).select("src", "dst", "l.type", "l.own")


def relations(stated: DataFrame) -> DataFrame:
    """(src, dst, type): one relation for each pair and direction: the one that is stated, else
    the reverse of what the other document states."""
    back = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RECIPROCAL.items() for x in kv]), F.col("type")), F.lit("relates_to"))
    reverse = stated.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.struct(F.lit(0).alias("p"), back.alias("type")).alias("t"))
    both = stated.select("src", "dst", F.struct(F.lit(1).alias("p"), F.col("type").alias("type")).alias("t")).unionByName(reverse)
    return both.groupBy("src", "dst").agg(F.max("t").alias("t")).select("src", "dst", "t.type")


def label(name: Column) -> Column:
    return F.initcap(F.regexp_replace(name, "[-_]", " "))


def splice(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, text, changed), (src, dst, type)) of documents (id, name, text): those with front matter and a
    relation get a section ``## Related Knowledge`` with a line for each, by target, in place of the
    one they have. All else stays byte for byte, but for blank space before the section; twice
    gives the same as once. A null text has no links and stays null. A section is as long as
    its document has relations.
    """
    aside = fresh(docs.sparkSession, "relations")  # read for the lines and by the caller
    relations(links(docs)).write.parquet(aside)
    edges = docs.sparkSession.read.parquet(aside)
    names = docs.select(F.col("id").alias("dst"), label(F.col("name")).alias("_n"))
    line = F.concat(F.lit("- [["), "type", F.lit(":"), "dst", F.lit("|"), "_n", F.lit("]] — "), "_n", F.lit(" ("), label(F.col("type")), F.lit(")"))
    listed = edges.join(names, "dst").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", line.alias("line")))).alias("_l"))
    lines = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    new = F.concat(F.regexp_replace("_before", r"\s++\z", ""), F.lit("\n\n## Related Knowledge\n"), lines, F.lit("\n"), "_after")
    fits = F.col("_l").isNotNull() & F.col("text").rlike(r"(?s)\A---\s*\n.*?\n---")
    out = settle(parted(docs).join(listed, "id", "left"), {"_new": F.when(fits, new).otherwise(F.col("text"))})
    return out.select("id", F.col("_new").alias("text"), (~F.col("_new").eqNullSafe(F.col("text"))).alias("changed")), edges
