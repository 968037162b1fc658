"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import setjoin as sj
from .shared import drop_table, materialize

SLACK = 3  # of 20: units keep about 25 % + 15 % of their shingles in the first pass


def _reaching_out(sets: DataFrame, slack: int | None) -> DataFrame:
    """Those of the sets (cid, n, root, tokens) that may link outside their group.

    Of the overlap of a set of n with such another, all are n-grams that two groups have: at
    least 3/4 n of the set, and of its smallest n-grams as many as ``setjoin.common`` says,
    which are looked at alone if slack is given.
    """
    n = F.col("n")
    need = F.floor((3 * n + 3) / 4).cast("int")
    tokens, least = F.col("tokens"), need
    if slack is not None:
        tokens = F.slice("tokens", 1, (n - need + 1 + F.floor(n * slack / 20)).cast("int"))
        least = 1 + F.floor(need * slack / 20)
    rows = sets.select("cid", "root", F.explode(tokens).alias("s"))
    shared = rows.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("s")
    met = rows.select("cid", "s").join(shared, "s").groupBy("cid").agg(F.count("*").alias("met"))
    return materialize(sets.join(met, "cid").where(F.col("met") >= least).drop("met"), "reaching-out", "none")


def incidence(sets: DataFrame) -> DataFrame:
    """(cid, root, n, own, g, w, before): classes by columns of n-grams.

    N-grams that exactly the same classes have are one column g of weight w. Columns of a class
    stand in order of rarity, after its ``own`` n-grams that no other group has; ``before``
    counts what stands before a column. Only columns are kept that begin among the first
    n-grams of which any linked class must share one.
    """
    rows = sets.select("cid", "root", "n", F.explode("tokens").alias("s"))
    mark = F.xxhash64("cid", F.lit(3)).cast("decimal(38,0)")
    grams = rows.groupBy("s").agg(F.count("*").alias("df"), F.sum(mark).alias("mark"), F.min("root").alias("x"), F.max("root").alias("y"))
    grams = grams.where("x != y").select("s", "df", F.xxhash64("df", "mark").alias("g"))
    columns = rows.join(grams, "s").groupBy("cid", "root", "n", "df", "g").agg(F.count("*").alias("w"))
    of = Window.partitionBy("cid")
    ahead = F.coalesce(F.sum("w").over(of.orderBy("df", "g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = columns.withColumn("own", F.col("n") - F.sum("w").over(of)).withColumn("before", F.col("own") + ahead)
    return materialize(placed.where(F.col("before") <= F.col("n") - F.floor((3 * F.col("n") + 3) / 4)).select("cid", "root", "n", "own", "g", "w", "before"), "incidence")


def product(rows: DataFrame) -> DataFrame:
    """(a, b): the pairs of classes of different groups whose counted overlap leaves a link
    possible, from the incidence multiplied with its transpose.

    Of two linked sets the smaller has a common column among its first seventh; of two equal
    sizes the one with more n-grams of its own, which has fewer columns there. A block is one
    column and two groups. Blocks whose bounds (sizes, and how large a set the best placed
    member can reach) leave no link possible are dropped before members are expanded, blocks
    within a group are never formed. Each product that the bounds let pass adds to its pair's
    count; what stands after the last common column bounds the rest.
    """
    n, left = F.col("n"), F.col("n") - F.col("before")
    key = F.struct("n", (-F.col("own")).alias("o"), "cid")
    reach = 7 * left - 3 * n  # 3 * size of the largest set it may still link with
    small = rows.where(7 * F.col("before") <= n)
    bounds = lambda k: [F.min("n").alias(f"least_{k}"), F.max("n").alias(f"most_{k}"), F.max(reach).alias(f"reach_{k}")]
    lows = small.groupBy("g", F.col("root").alias("ra")).agg(F.min(key).alias("low"), *bounds("a"))
    tops = rows.groupBy("g", F.col("root").alias("rb")).agg(F.max(key).alias("top"), *bounds("b"))
    blocks = lows.join(tops, "g").where("ra != rb AND low < top AND reach_a >= 3 * least_b AND reach_b >= 3 * least_a AND 4 * most_a >= 3 * least_b AND 4 * most_b >= 3 * least_a")
    blocks = blocks.select("g", "ra", "rb", "top", "least_b", "most_b", "reach_b")
    a = small.select("g", F.col("root").alias("ra"), key.alias("ka"), F.col("w"), F.col("before").alias("i"), reach.alias("reach"))
    met = blocks.join(a, ["g", "ra"]).where("ka < top AND reach >= 3 * least_b AND 3 * ka.n <= reach_b AND 4 * ka.n >= 3 * least_b AND 4 * most_b >= 3 * ka.n")
    b = rows.select("g", F.col("root").alias("rb"), key.alias("kb"), F.col("before").alias("j"))
    pairs = met.select("g", "rb", "ka", "w", "i").join(b, ["g", "rb"]).where((F.col("ka") < F.col("kb")) & sj.may_link(F.col("ka.n"), F.col("kb.n"), F.col("i"), F.col("j")))
    ends = [F.max(F.col(at) + F.col("w")).alias(at) for at in ("i", "j")]
    counted = pairs.groupBy(F.col("ka.cid").alias("a"), F.col("kb.cid").alias("b"), F.col("ka.n").alias("n"), F.col("kb.n").alias("m")).agg(F.sum("w").alias("c"), *ends)
    # past the last columns that met, at most the shorter rest can still be shared
    rest = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    return counted.where(7 * (F.col("c") + rest) >= 3 * (F.col("n") + F.col("m"))).select("a", "b")


def centres(sets: DataFrame) -> DataFrame:
    """Of each group the set that shares most with the others of its group, written out."""
    rows = sets.select("cid", "root", F.explode("tokens").alias("s"))
    common = rows.groupBy("root", "s").agg(F.count("*").alias("c")).where("c > 1")
    shared = rows.join(common, ["root", "s"]).groupBy("root", "cid").agg(F.sum("c").alias("c"))
    alone = sets.select("root", "cid", F.lit(0).cast("long").alias("c"))
    best = shared.unionByName(alone).groupBy("root").agg(F.max(F.struct("c", "cid")).alias("best")).select(F.col("best.cid").alias("cid"))
    return materialize(sets.join(best, "cid"), "centres", "none")


def missing_links(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Links that join all groups which any link joins, given the groups found so far.

    Classes with too few n-grams in common with other groups are left out first, which leaves
    few. Then the centres of groups meet, one of each: a class that is near the middle of a
    large family joins it by one link. What is still apart meets whole, all classes of a group
    with those of every other. Candidates of both rounds are verified exactly.
    """
    sets = sets.join(roots, "cid", "left").select("cid", "n", F.coalesce("root", "cid").alias("root"), "tokens")
    sets = _reaching_out(_reaching_out(sets, SLACK), None)
    first = sj.verify(product(incidence(centres(sets))), sets)
    group = sets.select("cid", "root")
    joined = first.join(group.toDF("a", "ra"), "a").join(group.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    merged = materialize(sj.components(joined).select(F.col("cid").alias("root"), F.col("root").alias("whole")), "merged")
    sets = sets.join(merged, "root", "left").select("cid", "n", F.coalesce("whole", "root").alias("root"), "tokens")
    sets = _reaching_out(sets, None)
    return first.unionByName(sj.verify(product(incidence(sets)), sets))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the size of its set of 5-word shingles,
    and the smallest id that is reachable by links of similarity 0.75 or more.

    Null and wordless texts have empty sets and link with nothing; with fewer than 5 words a
    text is one shingle; equal texts, and rows that repeat an id, link; null ids are ids like
    others that equal nothing, so a group of such rows alone has a null component; very long
    texts are read whole, hashed by blocks; other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text"))
    units = sj.scan(source, False, SLACK, id_col="id", text_col="_text")
    left = sj.classes(units, sj.Places(units), SLACK).where("open")
    rows = materialize(units.select("id", "cid", "n"), "rows")
    drop_table(units)
    sets = sj.full_sets(source, left, False, id_col="id", text_col="_text")
    links = sj.pivot_links(sets)
    links = links.unionByName(missing_links(sets, sj.components(links)))
    roots = materialize(sj.components(links), "roots")
    named = rows.join(roots, "cid", "left").select("id", "n", F.coalesce("root", "cid").alias("root"))
    named = materialize(named, "named")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    found = named.join(least, "root").select("id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    wordless = ~F.coalesce(F.col("_text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    empty = source.where(wordless).select("id", F.lit(0).cast("long").alias("n_shingles"), F.col("id").alias("component_id"))
    return found.unionByName(empty).withColumnRenamed("id", id_col)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
