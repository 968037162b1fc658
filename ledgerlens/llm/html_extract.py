"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node stands for a path of block elements below
the body with their presentation (tag, classes, id without digits). Pages that are the same
count once. A node's importance comes from entropies over the host's pages: how much the
presentation of its children varies, and how little its content (blocks of text and link
targets) repeats from page to page. The characters that do not repeat are the node's mass; the
main branch follows the containers that hold most of the host's mass. Branches of low
importance are taken out of every page. Importance is weighed with three features: that of the
same path over all hosts (hosts with few pages lean on it), the share of the mass for branches
that stand beside the main branch, and names that authors give to parts of a page, which raise
or lower it by a factor but never touch the main branch itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, small_batches, with_columns

# Fixed vocabularies of HTML.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NO_TEXT = frozenset("applet audio base button canvas col datalist embed head iframe input link meta noembed noframes noscript option param script select source style svg template textarea title track video".split())
_RAW = frozenset("script style template textarea title iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
_FENCES = frozenset("ul ol dl table menu".split())
# Names that web authors give to parts of a page; whole tokens of tags, classes and ids.
_ASIDE = frozenset("ad ads adsense advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus dialog footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split())
_ARTICLE = frozenset("article articlebody content entry main post story".split())

# What HTML lets stand in a head: any other tag ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_CONTAINERS = "article|center|div|form|main|section|table|tbody|td|tr"

# GAMMA weighs presentation against content; a branch beside the main one counts BESIDE times its share of the mass.
GAMMA, PRIOR_PAGES, LEAST, WRAPS, BESIDE = 0.9, 8, 0.2, 0.8, 4.0
NAMED_ASIDE, NAMED_ARTICLE = 0.1, 4.0
_SPACE = re.compile(r"\s+")


class Page(HTMLParser):
    """The blocks of a page in order, each with its style path: (path, text, linked characters)."""

    def __init__(self, html: str, shown: dict[str, int] | None = None):
        """shown: hiding tags that hide nothing, each from the start of which number on, because nothing closes it."""
        super().__init__(convert_charrefs=True)
        self.shown, self.starts, self.within = shown or {}, 0, Counter()
        self.open: list[str] = []
        self.styles: list[str] = []
        self.children: dict[str, list[str]] = {}
        self.targets: list[tuple[str, str]] = []
        self.blocks: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.hidden = ""
        self.depth = 0
        self.feed(html)
        self.close()
        self.flush()

    def path(self) -> str:
        return "/".join(self.styles)

    def flush(self) -> None:
        if self.text:
            whole = _SPACE.sub(" ", "".join(self.text)).strip()
            if whole:
                self.blocks.append((self.path(), whole))
            self.text = []

    def pop_to(self, at: int) -> None:
        self.flush()
        del self.open[at:], self.styles[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.hidden == "head" and tag not in _IN_HEAD and tag != "head":
            self.hidden = ""
        if self.hidden:
            self.depth += tag == self.hidden
            self.within[tag] += tag not in _VOID
            return
        if tag in ("html", "body"):
            self.flush()
            return
        if tag in ("br", "img", "wbr"):
            self.text.append(" ")
            return
        if tag in _NO_TEXT:
            if tag not in _VOID:
                self.starts += 1
                if self.starts < self.shown.get(tag, 1 << 62):
                    self.hidden, self.depth = tag, 1
                    self.within.clear()
            return
        if tag in _INLINE:
            if tag == "a" and (to := dict(attrs).get("href")):
                self.targets.append((self.path(), to))
            return
        if tag in _ENDS_P and "p" in self.open:
            self.pop_to(len(self.open) - 1 - self.open[::-1].index("p"))
        if tag in _SIBLINGS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k] in _SIBLINGS[tag]:
                    self.pop_to(k)
                    break
                if self.open[k] in _FENCES:
                    break
        self.flush()
        given = dict(attrs)
        names = sorted((given.get("class") or "").split()) + [given.get("id") or ""]
        style = ".".join([tag, *(re.sub(r"\d+|[/.]", "", x).lower() for x in names if x)])
        self.children.setdefault(self.path(), []).append(style)
        if tag not in _VOID:
            self.open.append(tag)
            self.styles.append(style)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID or tag not in _NO_TEXT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden:
                self.depth -= 1
                self.hidden = self.hidden if self.depth else ""
            elif tag in ("head", "body", "html"):
                self.hidden = ""
            elif self.within[tag] > 0:
                self.within[tag] -= 1
            elif tag in self.open and tag not in _INLINE:  # what encloses the hidden part ends, and ends it too
                self.hidden = ""
                self.handle_endtag(tag)
        elif tag in ("html", "body"):
            self.pop_to(0)
        elif tag in self.open:
            self.pop_to(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)

    def unknown_decl(self, data: str) -> None:
        pass


def parse(html: str) -> Page:
    """A page. If a tag that hides its content is never closed, it and those of its kind after it hide nothing, but for tags
    whose content browsers take for raw text. A page is read once more for each such kind."""
    shown: dict[str, int] = {}
    while True:
        page = Page(html, shown)
        if page.hidden in ("", "head", *_RAW):
            return page
        shown[page.hidden] = page.starts


def host_of(url: pd.Series) -> pd.Series:
    return url.fillna("").str.extract(r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", expand=False).fillna("").str.lower()


def _named(words: frozenset[str]) -> str:
    return "(^|[^a-z])(" + "|".join(sorted(words)) + ")([^a-z]|$)"


def _nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, path, kind, feature, chars) of pages: kind 0 a page that has the node, 1 the
    presentation of its children, 2 content of the node itself with its length."""
    for b in batches:
        rows = []
        for host, html in zip(host_of(b["url"]), b["html"], strict=True):
            page = parse(html or "")
            found = {(path, 1, xxhash.xxh64_intdigest(",".join(c)) >> 1): 0 for path, c in page.children.items()}
            found |= {(path, 2, xxhash.xxh64_intdigest(x) >> 1): 0 for path, x in page.targets}
            found |= {(path, 2, xxhash.xxh64_intdigest(x) >> 1): len(x) for path, x in page.blocks}
            paths = {path for path, _, _ in found}
            rows += [(host, *x, chars) for x, chars in found.items()]
            rows += [(host, path, 0, 0, 0) for path in paths]
        yield pd.DataFrame(rows, columns=["host", "path", "kind", "feature", "chars"])


def _host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def distinct_pages(pages: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """(url, html) of the pages, of those that a host has several times only one row. The list
    of such copies is broadcast only if it has at most ``broadcast_rows`` rows of a host's
    name and two numbers."""
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("_host"), F.xxhash64("html").alias("_digest"))
    copied = rows.groupBy("_host", "_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    copied = materialize(copied, "copied-pages")
    copied = F.broadcast(copied) if copied.count() <= broadcast_rows else copied
    marked = rows.join(copied, ["_host", "_digest"], "left")
    one = marked.where("_n IS NOT NULL AND page_id <=> _first").dropDuplicates(["_host", "_digest"])
    return marked.where("_n IS NULL").unionByName(one).select("url", "html")


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, m, importance, mass, total) of the nodes of every host's tree, and of the
    tree of all hosts under host ''.

    With m pages that have a node, a content feature found on n of them has entropy
    ln n / ln m; the node's own content counts 1 - the mean of these, the presentation
    counts the entropy of its children's styles to base m. An inner node takes
    (1 - GAMMA ** styles) of its presentation and the rest from the content below it. The mass
    of a branch is its characters, each 1 - its feature's entropy; ``total`` is the host's.
    Repeats are counted with partial sums, so a hot host or path is no single task's.
    """
    own = distinct_pages(pages).mapInPandas(_nodes, "host string, path string, kind int, feature long, chars long")
    by_host = materialize(own.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")), "style-features")
    both = by_host.where("host != ''").unionByName(by_host.withColumn("host", F.lit("")).groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")))
    nodes = both.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("m"),
        F.sum(F.when(F.col("kind") == 1, F.col("n"))).alias("n1"),
        F.sum(F.when(F.col("kind") == 1, F.col("n") * F.ln("n"))).alias("s1"),
        F.count(F.when(F.col("kind") == 1, 1)).alias("styles"),
        F.sum(F.when(F.col("kind") == 2, F.ln("n"))).alias("h2"),
        F.count(F.when(F.col("kind") == 2, 1)).alias("features"),
        F.sum("chars").alias("chars"),
        F.sum(F.col("chars") * F.ln("n")).alias("repeated"),
    )
    m = F.ln("m")
    # -sum p ln p over styles with p = n / n1 is ln n1 - s1 / n1
    varied = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), (F.ln("n1") - F.col("s1") / F.col("n1")) / m)).otherwise(1.0)
    fresh = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("h2") / F.col("features") / m)).otherwise(1.0)
    mass = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), F.col("chars") - F.col("repeated") / m)).otherwise(F.col("chars").cast("double"))
    nodes = nodes.select("host", "path", "m", "styles", varied.alias("varied"), F.when(F.col("features") > 0, fresh).alias("fresh"), "features", mass.alias("mass"))
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.when(F.col("path") == "", 0).otherwise(F.size(steps))), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    below = nodes.where("features > 0").select("host", F.explode(prefixes).alias("path"), "fresh", "features", "mass")
    below = below.groupBy("host", "path").agg((F.sum(F.col("fresh") * F.col("features")) / F.sum("features")).alias("content"), F.sum("mass").alias("mass"))
    total = below.where("path = ''").select("host", F.col("mass").alias("total"))
    share = F.when(F.col("styles") > 0, 1 - F.pow(F.lit(GAMMA), F.col("styles"))).otherwise(0.0)
    content = F.coalesce("content", F.lit(1.0))
    tree = nodes.drop("mass").join(below, ["host", "path"], "left").join(total, "host", "left")
    importance = share * F.coalesce("varied", F.lit(1.0)) + (1 - share) * content
    return materialize(tree.select("host", "path", "m", importance.alias("importance"), F.coalesce("mass", F.lit(0.0)).alias("mass"), F.coalesce("total", F.lit(0.0)).alias("total")), "style-tree")


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, low, beside array<string>): the tops of the branches of each host to take out;
    low ones for what the tree says alone, those beside also for their share and names.

    A node's importance is weighed with that of the same path over all hosts as PRIOR_PAGES
    pages. The main branch ends at the deepest container that holds WRAPS of the host's mass:
    nodes on it stay, what is beside it counts by its share of the mass. Names are looked at
    below the point where a path leaves the main branch.
    """
    everywhere = tree.where("host = ''").select("path", F.col("importance").alias("overall"))
    last = F.element_at(F.split("path", "/"), -1)
    wraps = tree.where((F.col("path") == "") | (last.rlike(f"^({_CONTAINERS})([.]|$)") & (F.col("mass") >= WRAPS * F.col("total")) & (F.col("total") > 0)))
    main = wraps.groupBy("host").agg(F.max(F.struct(F.length("path").alias("n"), "path")).alias("w")).select("host", F.col("w.path").alias("main"))
    seen = tree.where("path != ''").join(everywhere, "path").join(main, "host", "left").withColumn("main", F.coalesce("main", F.lit("")))
    weighed = (F.col("m") * F.col("importance") + PRIOR_PAGES * F.col("overall")) / (F.col("m") + PRIOR_PAGES)
    wrapper = (F.col("path") == F.col("main")) | F.col("main").startswith(F.concat("path", F.lit("/")))
    inside = (F.col("main") == "") | F.col("path").startswith(F.concat("main", F.lit("/")))
    own = F.when(inside & (F.col("main") != ""), F.expr("substring(path, length(main) + 2)")).otherwise(F.col("path"))
    part = F.when(inside | (F.col("total") <= 0), 1.0).otherwise(F.least(F.lit(1.0), BESIDE * F.col("mass") / F.col("total")))
    article = F.when(F.col("path").rlike(_named(_ARTICLE)), NAMED_ARTICLE).otherwise(1.0)
    aside = F.when(own.rlike(_named(_ASIDE)), NAMED_ASIDE).otherwise(1.0)
    judged = seen.where(~wrapper).select("host", "path", (weighed * article).alias("alone"), (weighed * F.when(aside < 1, aside).otherwise(article) * part).alias("whole"))
    found = judged.where(F.col("whole") < LEAST).groupBy("host").agg(F.collect_set(F.when(F.col("alone") < LEAST, F.col("path"))).alias("low"), F.collect_set("path").alias("beside"))
    tops = lambda c: F.filter(c, lambda x: ~F.exists(c, lambda y: x.startswith(F.concat(y, F.lit("/")))))
    return found.select("host", tops(F.col("low")).alias("low"), tops(F.col("beside")).alias("beside"))


def main_text(html: str, low: set[str], beside: set[str]) -> str:
    """The text of a page without the branches ``low``, nor those ``beside`` that hold less
    than WRAPS of what is then left of the page."""

    def top(path: str, tops: set[str]) -> str:
        while path and path not in tops:
            path = path.rpartition("/")[0]
        return path

    blocks = [(path, text) for path, text in parse(html).blocks if not top(path, low)]
    size: Counter[str] = Counter()
    for path, text in blocks:
        size[top(path, beside)] += len(text)
    kept = {k for k, n in size.items() if n >= WRAPS * sum(size.values())} | {""}
    return "\n".join(text for path, text in blocks if top(path, beside) in kept)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Character references are decoded; white space inside a block becomes one space; blocks
    are joined in page order by a newline. Null and empty html give an empty text; a null or
    odd url gives a page the tree of all hosts alone; broken markup is closed as browsers do
    (a head ends at the first tag that cannot stand in it, a form control or drawing with what
    encloses it), and a control or drawing that nothing closes hides nothing; null ids stay null; repeated rows
    and ids give a row each, and copies of a page count once in the tree; very long pages are
    read whole, a batch of few pages at a time; an empty table gives no rows; extra columns
    are ignored.
    """
    small_batches(pages.sparkSession)
    tops = low_branches(style_tree(pages))
    rows = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host")).join(tops, "host", "left").select("page_id", "url", "html", "low", "beside")
    kind = pages.schema["page_id"].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(html or "", set(low or ()), set(beside or ())) for html, low, beside in zip(*[b.column(c).to_pylist() for c in ("html", "low", "beside")], strict=True)]
            yield with_columns(b, slice(0, b.num_rows), ("page_id", "url"), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    return rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
