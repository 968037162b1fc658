"""Text functions as column expressions; all run inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Java's \\w is ASCII; this class gives the same words in Java, RE2 and Python.


def tokens(c: Column) -> Column:
    """the words of a text in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({WORD})"), F.lit(1))


def normalize(c: Column) -> Column:
    """lower case, white space squeezed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def unique_tokens(c: Column) -> Column:
    """F3"""
    return F.array_distinct(tokens(c))


def lexical_overlap(a: Column, b: Column) -> Column:
    """shared unique tokens over the larger side; 0 for empty sides."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / larger)


def contains_phrase(text: Column, phrase: Column) -> Column:
    """normalized containment; an empty phrase is in nothing."""
    p = normalize(phrase)
    return (p != "") & F.contains(normalize(text), p)


def stem(c: Column) -> Column:
    """a word in lower case without the ending ing, ed, es or s (not ss)."""
    return F.regexp_replace(F.lower(c), "(?:ing|ed|es|(?<!s)s)$", "")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def slug(c: Column) -> Column:
    """F13"""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def token_estimate(chars: Column) -> Column:
    """a token for 4 characters, at least one."""
    return F.greatest(F.lit(1), F.ceil(chars / 4)).cast("long")


def strip_fences(c: Column) -> Column:
    """F25"""
    return F.regexp_replace(c, "(?s)```.*?```", "")


#: F20. The key names and the characters of a secret.
SECRET = r"(?i)((?:api_key|apikey|secret|password|token|auth|authorization)(?:\s*[:=]\s*|[\"']\s*[:=]\s*[\"']?\s*)[\"']?)([a-zA-Z0-9_\-\.\/]{8,})"
BEARER = r"(?i)bearer\s+([a-zA-Z0-9_\-\.\/]+)"


def redact(c: Column) -> Column:
    """values after key names of secrets, and bearer tokens."""
    return F.regexp_replace(F.regexp_replace(c, SECRET, "$1[REDACTED]"), BEARER, "Bearer [REDACTED]")


def snippet(c: Column, chars: int = 200) -> Column:
    r = redact(c)
    return F.when(F.length(r) <= chars, r).otherwise(F.concat(F.substring(r, 1, chars), F.lit("... [Truncated]")))


def phrases(words: Column, least: int = 4, most: int = 7) -> Column:
    """All runs of ``least`` to ``most`` words."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(least), F.lit(most)),
            lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>")),
        )
    )


def ngrams(words: Column, n: int) -> Column:
    """W8"""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


#: Identifiers by shape.
IDENTIFIER_SHAPES = [r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", r"[A-Za-z]\w*_\w+", r"[A-Z][A-Z0-9_]{2,}", r"(?:[A-Z][a-z0-9]+){2,}", r"[a-z]+(?:[A-Z][a-z0-9]*)+"]


def identifiers(c: Column) -> Column:
    """dotted, snake, upper, Pascal and camel case identifiers, each once, in order of shape."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(rf"(?<![\w.])({p})(?![\w])"), F.lit(1)) for p in IDENTIFIER_SHAPES])))


def symbols(c: Column, most: int = 128) -> Column:
    """F16: the first identifiers of three letters or more, compared without case."""
    return F.slice(unique_ci(F.regexp_extract_all(c, F.lit(r"\b([A-Za-z_]\w{2,})\b"), F.lit(1))), 1, most)


def unique_ci(items: Column) -> Column:
    """D-5: each string once, compared without case, in order and in its first spelling. Sorted
    by spelling and put back in order, so a long list costs little more than its length."""
    ranked = F.array_sort(F.transform(items, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = F.element_at(F.transform(F.array(ranked), lambda r: F.filter(r, lambda e, j: (j == 0) | (F.get(r, j - 1)["k"] != e["k"]))), 1)
    return F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


# Words that say nothing about a source.
STOP_WORDS = "the a an of to in on for with from by at as is are was were be been being and or but if then than that this it its not no how why what where who which do does did will would could should can may".split()


def components_of(c: Column) -> Column:
    """words and the parts of snake and camel case names in lower case, each once, without
    stop words and single letters."""
    parts = F.regexp_extract_all(c, F.lit(r"([A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+)"), F.lit(1))
    both = F.transform(F.concat(F.regexp_extract_all(c, F.lit(r"(\w+)"), F.lit(1)), parts), F.lower)
    return F.filter(F.array_distinct(both), lambda x: (F.length(x) > 1) & ~x.isin(*STOP_WORDS))


def wiki_links(c: Column) -> Column:
    """the targets of [[target]], [[type:target]] and either with |label, as (type, target)."""
    raw = F.regexp_extract_all(c, F.lit(r"\[\[([^\]\[]+)\]\]"), F.lit(1))
    named = F.transform(raw, lambda x: F.trim(F.substring_index(x, "|", 1)))
    typed = lambda x: F.contains(x, F.lit(":"))
    return F.transform(named, lambda x: F.struct(F.when(typed(x), F.trim(F.substring_index(x, ":", 1))).otherwise(F.lit("relates_to")).alias("type"), F.when(typed(x), F.trim(F.regexp_replace(x, "^[^:]*:", ""))).otherwise(x).alias("target")))


def front_matter(c: Column) -> Column:
    """the key: value lines of a leading --- block, as a map; of a key that repeats the last
    value counts, and nested values stay text."""
    block = F.regexp_extract(c, r"(?s)\A---\s*\n(.*?)\n(?:---|\.\.\.)\s*(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    entries = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+)", 1), F.trim(F.regexp_extract(x, r"^[\w-]+\s*:(.*)$", 1)))).cast("array<struct<k:string,v:string>>")
    last = F.transform(F.array(entries), lambda all_: F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0))), lambda later: later["k"] == e["k"])))
    return F.map_from_entries(F.element_at(last, 1))


def section(c: Column, title: str) -> Column:
    """The text under a markdown heading of level two."""
    return strip(F.regexp_extract(c, rf"(?si)(?:\A|\n)##\s+{re.escape(title)}\s*\n(.*?)(?=\n##\s|\z)", 1))


def parse_time(c: Column) -> Column:
    """epoch seconds or ISO 8601, null for anything else; without a zone it is UTC."""
    return F.coalesce(F.timestamp_seconds(c.try_cast("double")), F.try_to_timestamp(c))


def phrase_normalized(c: Column) -> Column:
    """lower case, plain quotes, : and ; as commas, no other punctuation, no stop words."""
    plain = F.regexp_replace(F.translate(F.lower(c), "\u2018\u2019\u201c\u201d:;", "''\"\",,"), r"[^\p{L}\p{N}_\s,'-]", " ")
    words = F.filter(F.split(F.trim(plain), r"[\s,]+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    return F.array_join(words, " ")


def title_of(slugged: Column) -> Column:
    """a title from a slug."""
    return F.initcap(F.regexp_replace(slugged, "[-_]+", " "))


def canonical_json(m: Column) -> Column:
    """F36, D-2: a map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def is_text(content: Column) -> Column:
    """whether bytes look like text: no NUL and valid UTF-8 in the first 4 KiB."""
    head = F.substring(content, 1, 4096)
    return F.is_valid_utf8(head.cast("string")) & (F.instr(head.cast("string"), "\x00") == 0)


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are worked out once for each row: unlike those of a projection they
    are not written again into every expression and filter above, which would make plans of
    many rules grow without bound."""
    one = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    rows = df.select(*[c for c in df.columns if c not in columns], one.alias("_settled"))
    return rows.select(*[c for c in df.columns if c not in columns], *[F.col(f"_settled.{k}").alias(k) for k in columns])


def as_list(c: Column) -> Column:
    """a list from text that commas split; null and empty give an empty one."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
