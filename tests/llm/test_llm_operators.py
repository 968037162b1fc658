"""The operators on Spark: brute force, exact round trips, held-out accuracy, odd inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from ledgerlens.llm import ann_search, bpe_codec, embedding_dedup, html_extract, langid_crf, line_dedup, ngram_join, packing, token_counts, toxicity, wordbpe  # noqa: E402
from ledgerlens.llm.queries import QUERIES  # noqa: E402
from ledgerlens.llm.shared import scratch_path  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word30 ", "other ")
ODD = [
    (1, BASE, "en"),
    (2, BASE, "en"),
    (3, NEAR, "en"),
    (3, NEAR, "en"),
    (4, None, None),
    (5, "", "en"),
    (6, "short text", "en"),
    (7, "SHORT TEXT", "en"),
    (8, " ".join(f"x{i}" for i in range(30_000)), "de"),
    (9, "12 34 !", None),
    (10, f"{BASE}\n{NEAR}\nunique line of some words here", "fr"),
]
SCHEMA = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, nulls, an empty and a very long text, and columns whose names clash."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("id", "cid", "n", "pos", "root", "score", "_text", "_digest", "length", "part", "_drop", "prefix"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def linked(x, y):
    return bool(x) and bool(y) and 4 * len(x & y) >= 3 * len(x | y)


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    posted = defaultdict(list)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in posted[g]}:
            if linked(s, sets[j]):
                root[find(i)] = find(j)
        for g in s:
            posted[g].append(i)
    least = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        least[find(i)].append(k)
    return sorted((k, len(sets[i]), min(least[find(i)])) for i, (k, _) in enumerate(rows))


def test_ngram_join_odd(spark, odd, empty):
    got = sorted(tuple(r) for r in ngram_join.ngram_join(odd).select("doc_id", "n_shingles", "component_id").collect())
    assert got == plain_components([(k, t) for k, t, _ in ODD])
    assert ngram_join.ngram_join(empty).count() == 0


def test_ngram_join_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(40 + 5 * g)]
        for _ in range(12):  # edits put pairs on both sides of the threshold
            own = list(words)
            for at in rng.integers(0, len(own), rng.integers(0, 4)):
                own[at] = f"e{rng.integers(0, 1000)}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in ngram_join.ngram_join(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == plain_components(rows)


def plain_lines(rows):
    seen, out = [], {}
    for k, t in sorted(rows):
        keep = []
        for line in t.split("\n"):
            s = shingles(line) if len(line.split()) >= line_dedup.LEAST_WORDS else frozenset()
            if not any(linked(s, x) for x in seen):
                keep.append(line)
            if s:
                seen.append(s)
        out[k] = "\n".join(keep)
    return out


def test_line_dedup(spark, odd, empty):
    rng = np.random.default_rng(1)
    lines = [" ".join(f"l{a}w{i}" for i in range(12 + a % 9)) for a in range(12)]
    rows = []
    for k in range(60):
        own = []
        for a in rng.integers(0, len(lines), 4):
            w = lines[a].split()
            if rng.random() < 0.5:
                w[rng.integers(0, len(w))] = f"z{rng.integers(0, 50)}"
            own.append(" ".join(w))
        rows.append((k, "\n".join([*own, "", "short one", "short one"])))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_lines(rows)
    out = line_dedup.dedup_lines(odd)
    assert out.count() == len(ODD) and set(odd.columns) < set(out.columns)
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text == BASE and by[2].text == "" and by[4].text is None and by[5].text == "" and by[6].text == "short text"
    assert by[10].text == "unique line of some words here" and by[10].n_removed == 2
    assert line_dedup.dedup_lines(empty).count() == 0


def test_token_counts_use_and_extend_the_cache(spark, odd, empty):
    at, lib = scratch_path(spark, "cache"), wordbpe.load(BYTE)
    want = sorted((k, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for k, t, _ in ODD)
    for _ in range(2):
        got = token_counts.count_tokens(odd, BYTE, at)
        assert sorted(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens").collect()) == want
        cache = token_counts.read_cache(spark, at)
        assert cache.count() == cache.select("text_digest").distinct().count() == len({t or "" for _, t, _ in ODD})
    more = spark.createDataFrame([(1, "new text"), (2, BASE)], "doc_id long, text string")
    assert token_counts.count_tokens(more, BYTE, at).count() == 2
    assert token_counts.read_cache(spark, at).count() == len({t or "" for _, t, _ in ODD}) + 1
    assert token_counts.count_tokens(empty, BYTE, scratch_path(spark, "cache")).count() == 0


def test_packing(spark, odd, empty):
    lib = wordbpe.load(WORD)
    rows = packing.pack_documents(odd, WORD, 256).collect()
    ids = {k: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for k, t, _ in ODD}
    fill = defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length <= 256 and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        fill[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(ids[k]) for k, _, _ in ODD)
    for f in fill.values():
        end = 0
        for offset, length in sorted(f):
            assert offset == end
            end += length
        assert end <= 256
    assert packing.pack_documents(empty, WORD).count() == 0


def test_bpe_codec(spark, odd, empty):
    lib = wordbpe.load(WORD)
    full = {r.doc_id: r for r in bpe_codec.encode_documents(odd, WORD).collect()}
    short = {r.doc_id: r for r in bpe_codec.encode_documents(odd, WORD, digests=True).collect()}
    for k, t, _ in ODD:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert full[k].ids == ids and full[k].decoded == lib.decode(ids, skip_special_tokens=False)
        assert short[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and short[k].n_tokens == len(ids)
    assert bpe_codec.encode_documents(empty, WORD).count() == 0


def test_language_id(spark, sf_dir, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0] > 0.97
    crf = langid_crf.fit(docs)
    rows = {r.doc_id: r for r in langid_crf.identify(odd, crf).collect()}
    assert rows[4].lang_pred == rows[5].lang_pred == rows[9].lang_pred == "und" and rows[4].score == 0
    assert langid_crf.identify(odd, crf).count() == len(ODD)
    assert {r.lang_pred for r in langid_crf.identify(odd, langid_crf.fit(empty)).collect()} == {"und"}
    assert langid_crf.identify(empty, crf).count() == 0


def test_toxicity(spark, odd, empty):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op6_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.sum((F.col("predicted") * F.col("toxic"))).alias("hit"), F.sum("predicted").alias("said"), F.sum("toxic").alias("true")).head()
    assert r.hit / r.said > 0.9 and r.hit / r.true > 0.8
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, labels)
    assert toxicity.score_documents(odd, model).where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.score_documents(odd, model).count() == len(ODD) and toxicity.score_documents(empty, model).count() == 0


PAGE = "<html><head><title>t</title></head><body><nav><ul><li><a href='/a'>home</a></ul></nav><div class=ad>buy {i}</div><div id=c{i}><h1>Title {i}</h1><p>text {i} &amp; more<p>second\n  {j}</div><div class=foot>same for all</div><footer>(c)</footer></body></html>"


def test_html_extraction(spark):
    rows = [(i, f"http://h{i % 2}.example/p{i}", PAGE.format(i=i, j=i * 7)) for i in range(40)]
    rows += [(100, None, None), (101, "odd", ""), (102, "http://solo.example/", "<article><p>alone"), (102, "http://solo.example/", "<article><p>alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("low", F.lit(1)).withColumn("host", F.lit(1))
    out = html_extract.extract_main_text(df)
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows)
    for i in range(40):
        assert got[i].text == f"Title {i}\ntext {i} & more\nsecond {i * 7}" and got[i].n_chars == len(got[i].text)
    assert got[100].text == got[101].text == "" and got[102].text == "alone"
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def vectors(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    for i in range(0, n, 5):
        x[i + 1] = x[i] + rng.normal(size=16) * 0.05
        x[i + 2] = x[i]
    rows = [(i, [float(np.float32(c)) for c in x[i]], i % 3 if i % 50 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [None] + [1.0] * 15, 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash")).withColumn("shard", F.lit("clash")).repartition(4)


def good(v):
    return v is not None and None not in v and np.isfinite(v).all() and any(v)


def test_embedding_dedup(spark):
    rows, df = vectors(spark)
    # near copies share a label here
    df = df.withColumn("label", F.when(F.col("label").isNotNull(), F.floor(F.col("vec_id") / 5).cast("int") % 3))
    rows = [(k, v, None if y is None else (k // 5) % 3) for k, v, y in rows]
    links, root = defaultdict(int), {k: k for k, _, _ in rows}
    ok = [(k, np.array(v, float), y) for k, v, y in rows if y is not None and good(v)]
    pairs = [(a, b) for i, (a, x, p) in enumerate(ok) for b, y, q in ok[:i] if p == q and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in range(10):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    for k, _, _ in rows:
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (links[k], root[k], root[k] == k)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_ann_search(spark):
    rows, df = vectors(spark, 600, 1)
    got = defaultdict(list)
    for r in ann_search.search(ann_search.build_shards(df, 250), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ok = [(k, np.array(v, float)) for k, v, _ in rows if good(v)]
    hits = total = 0
    for k, x in ok:
        if k % 20 == 0:
            best = sorted(((-float(x @ y), j) for j, y in ok if j != k))[:20]
            hits += len({j for _, j in best} & {j for j, _ in got[k]})
            total += 20
            assert len(got[k]) == 20 and got[k] == sorted(got[k], key=lambda r: (-r[1], r[0]))
    assert hits / total > 0.9
    few = ann_search.search(ann_search.build_shards(df.where("vec_id < 5")), F.col("vec_id") % 20 == 0)
    assert few.count() == 4
    assert ann_search.search(ann_search.build_shards(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == p.COLUMNS
        docs = docs.sparkSession.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    rows = p.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
