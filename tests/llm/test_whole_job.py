"""Nothing is left out: pairs across the parts of a shard, pairs across shards, short lines, names of wrappers."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from ledgerlens.llm import embedding_dedup, html_extract, line_dedup, shared  # noqa: E402


def near(x, cosine, rng):
    """A vector at the given cosine from each row of x."""
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    return cosine * x + np.sqrt(1 - cosine * cosine) * y


def units(n, rng, d=64):
    x = rng.normal(size=(n, d))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def links_of(df):
    return {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}


def test_embedding_dedup_finds_pairs_across_parts(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "deal", lambda nodes, centres, *a, _deal=embedding_dedup.deal, **k: _deal(nodes, centres, *a, **k | {"most": 400}))
    rng = np.random.default_rng(4)
    x = units(1580, rng)
    x = np.concatenate([x, near(x[:20], 0.95, rng)])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    monkeypatch.setattr(embedding_dedup, "fit_centres", lambda nodes: {})
    got = links_of(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert got == {i: int(i < 20 or i >= 1580) for i in range(len(x))}


def test_embedding_dedup_finds_pairs_across_shards(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = units(3000, rng)
    x = np.concatenate([x, near(x[:600], 0.935, rng)])
    # centres of a table that has many more vectors than these
    monkeypatch.setattr(embedding_dedup, "fit_centres", lambda nodes: {0: units(1000, rng)})
    got = links_of(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"))
    want = (x @ x.T >= embedding_dedup.LEAST_COSINE).sum(1) - 1
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.97 * want.sum()


def test_line_dedup_takes_out_short_lines_that_repeat(spark):
    rows = [(1, "one\ntwo words\n\nONE\n犬も歩けば棒に当たる"), (2, "two  Words\nthree words here\n\n犬も歩けば棒に当たる\ntwo"), (3, "three words here")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("one\ntwo words\n\n犬も歩けば棒に当たる", 1), 2: ("three words here\n\ntwo", 2), 3: ("", 1)}


def test_html_names_do_not_override_text_share_and_entropy(spark):
    main = "<main><h1>Title {i}</h1><p>text {i} and more of it, long enough to be the most of this page</p><div class=x>the same on all</div></main>"
    form = "<body class='has-sidebar'><form id=aspnet>" + main + "<div class=ad>buy {i}</div></form></body>"
    rows = [(i, f"http://h.example/{i}", form.format(i=i)) for i in range(40)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\ntext {i} and more of it, long enough to be the most of this page" for i in range(40)}


def test_html_style_tree_decides_without_names(spark):
    """Neutral names: what repeats goes, and so does what is little beside the main branch; copies
    of a page don't make its text repeat."""
    rng = np.random.default_rng(2)
    some = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 900, n))
    page = "<html><head><title>t</title><body><div class=qa><span><a href='/h'>Home</a> <a href='/n'>News</a></span></div><div class=qb>Buy {a} now</div><div class=qc><h1>Title {i}</h1><p>{b}<p>more {c}</div><div class=qd>Impressum</div></body></html>"
    rows, want = [], {}
    for i in range(40):
        a, b, c = some(1), some(60), some(30)
        rows.append((i, f"http://n.example/{i}", page.format(i=i, a=a, b=b, c=c)))
        want[i] = f"Title {i}\n{b}\nmore {c}"
    rows += [(100 + k, f"http://n.example/copy{k}", rows[3][2]) for k in range(60)]
    want |= {100 + k: want[3] for k in range(60)}
    out = html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in out.collect()} == want


def test_bounded_sample_with_few_or_hot_keys(spark):
    few = spark.range(20000).selectExpr("id % 10 AS doc_id", "cast(id AS string) AS text")
    assert len(shared.bounded_sample(few, "doc_id", 2000, "text")) == 2000
    hot = spark.range(20000).selectExpr("if(id < 19000, 7, id) AS doc_id", "'x' AS text")
    got = shared.bounded_sample(hot, "doc_id", 500, "text")
    assert len(got) == 500 and got == shared.bounded_sample(hot, "doc_id", 500, "text")
    long = spark.createDataFrame([(k, "y" * 1000) for k in range(100)], "doc_id long, text string")
    assert len(shared.bounded_sample(long, "doc_id", 50, "text", chars=10_000)) == 10
    assert shared.bounded_sample(long, "doc_id", 50, "text", longest=999) == [] == shared.bounded_sample(long.limit(0), "doc_id", 5, "text")


def test_pipeline_line_stage_drops_near_copies_by_lines(spark):
    import corpus_pipeline as p

    lines = [" ".join(f"w{i}x{j}" for j in range(12)) for i in range(20)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[:18] + ["only here and nowhere else"])), (3, "\n".join(["fresh words of a third one"] * 40)), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in p.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 3: ("fresh words of a third one", 26), 4: (None, None), 5: ("", 0)}
    assert p.drop_repeated_lines(spark, docs.limit(0), "").count() == 0


def test_pipeline_keeps_code_switched_documents(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL AND n_chars > 2000").orderBy("doc_id")
    first = docs.toPandas().groupby("lang")["text"].first()
    mixed = " ".join(" ".join(t.split()[:60]) for t in first)
    rows = [(1, mixed, "en", "s", len(mixed)), (2, "12 34 !", "en", "s", 7)]
    kept = p.keep_known_languages(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf_dir)
    assert len(first) == 4 and [r.doc_id for r in kept.collect()] == [1]
