"""Null and large ids, vectors of several lengths, markup that nothing closes."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from ledgerlens.llm import ann_search, bpe_codec, embedding_dedup, html_extract, langid_crf, packing, toxicity  # noqa: E402

BIG = 9007199254740993  # no double has it
WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(BIG, "one text", "en"), (None, "ein Text", "de"), (BIG + 2, None, "en")], "doc_id long, text string, lang string").coalesce(1)


def ids(df, c="doc_id"):
    return sorted((str(r[c]) for r in df.select(c).collect()))


def test_ids_beside_nulls_stay_as_they_are(spark, docs):
    want = sorted([str(BIG), "None", str(BIG + 2)])
    crf = langid_crf.train(["one text of words", "ein Text aus Worten"] * 8, ["en", "de"] * 8)
    assert ids(langid_crf.identify(docs, crf)) == want
    kept = langid_crf.identify(docs, crf, ("doc_id", "text", "lang"))
    assert kept.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and ids(kept) == want
    model = toxicity.train(["bad words", "good words"] * 8, [1, 0] * 8)
    assert ids(toxicity.score_documents(docs, model)) == want
    assert ids(bpe_codec.encode_documents(docs, WORD)) == want and ids(bpe_codec.encode_documents(docs, WORD, digests=True)) == want
    packed = packing.pack_documents(docs, WORD)
    assert ids(packed) == want and packed.where("doc_id IS NULL").head().length > 1
    pages = spark.createDataFrame([(BIG, "http://a.b/", "<p>x</p>"), (None, None, "<p>y</p>")], "page_id long, url string, html string").coalesce(1)
    assert ids(html_extract.extract_main_text(pages), "page_id") == sorted([str(BIG), "None"])


VECTORS = [(1, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (3, [1.0], 1), (4, [1.0, 0.0, 0.0], 1), (5, [], 1), (6, None, 1), (None, [1.0, 0.0], 1)]


def test_each_row_is_a_candidate_and_ragged_vectors_take_no_part(spark):
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "row").withColumnRenamed("row", "label")
    got = [tuple(r) for r in ann_search.search(ann_search.build_shards(rows), ann_search.F.col("vec_id") % 20 == 0).collect()]
    first = sorted((r, v, round(s, 4)) for q, r, v, s in got)
    # two queries of id 20, with four other rows each: both rows of id 1, and the other of id 20
    assert len(got) == 8 and {q for q, *_ in got} == {20}
    assert [x for x in first if x[0] == 1] == [(1, 1, 0.1), (1, 1, 1.0)] and sorted(v for _, _, v, _ in got) == [1, 1, 1, 1, 2, 2, 20, 20]
    linked = {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(rows).collect()}
    assert linked == {(1, 3, 1), (2, 3, 1), (20, 3, 1), (20, 0, 20), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (None, 0, None)}


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>before</p><button>go<p>the article goes on", ["before", "go", "the article goes on"]),
        ("<div><p>a</p><button>go</div><p>b", ["a", "b"]),
        ("<div><select><option>x<option>y</select><p>b</div>", ["b"]),
        ("<p>a</p><svg><g><text>no</text></g></svg><p>b</p>", ["a", "b"]),
        ("<p>a</p><svg><g><p>b</p>", ["a", "b"]),
        ("<p>let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be</p>", ["let", "x", "=", "1", "be"]),
        ("<p>a</p><script>if (a < b) { '<p>' }", ["a"]),
        ("<p>a</p><button>1<button>2<select>3<p>b</p>", ["a", "123", "b"]),
    ],
)
def test_what_nothing_closes_hides_nothing(html, want):
    said = " ".join(text for _, text in html_extract.parse(html).blocks).split()
    assert said == " ".join(want).split()


def test_many_unclosed_tags_are_read_few_times():
    assert html_extract.parse("<button>x" * 5000).blocks
