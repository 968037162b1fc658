"""Parts of the operators without Spark, against plain versions."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")

from ledgerlens.llm import bpe_codec, graphs, html_extract, langid_crf, packing, setjoin, toxicity, wordbpe  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "abc \n\t'sétre12²  <|endoftext|> \xa0\x85,.!中́İ"


def odd_texts(n=400, seed=1):
    r = random.Random(seed)
    return ["", "a" * 9000, "é" * 9000 + " x", "it's " * 2000, *("".join(r.choice(ALPHABET) for _ in range(r.randint(0, 200))) for _ in range(n))]


def test_encoders_equal_the_library():
    texts = odd_texts()
    lib = wordbpe.load(WORD)
    assert [np.frombuffer(x, "<u4").tolist() for x in wordbpe.WordEncoder(WORD, 50).encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    lib = wordbpe.load(BYTE)
    assert wordbpe.ByteCounter(lib, 50).count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunk_codec_round_trip_and_reuse():
    texts = odd_texts(seed=2)
    passage = "the of and entia ment " * 200
    texts += [f"one {passage}", f"another beginning {passage} and end"]
    lib, codec = wordbpe.load(WORD), bpe_codec.ChunkCodec(WORD, 1 << 14)
    for part in (texts[:100], texts[100:], texts):
        for t, ids in zip(part, codec.encode(part), strict=True):
            want = lib.encode(t, add_special_tokens=False).ids
            assert ids.tolist() == want
            assert codec.decode(ids) == lib.decode(want, skip_special_tokens=False)
    assert codec.reused > 0


def test_cuts_depend_on_content():
    data = bytes(random.Random(3).choices(range(97, 123), k=20_000))
    a, b = bpe_codec.cut_points(data), bpe_codec.cut_points(b"xyz" * 50 + data)
    assert len({x + 150 for x in a} & set(b)) > 0.8 * len(a)
    assert a[-1] == len(data) and all(y - x <= bpe_codec.MOST + 4 for x, y in itertools.pairwise([0, *a]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_bins(lengths):
    capacity = 40
    bins = packing.plan_bins(np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, int))
    packed = Counter()
    for times, fill in bins:
        assert times > 0 and sum(fill) <= capacity
        for n in fill:
            packed[n] += times
    assert packed == Counter(lengths)


def test_best_two_fit_replaces_the_smallest():
    counts = np.zeros(101, int)
    counts[[60, 30, 25, 15]] = 1  # greedy: 60 + 30; 25 + 15 fill the gap of 40 in place of 30
    assert [sorted(f) for _, f in packing.plan_bins(counts)] == [[15, 25, 60], [30]]


def plain_sets(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_shingle_sets():
    texts = ["", "A b", "a B", "one two three four five six one two three four five", " \x0b\n ", "É x y z w v", "a b c d e f", "x", "w" * 5000 + " b c d e"]
    raw = [t.encode() for t in texts]
    data, edges = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    doc, _, n, h = setjoin.shingle_sets(data, edges, False)
    assert {int(d): int(k) for d, k in zip(doc, n, strict=True)} == {i: len(plain_sets(t)) for i, t in enumerate(texts) if plain_sets(t)}
    cid = dict(zip(doc.tolist(), setjoin.class_ids(n, h).tolist(), strict=True))
    assert cid[1] == cid[2] and len(set(cid.values())) == len(cid) - 1
    doc, line, n, _ = setjoin.shingle_sets(np.frombuffer(b"a b c d e\n\nshort\nf g h i j k", np.uint8), np.array([0, 28]), True, 5)
    assert list(zip(line.tolist(), n.tolist(), strict=True)) == [(0, 1), (3, 2)]


def test_forward_backward_equals_the_recursion():
    rng = np.random.default_rng(0)
    k, starts = 3, np.array([0, 1, 1, 140, 143])
    logits, t, s = rng.normal(size=(143, k)) * 3, rng.normal(size=(k, k)), rng.normal(size=k)
    got = langid_crf.forward_backward(logits, starts, t, s, block=16)
    for a, z in itertools.pairwise(starts):
        x = np.exp(logits[a:z])
        f, b = np.zeros_like(x), np.ones_like(x)
        for i in range(len(x)):
            f[i] = x[i] * (np.exp(s) if i == 0 else f[i - 1] @ np.exp(t))
            f[i] /= f[i].sum()
        for i in range(len(x) - 2, -1, -1):
            b[i] = np.exp(t) @ (x[i + 1] * b[i + 1])
            b[i] /= b[i].sum()
        p = f * b
        assert np.allclose(got[a:z], p / p.sum(1, keepdims=True))


def test_crf_labels_code_switched_words():
    en, de = ["the house and the garden of the king " * 6] * 30, ["das haus und der garten des königs ist schön " * 6] * 30
    crf = langid_crf.train(en + de, ["en"] * 30 + ["de"] * 30, sequences=300)
    lab = langid_crf.Labeller(crf)
    p, _ = lab.marginals([langid_crf.words_of("the house of the king und der garten des königs")])
    assert [crf.labels[k] for k in p.argmax(1)] == ["en"] * 5 + ["de"] * 5
    assert lab.shares(["", None, "12 !"]).sum() == 0


def test_counterfactual_penalty_draws_identity_terms_together():
    texts, labels = [], []
    for i in range(60):
        toxic = i % 3 == 0
        texts.append(f"w{i} {'muslim' if toxic or i % 7 == 0 else 'christian'} people {'moron scum' if toxic else 'kind words'} here.")
        labels.append(int(toxic))
    free, tied = toxicity.train(texts, labels, penalty=0.0), toxicity.train(texts, labels, penalty=5.0)

    def gap(m):
        return abs(m.word_weight("muslim") - m.word_weight("christian"))

    assert gap(tied) < 0.5 * gap(free)
    s = toxicity.Scorer(tied).score(["a moron and scum", "a muslim neighbour of mine", "", None])
    assert s[0] >= 0.5 > s[1] and s[2] == s[3]
    assert ("a gay man", "a straight man") in toxicity.swapped("A gay man")


def test_page_blocks():
    page = html_extract.Page("<body><nav><a href='/x'>m</a></nav><div class='post 12'><p>A &amp; b<p>c <b>d</b><br>e<script>var t='</p>'</script></div><p>x &lt")
    assert [t for _, t in page.blocks] == ["m", "A & b", "c d e", "x <"]
    # a head ends at the first tag that cannot stand in it, and html and body may be left out
    assert [t for _, t in html_extract.Page("<html><head><title>t</title><body><p>hello world</p></body></html>").blocks] == ["hello world"]
    assert [t for _, t in html_extract.Page("<title>t</title><p>one<p>two").blocks] == ["one", "two"]
    assert html_extract.main_text("<nav>a</nav><form><p>long enough text</p><p>x</p></form>", {"nav"}, {"form"}) == "long enough text\nx"


def test_word_hashes_by_blocks(monkeypatch):
    text = b"a bb " + b"x" * 300 + b" ccc" * 50 + b" Y" * 9
    data = np.frombuffer(text, np.uint8)
    begin = np.array([i for i in range(len(text)) if text[i] != 32 and (i == 0 or text[i - 1] == 32)])
    end = np.array([i + 1 for i in range(len(text)) if text[i] != 32 and (i + 1 == len(text) or text[i + 1] == 32)])
    whole = setjoin.word_hashes(data, begin, end)
    monkeypatch.setattr(setjoin, "_BLOCK", 64)
    monkeypatch.setattr(setjoin, "_powers", [])
    assert (setjoin.word_hashes(data, begin, end) == whole).all() and len(set(whole.tolist())) == 5


def test_graph_search_recall():
    x = np.random.default_rng(1).normal(size=(1500, 32)).astype(np.float32)
    graph, entry = graphs.build(x)
    ids, dist, _ = graphs.beam_search(x, (x * x).sum(1), graph, entry, x[:100] + 0.01, 80)
    true = ((x[None] - (x[:100, None] + 0.01)) ** 2).sum(2).argsort(1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) > 0.9
    assert (np.diff(dist, axis=1) >= 0).all()


def test_pack_crc():
    assert zlib.crc32(wordbpe.pack([1, 70000])) == zlib.crc32(b"\x01\0\0\0\x70\x11\x01\0")


def test_words_are_encoded_without_their_places():
    """op4: ids alone are asked for, from the library's call that works out no places in the text; older words stay at hand."""

    class Library:
        def __init__(self, library):
            self.encode_batch_fast, self.get_vocab = library.encode_batch_fast, library.get_vocab

    encoder, lib = wordbpe.WordEncoder(WORD, 3), wordbpe.load(WORD)
    encoder.library = Library(lib)
    for texts in (["the of and entia", "été 12's"], ["ment of", "the"], ["entia the été"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
