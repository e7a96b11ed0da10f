
import random

import numpy as np
import pytest

import corpus_pipeline
from corpus_guard.llm.deobfuscate import CLASSES, Decoder, trigram_ids
from corpus_guard.llm.html_extract import extract_text
from corpus_guard.llm.mixing import in_mixed_order, mixture
from corpus_guard.llm.ngram_join import _parity, ngram_components


@pytest.mark.parametrize("n", [512, 1024, 2048])
def test_parity_folds(n):
    s = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n + 6, dtype=np.uint64))
    small, large = _parity(s[:n]).view(np.uint64), _parity(s).view(np.uint64)
    assert len(large) == 2 * len(small)
    folded = large[: len(small)] ^ large[len(small) :]
    assert sum(int(x).bit_count() for x in folded ^ small) <= 6


def test_ngram_on_both_sides_of_bitmap_sizes(spark):
    r = random.Random(7)
    rows = []
    for n in (512, 1024, 2048):
        words = [f"w{r.randrange(10**9)}" for _ in range(n + 64)]
        for extra in (0, 1, 30):
            rows.append((len(rows), " ".join(words[: n + 4 + extra])))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = {}
    for i, a in enumerate(sets):
        want[i] = min(j for j, b in enumerate(sets) if 100 * len(a & b) >= 75 * len(a | b))
    got = {x.doc_id: x.component_id for x in ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) == 3


def test_small_source_does_not_end_the_mixture(spark):
    rows = [(i, "x" * 50, "ab"[i % 3 == 0]) for i in range(3000)] + [(9000, "y", None), (9001, "", "empty"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(map(str, corpus_pipeline.mixing(spark, docs, None).collect())) == sorted(map(str, docs.collect()))
    got = mixture(docs, block_chars=100, leave=True).collect()
    slots = {r.slot: r.source for r in got}
    assert all(r.selected for r in got) and sorted(slots) == list(range(1000 + 500 + 1 + 1))


def test_mixture_keeps_weights_until_a_source_leaves(spark):
    docs = spark.createDataFrame([(i, "x" * 50, "abc"[min(i % 10, 2)]) for i in range(3000)], "doc_id long, text string, source string")
    weights = {"a": 5, "b": 3, "c": 2}
    got = mixture(docs, weights, block_chars=50, leave=True).collect()
    slots = {r.slot: r.source for r in got}
    assert sorted(slots) == list(range(3000))
    until = max(k for k, s in slots.items() if s == "a") + 1
    assert until in (599, 600)
    for t in range(1, until + 1):
        for s, w in weights.items():
            assert abs(10 * sum(slots[k] == s for k in range(t)) - t * w) < 10
    order = [r.source for r in in_mixed_order(docs, weights=weights, block_chars=50).collect()]
    assert order == [slots[k] for k in range(3000)]


def test_decoder_ends_and_lengths():
    text = " ".join(["you are a worthless idiot and a vile loser with no class", "garbage trash clown pathetic person this is bold and plain"] * 200)
    d = Decoder(np.bincount(trigram_ids(text), minlength=CLASSES**3))
    forms = {"vil3": "vile", "garb4g3": "garbage", "cla$$": "class", "1diot!": "idiot!", "l0s3r!!": "loser!!", 'idi0t"': 'idiot"', "(idi0t)": "(idiot)", "(l o s e r)": "(loser)"}
    for noisy, plain in forms.items():
        assert d.clean(f"you {noisy} person") == f"you {plain} person"
    assert d.clean("y o u a r e a w o r t h l e s s i d i o t a n d a v i l e l o s e r").replace(" ", "") == "youareaworthlessidiotandavileloser"
    assert d.clean("you id" + "i" * 100 + "ot") == "you idiot"
    assert len(d.clean("l o s e r " * 4000 + "x")) < 30_000
    for plain in ("this is **bold** and plain!", "|trash|person|", "x" + "1" * 5 + "\u00e9"):
        assert d.clean(plain) == plain


def test_html_host_of_copies(spark):
    def html(n):
        return f"<body><div><p>Welcome to our site</p></div><section><p>Story number {n} has its own words</p></section><div><p>All rights kept</p></div></body>"

    rows = [(i, "http://h.example/x", html(0 if i < 20 else i)) for i in range(26)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story number {0 if i < 20 else i} has its own words" for i in range(26)}
