"""HTML, mixing, WARC, toxicity, quality, packing and the pipeline."""

import base64
import gzip
import hashlib
import os
import tempfile
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpus_guard.llm.deobfuscate import CLASSES, Decoder, pieces, trigram_ids
from corpus_guard.llm.html_extract import extract_text
from corpus_guard.llm.mixing import mixture, select_mixture
from corpus_guard.llm.exact_dedup import drop_duplicates
from corpus_guard.llm.ngram_join import drop_near_duplicates
from corpus_guard.llm.packing import CAPACITIES, best_fit, pack
from corpus_guard.llm.quality import grade, parts_of, ratings
from corpus_guard.llm.toxicity import drop_toxic, features, score
from corpus_guard.llm.warc import export_warc, read_archive, read_warc, write_archive

SF = "/root/testdata/sf0.01"


def page(body, nav="Home"):
    return f"<!DOCTYPE html><html><head><title>t</title><script>x('</p>')</script></head><body><nav><ul><li><a href='/'>{nav}</a></li></ul></nav><div class='ad'>Buy</div>{body}<footer>c</footer></body></html>"


def test_html(spark):
    rows = [
        (1, "http://a.example/1", page("<article><h1>One &amp; two</h1><p><b>First<br>line.<p>Second&nbsp;par  t.</p></article>")),
        (2, "http://a.example/2", page("<article><h1>H</h1><p>x</p><div class='comments'>bad</div></article>")),
        (3, "http://a.example/3", page("<article><h1>H</h1><p>open &lt;p&gt;")),
        (4, "http://b.example/1", page("<div class='notice'>Same notice</div><div id='c'><p>Alone one</p></div>")),
        (5, None, None), (6, "", ""), (7, "http://c.example", "just text  here"), (None, "http://a.example/9", page("<main><p>m</p><form>f</form></main>")),
        (9, "http://d.example/1", "<div>" * 400 + "deep" + "</div>" * 400),
    ]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")).collect()}
    assert got == {1: "One & two\n\nFirst line.\n\nSecond par t.", 2: "H\n\nx", 3: "H\n\nopen <p>", 4: "Alone one", 5: "", 6: "", 7: "just text here", None: "m", 9: "deep"}
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_template_is_induced(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>Welcome to our site</p></div><section><p>Story number {i} has its own words</p></section><div><p>All rights kept</p></div></body>") for i in range(8)]
    got = [r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == [f"Story number {i} has its own words" for i in range(8)]


def test_mixing_schedule(spark):
    rows = [(i, "x" * 50, "abc"[min(i % 10, 2)]) for i in range(3000)] + [(None, None, None), (9001, "", "d"), (9001, "", "d")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, slot int")
    weights = {"a": 5, "b": 3, "c": 2}
    got = mixture(docs, weights, block_chars=100).collect()
    assert len(got) == len(rows)
    slots = {r.slot: r.source for r in got if r.selected}
    last = max(slots)
    assert sorted(slots) == list(range(last + 1))
    for t in range(1, last + 1):
        for s, w in weights.items():
            assert abs(sum(slots[k] == s for k in range(t)) - t * w / 10) < 1
    assert not any(r.selected for r in got if r.source not in weights)
    assert select_mixture(docs, weights, block_chars=100).count() == sum(r.selected for r in got)
    even = mixture(docs, block_chars=100).collect()
    assert any(r.selected for r in even) and mixture(docs.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rows = [(3, "http://x", "<p>é</p>"), (1, "http://x\r\nbad", "<p>é</p>"), (2, None, None), (5, "u", ""), (None, "u", "q"), (7, "u", "q\r\n\r\nr"), (1, "again", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/a"
    write_archive(pages, path)
    got = read_archive(spark, path).collect()
    assert sorted(str((r.record_id, bytes(r.payload).decode())) for r in got) == sorted(str((i, h or "")) for i, _, h in rows)
    for r in got:
        assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() and r.payload_bytes == len(r.payload)
    kind = sorted(str((r.record_id, r.record_type, r.refers_to)) for r in got)
    assert kind == sorted(map(str, [(3, "revisit", 1), (1, "response", None), (1, "revisit", 1), (2, "response", None), (5, "revisit", 2), (None, "response", None), (7, "response", None)]))
    assert spark.read.parquet(path + "/payloads").count() == 4
    export_warc(spark, path, path + "-warc")
    raw = b"".join(gzip.open(os.path.join(path + "-warc", f)).read() for f in sorted(os.listdir(path + "-warc")) if f.endswith(".gz"))
    seen = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        n = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")][0][16:])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
        raw, seen = rest[n + 4 :], seen + 1
    assert seen == len(rows)
    write_archive(pages.limit(0), path + "0")
    assert read_archive(spark, path + "0").count() == 0


def test_warc_damage_is_loud(spark):
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/a"
    write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), path)
    spark.read.parquet(path + "/payloads").withColumn("payload", F.lit("y").cast("binary")).write.parquet(path + "2/payloads")
    spark.read.parquet(path + "/headers").write.parquet(path + "2/headers")
    with pytest.raises(Exception, match="does not match"):
        read_archive(spark, path + "2").collect()


def test_decoder():
    text = " ".join(["you are an idiot and a moron you stupid loser", "trash clown pathetic worthless person"] * 200)
    d = Decoder(np.bincount(trigram_ids(text), minlength=CLASSES**3))
    for noisy, plain in {"1d10t": "idiot", "m0r0n": "moron", "stuuuupid": "stupid", "i d i o t": "idiot", "l.o.s.e.r": "loser", "cl0wn": "clown", "tr4sh": "trash", "st*pid": "stupid"}.items():
        assert d.clean(f"you {noisy} person") == f"you {plain} person"
    assert d.clean("plain words stay, 2024 too") == "plain words stay, 2024 too"


def toxic_corpus(spark):
    words = ["tree", "river", "stone", "cloud", "light", "window", "paper", "garden"]
    bad = ["idiot", "moron", "stupid"]
    r = np.random.default_rng(2)
    rows = []
    for i in range(600):
        w = list(r.choice(words, 30))
        if i % 4 == 0:
            w[3] = w[9] = bad[i // 4 % 3]
        rows.append((i, " ".join(w)))
    hidden = [(1000, "river stone 1d10t garden m0r0n tree"), (1001, "tree i d i o t paper s t u p i d cloud"), (1002, None), (1003, ""), (None, "tree river")]
    docs = spark.createDataFrame([(*x, "q") for x in rows + hidden], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 != 1), int(i % 4 == 0)) for i, _ in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_corpus(spark)
    got = {r.doc_id: r for r in score(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [r for i, r in got.items() if r.held_out and i is not None and i < 600]
    assert held and sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert got[1000].predicted == 1 and got[1001].predicted == 1 and got[1002].predicted == 0 and got[1002].score == got[1003].score
    left = drop_toxic(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.score < 0.7}
    assert len({r.score for r in score(docs, labels.where("toxic = 0")).collect()}) == 1
    assert score(docs.limit(0), labels).count() == 0


def test_toxicity_held_out_on_tables(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    both = score(docs, labels).join(labels, "doc_id").join(docs.where("lang = 'en'").select("doc_id"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in both) >= 0.85 * len(both)


def test_quality(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(10_001, None), (10_002, ""), (None, "x")], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    got = grade(every, ratings(labels))
    assert got.count() == every.count()
    bad = got.where("p_ge_2 > p_ge_1 or p_ge_1 < 0 or p_ge_1 > 1 or abs(expected_grade - p_ge_1 - p_ge_2) > 1e-9").count()
    assert bad == 0
    held = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.selected == bool(r.quality) for r in held) >= 0.9 * len(held)
    assert grade(every.limit(0), ratings(labels)).count() == 0 and grade(odd, ratings(labels.limit(0))).count() == 3


def check_packing(rows, lengths):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows if r.piece_no == 0) == sorted((i is None, i or 0) for i, _ in lengths)
    assert sum(r.n_tokens for r in rows) == sum(n + 1 for _, n in lengths)
    bins = {}
    for r in rows:
        b = bins.setdefault(r.bin_id, [r.bin_capacity, r.bin_tokens, 0])
        assert b[:2] == [r.bin_capacity, r.bin_tokens]
        b[2] += r.n_tokens
    for capacity, tokens, total in bins.values():
        assert tokens == total <= capacity and capacity == min(c for c in CAPACITIES if c >= total)
    return bins


@pytest.mark.parametrize("shard", [20_000, 50])
def test_packing(spark, shard):
    r = np.random.default_rng(4)
    lengths = [(i, int(n)) for i, n in enumerate(r.integers(0, 900, 300))] + [(400, 4095), (401, 4096), (402, 20_000), (None, 3), (7, 5), (7, 5)]
    rows = [(i, "w " * n if n else None) for i, n in lengths]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, shard int")
    got = pack(docs, shard=shard).collect()
    bins = check_packing(got, lengths)
    if shard > 1000:
        assert sum(b[0] for b in bins.values()) < 1.05 * sum(n + 1 for _, n in lengths)
    assert sorted(map(str, got)) == sorted(map(str, pack(docs, shard=shard).collect()))
    assert pack(docs.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        now = step(spark, kept, SF)
        assert now.columns == docs.columns and 0 < now.count() <= kept.count(), name
        kept = spark.createDataFrame(now.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    check_packing(last, [(r.doc_id, len(r.text.encode().split())) for r in kept.collect()])
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in kept.collect()}


def brute_path(d, span):
    """Best of all paths through the lattice of a short span."""
    best = {}

    def walk(i, last, a, b, score, text):
        if i == len(span):
            total = score + d.logp[a, b, 0]
            if total > best.get("score", -1e9):
                best.update(score=total, text=text)
            return
        options, drop = d.options(span[i], last)
        if drop is not None:
            walk(i + 1, span[i], a, b, score - drop, text)
        for to, c, price in options:
            walk(i + 1, span[i], b, c, score - price + d.logp[a, b, c], text + to)

    walk(0, "", 0, 0, 0.0, "")
    return best["text"]


@pytest.fixture(scope="module")
def decoder():
    text = " ".join(["you are an idiot and a moron you stupid loser", "trash clown pathetic worthless person"] * 200)
    return Decoder(np.bincount(trigram_ids(text), minlength=CLASSES**3))


def test_viterbi_against_all_paths(decoder):
    r = np.random.default_rng(5)
    for _ in range(150):
        span = "".join(r.choice(list("aidoti01$!*8|. -о"), r.integers(2, 8)))
        assert decoder.restore(span) == brute_path(decoder, span), span


def test_decoding_is_linear(decoder):
    for text in ("0" * 10_000 + "a%", "$" * 10_000 + "a%", "+" * 10_000 + "a%", "0" * 10_000 + "é", "a" * 200_000 + "1" * 5 + "é", "x-" * 10_000 + "é"):
        began = time.time()
        decoder.clean(text)
        assert time.time() - began < 2, text[:3]


def test_lookalikes_and_hidden_characters(decoder):
    for noisy, plain in {"idiоt": "idiot", "mοrоn": "moron", "ｉｄｉｏｔ": "idiot", "id​i­ot": "idiot", "st-up1d": "stupid"}.items():
        assert decoder.clean(f"you {noisy} person") == f"you {plain} person"
    for plain in ("сон и мир", "και", "café naïve", ""):
        assert decoder.clean(plain) == plain


def test_long_texts_in_pieces(decoder):
    text = "the tree stands by the river 1d10t s t u p i d person\n" * 60_000
    assert "".join(pieces(text)) == text and len(list(pieces(text))) > 2
    assert "".join(decoder.clean(x) for x in pieces(text)) == "the tree stands by the river idiot stupid person\n" * 60_000
    one = features(decoder, [text[:54], "other words", text, None])
    assert sorted(one[1][one[0] == 0]) == sorted(one[1][one[0] == 2]) and not (one[0] == 3).any()


def test_training_rows_with_repeated_ids(spark):
    docs, labels = toxic_corpus(spark)
    twice = docs.unionByName(docs).unionByName(docs.where("doc_id < 300").withColumn("text", F.concat(F.lit("window "), "text")))
    few = [sorted(map(str, score(x, labels, max_train=100).collect())) for x in (twice, twice.repartition(7), twice.orderBy(F.desc("text")))]
    assert few[0] == few[1] == few[2] and len(few[0]) == twice.count()


def plain_best_fit(lengths, capacities, per_bin, prefer):
    """Best fit by looking through all open bins."""
    rate = min((c + per_bin) / c for c in capacities)
    bins, where = [], []
    for n in lengths:
        open_bins = [(size - held, i) for i, (size, held) in enumerate(bins) if size - held >= n]
        if open_bins:
            least = min(r for r, _ in open_bins)
            # of bins with equal room the one that came to it last
            i = max((touched[i], i) for r, i in open_bins if r == least)[1]
        else:
            size = prefer if prefer is not None and prefer >= n else min((c for c in capacities if c >= n), key=lambda c: (c + per_bin - rate * (c - n), c))
            bins.append((size, 0))
            i = len(bins) - 1
            touched = touched if i else {}
        bins[i] = (bins[i][0], bins[i][1] + n)
        touched[i] = len(where)
        where.append(i)
    sizes = [min(c for c in capacities if c >= held) for _, held in bins]
    return where, [held for _, held in bins], sizes, sum(sizes) + per_bin * len(bins)


@pytest.mark.parametrize("prefer", [None, 8, 16, 32])
def test_best_fit_against_all_bins(prefer):
    r = np.random.default_rng(6)
    for _ in range(60):
        lengths = sorted((int(x) for x in r.integers(1, 33, r.integers(1, 60))), reverse=True)
        got, want = best_fit(lengths, (8, 16, 32), 2, prefer), plain_best_fit(lengths, (8, 16, 32), 2, prefer)
        assert got[0] == want[0] and got[1] == want[1] and list(got[2]) == want[2] and got[3] == want[3]


def test_packing_of_one_repeated_id(spark):
    docs = spark.createDataFrame([(None, "w " * (i % 50)) for i in range(2000)] + [(5, "w")] * 500, "doc_id long, text string")
    got = pack(docs, shard=100).collect()
    bins = check_packing(got, [(r.doc_id, len((r.text or "").split())) for r in docs.collect()])
    assert len({b.split("-")[0] for b in bins}) >= 20


def test_stages_keep_columns_of_any_name(spark):
    names = ["_sha", "_text_key", "_id", "_key", "_lost", "_keep", "_source", "_n", "_slot", "_rank", "_nth", "source"]
    rows = [(i, f"some text of words that are {i % 3}", *["v"] * len(names)) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for fn in (drop_duplicates, drop_near_duplicates, select_mixture, corpus_pipeline.mixing and (lambda d: corpus_pipeline.mixing(spark, d, None))):
        out = fn(docs)
        got = out.collect()
        assert out.columns == docs.columns and got and all(r[2:] == ("v",) * len(names) for r in got)


def test_mixture_keeps_selected_twins(spark):
    rows = [(7, "x" * 50, "a")] * 400 + [(i, "y" * 50, "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    picked = mixture(docs, {"a": 1, "b": 1}, block_chars=100).where("selected").count()
    assert 0 < picked < 500 and select_mixture(docs, {"a": 1, "b": 1}, block_chars=100).count() == picked


def test_batches_in_parts():
    batch = pa.RecordBatch.from_pydict({"text": pa.array([None, "", "a" * 100, "b" * 5000, "c", None, "d" * 3000])})
    parts = list(parts_of(batch, 1000))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and len(parts) > 2
    assert not list(parts_of(batch.slice(0, 0)))


def test_warc_files_and_text_ids(spark):
    rows = [("null", "u", "p" * 5), ("a:b:1", "u", "same"), (None, "u", "same"), ("é %3A", "u", "same"), ("z", "u", "p" * 5), (None, "u", "lone"), ("", "u", "q\r\n\r\nr"), ("x", "v", "q\r\n\r\nr"), ("big", "u", "é" * 3_000_000)]
    path = tempfile.mkdtemp(prefix="spark-warc-") + "/a"
    write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"), path)
    got = {(r.record_id, bytes(r.payload).decode()): (r.record_type, r.refers_to) for r in read_archive(spark, path).collect()}
    want = {(i, h): ("response", None) for i, _, h in rows}
    want[None, "same"] = want["é %3A", "same"] = ("revisit", "a:b:1")
    want["z", "p" * 5] = ("revisit", "null")
    want["x", "q\r\n\r\nr"] = ("revisit", "")
    assert got == want
    export_warc(spark, path, path + "-warc")
    found = read_warc(spark, path + "-warc/*.gz").collect()
    assert len(found) == len(rows) and all(r.header.startswith("WARC/1.1\r\n") and f"Content-Length: {len(r.block)}\r\n" in r.header for r in found)
    assert sorted(bytes(r.block).partition(b"\r\n\r\n")[2].decode() for r in found if "response" in r.header.split("\r\n")[1]) == sorted(h for (_, h), (k, _) in want.items() if k == "response")
