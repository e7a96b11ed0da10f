"""Exact dedup, n-gram join, substring dedup and embedding dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpus_guard.llm.components import components
from corpus_guard.llm.embedding_dedup import FULL, _entries, near_duplicates
from corpus_guard.llm.exact_dedup import drop_duplicates, exact_dedup
from corpus_guard.llm.ngram_join import _repeated, drop_near_duplicates, ngram_components, shingle_sets
from corpus_guard.llm.staging import BATCH_BYTES
from corpus_guard.llm.substring_dedup import compact, remove_repeats, repeated_spans

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=120, seed=3):
    """Random texts with copies, edited copies, shared passages, odd rows and a hot group."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "Ünï", "ß", " x"]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.choice([1, 3, 4, 5, 6, 30, 90, 200]))]
        if i % 7 == 0:
            words = words[:10] + passage + words[10:]
        rows.append((i, r.choice([" ", "\n", "  \t"]).join(words)))
    for i in range(n, 2 * n):
        j = r.randrange(n)
        words = rows[j][1].split()
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = r.choice(vocab)
        rows.append((i, " ".join(words) if i % 3 else rows[j][1].upper()))
    base = [r.choice(vocab) for _ in range(80)]
    for i in range(2 * n, 2 * n + 60):
        words = list(base)
        for _ in range(r.randrange(7)):
            words[r.randrange(80)] = r.choice(vocab)
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n "), (903, ""), (904, "a " * 5000), (None, "a b"), (None, None), (905, "a b"), (905, "a b"), (906, rows[5][1]), (906, rows[6][1])]


def same(got, want):
    key = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("extra", [False, True])
def test_exact(docs, extra):
    rows = corpus()
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest(), []).append(i)
    got = exact_dedup(docs(rows, extra)).collect()
    want = [(i, max((x for x in g if x is not None), default=None), len(g), h) for h, g in groups.items() for i in g]
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], want)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)
    left = drop_duplicates(docs(rows, extra))
    assert left.columns == docs(rows, extra).columns
    same([(r.doc_id, (r.text or "").translate(LOWER)) for r in left.collect()], [(r.keep_id, next((t or "").translate(LOWER) for i, t in rows if hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest() == r.text_sha256)) for r in kept])


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    ids = {}
    for a, (i, _) in enumerate(rows):
        ids.setdefault(find(a), []).append(i)
    return sets, [min((x for x in ids[find(a)] if x is not None), default=None) for a in range(len(rows))], len(ids)


@pytest.mark.parametrize("most", [1 << 18, 8])
def test_ngram(docs, most):
    rows = corpus()
    sets, comp, n = brute_components(rows)
    got = ngram_components(docs(rows, True), most=most).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in got], [(i, len(s), c) for (i, _), s, c in zip(rows, sets, comp)])
    left = drop_near_duplicates(docs(rows, True), most=most)
    assert left.count() == n and left.columns == docs(rows, True).columns


def brute_repeats(rows, k):
    words = [WORD.findall(t or "") for _, t in rows]
    count = {}
    for w in words:
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            count[g] = count.get(g, 0) + 1
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_texts_reach_python_in_bounded_batches(spark, docs):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lpad("id", 10, " "), 500).alias("text"))
    few = docs([(1, "a b c"), (2, "a b c")])
    spark.conf.unset(key)
    ngram_components(few).collect()
    seen = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(seen) > 3000 * 5000 and max(seen) < 1.1 * BATCH_BYTES
    try:
        spark.conf.set(key, "1m")
        ngram_components(few).collect()
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key)


def test_repeats_of_shingles_are_counted():
    texts = [t or "" for _, t in corpus(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 7])], ["text"]) for i in range(0, len(texts), 7)]
    sets = {s.tobytes(): s for _, s in shingle_sets(pa.array(texts))}
    value, times = np.unique(np.concatenate(list(sets.values())), return_counts=True)
    got = {r["token"]: r["n"] for out in _repeated(5)(batches) for r in out.to_pylist()}
    assert got == dict(zip(value[times > 1].view(np.int64).tolist(), times[times > 1].tolist())) and len(got) > 100
    assert [out.num_rows for out in _repeated(5)([pa.RecordBatch.from_arrays([pa.array([None, " ", "a"])], ["text"])])] == [0]


@pytest.mark.parametrize(("k", "seed"), [(35, 8), (10, 3), (8, 8)])
def test_substring(docs, k, seed):
    rows = corpus()
    got = remove_repeats(docs(rows, True), k=k, seed=seed).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], brute_repeats(rows, k))


def test_empty_tables(docs):
    none = docs([])
    assert exact_dedup(none).count() == 0 and ngram_components(none).count() == 0 and remove_repeats(none).count() == 0
    assert drop_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (None, 3), (7, 9), (9, 7), (200, 7)] + [(1, x) for x in range(300, 340)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[200] == got[9] == got[7] == 7 and got[339] == 1 and 5 not in got


def test_embeddings(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 32))
    vectors = [(i, (centres[i % 12] + r.normal(size=32) * r.choice([0.05, 0.2, 0.35])).tolist()) for i in range(400)]
    vectors += [(400 + i, vectors[0][1]) for i in range(50)] + [(500, None), (501, [0.0] * 32), (502, [float("nan")] * 32), (503, [1.0, None] * 16), (504, [1.0] * 3), (505, []), (None, vectors[1][1]), (506, [1e308 * 10] * 32)]
    x = np.array([v for _, v in vectors[:450]] + [vectors[1][1]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    got = near_duplicates(spark.createDataFrame([(*v, "a") for v in vectors], "vec_id long, embedding array<double>, key string"), block=64).collect()
    assert len(got) == len(vectors)
    links = {r.vec_id: r.n_links for r in got}
    found = sum(links[i] for i in range(450))
    assert found >= 0.9 * near[:450].sum() and found <= near[:450].sum()
    assert all(links[i] == 0 for i in range(500, 507)) and all(r.component_id == r.vec_id and r.kept for r in got if r.vec_id in range(500, 507))
    assert links[400] >= 50
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert near_duplicates(empty).count() == 0


def brute_links(vectors, cosine=0.9):
    """Links and components of vectors of any lengths."""
    x = []
    for _, v in vectors:
        ok = v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        a = np.array(v, float) / np.abs(v).max() if ok else None
        x.append(a / np.linalg.norm(a) if ok else None)
    n = len(x)
    links = [[j for j in range(n) if j != i and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
    least = {}
    for i in range(n):
        least.setdefault(root[i], []).append(vectors[i][0])
    return [len(a) for a in links], [min((k for k in least[r] if k is not None), default=None) for r in root]


@pytest.mark.parametrize("sizes", [{}, {"block": 16, "full": 24, "dense": 8}])
def test_embeddings_of_all_kinds(spark, sizes):
    r = np.random.default_rng(3)
    base = r.normal(size=48)
    vectors = [(i, (base + r.normal(size=48) * (0.03 if i % 3 else 0.3)).tolist()) for i in range(150)]  # one hot ball and a looser ring
    other = r.normal(size=48)
    vectors += [(1000 + i, (other + r.normal(size=48) * 0.02).tolist()) for i in range(80)]
    vectors += [(2000, [1e-200, 0.0, 0.0]), (2001, [2e-200, 0.0, 0.0]), (2002, [1e300, 1e300, 0.0]), (2003, [1e-310, 1e-310, 0.0]), (2004, [3.0, 3.0, 0.0])]
    vectors += [(2010, [1.0, 2.0]), (2011, [1.0, 2.0]), (2012, [-1.0, -2.0]), (2013, [5.0]), (2014, [0.1]), (2015, [-5.0]), (2016, [1.0, 2.0, 0.0])]
    vectors += [(7, vectors[3][1]), (7, [0.0] * 48), (None, vectors[160][1]), (None, None), (2020, []), (2021, None), (2022, [None, 1.0]), (2023, [float("inf"), 1.0])]
    want = brute_links(vectors)
    got = near_duplicates(spark.createDataFrame([(*x, 1, "s") for x in vectors], "vec_id long, embedding array<double>, node int, uid string"), **sizes).collect()
    same([(x.vec_id, x.n_links, x.component_id) for x in got], [(v[0], n, c) for v, n, c in zip(vectors, *want)])
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)


def test_embedding_recall_at_the_threshold(spark):
    """Pairs at a cosine of exactly 0.9 in 64 components among other vectors."""
    r = np.random.default_rng(9)
    a, b = r.normal(size=(2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = 0.9 * a + np.sqrt(1 - 0.81) * b + 1e-9 * a
    rows = [(2 * i + j, v.tolist()) for i in range(1500) for j, v in enumerate((a[i], c[i]))]
    for full in (1024, 2):
        got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), full=full).where("n_links > 0").count() / 2
        print("recall", full, got / 1500)
        assert got >= 0.9 * 1500


def test_entries_do_not_depend_on_the_crowd(spark):
    """What a vector meets follows from its own codes, not from how many others share a bucket."""
    rows = [(i, 4, i, i, [5, 6 + i % 2, 9], [1, 2, 3 + i]) for i in range(1300)]
    make = lambda rows: {tuple(r) for r in _entries(spark.createDataFrame(rows, "node long, dim int, s1 long, s2 long, codes array<bigint>, thirds array<bigint>"), 2, FULL).where("node in (0, 2)").collect()}
    few, many = make([rows[0], rows[2]]), make(rows)
    # entries of buckets that the two share are the same, and the crowd only adds buckets that hold one of them with others
    assert len(few) > 4 and few <= many


def test_compaction_of_links(spark):
    """Chains, a cycle and lone links against walking them."""
    r = random.Random(8)
    ids = r.sample(range(-10**12, 10**12), 700)
    chains, at = [], 0
    for size in (2, 3, 300, 90, 17, 2):
        chains.append(ids[at : at + size])
        at += size
    rows = [(a, b, r.randrange(1, 9)) for c in chains for a, b in zip(c, c[1:])]
    ring = ids[600:605]
    rows += [(a, b, 1) for a, b in zip(ring, ring[1:] + ring[:1])]
    size = {a: n for a, _, n in rows}
    want = {x: (x, 0) for x in ring}
    for c in chains:
        off = 0
        for a, b in zip(c, c[1:]):
            off += size[a]
            want[b] = (c[0], off)
    got = {x.v: (x.head, x.offset) for x in compact(spark.createDataFrame(r.sample(rows, len(rows)), "u long, v long, n int")).collect()}
    assert got == want
    assert compact(spark.createDataFrame([], "u long, v long, n int")).count() == 0


def test_paths_do_not_branch(spark):
    """Every repeated window has one place in one path; a path's windows follow each other wherever they occur."""
    k = 6
    texts = ["a b c d e f g h i j k l m", "a b c d e f g h i j k l m", "x y c d e f g h i j k z w", "x y c d e f g h i j k z w", "q q q q q q q q q q q q q", "c d e f g h i"]
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "u1 long, u2 int, text string")
    word, spot = {}, {}
    for x in repeated_spans(docs, k, 3).collect():
        w = texts[x.u1].split()
        for i in range(x.n):
            gram = tuple(w[x.start + i : x.start + i + k])
            word.setdefault(gram, set()).add((x.path, x.offset + i))
            spot.setdefault((x.path, x.offset + i), set()).add(gram)
    count = {}
    for t in texts:
        w = t.split()
        for i in range(len(w) - k + 1):
            count[tuple(w[i : i + k])] = count.get(tuple(w[i : i + k]), 0) + 1
    assert set(word) == {g for g, n in count.items() if n > 1} and all(len(p) == 1 for p in word.values()) and all(len(g) == 1 for g in spot.values())
    inner = [p for g in word for p in word[g] if g[0] in "cdef" and g[-1] in "hijk"]
    assert len({p for p, _ in inner}) == 1


def test_rows_that_repeat_share_their_spans(docs):
    rows = [(7, " ".join(f"w{i}" for i in range(200)))] * 300 + [(8, " ".join(f"v{i}" for i in range(100))), (None, None)]
    same([(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in remove_repeats(docs(rows)).collect()], brute_repeats(rows, 35))
