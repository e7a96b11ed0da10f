"""Embedding whitening, conversation repair and decontamination against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_guard.llm.conversation_repair import audit_conversations, damage, repair_conversations
from corpus_guard.llm.decontaminate import SLICE, Automaton, Scanner, clean, contamination, words_of
from corpus_guard.llm.embedding_whitening import squares, whiten
from corpus_guard.llm.mixing import mixture, with_slots
from corpus_guard.llm.packing import pack

# ---- whitening


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    y = n * x - sums
    c = y / n
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1], u[:, ::-1]
    return n, [sum(int(v) ** 2 for v in row) for row in y], c @ u / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def vectors_of(spark, rows, extra=False):
    kind = "vec_id long, embedding array<float>"
    if extra:
        return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], kind + ", n long, component string, whitened double")
    return spark.createDataFrame(rows, kind)


@pytest.mark.parametrize("dim", [3, 8, 40, 100])
def test_whitening(spark, dim):
    r = np.random.default_rng(dim)
    data = (r.normal(size=(300, dim)) @ np.diag(np.linspace(3, 0.2, dim))).astype(np.float32)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(data)]
    odd = [(900, None), (901, [float("nan")] * dim), (902, [float("inf")] + [0.0] * (dim - 1)), (903, [None] + [0.0] * (dim - 1)), (904, []), (None, rows[0][1]), (5, rows[5][1])]
    got = whiten(vectors_of(spark, rows + odd, extra=dim == 8)).toPandas()
    good = rows + [(None, rows[0][1]), (5, rows[5][1])]
    n, deviation, w, explained = plain_whitening([v for _, v in good])
    k = min(8, dim)
    assert len(got) == k * n and set(got.n) == {n} and set(got.component) == set(range(1, k + 1))
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    for j in range(k):
        part = got[got.component == j + 1]
        assert np.allclose(part.explained, explained[j], rtol=1e-9)
        mine = {i: v for i, v in zip(part.vec_id, part.whitened) if i == i and i != 5}
        plain = {i: w[p, j] for p, (i, _) in enumerate(good) if i is not None and i != 5}
        sign = np.sign(sum(mine[i] * plain[i] for i in plain))
        assert max(abs(sign * mine[i] - plain[i]) for i in plain) < 1e-6
        assert sorted(part.deviation) == sorted(deviation) == sorted(int(v) for v in part.deviation_exact)


def test_whitening_of_odd_tables(spark):
    assert whiten(vectors_of(spark, [])).count() == 0
    assert whiten(vectors_of(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whiten(vectors_of(spark, [(i, [i / 7, 2 * i / 7, 0.0]) for i in range(20)])).toPandas()
    assert set(line.component) <= {1, 2} and line[line.component == 1].explained.min() > 0.99
    mixed = whiten(vectors_of(spark, [(i, [float(i % 3), float(i % 5)]) for i in range(15)] + [(100 + i, [float(i % 2)]) for i in range(4)])).toPandas()
    assert set(mixed[mixed.vec_id < 100].n) == {15} and set(mixed[mixed.vec_id >= 100].n) == {4} and len(mixed) == 34
    huge = whiten(vectors_of(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [-3e38, 5.0])])).toPandas()
    assert huge.deviation.isna().any() and set(huge.component) <= {1, 2}


def test_exact_squares():
    r = random.Random(1)
    rows = [[r.randrange(-(1 << 52), 1 << 52) for _ in range(9)] for _ in range(50)]
    assert squares(np.array(rows)) == [sum(v * v for v in row) for row in rows]
    rows = [[r.randrange(-(1 << 61), 1 << 61) for _ in range(3)] for _ in range(9)]
    assert squares(np.array(rows)) == squares(np.array(rows, object)) == [sum(v * v for v in row) for row in rows]


def test_near_ties_are_certified(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(r.normal(size=(400, 90)))]
    got = whiten(vectors_of(spark, rows), degree=12).toPandas()
    assert len(got) == 3200 and got.identity_error.max() < 1e-9


# ---- conversations

_OK = re.compile(r"(s?(ua)+)?")
_INK = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


def plain_audit(rows):
    """All ways to edit up to 5 rows, with up to two turns inserted at each gap."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        ink = _INK.findall(text)
        kinds.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    best = None
    edits = [("D",) if k in ("blank", "duplicate") else ("K", "Ru", "Ra", "D") for k in kinds]
    for choice in itertools.product(*edits):
        left = [(r, k, e) for r, k, e in zip(rows, kinds, choice)]
        for gaps in itertools.product(*([["", "u", "a", "ua", "au"]] * (len(rows) + 1))):
            cost, audit, out = 0, "", []
            for i, gap in enumerate(gaps):
                for g in gap:
                    cost, audit = cost + 5, audit + "I"
                    out.append(("user" if g == "u" else "assistant", ""))
                if i < len(rows):
                    r, k, e = left[i]
                    cost += {"K": 0, "R": 1, "D": 2}[e[0]] + (5 if k == "truncated" and e != "D" else 0)
                    audit += e[0]
                    if e != "D":
                        out.append((r[2] if e == "K" else "user" if e == "Ru" else "assistant", r[3]))
            if (best is None or (cost, audit) < best[:2]) and _OK.fullmatch("".join(r[:1] or "?" for r, _ in out)):
                best = (cost, audit, out)
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = lambda k: kinds.count(k)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, best[0], best[1], sha), best[2]


def conversations(seed, n=40, most=4):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t ", "ok?  ", "Ünï."]
    rows = []
    for conv in [*range(n), None]:
        for _ in range(r.randrange(1, most + 1)):
            rows.append((conv, r.choice([None, 0, 1, 2, 5, 9]), r.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), r.choice([*texts, None])))
    return rows


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_cheapest_repair_is_found(spark, seed):
    rows = conversations(seed, most=3)
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in audit_conversations(damage(spark.createDataFrame(rows, SCHEMA)), F.col("gone")).collect()}
    hurt = damaged(rows)
    assert set(got) == {r[0] for r in rows}
    turns = {}
    for r in repair_conversations(damage(spark.createDataFrame(rows, SCHEMA)), F.col("gone"), spill=16).orderBy("place").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv in got:
        want, repaired = plain_audit([r for r in hurt if r[0] == conv])
        assert got[conv] == want
        assert turns.get(conv, []) == repaired


def test_long_conversation_spills(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"text {i % 5000}.") for i in range(30_000)] + [(2, 0, "user", "x" * 5_000_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = audit_conversations(df).orderBy("conv_id").collect()
    assert plain == audit_conversations(df, spill=1000).orderBy("conv_id").collect()
    assert plain[0].duplicate == 25_000 and len(plain[0].audit) >= 30_000 and plain[1].audit == "D"


def test_conversations_of_odd_tables(spark):
    assert audit_conversations(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = [(c, t, "user", "Hi.") for c in range(30) for t in range(30) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    for r in audit_conversations(damage(spark.createDataFrame(gone, SCHEMA)), F.col("gone")).collect():
        assert tuple(r[f] for f in FIELDS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    clash = spark.createDataFrame([("a", 1, "user", "Hi.", "x", 3, True), ("a", 2, "assistant", "Yo.", "y", 4, False)], "conv_id string, turn int, role string, text string, audit string, conv int, gone boolean")
    (r,) = audit_conversations(clash).collect()
    assert (r.conv_id, r.cost, r.audit) == ("a", 0, "KK")


# ---- decontamination


def plain_contamination(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1)):
            if w:
                grams.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (items_here := grams.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= {str(x) for x in items_here if x is not None}
        out.append((doc, len(w), sorted(hit), sorted(found)))
    return out


def contaminated(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(25)] + ["É", "naïve", "X9"]
    say = lambda k: " ".join(r.choice(vocab) for _ in range(k))
    items = [(i, say(r.choice([3, 5, 9, 10, 11, 30, 80]))) for i in range(25)] + [(25, None), (26, " .,"), (None, say(12)), (27, say(40)), (28, ("a b " * 30))]
    items += [(29, items[3][1]), (30, items[5][1].upper() + " tail")]
    docs = []
    for i in range(n):
        w = say(r.choice([0, 1, 5, 40, 200])).split()
        for _ in range(r.randrange(3)):
            t = (r.choice(items)[1] or "").split()
            a = r.randrange(max(1, len(t) - 5)) if r.random() < 0.5 else 0
            w[len(w) // 2 : len(w) // 2] = t[a : a + r.choice([8, 10, 15, 100])]
        docs.append((i, r.choice([" ", ", ", "\n", "--"]).join(w)))
    return docs + [(900, None), (901, ""), (902, "..."), (903, docs[7][1]), (903, docs[7][1]), (None, docs[8][1]), (904, "a b " * 40)], items


def spread(starts, stops):
    return [i for a, b in zip(starts, stops) for i in range(a, b)]


@pytest.mark.parametrize("options", [{}, {"block": 40}, {"block": 40, "pass_bytes": 4000}])
@pytest.mark.parametrize("seed", [1, 2])
def test_contamination(spark, seed, options):
    docs, items = contaminated(seed)
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, items string, n int")
    got = contamination(frame, spark.createDataFrame(items, "item_id long, text string"), **options)
    assert got.columns == ["doc_id", "text", "items", "n", "n_words", "starts", "stops", "_items"]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([(r.doc_id, r.n_words, spread(r.starts, r.stops), list(r._items)) for r in got.collect()], key=key) == sorted(plain_contamination(docs, items), key=key)


def test_clean(spark):
    items = [(1, " ".join(f"q{i}" for i in range(20)))]
    leak = items[0][1].replace("q3 q4", "Q3, q4")
    rows = [(1, f"before it, {leak}; after\n" + "it " * 50), (2, leak + " x"), (3, None), (4, "q0 q1 q2"), (5, "")]
    frame = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, starts string")
    got = {r.doc_id: r.text for r in clean(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: "before it, ; after\n" + "it " * 50, 3: None, 4: "q0 q1 q2", 5: ""}
    none = spark.createDataFrame([], "item_id long, text string")
    assert clean(frame, none).count() == 5 and clean(frame.limit(0), none).count() == 0


def test_long_text_in_parts(spark):
    r = random.Random(4)
    items = [(i, " ".join(f"v{r.randrange(60)}" for _ in range(30))) for i in range(10)] + [(77, "v1 v2 v3")]
    words = [f"v{r.randrange(60)}" for _ in range(400_000)]
    for _ in range(4000):
        at, k = r.randrange(len(words)), r.randrange(8, 30)
        words[at : at + k] = items[r.randrange(10)][1].split()[:k]
    docs = [(1, " ".join(words)), (2, "x" * (3 * SLICE) + " " + items[0][1]), (3, " " * (2 * SLICE) + items[0][1])]
    assert len(docs[0][1]) > 2 * SLICE
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.n_words, spread(r.starts, r.stops), list(r["items"])) for r in sorted(got)] == plain_contamination(docs, items)


def test_longest_matching_lengths():
    r = random.Random(9)
    pieces = [("x", [b"%d" % r.randrange(3) for _ in range(60)], True) for _ in range(3)]
    a = Scanner(Automaton(pieces, 4)).a
    whole = [" ".join(w.decode() for w in p[1]) + " " for p in pieces]
    text, state, size = [b"%d" % r.randrange(3) for _ in range(300)], 0, 0
    for i, w in enumerate(text):
        state, size = a.step(state, size, a.word[w])
        want = max(k for k in range(i + 2) if k == 0 or any((" " + " ".join(x.decode() for x in text[i + 1 - k : i + 1]) + " ") in " " + t for t in whole))
        assert size == want


# ---- mixing: earliest deadline first, sources leave


def plain_schedule(weights, blocks):
    """Slot by slot: the source of each."""
    left, out, count, t = dict(blocks), [], dict.fromkeys(weights, 0), 0
    while any(left.values()):
        on = sorted(s for s in weights if left[s])
        d = sum(weights[s] for s in on)
        free = [(-(-(count[s] + 1) * d // weights[s]), s) for s in on if count[s] * d // weights[s] <= t]
        s = min(free)[1]
        out.append(s)
        count[s] += 1
        left[s] -= 1
        t += 1
        if not left[s]:
            count, t = dict.fromkeys(weights, 0), 0
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sources_leave_under_earliest_deadlines(spark, seed):
    r = random.Random(seed)
    weights = {f"s{i}": r.choice([1, 2, 3, 7, 20]) for i in range(7)}
    blocks = {s: r.choice([1, 2, 5, 40, 90]) for s in weights}
    rows = [(n * 1000 + i, "x" * 10, s) for n, s in enumerate(weights) for i in range(blocks[s] * 2)] + [(99_000, "", "s0"), (99_001, None, "none"), (None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixture(docs, weights, block_chars=20, leave=True).collect()
    slots = {x.slot: x.source for x in got if x.selected}
    want = plain_schedule(weights, blocks)
    assert [slots[k] for k in range(len(want))] == want and len(slots) == len(want)
    assert sum(x.selected for x in got) == len(rows) - 2 and all(x.slot is None for x in got if not x.selected)
    first = [x for x in mixture(docs, weights, block_chars=20).collect() if x.selected]
    done = min(k + 1 for k in range(len(want)) if want[: k + 1].count(want[k]) == blocks[want[k]])
    assert {x.slot for x in first} == set(range(done))


def test_packing_follows_the_mixture(spark):
    r = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 3, 40, 300, 5000]))), r.choice("aab")) for i in range(400)] + [(1000 + i, "", "c") for i in range(300)] + [(5000, None, None), (5001, "x", None), (5001, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    slots = {x.doc_id: x.slot for x in with_slots(docs, "slot", block_chars=2000).collect()}
    assert set(slots) == {i for i, _, _ in rows} and min(slots.values()) == 0
    got = pack(with_slots(docs, "slot", block_chars=2000), shard=60, slot_col="slot").collect()
    tokens, bins, runs = {}, {}, {}
    for x in got:
        tokens[x.doc_id] = tokens.get(x.doc_id, 0) + x.n_tokens
        bins.setdefault(x.bin_id, [x.bin_capacity, x.bin_tokens, 0])[2] += x.n_tokens
        runs.setdefault(int(x.bin_id.split("-")[0]), []).append(x.mix_slot)
        assert x.mix_slot == slots[x.doc_id]
    want = {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0) + len((t or "").split()) + 1
    assert tokens == want and all(held == total <= size for size, total, held in bins.values())
    ordered = [runs[k] for k in sorted(runs)]
    assert len(ordered) > 3 and all(max(a) < min(b) for a, b in zip(ordered, ordered[1:]))
    assert pack(with_slots(docs.limit(0), "slot"), slot_col="slot").count() == 0


def test_pieces_of_texts_without_words():
    from corpus_guard.llm.deobfuscate import pieces

    for text in ("12 34 5 " * 5000, "a b c d " * 5000, "7" * 30_000, "x\n" * 9000, "one two three " * 3000, "", "short"):
        parts = list(pieces(text, 1000))
        assert "".join(parts) == text and max(map(len, parts)) <= 2000
