"""Benchmark decontamination by a generalised suffix automaton of the test items.

1. Items are normalised to words and cut into pieces of at most ``PIECE`` words that overlap by a window less
   one word, so every window lies in one piece whole. Pieces are dealt into blocks of bounded words; one task builds the
   automaton of one block, with the items of each window at the state of its words.
2. Automata are broadcast in passes of at most ``PASS_BYTES``, checked by their size; documents are streamed
   once a pass. A large benchmark means more passes, not a larger broadcast.
3. A task hashes its words in slices and marks those inside a run of ``q`` words that some item has too (``q`` is at
   most 4, and no more than the shortest item). Only marked words go through the automaton: no
   occurrence of a window can hold another word. The automaton is keyed by the words themselves, so hashes decide nothing.
4. At each word the automaton knows the longest matching length. A length of a window or more, or a whole
   shorter item that ends here, makes a hit; hits merge into spans.
5. ``clean`` removes spans by their length and whole documents by the share of their words that is hit.

Texts longer than a slice are read in parts, the automaton's state carried over, so memory is bounded by the
slice (or by one word, where a word is longer).

Defined results: null and empty texts have no words, no hits and are kept; items without words match nothing; of items
that share an id, each hits for that id; null item ids are left out of the list of items but their words are hit;
an empty benchmark hits nothing; rows with equal ids are separate documents; other columns of the benchmark are not read, those
of the documents stay and win over a result column of the same name only in ``clean``.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import Words, windows
from .staging import drop_stage, fresh, small, stage

WINDOW = 10
#: Words of a piece of an item, and of a block of pieces.
PIECE, BLOCK = 20_000, 200_000
PASS_BYTES = 64 << 20
#: Bytes of text that are hashed at once.
SLICE = 1 << 19
Q = 4
#: A span of more than so many words is removed; a document of which more than this share is hit goes whole.
MAX_LENGTH, MAX_COVERAGE = 9, 0.5
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased; maximal runs of ASCII letters, digits and characters beyond ASCII."""
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


class Automaton:
    """The generalised suffix automaton of pieces of items: (item id, words, whole) each."""

    def __init__(self, pieces: list[tuple[str | None, list[bytes], bool]], window: int):
        self.window = window
        self.word: dict[bytes, int] = {}
        for _, words, _ in pieces:
            for w in words:
                self.word.setdefault(w, len(self.word))
        self.width = len(self.word) + 1
        step, link, length = [{}], [-1], [0]
        for _, words, _ in pieces:
            last = 0
            for w in words:
                last = self._extend(step, link, length, last, self.word[w])
        self.link, self.length = np.array(link, np.int32), np.array(length, np.int32)
        rows = sorted((s * self.width + c, t) for s, out in enumerate(step) for c, t in out.items())
        self.keys, self.to = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int32)
        self.names = sorted({i for i, _, _ in pieces if i is not None})
        number = {i: k for k, i in enumerate(self.names)}
        holds: dict[int, set] = {}
        self.ends: dict[int, list] = {}
        self.open()
        for item, words, whole in pieces:
            ids = [self.word[w] for w in words]
            k = number.get(item)
            if len(words) < window:
                state, _ = self._run(ids)
                if whole and words:
                    marks = self.ends.setdefault(state, [])
                    for m, items in marks:
                        if m == len(words):
                            items.update([] if k is None else [k])
                            break
                    else:
                        marks.append((len(words), set() if k is None else {k}))
                continue
            state, size = 0, 0
            for c in ids:
                state, size = self.step(state, size, c)
                if size >= window:
                    holds.setdefault(self.state_of_window(state), set()).update([] if k is None else [k])
        self.holds = {s: sorted(v) for s, v in holds.items()}
        self.short = sorted({m for marks in self.ends.values() for m, _ in marks})
        self._mark_chains()
        self.q = min([Q, window, *self.short])
        grams = [windows(h, self.q) for _, words, _ in pieces if len(h := _hashes(words)) >= self.q]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)

    @staticmethod
    def _extend(step, link, length, last: int, c: int) -> int:
        """Add c behind the state ``last``; returns the state of the longer word."""

        def copy_for(p: int, q: int) -> int:
            clone = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            link[q] = clone
            while p != -1 and step[p].get(c) == q:
                step[p][c] = clone
                p = link[p]
            return clone

        q = step[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else copy_for(last, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            link[new] = q if length[q] == length[p] + 1 else copy_for(p, q)
        return new

    def open(self) -> None:
        """Views that plain Python reads fast."""
        self._keys, self._to, self._link, self._length = memoryview(self.keys), memoryview(self.to), memoryview(self.link), memoryview(self.length)

    def _mark_chains(self) -> None:
        """The nearest state on each suffix chain, itself included, at which a short item ends."""
        self.near = np.full(len(self.link), -1, np.int32)
        for s in np.argsort(self.length, kind="stable").tolist():
            self.near[s] = s if s in self.ends else (self.near[self.link[s]] if self.link[s] >= 0 else -1)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_keys", "_to", "_link", "_length")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.open()

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """Longest suffix of what was read that items hold: its state and length."""
        keys, width = self._keys, self.width
        while True:
            key = state * width + c
            at = bisect_left(keys, key)
            if at < len(keys) and keys[at] == key:
                return self._to[at], size + 1
            if state == 0:
                return 0, 0
            state = self._link[state]
            size = self._length[state]

    def _run(self, ids: list[int]) -> tuple[int, int]:
        state, size = 0, 0
        for c in ids:
            state, size = self.step(state, size, c)
        return state, size

    def state_of_window(self, state: int) -> int:
        """The state of the last ``window`` words of a match at ``state``."""
        while self._length[self._link[state]] >= self.window:
            state = self._link[state]
        return state

    def hit(self, state: int, size: int) -> tuple[int, list[int]]:
        """Words hit that end here, and numbers of the items whose windows end here."""
        n, items = 0, []
        if size >= self.window:
            n = size
            items.extend(self.holds[self.state_of_window(state)])
        at = int(self.near[state]) if len(self.short) else -1
        while at >= 0:
            for m, found in self.ends[at]:
                if m <= size:
                    n = max(n, m)
                    items.extend(found)
            up = self._link[at]
            at = int(self.near[up]) if up >= 0 else -1
        return n, items


def _hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    return Words(data, np.array([0, len(data)], np.int64), True, _BREAK).hash


class _Part:
    """A slice of texts: words of whole documents, or one part of a long one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.w = Words(data, offsets, True, _BREAK)
        self.raw = memoryview(data)

    def marked(self, q: int, grams: np.ndarray, sieve: np.ndarray) -> np.ndarray:
        """Words inside a run of q words of one document that items have."""
        w = self.w
        n = len(w.hash)
        inside = np.zeros(n + 1, np.int32)
        h = windows(w.hash, q)
        at = np.flatnonzero(sieve[h & np.uint64(len(sieve) - 1)])
        if len(at):
            found = np.searchsorted(grams, h[at])
            at = at[(found < len(grams)) & (grams[np.minimum(found, len(grams) - 1)] == h[at])]
            document = np.searchsorted(w.first, at, "right")
            at = at[at + q <= w.first[document]]
            np.add.at(inside, at, 1)
            np.add.at(inside, at + q, -1)
        return np.cumsum(inside[:-1]) > 0

    def word(self, i: int) -> bytes:
        return bytes(self.raw[self.w.starts[i] : self.w.ends[i]]).lower()


def _sieve(grams: np.ndarray) -> np.ndarray:
    bits = max(16, int(len(grams)).bit_length() + 4)
    sieve = np.zeros(1 << bits, bool)
    sieve[grams & np.uint64((1 << bits) - 1)] = True
    return sieve


class Scanner:
    """Streams texts through one automaton."""

    def __init__(self, automaton: Automaton):
        self.a, self.sieve = automaton, _sieve(automaton.grams)

    def feed(self, part: _Part, lo: int, hi: int, base: int, state: int, size: int, spans: list, items: set) -> tuple[int, int]:
        """Words [lo, hi) of a part, whose first is word ``base`` of the document; extends spans and items; returns the state."""
        a = self.a
        marks = part.marks
        at = lo + np.flatnonzero(marks[lo:hi])
        if not len(at):
            return 0, 0
        if at[0] != lo:
            state, size = 0, 0
        before = int(at[0]) - 1
        for i in at.tolist():
            if i != before + 1:
                state, size = 0, 0
            before = i
            c = a.word.get(part.word(i))
            if c is None:
                state, size = 0, 0
                continue
            state, size = a.step(state, size, c)
            if size >= a.q:
                n, found = a.hit(state, size)
                if n:
                    stop = base + i - lo + 1
                    start = stop - n
                    while spans and start <= spans[-1][1]:
                        start = min(start, spans.pop()[0])
                    spans.append((start, stop))
                    items.update(found)
        if before + 1 < hi:
            return 0, 0
        return state, size

    def mark(self, part: _Part) -> None:
        part.marks = part.marked(self.a.q, self.a.grams, self.sieve)


def _long_parts(data: np.ndarray, q: int) -> Iterator[tuple[_Part, int, int]]:
    """A long text as parts: (part, first and last word to take); marks of the words taken are exact."""
    n, a, skip = len(data), 0, 0
    while True:
        b, words = a, 0
        while b < n:
            b = min(n, b + SLICE)
            while b < n and not _BREAK[data[b]]:
                gaps = np.flatnonzero(_BREAK[data[b : b + SLICE]])
                b = b + int(gaps[0]) if len(gaps) else min(n, b + SLICE)
            black = ~_BREAK[data[a:b]]
            words = int(black[0]) + int(np.count_nonzero(black[1:] & ~black[:-1]))
            if words == 0 or words >= 4 * q:
                break
        part = _Part(data[a:b], np.array([0, b - a], np.int64))
        if b == n:
            yield part, skip, words
            return
        if not words:
            a = b
            continue
        take = words - (q - 1)
        yield part, skip, take
        # the next part begins with those words before the first one not taken yet that its marks need
        again = take - (q - 1)
        a, skip = (a + int(part.w.starts[again]) if again < words else b), q - 1


def scan(column: pa.Array, scanners: list[Scanner]) -> Iterator[tuple[int, int, list, list]]:
    """(row, words, merged spans, item ids) of each text of an Arrow string column."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, buffer = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.empty(0, np.uint8)
    row = 0
    while row < n:
        if offsets[row + 1] - offsets[row] > SLICE:
            yield (row, *_scan_long(raw[offsets[row] : offsets[row + 1]], scanners))
            row += 1
            continue
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        end = min(end, n)
        part = _Part(raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        first = part.w.first.tolist()
        found = [([], set()) for _ in range(end - row)]
        for s in scanners:
            s.mark(part)
            held = np.searchsorted(part.w.first, np.flatnonzero(part.marks), "right") - 1
            for d in np.unique(held).tolist():
                spans: list = []
                s.feed(part, first[d], first[d + 1], 0, 0, 0, spans, items := set())
                found[d][0].extend(spans)
                found[d][1].update(s.a.names[i] for i in items)
        for d, (spans, items) in enumerate(found):
            yield row + d, first[d + 1] - first[d], merged(spans), sorted(items)
        row = end


def _scan_long(data: np.ndarray, scanners: list[Scanner]):
    spans, items, n = [], set(), 0
    for s in scanners:
        state, size, base, own, numbers = 0, 0, 0, [], set()
        for part, lo, hi in _long_parts(data, s.a.q):
            s.mark(part)
            state, size = s.feed(part, lo, hi, base, state, size, own, numbers)
            base += hi - lo
        n = base
        spans.extend(own)
        items.update(s.a.names[i] for i in numbers)
    if not scanners:
        n = sum(hi - lo for _, lo, hi in _long_parts(data, 1))
    return n, merged(spans), sorted(items)


def merged(spans: list) -> list:
    """Spans united where they touch or overlap."""
    out: list = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _cut_items(window: int):
    """Items to pieces of bounded words, dealt by their hash to blocks in the next step."""

    def cut(batches):
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                pieces = [words[i : i + PIECE] for i in range(0, max(1, len(words) - window + 1), PIECE - window + 1)] if len(words) > PIECE else [words]
                rows = [(item, p, len(words) == len(p), len(p)) for p in pieces if p]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.list_(pa.binary()), pa.bool_(), pa.int64()))], ["item", "words", "entire", "n"])

    return cut


def _build(window: int):
    """Pieces sorted by block to one pickled automaton a block."""

    def build(batches):
        block, held = None, []
        for batch in batches:
            for b, item, words, entire in zip(*(batch.column(c).to_pylist() for c in ("block", "item", "words", "entire"))):
                if held and b != block:
                    yield _packed(held, window)
                    held = []
                block = b
                held.append((item, words, entire))
        if held:
            yield _packed(held, window)

    return build


def _packed(pieces, window):
    return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Automaton(pieces, window))], pa.binary())], ["automaton"])


def automata(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Staged (automaton binary, bytes): one row per block of at most about ``block`` words."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    cut = items.mapInArrow(_cut_items(window), "item string, words array<binary>, entire boolean, n long")
    pieces = stage(cut.dropDuplicates(), "item-pieces")
    blocks = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))
    built = dealt.repartition(min(blocks, 200), "block").sortWithinPartitions("block").mapInArrow(_build(window), "automaton binary")
    out = stage(built, "automata")
    drop_stage(pieces)
    return out


def _passes(built: DataFrame, limit: int) -> Iterator[list[bytes]]:
    """Automata in groups of at most ``limit`` bytes (one may be larger), each fetched when its turn comes."""
    group, size = [], 0
    for r in built.toLocalIterator():
        if group and size + len(r.automaton) > limit:
            yield group
            group, size = [], 0
        group.append(bytes(r.automaton))
        size += len(r.automaton)
    if group:
        yield group


def _scanned(docs: DataFrame, text_col: str, group: list[bytes], names: list[str], only_hits: bool):
    """``docs`` with n_words, starts, stops and items of one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(group)
    schema = T.StructType([f for f in docs.schema.fields if f.name != text_col or not only_hits])
    kinds = (T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()))
    for name, kind in zip(names, kinds):
        schema = schema.add(T.StructField(name, kind))
    kept = [f.name for f in schema.fields[:-4]]
    arrow = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))

    def work(batches):
        scanners = None
        for batch in batches:
            if scanners is None:
                scanners = [Scanner(pickle.loads(a)) for a in shared.value]
            rows = [(r, n, [s for s, _ in spans], [e for _, e in spans], items) for r, n, spans, items in scan(batch.column(text_col), scanners) if spans or not only_hits]
            if rows:
                at, *found = zip(*rows)
                base = batch if not only_hits else batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(base.column(c) for c in kept), *(pa.array(x, t) for x, t in zip(found, arrow))], [*kept, *names])

    return docs.mapInArrow(work, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block: int = BLOCK, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``docs`` with n_words, starts and stops (word spans that are hit, merged) and items (ids of the items hit, sorted)."""
    columns = docs.columns
    names = [fresh(c, columns) for c in ("n_words", "starts", "stops", "items")]
    docs = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    text_col = f"c{columns.index(text_col)}"
    built = automata(benchmark, item_col, "text", window, block)
    groups = _passes(built, pass_bytes)
    out = _scanned(docs, text_col, next(groups, []), ["n", "starts", "stops", "items"], False)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(text.cast("binary"), 256)
    more = [stage(_scanned(docs.select(digest.alias("digest"), text_col), text_col, g, ["n", "s", "e", "i"], True).dropDuplicates(["digest"]), "hits") for g in groups]
    if more:
        hits = more[0]
        for x in more[1:]:
            hits = hits.unionByName(x)
        hits = stage(hits.groupBy("digest").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in "sei")), "all-hits")
        out = _united(out.withColumn("digest", digest).join(small(hits), "digest", "left"))
    return out.select(*docs.columns, "n", "starts", "stops", "items").toDF(*columns, *names)


def _united(rows: DataFrame) -> DataFrame:
    """Spans (starts, stops; s, e) and items (items; i) of several passes as one list of merged spans and one of items."""
    zipped = lambda a, b: F.coalesce(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))), F.array().cast("array<struct<a:int,b:int>>"))
    spans = F.array_sort(F.concat(zipped("starts", "stops"), zipped("s", "e")))

    def add(found, x):
        last = F.try_element_at(found, F.lit(-1))
        longer = F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b")))
        return F.when((F.size(found) > 0) & (last["b"] >= x["a"]), F.concat(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), longer)).otherwise(F.concat(found, F.array(x)))

    apart = F.aggregate(spans, F.array().cast("array<struct<a:int,b:int>>"), add)
    items = F.array_sort(F.array_union("items", F.coalesce("i", F.array().cast("array<string>"))))
    return rows.withColumn("spans", apart).withColumns({"starts": F.col("spans.a"), "stops": F.col("spans.b"), "items": items})


def _strip(text_col: str, limit: int):
    """Texts without the spans of more than ``limit`` words, from the first byte of a span to the last."""

    def strip(batches):
        for batch in batches:
            texts = []
            for text, starts, stops in zip(batch.column(text_col), batch.column("starts"), batch.column("stops")):
                spans = [(a, b) for a, b in zip(starts.as_py(), stops.as_py()) if b - a > limit]
                if not spans:
                    texts.append(text.as_py())
                    continue
                raw = text.as_py().encode()
                wanted = {x for a, b in spans for x in (a, b - 1)}
                at = {i: m.span() for i, m in enumerate(_WORD.finditer(raw.lower())) if i in wanted}
                kept, done = [], 0
                for a, b in spans:
                    kept.append(raw[done : at[a][0]])
                    done = at[b - 1][1]
                texts.append(b"".join([*kept, raw[done:]]).decode())
            names = [c for c in batch.schema.names if c not in ("starts", "stops")]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names], names)

    return strip


def _hit():
    """Words in the spans."""
    return F.aggregate(F.zip_with("stops", "starts", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_length: int = MAX_LENGTH, max_coverage: float = MAX_COVERAGE, **options) -> DataFrame:
    """``docs`` without spans of more than ``max_length`` hit words; documents hit on more than ``max_coverage`` of their words go."""
    columns = docs.columns
    safe = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    text = f"c{columns.index(text_col)}"
    found = contamination(safe, benchmark, text, **options)
    found = found.where(_hit() <= max_coverage * F.col("n_words")).select(*safe.columns, "starts", "stops")
    return found.mapInArrow(_strip(text, max_length), safe.schema).toDF(*columns)


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = found.select("doc_id", "n_words", _hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS k, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS t(i) WHERE len(words) > 0),
dw AS (
  SELECT doc_id, i, k, array_to_string(words[i:i + k - 1], ' ') AS g
  FROM w, (SELECT DISTINCT k FROM bw) s, unnest(range(1, len(words) - k + 2)) AS t(i)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, unnest(range(k)) AS t(j) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
