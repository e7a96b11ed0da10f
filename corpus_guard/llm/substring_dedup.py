"""Substring dedup by compacting the de Bruijn graph of repeated token windows.

Nodes of the graph are runs of k-1 words, edges the windows of k words that join two.

1. One pass over the texts deals each document's nodes into runs of consecutive nodes
   with the same smallest ``seed``-word stretch (minimiser). That choice depends
   on a node's words only, so all occurrences of a node, and so all edges that enter or leave it, meet
   under one minimiser. A row is a run with its source coordinates and a 128-bit
   BLAKE2 digest of its words and of the word before and after it, taken from the words
   at these coordinates. Minimisers that occur once are dropped.
2. Equal runs are counted. Where a minimiser has one kind of run only, all its nodes have one edge
   in and one out: the run is a nonbranching path already. Other kinds are opened, one
   copy of each, into their edges, whose words are digested at the copy's coordinates;
   edges are counted over the kinds, and those that occur once are dropped.
3. Each repeated edge or run knows the edge that follows it. Where it has one
   successor, which has one predecessor, the node between does not branch; such links are
   compacted into paths by pointer doubling, a join a round.
4. Runs that repeat and edges that repeat take their path and place in it and are laid
   back on the source coordinates of all documents, where they merge into spans,
   which the last pass over the texts removes.

Equality is decided on 128-bit digests of the words at the source coordinates, not on rolling
hashes. Counts use map-side combine; minimisers and runs that make up a
thousandth of all rows, at most a thousand of them, are joined by broadcast, so none is a hot
task; the texts themselves move only when the table of spans is too large to broadcast (its bytes are measured).

Defined results: null and empty texts have no words and keep the empty text;
texts under k words have no window; each row is its own document even when ids
repeat or are null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import Words, is_space, signed, slices, windows
from .staging import drop_stage, small, stage

WINDOW, SEED = 35, 8
#: Share of all rows from which on a key is joined by broadcast; 1 / HOT bounds the number of such keys.
HOT = 0.001
#: Bytes of lists of spans that are broadcast; beyond it the texts are joined by a shuffle.
SPAN_BYTES = 64 << 20


def _leftmost_min(a: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of each run of ``width`` values, by doubling."""
    low, at = a, np.arange(len(a))

    def merge(step: int, n: int):
        right = low[step : step + n] < low[:n]
        return np.where(right, low[step : step + n], low[:n]), np.where(right, at[step : step + n], at[:n])

    have = 1
    while have * 2 <= width:
        low, at = merge(have, len(low) - have)
        have *= 2
    if width > have:
        low, at = merge(width - have, len(low) - (width - have))
    return at


def _digests(w: Words, first: np.ndarray, stop: np.ndarray, mark=None) -> np.ndarray:
    """(rows, 2) words of the digests of the word sequences [first, stop), joined by one blank; ``mark`` sets some apart."""
    black = ~is_space(w.data)
    keep = black.copy()
    keep[1:] |= black[:-1]
    flat = np.where(black, w.data, 0x20)[keep].astype(np.uint8)
    at = np.concatenate([[0], np.cumsum(keep)])
    raw = memoryview(flat.tobytes())
    a, b = at[w.starts[first]].tolist(), at[w.ends[stop - 1]].tolist()
    blake = hashlib.blake2b
    if mark is None:
        out = [blake(raw[i:j], digest_size=16).digest() for i, j in zip(a, b)]
    else:
        out = [blake(raw[i:j], digest_size=16, person=b"inner" if m else b"").digest() for i, j, m in zip(a, b, mark.tolist())]
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _runs(w: Words, k: int, seed: int):
    """(minimiser, digest, digest, document, first node, edges that leave) arrays of all runs of a slice."""
    words = len(w.hash)
    if words < k:
        return None
    seeds = windows(w.hash, seed)
    place = _leftmost_min(seeds, k - seed)
    inside = np.zeros(len(place) + 1, np.int32)
    last = w.first[1:] - k + 2
    long = w.first[1:] - w.first[:-1] >= k
    np.add.at(inside, w.first[:-1][long], 1)
    np.add.at(inside, last[long], -1)
    valid = np.cumsum(inside[:-1]) > 0
    starts = np.zeros(len(place), bool)
    starts[w.first[:-1][long]] = True
    new = valid & (np.append(True, (place[1:] != place[:-1]) | ~valid[:-1]) | starts)
    stops = valid & np.append(new[1:] | ~valid[1:], True)
    first, end = np.flatnonzero(new), np.flatnonzero(stops) + 1
    if not len(first):
        return None
    doc = np.searchsorted(w.first, first, "right") - 1
    left = first > w.first[doc]
    stop = np.minimum(end + k - 1, w.first[doc + 1])
    edges = np.minimum(end, w.first[doc + 1] - k + 1) - first
    h = _digests(w, first - left, stop, left)
    return seeds[place[first]], h[:, 0], h[:, 1], doc, first - w.first[doc], edges


def _find_runs(k: int, seed: int):
    def find(batches):
        for batch in batches:
            u1, u2 = batch.column("u1").to_numpy(), batch.column("u2").to_numpy()
            for row, w in slices(batch.column("text")):
                if found := _runs(w, k, seed):
                    mini, h1, h2, doc, first, edges = found
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(mini)), pa.array(h1.copy()), pa.array(h2.copy()), pa.array(u1[row + doc]), pa.array(u2[row + doc]), pa.array(first.astype(np.int32)), pa.array(edges.astype(np.int32))],
                        ["mini", "h1", "h2", "u1", "u2", "start", "n"],
                    )

    return find


def _open_runs(k: int):
    """Listed runs of each document as edges, or as one path where they are pure: digest of the first edge, next edge, place, edges, count."""

    def find(batches):
        for batch in batches:
            uid, lists = [batch.column(c).to_numpy() for c in ("u1", "u2")], batch.column("runs")
            for row, w in slices(batch.column("text")):
                parts = []
                for i in range(len(w.offsets) - 1):
                    runs = lists[row + i].values
                    start, n, c, pure = (runs.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n", "c", "pure"))
                    each = np.where(pure, 1, n)
                    at = np.repeat(start - np.cumsum(each) + each, each) + np.arange(each.sum())
                    edges = np.repeat(np.where(pure, n, 1), each)
                    parts.append((at + w.first[i], np.full(len(at), row + i), at, edges, np.repeat(c, each), np.full(len(at), w.first[i + 1])))
                g, doc, at, edges, c, end = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
                follows = g + edges
                more = follows + k <= end
                e = _digests(w, g, g + k)
                x = np.zeros(len(g), np.int64)
                inside = np.append((g[1:] == follows[:-1]) & (doc[1:] == doc[:-1]), False)[: len(g)]
                x[inside] = e[np.flatnonzero(inside) + 1, 0]
                rest = np.flatnonzero(more & ~inside)
                x[rest] = _digests(w, follows[rest], follows[rest] + k)[:, 0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy()), pa.array(x, mask=~more), pa.array(uid[0][doc]), pa.array(uid[1][doc]),
                        pa.array(at.astype(np.int32)), pa.array(edges.astype(np.int32)), pa.array(c),
                    ],
                    ["e1", "e2", "x", "u1", "u2", "start", "n", "c"],
                )

    return find


def _merge(k: int):
    """Rows (u1, u2, start, n) in order to one row of merged word spans per document."""

    def merged(uid, also, start, stop):
        group = np.cumsum(np.concatenate([[0], (uid[1:] != uid[:-1]) | (also[1:] != also[:-1])])) << 40
        reach = np.maximum.accumulate(group + stop)
        new = np.flatnonzero(np.concatenate([[True], group[1:] + start[1:] > reach[:-1]]))
        last = np.append(new[1:], len(uid)) - 1
        owner, first = group[new], start[new].astype(np.int32)
        end = (reach[last] - group[last]).astype(np.int32)
        cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sizes = np.append(cut, len(owner)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(uid[new[cut]]), pa.array(also[new[cut]]), pa.ListArray.from_arrays(sizes, pa.array(first)), pa.ListArray.from_arrays(sizes, pa.array(end))],
            ["u1", "u2", "starts", "stops"],
        )

    def work(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            start = batch.column("start").to_numpy().astype(np.int64)
            now = (batch.column("u1").to_numpy(), batch.column("u2").to_numpy(), start, start + batch.column("n").to_numpy() + k - 1)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            others = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            at = int(others[-1]) + 1 if len(others) else 0
            if at:
                yield merged(*(x[:at] for x in now))
            held = tuple(x[at:] for x in now)
        if held is not None:
            yield merged(*held)

    return work


def _cut(names: list[str]):
    def cut(batches):
        for batch in batches:
            n_words, n_removed, shas, kept_text = [], [], [], []
            for text, starts, stops in zip(batch.column("text"), batch.column("starts"), batch.column("stops")):
                words = (text.as_py() or "").encode().split()
                n_words.append(len(words))
                if starts.is_valid:
                    kept, done = [], 0
                    for a, b in zip(starts.as_py(), stops.as_py()):
                        kept += words[done:a]
                        done = b
                    words = kept + words[done:]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                shas.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept_text, pa.string())],
                [*names, "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return cut


def _join(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` with the columns of ``table`` (staged; one row per key, c the key's rows): frequent keys by broadcast, the others by a shuffle."""
    often = F.col("c") > max(1000, int(total * HOT))
    hot = F.broadcast(table.where(often))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(~often), keys)
    return rows.join(hot, keys).unionByName(rest)


def compact(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """Nonbranching links (u, v, n: edges of u) of longs to (v, head, offset) for each v, by pointer doubling.

    Each u and each v occurs once. Closed cycles have no head: their members stay single, at offset 0.
    """
    now = stage(links.select(F.col("v").alias("id"), F.col("u").alias("head"), F.col("n").cast("long").alias("offset"), F.lit(True).alias("open")), "pointers")
    if rounds is None:
        rounds = 1 + math.ceil(math.log2(now.count() + 2))
    for _ in range(rounds):
        to = now.select(F.col("id").alias("head"), F.col("head").alias("further"), F.col("offset").alias("more"), F.lit(True).alias("met"))
        moved = now.where("open").join(to, "head", "left").select(
            "id", F.coalesce("further", "head").alias("head"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("met").isNotNull().alias("open")
        )
        new = stage(now.where("not open").unionByName(moved), "pointers")
        drop_stage(now)
        now = new
        if now.where("open").isEmpty():
            break
    return now.select(F.col("id").alias("v"), F.when(F.col("open"), F.col("id")).otherwise(F.col("head")).alias("head"), F.when(F.col("open"), 0).otherwise(F.col("offset")).alias("offset"))


def repeated_paths(opened: DataFrame) -> DataFrame:
    """Staged (e1, e2, path, offset): the repeated edges and runs among opened rows, each with its nonbranching path and its place in it."""
    units = stage(opened.groupBy("e1", "e2").agg(F.sum("c").alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("n").alias("n")).where("m > 1"), "repeated-edges")
    entering = opened.where("x is not null").join(units.select("e1", "e2"), ["e1", "e2"]).groupBy("x").agg(F.min("e1").alias("lo"), F.max("e1").alias("hi"))
    entering = entering.where("lo = hi").select(F.col("lo").alias("u"), F.col("x").alias("v"))
    leaving = units.where("lo = hi").select(F.col("e1").alias("u"), F.col("lo").alias("v"), "n")
    links = leaving.join(entering, ["u", "v"]).join(units.select(F.col("e1").alias("v")).distinct(), "v", "left_semi").dropDuplicates(["u"]).dropDuplicates(["v"])
    paths = compact(links).select(F.col("v").alias("e1"), F.col("head").alias("path"), "offset")
    return stage(units.select("e1", "e2").join(paths, "e1", "left").select("e1", "e2", F.coalesce("path", "e1").alias("path"), F.coalesce("offset", F.lit(0)).alias("offset")), "paths-of-edges")


def repeated_spans(docs: DataFrame, k: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(u1, u2, text) to staged (u1, u2, start, n, path, offset): runs of n repeated windows from word ``start`` on, with their path in the graph."""
    seed = min(seed, k - 1)
    every = stage(docs.select("u1", "u2", "text").mapInArrow(_find_runs(k, seed), "mini long, h1 long, h2 long, u1 long, u2 int, start int, n int"), "runs")
    total = every.count()
    again = stage(every.groupBy("mini").agg(F.count("*").alias("c")).where("c > 1"), "minimisers")
    runs = stage(_join(every, again, ["mini"], total).drop("c"), "shared-runs")
    drop_stage(every)
    kinds = stage(runs.groupBy("mini", "h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct("u1", "u2", "start", "n")).alias("one")), "kinds")
    per_mini = stage(kinds.groupBy("mini").agg(F.count("*").alias("c")), "kinds-of-minimisers")
    marked = _join(kinds.withColumnRenamed("c", "copies"), per_mini, ["mini"], total)
    todo = marked.where("one.n > 0").select("one.u1", "one.u2", F.struct("one.start", "one.n", F.col("copies").alias("c"), (F.col("c") == 1).alias("pure")).alias("run"))
    todo = stage(todo.groupBy("u1", "u2").agg(F.collect_list("run").alias("runs")), "to-open")
    once = docs.select("u1", "u2", "text").join(small(todo, SPAN_BYTES, 24 * F.size("runs") + 32), ["u1", "u2"])
    opened = stage(once.mapInArrow(_open_runs(k), "e1 long, e2 long, x long, u1 long, u2 int, start int, n int, c long"), "opened")
    paths = repeated_paths(opened)
    placed = stage(opened.join(paths, ["e1", "e2"]).select("u1", "u2", "start", "n", "path", "offset").dropDuplicates(["u1", "u2", "start"]), "placed")
    whole = kinds.where("c > 1").select("mini", "h1", "h2", "c", "one.u1", "one.u2", "one.start").join(placed.drop("n"), ["u1", "u2", "start"])
    whole = stage(whole.select("mini", "h1", "h2", "c", "path", "offset"), "repeated-runs")
    spans = _join(runs, whole, ["mini", "h1", "h2"], total).where("n > 0").select("u1", "u2", "start", "n", "path", "offset")
    out = stage(spans.unionByName(placed).distinct(), "span-parts")
    for used in (again, runs, kinds, per_mini, todo, opened, paths, placed, whole):
        drop_stage(used)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Rows are told apart by 96 bits of hashes of id and text; rows that agree in both have the
    same words, count as separate documents and share their spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.isnull(F.col(id_col)), text
    named = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(*key).alias("u1"), F.hash(*key).alias("u2"))
    parts = repeated_spans(named, k, seed)
    spans = parts.select("u1", "u2", "start", "n").repartition("u1", "u2").sortWithinPartitions("u1", "u2", "start")
    spans = stage(spans.mapInArrow(_merge(k), "u1 long, u2 int, starts array<int>, stops array<int>"), "spans")
    drop_stage(parts)
    names = ["doc_id"]
    schema = T.StructType([named.schema["doc_id"]]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string").add("kept_text", "string")
    held = named.join(small(spans, SPAN_BYTES, 8 * F.size("starts") + 32), ["u1", "u2"], "left")
    return held.select("doc_id", "text", "starts", "stops").mapInArrow(_cut(names), schema)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (
  SELECT doc_id, i AS start, md5(array_to_string(words[i:i+34], ' ')) AS h
  FROM w, unnest(range(1, len(words) - 33)) AS t(i)),
rep AS (SELECT doc_id, start FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, start + j AS pos FROM rep, unnest(range(35)) AS t(j)),
x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
k AS (
  SELECT x.doc_id, count(*) FILTER (gone.pos IS NOT NULL) AS n_removed,
         string_agg(x.word, ' ' ORDER BY x.pos) FILTER (gone.pos IS NULL) AS kept
  FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.pos = x.pos GROUP BY x.doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
