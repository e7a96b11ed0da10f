"""N-gram Jaccard self-join by rare-first prefix filtering.

1. One pass over the texts gives each document its set of 5-word shingles as
   64-bit hashes, and counts shingles that repeat inside a buffer of documents.
   The frequent ones (at most FREQUENT of them, by the bound sum/FREQUENT on
   their count) define the global order: infrequent shingles by hash, then
   frequent ones by count. Any total order is exact; a good one keeps buckets small.
2. Equal sets collapse to one node; the rest of the work is on nodes.
3. Each node emits its prefix in that order. Two sets at Jaccard >= t share a
   prefix shingle. Each bucket (equal prefix shingle) first compares its most
   central node with all its others (length, positional and suffix filters apply),
   pairs are verified once on the full sets, and linked nodes form components.
4. Buckets whose nodes still lie in different components are searched for their
   remaining cross-component pairs: in blocks of bounded size the common prefix
   shingles of all pairs are counted, the length and positional filters apply, and
   what is left is verified in the same way. Pairs inside one component cannot
   change it, so no link between different texts is lost, while a group of
   thousands of near copies never expands into all its pairs.

A shingle counts as frequent by its repeats inside the buffers of the first pass, so one that is met once in
each buffer of BUFFER shingles is not; its bucket then holds at most one row a buffer. Buckets of
frequent shingles, few rows, use a grouped minimum and a join that adaptive execution splits.

Defined results: null and empty texts, and texts without words, have an empty set
and link with nothing; fewer than five words form one shingle; rows that repeat
an id are separate documents of that id; a null id takes part and is only named
as component_id when the component has no other id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .hashing import mix, signed, slices, whole, windows
from .staging import bound_batches, drop_stage, fresh, small, stage

SHINGLE, NUM, DEN = 5, 75, 100
#: Most entries of the frequent-shingle table, which is all that reaches the driver and is broadcast.
FREQUENT = 1 << 18
#: Shingles counted together in one task's memory.
BUFFER = 1 << 21
#: Least bits of a parity bitmap; longer sets get about twice as many bits as shingles.
BITS = 1024
#: Most nodes of a block in the last search, and shingles of one matrix product there.
BLOCK, CHUNK = 512, 2048
#: Rounds in which each bucket compares its most central node with its others before pairs are listed.
STARS = 1


def shingle_sets(column: pa.Array, k: int = SHINGLE):
    """(row, sorted distinct shingle hashes) of each text of an Arrow column."""
    for first, w in slices(column, lower=True):
        grams = windows(w.hash, k)
        for i in range(len(w.offsets) - 1):
            a, b = w.first[i], w.first[i + 1]
            if b - a >= k:
                yield first + i, np.unique(grams[a : b - k + 1])
            elif b > a:
                yield first + i, np.array([whole(w.hash[a:b])], np.uint64)
            else:
                yield first + i, np.empty(0, np.uint64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    a = mix(s + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))
    b = np.bitwise_xor.reduce(mix(s ^ np.uint64(0x14057B7EF767814F)))
    return int(a.view(np.int64)), int(b.view(np.int64))


def _parity(s: np.ndarray) -> np.ndarray:
    """Bitmap of the parities of the shingles by their hash; halves of it folded by exclusive or are the bitmap of half the size."""
    size = max(BITS, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else BITS
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    # hash value v is bit v % 64 of word v / 64, so that words i and i + w hold values that are equal modulo 64 * w
    words = odd.reshape(size // 64, 64).astype(np.uint64)
    return signed((words << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64))


def _repeated(k: int):
    def count(batches):
        held: list[np.ndarray] = []
        seen: set = set()
        size = 0

        def flush():
            if held:
                h = np.concatenate(held)
                held.clear()
                h.sort()
                same = np.concatenate([[False], h[1:] == h[:-1], [False]])
                first, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
                yield pa.RecordBatch.from_arrays([pa.array(signed(h[first])), pa.array(last - first + 1)], ["token", "n"])

        for batch in batches:
            for _, s in shingle_sets(batch.column(0), k):
                if (d := _digest(s)) in seen:
                    continue
                seen.add(d)
                held.append(s)
                size += len(s)
                if size >= BUFFER:
                    yield from flush()
                    size = 0
                    seen.clear()
        yield from flush()

    return count


def frequent_shingles(docs: DataFrame, text_col: str, k: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the frequent shingles; never over ``most`` of them."""
    counts = stage(
        docs.select(F.col(text_col).alias("text")).mapInArrow(_repeated(k), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")),
        "shingles",
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") > max(2, total / most)).toArrow()
    token = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], rows.column("n").to_numpy()[order]


def _signatures(k: int, num: int, den: int, frequent, names: list[str]):
    def sign(batches):
        tokens, counts = frequent.value
        for batch in batches:
            out: list[tuple] = []
            for row, s in shingle_sets(batch.column("text"), k):
                n = len(s)
                need = -(-num * n // den)
                p = n - need + 1 if n else 0
                at = np.searchsorted(tokens, s)
                at[at == len(tokens)] = 0
                hot = tokens[at] == s if len(tokens) else np.zeros(n, bool)
                light = s[~hot]
                prefix = light[:p]
                n_light = len(prefix)
                if n_light < p:
                    heavy = np.flatnonzero(hot)
                    heavy = heavy[np.lexsort((s[heavy], counts[at[heavy]]))][: p - n_light]
                    prefix = np.concatenate([prefix, s[heavy]])
                out.append((n, *_digest(s), signed(prefix), n_light, _parity(s)))
            n, d1, d2, prefix, n_light, bits = zip(*out) if out else ([],) * 6
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in prefix])]).astype(np.int32)
            flat = np.concatenate(prefix) if out else np.empty(0, np.int64)
            bit_sizes = np.concatenate([[0], np.cumsum([len(x) for x in bits])]).astype(np.int32)
            bitmap = pa.ListArray.from_arrays(bit_sizes, pa.array(np.concatenate(bits) if out else np.empty(0, np.int64)))
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(sizes, pa.array(flat)), pa.array(n_light, pa.int32()), bitmap],
                [*names, "n", "d1", "d2", "prefix", "n_light", "bits"],
            )

    return sign


def text_key(text_col: str):
    """128 bits that name a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, most: int) -> DataFrame:
    """Staged: uid, doc_id, text_key, n, set digest, prefix in the global order, number of infrequent prefix shingles, parity bitmap."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, text_col, k, most))
    named = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text")
    )
    names = ["uid", "doc_id", "text_key"]
    schema = T.StructType([named.schema[c] for c in names]).add("n", "long").add("d1", "long").add("d2", "long")
    schema = schema.add("prefix", T.ArrayType(T.LongType())).add("n_light", "integer").add("bits", T.ArrayType(T.LongType()))
    return stage(named.mapInArrow(_signatures(k, num, den, frequent, names), schema), "signatures")


def _need(num: int, den: int):
    """Least intersection of two sets of x.n and y.n for the threshold."""
    return F.ceil(F.lit(num) * (F.col("xn") + F.col("yn")) / F.lit(num + den))


def _plausible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Length and positional filters on (xn, xpos, yn, ypos), before the full sets are fetched."""
    return pairs.where(
        (F.least("xn", "yn") * den >= F.greatest("xn", "yn") * num)
        & (F.least("xpos", "ypos") + 1 + F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos")) - 1 >= _need(num, den))
    )


def _verify(k: int, num: int, den: int):
    def check(batches):
        for batch in batches:
            ok = []
            right = shingle_sets(batch.column("ytext"), k)
            for (_, a), (_, b) in zip(shingle_sets(batch.column("xtext"), k), right, strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(both > 0 and den * both >= num * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return check


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """Of distinct candidate pairs (x, y) of nodes, those that reach the threshold.

    The suffix filter comes first: the Hamming distance of two parity bitmaps, the
    larger folded to the size of the smaller, is at most the size of the symmetric
    difference, which the threshold bounds.
    """
    x = nodes.select(F.col("uid").alias("x"), F.col("n").alias("xn"), F.col("bits").alias("xb"), F.col("text_key").alias("xkey"))
    y = nodes.select(F.col("uid").alias("y"), F.col("n").alias("yn"), F.col("bits").alias("yb"), F.col("text_key").alias("ykey"))
    words = F.least(F.size("xb"), F.size("yb"))
    fold = lambda c: f"transform(sequence(0, w - 1), i -> aggregate(sequence(i, size({c}) - 1, w), 0L, (a, j) -> a ^ {c}[j]))"
    apart = F.expr(f"aggregate(zip_with({fold('xb')}, {fold('yb')}, (a, b) -> bit_count(a ^ b)), 0, (a, b) -> a + b)")
    near = (apart <= F.col("xn") + F.col("yn") - 2 * _need(num, den)) & (F.least("xn", "yn") * den >= F.greatest("xn", "yn") * num)
    left = stage(pairs.distinct().join(x, "x").join(y, "y").withColumn("w", words).where(near).select("x", "y", "xkey", "ykey"), "candidates")
    keys = left.select(F.col("xkey").alias("key")).union(left.select("ykey")).distinct()
    keyed = docs.select(text_key(text_col).alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = stage(keyed.join(small(keys), "key").dropDuplicates(["key"]), "texts")
    both = left.join(texts.select(F.col("key").alias("xkey"), F.col("text").alias("xtext")), "xkey").join(
        texts.select(F.col("key").alias("ykey"), F.col("text").alias("ytext")), "ykey"
    )
    return both.select("x", "y", "xtext", "ytext").mapInArrow(_verify(k, num, den), "x long, y long")


def _pairs_of_cell(uid, n, p, root, block, sizes, tokens, bi: int, bj: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of two blocks of one group: common prefix shingles are counted by matrix products, then the length and positional filters apply."""
    x, y = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
    row = np.repeat(np.arange(len(uid)), sizes)
    _, inverse, count = np.unique(tokens, return_inverse=True, return_counts=True)
    several = count[inverse] > 1
    row, inverse = row[several], inverse[several]
    names, inverse = np.unique(inverse, return_inverse=True)
    common = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, len(names), CHUNK):
        inside = (inverse >= lo) & (inverse < lo + CHUNK)
        m = np.zeros((len(uid), min(CHUNK, len(names) - lo)), np.float32)
        m[row[inside], inverse[inside] - lo] = 1
        common += m[x] @ m[y].T
    xn, yn = n[x][:, None], n[y][None]
    tail = np.maximum(xn - p[x][:, None], yn - p[y][None])
    need = -(-num * (xn + yn) // (num + den))
    ok = (common > 0) & (common + tail >= need) & (np.minimum(xn, yn) * den >= np.maximum(xn, yn) * num)
    ok &= root[x][:, None] != root[y][None]
    ok &= uid[x][:, None] < uid[y][None] if bi == bj else uid[x][:, None] != uid[y][None]
    i, j = np.nonzero(ok)
    a, b = uid[x[i]], uid[y[j]]
    return np.minimum(a, b), np.maximum(a, b)


def _cells(num: int, den: int):
    """Cells (y, bi, bj) come sorted; each is held until the next begins, and holds at most two blocks."""
    columns = ("y", "bi", "bj", "uid", "n", "p", "root", "block")

    def work(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("tokens")
            now = [batch.column(c).to_numpy() for c in columns] + [lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy()]
            if held is not None:
                now = [np.concatenate(z) for z in zip(held, now)]
            key = np.stack(now[:3], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            ends = np.concatenate([[0], np.cumsum(now[8])])
            begin = 0
            for cut in cuts:
                yield from cell(now, ends, begin, cut)
                begin = int(cut)
            held = [c[begin:] for c in now[:9]] + [now[9][ends[begin] :]]
        if held is not None:
            ends = np.concatenate([[0], np.cumsum(held[8])])
            yield from cell(held, ends, 0, len(held[0]))

    def cell(c, ends, a, b):
        x, y = _pairs_of_cell(*(z[a:b] for z in c[3:9]), c[9][ends[a] : ends[b]], int(c[1][a]), int(c[2][a]), num, den)
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

    return work


def _cross_pairs(open_rows: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of nodes of different components that share a prefix shingle and pass the filters.

    Buckets with the same most central node make one group. A group is dealt into
    blocks, each pair of blocks is a task of bounded size, and only pairs that pass
    leave it; a pair's common prefix shingles all lie in open buckets, so the bound holds.
    """
    firsts = open_rows.groupBy("token").agg(F.max(F.struct("central", (-F.col("uid")).alias("u"))).alias("f")).select("token", (-F.col("f.u")).alias("y"))
    nodes = open_rows.groupBy("uid").agg(F.first("n").alias("n"), F.first("p").alias("p"), F.first("root").alias("root"), F.collect_list("token").alias("tokens"))
    members = stage(open_rows.join(firsts, "token").select("y", "uid", "root").distinct(), "groups")
    sizes = members.groupBy("y").agg(F.count("*").alias("c"), F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b")
    sizes = sizes.select("y", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    dealt = members.drop("root").join(sizes, "y").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("y", "uid", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    cells = dealt.join(nodes, "uid").repartition("y", "bi", "bj").sortWithinPartitions("y", "bi", "bj", "uid")
    return cells.select("y", "bi", "bj", "uid", "n", "p", "root", "block", "tokens").mapInArrow(_cells(num, den), "x long, y long").distinct()


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN, most: int = FREQUENT
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links), uid, root.

    Documents link when den * |intersection| >= num * |union| of their sets of k-word shingles.
    """
    bound_batches(docs.sparkSession)
    signed_docs = signatures(docs, id_col, text_col, k, num, den, most)
    classes = stage(signed_docs.where("n > 0").groupBy("d1", "d2").agg(F.min("uid").alias("class"), F.count("*").alias("rows")), "classes")
    copies = signed_docs.join(classes.where("rows > 1"), ["d1", "d2"]).select("uid", "class").where("uid <> class")
    copies = stage(copies, "copies")
    nodes = signed_docs.where("n > 0").join(small(copies.select("uid")), "uid", "left_anti")

    bucket = nodes.select("uid", F.col("n").cast("int").alias("n"), "n_light", F.size("prefix").alias("p"), F.posexplode("prefix").alias("pos", "token"))
    light = bucket.where("pos < n_light").drop("n_light").withColumn("c", F.count("*").over(Window.partitionBy("token"))).where("c > 1").drop("c")
    heavy = bucket.where("pos >= n_light").drop("n_light")
    several = heavy.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    shared = stage(light.unionByName(heavy.join(several, "token")).select("token", "uid", "n", "pos", "p"), "buckets")
    central = shared.groupBy("uid").agg((F.count("*") / F.first("p")).alias("central"))
    open_rows = stage(shared.join(central, "uid").withColumn("root", F.col("uid")), "open")
    drop_stage(shared)

    nodes_small = nodes.select("uid", "n", "bits", "text_key")
    links = linked = before = None
    for _ in range(STARS):
        # the most central node of each bucket, whose prefix has the fewest shingles of its own, is compared with all others
        firsts = open_rows.groupBy("token").agg(F.max(F.struct("central", (-F.col("uid")).alias("u"), "n", "pos", "root")).alias("f"))
        firsts = firsts.select("token", (-F.col("f.u")).alias("y"), F.col("f.n").alias("yn"), F.col("f.pos").alias("ypos"), F.col("f.root").alias("yroot"))
        met = stage(open_rows.join(firsts, "token"), "met")
        star = met.where("uid <> y and root <> yroot").select(F.col("uid").alias("x"), F.col("n").alias("xn"), F.col("pos").alias("xpos"), "y", "yn", "ypos")
        tried = stage(_plausible(star, num, den).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "star-pairs")
        found = stage(verified(tried, nodes_small, docs, text_col, k, num, den), "links")
        before = tried if before is None else before.union(tried)
        links = found if links is None else links.union(found)
        linked = components(links.toDF("u", "v"))
        rest = met.where("uid <> y").select("token", "uid", "n", "pos", "p", "central").join(linked.toDF("uid", "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
        mixed = rest.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("token")
        then, open_rows = open_rows, stage(rest.join(mixed, "token"), "open")
        drop_stage(met)
        drop_stage(then)

    # pairs that a star round has verified, with whatever result, are not verified again
    cross = stage(_cross_pairs(open_rows, num, den).join(before, ["x", "y"], "left_anti"), "cross")
    more = stage(verified(cross.select("x", "y"), nodes_small, docs, text_col, k, num, den), "links")
    if more.limit(1).count():
        linked = components(links.union(more).toDF("u", "v"))

    class_of = copies.select("uid", F.col("class").alias("node"))
    out = signed_docs.select("uid", "doc_id", "text_key", F.col("n").alias("n_shingles")).join(class_of, "uid", "left")
    out = out.withColumn("node", F.coalesce("node", "uid")).join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = out.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return out.join(ids, "root").select("doc_id", "n_shingles", "component_id", "uid", "root", "text_key")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` with one document left of each component, the one with the smallest id.

    Documents without words stay. Rows are matched by id and text, so rows that
    repeat both share their fate; if the survivor itself is repeated, one copy stays.
    """
    marked = ngram_components(docs, id_col, text_col, **kw).where("n_shingles > 0")
    best = marked.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "uid")).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    named = marked.join(best, "root")
    lost_id, lost_key, key = (fresh(n, docs.columns) for n in ("_id", "_key", "_text_key"))
    pick = lambda c: named.where(c).select(F.col("doc_id").alias(lost_id), F.col("text_key").alias(lost_key))
    lost = stage(pick(F.col("uid") != F.col("best.uid")).distinct(), "near-copies")
    stay = stage(pick(F.col("uid") == F.col("best.uid")), "survivors")
    twice = stage(lost.join(stay, (lost[lost_id].eqNullSafe(stay[lost_id])) & (lost[lost_key] == stay[lost_key]), "left_semi"), "repeated-survivors")
    keyed = docs.withColumn(key, text_key(text_col))
    same = lambda t: keyed[id_col].eqNullSafe(t[lost_id]) & (keyed[key] == t[lost_key])
    left = keyed.join(small(lost), same(lost), "left_anti")
    back = keyed.join(small(twice), same(twice), "left_semi").dropDuplicates([id_col, key])
    return left.unionByName(back).drop(key)


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN [array_to_string(words[i:i+4], ' ') FOR i IN range(1, len(words) - 3)]
                             WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * common >= 75 * (nx.n + ny.n - common)),
r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""
