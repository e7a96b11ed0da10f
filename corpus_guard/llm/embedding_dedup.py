"""Near-duplicate vectors by cross-polytope hashing with multiprobe.

1. Valid vectors are scaled to unit length in double precision, their largest component
   first, so nothing over- or underflows; equal vectors collapse to one node that
   remembers how many it stands for. Vectors of one length are compared with each other.
2. For each of TABLES tables a vector is rotated twice by three rounds of random
   signs and a fast Hadamard transform; the signed axis nearest to it in each rotation
   makes the bucket. It enters its own bucket and the PROBES next best ones. Every bucket
   is split by the axes of a third rotation, with probes too, however many entries it
   has, so that two vectors meet or not by themselves and not by the size of the input.
   An entry is the node, its bucket and a sketch of 128 signs; vectors do not move.
3. Buckets of more than DENSE entries compare all nodes with their smallest one first. Nodes
   verified within half the angle of the threshold around it form a ball, in
   which all are linked with all, so its links are counted without listing pairs.
4. The others are compared in cells, pairs of blocks of at most BLOCK entries of a bucket;
   blocks of one ball do not meet. Pairs whose sketches differ in at most APART signs are
   candidates, distinct ones are verified once by their cosine on the vectors.
5. Links per vector are summed; components come from links and balls.

A pair at the threshold differs in 18 of 128 signs on average, with a deviation of 4,
so the sketches lose one pair in ten million.

Defined results: null, empty and zero vectors and those with null or non-finite
components link with nothing and are kept; vectors of different lengths are not
comparable and do not link with each other; rows that repeat an id are separate vectors of
that id; a null id takes part and names a component only if it has no other; kept
compares the row's id with the component's, so rows that repeat the id that names a
component are all kept; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import drop_stage, small, stage

COSINE = 0.9
TABLES, PROBES, BLOCK = 8, 2, 1024
#: Entries of a bucket up to which it is not split: one meets nothing, so none that counts stays whole.
FULL = 1
#: Entries of a bucket from which on it is looked through for balls.
DENSE = 64
#: Most signs of 128 in which the sketches of a linked pair differ.
APART = 40
SEED = 7


@lru_cache(maxsize=4)
def _signs(dim: int, tables: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, 3, 3, dim))


@lru_cache(maxsize=4)
def _planes(width: int) -> np.ndarray:
    return np.random.default_rng(SEED + 1).normal(size=(width, 128))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the width is a power of two."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def _vertices(x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` signed axes nearest to each row, best first, and how far they fall short of the best."""
    part = np.argsort(-np.abs(x), axis=1)[:, :count]
    value = np.take_along_axis(x, part, 1)
    return part * 2 + (value < 0), np.abs(value[:, :1]) - np.abs(value)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; the largest component is scaled to 1 first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def buckets(unit: np.ndarray, tables: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tables, 1 + probes) bucket numbers of the first two rotations, and axes of the third; the own one first."""
    dim = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), dim))
    x[:, : unit.shape[1]] = unit
    signs = _signs(dim, tables)
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    third = np.empty((len(unit), tables, 1 + probes), np.int64)
    width = probes + 1
    for t in range(tables):
        found = []
        for r in range(3):
            y = x
            for s in signs[t, r]:
                y = _hadamard(y * s)
            found.append(_vertices(y, width))
        (va, la), (vb, lb), (vc, _) = found
        loss = (la[:, :, None] + lb[:, None, :]).reshape(len(x), -1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :width]
        # vectors of few components have fewer axes than probes; the best is repeated then
        if order.shape[1] < width:
            order = np.concatenate([order, np.repeat(order[:, :1], width - order.shape[1], 1)], 1)
        if vc.shape[1] < width:
            vc = np.concatenate([vc, np.repeat(vc[:, :1], width - vc.shape[1], 1)], 1)
        a, b = order // va.shape[1], order % vb.shape[1]
        out[:, t] = np.take_along_axis(va, a, 1) * (2 * dim) + np.take_along_axis(vb, b, 1)
        third[:, t] = vc
    return out, third


def sketches(unit: np.ndarray) -> np.ndarray:
    """(rows, 2) words of the signs of 128 random projections."""
    bits = np.packbits(unit @ _planes(unit.shape[1]) > 0, axis=1)
    return np.ascontiguousarray(bits).view(np.int64)


def _enter(tables: int, probes: int):
    def work(batches):
        for batch in batches:
            lists = batch.column("v")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy().astype(np.float64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                for lo in range(0, len(rows), 2048):
                    at = rows[lo : lo + 2048]
                    unit = unit_rows(flat[ends[at][:, None] + np.arange(dim)])
                    code, third = buckets(unit, tables, probes)
                    sketch = sketches(unit)
                    n, width = len(at), tables * (1 + probes)
                    cut = np.arange(n + 1, dtype=np.int32) * width
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("node").take(pa.array(at)), pa.array(np.full(n, dim, np.int32)), pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy()),
                            pa.ListArray.from_arrays(cut, pa.array(code.reshape(-1))), pa.ListArray.from_arrays(cut, pa.array(third.reshape(-1))),
                        ],
                        ["node", "dim", "s1", "s2", "codes", "thirds"],
                    )

    return work


def _verify(least: float):
    """Of (x, y, xv, yv) the pairs whose cosine is at least ``least``."""

    def dots(a, b, starts):
        return np.add.reduceat(a * b, starts)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            xs, ys = (batch.column(c).value_lengths().to_numpy(zero_copy_only=False) for c in ("xv", "yv"))
            same = pa.array(xs == ys)
            batch = batch.filter(same)
            if not batch.num_rows:
                continue
            size = batch.column("xv").value_lengths().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            unit = []
            for c in ("xv", "yv"):
                v = batch.column(c).flatten().to_numpy().astype(np.float64)
                v = v / np.repeat(np.maximum.reduceat(np.abs(v), starts), size)
                unit.append(v / np.repeat(np.sqrt(dots(v, v, starts)), size))
            near = dots(*unit, starts) >= least
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(pa.array(near))

    return work


@lru_cache(maxsize=128)
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _cells(apart: int, most: int = 1 << 20):
    """Cells (key, bi, bj) come sorted and hold at most two blocks: pairs of nodes of different balls whose sketches are close."""
    keys = ("key", "bi", "bj")

    def near(c, a, b):
        """Of pairs of entries the pairs of nodes, smaller first."""
        far = np.bitwise_count((c["s1"][a] ^ c["s1"][b]).view(np.uint64)) + np.bitwise_count((c["s2"][a] ^ c["s2"][b]).view(np.uint64)).astype(np.int16)
        ok = (far <= apart) & (c["node"][a] != c["node"][b]) & ((c["ball"][a] != c["ball"][b]) | (c["ball"][a] < 0))
        x, y = c["node"][a[ok]], c["node"][b[ok]]
        return np.minimum(x, y), np.maximum(x, y)

    def pairs(c, cuts):
        sizes = np.diff(np.append(cuts, len(c["node"])))
        for m in np.unique(sizes[(sizes > 1) & (sizes <= 64)]):
            i, j = _triangle(int(m))
            starts = cuts[sizes == m]
            step = max(1, most // len(i))
            for lo in range(0, len(starts), step):
                at = starts[lo : lo + step, None]
                a, b = (at + i).ravel(), (at + j).ravel()
                # in a cell of two blocks only pairs across them count; each block has a cell of its own
                across = (c["block"][a] != c["block"][b]) | (c["bi"][a] == c["bj"][a])
                yield near(c, a[across], b[across])
        for lo, m in zip(cuts[sizes > 64], sizes[sizes > 64]):
            at = np.arange(lo, lo + m)
            x, y = at[c["block"][at] == c["bi"][lo]], at[c["block"][at] == c["bj"][lo]]
            step = max(1, most // max(1, len(y)))
            for k in range(0, len(x), step):
                a, b = np.repeat(x[k : k + step], len(y)), np.tile(y, len(x[k : k + step]))
                if c["bi"][lo] == c["bj"][lo]:
                    a, b = a[a < b], b[a < b]
                yield near(c, a, b)

    def work(batches):
        held: dict | None = None

        def out(c, cuts):
            for x, y in pairs(c, cuts):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = {k: batch.column(k).to_numpy() for k in (*keys, "block", "node", "ball", "s1", "s2")}
            if held is not None:
                now = {k: np.concatenate([held[k], now[k]]) for k in now}
            change = np.ones(len(now["node"]), bool)
            change[1:] = False
            for k in keys:
                change[1:] |= now[k][1:] != now[k][:-1]
            cuts = np.flatnonzero(change)
            last = int(cuts[-1])
            if last:
                yield from out({k: x[:last] for k, x in now.items()}, cuts[:-1])
            held = {k: x[last:] for k, x in now.items()}
        if held is not None:
            yield from out(held, np.array([0]))

    return work


def _checked(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Of distinct pairs (x, y) of nodes those whose cosine is at least ``least``."""
    x, y = vectors.select(F.col("node").alias("x"), F.col("v").alias("xv")), vectors.select(F.col("node").alias("y"), F.col("v").alias("yv"))
    return pairs.distinct().join(x, "x").join(y, "y").select("x", "y", "xv", "yv").mapInArrow(_verify(least), "x long, y long")


def _entries(coded: DataFrame, probes: int, full: int) -> DataFrame:
    """Staged entries of buckets that hold several nodes: key, own, node, s1, s2."""
    width = 1 + probes
    table = (F.col("place") / width).cast("int")
    each = coded.select("node", "dim", "s1", "s2", "thirds", F.posexplode("codes").alias("place", "code"))
    each = each.select("node", "s1", "s2", F.xxhash64("dim", table, "code").alias("key"), (F.col("place") % width == 0).alias("own"), F.slice("thirds", table * width + 1, width).alias("third"))
    counts = stage(each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "bucket-sizes")
    held = each.join(counts, "key")
    split = held.where(F.col("c") > full).select("key", "own", "node", "s1", "s2", F.posexplode(F.array_distinct("third")).alias("at", "axis"))
    split = split.select(F.xxhash64("key", "axis").alias("key"), (F.col("own") & (F.col("at") == 0)).alias("own"), "node", "s1", "s2")
    return stage(held.where(F.col("c") <= full).select("key", "own", "node", "s1", "s2").unionByName(split), "entries")


def _balls(entries: DataFrame, vectors: DataFrame, cosine: float, apart: int, dense: int) -> DataFrame:
    """Staged (node, ball): nodes within half the threshold's angle of their ball's node, which is smaller and in no other ball, and that node itself."""
    tight = float(np.sqrt((1 + cosine) / 2)) + 1e-9
    own = entries.where("own")
    centres = own.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("node", "s1", "s2")).alias("m")).where(F.col("c") > dense)
    met = own.join(centres, "key").where(F.col("node") > F.col("m.node"))
    far = F.bit_count(F.col("s1").bitwiseXOR(F.col("m.s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("m.s2")))
    pairs = met.where(far <= apart).select(F.col("m.node").alias("x"), F.col("node").alias("y"))
    found = stage(_checked(pairs, vectors, tight), "tight")
    members = stage(found.select(F.col("y").alias("x")).distinct(), "tight-members")
    free = found.join(small(members), "x", "left_anti").groupBy(F.col("y").alias("node")).agg(F.min("x").alias("ball"))
    free = stage(free, "ball-members")
    return stage(free.union(free.select("ball", "ball").distinct()), "balls")


def near_duplicates(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK,
    full: int = FULL, dense: int = DENSE,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    v = F.col("v").cast("array<double>")
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.monotonically_increasing_id().alias("uid"))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = rows.withColumn("ok", finite & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    rows = stage(rows.select("vec_id", "uid", "v", F.when(F.col("ok"), F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b"), F.size("v").alias("n"))).alias("key")), "vectors")
    valid = rows.where("key is not null")
    classes = stage(valid.groupBy("key").agg(F.min("uid").alias("node"), F.count("*").alias("weight"), F.min("vec_id").alias("id")), "vector-classes")
    several = stage(classes.where("weight > 1").select("key", "node"), "vector-copies")
    nodes = classes.select("node", "weight", "id")
    vectors = stage(valid.join(classes.select(F.col("node").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("node"), "v"), "node-vectors")
    coded = stage(vectors.mapInArrow(_enter(tables, probes), "node long, dim int, s1 long, s2 long, codes array<bigint>, thirds array<bigint>"), "codes")
    entries = _entries(coded, probes, full)
    balls = _balls(entries, vectors, cosine, APART // 2, dense)

    entries = entries.join(small(balls), "node", "left").withColumn("ball", F.coalesce("ball", F.lit(-1)))
    sizes = stage(entries.groupBy("key", "ball").agg(F.count("*").alias("c")), "group-sizes")
    large = stage(sizes.where((F.col("ball") >= 0) & (F.col("c") > block)).select("key", "ball", F.ceil(F.col("c") / block).cast("int").alias("own_blocks")), "large-groups")
    # blocks of a bucket are numbered: those of all small groups and single nodes first, then those of each large ball
    total = sizes.groupBy("key").agg(F.sum("c").alias("n"))
    per_key = large.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ball", "own_blocks"))).alias("balls"), F.sum("own_blocks").alias("ball_blocks"))
    in_balls = sizes.join(large.select("key", "ball"), ["key", "ball"]).groupBy("key").agg(F.sum("c").alias("in_balls"))
    total = total.where("n > 1").join(small(stage(per_key.join(in_balls, "key"), "large-buckets")), "key", "left")
    total = total.withColumn("rest", F.ceil((F.col("n") - F.coalesce("in_balls", F.lit(0))) / block).cast("int"))
    total = stage(total.select("key", "rest", "balls", (F.col("rest") + F.coalesce("ball_blocks", F.lit(0))).cast("int").alias("blocks")), "bucket-blocks")
    dealt = entries.join(total, "key")
    before = F.aggregate(F.filter("balls", lambda b: b["ball"] < F.col("ball")), F.col("rest"), lambda n, b: n + b["own_blocks"])
    mine = F.coalesce(F.get(F.filter("balls", lambda b: b["ball"] == F.col("ball")), F.lit(0))["own_blocks"], F.lit(0))
    dealt = dealt.withColumn("own_blocks", mine).withColumn("first", F.when(F.col("own_blocks") > 0, before).otherwise(0))
    dealt = dealt.withColumn("block", (F.col("first") + F.pmod(F.xxhash64("node"), F.when(F.col("own_blocks") > 0, F.col("own_blocks")).otherwise(F.col("rest")))).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    others = F.when(F.col("own_blocks") > 0, F.filter(others, lambda o: (o < F.col("first")) | (o >= F.col("first") + F.col("own_blocks")))).otherwise(others)
    dealt = dealt.withColumn("other", F.explode(others)).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    cells = dealt.select("key", "bi", "bj", "block", "node", "ball", "s1", "s2").repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    found = stage(_checked(cells.mapInArrow(_cells(APART), "x long, y long"), vectors, cosine), "vector-links")

    weight = nodes.select("node", "weight")
    both = found.select(F.col("x").alias("node"), F.col("y").alias("other")).union(found.select("y", "x"))
    links = both.join(weight.toDF("other", "w"), "other").groupBy("node").agg(F.sum("w").alias("links"))
    in_ball = balls.join(weight, "node")
    ball_weight = in_ball.groupBy("ball").agg(F.sum("weight").alias("all"))
    in_ball = in_ball.join(ball_weight, "ball").select("node", (F.col("all") - F.col("weight")).alias("links"))
    links = stage(links.union(in_ball).groupBy("node").agg(F.sum("links").alias("links")), "link-counts")
    linked = components(found.toDF("u", "v").union(balls.toDF("u", "v")))
    named = linked.join(nodes.select("node", "id"), "node")
    linked = stage(named.join(small(stage(named.groupBy("root").agg(F.min("id").alias("component")), "component-ids")), "root").select("node", "component"), "linked")

    per_row = rows.select("vec_id", "uid", "key").join(small(several), "key", "left").withColumn("node", F.coalesce("node", "uid"))
    marks = classes.where("weight > 1").select("node", "weight", "id").join(links, "node", "full").join(linked, "node", "full")
    marks = stage(marks.select("node", "weight", "links", F.coalesce("component", "id").alias("component")), "marks")
    out = per_row.join(small(marks), "node", "left").withColumn("component", F.coalesce("component", "vec_id"))
    for used in (coded, vectors, entries, sizes):
        drop_stage(used)
    return out.select(
        "vec_id",
        (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"),
    )


def op7_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x) n USING (vec_id)
JOIN (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x) c USING (vec_id)
"""
