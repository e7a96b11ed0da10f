"""Mixing sources to target weights by Pfair scheduling (DataFrame functions only).

The documents of a source, in the order of the MD5 of their id, are cut into
blocks of ``block_chars`` characters; a document belongs to the block in which it
starts. With integer weights q that sum to D, block j (from 0) of a source may take
a slot from its release floor(j*D/q) on and must by its deadline ceil((j+1)*D/q).
Earliest deadline first among released blocks meets all deadlines, so after any
number of slots each source is less than one block from its target.

A source whose blocks are used up leaves, and a new phase begins: the others are released anew and go on
at their weights, so no document of a weighted source is left out, and within each phase the deviation
stays under one block. The schedule of a phase repeats after the sum of its weights, so only that many
slots of each phase are computed, as one aggregate: a table of at most S phases of D slots for S sources, bounded by
the weights and sources, not by the data. Without ``leave`` only the first phase is selected.

Positions inside a source are two-level prefix sums over 4096 ranges of the MD5,
so a source with a third of all rows is split over as many window partitions. The phases
join by source with a broadcast when their rows, counted, are few.

Defined results: null text is empty; a null source counts as the source '';
without ``weights`` each source weighs as the square root of its characters, in
thousandths, at least one; a weighted source has at least one block, to which its empty texts belong; sources without a weight
are never selected (slot null); rows that share id and length are interchangeable; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import fresh, small, stage

BLOCK_CHARS = 16_384
RESOLUTION = 1000

#: One phase, as a function of acc (left: blocks still to come, done: blocks placed, t0: slots placed) over the arrays q and left.
_PICK = """array_min(transform(w, (x, i) -> if(x > 0, if(s.c[i] * d div x <= t, ((s.c[i] + 1) * d + x - 1) div x * size(w) + i, cast(null as bigint)), cast(null as bigint)))) % size(w)"""
_PHASE = f"""transform(array(transform(q, (x, i) -> if(acc.left[i] > 0, x, 0L))), w ->
  transform(array(aggregate(w, 0L, (a, x) -> a + x)), d ->
  transform(array(aggregate(sequence(0L, d - 1), named_struct('c', transform(w, x -> 0L), 'p', cast(array() as array<bigint>)),
    (s, t) -> transform(array({_PICK}), pick -> named_struct('c', transform(s.c, (x, i) -> if(i = pick, x + 1, x)), 'p', array_append(s.p, pick)))[0]).p), p ->
  transform(array(transform(w, (x, i) -> filter(sequence(0L, d - 1), t -> p[cast(t as int)] = i))), at ->
  transform(array(1 + array_min(transform(w, (x, i) -> if(x > 0, (acc.left[i] - 1) div x * d + at[i][cast((acc.left[i] - 1) % x as int)], cast(null as bigint))))), span ->
  transform(array(transform(w, (x, i) -> if(x > 0, span div d * x + size(filter(at[i], k -> k < span % d)), 0L))), used ->
  named_struct('left', transform(acc.left, (x, i) -> x - used[i]), 'done', transform(acc.done, (x, i) -> x + used[i]), 't0', acc.t0 + span,
    'out', array_append(acc.out, named_struct('t0', acc.t0, 'd', d, 'first', acc.done, 'used', used, 'w', w, 'at', at))))[0])[0])[0])[0])[0])[0]"""
_OUT = "array<struct<t0: bigint, d: bigint, first: array<bigint>, used: array<bigint>, w: array<bigint>, at: array<array<bigint>>>>"


def schedule(shares: DataFrame) -> DataFrame:
    """(source, q, b blocks) to the phases of the schedule: source, phase, t0 (its first slot), d (its period), q, first (block), used (blocks), at (slots of the source in a period)."""
    one = shares.where("q > 0 and b > 0").agg(F.sort_array(F.collect_list(F.struct("source", "q", "b"))).alias("s")).where("size(s) > 0")
    one = one.selectExpr("transform(s, x -> x.source) as names", "transform(s, x -> cast(x.q as bigint)) as q", "transform(s, x -> cast(x.b as bigint)) as b")
    start = f"named_struct('left', b, 'done', transform(b, x -> 0L), 't0', 0L, 'out', cast(array() as {_OUT}))"
    phases = one.selectExpr("names", f"aggregate(sequence(1, size(q)), {start}, (acc, k) -> if(array_max(acc.left) > 0, {_PHASE}, acc)).out as out")
    each = phases.selectExpr("names", "posexplode(out) as (phase, o)").selectExpr("phase", "o", "posexplode(names) as (i, source)")
    return each.selectExpr("source", "phase", "o.t0 as t0", "o.d as d", "o.w[i] as q", "o.first[i] as first", "o.used[i] as used", "o.at[i] as at").where("used > 0")


def mixture(
    docs: DataFrame, weights: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_chars: int = BLOCK_CHARS, resolution: int = RESOLUTION, leave: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, source, n_chars, block_no (from 0), slot (null without a weight), selected."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_chars"),
    )
    rows = stage(rows.withColumn("rank", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("part", F.substring("rank", 1, 3)), "lengths")
    parts = stage(rows.groupBy("source", "part").agg(F.sum("n_chars").alias("chars")), "parts")
    totals = parts.groupBy("source").agg(F.sum("chars").alias("chars"))
    if weights is None:
        root = totals.agg(F.sum(F.sqrt("chars")).alias("root"))
        shares = totals.crossJoin(F.broadcast(root)).select(
            "source", "chars", F.when(F.col("root") > 0, F.greatest(F.lit(1), F.floor(F.lit(resolution) * F.sqrt("chars") / F.col("root")))).otherwise(1).cast("long").alias("q")
        )
    else:
        given = spark.createDataFrame([(k, int(v)) for k, v in weights.items()] or [(None, 0)], "source string, q long")
        shares = totals.join(F.broadcast(given), "source")
    shares = stage(shares.where("q > 0"), "shares")
    before = F.sum("chars").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("source", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "part").orderBy("rank", "doc_id", "n_chars").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("ahead", F.coalesce(F.sum("n_chars").over(within), F.lit(0))).join(offsets, ["source", "part"])
    placed = placed.withColumn("block_no", F.floor((F.col("offset") + F.col("ahead")) / block_chars).cast("long"))
    sized = shares.select("source", "q", F.greatest(F.lit(1), F.ceil(F.col("chars") / block_chars)).cast("long").alias("b"))
    turns = schedule(sized).select(F.col("source").alias("of"), "phase", "t0", "d", "q", "first", "used", "at")
    turns = small(stage(turns.join(sized.select(F.col("source").alias("of"), "b"), "of"), "schedule"))
    block = F.least("block_no", F.col("b") - 1)
    timed = placed.join(turns, (F.col("source") == F.col("of")) & (block >= F.col("first")) & (block < F.col("first") + F.col("used")), "left")
    slot = F.expr("t0 + (least(block_no, b - 1) - first) div q * d + get(at, cast((least(block_no, b - 1) - first) % q as int))")
    selected = slot.isNotNull() if leave else F.coalesce(F.col("phase") == 0, F.lit(False))
    return timed.select("doc_id", "source", "n_chars", "block_no", slot.alias("slot"), selected.alias("selected"))


def with_slots(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The rows of ``docs`` with a weighted source, all of them, and their slot of the mixture that sources leave when used up as the column ``name``."""
    out = mixture(docs, id_col=id_col, text_col=text_col, source_col=source_col, leave=True, **kw).where("selected")
    # rows that share id, source and length are interchangeable: they go to the first of their slots
    key, source, n = (fresh(x, [*docs.columns, name]) for x in ("_id", "_source", "_n"))
    out = out.groupBy(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("n_chars").alias(n)).agg(F.min("slot").alias(name))
    out = stage(out, "mixed")
    on = (
        docs[id_col].eqNullSafe(out[key])
        & (F.coalesce(docs[source_col].cast("string"), F.lit("")) == out[source])
        & (F.length(F.coalesce(docs[text_col], F.lit(""))) == out[n])
    )
    return docs.join(small(out), on).select(*docs.columns, name)


def in_mixed_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The rows of ``docs`` with a weighted source, all of them, in the order of the mixture that sources leave when used up."""
    slot = fresh("_slot", docs.columns)
    return with_slots(docs, slot, id_col, text_col, source_col, **kw).orderBy(slot).select(*docs.columns)


def select_mixture(docs: DataFrame, weights: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """The rows of ``docs`` that the mixture selects, with all their columns."""
    out = mixture(docs, weights, id_col, text_col, source_col, **kw).where("not selected")
    key, source, n, rank = (fresh(x, docs.columns) for x in ("_id", "_source", "_n", "_rank"))
    out = stage(out.groupBy(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("n_chars").alias(n)).agg(F.count("*").alias(rank)), "unselected")
    on = (
        docs[id_col].eqNullSafe(out[key])
        & (F.coalesce(docs[source_col].cast("string"), F.lit("")) == out[source])
        & (F.length(F.coalesce(docs[text_col], F.lit(""))) == out[n])
    )
    whole = docs.join(small(out.drop(rank)), on, "left_anti")
    # of rows that share id, source and length as many go as the mixture does not select; they are few, at the horizon
    twins = docs.join(small(out), on).withColumn(fresh("_nth", docs.columns), F.row_number().over(Window.partitionBy(key, source, n).orderBy(F.xxhash64(text_col))))
    return whole.unionByName(twins.where(F.col(fresh("_nth", docs.columns)) > F.col(rank)).select(*docs.columns))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"), leave=True)


ORACLE = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, coalesce(source, '') AS source, length(coalesce(text, '')) AS n_chars, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS rank FROM documents),
src AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars FROM r GROUP BY source),
share AS (
  SELECT source, chars, CAST(greatest(1, floor({RESOLUTION} * sqrt(chars) / (SELECT sum(sqrt(chars)) FROM src))) AS BIGINT) AS q,
         row_number() OVER (ORDER BY source) - 1 AS i FROM src),
cfg AS (SELECT list(q ORDER BY i) AS qs, list(CAST(greatest(1, ceil(chars / {BLOCK_CHARS})) AS BIGINT) ORDER BY i) AS bs, count(*) AS s FROM share),
-- one row a slot: when the block before was its source's last, the others are released anew
run AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(-1 AS BIGINT) AS t, list_transform(qs, lambda x: CAST(0 AS BIGINT)) AS c, bs AS blocks_left, CAST(-1 AS BIGINT) AS pick FROM cfg
  UNION ALL
  SELECT slot + 1, t, list_transform(c, lambda x, j: CASE WHEN j - 1 = nxt THEN x + 1 ELSE x END), list_transform(blocks_left, lambda x, j: CASE WHEN j - 1 = nxt THEN x - 1 ELSE x END), nxt
  FROM (SELECT slot, t, c, blocks_left, list_min(list_filter([CASE WHEN blocks_left[k] > 0 AND c[k] * d // qs[k] <= t THEN ((c[k] + 1) * d + qs[k] - 1) // qs[k] * s + k - 1 END FOR k IN range(1, s + 1)], lambda x: x IS NOT NULL)) % s AS nxt
    FROM (SELECT slot, CASE WHEN anew THEN 0 ELSE t + 1 END AS t, CASE WHEN anew THEN list_transform(c, lambda x: CAST(0 AS BIGINT)) ELSE c END AS c, blocks_left, qs, s,
            list_sum([CASE WHEN blocks_left[k] > 0 THEN qs[k] ELSE 0 END FOR k IN range(1, s + 1)]) AS d
          FROM (SELECT *, pick >= 0 AND blocks_left[pick + 1] = 0 AS anew FROM run, cfg WHERE list_max(blocks_left) > 0)))),
turns AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS turn, count(*) OVER (PARTITION BY source) AS b FROM run JOIN share ON share.i = run.pick),
placed AS (
  SELECT doc_id, source, n_chars, CAST(floor(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY rank, doc_id, n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {BLOCK_CHARS}) AS BIGINT) AS block_no
  FROM r)
SELECT doc_id, p.source, n_chars, block_no, slot, slot IS NOT NULL AS selected FROM placed p JOIN turns ON turns.source = p.source AND turns.turn = least(p.block_no, turns.b - 1)
"""
