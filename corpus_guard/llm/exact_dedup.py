"""Exact dedup with a heavy-hitter split (DataFrame functions only).

Digests of all rows are written once. A Misra-Gries pass (``freqItems``) names the
digests that may hold more than ``support`` of the rows, at most 1/support of
them; their exact counts are checked and the verified winners, a table bounded by
1/support rows, are broadcast and joined map-side. All other digests hold at most
``support`` of the rows each; they are counted by one ordinary shuffle with map-side combine, and
those that occur again are joined back, by broadcast if their counted number allows it.

Defined results: null text equals empty text; of rows with equal text the largest
id stays, a null id only when no other has one; of repeated rows with that id
exactly one stays; an empty table gives an empty result; other columns of the
input are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import fresh, small, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A digest with over this share of the rows is split off; at most 1/SUPPORT such digests exist.
SUPPORT = 0.001


def text_digest(text: str = "text"):
    """SHA-256 of the text with A-Z lower-cased, as lowercase hex."""
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), 256)


def heavy_digests(rows: DataFrame, key: str, support: float) -> DataFrame:
    """Verified heavy keys with their count and their winner; at most 1/support rows."""
    maybe = rows.freqItems([key], support).select(F.explode(f"{key}_freqItems").alias(key)).distinct()
    counted = (
        rows.join(F.broadcast(maybe), key)
        .groupBy(key)
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_no")).alias("best"))
    )
    total = rows.count()
    return counted.where(F.col("group_size") > support * total)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("row_no"),
            F.unhex(text_digest(text_col)).alias("digest"),
        ),
        "digests",
    )
    heavy = stage(heavy_digests(rows, "digest", support), "heavy")
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    hot = marked.where("group_size is not null")
    rest = marked.where("group_size is null").drop("group_size", "best")
    groups = rest.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row_no")).alias("best"))
    several = stage(groups.where("group_size > 1"), "groups")
    alone = F.struct("doc_id", "row_no")
    rest = rest.join(small(several), "digest", "left").withColumn("group_size", F.coalesce("group_size", F.lit(1))).withColumn("best", F.coalesce("best", alone))
    return hot.unionByName(rest).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row_no") == F.col("row_no")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns.

    The winner of a text is matched by id and digest; rows that repeat both id and
    text are the same row, of which one is returned.
    """
    decided = stage(exact_dedup(docs, id_col, text_col, support), "decided")
    names = docs.columns
    sha, lost_id, lost_sha = (fresh(n, names) for n in ("_sha", "_id", "_lost"))
    tagged = docs.withColumn(sha, text_digest(text_col))
    lost = decided.where("not kept").select(F.col("doc_id").alias(lost_id), F.col("text_sha256").alias(lost_sha), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("twin"))
    gone = stage(lost.where("not twin").drop("twin").distinct(), "gone")
    again = stage(lost.where("twin").drop("twin").distinct(), "again")
    same = lambda t: tagged[id_col].eqNullSafe(t[lost_id]) & (tagged[sha] == t[lost_sha])
    once = tagged.join(small(gone), same(gone), "left_anti").join(small(again), same(again), "left_anti")
    twice = tagged.join(small(again), same(again), "left_semi").dropDuplicates([id_col, sha])
    return once.unionByName(twice).select(*names)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
