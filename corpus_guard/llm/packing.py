"""Variable-capacity best-fit packing of token sequences.

Documents become pieces of at most the largest permitted length (a longer one
fills whole bins and leaves a remainder). Pieces are dealt into shards of about
SHARD pieces by a hash of their row and number; each shard is packed on its own, longest piece
first: into the open bin of any size that it fills best, else into a new bin of
the size that costs least. A size costs its length plus a fixed price per
sequence. Opening policies - each permitted size preferred for new bins, or the
least cost net of the room it leaves - are tried on the shard's lengths and the
cheapest packing wins; finally each bin shrinks to the cheapest size that holds
its contents. Shards grow in number, not in size, whatever ids
repeat.

Defined results: a document has its words plus one end token, so null and empty
texts are one token long and are packed too; ties go by id, then piece; repeated
rows are separate pieces; a null id is packed like any other; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import slices
from .staging import small, stage

CAPACITIES = (512, 1024, 2048, 4096)
PER_BIN = 64
SHARD = 20_000


def _word_counts(batches):
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for row, w in slices(batch.column("text")):
            n[row : row + len(w.offsets) - 1] = np.diff(w.first)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n)], ["doc_id", "n_words"])


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(_word_counts, T.StructType([named.schema["doc_id"]]).add("n_words", "long"))


def best_fit(lengths, capacities: tuple[int, ...], per_bin: int, prefer: int | None):
    """Bins of lengths given longest first: (bin of each piece, content of each bin, size of each bin after shrinking, total cost)."""
    top = capacities[-1]
    rate = min((c + per_bin) / c for c in capacities)
    room: dict[int, list[int]] = {}
    mask = 0
    where, content = [], []
    capacity: list[int] = []
    for n in lengths:
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            stack = room[r]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << r)
        else:
            b, r = len(content), prefer if prefer is not None and prefer >= n else min((c for c in capacities if c >= n), key=lambda c: (c + per_bin - rate * (c - n), c))
            content.append(0)
            capacity.append(r)
        content[b] += n
        left = r - n
        where.append(b)
        if left:
            room.setdefault(left, []).append(b)
            mask |= 1 << left
    sizes = np.array(capacities)[np.searchsorted(capacities, content)] if content else np.empty(0, int)
    assert not content or max(content) <= top
    return where, content, sizes, int(sizes.sum() + per_bin * len(content))


def _pack(capacities: tuple[int, ...], per_bin: int, names: list[str]):
    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["n_tokens"].tolist()
        tries = [best_fit(lengths, capacities, per_bin, p) for p in (None, *capacities)]
        where, content, sizes, _ = min(tries, key=lambda x: x[3])
        where = np.array(where)
        out = rows[names].copy()
        out["bin_id"] = [f"{s}-{b}" for s, b in zip(rows["shard"], where)]
        out["bin_capacity"], out["bin_tokens"] = sizes[where].astype(np.int64), np.array(content, np.int64)[where]
        return out

    def work(batches):
        held: list[pd.DataFrame] = []
        now = None
        for batch in batches:
            for shard, rows in batch.groupby("shard", sort=False):
                if held and shard != now:
                    yield packed(pd.concat(held))
                    held = []
                now = shard
                held.append(rows)
        if held:
            yield packed(pd.concat(held))

    return work


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, per_bin: int = PER_BIN,
    shard: int = SHARD, slot_col: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece_no, start_token, n_tokens, bin_id, bin_capacity, bin_tokens.

    With ``slot_col`` (places in a mixture, from 0) a shard is a run of consecutive slots, so bins follow the
    mixture and hold what stands together in it; the result has ``mix_slot`` too. A run with more than ``shard`` pieces
    is dealt into several by the same hash.
    """
    if slot_col is not None:
        return _pack_runs(docs, id_col, text_col, tuple(sorted(capacities)), per_bin, shard, slot_col)
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    counts = stage(word_counts(docs, id_col, text_col).withColumn("row_no", F.monotonically_increasing_id()), "word-counts")
    pieces = counts.withColumn("n", F.col("n_words") + 1).select("doc_id", "n", "row_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / top).cast("int"))).alias("piece_no"))
    pieces = pieces.select("doc_id", "row_no", "piece_no", (F.col("piece_no").cast("long") * top).alias("start_token"), F.least(F.lit(top), F.col("n") - F.col("piece_no").cast("long") * top).alias("n_tokens"))
    total = pieces.count()
    shards = max(1, -(-total // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row_no", "piece_no"), F.lit(shards)).cast("long"))
    names = ["doc_id", "piece_no", "start_token", "n_tokens"]
    schema = T.StructType([dealt.schema[c] for c in names]).add("bin_id", "string").add("bin_capacity", "long").add("bin_tokens", "long")
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.col("n_tokens").desc(), "doc_id", "piece_no", "row_no")
    return ordered.mapInPandas(_pack(capacities, per_bin, names), schema)


def _pack_runs(docs: DataFrame, id_col: str, text_col: str, capacities: tuple[int, ...], per_bin: int, shard: int, slot_col: str) -> DataFrame:
    top = capacities[-1]
    keyed = docs.select(F.struct(F.col(id_col).alias("doc_id"), F.coalesce(F.col(slot_col), F.lit(0)).cast("long").alias("slot")).alias("id"), F.col(text_col).alias("text"))
    counts = stage(word_counts(keyed, "id", "text").select("doc_id.doc_id", "doc_id.slot", "n_words", F.monotonically_increasing_id().alias("row_no")), "word-counts")
    n = F.col("n_words") + 1
    pieces = counts.select("doc_id", "slot", n.alias("n"), "row_no", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / top).cast("int"))).alias("piece_no"))
    pieces = pieces.select("doc_id", "row_no", "piece_no", (F.col("piece_no").cast("long") * top).alias("start_token"), F.least(F.lit(top), F.col("n") - F.col("piece_no").cast("long") * top).alias("n_tokens"), F.col("slot").alias("mix_slot"))
    total, slots = pieces.agg(F.count("*"), F.coalesce(F.max("mix_slot"), F.lit(0)) + 1).first()
    runs = max(1, -(-total // shard))
    pieces = pieces.withColumn("run", F.floor(F.col("mix_slot") * runs / slots).cast("long"))
    parts = stage(pieces.groupBy("run").agg(F.ceil(F.count("*") / shard).cast("long").alias("parts")), "runs")
    dealt = pieces.join(small(parts), "run").withColumn("shard", F.concat_ws("-", "run", F.pmod(F.xxhash64("row_no", "piece_no"), "parts")))
    names = ["doc_id", "piece_no", "start_token", "n_tokens", "mix_slot"]
    schema = T.StructType([dealt.schema[c] for c in names]).add("bin_id", "string").add("bin_capacity", "long").add("bin_tokens", "long")
    ordered = dealt.repartition(runs, "shard").sortWithinPartitions("shard", F.col("n_tokens").desc(), "doc_id", "piece_no", "row_no")
    return ordered.mapInPandas(_pack(capacities, per_bin, names), schema)


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
