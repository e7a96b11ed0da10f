"""Quality selection by ordinal cumulative-link regression.

Ratings have LEVELS grades: 0 for low quality, 1 for good quality that is marked
toxic, 2 for good quality that is not. One weight vector over hashed text features
is shared by all grades; ordered thresholds t1 < t2 give P(grade >= k) =
sigmoid(w.x - tk), from which come the expected grade and the tail probability
that decides selection.

Features are hashed words (each weighs 1 / sqrt(distinct words)) and hashed shape
classes of the text (shares of capitals, marks, repeats, digits, short lines, word
lengths, each in a few bands). The model is fitted on at most MAX_TRAIN rated rows
of the training folds, those with the smallest hashes of their ids; scoring reads
every document whole.

Defined results: null and empty texts have only the shape features of an empty
text; repeated rows score alike; a null id is never rated; without ratings of two
grades every row gets the smoothed shares of the grades; ratings, lang, source and
ids are never inputs; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import mix, slices
from .staging import drop_stage, stage
from .toxicity import held_out

LEVELS = 3
MAX_TRAIN = 8_000
BITS = 18
SHAPES = 4096
#: Lowest grade that counts as good, and the least probability of reaching it.
GOOD, TAIL = 1, 0.5
_BANDS = np.array([0.0, 0.002, 0.01, 0.03, 0.08, 0.15, 0.3, 0.5, 0.7, 0.9])


def _is(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER = _is("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _is("0123456789")
_MARKS = _is("!#$%&*+-/<=>@[]^_|~")
_COMMA, _STOP, _LINE, _PIPE = _is(",;"), _is(".:?"), _is("\n"), _is("|")


def _shares(w) -> np.ndarray:
    """(documents, shapes) numbers between 0 and 1 of a slice."""
    n_doc = len(w.offsets) - 1
    words = np.maximum(np.diff(w.first), 1)
    size = np.maximum(np.diff(w.offsets), 1)

    def per_byte(table):
        total = np.concatenate([[0], np.cumsum(table[w.data])])
        return total[w.offsets[1:]] - total[w.offsets[:-1]]

    def per_word(flag):
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[w.first[1:]] - total[w.first[:-1]]) / words

    length = w.ends - w.starts
    again = np.zeros(len(w.hash), bool)
    again[1:] = w.hash[1:] == w.hash[:-1]
    start = w.first[:-1][w.first[:-1] < len(again)]
    again[start] = False
    last = w.data[w.ends - 1] if len(w.ends) else np.empty(0, np.uint8)
    doc = np.repeat(np.arange(n_doc), np.diff(w.first))
    distinct = np.bincount((np.unique((doc.astype(np.uint64) << np.uint64(44)) | (w.hash >> np.uint64(20))) >> np.uint64(44)).astype(np.int64), minlength=n_doc)
    mean = per_word(length) / 40
    columns = [
        per_byte(_UPPER) / size, per_byte(_DIGIT) / size, per_byte(_MARKS) / size, per_word(_COMMA[last]), per_word(_STOP[last]), per_word(_MARKS[last]),
        per_word(again), 1 - distinct / words, np.minimum(mean, 1), per_byte(_LINE) / words, per_word(length == 1), per_byte(_PIPE) / words, np.minimum(words / 2000, 1),
        per_word(length >= 8),
    ]
    return np.clip(np.stack(columns, 1), 0, 1)


def features(column: pa.Array):
    """(row, feature, value) of the texts of an Arrow column; features under SHAPES are shapes."""
    rows, ids, values = [], [], []
    keep = np.uint64((1 << BITS) - SHAPES - 1)
    for first, w in slices(column, lower=True):
        n = len(w.offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(w.first)).astype(np.uint64)
        both = np.unique((doc << np.uint64(BITS)) | (w.hash % keep + np.uint64(SHAPES)))
        r = (both >> np.uint64(BITS)).astype(np.int64)
        count = np.bincount(r, minlength=n)
        rows.append(r + first)
        ids.append((both & np.uint64((1 << BITS) - 1)).astype(np.int32))
        values.append(1 / np.sqrt(count[r]))
        shares = _shares(w)
        band = np.searchsorted(_BANDS, shares, "right")
        code = mix((np.arange(shares.shape[1])[None] * 64 + band).astype(np.uint64)) % np.uint64(SHAPES)
        rows.append(np.repeat(np.arange(n), shares.shape[1]) + first)
        ids.append(code.astype(np.int32).reshape(-1))
        values.append(np.ones(code.size))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0)
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(values)


def _train_features(batches):
    for whole in batches:
        for batch in parts_of(whole):
            row, feature, value = features(batch.column("text"))
            order = np.argsort(row, kind="stable")
            sizes = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.ListArray.from_arrays(sizes, pa.array(feature[order])), pa.ListArray.from_arrays(sizes, pa.array(value[order].astype(np.float32)))], ["doc_id", "h", "y", "f", "v"]
            )


def fit(y: np.ndarray, sizes: np.ndarray, feature: np.ndarray, value: np.ndarray, levels: int = LEVELS, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds by gradient descent on the cumulative-link likelihood."""
    n = len(y)
    tail = np.array([(y >= k).sum() + 0.5 for k in range(1, levels)]) / (n + 1)
    thresholds = -np.log(tail / (1 - tail))
    weights = np.zeros(1 << BITS)
    if n == 0 or len(np.unique(y)) < 2:
        return weights, thresholds
    used, at = np.unique(feature, return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    w = np.zeros(len(used))
    gaps = np.log(np.maximum(np.diff(thresholds), 1e-3))
    p = np.concatenate([w, [thresholds[0]], gaps])
    m, v = np.zeros(len(p)), np.zeros(len(p))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, rounds + 1):
        w, t0, g = p[: len(used)], p[len(used)], p[len(used) + 1 :]
        theta = t0 + np.concatenate([[0], np.cumsum(np.exp(g))])
        s = np.bincount(row, w[at] * value, minlength=n)
        above = sig(s[:, None] - theta[None, :])  # P(y >= k), k = 1..
        up = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        like = np.maximum(up[np.arange(n), y] - up[np.arange(n), y + 1], 1e-9)
        slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], 1)
        lo, hi = slope[np.arange(n), y] / like, slope[np.arange(n), y + 1] / like
        d_s = -(lo - hi)
        d_theta = np.array([lo[y == k].sum() - hi[y == k - 1].sum() for k in range(1, levels)])
        grad_w = np.bincount(at, d_s[row] * value, minlength=len(used)) + 0.5 * w
        tail_sum = np.cumsum(d_theta[::-1])[::-1]
        grad = np.concatenate([grad_w, [d_theta.sum()], np.exp(g) * tail_sum[1:]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        p = p - 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    weights[used] = p[: len(used)]
    theta = p[len(used)] + np.concatenate([[0], np.cumsum(np.exp(p[len(used) + 1 :]))])
    return weights, theta


def _score(model, names: list[str], levels: int):
    def work(batches):
        weights, theta = model.value
        for whole in batches:
            for batch in parts_of(whole):
                row, feature, value = features(batch.column("text"))
                s = np.bincount(row, weights[feature] * value, minlength=batch.num_rows)
                tails = 1 / (1 + np.exp(-np.clip(s[:, None] - theta[None, :], -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(tails.sum(1)), *(pa.array(tails[:, k]) for k in range(levels - 1))],
                    [*names, "expected_grade", *(f"p_ge_{k + 1}" for k in range(levels - 1))],
                )

    return work


def parts_of(batch: pa.RecordBatch, most: int = 4 << 20):
    """A batch in runs of rows whose texts together have about ``most`` bytes, so that features of few texts are held at once."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def ratings(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Grades from the label columns: 0 low, 1 good but toxic, 2 good."""
    good, toxic = F.coalesce(F.col("quality"), F.lit(0)) > 0, F.coalesce(F.col("toxic"), F.lit(0)) > 0
    return labels.where("quality is not null").select(F.col(id_col).alias("doc_id"), F.when(~good, 0).when(toxic, 1).otherwise(2).alias("y"))


def grade(
    docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = LEVELS, max_train: int = MAX_TRAIN, good: int = GOOD, tail: float = TAIL
) -> DataFrame:
    """One row per input row: doc_id, held_out, expected_grade, p_ge_k for each grade k, selected. ``rated`` has doc_id and y."""
    marked = rated.where(F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("y").alias("y"))
    marked = stage(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "rated")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id").withColumn("h", F.xxhash64("text"))
    # rows that repeat an id and a text count once; ids that repeat with other texts are kept to the bound in a fixed order
    chosen = stage(rows.select("doc_id", "h").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(max_train), "rated-rows")
    rows = rows.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "y", "text")
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(_train_features, f"doc_id {kind}, h long, y int, f array<int>, v array<float>").toArrow().sort_by([("doc_id", "ascending"), ("h", "ascending")])
    drop_stage(marked)
    drop_stage(chosen)
    f, v = found.column("f").combine_chunks(), found.column("v").combine_chunks()
    weights, theta = fit(found.column("y").to_numpy(), f.value_lengths().to_numpy(zero_copy_only=False), f.flatten().to_numpy(), v.flatten().to_numpy().astype(float), levels)
    model = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), theta))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([named.schema["doc_id"]]).add("expected_grade", "double")
    for k in range(1, levels):
        schema = schema.add(f"p_ge_{k}", "double")
    out = named.mapInArrow(_score(model, ["doc_id"], levels), schema)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "expected_grade", *(f"p_ge_{k}" for k in range(1, levels)), (F.col(f"p_ge_{good}") >= tail).alias("selected"))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return grade(spark.read.parquet(f"{sf_dir}/documents.parquet"), ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))
