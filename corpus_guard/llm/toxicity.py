"""Toxicity scores on deobfuscated text.

1. Letter trigram counts of all documents (a table bounded by the alphabet) make
   the character model of the decoder in ``deobfuscate``.
2. A logistic model over hashed words and word beginnings of the restored text is
   fitted on at most MAX_TRAIN labelled rows of the training folds, those with the
   smallest hashes of their ids. Only features whose log-odds stand out enter.
3. Every document is restored and scored in one pass over its whole text.

Defined results: null and empty texts score by the intercept alone; each row is
scored on its own, repeated rows alike; a null id is held out from nothing (its
fold is that of the empty string) and never labelled; without labels of both kinds
all rows score the smoothed share of toxic labels; labels, lang, source and ids are
never inputs of a score; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .deobfuscate import CLASSES, PIECE, Decoder, pieces, trigram_ids
from .hashing import LETTERS_ONLY, Words
from .staging import bound_batches, drop_stage, stage

MAX_TRAIN = 10_000
BITS = 20
STARTS = (4, 5, 6)
THRESHOLD = 0.7


def held_out(id_col: str = "doc_id"):
    """The fold that is never trained on: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _count_trigrams(batches):
    """Letter trigrams of a partition; texts are joined, parted by gaps, to about a megabyte at once."""
    total = np.zeros(CLASSES**3, np.int64)
    held: list[str] = []
    size = 0

    def flush():
        return np.bincount(trigram_ids("  ".join(held)), minlength=CLASSES**3)

    for batch in batches:
        for text in batch.column(0):
            for part in pieces(text.as_py()) if text.is_valid else ():
                held.append(part)
                size += len(part)
                if size > PIECE:
                    total += flush()
                    held, size = [], 0
    total += flush()
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])


def letter_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_count_trigrams, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES**3, np.int64)
    out[rows.column("id").to_numpy()] = rows.column("n").to_numpy()
    return out


def features(decoder: Decoder, texts, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, distinct and in row order, of the restored texts; only features that are ``wanted``, if given."""
    found: list[np.ndarray] = []
    mask = np.uint64((1 << BITS) - 1)

    def flush(rows, held):
        p, at = decoder.clean_points(held)
        data = p.tobytes().decode("utf-32-le", "replace").encode()
        size = np.zeros(len(p) + 1, np.int64)
        np.cumsum(1 + (p > 0x7F).astype(np.int8) + (p > 0x7FF) + (p > 0xFFFF), out=size[1:])
        w = Words(np.frombuffer(data, np.uint8), size[at], False, LETTERS_ONLY)
        doc = np.repeat(np.array(rows, np.uint64), np.diff(w.first))
        parts = [(doc, w.hash)]
        for k in STARTS:
            long, h = w.prefix_hash(k)
            parts.append((doc[long], h))
        feature = np.concatenate([h for _, h in parts]) & mask
        row = np.concatenate([r for r, _ in parts])
        if wanted is not None:
            some = wanted[feature]
            feature, row = feature[some], row[some]
        found.append(np.unique((row << np.uint64(BITS)) | feature))

    rows, held, size = [], [], 0
    for row, text in enumerate(texts):
        for part in pieces(text or ""):
            rows.append(row)
            held.append(part)
            size += len(part)
            if size > PIECE:
                flush(rows, held)
                rows, held, size = [], [], 0
    if held:
        flush(rows, held)
    both = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
    return (both >> np.uint64(BITS)).astype(np.int64), (both & mask).astype(np.int32)


def _train_features(decoder):
    def work(batches):
        for batch in batches:
            row, feature = features(decoder.value, (t.as_py() for t in batch.column("text")))
            sizes = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(sizes, pa.array(feature))], ["doc_id", "h", "y", "f"])

    return work


def fit(y: np.ndarray, sizes: np.ndarray, feature: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights by feature and intercept of an L2 logistic model over the features whose log-odds stand out."""
    n, pos = len(y), int(y.sum())
    weights = np.zeros(1 << BITS)
    base = float(np.log((pos + 0.5) / (n - pos + 0.5)))
    if not pos or pos == n:
        return weights, base
    ends = np.concatenate([[0], np.cumsum(sizes)])
    parts = [(i, min(i + 500, n)) for i in range(0, n, 500)]
    a, b = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for i, j in parts:
        toxic = np.repeat(y[i:j] == 1, sizes[i:j])
        f = feature[ends[i] : ends[j]]
        a += np.bincount(f[toxic], minlength=1 << BITS)
        b += np.bincount(f[~toxic], minlength=1 << BITS)
    odds = np.log((a + 0.5) / (pos - a + 0.5)) - np.log((b + 0.5) / (n - pos - b + 0.5))
    spread = np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (pos - a + 0.5) + 1 / (n - pos - b + 0.5))
    chosen = np.flatnonzero((odds / spread > 2.5) & (odds > 2) & (a >= 3))
    if not len(chosen):
        return weights, base
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    rows, ats = [], []
    for i, j in parts:
        at = place[feature[ends[i] : ends[j]]]
        rows.append(np.repeat(np.arange(i, j), sizes[i:j])[at >= 0])
        ats.append(at[at >= 0])
    row, at = np.concatenate(rows), np.concatenate(ats)
    w, c = np.zeros(len(chosen)), base
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):
        z = c + np.bincount(row, w[at], minlength=n)
        r = 1 / (1 + np.exp(-z)) - y
        g = np.append(np.bincount(at, r[row], minlength=len(chosen)) + 0.05 * w, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, c = w - step[:-1], c - step[-1]
    weights[chosen] = w
    return weights, float(c)


def _score(model, names: list[str], text_col: str = "text"):
    def work(batches):
        decoder, weights, base = model.value
        for batch in batches:
            row, feature = features(decoder, (t.as_py() for t in batch.column(text_col)), weights != 0)
            z = base + np.bincount(row, weights[feature], minlength=batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score)], [*names, "score"])

    return work


def model_for(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int):
    """(decoder, weights, intercept) from the letters of all documents and a bounded sample of training labels."""
    bound_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    decoder = sc.broadcast(Decoder(letter_counts(docs, text_col)))
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    marked = marked.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    marked = stage(marked.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(*order).limit(max_train), "train")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")
    # rows that repeat an id and a text count once; ids that repeat with other texts are kept to the bound in a fixed order
    rows = rows.withColumn("h", F.xxhash64("text")).select("doc_id", "h", "y", "text")
    chosen = stage(rows.select("doc_id", "h").distinct().orderBy(*order, "h").limit(max_train), "train-rows")
    rows = rows.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.select("doc_id", "h", "y", "text").mapInArrow(_train_features(decoder), f"doc_id {kind}, h long, y int, f array<int>").toArrow()
    drop_stage(marked)
    drop_stage(chosen)
    found = found.sort_by([("doc_id", "ascending"), ("h", "ascending")])
    y = found.column("y").to_numpy()
    lists = found.column("f").combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    weights, base = fit(y, sizes, lists.flatten().to_numpy())
    return decoder.value, weights.astype(np.float32), base


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(model_for(docs, labels, id_col, text_col, label_col, max_train))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = named.mapInArrow(_score(model, ["doc_id"]), T.StructType([named.schema["doc_id"]]).add("score", "double"))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(model_for(docs, labels, id_col, text_col, kw.get("label_col", "toxic"), kw.get("max_train", MAX_TRAIN)))
    threshold = kw.get("threshold", THRESHOLD)
    names = docs.columns
    inner = _score(model, names, text_col)

    def keep(batches):
        for batch in inner(batches):
            ok = batch.columns[-1].to_numpy() < threshold  # the score; an input column may have its name
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=batch.schema.remove(len(names))).filter(pa.array(ok))

    return docs.mapInArrow(keep, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
