"""Structured Streaming operators; each shares its plan with a batch twin (K1-K5, K7)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpus_guard.operators.deps import INSTALL_KINDS, command_packages, detect_installs
from corpus_guard.operators.rules import audit_findings
from corpus_guard.plans.staging import stage
from corpus_guard.streaming.stateful import evidence_stream, watch_changes


#: Names of a threat feed up to which it is held as one array.
FEED_NAMES = 20_000


def command_gate(commands: DataFrame, names: DataFrame) -> DataFrame:
    """K1: per command approve or block: a pipe to a shell blocks, and so does a package with a malicious name. Stateless; works on streams and tables.

    ``names`` (name) is a threat-feed table. Up to ``FEED_NAMES`` of them, counted, are one array, so that the gate stays one
    narrow projection. Beyond that the words of a table of commands are joined with it by equality, a
    command known by a number of its own; a stream calls the gate on its micro-batches then.
    """
    bad = names.select(F.lower("name").alias("_word")).where("_word <> ''").distinct()
    gated = detect_installs(commands)
    words = F.filter(F.split(F.lower("command"), r"[\s;&|]+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.regexp_extract(w, r"^(@?[a-z0-9._/-]+)", 1))
    if bad.limit(FEED_NAMES + 1).count() <= FEED_NAMES:
        listed = F.broadcast(bad.agg(F.collect_set("_word").alias("_bad")))
        gated = gated.crossJoin(listed).withColumn("_hit", F.col("kind").isNotNull() & F.arrays_overlap(plain, F.col("_bad")))
    elif commands.isStreaming:
        raise ValueError(f"more than {FEED_NAMES} names: call the gate on micro-batches (foreachBatch)")
    else:
        gated = stage(gated.withColumn("_row", F.monotonically_increasing_id()), "gated")
        asked = gated.where("kind is not null").select("_row", F.explode(F.array_distinct(plain)).alias("_word"))
        hits = asked.join(bad, "_word", "left_semi").select("_row", F.lit(True).alias("_hit")).distinct()
        gated = gated.join(hits, "_row", "left")
    piped = F.col("kind").isin("pipe-to-shell", "process-substitution")
    reason = F.when(piped, "pipe-to-shell").when(F.coalesce("_hit", F.lit(False)), "malicious-package").otherwise("")
    return gated.select(*commands.columns, F.when(reason != "", "block").otherwise("approve").alias("decision"), reason.alias("reason"))


#: Named repos up to which their files are read by a pushed-down filter; more are semi-joined.
NAMED_REPOS = 1000


def files_of(files: DataFrame, repos: DataFrame) -> DataFrame:
    """The files of the repos(repo): few names prune the scan, many are joined."""
    names = [r.repo for r in repos.where("repo is not null").distinct().limit(NAMED_REPOS + 1).collect()]
    return files.where(F.col("repo").isin(names)) if len(names) <= NAMED_REPOS else files.join(repos, "repo", "left_semi")


def install_audit(commands: DataFrame, files: DataFrame, scans, sink) -> "object":
    """K2: for each micro-batch of commands with an install kind, scan the files of the named repo and hand the findings to ``sink(df, batch_id)``."""

    def batch(df: DataFrame, batch_id: int) -> None:
        repos = detect_installs(df).where("kind is not null").select("repo").distinct()
        sink(audit_findings(files_of(files, repos), scans), batch_id)

    return commands.writeStream.foreachBatch(batch)


def batch_sink(path: str):
    """A sink that writes each micro-batch to a folder of its own, named by its id: a batch that is run again replaces what it wrote before."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    return write


def scan_changed(changed: DataFrame, deps: DataFrame, names: DataFrame) -> DataFrame:
    """K4: dependencies of changed items that have a malicious name."""
    bad = names.select(F.lower("name").alias("name")).distinct()
    return deps.withColumn("name", F.lower("name")).join(changed.select("item").distinct(), "item", "left_semi").join(bad, "name", "left_semi")


_FLOOR = T.StructType([T.StructField("floor", T.LongType())])


def _floor(key, batches, state: GroupState):
    (pack,) = key
    floor = state.get[0] if state.exists else None
    out = []
    for rows in batches:
        for seq, version in rows.sort_values("seq")[["seq", "version"]].itertuples(index=False):
            out.append((pack, int(seq), int(version), floor is None or version >= floor))
            floor = int(version) if floor is None else max(floor, int(version))
    state.update((floor,))
    yield pd.DataFrame(out, columns=["pack", "seq", "version", "accepted"])


def version_floor_stream(stream: DataFrame) -> DataFrame:
    """K7: offered versions(pack, seq, version) accepted when not below the highest so far, kept as state per pack."""
    return stream.groupBy("pack").applyInPandasWithState(_floor, "pack string, seq long, version long, accepted boolean", _FLOOR, "append", GroupStateTimeout.NoTimeout)


__all__ = ["INSTALL_KINDS", "batch_sink", "command_gate", "command_packages", "evidence_stream", "install_audit", "scan_changed", "version_floor_stream", "watch_changes"]
