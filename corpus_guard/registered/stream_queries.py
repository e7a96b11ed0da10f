"""Queries of streams: the supplied tables replayed in micro-batches, the query stopped and restarted from its checkpoint in between."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.detectors.rule_sets import ENVIRONMENT
from corpus_guard.operators.deps import INSTALL_KINDS
from corpus_guard.operators.rules import scan_oracle
from corpus_guard.plans.staging import shared_dir
from corpus_guard.plans.views import oracle, table, view
from corpus_guard.registered.history_queries import EVIDENCE_SQL, evidence_events
from corpus_guard.registry import register
from corpus_guard.streaming.gates import batch_sink, install_audit
from corpus_guard.streaming.stateful import evidence_stream, watch_changes


def replay(spark, batches: list[DataFrame], run, name: str) -> str:
    """Each DataFrame is added to a folder that ``run(stream, checkpoint, out)`` reads until nothing is left; returns ``out``."""
    path = f"{shared_dir(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    for b in batches:
        b.write.mode("append").parquet(f"{path}/in")
        run(spark.readStream.schema(b.schema).parquet(f"{path}/in"), f"{path}/ck", f"{path}/out").awaitTermination()
    return f"{path}/out"


def _to_files(fn):
    return lambda stream, ck, out: fn(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start()


@register(
    "k03_watch_changes",
    oracle("""SELECT repo AS item, path, 'new' AS change FROM snap_a UNION ALL
SELECT coalesce(a.repo, b.repo), coalesce(a.path, b.path), CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END
FROM snap_a a FULL JOIN snap_b b ON a.repo = b.repo AND a.path = b.path WHERE a.sha256 IS DISTINCT FROM b.sha256""", "snap_a", "snap_b"),
)
def watched(spark, d):
    """K3: the first snapshot, then the second with a row without hash for what is gone; equal to D21 and D22."""
    a, b = view(spark, d, "snap_a"), view(spark, d, "snap_b")
    seen = lambda df, now: df.select(F.col("repo").alias("item"), "path", "sha256", F.lit(now).cast("long").alias("mtime_ns"), F.lit(now).cast("long").alias("now_ns"), F.lit(now).cast("long").alias("seq"))
    gone = a.join(b, ["repo", "path"], "left_anti").withColumn("sha256", F.lit(None).cast("string"))
    out = replay(spark, [seen(a, 1), seen(b.unionByName(gone), 2)], _to_files(watch_changes), "watch")
    return spark.read.schema("item string, path string, change string").parquet(out)


@register("k05_evidence_stream", EVIDENCE_SQL)
def evidence_as_stream(spark, d):
    """K5 with the watermark as the clock: the last word on each key is what the batch twin says at the newest time."""
    e = evidence_events(table(spark, d, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    middle = e.agg(F.expr("percentile_approx(unix_micros(ts), 0.5)").alias("m")).first().m or 0
    early = F.unix_micros("ts") <= middle
    out = replay(spark, [e.where(early), e.where(~early)], _to_files(lambda s: evidence_stream(s, event_time=True)), "evidence")
    told = spark.read.schema("kind string, key string, state string, status string, at_ms long, nth long").parquet(out)
    return told.groupBy("kind", "key").agg(F.max_by(F.struct("state", "status"), "nth").alias("l")).select("kind", "key", "l.state", "l.status")


_KINDS = " OR ".join(f"regexp_matches(command, '{p}')" for _, p in INSTALL_KINDS)
_REPO = "'src' || CAST(session % 64 AS VARCHAR)"


@register("k02_install_audit", oracle(f"SELECT * FROM (WITH z AS (SELECT 1) {scan_oracle(ENVIRONMENT)}) WHERE repo IN (SELECT {_REPO} FROM commands_v WHERE {_KINDS})", "files_v", "commands_v"))
def audited(spark, d):
    """K2: a command's session names a repo; an install has its files scanned. Batches land in folders of their own."""
    files = view(spark, d, "files_v")
    c = view(spark, d, "commands_v").select(F.concat(F.lit("src"), (F.col("session") % 64).cast("string")).alias("repo"), "command")
    run = lambda stream, ck, out: install_audit(stream, files, (ENVIRONMENT,), batch_sink(out)).option("checkpointLocation", ck).trigger(availableNow=True).start()
    out = replay(spark, [c], run, "audit")
    return spark.read.parquet(out).drop("batch_id").distinct()
