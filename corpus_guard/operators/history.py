"""Snapshots, drift, history and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tree_diff(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Added, removed and changed paths of two snapshots (repo, path, sha256)."""
    x, y = a.select(*keys, F.col("sha256").alias("old")), b.select(*keys, F.col("sha256").alias("new"))
    kind = F.when(F.isnull("old"), "added").when(F.isnull("new"), "removed").when(F.col("old") != F.col("new"), "changed")
    return x.join(y, list(keys), "full_outer").withColumn("change", kind).where("change is not null").select(*keys, "change")


CRITICAL_PATHS = r"(?i)(settings(\.local)?\.json|hooks?/|\.mcp\.json|agents?\.md|skill\.md|\.env$|doc-\d*[05]$)"


def drift(baseline: DataFrame, current: DataFrame, critical: str = CRITICAL_PATHS) -> DataFrame:
    """Drift of the critical paths only, with severities."""
    part = lambda df: df.where(F.col("path").rlike(critical))
    return tree_diff(part(baseline), part(current)).withColumn("severity", F.when(F.col("change") == "changed", "critical").otherwise("high"))


def changed_items(prev: DataFrame, cur: DataFrame, item: str = "repo") -> DataFrame:
    """Items whose map of paths to hashes differs; only items of the current snapshot."""
    both = tree_diff(prev, cur, (item, "path"))
    return both.select(item).distinct().join(cur.select(item).distinct(), item, "left_semi")


def common_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """H4."""
    return a.select("repo", "path").intersect(b.select("repo", "path"))


def tree_hash(files: DataFrame) -> DataFrame:
    """Per repo a digest of its paths and hashes in path order.

    Two levels keep a repo with a third of all files off one task: digests of the
    4096 ranges of the path's hash, then the digest of those in order.
    """
    part = F.substring(F.sha2("path", 256), 1, 3)
    line = F.concat_ws(":", "path", "sha256")
    parts = files.groupBy("repo", part.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("d"))
    return parts.groupBy("repo").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "d"))), "\n"), 256).alias("tree_hash"))


def digest(df: DataFrame, cols: list[str]) -> DataFrame:
    """One digest of a rule table: the digests of its rows, sorted."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)
    return df.select(row.alias("h")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("digest"))


def record_history(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to append: those whose key the store does not hold yet."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def identity_anomalies(commits: DataFrame, most: int = 2) -> DataFrame:
    """E-mail addresses with more than ``most`` author names."""
    return commits.groupBy("repo", "email").agg(F.count_distinct("author").alias("names")).where(F.col("names") > most)


def commit_anomalies(commits: DataFrame, now) -> DataFrame:
    """Commits from the future, committed long after or before they were written, or with a bad signature."""
    day = 86_400
    lag = F.unix_timestamp("commit_ts") - F.unix_timestamp("author_ts")
    ahead = F.unix_timestamp("author_ts") - F.unix_timestamp(F.lit(now).cast("timestamp"))
    kinds = F.array(
        F.when(ahead > day, F.lit("future-commit:high")), F.when(lag > 30 * day, F.lit("late-commit:medium")), F.when(lag < 0, F.lit("negative-lag:high")),
        F.when(F.col("sig").isin("B", "R"), F.lit("bad-signature:high")),
    )
    out = commits.withColumn("k", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
    return out.select("repo", "hash", F.split_part("k", F.lit(":"), F.lit(1)).alias("category"), F.split_part("k", F.lit(":"), F.lit(2)).alias("severity"))


def latest_commits(commits: DataFrame, most: int = 1000) -> DataFrame:
    """The latest commits of each repo."""
    w = Window.partitionBy("repo").orderBy(F.desc("author_ts"), "hash")
    return commits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def parse_commits(lines: DataFrame) -> DataFrame:
    """Commit-log lines: hash, author, e-mail, two ISO times and the signature mark, parted by NUL."""
    p = F.split("text", "\x00")
    return lines.where(F.size(p) == 6).select("repo", p[0].alias("hash"), p[1].alias("author"), p[2].alias("email"), p[3].try_cast("timestamp").alias("author_ts"), p[4].try_cast("timestamp").alias("commit_ts"), p[5].alias("sig"))


def evidence_status(events: DataFrame, now) -> DataFrame:
    """K5: the latest evidence of each key(kind, key, ts, ttl seconds): FRESH, STALE when expired, RECHECK_REQUIRED for expired anchors."""
    last = events.groupBy("kind", "key").agg(F.max_by(F.struct("ts", "ttl", "state"), F.struct("ts", "state")).alias("e"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("e.ts")
    status = F.when(age <= F.col("e.ttl"), "FRESH").when(F.col("kind") == "anchor", "RECHECK_REQUIRED").otherwise("STALE")
    return last.select("kind", "key", "e.state", status.alias("status"))


def reuse_verdicts(new: DataFrame, cache: DataFrame, now, ttl: int = 86_400) -> DataFrame:
    """K6: cached definite verdicts within the time to live stand in for new ones; 'not-checked' is never reused. cache has one row per key."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("cached_at")
    good = cache.where(F.col("verdict").isin("claimable", "live") & (age >= 0) & (age < ttl)).groupBy("key").agg(F.max_by("verdict", "cached_at").alias("cached"))
    return new.join(good, "key", "left").select("key", F.coalesce("cached", "verdict").alias("verdict"), F.col("cached").isNotNull().alias("from_cache"))


def version_floor(versions: DataFrame) -> DataFrame:
    """K7: offered versions in order of time, accepted when not below the highest so far."""
    w = Window.partitionBy("pack").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return versions.withColumn("floor", F.max("version").over(w)).withColumn("accepted", F.coalesce(F.col("version") >= F.col("floor"), F.lit(True)))


def feed_status(runs: DataFrame, now, days: int = 7, skew: int = 300) -> DataFrame:
    """K8: per feed fresh, stale, future-dated or never, by its latest success. runs(feed, ts, ok)."""
    last = runs.groupBy("feed").agg(F.max(F.when(F.col("ok"), F.col("ts"))).alias("last"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last")
    return last.select("feed", F.when(F.isnull("last"), "never").when(age < -skew, "future").when(age > days * 86_400, "stale").otherwise("fresh").alias("status"))


def retry_queue(gaps: DataFrame, attestations: DataFrame) -> DataFrame:
    """K9: queued gaps(item, reason, queued_at), completed by a later attestation(item, ts)."""
    done = attestations.groupBy("item").agg(F.max("ts").alias("done_at"))
    return gaps.join(done, "item", "left").select("item", "reason", "queued_at", F.coalesce(F.col("done_at") > F.col("queued_at"), F.lit(False)).alias("completed"))
