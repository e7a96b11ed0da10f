"""Queries of snapshots, commits and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_guard.operators import history as H
from corpus_guard.operators import rules as R
from corpus_guard.plans.views import oracle, table, view
from corpus_guard.registry import register

_DIFF = "SELECT repo, path, CASE WHEN a.sha256 IS NULL THEN 'added' WHEN b.sha256 IS NULL THEN 'removed' ELSE 'changed' END AS change FROM snap_a a FULL JOIN snap_b b USING (repo, path) WHERE a.sha256 IS DISTINCT FROM b.sha256"


@register("d21_tree_diff", oracle(_DIFF, "snap_a", "snap_b"))
def tree_diff(spark, d):
    return H.tree_diff(view(spark, d, "snap_a"), view(spark, d, "snap_b"))


@register("d20_drift", oracle(f"SELECT *, CASE WHEN change = 'changed' THEN 'critical' ELSE 'high' END AS severity FROM ({_DIFF}) WHERE regexp_matches(path, '{H.CRITICAL_PATHS}')", "snap_a", "snap_b"))
def drift(spark, d):
    return H.drift(view(spark, d, "snap_a"), view(spark, d, "snap_b"))


@register("d22_changed_items", oracle(f"SELECT DISTINCT repo FROM ({_DIFF}) WHERE repo IN (SELECT repo FROM snap_b)", "snap_a", "snap_b"))
def changed(spark, d):
    return H.changed_items(view(spark, d, "snap_a"), view(spark, d, "snap_b"))


@register("h04_common_keys", oracle("SELECT repo, path FROM snap_a INTERSECT SELECT repo, path FROM snap_b", "snap_a", "snap_b"))
def common(spark, d):
    return H.common_keys(view(spark, d, "snap_a"), view(spark, d, "snap_b"))


@register(
    "e08_tree_hash",
    oracle(
        """, p AS (SELECT repo, substring(sha256(path), 1, 3) AS part, sha256(string_agg(path || ':' || sha256, chr(10) ORDER BY path || ':' || sha256)) AS d FROM snap_a GROUP BY ALL)
SELECT repo, sha256(string_agg(part || ':' || d, chr(10) ORDER BY part || ':' || d)) AS tree_hash FROM p GROUP BY repo""".replace("sha256(path)", "sha256(path)"),
        "snap_a",
    ),
)
def tree_hash(spark, d):
    return H.tree_hash(view(spark, d, "snap_a"))


@register("e09_digest", "SELECT sha256(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT sha256(CAST(p_partkey AS VARCHAR) || chr(31) || coalesce(p_brand, '') || chr(31) || coalesce(p_type, '')) AS h FROM part)")
def digest(spark, d):
    return H.digest(table(spark, d, "part"), ["p_partkey", "p_brand", "p_type"])


@register("a24_history_sink", oracle("SELECT repo, path, sha256 FROM snap_b WHERE (repo, path) NOT IN (SELECT repo, path FROM snap_a)", "snap_a", "snap_b"))
def sink(spark, d):
    return H.record_history(view(spark, d, "snap_b"), view(spark, d, "snap_a"), ["repo", "path"])


@register("e10_identities", oracle("SELECT repo, email, count(DISTINCT author) AS names FROM commits_v GROUP BY ALL HAVING names > 2", "commits_v"))
def identities(spark, d):
    return H.identity_anomalies(view(spark, d, "commits_v"))


@register(
    "e11_commit_anomalies",
    oracle(
        """, n AS (SELECT min(author_ts) + INTERVAL 20 DAY AS t FROM commits_v), l AS (SELECT *, floor(epoch(commit_ts)) - floor(epoch(author_ts)) AS lag_, floor(epoch(author_ts)) - floor(epoch(t)) AS ahead FROM commits_v, n)
SELECT repo, hash, 'future-commit' AS category, 'high' AS severity FROM l WHERE ahead > 86400 UNION ALL SELECT repo, hash, 'late-commit', 'medium' FROM l WHERE lag_ > 30 * 86400
UNION ALL SELECT repo, hash, 'negative-lag', 'high' FROM l WHERE lag_ < 0 UNION ALL SELECT repo, hash, 'bad-signature', 'high' FROM l WHERE sig IN ('B', 'R')""",
        "commits_v",
    ),
)
def commits(spark, d):
    c = view(spark, d, "commits_v")
    now = c.agg((F.min("author_ts") + F.expr("interval 20 days")).alias("t")).first()[0]
    return H.commit_anomalies(c, now)


@register("a20_latest_commits", oracle("SELECT repo, hash, author, email, author_ts, commit_ts, sig FROM commits_v QUALIFY row_number() OVER (PARTITION BY repo ORDER BY author_ts DESC, hash) <= 1000", "commits_v"))
def latest(spark, d):
    """Written as log lines, parsed again, and the latest kept."""
    c = view(spark, d, "commits_v")
    log = c.select("repo", F.concat_ws("\x00", "hash", "author", "email", F.col("author_ts").cast("string"), F.col("commit_ts").cast("string"), "sig").alias("text"))
    return H.latest_commits(H.parse_commits(log))


_EVID = "SELECT CASE WHEN event_id % 3 = 0 THEN 'anchor' ELSE 'feed' END AS kind, CAST(user_id AS VARCHAR) AS key, ts, 86400.0 * (1 + event_id % 5) AS ttl, event_type AS state, event_id FROM events"


EVIDENCE_SQL = f"""WITH e AS ({_EVID}), n AS (SELECT max(ts) AS t FROM e), l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY ts DESC, state DESC) = 1)
SELECT kind, key, state, CASE WHEN floor(epoch(t)) - floor(epoch(ts)) <= ttl THEN 'FRESH' WHEN kind = 'anchor' THEN 'RECHECK_REQUIRED' ELSE 'STALE' END AS status FROM l, n"""


def evidence_events(events):
    k = F.col("event_id")
    return events.select(F.when(k % 3 == 0, "anchor").otherwise("feed").alias("kind"), F.col("user_id").cast("string").alias("key"), "ts", (86400.0 * (k % 5 + 1)).alias("ttl"), F.col("event_type").alias("state"))


@register("k05_evidence_status", EVIDENCE_SQL)
def evidence(spark, d):
    e = evidence_events(table(spark, d, "events"))
    return H.evidence_status(e, e.agg(F.max("ts")).first()[0])


@register(
    "k06_verdict_cache",
    """WITH n AS (SELECT max(ts) AS t FROM events), e AS (SELECT CAST(user_id AS VARCHAR) AS key, CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'claimable' WHEN 1 THEN 'live' ELSE 'not-checked' END AS verdict, ts FROM events),
g AS (SELECT key, arg_max(verdict, ts) AS cached FROM e, n WHERE verdict <> 'not-checked' AND floor(epoch(t)) - floor(epoch(ts)) BETWEEN 0 AND 86399 GROUP BY key)
SELECT key, coalesce(cached, 'not-checked') AS verdict, cached IS NOT NULL AS from_cache FROM (SELECT DISTINCT key FROM e) LEFT JOIN g USING (key)""",
)
def cache(spark, d):
    e = table(spark, d, "events")
    key = F.col("user_id").cast("string").alias("key")
    k = F.col("event_id") % 3
    cached = e.select(key, F.when(k == 0, "claimable").when(k == 1, "live").otherwise("not-checked").alias("verdict"), F.col("ts").alias("cached_at"))
    return H.reuse_verdicts(e.select(key).distinct().withColumn("verdict", F.lit("not-checked")), cached, e.agg(F.max("ts")).first()[0])


@register(
    "k07_version_floor",
    """SELECT pack, ts, seq, version, floor, coalesce(version >= floor, true) AS accepted FROM (SELECT event_type AS pack, ts, event_id AS seq, CAST(floor(value) AS BIGINT) AS version,
  max(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM events)""",
)
def floor(spark, d):
    return H.version_floor(table(spark, d, "events").select(F.col("event_type").alias("pack"), "ts", F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("version")))


@register(
    "k08_feed_status",
    """WITH n AS (SELECT max(ts) AS t FROM events), l AS (SELECT CAST(user_id AS VARCHAR) AS feed, max(ts) FILTER (event_type = 'purchase') AS last FROM events GROUP BY 1)
SELECT feed, CASE WHEN last IS NULL THEN 'never' WHEN floor(epoch(t)) - floor(epoch(last)) < -300 THEN 'future' WHEN floor(epoch(t)) - floor(epoch(last)) > 604800 THEN 'stale' ELSE 'fresh' END AS status FROM l, n""",
)
def feeds(spark, d):
    e = table(spark, d, "events")
    return H.feed_status(e.select(F.col("user_id").cast("string").alias("feed"), "ts", (F.col("event_type") == "purchase").alias("ok")), e.agg(F.max("ts")).first()[0])


@register(
    "k09_retry_queue",
    """WITH a AS (SELECT user_id AS item, max(ts) AS done_at FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT user_id AS item, event_type AS reason, ts AS queued_at, coalesce(done_at > ts, false) AS completed FROM events LEFT JOIN a ON item = user_id WHERE event_type = 'click'""",
)
def retries(spark, d):
    e = table(spark, d, "events")
    gaps = e.where("event_type = 'click'").select(F.col("user_id").alias("item"), F.col("event_type").alias("reason"), F.col("ts").alias("queued_at"))
    return H.retry_queue(gaps, e.where("event_type = 'purchase'").select(F.col("user_id").alias("item"), "ts"))


@register(
    "a05_accept_rules",
    """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS pack, CAST(event_id AS INT) AS pack_version, CASE WHEN event_id % 10 = 0 THEN '2.0' ELSE '1.1' END AS schema_version, CAST(ts AS DATE) AS generated, event_type AS digest FROM events),
f AS (SELECT CAST(user_id AS VARCHAR) AS pack, CAST(min(event_id) + 20 AS INT) AS floor_version, 'view' AS floor_digest FROM events GROUP BY 1), t AS (SELECT CAST(min(ts) AS DATE) + 10 AS t FROM events),
r AS (SELECT n.pack, pack_version, CASE WHEN schema_version = '2.0' THEN 'schema' WHEN date_diff('day', generated, t) > 30 THEN 'stale' WHEN date_diff('day', generated, t) < -1 THEN 'future' WHEN pack_version < floor_version THEN 'rollback'
  WHEN pack_version = floor_version AND digest <> floor_digest THEN 'digest' END AS reason FROM n JOIN f ON f.pack = n.pack, t)
SELECT pack, pack_version, reason IS NULL AS accepted, coalesce(reason, '') AS reason FROM r""",
)
def accept(spark, d):
    e = table(spark, d, "events")
    pack = F.col("user_id").cast("string").alias("pack")
    new = e.select(pack, F.col("event_id").cast("int").alias("pack_version"), F.when(F.col("event_id") % 10 == 0, "2.0").otherwise("1.1").alias("schema_version"), F.col("ts").cast("date").alias("generated"), F.col("event_type").alias("digest"))
    low = e.groupBy(pack).agg((F.min("event_id") + 20).cast("int").alias("floor_version")).withColumn("floor_digest", F.lit("view"))
    return R.accept_rules(new, low, e.agg(F.date_add(F.min("ts").cast("date"), 10)).first()[0])


@register(
    "a04_overlay_rules",
    """WITH b AS (SELECT 'p' || CAST(p_partkey % 20 AS VARCHAR) AS pack, CAST(1 + p_partkey % 20 % 4 AS INT) AS pack_version, p_name AS id FROM part), u AS (SELECT 'p' || CAST(s_suppkey % 15 AS VARCHAR) AS pack, CAST(1 + s_suppkey % 15 % 5 AS INT) AS pack_version, s_name AS id FROM supplier),
a AS (SELECT *, 1 AS shipped FROM b UNION ALL SELECT *, 0 FROM u)
SELECT pack, pack_version, id FROM a QUALIFY dense_rank() OVER (PARTITION BY pack ORDER BY pack_version DESC, shipped DESC) = 1""",
)
def overlay(spark, d):
    part, supp = table(spark, d, "part"), table(spark, d, "supplier")
    k, s = F.col("p_partkey") % 20, F.col("s_suppkey") % 15
    base = part.select(F.concat(F.lit("p"), k.cast("string")).alias("pack"), (k % 4 + 1).cast("int").alias("pack_version"), F.col("p_name").alias("id"))
    new = supp.select(F.concat(F.lit("p"), s.cast("string")).alias("pack"), (s % 5 + 1).cast("int").alias("pack_version"), F.col("s_name").alias("id"))
    return R.overlay_rules(base, new)


@register("f09_rule_ids", "SELECT event_id, upper(event_type) || '-' || upper(CAST(user_id % 3 AS VARCHAR)) || '-' || lpad(CAST(row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY user_id, event_id) AS VARCHAR), 3, '0') AS new_id FROM events WHERE event_id < 500")
def rule_ids(spark, d):
    e = table(spark, d, "events").where("event_id < 500")
    r = e.select("event_id", F.col("event_type").alias("scanner"), (F.col("user_id") % 3).cast("string").alias("category"), F.col("user_id").alias("tbl"), F.col("event_id").alias("idx"))
    return R.assign_rule_ids(r).select("event_id", "new_id")
