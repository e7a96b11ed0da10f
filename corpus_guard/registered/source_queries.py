"""Queries of file sources: the part table and the findings of a scan written in a source's format, at most a thousand entries a file, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpus_guard.detectors.rule_sets import ENVIRONMENT
from corpus_guard.operators.report import findings_from_json
from corpus_guard.operators.rules import load_rules, run_scan, scan_oracle
from corpus_guard.plans.staging import shared_dir
from corpus_guard.plans.views import oracle, table, view
from corpus_guard.registry import register
from corpus_guard.schema import CONFIDENCE
from corpus_guard.sources import manifests as M


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"


def _documents(spark, d: str, name: str, entry, document) -> str:
    """One JSON document for each thousand parts: ``document(list of entries, group)``; returns the folder."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.coalesce("p_name", F.lit("")).alias("name"))
    grouped = part.withColumn("grp", F.expr("k div 1000")).withColumn("e", entry).groupBy("grp").agg(F.collect_list("e").alias("es"))
    path = _folder(spark, name)
    grouped.select("grp", F.to_json(document(F.col("es"), F.concat(F.lit("g"), F.col("grp").cast("string")))).alias("value")).write.partitionBy("grp").text(path)
    return path


def _text(c):
    return c.cast("string")


def _key() -> tuple:
    """The number of a part, and the name of its package."""
    k = F.col("k")
    return k, F.concat(F.lit("pkg-"), _text(k))


@register(
    "a06_compromised_feed",
    "SELECT 'g' || (p_partkey // 1000) AS campaign, 'npm' AS ecosystem, 'pkg-' || p_partkey AS package, v AS version, v = '*' AS wildcard FROM part, unnest(CASE WHEN p_partkey % 10 = 0 THEN [(p_partkey % 7) || '.0', '*'] ELSE [(p_partkey % 7) || '.0'] END) t(v)",
)
def compromised(spark, d):
    k, package = _key()
    version = F.concat(_text(k % 7), F.lit(".0"))
    entry = F.struct(package.alias("key"), F.when(k % 10 == 0, F.array(version, F.lit("*"))).otherwise(F.array(version)).alias("value"))
    doc = lambda es, grp: F.struct(F.create_map(grp, F.struct(F.concat(F.lit("Campaign "), grp).alias("title"), F.lit("npm").alias("ecosystem"), F.map_from_entries(es).alias("packages"))).alias("campaigns"))
    return M.load_compromised(spark, _documents(spark, d, "campaigns", entry, doc))


@register("a09_exploited_feed", "SELECT DISTINCT 'CVE-2024-' || (1000 + p_partkey) AS cve FROM part WHERE p_partkey % 11 <> 0")
def exploited(spark, d):
    k, package = _key()
    entry = F.struct(F.when(k % 11 == 0, "bad").otherwise(F.concat(F.lit("cve-2024-"), _text(1000 + k))).alias("cveID"))
    return M.load_kev(spark, _documents(spark, d, "exploited", entry, lambda es, grp: F.struct(es.alias("vulnerabilities"))))


@register(
    "a10_advisory_feed",
    "SELECT 'npm' AS ecosystem, 'pkg-' || p_partkey AS package, 'ADV-' || p_partkey AS id, 'CVE-2023-' || (1000 + p_partkey) AS aliases, coalesce(p_name, '') AS summary, CAST((p_partkey % 100) / 10.0 AS DOUBLE) AS cvss, '1.' || (p_partkey % 9) || ',2.0' AS fixed_in FROM part",
)
def advisories(spark, d):
    k, package = _key()
    fixed = lambda x: F.struct(F.lit(None).cast("string").alias("introduced"), x.alias("fixed"))
    events = F.array(F.struct(F.lit("0").alias("introduced"), F.lit(None).cast("string").alias("fixed")), fixed(F.concat(F.lit("1."), _text(k % 9))), fixed(F.lit("2.0")), fixed(F.lit("2.0")))
    entry = F.struct(
        F.concat(F.lit("ADV-"), _text(k)).alias("id"), F.array(F.concat(F.lit("CVE-2023-"), _text(1000 + k))).alias("aliases"), F.col("name").alias("summary"),
        F.array(F.struct(F.lit("V3").alias("type"), _text((k % 100) / 10).alias("score"))).alias("severity"),
        F.array(F.struct(F.struct(F.lit("npm").alias("ecosystem"), package.alias("name")).alias("package"), F.array(F.struct(events.alias("events"))).alias("ranges"))).alias("affected"),
    )
    found = M.load_advisories(spark, _documents(spark, d, "advisories", entry, lambda es, grp: F.struct(es.alias("vulns"))))
    return found.withColumns({"aliases": F.array_join("aliases", ","), "fixed_in": F.array_join("fixed_in", ",")})


@register(
    "a26_release_documents",
    "SELECT 'pkg-' || p_partkey AS package, v AS version, TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 300 AS INTEGER)) AS published, CASE WHEN v = '1.0' THEN 'm' || (p_partkey % 5) END AS maintainer FROM part, (VALUES ('1.0'), ('1.1')) t(v)",
)
def release_documents(spark, d):
    k, package = _key()
    day = F.concat(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 300).cast("int")), "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    times = F.create_map(F.lit("created"), F.lit("x"), F.lit("1.0"), day, F.lit("1.1"), day)
    entry = F.struct(package.alias("name"), times.alias("time"), F.create_map(F.lit("1.0"), F.struct(F.concat(F.lit("m"), _text(k % 5)).alias("maintainer"))).alias("versions"))
    return M.load_releases(spark, _documents(spark, d, "releases", entry, lambda es, grp: es)).withColumn("published", F.col("published").cast("timestamp_ntz"))


_SEVERITIES = ("critical", "high", "medium", "low", "odd")
_DEFAULT = " ".join(f"WHEN '{s}' THEN {c}" for s, c in CONFIDENCE.items())


@register(
    "a03_rule_packs",
    f"""WITH r AS (SELECT p_partkey AS k, ['critical', 'high', 'medium', 'low', 'odd'][CAST(p_partkey % 5 AS INT) + 1] AS severity FROM part WHERE p_partkey % 13 <> 0 AND p_partkey % 17 <> 0)
SELECT 'g' || (k // 1000) AS pack, 'R-' || k AS id, severity, CAST(CASE WHEN k % 3 = 0 THEN 1.0 ELSE CASE severity {_DEFAULT} ELSE 0.4 END END AS DOUBLE) AS confidence FROM r""",
)
def rule_packs(spark, d):
    """A3: every thirteenth rule retired, every seventeenth without its pattern, every third with a confidence beyond 1."""
    k, _ = _key()
    entry = F.struct(
        F.concat(F.lit("R-"), _text(k)).alias("id"), F.lit("regex").alias("type"), F.when(k % 17 != 0, F.concat(F.lit("x"), _text(k))).alias("pattern"), F.lit("a rule").alias("title"),
        F.element_at(F.array(*map(F.lit, _SEVERITIES)), (k % 5 + 1).cast("int")).alias("severity"), F.when(k % 3 == 0, 7.0).alias("confidence"), (k % 13 == 0).alias("retired"),
    )
    doc = lambda es, grp: F.struct(F.lit("1.0").alias("schema_version"), F.lit("2026-01-01").alias("generated"), grp.alias("pack"), F.lit(1).alias("pack_version"), es.alias("rules"))
    return load_rules(spark, _documents(spark, d, "packs", entry, doc)).select("pack", "id", "severity", "confidence")


_SCAN_SQL = oracle(scan_oracle(ENVIRONMENT), "files_v")


@register("a22_findings_in_and_out", _SCAN_SQL)
def findings_in_and_out(spark, d):
    """Findings written as JSON by repo and read back."""
    path = _folder(spark, "findings")
    M.write_findings(run_scan(view(spark, d, "files_v"), ENVIRONMENT), path, "json")
    return M.read_findings(spark, path)


@register("b10_findings_from_json", _SCAN_SQL)
def from_payloads(spark, d):
    """One payload for each finding, between payloads that are malformed."""
    found = run_scan(view(spark, d, "files_v"), ENVIRONMENT)
    good = found.select(F.to_json(F.array(F.struct(*found.columns))).alias("payload"))
    bad = found.select(F.concat(F.lit("[{"), F.col("title")).alias("payload"))
    return findings_from_json(good.unionByName(bad))
