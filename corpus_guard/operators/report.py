"""From findings to a report: normalising, suppressions, summaries, verdicts, coverage, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_guard.functions.scalars import default_confidence, severity_score, verdict_tier
from corpus_guard.operators.lines import glob_to_regex
from corpus_guard.schema import FINDING, SEVERITY


def normalize_findings(df: DataFrame) -> DataFrame:
    """Missing text becomes '', a bad or missing line 0, severity lower case, a missing, zero or NaN confidence the default of its severity, others clamped to [0, 1]."""
    conf = F.col("confidence").try_cast("double")
    sev = F.lower(F.coalesce("severity", F.lit("")))
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("repo", "scanner", "title", "description", "file", "snippet", "category", "rule_id")]
    return df.select(
        *text, sev.alias("severity"), F.greatest(F.lit(0), F.coalesce(F.col("line").try_cast("int"), F.lit(0))).alias("line"),
        F.when(conf.isNull() | F.isnan(conf) | (conf == 0), default_confidence(sev)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))).alias("confidence"),
    )


def findings_from_json(df: DataFrame, col: str = "payload") -> DataFrame:
    """Findings of a JSON array column; malformed payloads and elements are skipped."""
    from pyspark.sql import types as T

    return df.select(F.explode(F.from_json(col, T.ArrayType(FINDING))).alias("f")).select("f.*").where("title is not null")


def union_findings(*dfs: DataFrame) -> DataFrame:
    """H1."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def filter_domain(findings: DataFrame, scanners: DataFrame) -> DataFrame:
    """Findings of the scanners of a domain."""
    return findings.join(F.broadcast(scanners), "scanner", "left_semi")


def dedupe_findings(findings: DataFrame, order: list) -> DataFrame:
    """the first finding by finding_id, else by scanner, file and line."""
    key = F.coalesce(F.col("finding_id"), F.concat_ws(":", "scanner", "file", F.col("line").cast("string")))
    return findings.withColumn("_key", key).withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).where("_rn = 1").drop("_rn", "_key")


def apply_suppressions(findings: DataFrame, suppressions: DataFrame, now: float) -> DataFrame:
    """Adds suppressed. suppressions(rule_id, glob, structured, expiry, content_hash) is a small table; findings need file_hash for structured ones."""
    s = F.broadcast(suppressions.withColumn("glob_re", glob_to_regex("glob")).withColumnRenamed("rule_id", "s_rule"))
    hit = (F.col("rule_id") == F.col("s_rule")) & (F.isnull("glob") | F.expr("file rlike glob_re"))
    live = ~F.col("structured") | ((F.isnull("expiry") | (F.col("expiry") > now)) & (F.isnull("content_hash") | (F.col("content_hash") == F.col("file_hash"))))
    keyed = findings.withColumn("_id", F.xxhash64(*[F.col(c) for c in ("repo", "file", "line", "rule_id")]))
    marks = keyed.join(s, hit & live, "left_semi").withColumn("suppressed", F.lit(True))
    return marks.unionByName(keyed.join(s, hit & live, "left_anti").withColumn("suppressed", F.lit(False))).drop("_id")


def suppression_guards(findings: DataFrame, suppressions: DataFrame, most: int = 5) -> DataFrame:
    """A critical finding suppressed, over ``most`` suppressed in a repo, and suppressions that match nothing. ``findings`` has suppressed."""
    hit = findings.where("suppressed")
    critical = hit.where("severity = 'critical'").select("repo", "rule_id").distinct().select("repo", F.lit("critical").alias("severity"), F.concat(F.lit("critical rule suppressed: "), "rule_id").alias("title"))
    many = hit.groupBy("repo").count().where(F.col("count") > most).select("repo", F.lit("high").alias("severity"), F.concat(F.lit("suppressed findings: "), F.col("count").cast("string")).alias("title"))
    unused = suppressions.join(hit.select("rule_id").distinct(), "rule_id", "left_anti").select(F.lit("").alias("repo"), F.lit("high").alias("severity"), F.concat(F.lit("unused suppression: "), "rule_id").alias("title"))
    return union_findings(critical, many, unused)


def summarize(findings: DataFrame, keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Counts by severity and in total; unknown severities count in the total only."""
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY], F.count("*").alias("total"))


def verdicts(findings: DataFrame, keys: tuple[str, ...] = ("repo",)) -> DataFrame:
    """Counts by confidence tier of active findings, and of suppressed ones."""
    tier = verdict_tier("confidence")
    on = ~F.col("suppressed")
    return findings.groupBy(*keys).agg(
        *[F.count_if(on & (tier == t)).alias(t) for t in ("block", "warn", "info", "noise")], F.count_if("suppressed").alias("suppressed")
    )


def exit_code(failed: Column) -> Column:
    """99 if a scanner failed, else 2, 1 or 0 by the worst severity."""
    return F.when(failed, 99).when(F.col("critical") > 0, 2).when((F.col("high") > 0) | (F.col("medium") > 0), 1).otherwise(0)


def core_verdict(code: Column) -> Column:
    """E5."""
    return F.when(code == 99, "block").when(code == 2, "block").when(code == 1, "warn").otherwise("clean")


GAPS = ("scan-incomplete", "scanner-timeout", "oversize-skipped", "decode-budget", "archive-limit")


def coverage(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Per scanner COMPLETE, INCOMPLETE or UNSUPPORTED, its reasons, and the worst of all. runs(scanner, exit_code)."""
    rank = F.when(F.col("category").startswith("unsupported"), 2).when(F.col("category").isin(*GAPS) | F.col("category").endswith("-truncated"), 1).otherwise(0)
    found = findings.withColumn("rank", rank).where("rank > 0").groupBy("scanner").agg(F.max("rank").alias("r"), F.array_sort(F.collect_set("category")).alias("reasons"))
    joined = runs.join(found, "scanner", "left").withColumn("rank", F.greatest(F.coalesce("r", F.lit(0)), F.when(F.col("exit_code") > 2, 1).otherwise(0)))
    overall = joined.agg(F.max("rank").alias("worst"))
    name = lambda c: F.element_at(F.array(*map(F.lit, ("COMPLETE", "INCOMPLETE", "UNSUPPORTED"))), F.col(c) + 1)
    return joined.crossJoin(F.broadcast(overall)).select("scanner", name("rank").alias("status"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"), name("worst").alias("overall"))


def enrichment(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Distinct capability gaps and ok < degraded < offline. runs(capability, state)."""
    rank = F.when(F.col("state") == "offline", 2).when(F.col("state") == "degraded", 1).otherwise(0)
    worst = runs.agg(F.max(rank).alias("r")).select(F.element_at(F.array(*map(F.lit, ("ok", "degraded", "offline"))), F.col("r") + 1).alias("status"))
    gaps = findings.where(F.col("category").endswith("-gap")).select("category").distinct().agg(F.array_sort(F.collect_list("category")).alias("gaps"))
    return worst.crossJoin(gaps)


def budget_gate(counts: DataFrame, budgets: DataFrame) -> DataFrame:
    """(item, severity) over budget; a missing budget is 0. counts are findings with item and severity."""
    n = counts.groupBy("item", "severity").agg(F.count("*").alias("n"))
    return n.join(budgets, ["item", "severity"], "left").withColumn("budget", F.coalesce("budget", F.lit(0))).where("n > budget")


def joint_error(cases: DataFrame) -> DataFrame:
    """Two reviewers against the truth: single and joint error rates. cases(truth, a, b) booleans."""
    wrong_a, wrong_b = F.col("a") != F.col("truth"), F.col("b") != F.col("truth")
    return cases.agg(F.count("*").alias("n"), F.count_if(wrong_a).alias("wrong_a"), F.count_if(wrong_b).alias("wrong_b"), F.count_if(wrong_a & wrong_b).alias("wrong_both"))


def order_by_severity(findings: DataFrame, *then) -> DataFrame:
    """G1."""
    return findings.orderBy(severity_score("severity").desc(), *then)


def cap_findings(findings: DataFrame, per: int, total: int, *order) -> DataFrame:
    """At most ``per`` findings of a severity and ``total`` in all, worst first. The ranks of a severity are a top-k, so no task holds all rows."""
    best = None
    for s in SEVERITY:
        part = findings.where(F.col("severity") == s).orderBy(*order).limit(per)
        best = part if best is None else best.unionByName(part)
    return best.orderBy(severity_score("severity").desc(), *order).limit(total)


def review_queue(findings: DataFrame, cap: int = 5) -> DataFrame:
    """The first ``cap`` warn-tier findings that are not compound, by falling confidence and title, with the number left over."""
    warn = findings.where((verdict_tier("confidence") == "warn") & (F.col("scanner") != "correlation"))
    overflow = warn.agg(F.greatest(F.count("*") - cap, F.lit(0)).alias("overflow"))
    return warn.orderBy(F.desc("confidence"), "title", "file", "line", "rule_id").limit(cap).crossJoin(overflow)


def top_actions(findings: DataFrame, n: int = 5) -> DataFrame:
    """G4."""
    return findings.orderBy(severity_score("severity").desc(), "title", "file", "line", "rule_id").limit(n)


def risk_themes(findings: DataFrame) -> DataFrame:
    """Distinct themes in first-seen order."""
    return findings.groupBy("theme").agg(F.min("ord").alias("first_seen")).orderBy("first_seen", "theme")


def cross_tool_rules(rules: DataFrame, detected: DataFrame) -> DataFrame:
    """Rules whose required keys are all present and whose forbidden keys are all absent. rules(rule, key, required), detected(key)."""
    found = rules.join(detected.select("key").distinct().withColumn("there", F.lit(True)), "key", "left")
    ok = F.bool_and(F.coalesce("there", F.lit(False)) == F.col("required"))
    return found.groupBy("rule").agg(ok.alias("fires")).where("fires").select("rule")


def ungrounded(cited: DataFrame, findings: DataFrame, inventory: DataFrame) -> DataFrame:
    """cited(ref) that name neither a finding id nor an inventory path."""
    return cited.join(findings.select(F.col("rule_id").alias("ref")).distinct(), "ref", "left_anti").join(inventory.select(F.col("path").alias("ref")).distinct(), "ref", "left_anti")


def omitted(findings: DataFrame, reported: DataFrame) -> DataFrame:
    """Critical and high findings that are missing from the reported ones."""
    return findings.where(F.col("severity").isin("critical", "high")).join(reported.select("repo", "file", "line", "rule_id").distinct(), ["repo", "file", "line", "rule_id"], "left_anti")
