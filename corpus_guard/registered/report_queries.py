"""Queries of correlation and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_guard.detectors.rule_sets import SCANS
from corpus_guard.detectors.union import PARSED, STRUCTURED, Inputs, detect, detect_oracle
from corpus_guard.functions.scalars import dotted_get, verdict_tier
from corpus_guard.operators import correlate as C
from corpus_guard.operators import report as R
from corpus_guard.operators.rules import audit_findings, audit_oracle, dedupe_line_category
from corpus_guard.plans.staging import stage
from corpus_guard.plans.views import dealt, even, oracle, table, view
from corpus_guard.registered.content_queries import ACTIONS, IOCS
from corpus_guard.registered.dep_queries import TRUSTED
from corpus_guard.registry import register
from corpus_guard.schema import SEVERITY

ALL = tuple(s for _, s in SCANS.values())


def findings(spark, d):
    """Findings of the rule scans."""
    return audit_findings(even(view(spark, d, "files_v")), ALL)


def staged(spark, d):
    """The same, scanned once for plans that read them more than once."""
    return stage(findings(spark, d), "findings")


FINDINGS_SQL = f", findings AS MATERIALIZED ({audit_oracle(ALL)})"


def found(sql: str) -> str:
    return oracle(FINDINGS_SQL + sql, "files_v")


#: A package that manifests name and that has just been released, beside the releases of releases_v.
NEW_PACKAGE = ("llm-agent-tools", "1.0.0", "newcomer")


def inputs(spark, d) -> Inputs:
    releases = view(spark, d, "releases_v")
    now = releases.agg(F.max("published")).first()[0]
    new = spark.range(1).select(F.lit(NEW_PACKAGE[0]).alias("package"), F.lit(NEW_PACKAGE[1]).alias("version"), F.lit(now).cast(releases.schema["published"].dataType).alias("published"), F.lit(NEW_PACKAGE[2]).alias("maintainer"))
    rows = lambda data, schema: spark.createDataFrame(list(data), schema)
    iocs = rows({(k, v) for k, v, _ in IOCS}, "kind string, value string")
    return Inputs(dealt(view(spark, d, "code_v")), view(spark, d, "deps_v"), releases.unionByName(new), rows([(t,) for t in TRUSTED], "host string"), iocs, rows(ACTIONS, "action string, ref string"), now=now)


def every_finding(spark, d):
    """H1: the rule scans and the structured detectors over all files, their seeded programs and settings, and the locked dependencies."""
    x = inputs(spark, d)
    return audit_findings(x.files, ALL).unionByName(detect(x, STRUCTURED))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rows)


EVERY_SQL = f""", feed_v AS (SELECT * FROM releases_v UNION ALL SELECT '{NEW_PACKAGE[0]}', '{NEW_PACKAGE[1]}', max(published), '{NEW_PACKAGE[2]}' FROM releases_v),
trusted(host) AS (VALUES {_values([(t,) for t in TRUSTED])}), iocs(kind, value) AS (SELECT DISTINCT * FROM (VALUES {_values([(k, v) for k, v, _ in IOCS])})), bad_actions(action, bad_ref) AS (VALUES {_values(ACTIONS)}),
findings AS MATERIALIZED ({audit_oracle(ALL, "code_v")} UNION ALL {detect_oracle()})"""


def every(sql: str) -> str:
    return oracle(EVERY_SQL + sql, "code_v", "deps_v", "releases_v")


@register("h01_union_findings", every(" SELECT * FROM findings"))
def union_findings(spark, d):
    return every_finding(spark, d)


def all_findings(spark, d):
    """H1: every_finding and the detectors that parse, decode, reassemble or measure."""
    x = inputs(spark, d)
    return audit_findings(x.files, ALL).unionByName(detect(x))


@register("h01_parser_findings")
def parser_findings(spark, d):
    """H1: the detectors that parse, decode or measure."""
    return detect(inputs(spark, d), PARSED)


@register("f04_first_line_category", found("SELECT DISTINCT repo, file, line, category, first_value(title) OVER (PARTITION BY repo, file, line, category ORDER BY rule_id, title) AS title FROM findings"))
def first_of_category(spark, d):
    return dedupe_line_category(findings(spark, d).withColumn("seq", F.struct("rule_id", "title"))).select("repo", "file", "line", "category", "title")


@register("i20_dotted_get", oracle("""SELECT path, json_extract_string(TRY_CAST(content AS JSON), '$.mcpServers.files.command') AS server, json_extract_string(TRY_CAST(content AS JSON), '$.scripts.postinstall') AS hook
FROM code_v WHERE ext = 'json'""", "code_v"))
def dotted(spark, d):
    return view(spark, d, "code_v").where("ext = 'json'").select("path", dotted_get("content", "mcpServers.files.command").alias("server"), dotted_get("content", "scripts.postinstall").alias("hook"))


@register("m_compound_findings", every(f", {C.correlate_oracle()} SELECT * FROM compound"))
def compound(spark, d):
    """M1-M41, E13, E14, B9, D23."""
    return C.correlate(stage(every_finding(spark, d), "findings"))


_SUM = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low"))
_TIER = "CASE WHEN confidence >= 0.92 THEN 'block' WHEN confidence >= 0.6 THEN 'warn' WHEN confidence >= 0.3 THEN 'info' ELSE 'noise' END"


def summarize(base):
    """E2-E5 over the findings and compound findings of each repo, in one aggregate."""
    both = base.unionByName(C.correlate(base))
    tier = verdict_tier("confidence")
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY] + [F.count("*").alias("total")] + [F.count_if(tier == t).alias(t) for t in ("block", "warn", "info")]
    code = R.exit_code(F.lit(False))
    return both.groupBy("repo").agg(*counts).withColumn("exit_code", code).withColumn("verdict", R.core_verdict(code))


def audit_summary(spark, d):
    """The flagship: the audit over all that SQL can express too."""
    return summarize(stage(every_finding(spark, d), "findings"))


@register("audit_everything")
def audit_everything(spark, d):
    """The audit over all detectors, those that parse, decode, reassemble, follow taint or measure included, and the compound rules over their union."""
    return summarize(stage(all_findings(spark, d), "findings"))


register(
    "audit_summary",
    every(
        f""", {C.correlate_oracle()}, every AS (SELECT * FROM findings UNION ALL BY NAME SELECT * FROM compound)
SELECT repo, {_SUM}, count(*) AS total, count(*) FILTER ({_TIER} = 'block') AS block, count(*) FILTER ({_TIER} = 'warn') AS warn, count(*) FILTER ({_TIER} = 'info') AS info,
  CASE WHEN critical > 0 THEN 2 WHEN high > 0 OR medium > 0 THEN 1 ELSE 0 END AS exit_code, CASE WHEN critical > 0 THEN 'block' WHEN high > 0 OR medium > 0 THEN 'warn' ELSE 'clean' END AS verdict
FROM every GROUP BY repo"""
    ),
)(audit_summary)

SUPPRESSIONS = (
    ("SAST-NET-001", None, False, None), ("CI-PIN-001", "src1*/doc-*", False, None), ("INS-PI-001", "*.md", True, 100.0), ("INS-CP-001", None, True, 1e12), ("NO-SUCH-001", None, False, None),
)


def _suppressions(spark):
    return spark.createDataFrame([(*s, None) for s in SUPPRESSIONS], "rule_id string, glob string, structured boolean, expiry double, content_hash string")


def _lit(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"{v!r}::DOUBLE"


_SUPP_SQL = f""", supp(rule_id, pat, structured, expiry) AS (VALUES {', '.join('(' + ', '.join(map(_lit, s)) + ')' for s in SUPPRESSIONS)}),
marked AS (SELECT f.*, EXISTS (SELECT 1 FROM supp s WHERE s.rule_id = f.rule_id AND (pat IS NULL OR regexp_matches(file, '^' || replace(replace(pat, '.', '\\.'), '*', '.*') || '$'))
  AND (NOT structured OR expiry IS NULL OR expiry > 1000)) AS suppressed FROM findings f)"""


def _marked(spark, d):
    return R.apply_suppressions(staged(spark, d).withColumn("file_hash", F.lit(None).cast("string")), _suppressions(spark), 1000.0).drop("file_hash")


@register("d13_suppressions", found(_SUPP_SQL + " SELECT * FROM marked"))
def suppressions(spark, d):
    return _marked(spark, d)


@register(
    "d14_suppression_guards",
    found(
        _SUPP_SQL
        + """ SELECT DISTINCT repo, 'critical' AS severity, 'critical rule suppressed: ' || rule_id AS title FROM marked WHERE suppressed AND severity = 'critical'
UNION ALL SELECT repo, 'high', 'suppressed findings: ' || count(*) FROM marked WHERE suppressed GROUP BY repo HAVING count(*) > 5
UNION ALL SELECT '', 'high', 'unused suppression: ' || rule_id FROM supp WHERE rule_id NOT IN (SELECT rule_id FROM marked WHERE suppressed)"""
    ),
)
def guards(spark, d):
    return R.suppression_guards(_marked(spark, d), _suppressions(spark))


@register("e03_verdicts", found(_SUPP_SQL + f" SELECT repo, {', '.join(f'''count(*) FILTER (NOT suppressed AND {_TIER} = '{t}') AS {t}''' for t in ('block', 'warn', 'info', 'noise'))}, count(*) FILTER (suppressed) AS suppressed FROM marked GROUP BY repo"))
def verdicts(spark, d):
    return R.verdicts(_marked(spark, d))


@register(
    "b08_normalize_findings",
    """
SELECT 'r' AS repo, event_type AS scanner, '' AS title, '' AS description, '' AS file, '' AS snippet, '' AS category, CAST(event_id AS VARCHAR) AS rule_id, lower(coalesce(sev, '')) AS severity,
  greatest(0, coalesce(TRY_CAST(ln AS INT), 0)) AS line, CASE WHEN c IS NULL OR isnan(c) OR c = 0 THEN CASE lower(coalesce(sev, '')) WHEN 'critical' THEN 0.95 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 ELSE 0.4 END ELSE greatest(0.0, least(1.0, c)) END::DOUBLE AS confidence
FROM (SELECT event_id, event_type, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'High' WHEN 2 THEN 'odd' END AS sev, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id % 50 - 10 AS VARCHAR) END AS ln,
  CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 0.0 WHEN 2 THEN 7.5 WHEN 3 THEN -1.0 WHEN 4 THEN 0.33 END AS c FROM events)""",
)
def normalize(spark, d):
    k = F.col("event_id")
    raw = table(spark, d, "events").select(
        F.lit("r").alias("repo"), F.col("event_type").alias("scanner"), *[F.lit(None).cast("string").alias(c) for c in ("title", "description", "file", "snippet", "category")],
        k.cast("string").alias("rule_id"), F.when(k % 4 == 0, "CRITICAL").when(k % 4 == 1, "High").when(k % 4 == 2, "odd").alias("severity"),
        F.when(k % 3 == 0, "x").otherwise((k % 50 - 10).cast("string")).alias("line"),
        F.when(k % 6 == 0, float("nan")).when(k % 6 == 1, 0.0).when(k % 6 == 2, 7.5).when(k % 6 == 3, -1.0).when(k % 6 == 4, 0.33).alias("confidence"),
    )
    return R.normalize_findings(raw)


@register("b17_domain_filter", found("SELECT * FROM findings WHERE scanner IN ('skill_threats', 'agent_skills')"))
def domain(spark, d):
    return R.filter_domain(findings(spark, d), spark.createDataFrame([("skill_threats",), ("agent_skills",)], "scanner string"))


@register(
    "f05_dedupe_findings",
    found("SELECT scanner, file, line, min(rule_id) AS rule_id FROM findings GROUP BY scanner, file, line"),
)
def dedupe(spark, d):
    f = findings(spark, d).withColumn("finding_id", F.lit(None).cast("string"))
    return R.dedupe_findings(f, ["rule_id"]).select("scanner", "file", "line", "rule_id")


_ORDER = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC"


@register("g01_severity_order", found(f"SELECT row_number() OVER (ORDER BY {_ORDER}, total DESC, repo) AS place, * EXCLUDE (total), total FROM (SELECT repo, severity, count(*) AS total FROM findings GROUP BY ALL)"))
def severity_order(spark, d):
    counts = findings(spark, d).groupBy("repo", "severity").agg(F.count("*").alias("total"))
    from pyspark.sql import Window

    from corpus_guard.functions.scalars import severity_score

    w = Window.orderBy(severity_score("severity").desc(), F.desc("total"), "repo")
    return R.order_by_severity(counts, F.desc("total"), "repo").withColumn("place", F.row_number().over(w)).select("place", "repo", "severity", "total")


@register(
    "g02_cap_findings",
    found(f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY repo, file, line, rule_id) AS rn FROM findings) WHERE rn <= 50 ORDER BY {_ORDER}, repo, file, line, rule_id LIMIT 200"),
)
def cap(spark, d):
    return R.cap_findings(staged(spark, d), 50, 200, "repo", "file", "line", "rule_id")


@register(
    "g03_review_queue",
    found(f", w AS (SELECT * FROM findings WHERE {_TIER} = 'warn') SELECT *, greatest((SELECT count(*) FROM w) - 5, 0) AS overflow FROM w ORDER BY confidence DESC, title, file, line, rule_id LIMIT 5"),
)
def queue(spark, d):
    return R.review_queue(staged(spark, d))


@register("g04_top_actions", found(f"SELECT * FROM findings ORDER BY {_ORDER}, title, file, line, rule_id LIMIT 5"))
def actions(spark, d):
    return R.top_actions(findings(spark, d))


@register(
    "e06_coverage",
    """
WITH runs AS (SELECT DISTINCT event_type AS scanner, CASE WHEN event_type = 'click' THEN 99 ELSE 0 END AS exit_code FROM events),
f AS (SELECT event_type AS scanner, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'unsupported-format' WHEN 1 THEN 'scan-incomplete' WHEN 2 THEN 'file-truncated' ELSE 'x' END AS category FROM events WHERE event_type <> 'view'),
g AS (SELECT scanner, max(CASE WHEN category LIKE 'unsupported%' THEN 2 ELSE 1 END) AS r, list_sort(list_distinct(list(category))) AS reasons FROM f WHERE category <> 'x' GROUP BY scanner),
j AS (SELECT runs.scanner, greatest(coalesce(r, 0), CASE WHEN exit_code > 2 THEN 1 ELSE 0 END) AS rank, coalesce(reasons, []) AS reasons FROM runs LEFT JOIN g USING (scanner))
SELECT scanner, ['COMPLETE', 'INCOMPLETE', 'UNSUPPORTED'][rank + 1] AS status, reasons, (SELECT ['COMPLETE', 'INCOMPLETE', 'UNSUPPORTED'][max(rank) + 1] FROM j) AS overall FROM j""",
)
def coverage(spark, d):
    e = table(spark, d, "events")
    runs = e.select(F.col("event_type").alias("scanner")).distinct().withColumn("exit_code", F.when(F.col("scanner") == "click", 99).otherwise(0))
    k = F.col("event_id") % 5
    f = e.where("event_type <> 'view'").select(F.col("event_type").alias("scanner"), F.when(k == 0, "unsupported-format").when(k == 1, "scan-incomplete").when(k == 2, "file-truncated").otherwise("x").alias("category"))
    return R.coverage(runs, f)


@register(
    "e07_enrichment",
    """
WITH e AS (SELECT event_type, CASE WHEN value > 1 THEN 'degraded' ELSE 'ok' END AS state, CASE WHEN event_id % 3 = 0 THEN event_type || '-gap' ELSE 'x' END AS category FROM events)
SELECT (SELECT CASE max(CASE state WHEN 'offline' THEN 2 WHEN 'degraded' THEN 1 ELSE 0 END) WHEN 2 THEN 'offline' WHEN 1 THEN 'degraded' ELSE 'ok' END FROM e) AS status,
  (SELECT list_sort(list_distinct(list(category))) FROM e WHERE category LIKE '%-gap') AS gaps""",
)
def enrichment(spark, d):
    e = table(spark, d, "events")
    runs = e.select(F.col("event_type").alias("capability"), F.when(F.col("value") > 1, "degraded").otherwise("ok").alias("state"))
    return R.enrichment(runs, e.select(F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("-gap"))).otherwise("x").alias("category")))


BUDGETS = (("src0", "critical", 5), ("src1", "high", 2), ("pages", "medium", 1))


@register(
    "e15_budget_gate",
    found(f", b(item, severity, budget) AS (VALUES {', '.join(map(str, BUDGETS))}) SELECT item, severity, n, coalesce(budget, 0) AS budget FROM (SELECT repo AS item, severity, count(*) AS n FROM findings GROUP BY ALL) LEFT JOIN b USING (item, severity) WHERE n > coalesce(budget, 0)"),
)
def budget(spark, d):
    return R.budget_gate(findings(spark, d).withColumnRenamed("repo", "item"), spark.createDataFrame(list(BUDGETS), "item string, severity string, budget int"))


@register(
    "e20_joint_error",
    """
SELECT count(*) AS n, count(*) FILTER (a <> truth) AS wrong_a, count(*) FILTER (b <> truth) AS wrong_b, count(*) FILTER (a <> truth AND b <> truth) AS wrong_both
FROM (SELECT toxic = 1 AS truth, length(coalesce(text, '')) % 7 = 0 AS a, doc_id % 5 = 0 AS b FROM labels JOIN documents USING (doc_id))""",
)
def joint_error(spark, d):
    c = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    return R.joint_error(c.select((F.col("toxic") == 1).alias("truth"), (F.length(F.coalesce("text", F.lit(""))) % 7 == 0).alias("a"), (F.col("doc_id") % 5 == 0).alias("b")))


@register("e22_risk_themes", found("SELECT category AS theme, min(file || ':' || lpad(CAST(line AS VARCHAR), 6, '0')) AS first_seen FROM findings GROUP BY category"))
def themes(spark, d):
    f = findings(spark, d).select(F.col("category").alias("theme"), F.concat("file", F.lit(":"), F.lpad(F.col("line").cast("string"), 6, "0")).alias("ord"))
    return R.risk_themes(f)


TOOL_RULES = (("both", "secret", True), ("both", "container", True), ("alone", "stealth", True), ("alone", "no-such", False), ("never", "no-such", True))


@register(
    "d24_cross_tool_rules",
    found(f", r(rule, key, required) AS (VALUES {', '.join(map(str, TOOL_RULES))}) SELECT rule FROM r GROUP BY rule HAVING bool_and((key IN (SELECT category FROM findings)) = required)"),
)
def cross_rules(spark, d):
    return R.cross_tool_rules(spark.createDataFrame(list(TOOL_RULES), "rule string, key string, required boolean"), findings(spark, d).select(F.col("category").alias("key")))


@register(
    "d25_ungrounded",
    found(", c AS (SELECT rule_id AS ref FROM findings UNION SELECT path FROM files_v UNION SELECT 'claim-' || doc_id FROM documents WHERE doc_id % 10 = 0) SELECT ref FROM c WHERE ref NOT IN (SELECT rule_id FROM findings) AND ref NOT IN (SELECT path FROM files_v)"),
)
def grounding(spark, d):
    f, v = staged(spark, d), view(spark, d, "files_v")
    cited = f.select(F.col("rule_id").alias("ref")).union(v.select("path")).union(table(spark, d, "documents").where("doc_id % 10 = 0").select(F.concat(F.lit("claim-"), F.col("doc_id").cast("string")))).distinct()
    return R.ungrounded(cited, f, v)


@register("d26_omitted", found("SELECT DISTINCT repo, file, line, rule_id FROM findings WHERE severity IN ('critical', 'high') AND line % 2 = 0"))
def omissions(spark, d):
    f = staged(spark, d)
    return R.omitted(f, f.where("line % 2 = 1")).select("repo", "file", "line", "rule_id").distinct()
