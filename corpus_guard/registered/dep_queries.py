"""Queries of dependencies, releases and commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_guard.operators import deps as D
from corpus_guard.operators.lines import to_lines
from corpus_guard.operators.rules import LINES_SQL
from corpus_guard.plans.views import oracle, table, view
from corpus_guard.registry import register

TRUSTED = ("registry.npmjs.org", "pypi.org", "docs.python.org")
_TRUST = "trusted(host) AS (VALUES " + ", ".join(f"('{t}')" for t in TRUSTED) + ")"
_DEP = "repo, file, ecosystem, name, version, prefix, resolved_url, integrity"
_SUFFIX = "SELECT h FROM (SELECT DISTINCT host AS h FROM {0}) WHERE EXISTS (SELECT 1 FROM trusted t WHERE h = t.host OR ends_with(h, '.' || t.host))"
_HOST = r"nullif(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([A-Za-z0-9.-]+)', 1)), '')"


def _trusted(spark):
    return spark.createDataFrame([(t,) for t in TRUSTED], "host string")


def _deps(spark, d):
    return view(spark, d, "deps_v").drop("manifest_id", "part_id")


def _compromised(spark, d):
    """Every tenth part name is compromised at one version, every 25th at all."""
    p = table(spark, d, "part")
    name = F.lower(F.replace("p_name", F.lit(" "), F.lit("-")))
    return p.where("p_partkey % 10 = 0").select(F.concat(F.lit("c"), (F.col("p_partkey") % 3).cast("string")).alias("campaign"), name.alias("package"), F.when(F.col("p_partkey") % 25 == 0, "*").otherwise(F.concat(F.lit("v"), (F.col("p_partkey") % 100).cast("string"), F.lit(".2.5"))).alias("version")).distinct()


_COMP = """, c AS (SELECT DISTINCT 'c' || CAST(p_partkey % 3 AS VARCHAR) AS campaign, lower(replace(p_name, ' ', '-')) AS package, CASE WHEN p_partkey % 25 = 0 THEN '*' ELSE CAST(p_partkey % 100 AS VARCHAR) || '.2.5' END AS v FROM part WHERE p_partkey % 10 = 0)"""


@register("d01_compromised_versions", oracle(_COMP + f" SELECT {_DEP}, campaign FROM deps_v JOIN c ON name = package AND (v = '*' OR (v = version AND prefix = ''))", "deps_v"))
def compromised(spark, d):
    return D.match_compromised(_deps(spark, d), _compromised(spark, d))


@register("c71_installed_sweep", oracle(_COMP + f" SELECT {_DEP.replace('prefix, ', '')}, campaign FROM deps_v JOIN c ON name = package AND (v = '*' OR v = version)", "deps_v"))
def installed(spark, d):
    return D.sweep_installed(_deps(spark, d).drop("prefix"), _compromised(spark, d))


@register("d02_malicious_names", oracle(f"SELECT {_DEP} FROM deps_v WHERE name IN (SELECT lower(replace(p_name, ' ', '-')) FROM part WHERE p_partkey % 10 = 0)", "deps_v"))
def malicious(spark, d):
    return D.match_ioc_names(_deps(spark, d), _compromised(spark, d).select(F.upper("package").alias("name")))


@register("d04_scopes", oracle("SELECT file, '@s' || CAST(part_id % 9 AS VARCHAR) || '/' || name AS name FROM deps_v WHERE part_id % 9 IN (2, 5)", "deps_v"))
def scopes(spark, d):
    dv = view(spark, d, "deps_v").select("file", F.concat(F.lit("@s"), (F.col("part_id") % 9).cast("string"), F.lit("/"), "name").alias("name"))
    return D.match_scopes(dv, spark.createDataFrame([("@s2",), ("@s5",)], "scope string")).select("file", "name")


def _popular(spark, d):
    p = table(spark, d, "part").where("p_partkey % 20 = 1")
    return p.groupBy(F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("z")).alias("popular")).agg(F.min("p_partkey").alias("ord"))


@register("d05_typosquats")
def typosquats(spark, d):
    return D.typosquats(_deps(spark, d), _popular(spark, d))


@register(
    "d05_near_names",
    oracle(
        """, pop AS (SELECT lower(replace(p_name, ' ', '-')) || 'z' AS popular, min(p_partkey) AS ord FROM part WHERE p_partkey % 20 = 1 GROUP BY 1),
n AS (SELECT DISTINCT name FROM deps_v WHERE name NOT IN (SELECT popular FROM pop))
SELECT name, arg_min(popular, ord) AS popular FROM n JOIN pop ON levenshtein(name, popular) <= 2 GROUP BY name""",
        "deps_v",
    ),
)
def near_names(spark, d):
    return D.near_names(_deps(spark, d), _popular(spark, d))


@register("d06_invented_names", oracle(f"SELECT {_DEP} FROM deps_v WHERE (ecosystem, name) IN (SELECT 'npm', lower(replace(p_name, ' ', '-')) FROM part WHERE p_partkey % 30 = 3)", "deps_v"))
def invented(spark, d):
    names = table(spark, d, "part").where("p_partkey % 30 = 3").select(F.lit("npm").alias("ecosystem"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"))
    return D.slopsquats(_deps(spark, d), names).select(*_DEP.split(", "))


@register("d07_starjacking")
def starjacking(spark, d):
    m = _deps(spark, d).select("repo", "name", F.reverse("name").alias("repo_name")).distinct()
    return D.starjacking(m)


@register("d08_untrusted_hosts", oracle(f", {_TRUST}, u AS (SELECT file, resolved_url, {_HOST.format('resolved_url')} AS host FROM deps_v) SELECT host, file, resolved_url FROM u WHERE host NOT IN ({_SUFFIX.format('u')})", "deps_v"))
def untrusted(spark, d):
    u = _deps(spark, d).select("file", "resolved_url", D.url_host("resolved_url").alias("host"))
    return D.untrusted_hosts(u, _trusted(spark))


_IMP = """, i AS (SELECT DISTINCT 'r' || CAST(l_orderkey AS VARCHAR) AS repo, CAST(l_partkey % 60 AS VARCHAR) AS name FROM lineitem WHERE l_linenumber <= 3),
dcl AS (SELECT DISTINCT 'r' || CAST(l_orderkey AS VARCHAR) AS repo, CAST(l_suppkey % 60 AS VARCHAR) AS name FROM lineitem WHERE l_orderkey % 4 < 3),
b(name) AS (VALUES ('1'), ('2'), ('3'))"""


def _imports(spark, d):
    li = table(spark, d, "lineitem")
    repo = F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("repo")
    imports = li.where("l_linenumber <= 3").select(repo, (F.col("l_partkey") % 60).cast("string").alias("name")).distinct()
    declared = li.where("l_orderkey % 4 < 3").select(repo, (F.col("l_suppkey") % 60).cast("string").alias("name")).distinct()
    return imports, declared, spark.createDataFrame([("1",), ("2",), ("3",)], "name string")


@register("d09_phantom_dependencies", f"WITH {_IMP.lstrip(', ')} SELECT repo, name FROM i WHERE repo IN (SELECT repo FROM dcl) AND (repo, name) NOT IN (SELECT repo, name FROM dcl) AND name NOT IN (SELECT name FROM b)")
def phantom(spark, d):
    return D.phantom_deps(*_imports(spark, d))


@register("d10_unused_dependencies", f"WITH {_IMP.lstrip(', ')} SELECT repo, name FROM dcl WHERE (repo, name) NOT IN (SELECT repo, name FROM i) AND name NOT IN (SELECT name FROM b)")
def unused(spark, d):
    return D.unused_deps(*_imports(spark, d))


@register(
    "d11_missing_lockfiles",
    """WITH f AS (SELECT DISTINCT 'r' AS repo, 'a' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '/b' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN '/c' ELSE '' END AS dir, o_orderkey % 11 = 0 AS locked FROM orders),
l AS (SELECT DISTINCT dir FROM f WHERE locked), m AS (SELECT DISTINCT repo, dir FROM f WHERE NOT locked),
p AS (SELECT *, regexp_replace(dir, '(^|/)[^/]*$', '') AS up FROM m)
SELECT repo, dir FROM p WHERE dir NOT IN (SELECT dir FROM l) AND up NOT IN (SELECT dir FROM l) AND regexp_replace(up, '(^|/)[^/]*$', '') NOT IN (SELECT dir FROM l)""",
)
def lockfiles(spark, d):
    k = F.col("o_orderkey")
    dirs = F.concat(F.lit("a"), F.col("o_custkey").cast("string"), F.when(k % 2 == 0, "/b").otherwise(""), F.when(k % 3 == 0, "/c").otherwise(""))
    f = table(spark, d, "orders").select(F.lit("r").alias("repo"), dirs.alias("dir"), F.when(k % 11 == 0, "yarn.lock").otherwise("package.json").alias("base")).distinct()
    return D.missing_lockfiles(f, f.where("base = 'package.json'").select("repo", "dir"))


@register(
    "c53_dependency_specs",
    oracle(
        r"""SELECT file, name, prefix || version AS spec, CASE prefix WHEN 'git+https://github.com/x/' THEN 'git-dependency' WHEN 'http://dl.example/' THEN 'http-dependency' ELSE 'file-dependency' END AS category,
CASE prefix WHEN 'git+https://github.com/x/' THEN 'high' WHEN 'http://dl.example/' THEN 'critical' ELSE 'medium' END AS severity FROM deps_v WHERE length(prefix) > 2""",
        "deps_v",
    ),
)
def specs(spark, d):
    return D.check_dep_specs(_deps(spark, d)).select("file", "name", "spec", "category", "severity")


@register("c54_version_anomaly", oracle("SELECT file, name, version FROM deps_v WHERE CAST(split_part(version, '.', 1) AS INT) >= 90", "deps_v"))
def anomaly(spark, d):
    return D.version_anomaly(_deps(spark, d)).select("file", "name", "version")


@register("c55_unbounded_ranges", oracle("SELECT file, name, 'medium' AS severity FROM deps_v WHERE prefix = '>=' AND manifest_id % 3 <> 0", "deps_v"))
def unbounded(spark, d):
    dv = view(spark, d, "deps_v")
    return D.unbounded_ranges(dv, dv.where("manifest_id % 3 = 0").select("repo").distinct()).select("file", "name", "severity")


@register(
    "c56_lock_urls",
    oracle(
        rf""", {_TRUST}, l AS ({LINES_SQL.format(files='files_v')}),
u0 AS (SELECT repo, path, line, regexp_extract_all(text, '(https?://[^\s"''<>)]+)', 1) AS us FROM l),
u AS (SELECT repo, path, line, unnest(us) AS url, generate_subscripts(us, 1) AS at_ FROM u0), h AS (SELECT *, {_HOST.format('url')} AS host FROM u)
SELECT repo, path, line, url, host FROM h WHERE host IS NOT NULL AND host NOT IN ({_SUFFIX.format('(SELECT * FROM h WHERE host IS NOT NULL)')}) QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line, at_) <= 5""",
        "files_v",
    ),
)
def lock_urls(spark, d):
    return D.lock_urls(to_lines(view(spark, d, "files_v"), "keep"), _trusted(spark))


@register(
    "c57_lock_injection",
    oracle(
        f""", {_TRUST}, u AS (SELECT *, {_HOST.format('resolved_url')} AS host FROM deps_v)
SELECT file, name, 'missing-integrity' AS category FROM u WHERE integrity IS NULL UNION ALL SELECT file, name, 'untrusted-registry' FROM u WHERE host NOT IN ({_SUFFIX.format('u')})""",
        "deps_v",
    ),
)
def lock_injection(spark, d):
    return D.lock_injection(_deps(spark, d), _trusted(spark)).select("file", "name", "category")


@register("h05_overrides", "WITH d AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS repo, o_orderstatus AS name FROM orders), o AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS repo, substring(o_orderpriority, 1, 1) AS name FROM orders UNION SELECT DISTINCT CAST(o_custkey AS VARCHAR), 'F' FROM orders) SELECT * FROM d UNION ALL SELECT * FROM o WHERE (repo, name) NOT IN (SELECT repo, name FROM d)")
def overrides(spark, d):
    o = table(spark, d, "orders").withColumn("repo", F.col("o_custkey").cast("string"))
    return D.with_overrides(o.select("repo", F.col("o_orderstatus").alias("name")).distinct(), o.select("repo", F.substring("o_orderpriority", 1, 1).alias("name")).union(o.select("repo", F.lit("F"))).distinct())


@register(
    "d16_vulnerabilities",
    oracle(
        """, a AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, lower(replace(p_name, ' ', '-')) AS package, 'OSV-' || CAST(p_partkey AS VARCHAR) AS id, 'CVE-2024-' || CAST(1000 + p_partkey % 500 AS VARCHAR) AS cve, (p_partkey % 101) / 10.0 AS cvss FROM part WHERE p_partkey % 12 = 0 OR p_partkey % 13 = 0)
SELECT file, name, version, id, CASE WHEN CAST(split_part(cve, '-', 3) AS INT) % 50 = 0 OR cvss >= 9 THEN 'critical' WHEN cvss >= 7 THEN 'high' WHEN cvss >= 4 THEN 'medium' ELSE 'low' END AS severity
FROM deps_v JOIN a ON a.ecosystem = deps_v.ecosystem AND name = package""",
        "deps_v",
    ),
)
def vulns(spark, d):
    k = F.col("p_partkey")
    cve = F.concat(F.lit("CVE-2024-"), (k % 500 + 1000).cast("string"))
    p = table(spark, d, "part").where("p_partkey % 12 = 0 or p_partkey % 13 = 0")
    adv = p.select(F.when(k % 2 == 0, "npm").otherwise("pypi").alias("ecosystem"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("package"), F.concat(F.lit("OSV-"), k.cast("string")).alias("id"), F.array(cve).alias("aliases"), ((k % 101) / 10).alias("cvss"))
    kev = spark.range(1000, 1500).where("id % 50 = 0").select(F.concat(F.lit("cve-2024-"), F.col("id").cast("string")).alias("cve"))
    deps = D.by_package(_deps(spark, d).select("ecosystem", "file", "name", "version"), "file", "version")
    return D.enrich_vulns(deps, adv, kev).select("file", "name", "version", "id", "severity")


_HIST = "SELECT package, version, published, maintainer, lag(maintainer) OVER w AS prev_maintainer, row_number() OVER w AS nth, count(*) OVER (PARTITION BY package) AS version_count FROM releases_v WINDOW w AS (PARTITION BY package ORDER BY published, version, maintainer)"


@register("f07_release_history", oracle(_HIST, "releases_v"))
def history(spark, d):
    return D.release_history(view(spark, d, "releases_v"))


@register(
    "d17_freshness",
    oracle(
        f""", n AS (SELECT max(published) AS t FROM releases_v), h AS ({_HIST}),
l AS (SELECT *, date_diff('second', published, t) / 3600.0 AS hrs FROM h, n WHERE package NOT IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 10 = 0) QUALIFY row_number() OVER (PARTITION BY package ORDER BY published DESC, version DESC, maintainer DESC) = 1)
SELECT package, version, 'freshness-new-release' AS category, 'high' AS severity FROM l WHERE hrs >= 0 AND hrs < 24
UNION ALL SELECT package, version, 'freshness-recent-release', 'medium' FROM l WHERE hrs >= 24 AND hrs < 168
UNION ALL SELECT package, version, 'freshness-brand-new-package', 'high' FROM l WHERE version_count = 1 AND hrs >= 0 AND hrs < 720
UNION ALL SELECT package, version, 'maintainer-changed', 'high' FROM l WHERE prev_maintainer <> maintainer""",
        "releases_v",
    ),
)
def freshness(spark, d):
    r = view(spark, d, "releases_v")
    now = r.agg(F.max("published")).first()[0]
    return D.freshness(r, table(spark, d, "part").where("p_partkey % 10 = 0").select(F.col("p_partkey").cast("string").alias("package")), now)


_KINDS = " ".join(f"WHEN regexp_matches(command, '{p}') THEN '{k}'" for k, p in D.INSTALL_KINDS)


@register("c66_install_commands", oracle(f"SELECT session, turn, CASE {_KINDS} END AS kind FROM commands_v", "commands_v"))
def installs(spark, d):
    return D.detect_installs(view(spark, d, "commands_v")).select("session", "turn", "kind")


@register(
    "c67_command_packages",
    oracle(
        rf""", k AS (SELECT session, turn, command, CASE {_KINDS} END AS kind FROM commands_v),
w AS (SELECT session, turn, kind, unnest(list_filter(regexp_split_to_array(regexp_extract(command, '{D._TAIL}', 1), '\s+'), lambda x: x <> '' AND NOT starts_with(x, '-'))) AS word FROM k WHERE kind IS NOT NULL)
SELECT session, turn, kind, package FROM (SELECT *, lower(CASE WHEN kind IN ('pip', 'uv-pip', 'uv', 'pipx', 'poetry') THEN regexp_extract(word, '^([A-Za-z0-9._-]+)', 1) ELSE regexp_extract(word, '^(@?[^@\s]+)', 1) END) AS package FROM w) WHERE package <> ''""",
        "commands_v",
    ),
)
def packages(spark, d):
    return D.command_packages(view(spark, d, "commands_v")).select("session", "turn", "kind", "package")
