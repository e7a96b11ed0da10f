"""Queries of content detectors, lines, graphs and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_guard.detectors import content as C
from corpus_guard.operators import graph as G
from corpus_guard.operators import inventory as I
from corpus_guard.operators import lines as L
from corpus_guard.operators.rules import LINES_SQL, SNIPPET_SQL
from corpus_guard.plans.views import oracle, table, view
from corpus_guard.registry import register

_L = f", l AS ({LINES_SQL.format(files='files_v')})"


def _files(spark, d):
    return view(spark, d, "files_v")


def _lines(spark, d, long="keep"):
    return L.to_lines(_files(spark, d), long)


def q(s: str) -> str:
    return s.replace("'", "''")


@register("b01_lines", oracle(_L + " SELECT path, line, md5(text) AS h FROM l", "files_v"))
def lines(spark, d):
    return _lines(spark, d).select("path", "line", F.md5("text").alias("h"))


@register("b02_long_lines", oracle(_L + " SELECT path, count(*) AS n, sum(length(substring(text, 1, 10000))) AS cut, count(*) FILTER (length(text) <= 10000) AS short FROM l GROUP BY path", "files_v"))
def long_lines(spark, d):
    cut = L.to_lines(_files(spark, d), "truncate").groupBy("path").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("cut"))
    short = L.to_lines(_files(spark, d), "skip").groupBy("path").agg(F.count("*").alias("short"))
    return cut.join(short, "path", "left").withColumn("short", F.coalesce("short", F.lit(0)))


@register("b03_comments", oracle(_L + f" SELECT path, line FROM l WHERE NOT regexp_matches(text, '{L.COMMENT}') AND ext = 'py'", "files_v"))
def comments(spark, d):
    return L.drop_comments(_lines(spark, d).where("ext = 'py'")).select("path", "line")


IGNORES = ("src1/doc-*", "conv/", "src7", "*/doc-5.txt")


@register(
    "b04_ignores",
    oracle("SELECT path FROM files_v WHERE NOT (starts_with(path, 'conv/') OR starts_with(path, 'src7/') OR regexp_matches(path, '^src1/doc-.*$') OR regexp_matches(path, '^.*/doc-5\\.txt$'))", "files_v"),
)
def ignores(spark, d):
    return L.apply_ignores(_files(spark, d), spark.createDataFrame([(x,) for x in IGNORES], "pattern string")).select("path")


@register("b07_snippets", oracle(_L + f" SELECT path, line, {SNIPPET_SQL} AS snippet FROM l", "files_v"))
def snippets(spark, d):
    return _lines(spark, d).select("path", "line", L.snippet("text").alias("snippet"))


@register(
    "b11_file_filters",
    oracle(
        f"""SELECT path, NOT regexp_matches(lower(base), '(\\.min\\.(js|css)|\\.map|[.-]lock\\.(json|yaml)|^package-lock\\.json|^yarn\\.lock|^poetry\\.lock|^pipfile\\.lock|bundle\\.js)$') AS plain,
len(list_intersect(string_split(path, '/'), ['node_modules', 'vendor', 'third_party', 'site-packages', 'dist-packages', '.venv', 'venv'])) > 0 AS vendored,
regexp_matches(substring(content, 1, 8000), '{q(L.SERVER_SIGNALS)}') OR contains(lower(path), 'mcp') AS server_related FROM files_v""",
        "files_v",
    ),
)
def file_filters(spark, d):
    """B11, B13, B14, B16."""
    f = L.is_server_related(L.drop_build_artifacts(_files(spark, d)))
    plain = L.drop_minified(_files(spark, d)).select("path").withColumn("plain", F.lit(True))
    return f.join(plain, "path", "left").select("path", F.coalesce("plain", F.lit(False)).alias("plain"), L.is_vendored("path").alias("vendored"), "server_related")


@register("b15_seed_files", oracle("SELECT repo, path FROM files_v WHERE ext IN ('md', 'txt', 'py', 'js', 'sh', 'yml', 'yaml', 'json', 'toml') AND length(content) <= 1000000 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path) <= 200", "files_v"))
def seeds(spark, d):
    return L.seed_files(_files(spark, d)).select("repo", "path")


_FENCE = f"sum(CAST(regexp_matches(text, '{L.FENCE}') AS INT)) OVER (PARTITION BY repo, path ORDER BY line ROWS UNBOUNDED PRECEDING) % 2 = 1"


@register("f01_fences", oracle(_L + f" SELECT path, line, {_FENCE} AS in_fence FROM l WHERE ext = 'md'", "files_v"))
def fences(spark, d):
    return L.in_fence(_lines(spark, d).where("ext = 'md'")).select("path", "line", "in_fence")


@register("f03_first_by", oracle(_L + " SELECT repo, path, line FROM l WHERE length(text) > 200 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) = 1", "files_v"))
def first_by(spark, d):
    return L.first_by(_lines(spark, d).where("length(text) > 200"), ["repo"], ["path", "line"]).select("repo", "path", "line")


@register("g05_first_n", oracle(_L + " SELECT repo, path, line FROM l WHERE length(text) > 200 QUALIFY row_number() OVER (PARTITION BY repo ORDER BY path, line) <= 20", "files_v"))
def first_n(spark, d):
    return L.first_n(_lines(spark, d).where("length(text) > 200"), ["repo"], ["path", "line"], 20).select("repo", "path", "line")


@register(
    "f06_tail_lines",
    oracle(_L + ", n AS (SELECT path, line, count(*) OVER (PARTITION BY repo, path) AS n_lines FROM l) SELECT path, line, n_lines, line > n_lines - greatest(5, CAST(floor(n_lines * 0.3) AS INT)) AS in_tail, line > n_lines - 10 AS in_last_ten, line > n_lines * 0.8 AS past_80 FROM n", "files_v"),
)
def tails(spark, d):
    return L.tail_lines(_lines(spark, d), 0.3, 5).select("path", "line", "n_lines", "in_tail", "in_last_ten", "past_80")


_SEED = "SELECT repo, path, ext, line, text FROM l WHERE ext = 'yml'"


@register("f08_look_ahead", oracle(_L + r""", y AS (""" + _SEED + r"""), k AS (SELECT *, CASE WHEN regexp_matches(text, '^\s*key:\s*(\S+)') THEN regexp_extract(text, '^\s*key:\s*(\S+)', 1) END AS k FROM y)
SELECT path, line, ahead FROM (SELECT *, first_value(k IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY line ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM k) WHERE contains(text, 'actions/cache')""", "files_v"))
def look_ahead(spark, d):
    return L.look_ahead(_lines(spark, d).where("ext = 'yml'"), 10, r"^\s*key:\s*(\S+)").where(F.contains("text", F.lit("actions/cache"))).select("path", "line", "ahead")


@register("f10_carry_forward", oracle(_L + r""", k AS (SELECT *, CASE WHEN regexp_matches(text, '^\[([\w.]+)\]') THEN regexp_extract(text, '^\[([\w.]+)\]', 1) END AS k FROM l WHERE ext = 'toml')
SELECT path, line, last_value(k IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY line ROWS UNBOUNDED PRECEDING) AS section FROM k""", "files_v"))
def carry(spark, d):
    return L.carry_forward(_lines(spark, d).where("ext = 'toml'"), r"^\[([\w.]+)\]").select("path", "line", "section")


_CODE = f"SELECT *, {SNIPPET_SQL} AS snippet FROM l WHERE NOT regexp_matches(text, '^\\s*(#|//|;;|/\\*|\\*)')"
_PRIM = f", code AS ({_CODE}), k(kind, p) AS (VALUES " + ", ".join(f"('{k}', '{q(p)}')" for k, p in C.PRIMITIVES.items()) + "), f AS (SELECT repo, path, kind, line, snippet FROM code JOIN k ON regexp_matches(text, p) QUALIFY row_number() OVER (PARTITION BY repo, path, kind ORDER BY line) = 1)"


@register("c24_primitives", oracle(_L + _PRIM + " SELECT * FROM f", "files_v"))
def primitives(spark, d):
    return C.primitives(_lines(spark, d))


@register("c23_trifecta", oracle(_L + _PRIM + " SELECT * FROM f QUALIFY count(*) OVER (PARTITION BY repo, path) = 3", "files_v"))
def trifecta(spark, d):
    return C.trifecta(_lines(spark, d))


IOCS = (("domain", "hook.badhost.example", "shipped"), ("domain", "collect.badhost.example", "shipped"), ("domain", "evil.example", "feed"), ("c2_ip", "203.0.113.9", "shipped"), ("path", ".claude/settings.json", "shipped"), ("package", "evil-lib", "feed"), ("domain", "evil.example", "user"), ("pth_file", "evil.pth", "user"))


def _iocs(spark):
    one = spark.createDataFrame(list(IOCS[:4]), "kind string, value string, source string")
    return C.merge_iocs(one, spark.createDataFrame(list(IOCS[4:]), "kind string, value string, source string"))


_IOC = ", i(kind, value) AS (SELECT DISTINCT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v, _ in IOCS) + "))"


@register("d03_indicator_text", oracle(_L + _IOC + r""", c AS (SELECT DISTINCT repo, path, line, unnest(regexp_extract_all(lower(text), '([a-z0-9][a-z0-9.-]*\.[a-z0-9-]+|[0-9a-f]{32,64})', 1)) AS value FROM l)
SELECT repo, path, line, kind, value FROM c JOIN i USING (value) WHERE kind IN ('domain', 'c2_ip', 'hash') UNION SELECT repo, path, line, kind, value FROM l JOIN i ON contains(text, value) WHERE kind IN ('path', 'pth_file')""", "files_v"))
def ioc_text(spark, d):
    """D3, C26, A7, H2."""
    return C.match_ioc_text(_lines(spark, d), _iocs(spark))


@register("c70_log_sweep", oracle(_IOC + r", c AS (SELECT DISTINCT session, turn, unnest(regexp_extract_all(lower(command), '([a-z0-9][a-z0-9._-]+)', 1)) AS value FROM commands_v) SELECT session, turn, kind, value FROM c JOIN i USING (value)", "commands_v"))
def log_sweep(spark, d):
    return C.sweep_logs(view(spark, d, "commands_v").withColumnRenamed("command", "text"), _iocs(spark))


NAMES = (("doc-11.json", "high", "Build manifest"), ("doc-12.yml", "critical", "Worm lock file"), ("7.txt", "medium", "Unexpected runner"))


@register("c73_path_indicators", oracle(", t(base, severity, title) AS (VALUES " + ", ".join(map(str, NAMES)) + ") SELECT repo, path, severity, title FROM files_v JOIN t USING (base)", "files_v"))
def path_indicators(spark, d):
    return C.path_indicators(_files(spark, d), spark.createDataFrame(list(NAMES), "base string, severity string, title string"))


def _unicode_sql() -> str:
    odd = "CASE file_id % 10 WHEN 0 THEN chr(8203) || chr(8203) || 'x' || chr(8203) WHEN 1 THEN chr(8238) || 'abc' WHEN 2 THEN 'p' || chr(1072) || 'ypal' ELSE '' END"
    arms = []
    for kind, (pattern, least, only_code) in C.UNICODE_KINDS.items():
        code = " AND ext IN ('py', 'js', 'ts', 'sh', 'json', 'yml', 'toml')" if only_code else ""
        arms.append(f"SELECT repo, path, '{kind}' AS kind, len(regexp_extract_all(content, '{pattern}')) AS n FROM u WHERE n >= {least}{code}")
    return f", u AS (SELECT * REPLACE (content || {odd} AS content) FROM files_v) " + " UNION ALL ".join(arms)


@register("c13_unicode", oracle(_unicode_sql(), "files_v"))
def unicode_scan(spark, d):
    f = _files(spark, d)
    odd = F.when(F.col("file_id") % 10 == 0, "​​x​").when(F.col("file_id") % 10 == 1, "‮abc").when(F.col("file_id") % 10 == 2, "pаypal").otherwise("")
    return C.scan_unicode(f.withColumn("content", F.concat("content", odd)))


@register("c14_morse", oracle(_L + r""", w AS (SELECT repo, path, line, list_filter(regexp_split_to_array(text, '[\s/]+'), lambda x: regexp_matches(x, '^[.\-]{1,6}$')) AS ws FROM l WHERE ext IN ('md', 'txt'))
SELECT repo, path, line, len(ws) AS words FROM w WHERE len(ws) >= 8 AND len(list_filter(ws, lambda x: regexp_matches(x, '^(\.-|-\.\.\.|-\.-\.|-\.\.|\.|\.\.-\.|--\.|\.\.\.\.|\.\.|\.---|-\.-|\.-\.\.|--|-\.|---|\.--\.|--\.-|\.-\.|\.\.\.|-|\.\.-|\.\.\.-|\.--|-\.\.-|-\.--|--\.\.)$'))) * 2 >= len(ws)""", "files_v"))
def morse(spark, d):
    return C.scan_morse(_lines(spark, d).withColumn("text", F.when((F.col("ext") == "md") & (F.col("line") == 1), F.lit("x")).otherwise(F.col("text"))).where("line > 0"))


@register("c15_hex_text")
def hex_text(spark, d):
    return C.scan_hex_text(_lines(spark, d))


@register("c16_padding", oracle(_L + r" SELECT repo, path, line, length(text) AS length FROM l WHERE length(text) > 2000 AND regexp_matches(text, '(?i)\b(run|execute|install|fetch|send|ignore|the)\b') QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY line) = 1", "files_v"))
def padding(spark, d):
    return C.scan_padding(_lines(spark, d))


_BLOB = " UNION ".join(f"SELECT repo, path, unnest(regexp_extract_all(content, '({p})', 1)) AS blob FROM b" for p in C.BLOBS.values())


@register("c18_blobs", oracle(f", b AS (SELECT repo, path, content || CASE WHEN file_id % 20 = 0 THEN ' ' || repeat('QUJDREVG', 8) || '== ' || repeat('0af9', 16) ELSE '' END AS content FROM files_v) SELECT DISTINCT repo, path, md5(blob) AS h FROM ({_BLOB})", "files_v"))
def blobs(spark, d):
    f = _files(spark, d).withColumn("content", F.concat("content", F.when(F.col("file_id") % 20 == 0, " " + "QUJDREVG" * 8 + "== " + "0af9" * 16).otherwise("")))
    return C.detect_blobs(f).select("repo", "path", F.md5("blob").alias("h")).distinct()


_RUN, _HEX, _KEY = r"[A-Za-z0-9+/]{80,}={0,2}", r"\b[0-9a-fA-F]{64,}\b", "(?i)(secret|token|api_?key|password)"


@register("c21_entropy_scan", oracle(_L + rf""", m AS (SELECT repo, path, line, text, regexp_matches(text, '{_RUN}') AND NOT regexp_matches(text, 'data:[^"]*;base64,') AS run, regexp_matches(text, '{_HEX}') AS hexed,
round(list_aggregate(string_split(substring(text, 1, 10000), ''), 'entropy'), 4) AS bits FROM (SELECT * REPLACE (substring(text, 1, 10000) AS text) FROM l) WHERE length(text) >= 50)
SELECT repo, path, line, CASE WHEN run THEN 'base64-run' WHEN hexed THEN 'hex-run' ELSE 'high-entropy' END AS kind, CASE WHEN run OR hexed OR regexp_matches(text, '{_KEY}') THEN 'high' ELSE 'medium' END AS severity
FROM m WHERE run OR hexed OR bits > 5.8""", "files_v"))
def entropy_scan(spark, d):
    return C.scan_entropy(_lines(spark, d))


_URLH = r"nullif(lower(regexp_extract(regexp_extract(text, '(https?://[^\s)>\"'']+)', 1), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([A-Za-z0-9.-]+)', 1)), '')"


@register("c19_prose", oracle(_L + rf""", f AS (SELECT *, {_FENCE} AS fenced, regexp_matches(text, '{L.FENCE}') AS is_fence FROM l WHERE ext IN ('md', 'txt')),
h AS (SELECT *, {_URLH} AS host FROM f WHERE NOT fenced AND NOT is_fence AND NOT regexp_matches(text, '[\w.]+@[\w.]+\.\w+')),
s AS (SELECT *, CASE WHEN regexp_matches(text, '{C.VERB}') AND regexp_matches(text, '{C.SENSITIVE}') AND host IS NOT NULL THEN 'high' WHEN regexp_matches(text, '{C.VERB}') AND host IS NOT NULL AND host NOT IN {C.SAFE_HOSTS} THEN 'medium' END AS severity FROM h)
SELECT repo, path, line, severity FROM s WHERE severity IS NOT NULL""", "files_v"))
def prose(spark, d):
    return C.scan_prose(_lines(spark, d))


@register("c25_registry_redirects")
def registry(spark, d):
    return C.scan_registry(_files(spark, d))


ACTIONS = (("tj-actions/changed-files", "v35"), ("evil-org/setup-tool", "*"))


@register("d15_actions", oracle(_L + rf""", a(action, bad_ref) AS (VALUES {', '.join(map(str, ACTIONS))}), u AS (SELECT repo, path, line, lower(regexp_extract(text, '{C.ACTION}', 1)) AS action, regexp_extract(text, '{C.ACTION}', 2) AS ref FROM l),
h AS (SELECT u.*, EXISTS (SELECT 1 FROM a WHERE a.action = u.action AND bad_ref IN ('*', ref)) AS hit FROM u WHERE action <> '')
SELECT repo, path, line, action, ref, CASE WHEN hit THEN 'compromised-action' ELSE 'unpinned-action' END AS category FROM h WHERE hit OR NOT regexp_matches(ref, '^[0-9a-f]{{40}}$')""", "files_v"))
def actions(spark, d):
    return C.match_actions(_lines(spark, d), spark.createDataFrame(list(ACTIONS), "action string, ref string"))


@register("d19_tool_collisions", "WITH t AS (SELECT DISTINCT l_suppkey AS server, 'tool-' || CAST(l_partkey % 400 AS VARCHAR) AS name FROM lineitem WHERE l_linenumber = 7), n AS (SELECT name, count(DISTINCT server) AS servers FROM t GROUP BY name) SELECT name, servers, CASE WHEN name IN ('tool-1', 'tool-2', 'tool-3') THEN 'critical' ELSE 'high' END AS severity FROM n WHERE servers > 1 OR name IN ('tool-1', 'tool-2', 'tool-3')")
def collisions(spark, d):
    t = table(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_suppkey").alias("server"), F.concat(F.lit("tool-"), (F.col("l_partkey") % 400).cast("string")).alias("name")).distinct()
    return C.tool_collisions(t, spark.createDataFrame([("tool-1",), ("tool-2",), ("tool-3",)], "name string"))


def _flag(p, name):
    return f"bool_or(regexp_matches(text, '{q(p)}')) AS {name}"


@register("c44_ci_compound", oracle(_L + f""", f AS (SELECT repo, path, {_flag('(pull_request_target|issue_comment|workflow_run)', 'untrusted')}, {_flag(r'secrets[.]', 'secrets')}, {_flag('(?i)(claude|copilot|gpt|agent).*action', 'agentic')}, {_flag('(contents: write|write-all)', 'w')},
{_flag('workflow_dispatch', 'dispatch')}, {_flag('actions/cache', 'cache')}, {_flag('id-token: write', 'id_token')}, {_flag('(curl|wget|https?://)', 'ext_')} FROM l WHERE ext IN ('yml', 'yaml') GROUP BY ALL)
SELECT repo, path, 'untrusted-trigger-with-secrets' AS category, CASE WHEN ext_ OR agentic THEN 'critical' ELSE 'high' END AS severity FROM f WHERE untrusted AND secrets UNION ALL SELECT repo, path, 'zombie-workflow', 'high' FROM f WHERE dispatch AND NOT untrusted AND w
UNION ALL SELECT repo, path, 'untrusted-cache-write', 'high' FROM f WHERE untrusted AND (cache OR id_token) UNION ALL SELECT repo, path, 'untrusted-trigger-with-write', 'high' FROM f WHERE untrusted AND w""", "files_v"))
def ci_compound(spark, d):
    return C.scan_ci_compound(_lines(spark, d))


@register("c45_package_config", oracle(_L + f""", f AS (SELECT repo, path, {_flag(r'^[[:space:]]*(registry|strict-ssl|ignore-scripts|package-lock)[[:space:]]*=', 'is_cfg')}, {_flag(r'strict-ssl[[:space:]]*=[[:space:]]*false', 'ssl')}, {_flag(r'package-lock[[:space:]]*=[[:space:]]*false', 'nolock')}, {_flag(r'^[[:space:]]*git[[:space:]]*=', 'git')},
{_flag(r'dangerouslyAllowAllBuilds:[[:space:]]*true', 'builds')}, {_flag(r'ignore-scripts[[:space:]]*=[[:space:]]*true', 'ign')}, {_flag(r'min(imum)?-release-age', 'age')} FROM l GROUP BY ALL),
k AS (SELECT repo, path, unnest([CASE WHEN ssl THEN 'ssl-off:critical' END, CASE WHEN nolock THEN 'no-lockfile:high' END, CASE WHEN git THEN 'git-override:critical' END, CASE WHEN builds THEN 'all-builds:critical' END, CASE WHEN NOT ign THEN 'scripts-allowed:medium' END, CASE WHEN NOT age THEN 'no-release-age:low' END]) AS k FROM f WHERE is_cfg)
SELECT repo, path, split_part(k, ':', 1) AS category, split_part(k, ':', 2) AS severity FROM k WHERE k IS NOT NULL""", "files_v"))
def package_config(spark, d):
    return C.scan_pkg_config(_lines(spark, d))


@register("c68_ignore_files", oracle(_L + r""", g AS (SELECT repo, text FROM l WHERE regexp_matches(text, '^\s*[\w*./-]*\*[\w*./-]*\s*$')) SELECT repo, CASE WHEN bool_or(trim(text) IN ('*', '**', '**/*', '*.py', '*.js', '*.sh', 'src/', 'scripts/', 'hooks/', '.')) THEN 'critical' ELSE 'medium' END AS severity, count(*) AS entries FROM g GROUP BY repo""", "files_v"))
def ignore_files(spark, d):
    return C.check_ignore_files(_lines(spark, d))


@register("c61_oversize", oracle("SELECT path, 'head' AS part, md5(substring(content, 1, 2000)) AS h, length(content) AS size FROM files_v WHERE length(content) > 8000 UNION ALL SELECT path, 'tail', md5(right(content, 2000)), length(content) FROM files_v WHERE length(content) > 8000", "files_v"))
def oversize(spark, d):
    return C.oversize_windows(_files(spark, d), 8000, 2000).select("path", "part", F.md5("content").alias("h"), "size")


@register("c62_whitespace", oracle(r""", f AS (SELECT *, content || CASE WHEN file_id % 25 = 0 THEN repeat(' ', 60000) || '.' ELSE '' END AS c FROM files_v),
w AS (SELECT repo, path, coalesce(list_max(list_transform(regexp_extract_all(c, '([ \t\n\r\f]{16,})', 1), lambda x: length(x))), 0) AS longest, length(regexp_replace(c, '[ \t\n\r\f]+', '', 'g')) AS left_, length(c) AS n FROM f)
SELECT repo, path, longest, round(1 - left_ / nullif(n, 0), 6) AS share FROM w WHERE left_ > 0 AND (longest >= 50000 OR round(1 - left_ / nullif(n, 0), 6) >= 0.5)""", "files_v"))
def whitespace(spark, d):
    return C.scan_whitespace(_files(spark, d).withColumn("content", F.concat("content", F.when(F.col("file_id") % 25 == 0, F.concat(F.repeat(F.lit(" "), F.lit(60_000)), F.lit("."))).otherwise(""))))


_DOM = "CASE WHEN regexp_matches(h, '^[0-9.]+$') OR len(string_split(h, '.')) < 2 THEN NULL ELSE array_to_string(string_split(h, '.')[-2:], '.') END"


_ANCHORS = _L + rf""", hs AS (SELECT repo, path, line, lower(unnest(regexp_extract_all(text, 'https?://([A-Za-z0-9.-]+)', 1))) AS h FROM l),
every AS (SELECT repo, path, line, 'forge' AS type, lower(unnest(regexp_extract_all(text, 'github\.com/([\w.-]+/[\w-]+)', 1))) AS target FROM l UNION ALL SELECT repo, path, line, 'domain', {_DOM} FROM hs
UNION ALL SELECT repo, path, line, 'cloud', h FROM hs WHERE regexp_matches(h, '\.(s3\.amazonaws\.com|herokuapp\.com|azurewebsites\.net|github\.io|netlify\.app|vercel\.app|pages\.dev|firebaseapp\.com|blob\.core\.windows\.net)$')
UNION ALL SELECT repo, path, line, 'package', lower(unnest(regexp_extract_all(text, '(?:pip|npm) install ([A-Za-z0-9@/._-]+)', 1))) FROM l),
anchors AS (SELECT repo, type, target, path, line FROM every WHERE target IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, type, target ORDER BY path, line) = 1)"""


@register("c72_anchors", oracle(_ANCHORS + " SELECT * FROM anchors", "files_v"))
def anchors(spark, d):
    return C.extract_anchors(_lines(spark, d))


VERDICTS = (("gone-owner", "claimable"), ("evil-org", "live"), ("evil-org/stash", "claimable"), ("evil-lib", "claimable"), ("badhost.example", "live"))


@register("d18_dead_anchors", oracle(_ANCHORS + f""", v(key, verdict) AS (VALUES {', '.join(map(str, VERDICTS))}), j AS (SELECT a.*, CASE WHEN type = 'forge' THEN split_part(target, '/', 1) END AS owner FROM anchors a),
k AS (SELECT j.*, o.verdict AS ov, t.verdict AS tv FROM j LEFT JOIN v o ON o.key = owner LEFT JOIN v t ON t.key = target)
SELECT DISTINCT repo, 'owner' AS type, owner AS target, 'claimable' AS verdict FROM k WHERE ov = 'claimable' UNION ALL SELECT repo, type, target, coalesce(tv, 'not-checked') FROM k WHERE coalesce(ov, 'live') = 'live' AND coalesce(tv, 'not-checked') <> 'live'""", "files_v"))
def dead(spark, d):
    return C.dead_anchors(C.extract_anchors(_lines(spark, d)), spark.createDataFrame(list(VERDICTS), "key string, verdict string"))


_MEMQ, _NETQ = "regexp_matches(text, '(?i)(your memory|conversation history|MEMORY\\.md)')", f"regexp_matches(text, '{q(C.PRIMITIVES['network'])}')"


@register("e12_cooccurrence", oracle(_L + f" SELECT repo, count(DISTINCT path) FILTER ({_MEMQ}) AS memory_files, count(DISTINCT path) FILTER ({_NETQ}) AS network_files, min(path) FILTER ({_MEMQ}) AS memory_path, min(path) FILTER ({_NETQ}) AS network_path FROM l GROUP BY repo HAVING memory_files > 0 AND network_files > 0", "files_v"))
def cooccurrence(spark, d):
    return C.cooccurrence(_lines(spark, d))


# ---- graphs -----------------------------------------------------------------------------------------------------------------

_EDGES = f", named AS (SELECT DISTINCT repo, base AS src, unnest(regexp_extract_all(replace(content, 'helper-', 'doc-'), '{G.REFERENCE}', 1)) AS dst FROM files_v), edges AS (SELECT repo, src, dst FROM named WHERE src <> dst AND (repo, dst) IN (SELECT repo, base FROM files_v))"


def _linked(spark, d):
    """Files whose seeded helper names point at documents; all documents share one repo so that they meet."""
    f = _files(spark, d)
    docs = table(spark, d, "documents").select("doc_id")
    ring = docs.select(F.lit("ring").alias("repo"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("base"), F.concat(F.lit("see doc-"), (F.col("doc_id") * 3 % 101).cast("string"), F.lit(".md and doc-"), (F.col("doc_id") + 7).cast("string"), F.lit(".md")).alias("content"))
    return f.select("repo", "base", "content").unionByName(ring)


_RING = f""", all_f AS (SELECT repo, base, content FROM files_v UNION ALL SELECT 'ring', 'doc-' || CAST(doc_id AS VARCHAR) || '.md', 'see doc-' || CAST(doc_id * 3 % 101 AS VARCHAR) || '.md and doc-' || CAST(doc_id + 7 AS VARCHAR) || '.md' FROM documents),
named AS (SELECT DISTINCT repo, base AS src, unnest(regexp_extract_all(content, '{G.REFERENCE}', 1)) AS dst FROM all_f), edges AS (SELECT repo, src, dst FROM named WHERE src <> dst AND (repo, dst) IN (SELECT repo, base FROM all_f))"""


@register("j01_reference_edges", oracle(_RING + " SELECT * FROM edges", "files_v"))
def reference_edges(spark, d):
    return G.reference_edges(_linked(spark, d))


_SEED = r"^doc-\d*0\.md$"


@register("j01_reference_chains", oracle(_RING + """, chains AS (SELECT repo, [src, dst] AS path, dst AS e FROM edges WHERE regexp_matches(src, '^doc-\\d*0\\.md$') UNION ALL SELECT c.repo, list_append(path, dst), dst FROM chains c JOIN edges ON edges.repo = c.repo AND src = e WHERE NOT list_contains(path, dst) AND len(path) < 6)
SELECT repo, array_to_string(path, '>') AS chain, len(path) - 1 AS hops, CASE WHEN len(path) >= 4 THEN 'high' ELSE 'medium' END AS severity FROM chains WHERE len(path) > 2""", "files_v", recursive=True))
def reference_chains(spark, d):
    e = G.reference_edges(_linked(spark, d))
    return G.simple_chains(e, e.where(F.col("src").rlike(_SEED)).select("repo", "src").distinct())


_IMPQ = q(G.IMPORT)
_IMPORTS = rf", il AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS text FROM files_v WHERE ext IN ('py', 'js', 'ts')), im AS (SELECT DISTINCT repo, path, regexp_replace(regexp_replace(CASE WHEN regexp_extract(text, '{_IMPQ}', 1) <> '' THEN regexp_extract(text, '{_IMPQ}', 1) WHEN regexp_extract(text, '{_IMPQ}', 2) <> '' THEN regexp_extract(text, '{_IMPQ}', 2) ELSE regexp_extract(text, '{_IMPQ}', 3) END, '^\./', ''), '\..*$', '') AS module FROM il WHERE regexp_matches(text, '{_IMPQ}'))"


@register("j02_import_edges", oracle(_IMPORTS + " SELECT * FROM im", "files_v"))
def import_edges(spark, d):
    return G.import_edges(_files(spark, d))


_CROSS = """, f AS (SELECT * FROM files_v WHERE ext IN ('py', 'js')), g AS (SELECT repo, path, base, ext, content FROM f
UNION ALL SELECT repo, dir || '/helper.' || ext, 'helper.' || ext, ext, arg_min(content, file_id) FROM f WHERE file_id % 64 IN (10, 33) GROUP BY repo, dir, ext)""" + _IMPORTS.replace("FROM files_v", "FROM g") + f""",
t AS (SELECT repo, regexp_replace(base, '\\.[^.]*$', '') AS module, path AS source_path FROM g WHERE regexp_matches(content, '{G.SOURCE}')), s AS (SELECT repo, path FROM g WHERE regexp_matches(content, '{G.SINK}'))
SELECT DISTINCT im.repo, im.path, im.module, t.source_path FROM im JOIN s ON s.repo = im.repo AND s.path = im.path JOIN t ON t.repo = im.repo AND t.module = im.module WHERE im.path <> t.source_path"""


@register("d12_cross_file_taint", oracle(_CROSS, "files_v"))
def cross_taint(spark, d):
    f = _files(spark, d).where("ext in ('py', 'js')")
    helper = f.where("file_id % 64 in (10, 33)").groupBy("repo", "dir", "ext").agg(F.min_by("content", "file_id").alias("content"), F.min("file_id").alias("file_id"))
    alias = helper.withColumns({"path": F.concat("dir", F.lit("/helper."), "ext"), "base": F.concat(F.lit("helper."), "ext")})
    return G.cross_file_taint(f.unionByName(alias.select(*f.columns)))


# ---- inventories ------------------------------------------------------------------------------------------------------------

_SURF = "CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN '{s}'" for s, p in I.SURFACES) + " END"
_INV = f", inv AS (SELECT split_part(path, '/', 1) AS ecosystem, {_SURF} AS surface, path, base AS name, length(content) AS size_bytes FROM files_v)"


@register("a01_corpus_scan", oracle("SELECT path, strlen(content) AS size FROM files_v WHERE strlen(content) <= 10485760 AND len(list_intersect(string_split(path, '/'), ['.git', 'node_modules', '__pycache__', '.venv', 'venv', 'dist', 'build', '.tox'])) = 0", "files_v"))
def corpus_scan(spark, d):
    return I.read_corpus(spark, _files(spark, d)).select("path", "size")


@register("a02_aux_scan", oracle("SELECT path, strlen(content) AS size FROM files_v", "files_v"))
def aux_scan(spark, d):
    return I.read_corpus(spark, _files(spark, d), aux=True).select("path", "size")


@register("a25_inventory", oracle(_INV + " SELECT * FROM inv WHERE surface IS NOT NULL", "files_v"))
def inventory(spark, d):
    return I.inventory(_files(spark, d))


@register("e16_surface_counts", oracle(_INV + " SELECT ecosystem, " + ", ".join(f"count(*) FILTER (surface = '{s}') AS {s}" for s, _ in I.SURFACES) + " FROM inv WHERE surface IS NOT NULL GROUP BY ecosystem", "files_v"))
def surface_counts(spark, d):
    return I.surface_counts(I.inventory(_files(spark, d)))


@register("e17_shared_configs", oracle(_INV + " SELECT CASE WHEN starts_with(name, 'doc') THEN split_part(name, '.', 2) ELSE name END AS name, count(DISTINCT ecosystem) AS ecosystems FROM inv WHERE surface IS NOT NULL GROUP BY 1 HAVING ecosystems > 1", "files_v"))
def shared_configs(spark, d):
    inv = I.inventory(_files(spark, d))
    return I.shared_configs(inv.withColumn("name", F.when(F.col("name").startswith("doc"), F.split_part("name", F.lit("."), F.lit(2))).otherwise(F.col("name"))))


@register("e18_agent_repos", oracle(f"SELECT repo, bool_or(regexp_matches(base, '(?i)^(skill|agents|claude)\\.md$') OR regexp_matches(content, '{I.MARKERS}')) AS is_agent FROM files_v GROUP BY repo", "files_v"))
def agent_repos(spark, d):
    return I.is_agent_repo(_files(spark, d))


@register("e19_shape_counts", oracle(r"SELECT path, len(list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(#.*|//.*)?$'))) AS lines, len(regexp_extract_all(content, '" + r'("command"\s*:)' + "', 1)) AS servers FROM files_v", "files_v"))
def shape_counts(spark, d):
    return I.shape_counts(_files(spark, d))


SIGNALS = (("node", "doc-3.json"), ("node", "package.json"), ("python", "pyproject.toml"), ("python", "doc-7.toml"), ("rust", "Cargo.toml"))


@register("e21_ecosystems", oracle(", s(ecosystem, base) AS (VALUES " + ", ".join(map(str, SIGNALS)) + ") SELECT ecosystem, bool_or(base IN (SELECT base FROM files_v)) AS present FROM s GROUP BY ecosystem", "files_v"))
def ecosystems(spark, d):
    return I.detect_ecosystems(_files(spark, d), spark.createDataFrame(list(SIGNALS), "ecosystem string, base string"))
