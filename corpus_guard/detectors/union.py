"""H1: what every detector finds as findings of one schema, to be united with the rule scans, and the same in SQL.

A detector gives (repo, path, category, severity, detail) and perhaps a line. Its
title is a fixed prefix and the category, so tags stay few however many findings there are.

Before the detectors run, the files are read twice (``narrowed``): the files and the lines that may concern some of them, by conditions
that every file or line with a finding meets, are written once, and the detectors read these in place of all files.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_guard.detectors import content as C
from corpus_guard.detectors import python_jobs as P
from corpus_guard.detectors import python_source as S
from corpus_guard.detectors.config_files import DETECTORS, PTH, manifest_confusion, scan_pth
from corpus_guard.detectors.config_sql import DETECTOR_SQL, JS, LINES
from corpus_guard.detectors.split_payloads import find_split_payloads
from corpus_guard.detectors.taint import EXTENSIONS, SINK, SOURCE as TAINTED, taint_flows
from corpus_guard.functions.scalars import default_confidence, looks_like_llm_bait
from corpus_guard.operators import deps as D
from corpus_guard.operators.lines import FENCE, once, snippet, to_lines
from corpus_guard.operators.report import union_findings
from corpus_guard.plans.staging import stage

BUILTINS = ("os", "sys", "re", "json", "base64", "subprocess", "importlib", "datetime")


@dataclass(frozen=True)
class Inputs:
    """What detectors read: files(repo, path, base, ext, content), locked dependencies, releases, and threat tables.

    ``every`` is all files where ``files`` are those that concern a detector, ``lines`` the lines that concern those which read lines,
    ``now`` the newest release where it is known.
    """

    files: DataFrame
    locked: DataFrame
    releases: DataFrame
    trusted: DataFrame
    iocs: DataFrame
    actions: DataFrame
    every: DataFrame | None = None
    lines: DataFrame | None = None
    now: date | datetime | None = None

    def of_lines(self) -> DataFrame:
        return to_lines(self.files) if self.lines is None else self.lines


@dataclass(frozen=True)
class Detector:
    """``reads``: the kinds of files in ``SIEVES``, or "line", that the detector reads; none for all files."""

    scanner: str
    prefix: str
    run: Callable[[Inputs], DataFrame]
    sql: str | None = None
    reads: tuple[str, ...] = ()


def as_findings(found: DataFrame, scanner: str, prefix: str) -> DataFrame:
    """Rows of a detector in the schema of findings."""
    title = F.concat(F.lit(prefix), F.replace("category", F.lit("-"), F.lit(" ")))
    line = F.col("line").cast("int") if "line" in found.columns else F.lit(0)
    return found.select(
        "repo", F.lit(scanner).alias("scanner"), "severity", title.alias("title"), title.alias("description"), F.col("path").alias("file"), line.alias("line"),
        snippet(F.coalesce("detail", F.lit(""))).alias("snippet"), "category", F.concat(F.lit("DET-"), "category").alias("rule_id"), default_confidence("severity").alias("confidence"),
    )


def as_findings_sql(d: Detector) -> str:
    line = "CAST(line AS INT)" if re.search(r"SELECT repo, path, line, ('|CASE)", d.sql) else "0"
    return f"""SELECT repo, '{d.scanner}' AS scanner, severity, '{d.prefix}' || replace(category, '-', ' ') AS title, '{d.prefix}' || replace(category, '-', ' ') AS description, path AS file, {line} AS line,
substring(regexp_replace(coalesce(detail, ''), '^\\s+|\\s+$', '', 'g'), 1, 120) AS snippet, category, 'DET-' || category AS rule_id,
CASE severity WHEN 'critical' THEN 0.95 WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.6 ELSE 0.4 END::DOUBLE AS confidence FROM (WITH {d.sql.strip().lstrip(',')})"""


# ---- detectors that need an input of their own --------------------------------------------------------------------------------


def _unicode(x: Inputs) -> DataFrame:
    return C.scan_unicode(x.files).select("repo", "path", F.lit("unicode-smuggling").alias("category"), F.lit("high").alias("severity"), F.col("kind").alias("detail"))


def _prose(x: Inputs) -> DataFrame:
    return C.scan_prose(x.of_lines()).select("repo", "path", "line", F.lit("prose-imperative").alias("category"), "severity", F.lit("").alias("detail"))


def _workflow(x: Inputs) -> DataFrame:
    return C.scan_ci_compound(x.of_lines()).withColumn("detail", F.lit(""))


def _npmrc(x: Inputs) -> DataFrame:
    return C.scan_pkg_config(x.of_lines()).withColumn("detail", F.lit(""))


def _actions(x: Inputs) -> DataFrame:
    found = C.match_actions(x.of_lines().where(F.contains("text", F.lit("uses:"))), x.actions)
    return found.select("repo", "path", "line", "category", F.when(F.col("category") == "compromised-action", "critical").otherwise("medium").alias("severity"), F.concat("action", F.lit("@"), "ref").alias("detail"))


def _iocs(x: Inputs) -> DataFrame:
    found = C.match_ioc_text(x.of_lines(), x.iocs)
    return found.select("repo", "path", "line", F.lit("known-ioc").alias("category"), F.lit("critical").alias("severity"), F.concat_ws(" ", "kind", "value").alias("detail"))


def declared(files: DataFrame) -> DataFrame:
    """Dependencies that the JSON manifests among files declare: repo, path, name, spec."""
    j = files.where("ext = 'json'").withColumn("j", F.from_json("content", "dependencies map<string,string>"))
    return j.select("repo", "path", F.explode("j.dependencies").alias("name", "spec"))


def required(files: DataFrame) -> DataFrame:
    """Names that the set-up programs among files require: repo, path, name."""
    inside = F.regexp_extract("content", r"install_requires\s*=\s*\[([^\]]*)\]", 1)
    return files.where("ext = 'py'").select("repo", "path", F.explode(F.regexp_extract_all(inside, F.lit(r"['\"]([A-Za-z0-9_.-]+)"), 1)).alias("name"))


def _specs(x: Inputs) -> DataFrame:
    specs = D.check_dep_specs(declared(x.files).select("repo", "path", "name", F.lit("").alias("prefix"), F.col("spec").alias("version")))
    return specs.select("repo", "path", "category", "severity", F.concat_ws(" ", "name", "spec").alias("detail"))


def _bait(x: Inputs) -> DataFrame:
    found = declared(x.files).where(looks_like_llm_bait("name"))
    return found.select("repo", "path", F.lit("llmo-suspicious").alias("category"), F.lit("high").alias("severity"), F.col("name").alias("detail"))


def _fresh(x: Inputs) -> DataFrame:
    """D17 over the releases of declared packages only; the newest release of all is now."""
    names = declared(x.files).select("repo", "path", F.col("name").alias("package"))
    now = x.now if x.now is not None else x.releases.agg(F.max("published")).first()[0]
    known = x.releases.join(names.select("package").distinct(), "package", "left_semi")
    none = known.select("package").limit(0)
    found = D.freshness(known, none, now).join(names, "package")
    return found.select("repo", "path", "category", "severity", F.col("package").alias("detail"))


def _phantom(x: Inputs) -> DataFrame:
    """D9 for modules that programs import in repos with a manifest."""
    names = F.regexp_extract_all("content", F.lit(r"(?m)^(?:import|from)\s+([A-Za-z_]\w*)"), 1)
    imports = x.files.where("ext = 'py'").select("repo", "path", F.explode(F.array_distinct(names)).alias("name"))
    builtins = x.files.sparkSession.createDataFrame([(b,) for b in BUILTINS], "name string")
    known = declared(x.files).select("repo", "name").union(required(x.files).select("repo", "name")).distinct()
    bad = D.phantom_deps(imports.select("repo", "name"), known, builtins)
    found = imports.join(bad, ["repo", "name"])
    return found.select("repo", "path", F.lit("phantom-dependency").alias("category"), F.lit("high").alias("severity"), F.col("name").alias("detail"))


def _locked(x: Inputs) -> DataFrame:
    found = D.lock_injection(x.locked, x.trusted).withColumn("path", F.col("file"))
    sev = F.when(F.col("category") == "missing-integrity", "medium").otherwise("high")
    return found.select("repo", "path", "category", sev.alias("severity"), F.concat_ws(" ", "name", "version").alias("detail"))


def _taint(x: Inputs) -> DataFrame:
    found = taint_flows(x.files)
    return found.select("repo", "path", F.col("sink_line").alias("line"), F.lit("taint-flow").alias("category"), F.lit("high").alias("severity"), F.col("variable").alias("detail"))


def _ladder(found: DataFrame) -> DataFrame:
    return found.select("repo", "path", F.lit("decoded-payload").alias("category"), F.lit("critical").alias("severity"), F.concat_ws(" ", "trail", "call").alias("detail"))


def _decoded(x: Inputs) -> DataFrame:
    return _ladder(P.decode_rescan(C.detect_blobs(x.files)))


def _split(x: Inputs) -> DataFrame:
    return find_split_payloads(P.fragments(x.files))


def _dense(x: Inputs) -> DataFrame:
    found = C.scan_entropy(to_lines(x.files))
    return found.select("repo", "path", "line", F.concat(F.lit("entropy-"), "kind").alias("category"), "severity", F.lit("").alias("detail"))


def _pth(x: Inputs) -> DataFrame:
    return scan_pth(x.files, lines=x.lines)


def _confusion(x: Inputs) -> DataFrame:
    return manifest_confusion(x.files, x.every)


# ---- which files and lines concern a detector -----------------------------------------------------------------------------------

IMPORTS = r"(?m)^(?:import|from)\s+[A-Za-z_]"
_SETTINGS = r"^\s*(registry|strict-ssl|ignore-scripts|package-lock|git)\s*="
_WORKFLOWS = r"(?i)(pull_request_target|issue_comment|workflow_run|secrets\.|(claude|copilot|gpt|agent).*action|contents: write|write-all|workflow_dispatch|actions/cache|id-token: write|curl|wget|https?://)"


def _sieves() -> dict[str, Column]:
    """Conditions on files by kind; every file in which a detector of the kind finds something meets its condition."""
    c, ext = F.col("content"), F.col("ext")
    foreign = F.octet_length(c) > F.length(c)
    return {
        "json": c.rlike(r"^[\x00-\x20\x{FEFF}]*[\[{]"),
        "metadata": c.rlike(r"(?i)(<(important|system)>|ignore previous|must (always|never)|do not tell|before using|(send|post|upload|fetch)[^\"'\n]{0,400}https?://)"),
        "frontmatter": (ext == "md") & c.rlike(r"^\s*---\n"),
        "scripts": F.contains(c, F.lit("scripts")) & c.rlike(r"[a-z0-9_-]\s*=\s*['\"]?[\w.]+:\w"),
        "setup": (ext == "py") & c.rlike(r"\bsetup\s*\("),
        "unicode": foreign & c.rlike(C.ODD) | ~foreign & ext.isin(*C.CODE) & c.rlike(C.UNICODE_KINDS["control"][0]),
        "imports": (ext == "py") & (c.rlike(IMPORTS) | F.contains(c, F.lit("install_requires"))),
        "taint": ext.isin(*EXTENSIONS) & c.rlike(TAINTED) & c.rlike(SINK),
        "blob": c.rlike("[A-Za-z0-9+/]{50,}") | F.contains(c, F.lit("<~")),
    }


def _named(x: Inputs) -> Column | None:
    """Whether a line, with ``low``, its lower-cased text, holds an indicator; none where there are more than one projection looks for."""
    few = [r for r in x.iocs.where("value <> '' and kind in ('domain', 'c2_ip', 'hash', 'path', 'pth_file')").limit(C.FEW_SUBSTRINGS + 1).collect()]
    if len(few) > C.FEW_SUBSTRINGS:
        return None
    hit = F.lit(False)
    for r in few:
        hit = hit | F.contains("text" if r.kind in ("path", "pth_file") else "low", F.lit(r.value))
    return hit


def _line_sieve() -> Column:
    """A condition on lines that every line meets which a detector of lines asks for, indicators apart."""
    t, ext = F.col("text"), F.col("ext")
    has = lambda *words: reduce(or_, [F.contains(t, F.lit(w)) for w in words])
    prose = ext.isin("md", "txt") & (t.rlike(FENCE) | F.contains(t, F.lit("://")) & t.rlike(C.VERB))
    npmrc = F.contains(t, F.lit("=")) & t.rlike(_SETTINGS) | has("strict-ssl", "package-lock", "dangerouslyAllowAllBuilds", "ignore-scripts", "release-age")
    return t.rlike(PTH) | prose | ext.isin("yml", "yaml") & t.rlike(_WORKFLOWS) | npmrc | F.contains(t, F.lit("uses:"))


def narrowed(x: Inputs, detectors: tuple[Detector, ...]) -> Callable[[Detector], Inputs]:
    """The inputs of each detector: of the files those that may concern it, and of the lines those that may concern any."""
    asked = {r for d in detectors for r in d.reads}
    kinds = [F.when(cond, F.lit(k)) for k, cond in _sieves().items() if k in asked]
    files = lines = None
    if kinds:
        # the few files in JSON apart, since most detectors read no others
        found = x.files.select("repo", "path", "base", "ext", "content", once(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("kinds")).where(F.size("kinds") > 0)
        files = stage(found.withColumn("json", F.array_contains("kinds", "json")), "concerned-files", "json")
    named = _named(x) if "ioc" in asked else F.lit(False)
    if asked & {"line", "ioc"}:
        every = to_lines(x.files.select("repo", "path", "base", "ext", "content")).withColumn("low", once(F.lower("text")))
        lines = stage(every.where(_line_sieve() | (F.lit(False) if named is None else named)).drop("low"), "concerned-lines")

    def of(d: Detector) -> Inputs:
        if "line" in d.reads or "ioc" in d.reads and named is not None:
            return replace(x, lines=lines)
        if not d.reads or "ioc" in d.reads:
            return x
        own = files.where("json") if d.reads == ("json",) else files
        return replace(x, files=own.where(F.arrays_overlap("kinds", F.array(*map(F.lit, d.reads)))).drop("kinds", "json"), every=x.files)

    return of


# ---- the same in SQL ------------------------------------------------------------------------------------------------------------

_DECLARED = f"{JS}, md AS (SELECT repo, path, name, json_extract_string(j, '$.dependencies.\"' || name || '\"') AS spec FROM (SELECT *, unnest(json_keys(j, '$.dependencies')) AS name FROM js WHERE ext = 'json'))"


def _flag(pattern: str, name: str) -> str:
    return f"bool_or(regexp_matches(text, '{pattern}')) AS {name}"


def _unicode_sql() -> str:
    arms = []
    for kind, (pattern, least, only_code) in C.UNICODE_KINDS.items():
        code = " AND ext IN ('py', 'js', 'ts', 'sh', 'json', 'yml', 'toml')" if only_code else ""
        arms.append(f"SELECT repo, path, 'unicode-smuggling' AS category, 'high' AS severity, '{kind}' AS detail FROM code_v WHERE len(regexp_extract_all(content, '{pattern}')) >= {least}{code}")
    return "z AS (SELECT 1) " + " UNION ALL ".join(arms)


_HOST = r"nullif(lower(regexp_extract(regexp_extract(text, '(https?://[^\s)>\"'']+)', 1), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([A-Za-z0-9.-]+)', 1)), '')"
_PROSE = rf"""{LINES}, f AS (SELECT *, sum(CAST(regexp_matches(text, '{FENCE}') AS INT)) OVER (PARTITION BY repo, path ORDER BY line ROWS UNBOUNDED PRECEDING) % 2 = 1 AS fenced, regexp_matches(text, '{FENCE}') AS is_fence FROM ln WHERE ext IN ('md', 'txt')),
h AS (SELECT *, {_HOST} AS host FROM f WHERE NOT fenced AND NOT is_fence AND NOT regexp_matches(text, '[\w.]+@[\w.]+\.\w+')),
s AS (SELECT *, CASE WHEN regexp_matches(text, '{C.VERB}') AND regexp_matches(text, '{C.SENSITIVE}') AND host IS NOT NULL THEN 'high' WHEN regexp_matches(text, '{C.VERB}') AND host IS NOT NULL AND host NOT IN {C.SAFE_HOSTS} THEN 'medium' END AS severity FROM h)
SELECT repo, path, line, 'prose-imperative' AS category, severity, '' AS detail FROM s WHERE severity IS NOT NULL"""
_WORKFLOW = f"""{LINES}, f AS (SELECT repo, path, {_flag('(pull_request_target|issue_comment|workflow_run)', 'untrusted')}, {_flag(r'secrets[.]', 'secrets')}, {_flag('(?i)(claude|copilot|gpt|agent).*action', 'agentic')},
{_flag('(contents: write|write-all)', 'w')}, {_flag('workflow_dispatch', 'dispatch')}, {_flag('actions/cache', 'cache')}, {_flag('id-token: write', 'id_token')}, {_flag('(curl|wget|https?://)', 'ext_')} FROM ln WHERE ext IN ('yml', 'yaml') GROUP BY ALL)
SELECT repo, path, 'untrusted-trigger-with-secrets' AS category, CASE WHEN ext_ OR agentic THEN 'critical' ELSE 'high' END AS severity, '' AS detail FROM f WHERE untrusted AND secrets
UNION ALL SELECT repo, path, 'zombie-workflow', 'high', '' FROM f WHERE dispatch AND NOT untrusted AND w UNION ALL SELECT repo, path, 'untrusted-cache-write', 'high', '' FROM f WHERE untrusted AND (cache OR id_token)
UNION ALL SELECT repo, path, 'untrusted-trigger-with-write', 'high', '' FROM f WHERE untrusted AND w"""
_S = "[[:space:]]*"
_NPMRC = f"""{LINES}, f AS (SELECT repo, path, {_flag(f'^{_S}(registry|strict-ssl|ignore-scripts|package-lock){_S}=', 'is_cfg')}, {_flag(f'strict-ssl{_S}={_S}false', 'ssl')}, {_flag(f'package-lock{_S}={_S}false', 'nolock')}, {_flag(f'^{_S}git{_S}=', 'git')},
{_flag(f'dangerouslyAllowAllBuilds:{_S}true', 'builds')}, {_flag(f'ignore-scripts{_S}={_S}true', 'ign')}, {_flag(r'min(imum)?-release-age', 'age')} FROM ln GROUP BY repo, path),
k AS (SELECT repo, path, unnest([CASE WHEN ssl THEN 'ssl-off:critical' END, CASE WHEN nolock THEN 'no-lockfile:high' END, CASE WHEN git THEN 'git-override:critical' END, CASE WHEN builds THEN 'all-builds:critical' END,
CASE WHEN NOT ign THEN 'scripts-allowed:medium' END, CASE WHEN NOT age THEN 'no-release-age:low' END]) AS k FROM f WHERE is_cfg)
SELECT repo, path, split_part(k, ':', 1) AS category, split_part(k, ':', 2) AS severity, '' AS detail FROM k WHERE k IS NOT NULL"""
_ACTIONS = rf"""{LINES}, u AS (SELECT repo, path, line, lower(regexp_extract(text, '{C.ACTION}', 1)) AS action, regexp_extract(text, '{C.ACTION}', 2) AS ref FROM ln),
h AS (SELECT DISTINCT u.*, EXISTS (SELECT 1 FROM bad_actions a WHERE a.action = u.action AND bad_ref IN ('*', ref)) AS hit FROM u WHERE action <> '')
SELECT repo, path, line, CASE WHEN hit THEN 'compromised-action' ELSE 'unpinned-action' END AS category, CASE WHEN hit THEN 'critical' ELSE 'medium' END AS severity, action || '@' || ref AS detail
FROM h WHERE hit OR NOT regexp_matches(ref, '^[0-9a-f]{{40}}$')"""
_IOCS = rf"""{LINES}, c AS (SELECT DISTINCT repo, path, line, unnest(regexp_extract_all(lower(text), '([a-z0-9][a-z0-9.-]*\.[a-z0-9-]+|[0-9a-f]{{32,64}})', 1)) AS value FROM ln)
SELECT repo, path, line, 'known-ioc' AS category, 'critical' AS severity, kind || ' ' || value AS detail FROM (
SELECT repo, path, line, kind, value FROM c JOIN iocs USING (value) WHERE kind IN ('domain', 'c2_ip', 'hash') UNION SELECT repo, path, line, kind, value FROM ln JOIN iocs ON contains(text, value) WHERE kind IN ('path', 'pth_file'))"""
_SPECS = rf"""{_DECLARED}, sp AS (SELECT *, CASE WHEN regexp_matches(spec, '^git(\+|:)|^github:') THEN 'git-dependency:high' WHEN regexp_matches(spec, '^https?://') THEN 'http-dependency:critical' WHEN starts_with(spec, 'file:') THEN 'file-dependency:medium'
WHEN regexp_matches(spec, '#[0-9a-f]{{40}}$') THEN 'orphan-commit:high' END AS k FROM md)
SELECT repo, path, split_part(k, ':', 1) AS category, split_part(k, ':', 2) AS severity, name || ' ' || spec AS detail FROM sp WHERE k IS NOT NULL"""
_BAIT = rf"{_DECLARED} SELECT repo, path, 'llmo-suspicious' AS category, 'high' AS severity, name AS detail FROM md WHERE regexp_matches(lower(name), '(^|[-_])(ai|gpt|llm|agent|copilot|chatbot|rag|mcp)([-_]|$)')"
_FRESH = f"""{_DECLARED}, n AS (SELECT max(published) AS t FROM feed_v), r AS (SELECT *, lag(maintainer) OVER w AS prev, count(*) OVER (PARTITION BY package) AS n_versions FROM feed_v WHERE package IN (SELECT name FROM md) WINDOW w AS (PARTITION BY package ORDER BY published, version, maintainer)),
l AS (SELECT *, date_diff('second', CAST(published AS TIMESTAMP), CAST(t AS TIMESTAMP)) / 3600.0 AS hrs FROM r, n QUALIFY row_number() OVER (PARTITION BY package ORDER BY published DESC, version DESC, maintainer DESC) = 1),
k AS (SELECT package, unnest([CASE WHEN hrs >= 0 AND hrs < 24 THEN 'freshness-new-release:high' END, CASE WHEN hrs >= 24 AND hrs < 168 THEN 'freshness-recent-release:medium' END, CASE WHEN n_versions = 1 AND hrs >= 0 AND hrs < 720 THEN 'freshness-brand-new-package:high' END,
CASE WHEN prev <> maintainer THEN 'maintainer-changed:high' END]) AS k FROM l)
SELECT repo, path, split_part(k, ':', 1) AS category, split_part(k, ':', 2) AS severity, package AS detail FROM k JOIN md ON name = package WHERE k IS NOT NULL"""
_PHANTOM = rf"""{_DECLARED}, known AS (SELECT repo, name FROM md UNION SELECT repo, unnest(regexp_extract_all(regexp_extract(content, 'install_requires\s*=\s*\[([^\]]*)\]', 1), '[''"]([A-Za-z0-9_.-]+)', 1)) FROM code_v WHERE ext = 'py'), im AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(content, '(?m)^(?:import|from)\s+([A-Za-z_]\w*)', 1)) AS name FROM code_v WHERE ext = 'py')
SELECT repo, path, 'phantom-dependency' AS category, 'high' AS severity, name AS detail FROM im WHERE repo IN (SELECT repo FROM known) AND (repo, name) NOT IN (SELECT repo, name FROM known) AND name NOT IN {BUILTINS}"""
_LOCKED = r"""d AS (SELECT *, lower(regexp_extract(resolved_url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([A-Za-z0-9.-]+)', 1)) AS host FROM deps_v),
k AS (SELECT repo, file AS path, name, version, unnest([CASE WHEN starts_with(resolved_url, 'http://') THEN 'insecure-protocol' END, CASE WHEN integrity IS NULL THEN 'missing-integrity' END,
CASE WHEN host <> '' AND NOT EXISTS (SELECT 1 FROM trusted t WHERE d.host = t.host OR ends_with(d.host, '.' || t.host)) THEN 'untrusted-registry' END]) AS category FROM d)
SELECT repo, path, category, CASE category WHEN 'missing-integrity' THEN 'medium' ELSE 'high' END AS severity, name || ' ' || version AS detail FROM k WHERE category IS NOT NULL"""


def _of_files(name: str) -> Callable[[Inputs], DataFrame]:
    return lambda x: DETECTORS[name](x.files)


_PREFIX = {
    "c09_tool_metadata": ("tool_metadata", "Tool metadata: "), "c11_server_config": ("server_start", "Server start: "), "c27_frontmatter": ("frontmatter", "Frontmatter: "), "c28_tool_schema": ("tool_schema", "Tool schema: "),
    "c32_plugin_manifest": ("plugin_manifest", "Plugin manifest: "), "c35_install_hooks": ("lifecycle", "Install hook: "), "c36_command_jacking": ("command_jacking", "Shadows system command: "),
    "c38_setup_py": ("lifecycle", "setup.py: "), "c39_pth": ("pth", "Start-up .pth file: "), "c40_persistence": ("agent_settings", "Tool persistence: "), "c47_devcontainer": ("devcontainer", "Dev container: "),
    "c48_entrypoint": ("entrypoint", "Script tail: "), "c58_manifest_confusion": ("manifest_drift", "Manifest drift: "), "c59_behavior_signals": ("lifecycle", "Install script: "),
}

#: What they read where that is not JSON.
_READS = {
    "c09_tool_metadata": ("metadata",), "c27_frontmatter": ("frontmatter",), "c36_command_jacking": ("json", "scripts"), "c38_setup_py": ("setup",), "c39_pth": ("line",), "c48_entrypoint": (),
}
_RUNS = {"c39_pth": _pth, "c58_manifest_confusion": _confusion}

#: Detectors with an equivalent in SQL.
STRUCTURED: tuple[Detector, ...] = tuple(Detector(s, p, _RUNS.get(n) or _of_files(n), DETECTOR_SQL[n], _READS.get(n, ("json",))) for n, (s, p) in _PREFIX.items()) + (
    Detector("unicode", "Hidden characters: ", _unicode, _unicode_sql(), ("unicode",)), Detector("prose", "Order in prose: ", _prose, _PROSE, ("line",)), Detector("infra", "Workflow: ", _workflow, _WORKFLOW, ("line",)),
    Detector("npmrc", "npmrc setting: ", _npmrc, _NPMRC, ("line",)), Detector("infra", "Action: ", _actions, _ACTIONS, ("line",)), Detector("ioc", "Indicator: ", _iocs, _IOCS, ("ioc",)),
    Detector("dependencies", "Dependency: ", _specs, _SPECS, ("json",)), Detector("dependencies", "Dependency: ", _bait, _BAIT, ("json",)), Detector("dependencies", "Dependency: ", _fresh, _FRESH, ("json",)),
    Detector("dependencies", "Dependency: ", _phantom, _PHANTOM, ("json", "imports")), Detector("lockfile", "Lockfile: ", _locked, _LOCKED),
)

#: Detectors that decode or measure, which SQL cannot express; those that read syntax trees are in ``SOURCE``.
PARSED: tuple[Detector, ...] = (
    Detector("taint", "Flow to a sink: ", _taint, None, ("taint",)), Detector("decoder", "Decoded text: ", _decoded, None, ("blob",)), Detector("splitstream", "Split payload: ", _split), Detector("entropy", "Dense text: ", _dense),
)

#: Scanner and title prefix of each scan of the one parse of Python files.
SOURCE = {"ast": ("py_ast", "Syntax tree: "), "dynamism": ("runtime_dynamism", "Syntax tree: "), "entry": ("entrypoint", "Import time: "), "fallback": ("manifest_drift", "Syntax tree: ")}


def source_findings(files: DataFrame) -> DataFrame:
    """Findings of all scans of Python files, and of what their decode calls decode, from one staged parse."""
    rows = stage(S.parse_python(files), "python-source")
    parts = [as_findings(S.of_scan(rows, scan).withColumn("detail", F.lit("")), scanner, prefix) for scan, (scanner, prefix) in SOURCE.items()]
    return union_findings(*parts, as_findings(_ladder(S.decoded_arguments(rows)), "decoder", "Decoded text: "))


def detect(inputs: Inputs, detectors: tuple[Detector, ...] = STRUCTURED + PARSED) -> DataFrame:
    """Findings of all detectors over the same inputs; with any of PARSED, those of Python files too."""
    of = narrowed(inputs, detectors)
    found = [as_findings(d.run(of(d)), d.scanner, d.prefix) for d in detectors]
    return union_findings(*found, *([source_findings(inputs.files)] if any(d in PARSED for d in detectors) else []))


def detect_oracle(detectors: tuple[Detector, ...] = STRUCTURED) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({as_findings_sql(d)})" for d in detectors)
