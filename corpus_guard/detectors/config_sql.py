"""DuckDB SQL of the detectors over structured files: (repo, path, category, severity, detail) over ``code_v``."""

from __future__ import annotations

from corpus_guard.detectors.config_files import HOOKS, INJECTION, KNOWN_SAFE, NETWORK, SHADOWED
from corpus_guard.schema import MAX_LINE

#: Files that are JSON objects, as j.
JS = "js AS (SELECT repo, path, base, ext, j FROM (SELECT *, TRY_CAST(content AS JSON) AS j FROM code_v) WHERE j IS NOT NULL AND json_type(j) = 'OBJECT')"
SCRIPTS = f"{JS}, sc AS (SELECT repo, path, hook, json_extract_string(j, '$.scripts.\"' || hook || '\"') AS command FROM (SELECT *, unnest(json_keys(j, '$.scripts')) AS hook FROM js WHERE ext = 'json'))"
LINES = f"ln AS (SELECT repo, path, ext, substring(x, 1, {MAX_LINE}) AS text, line FROM (SELECT repo, path, ext, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM code_v))"
OUT = "repo, path, category, severity, substring(detail, 1, 120) AS detail"


def hits(source: str, *arms: tuple[str, str, str, str]) -> str:
    """One row per (category, severity, detail, condition) that holds for a row of ``source``; all are SQL expressions."""
    return " UNION ALL ".join(f"SELECT repo, path, {c} AS category, {s} AS severity, substring({d}, 1, 120) AS detail FROM {source} WHERE {w}" for c, s, d, w in arms)


def kinds(source: str, case: str, detail: str) -> str:
    """Rows of ``source`` with 'category:severity' by a CASE."""
    return f"SELECT repo, path, split_part(k, ':', 1) AS category, split_part(k, ':', 2) AS severity, substring({detail}, 1, 120) AS detail FROM (SELECT *, {case} AS k FROM {source}) WHERE k IS NOT NULL"


def _m(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, '{pattern.replace(chr(39), chr(39) * 2)}')"


BITS = "list_aggregate(string_split({0}, ''), 'entropy')"
_FIELD = r"(?i)[\"'']?(?:description|title|summary|name)[\"'']?\s*[:=]\s*[\"'']([^\"''\n]{4,400})[\"'']"
_SERVERS = f"{JS}, sv AS (SELECT repo, path, name, json_extract(j, '$.' || kk || '.\"' || name || '\"') AS s FROM (SELECT *, unnest(json_keys(j, '$.' || kk)) AS name FROM js, (VALUES ('mcpServers'), ('servers')) t(kk))), sa AS (SELECT *, s->>'$.args[*]' AS args, array_to_string(s->>'$.args[*]', ' ') AS a, json_keys(s, '$.env') AS env FROM sv)"
_TOOLS = """tl AS (SELECT repo, path, unnest(CASE json_type(j) WHEN 'ARRAY' THEN CAST(j AS JSON[]) ELSE [j] END) AS t FROM (SELECT repo, path, TRY_CAST(content AS JSON) AS j FROM code_v) WHERE json_type(j) IN ('ARRAY', 'OBJECT')),
tt AS (SELECT repo, path, concat_ws(' ', t->>'name', t->>'description', t->>'title', t->>'summary') AS text, array_to_string(json_keys(t, '$.inputSchema.properties'), ',') AS keys FROM tl WHERE json_type(t) = 'OBJECT')"""
_DEV = f"""{JS}, dv AS (SELECT repo, path, array_to_string(j->>'$.mounts[*]', ' ') AS mounts, array_to_string(j->>'$.runArgs[*]', ' ') AS args, concat_ws(' ', j->>'postCreateCommand', j->>'postStartCommand') AS life,
  array_to_string(list_concat(j->>'$.containerEnv.*', j->>'$.remoteEnv.*'), ' ') AS env, array_to_string(json_keys(j, '$.features'), ' ') AS feats FROM js)"""
_TAIL = f"""{LINES.replace('substring(x, 1, ' + str(MAX_LINE) + ')', 'x')}, nl AS (SELECT *, count(*) OVER (PARTITION BY repo, path) AS n FROM ln WHERE ext IN ('js', 'ts')),
tn AS (SELECT *, line > n - greatest(50, CAST(floor(n * 0.3) AS INT)) AS in_tail, line > n - 10 AS last_ten, line > n * 0.8 AS past_80 FROM nl)"""

DETECTOR_SQL: dict[str, str] = {
    "c09_tool_metadata": ", f AS (SELECT repo, path, unnest(regexp_extract_all(content, '" + _FIELD + "', 1)) AS text FROM code_v) "
    + kinds("f", f"CASE WHEN {_m('text', '(?i)<(important|system)>|ignore previous')} THEN 'poisoned-keyword:critical' WHEN {_m('text', '(?i)(must (always|never)|do not tell|before using)')} THEN 'poisoned-imperative:critical' WHEN {_m('text', '(?i)(send|post|upload|fetch).*https?://')} THEN 'poisoned-exfiltration:critical' END", "text"),
    "c11_server_config": f", {_SERVERS} "
    + hits(
        "sa", ("'dangerous-env'", "'critical'", "name", "list_has_any(env, ['NODE_OPTIONS', 'LD_PRELOAD', 'PYTHONSTARTUP', 'DYLD_INSERT_LIBRARIES'])"), ("'inline-exec'", "'critical'", "a", "list_has_any(args, ['-e', '-c', '--eval'])"),
        ("'payload-call'", "'critical'", "a", _m("a", r"(eval|exec|\|\s*(ba)?sh)")), ("'inline-url'", "'high'", "a", _m("a", "https?://")),
    ),
    "c27_frontmatter": r", b AS (SELECT repo, path, regexp_extract(content, '(?s)^\s*---\n(.*?)\n---', 1) AS b FROM code_v WHERE ext = 'md'), f AS (SELECT * FROM b WHERE b <> '') "
    + hits(
        "f", ("'frontmatter-no-name'", "'medium'", "b", r"NOT regexp_matches(b, '(?m)^name:\s*\S')"), ("'frontmatter-no-author'", "'low'", "b", r"NOT regexp_matches(b, '(?m)^author:\s*\S')"),
        ("'frontmatter-broad-trigger'", "'high'", "b", _m("b", "(?i)(for everything|any request|always use)")), ("'frontmatter-injection'", "'critical'", "b", _m("b", INJECTION)),
    ),
    "c28_tool_schema": f", {_TOOLS} " + hits("tt", ("'tool-poisoning'", "'critical'", "text", _m("text", INJECTION)), ("'credential-input'", "'high'", "keys", _m("keys", "(?i)(api_?key|token|password|secret)"))),
    "c32_plugin_manifest": f", {JS}, pm AS (SELECT *, j->>'name' AS name FROM js WHERE ext = 'json' AND j->>'name' IS NOT NULL) "
    + hits("pm", ("'manifest-no-id'", "'medium'", "name", "j->>'id' IS NULL"), ("'manifest-no-schema'", "'low'", "name", "json_extract_string(j, '/$schema') IS NULL"), ("'manifest-injection'", "'critical'", "j->>'description'", _m("j->>'description'", INJECTION))),
    "c35_install_hooks": f", {SCRIPTS}, h AS (SELECT * FROM sc WHERE hook IN {HOOKS} AND command IS NOT NULL) "
    + kinds("h", f"CASE WHEN {_m('command', NETWORK)} OR {_m('command', r'(eval|base64|\|\s*sh)')} THEN 'hook-suspicious:critical' WHEN {_m('command', r'^\s*node\s+\S+\.js')} THEN 'hook-relay:high' WHEN {_m('command', KNOWN_SAFE)} THEN 'hook-known:low' ELSE 'hook-present:medium' END", "concat_ws(' ', hook, command)"),
    "c36_command_jacking": f""", {JS}, n AS (SELECT repo, path, unnest(json_keys(j, '$.bin')) AS name FROM js
UNION ALL SELECT repo, path, unnest(regexp_extract_all(content, '[{{\\[''\"\\s]([a-z0-9_-]+)\\s*=\\s*[''\"]?[\\w.]+:\\w+', 1)) FROM code_v WHERE regexp_matches(content, '(console_scripts|scripts)'))
SELECT DISTINCT repo, path, 'command-jacking' AS category, 'critical' AS severity, name AS detail FROM n WHERE name IN {SHADOWED}""",
    "c38_setup_py": ", f AS (SELECT * FROM code_v WHERE ext = 'py' AND " + _m("content", r"\bsetup\s*\(") + ") "
    + hits("f", ("'setup-cmdclass'", "'high'", r"regexp_extract(content, '(cmdclass[^\n]*)', 1)", _m("content", "cmdclass")), ("'setup-exec'", "'critical'", r"regexp_extract(content, '([^\n]*(?:os\.system|subprocess|urlopen|requests\.)[^\n]*)', 1)", _m("content", r"(os\.system|subprocess|urlopen|requests\.)"))),
    "c39_pth": f", {LINES}, p AS (SELECT * FROM ln WHERE {_m('text', chr(94) + r'import\s+\S+\s*;')}) "
    + kinds("p", f"CASE WHEN {_m('text', '(b64decode|base64)')} THEN 'pth-encoded:critical' WHEN {_m('text', r'(exec|eval|os\.system|subprocess)')} THEN 'pth-exec:critical' ELSE 'pth-import:high' END", "text"),
    "c40_persistence": f""", {JS}, ev AS (SELECT repo, path, event, json_extract_string(h, '$.command') AS command FROM (SELECT repo, path, event, unnest(CAST(json_extract(j, '$.hooks."' || event || '"') AS JSON[])) AS h FROM (SELECT *, unnest(json_keys(j, '$.hooks')) AS event FROM js))),
tk AS (SELECT repo, path, t FROM (SELECT repo, path, unnest(CAST(j->'tasks' AS JSON[])) AS t FROM js) WHERE json_extract_string(t, '$.runOptions.runOn') = 'folderOpen'), sk AS (SELECT * FROM js WHERE json_extract_string(j, '$.dangerouslySkipPermissions') = 'true') """
    + hits("ev", ("'ai-tool-persistence'", f"CASE WHEN {_m('command', NETWORK)} THEN 'critical' ELSE 'high' END", "concat_ws(' ', event, command)", "true"))
    + " UNION ALL " + hits("tk", ("'folder-open-task'", "'high'", "t->>'command'", "true")) + " UNION ALL " + hits("sk", ("'permissions-skipped'", "'critical'", "'dangerouslySkipPermissions'", "true")),
    "c47_devcontainer": f", {_DEV} "
    + hits(
        "dv", ("'host-secret-exposure'", "'critical'", "mounts", _m("mounts", r"\.(ssh|aws|kube|gnupg|netrc)")), ("'docker-socket'", "'critical'", "mounts", _m("mounts", r"docker\.sock")),
        ("'privileged'", "'critical'", "args", _m("args", "--privileged")), ("'sys-admin'", "'high'", "args", _m("args", "SYS_ADMIN")), ("'pulls-host-secret'", "'high'", "env", _m("env", r"\$\{localEnv:")),
        ("'lifecycle-fetch'", "'high'", "life", _m("life", "(curl|wget)")), ("'untrusted-feature'", "'medium'", "feats", "len(list_filter(string_split(feats, ' '), lambda x: x <> '' AND NOT starts_with(x, 'ghcr.io/devcontainers'))) > 0"),
    ),
    "c48_entrypoint": f", {_TAIL} "
    + hits(
        "tn", ("'entrypoint-iife'", f"CASE WHEN {_m('text', NETWORK)} THEN 'critical' ELSE 'high' END", "text", "in_tail AND " + _m("text", r"^\s*[;!]?\(?(async\s+)?(function\s*\(|\(\s*\)\s*=>)")),
        ("'entrypoint-export'", "'high'", "text", "past_80 AND " + _m("text", r"^\s*module\.exports\s*=")), ("'entrypoint-entropy'", "'medium'", "text", f"last_ten AND length(text) >= 50 AND {BITS.format('text')} > 4.5"),
    ),
    "c58_manifest_confusion": f", {SCRIPTS}, rf AS (SELECT repo, path, regexp_extract(command, '(?:node|python|sh|bash)\\s+(?:\\./)?([\\w./-]+\\.(?:js|py|sh))', 1) AS ref FROM sc) "
    + "SELECT repo, path, 'missing-script' AS category, 'high' AS severity, ref AS detail FROM rf WHERE ref <> '' AND NOT EXISTS (SELECT 1 FROM code_v c WHERE c.repo = rf.repo AND c.base = rf.ref)",
    "c59_behavior_signals": f", {SCRIPTS} "
    + hits(
        "sc", ("'network-and-write'", "'high'", "command", _m("command", NETWORK) + " AND " + _m("command", "(>|tee|writeFile)")), ("'dense-script'", "'medium'", "command", f"length(command) > 60 AND {BITS.format('command')} > 4.5"),
        ("'download-and-run'", "'critical'", "command", _m("command", "(curl|wget)") + " AND " + _m("command", "(sh|node|python|chmod)")),
    ),
}
