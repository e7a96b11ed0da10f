"""Hooks in settings, executable configuration files, and plugin paths that a script writes into settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Extensions of configuration and documents, settings files, and what is dangerous in a hook.
CONFIG_EXTENSIONS = ("json", "md", "txt", "yml", "yaml", "toml", "ini", "cfg")
OWN_PATH = r"Path\s*\(\s*__file__\s*\)\s*\.resolve\s*\(|os\.path\.(abspath|realpath)\s*\(\s*__file__\s*\)"
SETTINGS = r"settings(\.local)?\.json|claude_desktop_config\.json"
PLUGIN_ROOT = "CLAUDE_PLUGIN_ROOT"
DANGEROUS = r"(?i)curl|wget|bash -c|eval|base64|/dev/tcp"
HOOKS = "hooks map<string,array<struct<command:string>>>"


def scan_integrity(files: DataFrame) -> DataFrame:
    """C69 over files(repo, path, ext, content, mode): repo, path, category, severity, detail.

    ``mode`` holds the permission bits (null: unknown). Each registered hook counts, and again where its command is dangerous;
    content that does not parse has none.
    """
    found = lambda category, severity, detail: F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), detail.alias("detail"))
    once = F.array(
        F.when(F.col("ext").isin(*CONFIG_EXTENSIONS) & (F.col("mode").bitwiseAND(0o111) != 0), found("permission-anomaly", "high", F.concat(F.lit("mode "), F.conv(F.col("mode").cast("string"), 10, 8)))),
        F.when((F.col("ext") == "py") & F.col("content").rlike(OWN_PATH) & F.col("content").rlike(SETTINGS) & ~F.contains("content", F.lit(PLUGIN_ROOT)), found("hardcoded-plugin-path", "high", F.lit("own path and settings"))),
    )
    hooks = F.filter(
        F.flatten(F.transform(F.map_entries(F.from_json(F.when(F.col("ext") == "json", F.col("content")), HOOKS)["hooks"]), lambda e: F.transform(e["value"], lambda h: F.struct(e["key"].alias("event"), h["command"].alias("command"))))),
        lambda h: h["command"] != "",
    )
    named = lambda h: F.concat_ws(" ", h["event"], h["command"])
    plain = F.transform(hooks, lambda h: found("hook-configuration", "high", named(h)))
    bad = F.transform(F.filter(hooks, lambda h: h["command"].rlike(DANGEROUS)), lambda h: found("hook-dangerous", "critical", named(h)))
    none = F.array().cast("array<struct<category:string,severity:string,detail:string>>")
    every = F.concat(F.filter(once, lambda x: x.isNotNull()), F.coalesce(plain, none), F.coalesce(bad, none))
    return files.select("repo", "path", F.explode(every).alias("f")).select("repo", "path", "f.*")


#: The same for DuckDB over moded(repo, path, ext, content, mode).
INTEGRITY_SQL = rf"""hk AS (SELECT repo, path, event, json_extract_string(h, '$.command') AS command FROM (
  SELECT repo, path, event, unnest(TRY_CAST(json_extract(j, '$.hooks."' || event || '"') AS JSON[])) AS h FROM (SELECT repo, path, j, unnest(json_keys(j, '$.hooks')) AS event FROM (SELECT repo, path, TRY_CAST(content AS JSON) AS j FROM moded WHERE ext = 'json')))),
hc AS (SELECT * FROM hk WHERE command <> '')
SELECT repo, path, 'permission-anomaly' AS category, 'high' AS severity, 'mode ' || printf('%o', mode) AS detail FROM moded WHERE ext IN {CONFIG_EXTENSIONS} AND mode & 73 <> 0
UNION ALL SELECT repo, path, 'hardcoded-plugin-path', 'high', 'own path and settings' FROM moded WHERE ext = 'py' AND regexp_matches(content, '{OWN_PATH}') AND regexp_matches(content, '{SETTINGS}') AND NOT contains(content, '{PLUGIN_ROOT}')
UNION ALL SELECT repo, path, 'hook-configuration', 'high', event || ' ' || command FROM hc UNION ALL SELECT repo, path, 'hook-dangerous', 'critical', event || ' ' || command FROM hc WHERE regexp_matches(command, '{DANGEROUS}')"""
