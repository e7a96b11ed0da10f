"""Detectors over manifests, settings and other structured files.

Each returns (repo, path, category, severity, detail). JSON is read through declared
schemas or as VARIANT; a file that is not what a detector reads yields nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_guard.functions.scalars import entropy
from corpus_guard.operators.lines import tail_lines, to_lines

INJECTION = r"(?i)(ignore (all )?(previous|prior)|do not tell the user|must always|never mention)"
NETWORK = r"(curl|wget|https?://|fetch\(|\bnc\b)"
SHADOWED = ("ls", "cat", "git", "node", "npm", "python", "python3", "pip", "ssh", "sudo", "curl", "bash", "sh", "docker", "make")


def _hit(category: str | Column, severity: str | Column, detail: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(category).alias("category"), lit(severity).alias("severity"), F.substring(detail, 1, 120).alias("detail"))


def _out(df: DataFrame, *hits: Column) -> DataFrame:
    return df.select("repo", "path", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h")).select("repo", "path", "h.*")


def scan_tool_metadata(files: DataFrame) -> DataFrame:
    """Description, title, summary and name fields: a keyword, an imperative, or a verb with a URL; the first that hits."""
    fields = F.regexp_extract_all("content", F.lit(r"(?i)[\"']?(?:description|title|summary|name)[\"']?\s*[:=]\s*[\"']([^\"'\n]{4,400})[\"']"), 1)
    t = F.col("text")
    kind = (
        F.when(t.rlike(r"(?i)<(important|system)>|ignore previous"), "poisoned-keyword:critical").when(t.rlike(r"(?i)(must (always|never)|do not tell|before using)"), "poisoned-imperative:critical")
        .when(t.rlike(r"(?i)(send|post|upload|fetch).*https?://"), "poisoned-exfiltration:critical")
    )
    return files.select("repo", "path", F.explode(fields).alias("text")).withColumn("k", kind).where("k is not null").select(
        "repo", "path", F.split_part("k", F.lit(":"), F.lit(1)).alias("category"), F.split_part("k", F.lit(":"), F.lit(2)).alias("severity"), F.substring("text", 1, 120).alias("detail")
    )


_SERVER = "map<string,struct<command:string,args:array<string>,env:map<string,string>,url:string>>"


def scan_server_config(files: DataFrame) -> DataFrame:
    """C11: servers of a configuration: variables that load code, inline programs, payload calls, inline URLs."""
    j = files.withColumn("j", F.from_json("content", f"mcpServers {_SERVER}, servers {_SERVER}"))
    s = j.select("repo", "path", F.explode(F.map_concat(*[F.coalesce(f"j.{k}", F.create_map().cast(_SERVER)) for k in ("mcpServers", "servers")])).alias("name", "s"))
    args = F.array_join(F.coalesce("s.args", F.array().cast("array<string>")), " ")
    env = F.coalesce(F.map_keys("s.env"), F.array().cast("array<string>"))
    return _out(
        s, F.when(F.arrays_overlap(env, F.array(*map(F.lit, ("NODE_OPTIONS", "LD_PRELOAD", "PYTHONSTARTUP", "DYLD_INSERT_LIBRARIES")))), _hit("dangerous-env", "critical", F.col("name"))),
        F.when(F.arrays_overlap(F.coalesce("s.args", F.array().cast("array<string>")), F.array(F.lit("-e"), F.lit("-c"), F.lit("--eval"))), _hit("inline-exec", "critical", args)),
        F.when(args.rlike(r"(eval|exec|\|\s*(ba)?sh)"), _hit("payload-call", "critical", args)), F.when(args.rlike("https?://"), _hit("inline-url", "high", args)),
    )


def scan_frontmatter(files: DataFrame) -> DataFrame:
    """The leading block of a document: no name, no author, broad trigger, injected description."""
    block = F.regexp_extract("content", r"(?s)^\s*---\n(.*?)\n---", 1)
    f = files.where(F.col("ext") == "md").withColumn("b", block).where("b <> ''")
    return _out(
        f, F.when(~F.col("b").rlike(r"(?m)^name:\s*\S"), _hit("frontmatter-no-name", "medium", F.col("b"))), F.when(~F.col("b").rlike(r"(?m)^author:\s*\S"), _hit("frontmatter-no-author", "low", F.col("b"))),
        F.when(F.col("b").rlike(r"(?i)(for everything|any request|always use)"), _hit("frontmatter-broad-trigger", "high", F.col("b"))), F.when(F.col("b").rlike(INJECTION), _hit("frontmatter-injection", "critical", F.col("b"))),
    )


def scan_tool_schema(files: DataFrame) -> DataFrame:
    """Tools of a JSON array: injection in their text, inputs that ask for credentials."""
    schema = "array<struct<name:string,description:string,title:string,summary:string,inputSchema:struct<properties:map<string,string>>>>"
    t = files.select("repo", "path", F.explode(F.from_json("content", schema)).alias("t"))
    text = F.concat_ws(" ", "t.name", "t.description", "t.title", "t.summary")
    keys = F.array_join(F.coalesce(F.map_keys("t.inputSchema.properties"), F.array().cast("array<string>")), ",")
    return _out(t, F.when(text.rlike(INJECTION), _hit("tool-poisoning", "critical", text)), F.when(keys.rlike(r"(?i)(api_?key|token|password|secret)"), _hit("credential-input", "high", keys)))


def scan_plugin_manifest(files: DataFrame) -> DataFrame:
    """JSON objects with a name: no id, no schema, injected text."""
    v = F.try_parse_json("content")
    f = files.where(F.col("ext") == "json").withColumn("v", v).where("v is not null").withColumn("name", F.try_variant_get("v", "$.name", "string")).where("name is not null")
    get = lambda p: F.try_variant_get("v", p, "string")
    return _out(f, F.when(get("$.id").isNull(), _hit("manifest-no-id", "medium", F.col("name"))), F.when(get("$['$schema']").isNull(), _hit("manifest-no-schema", "low", F.col("name"))), F.when(get("$.description").rlike(INJECTION), _hit("manifest-injection", "critical", get("$.description"))))


def _scripts(files: DataFrame) -> DataFrame:
    j = files.where(F.col("ext") == "json").withColumn("j", F.from_json("content", "scripts map<string,string>"))
    return j.select("repo", "path", F.explode("j.scripts").alias("hook", "command"))


HOOKS = ("preinstall", "install", "postinstall", "prepare", "prepublish")
KNOWN_SAFE = r"^(husky( install)?|tsc|node-gyp rebuild|patch-package|npm run build)\s*$"


def scan_hooks(files: DataFrame) -> DataFrame:
    """Install hooks: suspicious, relaying to a file, known and safe, or just present; the first that holds."""
    c = F.col("command")
    kind = F.when(c.rlike(NETWORK) | c.rlike(r"(eval|base64|\|\s*sh)"), "hook-suspicious:critical").when(c.rlike(r"^\s*node\s+\S+\.js"), "hook-relay:high").when(c.rlike(KNOWN_SAFE), "hook-known:low").otherwise("hook-present:medium")
    return _scripts(files).where(F.col("hook").isin(*HOOKS)).select("repo", "path", F.split_part(kind, F.lit(":"), F.lit(1)).alias("category"), F.split_part(kind, F.lit(":"), F.lit(2)).alias("severity"), F.substring(F.concat_ws(" ", "hook", "command"), 1, 120).alias("detail"))


def scan_command_jacking(files: DataFrame) -> DataFrame:
    """Declared commands, of package bins and of console scripts, that shadow a system command."""
    bins = files.withColumn("j", F.from_json("content", "bin map<string,string>")).select("repo", "path", F.explode(F.map_keys("j.bin")).alias("name"))
    scripts = files.where(F.col("content").rlike("(console_scripts|scripts)")).select("repo", "path", F.explode(F.regexp_extract_all("content", F.lit(r"[{\['\"\s]([a-z0-9_-]+)\s*=\s*['\"]?[\w.]+:\w+"), 1)).alias("name"))
    return bins.union(scripts).where(F.col("name").isin(*SHADOWED)).distinct().select("repo", "path", F.lit("command-jacking").alias("category"), F.lit("critical").alias("severity"), F.col("name").alias("detail"))


def scan_setup_py(files: DataFrame) -> DataFrame:
    """Set-up programs with command classes, network or shell calls."""
    f = files.where((F.col("ext") == "py") & F.col("content").rlike(r"\bsetup\s*\("))
    c, calls = F.col("content"), r"(os\.system|subprocess|urlopen|requests\.)"
    # the first line that calls; a pattern for the whole line is tried from every character of the lines before it
    line = F.get(F.filter(F.split(c, "\n", -1), lambda x: x.rlike(calls)), F.lit(0))
    return _out(f, F.when(c.rlike("cmdclass"), _hit("setup-cmdclass", "high", F.regexp_extract(c, r"(cmdclass[^\n]*)", 1))), F.when(c.rlike(calls), _hit("setup-exec", "critical", line)))


PTH = r"^import\s+\S+\s*;"


def scan_pth(files: DataFrame, known: DataFrame | None = None, lines: DataFrame | None = None) -> DataFrame:
    """Start-up lines (import with a statement on the same line): base64, execution, plain import; known file names by a join."""
    lines = (to_lines(files) if lines is None else lines).where(F.col("text").rlike(PTH))
    kind = F.when(F.col("text").rlike("(b64decode|base64)"), "pth-encoded:critical").when(F.col("text").rlike(r"(exec|eval|os\.system|subprocess)"), "pth-exec:critical").otherwise("pth-import:high")
    out = lines.select("repo", "path", F.split_part(kind, F.lit(":"), F.lit(1)).alias("category"), F.split_part(kind, F.lit(":"), F.lit(2)).alias("severity"), F.substring("text", 1, 120).alias("detail"))
    if known is not None:
        out = out.unionByName(files.join(known, "base", "left_semi").select("repo", "path", F.lit("pth-known").alias("category"), F.lit("critical").alias("severity"), F.col("base").alias("detail")))
    return out


def scan_persistence(files: DataFrame) -> DataFrame:
    """Hooks of agent settings and tasks that run when a folder opens."""
    j = files.withColumn("j", F.from_json("content", "hooks map<string,array<struct<command:string>>>, tasks array<struct<label:string,command:string,runOptions:struct<runOn:string>>>, dangerouslySkipPermissions boolean"))
    hooks = j.select("repo", "path", F.explode("j.hooks").alias("event", "hs")).select("repo", "path", "event", F.explode("hs.command").alias("command"))
    tasks = j.select("repo", "path", F.explode("j.tasks").alias("t")).where("t.runOptions.runOn = 'folderOpen'")
    skip = j.where("j.dangerouslySkipPermissions")
    out = _out(hooks, _hit("ai-tool-persistence", F.when(F.col("command").rlike(NETWORK), F.lit("critical")).otherwise(F.lit("high")), F.concat_ws(" ", "event", "command")))
    out = out.unionByName(_out(tasks, _hit("folder-open-task", "high", F.col("t.command"))))
    return out.unionByName(_out(skip, _hit("permissions-skipped", "critical", F.lit("dangerouslySkipPermissions"))))


def scan_devcontainer(files: DataFrame) -> DataFrame:
    """Mounts of secrets and sockets, privileges, host variables, lifecycle commands and features of a dev container."""
    schema = "mounts array<string>, runArgs array<string>, containerEnv map<string,string>, remoteEnv map<string,string>, postCreateCommand string, postStartCommand string, features map<string,string>"
    j = files.withColumn("j", F.from_json("content", schema)).select("repo", "path", "j.*")
    join = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    mounts, args, life = join("mounts"), join("runArgs"), F.concat_ws(" ", "postCreateCommand", "postStartCommand")
    env = F.array_join(F.map_values(F.map_concat(*[F.coalesce(c, F.create_map().cast("map<string,string>")) for c in ("containerEnv", "remoteEnv")])), " ")
    feats = F.array_join(F.coalesce(F.map_keys("features"), F.array().cast("array<string>")), " ")
    return _out(
        j, F.when(mounts.rlike(r"\.(ssh|aws|kube|gnupg|netrc)"), _hit("host-secret-exposure", "critical", mounts)), F.when(mounts.rlike(r"docker\.sock"), _hit("docker-socket", "critical", mounts)),
        F.when(args.rlike("--privileged"), _hit("privileged", "critical", args)), F.when(args.rlike("SYS_ADMIN"), _hit("sys-admin", "high", args)), F.when(env.rlike(r"\$\{localEnv:"), _hit("pulls-host-secret", "high", env)),
        F.when(life.rlike(r"(curl|wget)"), _hit("lifecycle-fetch", "high", life)), F.when(feats.rlike(r"(^| )(?!ghcr\.io/devcontainers)\S"), _hit("untrusted-feature", "medium", feats)),
    )


def scan_entrypoint(files: DataFrame) -> DataFrame:
    """Script tails: a self-calling function in the last lines, exports set again near the end, high entropy in the last ten lines."""
    t = tail_lines(to_lines(files.where(F.col("ext").isin("js", "ts")), long="keep"), 0.3, 50).where("in_tail or past_80 or in_last_ten").withColumn("bits", entropy("text"))
    text, bits = F.col("text"), F.col("bits")
    return _out(
        t, F.when(F.col("in_tail") & text.rlike(r"^\s*[;!]?\(?(async\s+)?(function\s*\(|\(\s*\)\s*=>)"), _hit("entrypoint-iife", F.when(text.rlike(NETWORK), F.lit("critical")).otherwise(F.lit("high")), text)),
        F.when(F.col("past_80") & text.rlike(r"^\s*module\.exports\s*="), _hit("entrypoint-export", "high", text)),
        F.when(F.col("in_last_ten") & (F.length("text") >= 50) & (bits > 4.5), _hit("entrypoint-entropy", "medium", text)),
    )


def manifest_confusion(files: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Scripts of a manifest that name a file its repo lacks, among these or among ``every`` file."""
    refs = _scripts(files).withColumn("ref", F.regexp_extract("command", r"(?:node|python|sh|bash)\s+(?:\./)?([\w./-]+\.(?:js|py|sh))", 1)).where("ref <> ''")
    have = (files if every is None else every).select("repo", F.col("base").alias("ref")).distinct()
    return refs.join(have, ["repo", "ref"], "left_anti").select("repo", "path", F.lit("missing-script").alias("category"), F.lit("high").alias("severity"), F.col("ref").alias("detail"))


def behavior_signals(files: DataFrame) -> DataFrame:
    """What scripts do together: network and file writes, long and dense text, download and execution."""
    s = _scripts(files).withColumn("bits", entropy("command"))
    c = F.col("command")
    return _out(
        s, F.when(c.rlike(NETWORK) & c.rlike(r"(>|tee|writeFile)"), _hit("network-and-write", "high", c)), F.when((F.length(c) > 60) & (F.col("bits") > 4.5), _hit("dense-script", "medium", c)),
        F.when(c.rlike(r"(curl|wget)") & c.rlike(r"(sh|node|python|chmod)"), _hit("download-and-run", "critical", c)),
    )


DETECTORS = {
    "c09_tool_metadata": scan_tool_metadata, "c11_server_config": scan_server_config, "c27_frontmatter": scan_frontmatter, "c28_tool_schema": scan_tool_schema, "c32_plugin_manifest": scan_plugin_manifest,
    "c35_install_hooks": scan_hooks, "c36_command_jacking": scan_command_jacking, "c38_setup_py": scan_setup_py, "c39_pth": scan_pth, "c40_persistence": scan_persistence, "c47_devcontainer": scan_devcontainer,
    "c48_entrypoint": scan_entrypoint, "c58_manifest_confusion": manifest_confusion, "c59_behavior_signals": behavior_signals,
}
