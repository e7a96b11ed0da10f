"""Compound findings: presence flags per file in one grouped aggregate, then boolean conditions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_guard.plans.staging import BROADCAST_ROWS, counted, stage

# The keyword sets that tags are tested against, as substrings of lower(description title category).
KEYWORDS: dict[str, tuple[str, ...]] = {
    "env": ("env access", "environ", "credential", "secret", ".env", ".ssh", ".aws", "keychain"),
    "network": ("network", "http", "fetch", "request", "post", "webhook", "curl", "wget", "exfiltration"),
    "exec": ("eval", "exec", "system", "subprocess", "code execution", "shell"),
    "encoding": ("base64", "obfuscat", "encoding", "hex string"),
    "sensitive_read": (".env", ".ssh", ".aws", "credential", "keychain", "browser data", "config"),
    "prompt_injection": ("prompt injection", "instruction override", "persona reassignment", "confirmation bypass"),
    "lifecycle": ("lifecycle", "hook", "postinstall", "preinstall", "cmdclass", "setup.py"),
    "sql": ("sql-injection", "string concatenation in execute", "sql select", "sql insert"),
    "server_poison": ("tool-poisoning", "mcp_security", "skill_threats", "prompt injection"),
    "poisoning": ("tool-poisoning", "tool shadowing", "mcp-tool-injection", "tool metadata"),
    "smuggling": ("unicode-smuggling", "zero-width", "rtl override", "homoglyph"),
    "doc_injection": ("prompt-injection", "prompt injection"),
    "dynamic_import": ("dynamic import", "importlib", "import_module", "dynamic-import"),
    "time_bomb": ("time bomb", "time-bomb", "datetime comparison", "activation trigger", "unix timestamp"),
    "dynamic_description": ("dynamic-description", "rug-pull", "rug pull enabler", "dynamic tool description"),
    "server": ("mcp", "tool-poisoning", "mcp_security", "mcp-config", "rug-pull-enabler"),
    "phantom": ("phantom-dependency", "phantom dep", "shadow dependency"),
    "pipe_exfil": ("pipe exfiltration", "reverse shell", "/dev/tcp", "pipe-exfiltration"),
    "agent_config": ("tool-poisoning", "agent-injection", "frontmatter", "clawhavoc-delivery", "clawhubignore-bypass"),
    "git_dependency": ("git-dependency", "git dependency", "git+"),
    "missing_integrity": ("missing-integrity", "missing integrity", "no integrity"),
    "untrusted_url": ("untrusted-registry", "untrusted registry", "insecure-protocol"),
    "pth": ("pth-injection", ".pth file", "pth file"),
    "pth_exec": ("exec", "eval", "compile", "base64", "obfuscat"),
    "known_ioc": ("known-ioc", "known malicious", "ioc match", "ioc database"),
    "three_exec": (
        "code execution", "code-execution", "arbitrary code", "remote code", "shell execution", "shell-exec", "eval(", "exec(", "os.system(", "os.system ", "subprocess.run",
        "subprocess.call", "subprocess.popen", "subprocess.check_output", "subprocess.exec", "child_process.exec", "child_process.spawn", "child_process.execsync",
        "command injection", "shell=true", "dangerous exec",
    ),
    "three_network": (
        "exfiltration", "exfiltrate", "data theft", "outbound network", "outbound-network", "outbound http", "outbound-http", "webhook post", "webhook-post", "webhook exfil",
        "reverse shell", "reverse-shell", "/dev/tcp/", "requests.post(", "urllib.request.urlopen(", "socket.connect(", "socket.send(", "socket.sendto(",
        "http.client.httpsconnection", "http.client.httpconnection", "node-fetch(", "axios.post(", "axios.get(", "command and control", "c2 callback",
        "data posted to external", "posts to webhook",
    ),
    "three_credential": (
        "credential read", "credential-read", "credential file", "credential access", "credential theft", "credential exfil", "secret read", "secret-read", "secret exfil",
        "env access", "env-access", ".env read", ".env access", "env_key read", ".ssh/id_", ".aws/credentials", ".aws/config", ".netrc", "id_rsa", "id_ed25519",
        "keychain access", "keychain read", "github_token", "api_key read", "api-key read", "browser data", "private key read", "token theft",
    ),
    "secret_exposure": ("secret-exposure", "process.env logged", "process.env serialized", "json.stringify"),
    "error_handler": ("uncaughtexception", "unhandledrejection", "error handler", "crash report", "onerror"),
    "devcontainer": ("host-secret-exposure", "host secret mount", "pulls host secret", "localenv"),
    "credential_access": ("credential-exfiltration", "credential exfiltration", "credential theft", "secret exfil", "token theft", "remote-code-execution"),
    "command_jacking": ("command-jacking", "shadows system command"),
    "model_confusion": ("model-confusion", "from_pretrained", "trust_remote_code"),
    "compromised_action": ("compromised-action", "compromised action"),
    "secrets": ("secret", "credential", "token", "password", "api.key"),
    "audio": ("audio-steganography", "steganography", "audio steg"),
    "worm": ("worm-propagation", "npm publish", "package enumeration"),
    "npm_token": ("npmrc", "npm_token", "npm-token", "credential-theft"),
    "destructive": ("destructive-command", "shred", "cipher /w", "disk overwrite", "home directory"),
    "tool_persistence": ("ai-tool-persistence", "claude code hook", "sessionstart", "folder open", "vscode task"),
    "git_exfil": ("git-exfiltration", "repo creation", "content push", "commit search"),
    "locale_gating": ("locale-gating", "locale gating", "geoip", "country_code", "navigator.language"),
    "process_memory": ("memory-forensics", "process memory read"),
    "process_enum": ("process-enumeration", "runner.worker", "process hunt"),
    "bait": ("llmo-suspicious", "llmo suspicious"),
    "brand_new": ("freshness-brand-new-package", "brand new package", "single version"),
    "entrypoint": ("entrypoint", "entrypoint-iife", "entrypoint-import-exec"),
    "entry_credential": ("credential", "env", "process.env", "os.environ"),
    "entry_network": ("network", "fetch", "request", "http", "exfil", "socket"),
    "update_channel": ("update-channel", "deferred update channel", "update channel"),
    "prose": ("prose-imperative", "prose imperative", "exfiltration instruction"),
    "config_write": ("config-write-request", "config write request", "hook installation"),
    "sub_agent": ("sub-agent-spawn", "sub-agent spawn", "agent spawn", "child agent"),
    "authority": ("authority-framing", "authority claim", "safety theater", "trust escalation"),
    "memory_poison": ("memory-poisoning", "memory write", "rag poisoning", "provenance-stripping", "provenance stripping"),
    "visual_hiding": ("css-steganography", "css hiding", "visual hiding"),
    "credential_exfil": ("credential-exfiltration", "credential exfil", "credential theft", "exfil-pattern"),
    "action": ("code-execution", "shell-injection", "config-write-request", "code execution"),
}


@dataclass(frozen=True)
class Compound:
    id: str
    severity: str
    category: str
    title: str
    when: str  # a boolean expression over the flags, in the subset that Spark and DuckDB share


#: M1-M29 and M37-M41, over the flags of one file.
FILE_RULES = (
    Compound("M1", "critical", "exfiltration", "Environment or credentials read beside a network call", "env AND network"),
    Compound("M2", "critical", "obfuscation", "Decoding beside execution", "encoding AND exec"),
    Compound("M3", "high", "exfiltration", "Sensitive file read beside a network call", "sensitive_read AND network AND NOT (env AND network)"),
    Compound("M4", "critical", "compound-attack", "Prompt injection beside execution", "prompt_injection AND exec"),
    Compound("M5", "critical", "exfiltration", "Install hook beside a network call", "lifecycle AND network"),
    Compound("M6", "critical", "mcp-escalation", "Injected query can store prompts", "sql AND server_poison"),
    Compound("M7", "critical", "mcp-escalation", "Poisoned tool metadata beside execution", "poisoning AND exec"),
    Compound("M8", "high", "compound-attack", "Hidden instructions in documentation", "smuggling AND doc_injection AND is_doc"),
    Compound("M9", "critical", "deferred-payload", "Dynamic import beside a fetch", "dynamic_import AND network"),
    Compound("M10", "critical", "time-triggered-malware", "Time bomb beside execution", "time_bomb AND exec"),
    Compound("M11", "high", "rug-pull", "Server with dynamic descriptions", "dynamic_description AND server"),
    Compound("M12", "critical", "shadow-dependency", "Undeclared dependency beside a network call", "phantom AND network"),
    Compound("M13", "critical", "pipe-exfiltration", "Pipe to the network", "pipe_exfil AND network"),
    Compound("M14", "critical", "openclaw-compound", "Poisoned configuration beside prompt injection", "agent_config AND prompt_injection_other"),
    Compound("M15", "high", "npmrc-injection-risk", "Git dependency beside an install hook", "git_dependency AND lifecycle"),
    Compound("M16", "critical", "lockfile-tampering", "No integrity beside an untrusted registry", "missing_integrity AND untrusted_url"),
    Compound("M17", "critical", "pth-injection", "Start-up file beside execution", "pth AND pth_exec"),
    Compound("M18", "critical", "pth-injection", "Start-up file of a known attack", "pth AND known_ioc"),
    Compound("M19", "critical", "lethal-trifecta", "Execution, network and credentials together", "three_exec AND three_network AND three_credential AND three_n >= 2"),
    Compound("M20", "critical", "secret-leak-chain", "Secrets in an error handler", "secret_exposure AND error_handler"),
    Compound("M21", "critical", "compound-threat", "Host secrets in a dev container", "devcontainer AND credential_access"),
    Compound("M22", "critical", "command-jacking-chain", "Shadowed command beside a network call", "command_jacking AND network"),
    Compound("M23", "critical", "model-confusion-chain", "Remote model code beside execution", "model_confusion AND exec"),
    Compound("M24", "critical", "compromised-action-chain", "Compromised action with secrets", "compromised_action AND secrets"),
    Compound("M25", "critical", "steganography-chain", "Hidden payload beside a network call", "audio AND network"),
    Compound("M26", "critical", "worm-propagation-chain", "Publishing beside a registry token", "worm AND npm_token"),
    Compound("M27", "critical", "destructive-fallback-chain", "Destruction beside credentials", "destructive AND env"),
    Compound("M28", "critical", "ai-persistence-chain", "Tool persistence beside credentials", "tool_persistence AND (env OR sensitive_read)"),
    Compound("M29", "critical", "git-exfiltration-chain", "Repository writes beside credentials", "git_exfil AND (env OR sensitive_read)"),
    Compound("M37", "critical", "geofenced-destructive", "Destruction by locale", "locale_gating AND destructive"),
    Compound("M38", "critical", "ci-runner-memory-extraction", "Memory read of a build runner", "process_memory AND process_enum"),
    Compound("M39", "high", "llmo-attack", "Bait name on a brand-new package", "bait AND brand_new"),
    Compound("M40", "critical", "entrypoint-credential-chain", "Entry point beside credentials", "entrypoint AND entry_credential"),
    Compound("M41", "critical", "entrypoint-exfiltration-chain", "Entry point beside a network call", "entrypoint AND entry_network"),
)

#: Two keyword sets in equal, ancestor or descendant directories of one repo.
REPO_RULES = (
    ("M30", "critical", "staged-injection-chain", "Update channel near a prose instruction", "update_channel", "prose"),
    ("M31", "critical", "workspace-persistence-chain", "Config write near an update channel", "config_write", "update_channel"),
    ("M32", "critical", "sub-agent-hijack-chain", "Sub-agent near credential exfiltration", "sub_agent", "credential_exfil"),
    ("M33", "high", "social-engineering-chain", "Authority claim near an action", "authority", "action"),
    ("M34", "critical", "memory-backdoor-chain", "Memory poisoning near prompt injection", "memory_poison", "prompt_injection"),
    ("M35", "critical", "visual-steganography-chain", "Visual hiding near prompt injection", "visual_hiding", "prompt_injection"),
    ("M36", "critical", "deferred-sub-agent-chain", "Update channel near a sub-agent", "update_channel", "sub_agent"),
)

DOC_EXT = r"(?i)\.(md|txt|rst|adoc)$"


def with_tags(findings: DataFrame) -> DataFrame:
    """Lower-cased description, title and category."""
    return findings.withColumn("tags", F.lower(F.concat_ws(" ", "description", "title", "category")))


def has(name: str) -> Column:
    """Whether tags hold any keyword of a set."""
    hit = F.lit(False)
    for k in KEYWORDS[name]:
        hit = hit | F.contains("tags", F.lit(k))
    return hit


#: The bit of each keyword set in a mask of sets.
BITS = {k: 1 << i for i, k in enumerate(KEYWORDS)}
assert len(BITS) < 64


def mask_of(*names: str) -> Column:
    return F.lit(sum(BITS[k] for k in names)).cast("long")


def holds(mask: str, *names: str) -> Column:
    """Whether a mask has any of some sets."""
    return F.col(mask).bitwiseAND(mask_of(*names)) != 0


def with_sets(findings: DataFrame) -> DataFrame:
    """The keyword sets that each finding's tags hit, as a mask. Tags repeat what rules say, so they are few: each distinct one is tested once. Findings that have sets stay as they are."""
    if "sets" in findings.columns:
        return findings
    tagged = with_tags(findings)
    mask = F.lit(0).cast("long")
    for k in KEYWORDS:
        mask = mask.bitwiseOR(F.when(has(k), mask_of(k)).otherwise(F.lit(0).cast("long")))
    known = stage(tagged.select("tags").distinct().withColumn("sets", mask), "tags")
    return tagged.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "tags")


#: What the rules ask of a file; files differ in few ways in it.
STATE = ("held", "prompt_injection_other", "three_n", "is_doc")


def file_states(findings: DataFrame) -> DataFrame:
    """One row per file that any set holds for: the mask of its sets, prompt injection from another scanner, the number of findings in any of the three narrow sets, up to 2, and is_doc."""
    tagged = with_sets(findings).where("sets <> 0")
    other = F.coalesce(F.bool_or(holds("sets", "prompt_injection") & (F.col("scanner") != "agent_skills")), F.lit(False)).alias("prompt_injection_other")
    three = F.least(F.count_if(holds("sets", "three_exec", "three_network", "three_credential")), F.lit(2).cast("long")).alias("three_n")
    held = tagged.groupBy("repo", "file").agg(F.bit_or("sets").alias("held"), other, three)
    return held.withColumn("is_doc", F.coalesce(F.col("file").rlike(DOC_EXT), F.lit(False)))


def _out(df: DataFrame) -> DataFrame:
    return df.select(
        "repo", F.lit("correlation").alias("scanner"), "severity", "title", F.col("title").alias("description"), "file", F.lit(0).alias("line"),
        F.lit("[compound]").alias("snippet"), "category", "rule_id", F.when(F.col("severity") == "critical", 0.95).otherwise(0.8).alias("confidence"),
    )


def correlate_files(findings: DataFrame) -> DataFrame:
    """One grouped aggregate; the rules are asked once for each distinct state of a file, and files meet what fires by equality of states."""
    states = stage(file_states(findings), "file-states")
    struct = lambda m: F.struct(F.lit(m.id).alias("rule_id"), F.lit(m.severity).alias("severity"), F.lit(m.category).alias("category"), F.lit(m.title).alias("title"))
    fired = F.filter(F.array(*[F.when(F.expr(m.when), struct(m)) for m in FILE_RULES]), lambda x: x.isNotNull())
    flags = states.select(*STATE).distinct().select(*STATE, *[holds("held", k).alias(k) for k in KEYWORDS])
    known = counted(flags.select(*STATE, F.explode(fired).alias("m")).select(*STATE, "m.*"), "fired-rules")
    return _out(states.join(known, list(STATE)))


def ancestors(d: str) -> Column:
    """A directory, its parents and the root, as an array."""
    parts = F.split(d, "/")
    return F.array_union(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), F.array(F.lit("")))


def near_dirs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Repos in which a directory of ``a`` equals, contains or lies in one of ``b`` (both repo, dir); equi-joins on exploded parents."""
    up = lambda x: x.select("repo", F.explode(ancestors("dir")).alias("dir"))
    return a.join(up(b), ["repo", "dir"]).select("repo").union(b.join(up(a), ["repo", "dir"]).select("repo")).distinct()


def correlate_repos(findings: DataFrame) -> DataFrame:
    """M30-M36, over the distinct directories of each set."""
    tagged = with_sets(findings)
    sets = sorted({x for r in REPO_RULES for x in r[4:]})
    placed = tagged.where(holds("sets", *sets)).withColumn("dir", F.when(F.contains("file", F.lit("/")), F.regexp_replace("file", "/[^/]*$", "")).otherwise(""))
    masks = placed.groupBy("repo", "dir").agg(F.bit_or("sets").alias("held"))
    hits = F.filter(F.array(*[F.when(holds("held", k), F.lit(k)) for k in sets]), lambda x: x.isNotNull())
    dirs = stage(masks.select("repo", "dir", F.explode(hits).alias("set")), "set-directories")
    spark = tagged.sparkSession
    rules = spark.createDataFrame(list(REPO_RULES), "rule_id string, severity string, category string, title string, a string, b string")
    side = lambda name: dirs.join(F.broadcast(rules.select("rule_id", F.col(name).alias("set"))), "set").select("repo", "rule_id", "dir")
    up = lambda x: x.select("repo", "rule_id", F.explode(ancestors("dir")).alias("dir")).distinct()
    a, b = side("a"), side("b")
    keys = ["repo", "rule_id", "dir"]
    met = a.join(up(b), keys).select("repo", "rule_id").union(b.join(up(a), keys).select("repo", "rule_id")).distinct()
    return _out(met.join(F.broadcast(rules), "rule_id").withColumn("file", F.lit("")))


def correlate(findings: DataFrame) -> DataFrame:
    """All compound findings. Rules over a repo read the findings as a list, so they fire beside those over files."""
    tagged = with_sets(findings)
    return correlate_files(tagged).unionByName(correlate_repos(tagged))


def _has_sql(name: str) -> str:
    return "(" + " OR ".join("contains(tags, '" + k.replace("'", "''") + "')" for k in KEYWORDS[name]) + ")"


_OUT_SQL = "'correlation' AS scanner, severity, title, title AS description, file, 0 AS line, '[compound]' AS snippet, category, rule_id, CASE severity WHEN 'critical' THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence"


def correlate_oracle(findings: str = "findings") -> str:
    """Common table expressions ``tagged``, ``flags``, ``compound`` over a findings relation."""
    aggs = ", ".join(f"bool_or({_has_sql(k)}) AS {k}" for k in KEYWORDS)
    three = " OR ".join(_has_sql(k) for k in ("three_exec", "three_network", "three_credential"))
    arms = ", ".join(f"('{m.id}', '{m.severity}', '{m.category}', '{m.title}')" for m in FILE_RULES)
    fired = " ".join(f"WHEN '{m.id}' THEN {m.when}" for m in FILE_RULES)
    repo = " UNION ALL ".join(
        f"SELECT DISTINCT a.repo, '{i}' AS rule_id, '{s}' AS severity, '{c}' AS category, '{t}' AS title FROM tagged a JOIN tagged b ON a.repo = b.repo AND "
        f"(a.dir = b.dir OR starts_with(a.dir, b.dir || '/') OR starts_with(b.dir, a.dir || '/') OR a.dir = '' OR b.dir = '') WHERE {_has_sql(x).replace('tags', 'a.tags')} AND {_has_sql(y).replace('tags', 'b.tags')}"
        for i, s, c, t, x, y in REPO_RULES
    )
    return f"""
tagged AS (SELECT *, lower(concat_ws(' ', description, title, category)) AS tags, CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '' END AS dir FROM {findings}),
flags AS (SELECT repo, file, {aggs}, coalesce(bool_or({_has_sql('prompt_injection')} AND scanner <> 'agent_skills'), false) AS prompt_injection_other,
  count(*) FILTER ({three}) AS three_n, regexp_matches(file, '{DOC_EXT}') AS is_doc FROM tagged GROUP BY repo, file),
m(rule_id, severity, category, title) AS (VALUES {arms}),
compound AS (
  SELECT repo, {_OUT_SQL} FROM flags, m WHERE CASE rule_id {fired} END
  UNION ALL
  SELECT repo, {_OUT_SQL} FROM (SELECT *, '' AS file FROM ({repo})))"""
