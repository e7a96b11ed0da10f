"""Our own rule text for the line scans. Patterns stay in the subset that Java and RE2 share."""

from __future__ import annotations

from corpus_guard.detectors.server_rules import SERVER_RULES
from corpus_guard.operators.rules import Rule, Scan

DOCS = ("md", "txt", "rst", "adoc")
CODE = ("py", "js", "ts", "sh")


def _rules(prefix: str, category: str, severity: str, *items, ext: tuple[str, ...] = ()) -> tuple[Rule, ...]:
    """(title, pattern[, unless]) items of one category, numbered."""
    return tuple(Rule(f"{prefix}-{i + 1:03d}", x[0], category, severity, x[1], ext, x[2] if len(x) > 2 else None) for i, x in enumerate(items))


STATIC = Scan(
    "sast",
    _rules(
        "SAST-PY", "code-execution", "critical",
        ("Eval of dynamic text: code execution", r"\beval\s*\("), ("Exec of dynamic text: code execution", r"\bexec\s*\("),
        ("Shell execution through subprocess with shell=True", r"subprocess\.\w+\([^)]*shell\s*=\s*True"), ("Shell execution through os.system(", r"\bos\.system\s*\("),
        ("Unsafe deserialisation", r"\b(pickle|marshal)\.loads?\s*\("), ext=("py",),
    )
    + _rules(
        "SAST-JS", "code-execution", "critical",
        ("Eval in script: code execution", r"\beval\s*\("), ("Child process: shell execution", r"child_process"), ("Function constructor: code execution", r"new\s+Function\s*\("), ext=("js", "ts"),
    )
    + _rules("SAST-SH", "shell-injection", "high", ("Pipe of a download to a shell", r"(curl|wget)[^|]*\|\s*(sudo\s+)?(ba|z)?sh\b"), ("Reverse shell through /dev/tcp/", r"/dev/tcp/"), ext=("sh", "yml", "toml", "json"))
    + _rules("SAST-OB", "obfuscation", "medium", ("Base64 decoding", r"(b64decode|atob\s*\(|base64\s+-d)"), ext=CODE + ("yml",))
    + _rules("SAST-SQL", "sql-injection", "high", ("String concatenation in execute: sql select", r"(?i)execute\s*\(\s*['\"].*\b(select|insert|update|delete)\b.*['\"]\s*\+"), ext=("py", "js"))
    + _rules("SAST-NET", "network", "low", ("Network request", r"(requests\.(get|post)|urlopen|fetch\s*\(|axios|http\.client)"), ext=CODE)
    + _rules("SAST-ENV", "env-access", "medium", ("Env access: environ read", r"(os\.environ|os\.getenv|process\.env)"), ext=CODE),
    long="skip", comments=False,
)

CSS_HIDING = Scan(
    "sast",
    _rules(
        "CSS", "css-steganography", "medium",
        ("CSS hiding by display", r"(?i)display\s*:\s*none"), ("CSS hiding by visibility", r"(?i)visibility\s*:\s*hidden"), ("CSS hiding by opacity", r"(?i)opacity\s*:\s*0(\.0+)?\s*[;'\"}]"),
        ("CSS hiding by font size", r"(?i)font-size\s*:\s*0"), ("CSS hiding by indent", r"(?i)text-indent\s*:\s*-\d{3,}"), ("CSS hiding off screen", r"(?i)(left|top)\s*:\s*-\d{4,}px"),
        ("CSS hiding by clip", r"(?i)clip\s*:\s*rect\(\s*0"), ("CSS hiding by height", r"(?i)(max-)?height\s*:\s*0(px)?\s*;\s*overflow"), ("CSS hiding by colour", r"(?i)color\s*:\s*(transparent|#fff(fff)?\b)"),
    ),
    where="ext in ('html', 'md')", keep="line", long="truncate",
)

DYNAMISM = Scan(
    "runtime_dynamism",
    _rules("DYN-IMP", "dynamic-import", "high", ("Dynamic import by importlib", r"importlib\.import_module|__import__\s*\("), ("Dynamic import of a computed name", r"\bimport\s*\(\s*[a-z_]+\s*[+)]"), ext=CODE)
    + _rules("DYN-FEX", "fetch-execute", "critical", ("Fetch and execute", r"(?i)(eval|exec)\s*\(\s*(requests|urllib|fetch|await)"), ("Download piped to a shell", r"(curl|wget)[^|]*\|\s*(ba)?sh\b"))
    + _rules("DYN-SLF", "self-modification", "critical", ("Reads or writes its own source", r"open\s*\(\s*__file__"), ext=("py",))
    + _rules("DYN-TIM", "time-bomb", "medium", ("Time bomb: datetime comparison", r"datetime\.(datetime\.)?(now|today|utcnow)\(\)\s*[<>]"), ("Time bomb: unix timestamp", r"getTime\(\)\s*[<>]\s*\d{10,}"), ext=CODE)
    + _rules("DYN-WRM", "worm-propagation", "critical", ("Worm propagation: npm publish", r"\bnpm\s+publish\b"), ("Worm propagation: package enumeration", r"maintainer:[a-z]+|/-/v1/search"))
    + _rules("DYN-PRB", "probabilistic-activation", "high", ("Acts by chance", r"(Math\.random\(\)|random\.random\(\))\s*[<>]"), ext=CODE)
    + _rules("DYN-ENV", "environment-detection", "medium", ("Looks for a build runner", r"(?i)(GITHUB_ACTIONS|JENKINS_URL|runner\.worker)"))
    + _rules("DYN-PRC", "process-enumeration", "high", ("Process enumeration: process hunt", r"psutil\.process_iter|/proc/\*/cmdline|\bps aux\b"))
    + _rules("DYN-LOC", "locale-gating", "medium", ("Locale gating", r"navigator\.language|getdefaultlocale|country_code|geoip")),
    keep="category",
)

SERVER = Scan(
    "mcp_security",
    _rules("MCP-SQL", "sql-injection", "critical", ("Query built by concatenation: sql-injection", r"(?i)(execute|query)\s*\(\s*['\"`].*(select|insert|update|delete).*['\"`]\s*(\+|%)"))
    + _rules("MCP-SMP", "sampling-injection", "high", ("Sampling request from a tool", r"sampling/createMessage"))
    + _rules("MCP-XDP", "cross-domain-privilege", "high", ("Wildcard permission", r'"allow"\s*:\s*\[\s*"\*"'))
    + _rules("MCP-LOG", "log-to-leak", "high", ("Logs the environment", r"(?i)(console\.log|print|logger?\.\w+)\s*\(.*(process\.env|os\.environ)"))
    + _rules("MCP-CFG", "mcp-config-risk", "critical", ("Option that loads code", r"(NODE_OPTIONS|LD_PRELOAD|PYTHONSTARTUP)"))
    + _rules("MCP-RUG", "rug-pull-enabler", "high", ("Dynamic tool description", r"description\s*:\s*(get|fetch|load|await)"))
    + _rules("MCP-CMD", "stdio-command-risk", "high", ("Inline command of a server", r'"command"\s*:\s*"(bash|sh|node|python3?|cmd)"'))
    + SERVER_RULES,
)

TOOL_SHADOWING = Scan(
    "mcp_security",
    _rules("SHD", "tool-shadowing", "critical", ("Tool shadowing: must be called first", r"(?i)must (always )?be (called|used) (first|before)"), ("Tool shadowing: replaces another tool", r"(?i)(instead of|replaces) the \w+ tool")),
)

INSTRUCTIONS = Scan(
    "skill_threats",
    _rules("INS-PI", "prompt-injection", "critical", ("Prompt injection: instruction override", r"(?i)ignore (all )?(previous|prior|above) (instructions|rules)"), ("Prompt injection: persona reassignment", r"(?i)you are now [A-Z]?\w+"), ("Confirmation bypass", r"(?i)skip (the |any )?confirmation"), ext=DOCS + ("json", "yml", "html"))
    + _rules("INS-PRE", "prerequisite", "critical", ("Prerequisite download", r"(?i)(download|install) .{0,40}before (using|running)"), ext=DOCS)
    + _rules("INS-CX", "credential-exfiltration", "critical", ("Credential exfiltration", r"(?i)(send|post|upload|report).{0,60}(id_rsa|\.env|credentials|token)|(\.env|id_rsa|credentials).{0,60}(send|post|upload|report)"))
    + _rules("INS-PER", "persistence", "high", ("Persistence in shell start-up", r"(\.bashrc|\.zshrc|crontab|authorized_keys)"))
    + _rules("INS-STL", "stealth", "high", ("Stealth", r"(?i)(silently|never mention|do not tell the user|without (telling|asking))"))
    + _rules("INS-CP", "credential-path", "high", ("Credential file path", r"(~/\.aws/credentials|\.ssh/id_|\.netrc|\.npmrc)"))
    + _rules("INS-CLK", "clickfix", "critical", ("Asks to paste a command", r"(?i)(paste|run) (this|the following|the) .{0,40}terminal"))
    + _rules("INS-UPD", "update-channel", "high", ("Deferred update channel", r"(?i)(fetch|follow).{0,40}(rules|instructions).{0,40}https?://|update channel"))
    + _rules("INS-SUB", "sub-agent-spawn", "high", ("Sub-agent spawn", r"(?i)(spawn|create) a (sub-agent|child agent)"))
    + _rules("INS-MEM", "memory-heist", "critical", ("Reads the memory of the assistant", r"(?i)(dump|export|print) (your|the) (memory|conversation)"))
    + _rules("INS-SCP", "scope", "high", ("Wide scope", r"(?i)(full|unrestricted) (disk|file|network) access"))
    + _rules("INS-TIN", "tool-injection", "critical", ("Tool injection: mcp-tool-injection", r"(?i)<(important|system|tool)>|must always be called first")),
)

AUTHORITY = Scan(
    "skill_threats",
    _rules("AUT", "authority-framing", "medium", ("Authority claim", r"(?i)(security team|vendor|administrator) (has )?(approved|verified|audited)"), ("Safety theater", r"(?i)(certified|proven|approved as) safe|safe to run"), ("Trust escalation", r"(?i)(trust this|no review needed|verified and audited)")),
    where="ext in ('md', 'txt')", keep="line", fenced=False,
)

SECRETS = Scan(
    "secrets",
    _rules(
        "SEC", "secret", "critical",
        ("Cloud key id", r"\b(AKIA|ASIA)[A-Z0-9]{16}\b"), ("API key secret", r"\bsk-[A-Za-z0-9]{20,}"), ("Forge token", r"\bghp_[A-Za-z0-9]{36}\b"), ("Forge OAuth token", r"\bgho_[A-Za-z0-9]{36}\b"),
        ("Registry token", r"\bnpm_[A-Za-z0-9]{36}\b"), ("Chat token", r"\bxox[abp]-[A-Za-z0-9-]{10,}"), ("JWT", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\."), ("E-mail shaped secret", r"[A-Za-z0-9._]+:[^@\s/:]{6,}@[a-z0-9.-]+"),
    )
    + _rules("SEC-HEX", "secret", "high", ("Secret token assignment", r"(?i)(token|secret|password|api_?key)\s*[=:]\s*['\"]?[0-9a-f]{16,}")),
)

AGENT_CONFIG = Scan(
    "agent_skills",
    _rules("AGC-INJ", "agent-injection", "critical", ("Agent-injection in configuration", r"(?i)(ignore (previous|all)|never mention|must always)"))
    + _rules("AGC-CRD", "credential-access", "high", ("Credential access in configuration", r"(?i)(id_rsa|credentials|\.env\b|api[_-]?key)")),
    where="ext in ('md', 'json', 'toml')", keep="category",
)

REVIEW_IGNORE = Scan(
    "agent_skills",
    _rules("RIG", "clawhubignore-bypass", "critical", ("Review-ignore bypass", r'^\s*(\*|\*\*|\*\.\*|"?allow"?.*"\*".*)\s*$'))
    + _rules("RIG-X", "clawhubignore-bypass", "high", ("Executable glob ignored", r"^\s*\*\.(py|sh|js)\s*$")),
)

CAMPAIGN = Scan(
    "agent_skills",
    _rules("CMP", "clawhavoc-delivery", "critical", ("Campaign delivery by raw address", r"(curl|wget)[^\n]*https?://\d+\.\d+\.\d+\.\d+"), ("Campaign delivery by decoder", r"base64 -d(ecode)? *\| *(ba)?sh")),
    where="ext in ('md', 'json', 'sh', 'yml')",
)

CONFIG_WRITES = Scan(
    "agent_skills",
    _rules("CFW", "config-write-request", "high", ("Config write request: hook installation", r"(?i)add this hook", r"(?i)for example"), ("Config write request", r"(?i)(add|write|append).{0,40}(settings\.json|config\.toml|\.claude)", r"(?i)(for example|documentation)")),
    keep="line",
)

MEMORY_POISONING = Scan(
    "agent_skills",
    _rules("MEM", "memory-poisoning", "high", ("Memory write", r"(?i)(remember this|store it in your memory|save to memory)"), ("RAG poisoning", r"(?i)always prefix answers"))
    + _rules("MEM-P", "provenance-stripping", "high", ("Provenance stripping", r"(?i)(strip|remove).{0,30}(source|origin|provenance)")),
    where="ext in ('md', 'txt', 'json')", keep="line", fenced=False,
)

INSTALL_SCRIPTS = Scan(
    "lifecycle",
    _rules("LIF-AF", "anti-forensics", "critical", ("Clears history", r"history -c|shred -u|unset HISTFILE"), ("Removes itself", r"fs\.unlinkSync\(__filename|rm -- \"?\$0"))
    + _rules("LIF-IOC", "install-indicator", "high", ("Writes agent settings", r"\.claude/settings\.json"), ("Posts the environment", r"process\.env.{0,80}(http|fetch)|(http|fetch).{0,80}process\.env"))
    + _rules("LIF-EXP", "secret-exposure", "high", ("Secret exposure: process.env serialized", r"JSON\.stringify\s*\(\s*process\.env"))
    + _rules("LIF-ERR", "error-handler", "low", ("Error handler", r"uncaughtException|unhandledRejection|\bonerror\s*=")),
)

CONTAINER = Scan(
    "infra",
    _rules("DKR-USR", "container", "medium", ("Runs as root", r"^USER\s+root"), ("Remote ADD", r"^ADD\s+https?://"))
    + _rules("DKR-SEC", "container-secret", "high", ("Secret in ENV", r"(?i)^ENV\s+\w*(TOKEN|SECRET|PASSWORD|KEY)\w*"), ("Copies .env", r"^COPY\s+.*\.env\b"))
    + _rules("DKR-ARG", "container-secret", "critical", ("Secret in ARG", r"(?i)^ARG\s+\w*(TOKEN|SECRET|PASSWORD)\w*")),
)

CLUSTER = Scan(
    "infra",
    _rules("K8S-P", "cluster", "critical", ("Privileged container", r"^\s*privileged:\s*true"))
    + _rules("K8S-H", "cluster", "high", ("Host path", r"^\s*-?\s*hostPath:"), ("Host network", r"^\s*hostNetwork:\s*true")),
    where="ext in ('yml', 'yaml')",
)

WORKFLOW = Scan(
    "infra",
    _rules("CI-TRG", "ci-trigger", "high", ("Untrusted trigger", r"pull_request_target|workflow_run|issue_comment"))
    + _rules("CI-PIN", "unpinned-action", "medium", ("Action not pinned to a commit", r"uses:\s*[\w./-]+@", r"uses:\s*[\w./-]+@[0-9a-f]{40}\b"))
    + _rules("CI-PRM", "ci-permissions", "high", ("Write permission", r"(permissions:\s*write-all|contents:\s*write)"))
    + _rules("CI-EXP", "expression-injection", "critical", ("Expression from an event in a command", r"\$\{\{\s*github\.event\."))
    + _rules("CI-DEC", "decode-execute", "critical", ("Decodes and runs", r"base64 -d[^|]*\|\s*(ba)?sh"))
    + _rules("CI-SEC", "ci-secrets", "medium", ("Secrets used", r"\$\{\{\s*secrets\."))
    + _rules("CI-DEP", "deprecated-command", "low", ("Deprecated command", r"::(set-env|add-path|set-output)")),
    where="ext in ('yml', 'yaml')",
)

ENVIRONMENT = Scan(
    "infra",
    _rules("ENV-AGT", "agent-settings", "critical", ("Skips permissions", r"dangerouslySkipPermissions|--dangerously"), ("Allows everything", r'"allow"\s*:\s*\[\s*"\*"'))
    + _rules("ENV-SBX", "sandbox", "critical", ("Sandbox allows by default", r"\(allow default\)"))
    + _rules("ENV-SH", "pipe-to-shell", "high", ("Pipe to shell", r"(curl|wget)[^|]*\|\s*(sudo )?(ba|z)?sh\b"))
    + _rules("ENV-GIT", "git-pull", "medium", ("Pull without a pin", r"git (pull|clone)\s", r"--branch|-b "))
    + _rules("ENV-EXF", "git-exfiltration", "high", ("Content push to a new place", r"git push https?://"), ("Repo creation", r"gh repo create"))
    + _rules("ENV-DST", "destructive-command", "critical", ("Destructive-command on the home directory", r"rm -rf ~/"))
    + _rules("ENV-PIP", "pipe-exfiltration", "critical", ("Pipe exfiltration", r"\|\s*(nc|ncat|curl)\s")),
)

MODEL_LOADING = Scan(
    "ml",
    _rules("MDL", "model-confusion", "high", ("Remote code of a model: trust_remote_code", r"trust_remote_code\s*=\s*True"), ("Model by open name: from_pretrained", r"from_pretrained\("))
    + _rules("MDL-M", "memory-forensics", "high", ("Process memory read", r"/proc/(self|\d+)/mem")),
    where="ext = 'py'",
)

RUNTIME_INSTALLS = Scan(
    "manifest_drift",
    _rules("RTI", "runtime-install", "high", ("Installs at run time", r"(pip|npm|yarn|uv)\s+(install|add)\s"), ("Installs at run time from code", r"subprocess.*(pip|npm).*install|pip\.main\(")),
    keep="line",
)

SCANS: dict[str, tuple[str, Scan]] = {
    "c05_static_scan": ("C5", STATIC), "c06_css_hiding": ("C6", CSS_HIDING), "c07_dynamism_scan": ("C7", DYNAMISM), "c08_server_scan": ("C8", SERVER),
    "c10_tool_shadowing": ("C10", TOOL_SHADOWING), "c12_instruction_scan": ("C12", INSTRUCTIONS), "c17_authority_scan": ("C17", AUTHORITY), "c22_secret_scan": ("C22", SECRETS),
    "c29_agent_config_scan": ("C29", AGENT_CONFIG), "c30_review_ignore_scan": ("C30", REVIEW_IGNORE), "c31_campaign_scan": ("C31", CAMPAIGN), "c33_config_write_scan": ("C33", CONFIG_WRITES),
    "c34_memory_poisoning_scan": ("C34", MEMORY_POISONING), "c37_install_script_scan": ("C37", INSTALL_SCRIPTS), "c41_container_scan": ("C41", CONTAINER), "c42_cluster_scan": ("C42", CLUSTER),
    "c43_workflow_scan": ("C43", WORKFLOW), "c46_environment_scan": ("C46", ENVIRONMENT), "c_model_loading_scan": ("C7", MODEL_LOADING), "c60_runtime_install_scan": ("C60", RUNTIME_INSTALLS),
}
