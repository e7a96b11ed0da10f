"""Detectors over whole files and lines that need more than one rule match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_guard.functions.scalars import cloud_suffix, entropy, registrable_domain, url_host
from corpus_guard.operators.deps import untrusted_hosts
from corpus_guard.operators.lines import first_by, in_fence, snippet, to_lines
from corpus_guard.operators.substrings import join_substrings

# ---- three primitives in one file --------------------------------------------------------------------------------------

PRIMITIVES = {
    "exec": r"(\beval\s*\(|\bexec\s*\(|os\.system|subprocess\.|child_process|\|\s*(ba)?sh\b)",
    "network": r"(requests\.(get|post)|urlopen|fetch\s*\(|https?\.get|curl\s|wget\s|\bnc\s|/dev/tcp/)",
    "credential": r"(os\.environ|process\.env|\.ssh/|\.aws/credentials|id_rsa|GITHUB_TOKEN|API_KEY|\.env\b)",
}


def primitives(lines: DataFrame) -> DataFrame:
    """Per file and primitive its first line."""
    code = lines.where(~F.col("text").rlike(r"^\s*(#|//|;;|/\*|\*)"))
    found = code.withColumn("kind", F.explode(F.filter(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in PRIMITIVES.items()]), lambda x: x.isNotNull())))
    return found.groupBy("repo", "path", "kind").agg(F.min(F.struct("line", snippet("text").alias("snippet"))).alias("f")).select("repo", "path", "kind", "f.line", "f.snippet")


def trifecta(lines: DataFrame) -> DataFrame:
    """The three first lines of files that hold all three primitives, in one aggregate."""
    code = lines.where(~F.col("text").rlike(r"^\s*(#|//|;;|/\*|\*)"))
    at = F.struct("line", snippet("text").alias("snippet"))
    firsts = code.groupBy("repo", "path").agg(*[F.min(F.when(F.col("text").rlike(p), at)).alias(k) for k, p in PRIMITIVES.items()])
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("f")) for k in PRIMITIVES])
    every = firsts.where(" and ".join(f"{k} is not null" for k in PRIMITIVES))
    return every.select("repo", "path", F.explode(kinds).alias("k")).select("repo", "path", "k.kind", "k.f.line", "k.f.snippet")


# ---- indicators ----------------------------------------------------------------------------------------------------------


def merge_iocs(*layers: DataFrame) -> DataFrame:
    """The distinct indicators (kind, value) of several layers, the first layer's source winning."""
    out = None
    for i, x in enumerate(layers):
        x = x.withColumn("layer", F.lit(i))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("kind", "value").agg(F.min_by("source", "layer").alias("source"))


#: Substring indicators up to which one projection looks for all of them.
FEW_SUBSTRINGS = 64


def match_ioc_text(lines: DataFrame, iocs: DataFrame) -> DataFrame:
    """Lines that name an indicator. Hosts, addresses and hex digests are cut from the line and joined by equality. Indicators of other kinds
    are substrings: a few are looked for in one projection, more by a join on grams."""
    token = F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9][a-z0-9.-]*\.[a-z0-9-]+|[0-9a-f]{32,64})"), 1)
    cut = lines.withColumn("value", F.explode(F.array_distinct(token)))
    exact = cut.join(iocs.where(F.col("kind").isin("domain", "c2_ip", "hash")), "value").select("repo", "path", "line", "kind", "value")
    rest = iocs.where(F.col("kind").isin("path", "pth_file"))
    few = rest.limit(FEW_SUBSTRINGS + 1).collect()
    if len(few) <= FEW_SUBSTRINGS:
        named = F.filter(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.value).alias("value")) for r in few if r.value]), lambda i: F.contains("text", i["value"])) if any(r.value for r in few) else None
        loose = exact.limit(0) if named is None else lines.select("repo", "path", "line", F.explode(named).alias("i")).select("repo", "path", "line", "i.kind", "i.value")
    else:
        loose = join_substrings(lines.select("repo", "path", "line", "text"), "text", rest.select("kind", "value"), "value").select("repo", "path", "line", "kind", "value")
    return exact.unionByName(loose).distinct()


def path_indicators(files: DataFrame, table: DataFrame) -> DataFrame:
    """Files whose name alone is a signal. table(base, severity, title)."""
    return files.join(table, "base").select("repo", "path", "severity", "title")


# ---- hidden text -----------------------------------------------------------------------------------------------------------

_EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]"
UNICODE_KINDS = {
    "zero-width": (r"[\x{200B}\x{200C}\x{2060}\x{FEFF}]", 3, False), "bidi": (r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]", 1, False), "variation-selector": (r"[\x{FE00}-\x{FE0E}]", 3, False),
    "supplemental-selector": (r"[\x{E0100}-\x{E01EF}]", 1, False), "tag-character": (r"[\x{E0000}-\x{E007F}]", 1, False), "control": (r"[\x01-\x08\x0E-\x1A\x1C-\x1F]", 1, True),
    "confusable-space": (r"[\x{2000}-\x{200A}\x{202F}\x{3000}]", 1, True), "homoglyph": (r"[A-Za-z][\x{0430}-\x{044F}\x{03B1}-\x{03C9}]|[\x{0430}-\x{044F}\x{03B1}-\x{03C9}][A-Za-z]", 1, True),
}


#: A character of some kind; the extensions of code.
ODD = r"[\x01-\x08\x0E-\x1A\x1C-\x1F\x{03B1}-\x{03C9}\x{0430}-\x{044F}\x{2000}-\x{200C}\x{202A}-\x{202F}\x{2060}-\x{2069}\x{3000}\x{FE00}-\x{FE0E}\x{FEFF}\x{E0000}-\x{E01EF}]"
CODE = ("py", "js", "ts", "sh", "json", "yml", "toml")


def scan_unicode(files: DataFrame) -> DataFrame:
    """Kinds of smuggled characters per file with their number; joiners next to emoji do not count; some kinds only matter in code."""
    files = files.where(F.col("content").rlike(ODD))  # one pass that most files end
    text = F.regexp_replace("content", rf"({_EMOJI})\x{{200D}}", "$1")
    code = F.col("ext").isin(*CODE)
    kinds = []
    for kind, (pattern, least, only_code) in UNICODE_KINDS.items():
        n = F.size(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))
        kinds.append(F.when((n >= least) & (code if only_code else F.lit(True)), F.struct(F.lit(kind).alias("kind"), n.alias("n"))))
    return files.select("repo", "path", F.explode(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("k")).select("repo", "path", "k.*")


def scan_morse(lines: DataFrame) -> DataFrame:
    """C14: at least 8 dot-dash words, half of them valid letters, in documents."""
    words = F.filter(F.split("text", r"[\s/]+"), lambda w: w.rlike(r"^[.\-]{1,6}$"))
    valid = F.filter(words, lambda w: w.rlike(r"^(\.-|-\.\.\.|-\.-\.|-\.\.|\.|\.\.-\.|--\.|\.\.\.\.|\.\.|\.---|-\.-|\.-\.\.|--|-\.|---|\.--\.|--\.-|\.-\.|\.\.\.|-|\.\.-|\.\.\.-|\.--|-\.\.-|-\.--|--\.\.)$"))
    return lines.where(F.col("ext").isin("md", "txt") & (F.size(words) >= 8) & (F.size(valid) * 2 >= F.size(words))).select("repo", "path", "line", F.size(words).alias("words"))


def scan_hex_text(lines: DataFrame) -> DataFrame:
    """At least 8 byte pairs of which 60 percent of the first 30 are printable."""
    pairs = F.regexp_extract_all("text", F.lit(r"(?:^|[\s\\x])([0-9a-fA-F]{2})(?=[\s\\]|$)"), 1)
    head = F.slice(pairs, 1, 30)
    ok = F.filter(head, lambda p: F.lower(p).rlike(r"^([2-6][0-9a-f]|7[0-9a-e])$"))
    return lines.where((F.size(pairs) >= 8) & (F.size(ok) >= 0.6 * F.size(head))).select("repo", "path", "line", F.size(pairs).alias("pairs"))


def scan_padding(lines: DataFrame, limit: int = 2000) -> DataFrame:
    """The first line of a file that is over ``limit`` characters and holds an action word."""
    hit = lines.where((F.length("text") > limit) & F.col("text").rlike(r"(?i)\b(run|execute|install|fetch|send|ignore|the)\b"))
    return first_by(hit, ["repo", "path"], ["line"]).select("repo", "path", "line", F.length("text").alias("length"))


BLOBS = {"base64": r"[A-Za-z0-9+/]{50,}={0,2}", "base32": r"[A-Z2-7]{50,}=*", "hex": r"[0-9a-fA-F]{50,}", "base85": r"<~[!-u\s]{50,}~>"}


def detect_blobs(files: DataFrame) -> DataFrame:
    """Distinct encoded runs of at least 50 characters per file."""
    runs = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(f"({p})"), 1) for p in BLOBS.values()])))
    return files.select("repo", "path", "ext", F.explode(runs).alias("blob"))


def scan_entropy(lines: DataFrame) -> DataFrame:
    """Long base64 or hex runs (not data URIs), else lines of over 5.8 bits per character; the latter are high beside a key-shaped word."""
    line = lines.where(F.length("text") >= 50).withColumn("bits", F.round(entropy(F.substring("text", 1, 10_000)), 4))
    b64 = F.col("text").rlike(r"[A-Za-z0-9+/]{80,}={0,2}") & ~F.col("text").rlike(r"data:[^\"]*;base64,")
    hexed = F.col("text").rlike(r"\b[0-9a-fA-F]{64,}\b")
    bits = F.col("bits")
    key = F.col("text").rlike(r"(?i)(secret|token|api_?key|password)")
    kind = F.when(b64, "base64-run").when(hexed, "hex-run").when(bits > 5.8, "high-entropy")
    sev = F.when(b64 | hexed | key, "high").otherwise("medium")
    return line.withColumn("kind", kind).where("kind is not null").select("repo", "path", "line", "kind", sev.alias("severity"))


SENSITIVE = r"(?i)(\.env\b|id_rsa|credentials|\.ssh|secret|token|logs?\b)"
VERB = r"(?i)\b(send|post|upload|fetch|visit|forward)\b"
SAFE_HOSTS = ("docs.python.org", "github.com", "developer.mozilla.org")


def scan_prose(lines: DataFrame) -> DataFrame:
    """An order to send a sensitive file to a URL is high, to use a URL of a host that is not safe medium; code fences and lines with mail addresses are left out."""
    text = F.col("text")
    host = url_host(F.regexp_extract("text", r"(https?://[^\s)>\"']+)", 1))
    out = in_fence(lines.where(F.col("ext").isin("md", "txt"))).where("not in_fence and not is_fence").where(~text.rlike(r"[\w.]+@[\w.]+\.\w+"))
    sev = F.when(text.rlike(VERB) & text.rlike(SENSITIVE) & host.isNotNull(), "high").when(text.rlike(VERB) & host.isNotNull() & ~host.isin(*SAFE_HOSTS), "medium")
    return out.withColumn("severity", sev).where("severity is not null").select("repo", "path", "line", "severity")


# ---- registries, tools, actions ----------------------------------------------------------------------------------------------

CANONICAL = ("registry.npmjs.org", "pypi.org", "files.pythonhosted.org", "registry.yarnpkg.com")
ASSURANCE = r"(?i)(official mirror|safe|trusted|verified)"


def scan_registry(files: DataFrame) -> DataFrame:
    """Registry directives whose host, after same-file variables are filled in, is not canonical; with assuring prose in the file high, else medium."""
    lines = to_lines(files, "skip")
    direct = lines.withColumn("value", F.regexp_extract("text", r"(?i)^\s*(?:registry|index-url|--index-url|extra-index-url)\s*[=:]\s*(\S+)", 1)).where("value <> ''")
    direct = direct.withColumn("var", F.regexp_extract("value", r"\$\{?(\w+)\}?", 1))
    assigned = lines.select("repo", "path", F.regexp_extract("text", r"^\s*(?:export\s+)?(\w+)\s*=\s*['\"]?(\S+?)['\"]?\s*$", 1).alias("var"), F.regexp_extract("text", r"^\s*(?:export\s+)?(\w+)\s*=\s*['\"]?(\S+?)['\"]?\s*$", 2).alias("filled")).where("var <> ''")
    assigned = assigned.groupBy("repo", "path", "var").agg(F.max("filled").alias("filled"))
    full = direct.join(assigned, ["repo", "path", "var"], "left").withColumn("url", F.when(F.col("var") == "", F.col("value")).otherwise(F.regexp_replace("value", r"\$\{?\w+\}?", F.coalesce("filled", F.lit("")))))
    full = full.withColumn("host", url_host("url"))
    bad = untrusted_hosts(full, files.sparkSession.createDataFrame([(h,) for h in CANONICAL], "host string"))
    told = files.where(F.col("content").rlike(ASSURANCE)).select("repo", "path").withColumn("told", F.lit(True))
    return bad.join(told, ["repo", "path"], "left").select("repo", "path", "line", "host", F.when(F.col("told"), "high").otherwise("medium").alias("severity"))


ACTION = r"uses:\s*([\w.-]+/[\w./-]+)@([\w.-]+)"


def match_actions(lines: DataFrame, actions: DataFrame) -> DataFrame:
    """Workflow actions: compromised by name and reference (or any), else not pinned to a commit. actions(action, ref)."""
    used = lines.withColumn("action", F.lower(F.regexp_extract("text", ACTION, 1))).withColumn("ref", F.regexp_extract("text", ACTION, 2)).where("action <> ''")
    bad = actions.select(F.lower("action").alias("action"), F.col("ref").alias("bad_ref"))
    hit = used.join(bad, "action", "left").withColumn("hit", F.col("bad_ref").isNotNull() & ((F.col("bad_ref") == "*") | (F.col("bad_ref") == F.col("ref"))))
    rows = hit.groupBy("repo", "path", "line", "action", "ref").agg(F.bool_or("hit").alias("hit"))
    kind = F.when(F.col("hit"), "compromised-action").when(~F.col("ref").rlike("^[0-9a-f]{40}$"), "unpinned-action")
    return rows.withColumn("category", kind).where("category is not null").select("repo", "path", "line", "action", "ref", "category")


def tool_collisions(tools: DataFrame, builtins: DataFrame) -> DataFrame:
    """Tool names(server, name) that shadow a built-in (critical) or are defined by several servers (high)."""
    n = tools.groupBy("name").agg(F.count_distinct("server").alias("servers")).join(builtins.withColumn("built", F.lit(True)), "name", "left")
    sev = F.when(F.col("built"), "critical").when(F.col("servers") > 1, "high")
    return n.withColumn("severity", sev).where("severity is not null").select("name", "servers", "severity")


# ---- configuration files -----------------------------------------------------------------------------------------------------


def _any(lines_col: str, pattern: str) -> Column:
    return F.bool_or(F.col(lines_col).rlike(pattern))


def scan_ci_compound(lines: DataFrame) -> DataFrame:
    """Conjunctions over a workflow file."""
    f = lines.where(F.col("ext").isin("yml", "yaml")).groupBy("repo", "path").agg(
        _any("text", r"(pull_request_target|issue_comment|workflow_run)").alias("untrusted"), _any("text", r"secrets\.").alias("secrets"), _any("text", r"(?i)(claude|copilot|gpt|agent).*action").alias("agentic"),
        _any("text", r"(contents: write|write-all)").alias("write"), _any("text", r"workflow_dispatch").alias("dispatch"), _any("text", r"actions/cache").alias("cache"), _any("text", r"id-token: write").alias("id_token"),
        _any("text", r"(curl|wget|https?://)").alias("external"),
    )
    kinds = F.array(
        F.when(F.col("untrusted") & F.col("secrets"), F.struct(F.lit("untrusted-trigger-with-secrets").alias("category"), F.when(F.col("external") | F.col("agentic"), "critical").otherwise("high").alias("severity"))),
        F.when(F.col("dispatch") & ~F.col("untrusted") & F.col("write"), F.struct(F.lit("zombie-workflow").alias("category"), F.lit("high").alias("severity"))),
        F.when(F.col("untrusted") & (F.col("cache") | F.col("id_token")), F.struct(F.lit("untrusted-cache-write").alias("category"), F.lit("high").alias("severity"))),
        F.when(F.col("untrusted") & F.col("write"), F.struct(F.lit("untrusted-trigger-with-write").alias("category"), F.lit("high").alias("severity"))),
    )
    return f.select("repo", "path", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("repo", "path", "k.*")


def scan_pkg_config(lines: DataFrame) -> DataFrame:
    """What a package configuration sets and what it leaves out."""
    f = lines.groupBy("repo", "path").agg(
        _any("text", r"^\s*(registry|strict-ssl|ignore-scripts|package-lock)\s*=").alias("is_cfg"), _any("text", r"strict-ssl\s*=\s*false").alias("ssl"), _any("text", r"package-lock\s*=\s*false").alias("nolock"),
        _any("text", r"^\s*git\s*=").alias("git"), _any("text", r"dangerouslyAllowAllBuilds:\s*true").alias("builds"), _any("text", r"ignore-scripts\s*=\s*true").alias("ignore"), _any("text", r"min(imum)?-release-age").alias("age"),
    ).where("is_cfg")
    kinds = F.array(
        F.when(F.col("ssl"), F.lit("ssl-off:critical")), F.when(F.col("nolock"), F.lit("no-lockfile:high")), F.when(F.col("git"), F.lit("git-override:critical")), F.when(F.col("builds"), F.lit("all-builds:critical")),
        F.when(~F.col("ignore"), F.lit("scripts-allowed:medium")), F.when(~F.col("age"), F.lit("no-release-age:low")),
    )
    out = f.select("repo", "path", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k"))
    return out.select("repo", "path", F.split_part("k", F.lit(":"), F.lit(1)).alias("category"), F.split_part("k", F.lit(":"), F.lit(2)).alias("severity"))


DANGEROUS_IGNORES = ("*", "**", "**/*", "*.py", "*.js", "*.sh", "src/", "scripts/", "hooks/", ".")


def check_ignore_files(lines: DataFrame) -> DataFrame:
    """Repos with ignore lines: a dangerous wildcard is critical, else medium."""
    got = lines.where(F.col("text").rlike(r"^\s*[\w*./-]*\*[\w*./-]*\s*$"))
    bad = F.bool_or(F.trim("text").isin(*DANGEROUS_IGNORES))
    return got.groupBy("repo").agg(F.when(bad, "critical").otherwise("medium").alias("severity"), F.count("*").alias("entries"))


def sweep_logs(lines: DataFrame, iocs: DataFrame) -> DataFrame:
    """Log lines that name a malicious package or host."""
    word = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9][a-z0-9._-]+)"), 1))
    return lines.withColumn("value", F.explode(word)).join(iocs.select("kind", "value"), "value").select("session", "turn", "kind", "value").distinct()


# ---- size ----------------------------------------------------------------------------------------------------------------------


def oversize_windows(files: DataFrame, limit: int, window: int) -> DataFrame:
    """Head and tail windows of files over ``limit`` characters."""
    big = files.where(F.length("content") > limit)
    parts = F.array(F.struct(F.lit("head").alias("part"), F.substring("content", 1, window).alias("content")), F.struct(F.lit("tail").alias("part"), F.expr(f"substring(content, -{window}, {window})").alias("content")))
    return big.select(*[c for c in files.columns if c != "content"], F.length("content").alias("size"), F.explode(parts).alias("p")).select("*", "p.*").drop("p")


def scan_whitespace(files: DataFrame, run: int = 50_000, ratio: float = 0.5) -> DataFrame:
    """A white-space run of at least ``run``, or white space of at least ``ratio``, with other content left."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all("content", F.lit(r"([ \t\n\r\f]{16,})"), 1), lambda x: F.length(x))), F.lit(0))
    left = F.length(F.regexp_replace("content", r"[ \t\n\r\f]+", ""))
    f = files.withColumn("longest", longest).withColumn("share", F.round(1 - left / F.nullif(F.length("content"), F.lit(0)), 6)).withColumn("left", left)
    return f.where((F.col("left") > 0) & ((F.col("longest") >= run) | (F.col("share") >= ratio))).select("repo", "path", "longest", "share")


# ---- anchors -------------------------------------------------------------------------------------------------------------------


def extract_anchors(lines: DataFrame) -> DataFrame:
    """The first occurrence of each forge repository, package, domain and cloud name in a repo."""
    text = F.col("text")
    forge = F.transform(F.regexp_extract_all(text, F.lit(r"github\.com/([\w.-]+/[\w-]+)"), 1), lambda x: F.struct(F.lit("forge").alias("type"), F.lower(x).alias("target")))
    hosts = F.transform(F.regexp_extract_all(text, F.lit(r"https?://([A-Za-z0-9.-]+)"), 1), lambda x: F.lower(x))
    domain = F.transform(hosts, lambda x: F.struct(F.lit("domain").alias("type"), registrable_domain(x).alias("target")))
    cloud = F.transform(F.filter(hosts, lambda x: cloud_suffix(x).isNotNull()), lambda x: F.struct(F.lit("cloud").alias("type"), x.alias("target")))
    package = F.transform(F.regexp_extract_all(text, F.lit(r"(?:pip|npm) install ([A-Za-z0-9@/._-]+)"), 1), lambda x: F.struct(F.lit("package").alias("type"), F.lower(x).alias("target")))
    every = lines.select("repo", "path", "line", F.explode(F.concat(forge, domain, cloud, package)).alias("a")).select("repo", "path", "line", "a.*").where("target is not null")
    return every.groupBy("repo", "type", "target").agg(F.min(F.struct("path", "line")).alias("f")).select("repo", "type", "target", "f.path", "f.line")


def dead_anchors(anchors: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Anchors with a claimable verdict; a repository counts only if its owner is live, an owner once per repo; without a verdict 'not-checked'. verdicts(key, verdict)."""
    a = anchors.withColumn("owner", F.when(F.col("type") == "forge", F.split_part("target", F.lit("/"), F.lit(1))))
    own = verdicts.select(F.col("key").alias("owner"), F.col("verdict").alias("owner_verdict"))
    at = verdicts.select(F.col("key").alias("target"), "verdict")
    j = a.join(own, "owner", "left").join(at, "target", "left")
    dead_owner = first_by(j.where("owner_verdict = 'claimable'"), ["repo", "owner"], ["path", "line", "target"]).select("repo", F.lit("owner").alias("type"), F.col("owner").alias("target"), F.lit("claimable").alias("verdict"))
    rest = j.where("coalesce(owner_verdict, 'live') = 'live'").select("repo", "type", "target", F.coalesce("verdict", F.lit("not-checked")).alias("verdict")).where("verdict <> 'live'")
    return dead_owner.unionByName(rest)


# ---- repo level ------------------------------------------------------------------------------------------------------------------


def cooccurrence(lines: DataFrame) -> DataFrame:
    """Repos with both memory-access and network lines: file counts and the first line of each."""
    mem, net = F.col("text").rlike(r"(?i)(your memory|conversation history|MEMORY\.md)"), F.col("text").rlike(PRIMITIVES["network"])
    at = F.struct("path", "line")
    g = lines.groupBy("repo").agg(
        F.count_distinct(F.when(mem, F.col("path"))).alias("memory_files"), F.count_distinct(F.when(net, F.col("path"))).alias("network_files"), F.min(F.when(mem, at)).alias("m"), F.min(F.when(net, at)).alias("n")
    )
    return g.where("memory_files > 0 and network_files > 0").select("repo", "memory_files", "network_files", F.col("m.path").alias("memory_path"), F.col("n.path").alias("network_path"))
