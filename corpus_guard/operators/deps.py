"""Dependencies: joins against threat tables, spec checks, lockfiles, releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_guard.functions.scalars import canonical_package, l33t_normalize, normalize_version, sequence_ratio, url_host
from corpus_guard.plans.staging import BROADCAST_ROWS, counted


def match_compromised(deps: DataFrame, compromised: DataFrame, strict_pin: bool = True) -> DataFrame:
    """Dependencies at a compromised version; version '*' means all. compromised(campaign, package, version) is a feed-sized table, broadcast when its counted rows are few: names are few and hot."""
    d = deps.withColumn("name_l", F.lower("name")).withColumn("version_n", normalize_version(F.concat("prefix", "version") if "prefix" in deps.columns else "version", strict_pin))
    c = compromised.select("campaign", F.lower("package").alias("name_l"), normalize_version("version").alias("c_version"), (F.col("version") == "*").alias("any"))
    exact = d.join(counted(c.where("not any").withColumnRenamed("c_version", "version_n").drop("any"), "compromised-versions"), ["name_l", "version_n"])
    wild = d.join(counted(c.where("any").drop("c_version", "any"), "compromised-names"), "name_l")
    return exact.unionByName(wild.select(*exact.columns)).drop("name_l", "version_n")


def match_ioc_names(deps: DataFrame, names: DataFrame) -> DataFrame:
    """Dependencies with a malicious name, any version. names(name)."""
    bad = counted(names.select(F.lower("name").alias("_bad")).distinct(), "bad-names")
    return deps.join(bad, F.lower("name") == F.col("_bad"), "left_semi")


def match_scopes(deps: DataFrame, scopes: DataFrame) -> DataFrame:
    """Names under a suspicious scope: an equi-join on the part before the first slash. scopes(scope)."""
    return deps.withColumn("scope", F.split_part("name", F.lit("/"), F.lit(1))).join(scopes.distinct(), "scope", "left_semi")


def typosquats(deps: DataFrame, popular: DataFrame, ratio: float = 0.85) -> DataFrame:
    """Names like a popular one but not popular themselves. popular(ord, popular) by rank; the first similar one wins.

    Distinct names are joined with popular ones on shared bigrams of the plain
    form inside a length band, so no pair without a common bigram is compared.
    """
    names = deps.select(F.lower("name").alias("name")).distinct().join(popular.select(F.col("popular").alias("name")), "name", "left_anti")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    a = names.withColumn("plain", l33t_normalize("name")).withColumn("g", F.explode(grams(F.col("plain"))))
    b = popular.withColumn("p_plain", l33t_normalize("popular")).withColumn("g", F.explode(grams(F.col("p_plain"))))
    band = F.greatest(F.lit(3), F.ceil(F.length("popular") * 0.15))
    pairs = a.join(b, "g").where(F.abs(F.length("name") - F.length("popular")) <= band).select("name", "plain", "ord", "popular", "p_plain").distinct()
    near = pairs.where((sequence_ratio("name", "popular") > ratio) | (sequence_ratio("plain", "p_plain") > ratio))
    return near.groupBy("name").agg(F.min_by("popular", "ord").alias("popular"))


def _rests(c: Column, most: int) -> Column:
    """What is left of a string after up to ``most`` deletions, the string itself included."""
    rests = F.array(c)
    for _ in range(most):
        cut = lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        rests = F.array_distinct(F.concat(rests, F.flatten(F.transform(rests, cut))))
    return rests


def near_names(deps: DataFrame, popular: DataFrame, most: int = 2) -> DataFrame:
    """D5 by edit distance: the first popular name within ``most`` edits.

    An edit takes away two bigrams at most, so names of at least 2 * most + 2 characters
    share a bigram with any name that near; shorter ones meet on equal rests after up to
    ``most`` deletions, which all pairs within ``most`` edits have.
    """
    names = deps.select(F.lower("name").alias("name")).distinct().join(popular.select(F.col("popular").alias("name")), "name", "left_anti")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    a = names.withColumn("g", F.explode(grams(F.col("name"))))
    b = popular.withColumn("g", F.explode(grams(F.col("popular"))))
    short = lambda df, c: df.where(F.length(c) < 2 * most + 2).withColumn("g", F.explode(_rests(F.col(c), most)))
    pairs = a.join(b, "g").unionByName(short(names, "name").join(short(popular, "popular"), "g"))
    pairs = pairs.where(F.abs(F.length("name") - F.length("popular")) <= most).select("name", "ord", "popular").distinct()
    near = pairs.where(F.levenshtein("name", "popular") <= most)
    return near.groupBy("name").agg(F.min_by("popular", "ord").alias("popular"))


def slopsquats(deps: DataFrame, names: DataFrame) -> DataFrame:
    """Names that models are known to invent, per ecosystem. names(ecosystem, name)."""
    known = counted(names.select("ecosystem", F.lower("name").alias("_n")).distinct(), "invented-names")
    return deps.withColumn("_n", F.lower("name")).join(known, ["ecosystem", "_n"], "left_semi").drop("_n")


GENERIC = ("core", "utils", "lib", "app", "monorepo", "packages", "sdk", "api", "server", "client")


def starjacking(manifests: DataFrame, least: float = 0.5) -> DataFrame:
    """manifests(repo, name, repo_name) whose repository name is unlike the package name."""
    m = manifests.where(~F.lower("repo_name").isin(*GENERIC)).withColumn("ratio", sequence_ratio(F.lower("repo_name"), F.lower("name")))
    return m.where(F.col("ratio") < least)


def trusted_hosts(urls: DataFrame, trusted: DataFrame) -> DataFrame:
    """The distinct hosts among urls(host) that equal a trusted host or lie under one: host suffixes exploded, then an equi-join. Staged and counted, since hosts may be few and hot."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = urls.select("host").where("host is not null").distinct()
    return counted(hosts.withColumn("suffix", F.explode(suffixes)).join(trusted.select(F.col("host").alias("suffix")), "suffix", "left_semi").select("host").distinct(), "trusted-hosts")


#: Trusted hosts up to which a host is compared with each in its row.
FEW_HOSTS = 64


def is_trusted(hosts: list[str]) -> Column:
    """Whether the column host equals one of a few hosts or lies under one."""
    hit = F.lit(False)
    for h in hosts:
        hit = hit | (F.col("host") == h) | F.endswith("host", F.lit("." + h))
    return hit


def untrusted_hosts(urls: DataFrame, trusted: DataFrame) -> DataFrame:
    """urls(host) that neither equal a trusted host nor lie under one."""
    return urls.where("host is not null").join(trusted_hosts(urls, trusted), "host", "left_anti")


def phantom_deps(imports: DataFrame, declared: DataFrame, builtins: DataFrame) -> DataFrame:
    """Imported - declared - builtins, for repos with a manifest. imports(repo, name), declared(repo, name), builtins(name)."""
    return imports.join(declared.select("repo").distinct(), "repo", "left_semi").join(declared, ["repo", "name"], "left_anti").join(builtins, "name", "left_anti").distinct()


def unused_deps(imports: DataFrame, declared: DataFrame, tooling: DataFrame) -> DataFrame:
    """Declared - imported - tooling."""
    return declared.join(imports, ["repo", "name"], "left_anti").join(tooling, "name", "left_anti").distinct()


LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "uv.lock", "Cargo.lock")


def missing_lockfiles(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """manifests(repo, dir) without a lockfile in their directory or its two parents."""
    up = F.array_distinct(F.array(F.col("dir"), F.regexp_replace("dir", "(^|/)[^/]*$", ""), F.regexp_replace(F.regexp_replace("dir", "(^|/)[^/]*$", ""), "(^|/)[^/]*$", "")))
    locks = files.where(F.col("base").isin(*LOCKFILES)).select("repo", F.col("dir").alias("at")).distinct()
    found = manifests.withColumn("at", F.explode(up)).join(locks, ["repo", "at"], "left_semi").select("repo", "dir").distinct()
    return manifests.join(found, ["repo", "dir"], "left_anti")


def check_dep_specs(deps: DataFrame) -> DataFrame:
    """Git, http and file specs, and bare commits, with their severity."""
    spec = F.concat("prefix", "version")
    kind = (
        F.when(spec.rlike(r"^git(\+|:)|^github:"), "git-dependency").when(spec.rlike(r"^https?://"), "http-dependency").when(spec.startswith("file:"), "file-dependency")
        .when(spec.rlike(r"#[0-9a-f]{40}$"), "orphan-commit")
    )
    sev = F.when(kind.isin("git-dependency", "orphan-commit"), "high").when(kind == "http-dependency", "critical").otherwise("medium")
    return deps.withColumn("spec", spec).withColumn("category", kind).withColumn("severity", sev).where("category is not null")


def version_anomaly(deps: DataFrame, least: int = 90) -> DataFrame:
    """A major version of at least ``least``."""
    return deps.where(F.regexp_extract("version", r"^[vV=^~>]*\s*(\d+)", 1).try_cast("int") >= least)


def unbounded_ranges(deps: DataFrame, locked: DataFrame) -> DataFrame:
    """Bare or lower-bounded specs in repos without a lockfile. locked(repo)."""
    spec = F.concat("prefix", "version")
    sev = F.when(spec.rlike(r"^(\*|latest|)$"), "high").when(spec.rlike(r"^>=?[^,<]*$"), "medium")
    return deps.withColumn("severity", sev).where("severity is not null").join(locked, "repo", "left_anti")


def lock_urls(lines: DataFrame, trusted: DataFrame, most: int = 5) -> DataFrame:
    """Per file the first ``most`` URLs on lines whose host is not trusted."""
    found = lines.select("repo", "path", "line", F.posexplode(F.regexp_extract_all("text", F.lit(r"(https?://[^\s\"'<>)]+)"), 1)).alias("at", "url")).withColumn("host", url_host("url"))
    bad = untrusted_hosts(found, trusted)
    rn = F.row_number().over(Window.partitionBy("repo", "path").orderBy("line", "at"))
    return bad.withColumn("rn", rn).where(F.col("rn") <= most).select("repo", "path", "line", "url", "host")


def lock_injection(deps: DataFrame, trusted: DataFrame) -> DataFrame:
    """Locked packages over plain http, without integrity, or from a host that is not trusted."""
    d = deps.withColumn("host", url_host("resolved_url"))
    few = [r.host for r in trusted.where("host is not null").limit(FEW_HOSTS + 1).collect()]
    if len(few) <= FEW_HOSTS:  # in place of a second reading of the dependencies for their hosts
        d = d.withColumn("untrusted", F.col("host").isNotNull() & ~is_trusted(few)).select("host", *deps.columns, "untrusted")
    else:
        d = d.join(trusted_hosts(d, trusted).withColumn("good", F.lit(True)), "host", "left").withColumn("untrusted", F.col("host").isNotNull() & F.col("good").isNull()).drop("good")
    kinds = F.array(
        F.when(F.col("resolved_url").startswith("http://"), F.lit("insecure-protocol")), F.when(F.isnull("integrity"), F.lit("missing-integrity")), F.when(F.col("untrusted"), F.lit("untrusted-registry"))
    )
    return d.withColumn("category", F.explode(F.filter(kinds, lambda k: k.isNotNull()))).drop("untrusted")


def with_overrides(deps: DataFrame, overrides: DataFrame) -> DataFrame:
    """H5: override names that are not declared are added."""
    return deps.unionByName(overrides.join(deps.select("repo", "name").distinct(), ["repo", "name"], "left_anti"), allowMissingColumns=True)


def by_package(deps: DataFrame, *spread: str) -> DataFrame:
    """Dependencies dealt by range of package, so that few packages meet in a task; a package of many is split by the columns ``spread``.

    For joins whose matches are many: rows of one package meet the same rows, and files by columns store such repeats in little space.
    """
    spark, keys = deps.sparkSession, ["ecosystem", "name", *spread]
    parts = max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return deps.repartitionByRange(parts, *keys)


def enrich_vulns(deps: DataFrame, advisories: DataFrame, kev: DataFrame) -> DataFrame:
    """Advisories of each package; any alias among the exploited ids makes it critical, else bands of the score. advisories(ecosystem, package, id, aliases, cvss), kev(cve)."""
    a = advisories.withColumn("package", canonical_package("ecosystem", "package"))
    alias = a.select("id", F.explode_outer(F.array_append("aliases", F.col("id"))).alias("cve")).join(kev.select(F.upper("cve").alias("cve")).distinct().withColumn("hit", F.lit(True)), "cve", "left")
    known = alias.groupBy("id").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("exploited"))
    d = deps.withColumn("package", canonical_package("ecosystem", "name"))
    # advisories are finished before they meet the dependencies, whose matches may be many and then go through no further join
    band = F.when(F.col("exploited"), "critical").when(F.col("cvss") >= 9, "critical").when(F.col("cvss") >= 7, "high").when(F.col("cvss") >= 4, "medium").otherwise("low")
    finished = counted(a.join(known, "id").withColumn("severity", band), "advisories", 10 * BROADCAST_ROWS)
    return d.join(finished, ["ecosystem", "package"])


def release_history(releases: DataFrame) -> DataFrame:
    """releases in order of time with the previous maintainer and the number of versions so far and in all."""
    w = Window.partitionBy("package").orderBy("published", "version", "maintainer")
    return (
        releases.withColumn("prev_maintainer", F.lag("maintainer").over(w)).withColumn("nth", F.row_number().over(w))
        .withColumn("version_count", F.count("*").over(Window.partitionBy("package")))
    )


def freshness(releases: DataFrame, popular: DataFrame, as_of) -> DataFrame:
    """The latest release of each package that is not popular: age bands, single young versions and changes of maintainer. popular(package)."""
    w = Window.partitionBy("package").orderBy(F.desc("published"), F.desc("version"), F.desc("maintainer"))
    last = release_history(releases).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn").join(popular, "package", "left_anti")
    hours = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("published")) / 3600
    kinds = F.array(
        F.when((hours >= 0) & (hours < 24), F.lit("freshness-new-release:high")), F.when((hours >= 24) & (hours < 168), F.lit("freshness-recent-release:medium")),
        F.when((F.col("version_count") == 1) & (hours >= 0) & (hours < 720), F.lit("freshness-brand-new-package:high")),
        F.when(F.col("prev_maintainer").isNotNull() & (F.col("prev_maintainer") != F.col("maintainer")), F.lit("maintainer-changed:high")),
    )
    out = last.withColumn("k", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
    return out.select("package", "version", F.split_part("k", F.lit(":"), F.lit(1)).alias("category"), F.split_part("k", F.lit(":"), F.lit(2)).alias("severity"))


def sweep_installed(installed: DataFrame, compromised: DataFrame) -> DataFrame:
    """Installed versions that are compromised."""
    return match_compromised(installed, compromised, strict_pin=False)


# ---- install commands ----------------------------------------------------------------------------------------------------

#: Ordered command kinds; the first that matches wins.
INSTALL_KINDS: tuple[tuple[str, str], ...] = (
    ("pipe-to-shell", r"(curl|wget)\s[^|;&]*\|\s*(sudo\s+)?(ba|z|da)?sh\b"), ("process-substitution", r"(ba|z)?sh\s+<\(\s*(curl|wget)"), ("npx", r"\bnpx\s+(-\w+\s+)*[@A-Za-z]"),
    ("npm", r"\bnpm\s+(?:--?[\w=./-]+\s+)*(install|i|add|ci|update|up)\b"), ("yarn", r"\byarn\s+(?:--?[\w=./-]+\s+)*((global\s+)?add|install|up)\b"), ("pnpm", r"\bpnpm\s+(?:--?[\w=./-]+\s+)*(add|install|i|update)\b"), ("bun", r"\bbun\s+(?:--?[\w=./-]+\s+)*(add|install|update)\b"),
    ("uv-pip", r"\buv\s+pip\s+install\b"), ("uv", r"\buv\s+(add|sync|tool\s+install)\b"), ("pipx", r"\bpipx\s+install\b"), ("pip", r"\bpip3?\s+install\b"), ("poetry", r"\bpoetry\s+add\b"),
    ("conda", r"\bconda\s+install\b"), ("gem", r"\b(gem|bundle)\s+(install|update)\b"), ("cargo", r"\bcargo\s+(install|add)\b"), ("go", r"\bgo\s+(install|get)\b"), ("brew", r"\bbrew\s+install\b"),
    ("apt", r"\bapt(-get)?\s+install\b"), ("git-clone", r"\bgit\s+clone\b"), ("git-pull", r"\bgit\s+pull\b"), ("submodule", r"\bgit\s+submodule\s+add\b"), ("gh-clone", r"\bgh\s+repo\s+clone\b"),
)
PYTHON_KINDS = ("pip", "uv-pip", "uv", "pipx", "poetry")


def detect_installs(commands: DataFrame, col: str = "command") -> DataFrame:
    """Adds kind, null when the command installs nothing."""
    return commands.withColumn("kind", F.coalesce(*[F.when(F.col(col).rlike(p), F.lit(k)) for k, p in INSTALL_KINDS]))


_TAIL = r"\b(?:npm\s+(?:install|i|add|ci)|yarn\s+(?:global\s+)?add|pnpm\s+(?:add|install|i)|bun\s+(?:add|install)|uv\s+pip\s+install|uv\s+(?:add|tool\s+install)|pipx\s+install|pip3?\s+install|poetry\s+add)\s+([^;&|\n]*)"


def command_packages(commands: DataFrame, col: str = "command") -> DataFrame:
    """Package names of install commands: flags dropped, versions cut, scopes kept."""
    words = F.filter(F.split(F.regexp_extract(col, _TAIL, 1), r"\s+"), lambda w: (w != "") & ~w.startswith("-"))
    named = detect_installs(commands, col).where(F.col("kind").isNotNull()).withColumn("word", F.explode(words))
    name = F.when(F.col("kind").isin(*PYTHON_KINDS), F.regexp_extract("word", r"^([A-Za-z0-9._-]+)", 1)).otherwise(F.regexp_extract("word", r"^(@?[^@\s]+)", 1))
    return named.withColumn("package", F.lower(name)).where("package <> ''").drop("word")
