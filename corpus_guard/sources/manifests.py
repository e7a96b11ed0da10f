"""Dependencies of manifests and lockfiles (A11-A19), threat tables (A6, A8-A10, A26) and findings in and out.

Each extractor takes files(repo, path, content) of its kind and returns
(repo, path, name, version, kind). Text formats are read line by line with windows
over the lines of a file; JSON goes through declared schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_guard.operators.lines import cut_at, once, sections, to_lines
from corpus_guard.plans.staging import stage
from corpus_guard.schema import FINDING

_MAP = T.MapType(T.StringType(), T.StringType())


def _row(df: DataFrame, name: Column, version: Column, kind: Column | str) -> DataFrame:
    return df.select("repo", "path", name.alias("name"), version.alias("version"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"))


NPM_MAPS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def npm_manifest(files: DataFrame) -> DataFrame:
    """The four dependency maps, and overrides and resolutions of one level that the maps do not name."""
    schema = T.StructType([T.StructField(m, _MAP) for m in (*NPM_MAPS, "overrides", "resolutions")])
    j = files.withColumn("j", F.from_json("content", schema)).where("j is not null")

    def entries(m: str) -> Column:
        return F.transform(F.map_entries(F.coalesce(F.col(f"j.{m}"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("version"), F.lit(m).alias("kind")))

    maps = [entries(m) for m in NPM_MAPS]
    declared = j.select("repo", "path", F.explode(F.concat(*maps)).alias("d")).select("repo", "path", "d.*")
    extra = F.map_entries(F.coalesce(F.col("j.overrides"), F.create_map().cast("map<string,string>")))
    more = F.map_entries(F.coalesce(F.col("j.resolutions"), F.create_map().cast("map<string,string>")))
    forced = j.select("repo", "path", F.explode(F.concat(extra, more)).alias("e")).select("repo", "path", F.regexp_replace("e.key", r"^(\*\*/)+", "").alias("name"), F.col("e.value").alias("version"), F.lit("override").alias("kind"))
    forced = forced.where(~F.col("version").startswith("{")).join(declared.select("repo", "path", "name"), ["repo", "path", "name"], "left_anti")
    return declared.unionByName(forced)


def flatten_overrides(files: DataFrame, depth: int = 32) -> DataFrame:
    """Nested overrides of manifests: each leaf with the name of its innermost package; '.' names the package that holds it. Each level is written once, so that deeper ones do not compute it again."""
    v = files.select("repo", "path", F.variant_get(F.try_parse_json("content"), "$.overrides", "variant").alias("v"), F.lit("").alias("owner")).where("v is not null")
    out, v = None, stage(v, "overrides")
    for _ in range(depth):
        v.createOrReplaceTempView("_overrides")
        level = v.sparkSession.sql("select o.repo, o.path, o.owner, e.key, e.value, schema_of_variant(e.value) as kind from _overrides o, lateral variant_explode(o.v) e")
        leaf = level.where("kind = 'STRING'").select("repo", "path", F.when(F.col("key") == ".", F.col("owner")).otherwise(F.regexp_replace("key", r"^(\*\*/)+", "")).alias("name"), F.expr("cast(value as string)").alias("version"))
        out = leaf if out is None else out.unionByName(leaf)
        v = stage(level.where("kind like 'OBJECT%'").select("repo", "path", F.col("value").alias("v"), F.regexp_replace("key", r"^(\*\*/)+", "").alias("owner")), "overrides")
        if v.isEmpty():
            break
    return out.select("repo", "path", "name", "version", F.lit("override").alias("kind"))


_REQ = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*((?:[=<>!~]=?=?[^;#\s]+\s*,?\s*)*)"


def requirements(files: DataFrame) -> DataFrame:
    """Requirement lines; options, comments and URLs are left out, an exact pin loses its marks."""
    lines = to_lines(files).where(F.col("text").rlike(_REQ) & ~F.col("text").rlike(r"^\s*(#|-|https?:|git\+)"))
    spec = F.trim(F.regexp_extract("text", _REQ, 2))
    return _row(lines, F.regexp_extract("text", _REQ, 1), F.regexp_replace(spec, r"^==", ""), "requirement")


def package_lock(files: DataFrame) -> DataFrame:
    """Packages of lockfile version 2 and later (flat), or dependencies of version 1 to three levels."""
    entry = T.StructType([T.StructField("version", T.StringType()), T.StructField("resolved", T.StringType()), T.StructField("integrity", T.StringType())])
    nested: T.StructType = entry
    for _ in range(2):
        nested = T.StructType([*entry.fields, T.StructField("dependencies", T.MapType(T.StringType(), nested))])
    schema = T.StructType([T.StructField("packages", T.MapType(T.StringType(), entry)), T.StructField("dependencies", T.MapType(T.StringType(), nested))])
    j = files.withColumn("j", F.from_json("content", schema)).where("j is not null")
    flat = j.select("repo", "path", F.explode("j.packages").alias("k", "e")).where("k <> ''")
    out = flat.select("repo", "path", F.regexp_replace("k", r"^.*node_modules/", "").alias("name"), "e.version", F.lit("locked").alias("kind"), "e.resolved", "e.integrity")
    level = j.where("j.packages is null").select("repo", "path", F.explode("j.dependencies").alias("name", "e"))
    for depth in range(3):
        out = out.unionByName(level.select("repo", "path", "name", "e.version", F.lit("locked").alias("kind"), "e.resolved", "e.integrity"))
        if depth < 2:
            level = level.select("repo", "path", F.explode("e.dependencies").alias("name", "e"))
    return out


def yarn_lock(files: DataFrame) -> DataFrame:
    """Entries of a yarn lockfile: the version line below each header."""
    header = r'^"?(@?[^@"\s][^@"]*)@[^:]*:\s*$'
    lines = sections(files, header).select("repo", "path", F.regexp_extract("head", header, 1).alias("section"), F.explode("body").alias("text"))
    v = lines.where(F.col("text").rlike(r'^\s+version:?\s+"?[^"\s]+"?\s*$'))
    return _row(v, F.col("section"), F.regexp_extract("text", r'version:?\s+"?([^"\s]+)"?', 1), "locked")


def poetry_lock(files: DataFrame) -> DataFrame:
    """Name and version of each package block."""
    block = cut_at(sections(files, r"^\[\[package\]\]\s*$"), "body", r"^\[")
    inside = F.filter("parts", lambda p: p["head"].isNull() | p["head"].startswith("[[package]]"))
    block = block.withColumn("kept", once(F.flatten(F.transform(inside, lambda p: p["body"]))))
    pick = lambda k: F.array_max(F.transform(F.filter("kept", lambda x: x.rlike(rf"^{k}\s*=")), lambda x: F.regexp_extract(x, r'=\s*"([^"]*)"', 1)))
    out = block.select("repo", "path", pick("name").alias("name"), pick("version").alias("version"))
    return _row(out.where("name is not null"), F.col("name"), F.col("version"), "locked")


def pnpm_lock(files: DataFrame) -> DataFrame:
    """Keys of the packages section: /name@version (v6, v9) with peers cut off."""
    packages = sections(files, r"^([A-Za-z]+):\s*$").where(F.col("head").rlike(r"^packages:\s*$"))
    key = r"^\s{2}'?/?((?:@[^/'\s]+/)?[^@'\s(/]+)@([^:'(\s]+)(?:\([^)]*\))*'?:\s*$"
    hit = packages.select("repo", "path", F.explode("body").alias("text")).where(F.col("text").rlike(key))
    return _row(hit, F.regexp_extract("text", key, 1), F.regexp_extract("text", key, 2), "locked")


def pipfile_lock(files: DataFrame) -> DataFrame:
    """Default and develop sections."""
    entry = T.MapType(T.StringType(), T.StructType([T.StructField("version", T.StringType())]))
    j = files.withColumn("j", F.from_json("content", T.StructType([T.StructField("default", entry), T.StructField("develop", entry)])))
    both = None
    for part in ("default", "develop"):
        x = j.select("repo", "path", F.explode(f"j.{part}").alias("name", "e")).select("repo", "path", "name", F.regexp_replace("e.version", "^==", "").alias("version"), F.lit(part).alias("kind"))
        both = x if both is None else both.unionByName(x)
    return both


EXTRACTORS = (
    (r"(^|/)package\.json$", npm_manifest), (r"(^|/)requirements[\w.-]*\.txt$", requirements), (r"(^|/)package-lock\.json$", package_lock), (r"(^|/)yarn\.lock$", yarn_lock),
    (r"(^|/)poetry\.lock$", poetry_lock), (r"(^|/)pnpm-lock\.yaml$", pnpm_lock), (r"(^|/)Pipfile\.lock$", pipfile_lock),
)


def extract_dependencies(files: DataFrame) -> DataFrame:
    """The dependencies of all manifests and lockfiles in ``files``."""
    out = None
    for pattern, fn in EXTRACTORS:
        got = fn(files.where(F.col("path").rlike(pattern))).select("repo", "path", "name", "version", "kind")
        out = got if out is None else out.unionByName(got)
    return out


# ---- threat tables ---------------------------------------------------------------------------------------------------------

_CAMPAIGN = T.StructType([T.StructField("title", T.StringType()), T.StructField("ecosystem", T.StringType()), T.StructField("packages", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])


def load_compromised(spark: SparkSession, path: str) -> DataFrame:
    """Campaigns, packages and versions as rows; '*' marks all versions."""
    raw = spark.read.schema(T.StructType([T.StructField("campaigns", T.MapType(T.StringType(), _CAMPAIGN))])).option("multiLine", True).json(path)
    c = raw.select(F.explode("campaigns").alias("campaign", "c")).select("campaign", "c.ecosystem", F.explode("c.packages").alias("package", "versions"))
    return c.select("campaign", "ecosystem", "package", F.explode("versions").alias("version")).withColumn("wildcard", F.col("version") == "*")


def load_package_list(spark: SparkSession, path: str, most: int = 10_000, most_wild: int = 100) -> DataFrame:
    """name@version lines; too many entries or wildcards are an error, not a cut."""
    raw = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    rows = raw.select(F.regexp_extract("value", r"^\s*(@?[^@\s]+)@(\S+)\s*$", 1).alias("name"), F.regexp_extract("value", r"^\s*(@?[^@\s]+)@(\S+)\s*$", 2).alias("version")).where("name <> ''").withColumn("wildcard", F.col("version") == "*")
    n = rows.agg(F.count("*").alias("n"), F.count_if("wildcard").alias("w")).first()
    if n.n > most or n.w > most_wild:
        raise ValueError(f"package list of {n.n} entries and {n.w} wildcards; at most {most} and {most_wild} are allowed")
    return rows


def load_kev(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """Ids of exploited vulnerabilities in upper case; a set of fewer than ``least`` valid ids is rejected (empty)."""
    raw = spark.read.schema("vulnerabilities array<struct<cveID:string>>").option("multiLine", True).json(path)
    cve = raw.select(F.explode("vulnerabilities.cveID").alias("cve")).select(F.upper("cve").alias("cve")).where(F.col("cve").rlike(r"^CVE-\d{4}-\d{4,}$")).distinct()
    n = cve.agg(F.count("*").alias("n"))
    return cve.crossJoin(F.broadcast(n)).where(F.col("n") >= least).drop("n")


_OSV = (
    "vulns array<struct<id:string,aliases:array<string>,summary:string,severity:array<struct<type:string,score:string>>,"
    "affected:array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>>>"
)


def load_advisories(spark: SparkSession, path: str) -> DataFrame:
    """A10: advisories with aliases, score and the first ten fixed versions."""
    v = spark.read.schema(_OSV).option("multiLine", True).json(path).select(F.explode("vulns").alias("v")).select("v.*")
    events = F.flatten(F.flatten(F.transform("affected", lambda a: F.transform(a["ranges"], lambda r: r["events"]))))
    fixed = F.slice(F.array_distinct(F.filter(F.transform(events, lambda e: e["fixed"]), lambda x: x.isNotNull())), 1, 10)
    first = F.get("affected", F.lit(0))
    return v.select(F.lower(first["package"]["ecosystem"]).alias("ecosystem"), first["package"]["name"].alias("package"), "id", "aliases", "summary", F.get("severity", F.lit(0))["score"].try_cast("double").alias("cvss"), fixed.alias("fixed_in"))


def load_releases(spark: SparkSession, path: str) -> DataFrame:
    """Publish times of a registry document(name, time map, versions map with maintainer) as rows."""
    schema = "name string, time map<string,string>, versions map<string,struct<maintainer:string>>"
    r = spark.read.schema(schema).option("multiLine", True).json(path)
    t = r.select("name", "versions", F.explode("time").alias("version", "published")).where("version not in ('created', 'modified')")
    return t.select(F.col("name").alias("package"), "version", F.col("published").try_cast("timestamp").alias("published"), F.try_element_at("versions", F.col("version"))["maintainer"].alias("maintainer"))


# ---- findings in and out -----------------------------------------------------------------------------------------------------


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of JSON lines; a row that cannot be read becomes a scan-incomplete finding, not silence."""
    schema = T.StructType([*FINDING.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    bad = F.col("_corrupt_record").isNotNull()
    fill = {"scanner": "reader", "severity": "high", "title": "Scanner output could not be read", "category": "scan-incomplete"}
    return raw.select(*[F.when(bad, F.lit(fill[f.name])).otherwise(F.col(f.name)).alias(f.name) if f.name in fill else F.col(f.name) for f in FINDING.fields])


def write_findings(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Findings by repo as parquet or JSON, severest first within a file, or counts by severity."""
    from corpus_guard.functions.scalars import severity_score
    from corpus_guard.operators.report import summarize

    if fmt == "summary":
        summarize(df).write.json(path)
    else:
        df.sortWithinPartitions("repo", severity_score("severity").desc()).write.partitionBy("repo").format(fmt).save(path)
