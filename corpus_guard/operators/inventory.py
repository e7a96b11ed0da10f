"""Inventories of agent stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED_DIRS = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".tox")
IGNORED_EXT = ("png", "jpg", "jpeg", "gif", "ico", "woff", "woff2", "zip", "gz", "pyc", "so", "dll", "exe", "lock")
MAX_SIZE = 10 * 1024 * 1024


def read_corpus(spark: SparkSession, source, aux: bool = False) -> DataFrame:
    """A1, A2: files of a folder (binaryFile, listed in parallel) or of a DataFrame with path and content.

    The plain scan prunes ignored directories, binary kinds and files over 10 MB - path and
    length filters reach the scan; the auxiliary scan keeps all.
    """
    if isinstance(source, str):
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).withColumnRenamed("content", "bytes").withColumn("size", F.col("length"))
        raw = raw.withColumn("content", F.try_validate_utf8(F.col("bytes").cast("string")))
    else:
        raw = source.withColumn("size", F.octet_length("content").cast("long"))
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    out = raw.withColumn("base", base).withColumn("ext", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    if aux:
        return out
    return out.where((F.col("size") <= MAX_SIZE) & ~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED_DIRS))) & ~F.col("ext").isin(*IGNORED_EXT))


#: Surface of a path; the first pattern that matches wins.
SURFACES: tuple[tuple[str, str], ...] = (
    ("credentials", r"(?i)(credentials|\.env$|auth\.json|id_rsa)"), ("skills", r"(?i)(^|/)skills?/|/doc-\d*1\.\w+$"), ("hooks", r"(?i)(^|/)hooks?/|\.sh$"), ("mcp", r"(?i)mcp|\.json$"),
    ("plugins", r"(?i)(^|/)plugins?/|\.js$"), ("commands", r"(?i)(^|/)commands?/|\.toml$"), ("memory", r"(?i)(memory|agents)\.md$|\.md$"), ("shadow", r"(?i)(^|/)\.[a-z]+/"),
)


def inventory(files: DataFrame) -> DataFrame:
    """Files with their surface and ecosystem (the first directory)."""
    surface = F.coalesce(*[F.when(F.col("path").rlike(p), F.lit(s)) for s, p in SURFACES])
    return files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("ecosystem"), surface.alias("surface"), "path", F.col("base").alias("name"), F.length("content").alias("size_bytes")).where("surface is not null")


def surface_counts(inv: DataFrame) -> DataFrame:
    """Files per ecosystem and surface, one column per surface."""
    return inv.groupBy("ecosystem").agg(*[F.count_if(F.col("surface") == s).alias(s) for s, _ in SURFACES])


def shared_configs(inv: DataFrame) -> DataFrame:
    """File names that several ecosystems share, with their number."""
    return inv.groupBy("name").agg(F.count_distinct("ecosystem").alias("ecosystems")).where("ecosystems > 1")


MARKERS = r"(?i)(mcpServers|SessionStart|sub-agent|\"hooks\")"


def is_agent_repo(files: DataFrame) -> DataFrame:
    """Repos with any marker path or content."""
    return files.groupBy("repo").agg(F.bool_or(F.col("base").rlike(r"(?i)^(skill|agents|claude)\.md$") | F.col("content").rlike(MARKERS)).alias("is_agent"))


def shape_counts(files: DataFrame) -> DataFrame:
    """Lines that are neither empty nor comments, and server entries of JSON files."""
    lines = F.filter(F.split("content", "\n", -1), lambda x: ~x.rlike(r"^\s*(#.*|//.*)?$"))
    servers = F.size(F.regexp_extract_all("content", F.lit(r'("command"\s*:)'), 1))
    return files.select("path", F.size(lines).alias("lines"), servers.alias("servers"))


def detect_ecosystems(files: DataFrame, signals: DataFrame) -> DataFrame:
    """Ecosystems of which a signal file exists. signals(ecosystem, base)."""
    names = files.select("base").distinct()
    return signals.join(names.withColumn("there", F.lit(True)), "base", "left").groupBy("ecosystem").agg(F.coalesce(F.bool_or("there"), F.lit(False)).alias("present"))
