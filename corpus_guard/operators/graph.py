"""Reference graphs, import graphs and cross-file taint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.plans.staging import stage

REFERENCE = r"([A-Za-z0-9_-]+-\d+\.(?:md|txt|py|js|json|sh|yml|toml))"
IMPORT = r"(?:^|\s)(?:from\s+([A-Za-z_][\w.]*)\s+import|import\s+([A-Za-z_][\w.]*)|require\(['\"]([^'\"]+)['\"]\))"


def reference_edges(files: DataFrame) -> DataFrame:
    """Edges (repo, src, dst) from a file to the files of its repo that its text names."""
    named = files.select("repo", F.col("base").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(REFERENCE), 1))).alias("dst"))
    known = files.select("repo", F.col("base").alias("dst")).distinct()
    return named.where("src <> dst").join(known, ["repo", "dst"], "left_semi").select("repo", "src", "dst").distinct()


def reference_chains(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """Chains of 2 to ``depth`` hops from seed files (repo, src): an edge is followed once for each seed.

    A loop over frontiers: edges that leave it and that its seed has not followed yet (an anti-join), of several chains
    to an edge the least; an edge back into its own chain stays open for others. So rows are bounded by seeds times
    edges, however many paths there are. Each frontier is staged.
    """
    step = stage(edges.select("repo", F.col("src").alias("end"), F.col("dst").alias("next")), "reference-edges")
    starts = seeds.select("repo", F.col("src").alias("seed")).distinct()
    front = starts.select("repo", "seed", F.array("seed").alias("path"), F.col("seed").alias("end"))
    found = None
    for hop in range(1, depth + 1):
        near = front.join(step, ["repo", "end"]).where(~F.array_contains("path", F.col("next")))
        if found is not None:
            near = near.join(found.select("repo", "seed", "end", "next"), ["repo", "seed", "end", "next"], "left_anti")
        taken = near.groupBy("repo", "seed", "end", "next").agg(F.min("path").alias("path")).withColumn("path", F.array_append("path", F.col("next")))
        taken = stage(taken.withColumn("hops", F.lit(hop)), "reference-front")
        found = taken if found is None else found.unionByName(taken)
        front = taken.select("repo", "seed", "path", F.col("next").alias("end"))
    severity = F.when(F.col("hops") >= 3, "high").otherwise("medium").alias("severity")
    return found.where("hops >= 2").select("repo", F.array_join("path", ">").alias("chain"), "hops", severity)


def simple_chains(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """All simple paths of 2 to ``depth`` hops from seed files (repo, src); a bounded loop of joins over staged frontiers, without a cut."""
    step = stage(edges.select("repo", F.col("src").alias("end"), F.col("dst").alias("next")), "reference-edges")
    paths = seeds.select("repo", F.array("src").alias("path"), F.col("src").alias("end")).distinct()
    found = None
    for hop in range(1, depth + 1):
        paths = paths.join(step, ["repo", "end"]).where(~F.array_contains("path", F.col("next"))).select("repo", F.array_append("path", F.col("next")).alias("path"), F.col("next").alias("end"))
        # the last hop is most of the rows and is read once
        paths = stage(paths, "reference-paths") if hop < depth else paths
        if hop >= 2:
            found = paths if found is None else found.unionByName(paths)
    hops = F.size("path") - 1
    return found.select("repo", F.array_join("path", ">").alias("chain"), hops.alias("hops"), F.when(hops >= 3, "high").otherwise("medium").alias("severity"))


def chains_sql(seed: str, depth: int = 5) -> str:
    """The same for DuckDB over edges(repo, src, dst): one common table expression a hop; ``seed`` is a condition on src."""
    out = [f"f0 AS (SELECT DISTINCT repo, src AS seed, [src] AS path, src AS last FROM edges WHERE {seed})"]
    for h in range(1, depth + 1):
        known = " UNION ALL ".join(f"SELECT repo, seed, src, dst FROM f{i}" for i in range(1, h))
        free = f"AND (f.repo, f.seed, e.src, e.dst) NOT IN ({known})" if known else ""
        out.append(f"f{h} AS (SELECT f.repo, f.seed, e.src, e.dst, list_append(min(f.path), e.dst) AS path, e.dst AS last, {h} AS hops FROM f{h - 1} f JOIN edges e ON e.repo = f.repo AND e.src = f.last WHERE NOT list_contains(f.path, e.dst) {free} GROUP BY f.repo, f.seed, e.src, e.dst)")
    every = " UNION ALL ".join(f"SELECT repo, array_to_string(path, '>') AS chain, hops, CASE WHEN hops >= 3 THEN 'high' ELSE 'medium' END AS severity FROM f{h}" for h in range(2, depth + 1))
    return ", " + ", ".join(out) + " " + every


def import_edges(files: DataFrame) -> DataFrame:
    """(repo, path, module) of import and require statements."""
    lines = files.where(F.col("ext").isin("py", "js", "ts")).select("repo", "path", F.explode(F.split("content", "\n", -1)).alias("text"))
    m = [F.regexp_extract("text", IMPORT, i) for i in (1, 2, 3)]
    module = F.when(m[0] != "", m[0]).when(m[1] != "", m[1]).otherwise(m[2])
    return lines.where(F.col("text").rlike(IMPORT)).select("repo", "path", F.regexp_replace(F.regexp_replace(module, r"^\./", ""), r"\..*$", "").alias("module")).distinct()


SOURCE, SINK = r"(os\.environ|process\.env|open\(|input\()", r"(requests\.(get|post)|fetch\s*\(|subprocess\.|eval\s*\(|exec\s*\()"


def cross_file_taint(files: DataFrame) -> DataFrame:
    """Files with a sink that import a module whose file has a source."""
    tainted = files.where(F.col("content").rlike(SOURCE)).select("repo", F.regexp_replace("base", r"\.[^.]*$", "").alias("module"), F.col("path").alias("source_path"))
    sinks = files.where(F.col("content").rlike(SINK)).select("repo", "path")
    return import_edges(files).join(sinks, ["repo", "path"]).join(tainted, ["repo", "module"]).where("path <> source_path").select("repo", "path", "module", "source_path").distinct()
