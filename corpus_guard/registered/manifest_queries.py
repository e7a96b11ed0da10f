"""Manifests and lockfiles written from the dependency view and read back; the oracle is the view itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_guard.plans.views import oracle, view
from corpus_guard.registry import register
from corpus_guard.sources import manifests as M

_SQL = "SELECT repo, name, min(version) AS version FROM deps_v GROUP BY repo, name"


def _pairs(spark, d):
    return view(spark, d, "deps_v").groupBy("repo", "name").agg(F.min("version").alias("version"))


def _files(spark, d, base, content):
    return _pairs(spark, d).groupBy("repo").agg(content.alias("content")).select("repo", F.concat("repo", F.lit("/" + base)).alias("path"), "content")


def _entries(value):
    return F.map_from_entries(F.collect_list(F.struct("name", value)))


def _text(line, sep="\n"):
    return F.array_join(F.array_sort(F.collect_list(line)), sep)


@register("a11_npm_manifest", oracle(_SQL, "deps_v"))
def npm(spark, d):
    f = _files(spark, d, "package.json", F.to_json(F.struct(_entries(F.col("version")).alias("dependencies"))))
    return M.extract_dependencies(f).select("repo", "name", "version")


@register("a12_overrides", oracle(_SQL, "deps_v"))
def overrides(spark, d):
    inner = F.map_from_entries(F.collect_list(F.struct("name", F.create_map(F.lit("."), F.col("version")))))
    return M.flatten_overrides(_files(spark, d, "package.json", F.to_json(F.struct(inner.alias("overrides"))))).select("repo", "name", "version")


@register("a13_requirements", oracle(_SQL, "deps_v"))
def requirements(spark, d):
    return M.extract_dependencies(_files(spark, d, "requirements.txt", _text(F.concat("name", F.lit("=="), "version", F.lit("  # pinned"))))).select("repo", "name", "version")


@register("a15_package_lock", oracle(_SQL, "deps_v"))
def package_lock(spark, d):
    packages = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("node_modules/"), "name"), F.struct("version"))))
    return M.extract_dependencies(_files(spark, d, "package-lock.json", F.to_json(F.struct(packages.alias("packages"))))).select("repo", "name", "version")


@register("a16_yarn_lock", oracle(_SQL, "deps_v"))
def yarn(spark, d):
    line = F.concat(F.lit('"'), "name", F.lit("@^1.0.0\":\n  version \""), "version", F.lit('"\n  resolved "https://x"\n'))
    return M.extract_dependencies(_files(spark, d, "yarn.lock", _text(line))).select("repo", "name", "version")


@register("a17_poetry_lock", oracle(_SQL, "deps_v"))
def poetry(spark, d):
    line = F.concat(F.lit('[[package]]\nname = "'), "name", F.lit('"\nversion = "'), "version", F.lit('"\n\n[package.dependencies]\nname = "other"\n'))
    return M.extract_dependencies(_files(spark, d, "poetry.lock", _text(line))).select("repo", "name", "version")


@register("a18_pnpm_lock", oracle(_SQL, "deps_v"))
def pnpm(spark, d):
    line = F.concat(F.lit("  /"), "name", F.lit("@"), "version", F.lit("(peer@1.0.0):\n    resolution: {integrity: x}"))
    return M.extract_dependencies(_files(spark, d, "pnpm-lock.yaml", F.concat(F.lit("lockfileVersion: '6.0'\npackages:\n"), _text(line), F.lit("\nsnapshots:\n  /zz@9:\n")))).select("repo", "name", "version")


@register("a19_pipfile_lock", oracle(_SQL, "deps_v"))
def pipfile(spark, d):
    default = _entries(F.struct(F.concat(F.lit("=="), "version").alias("version")))
    return M.extract_dependencies(_files(spark, d, "Pipfile.lock", F.to_json(F.struct(default.alias("default"))))).select("repo", "name", "version")
