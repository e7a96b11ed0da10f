"""Lines of files and what is derived from their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_guard.schema import MAX_LINE, SNIPPET

#: A line that opens or closes a fenced code block.
FENCE = r"^\s*(```|~~~)"
COMMENT = r"^\s*(#|//|;;|/\*|\*)"


def to_lines(files: DataFrame, long: str = "truncate", limit: int = MAX_LINE) -> DataFrame:
    """B1, B2: one row per line, numbered from 1; lines over ``limit`` are cut (truncate), left out (skip) or kept (keep).

    A trailing line end yields a last empty line; null content has no lines.
    """
    keep = [c for c in files.columns if c not in ("content", "bytes")]
    lines = files.select(*keep, F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).withColumn("line", F.col("at") + 1).drop("at")
    if long == "truncate":
        return lines.withColumn("text", F.substring("text", 1, limit))
    return lines.where(F.length("text") <= limit) if long == "skip" else lines


def drop_comments(lines: DataFrame) -> DataFrame:
    """Lines that do not begin with a comment mark."""
    return lines.where(~F.col("text").rlike(COMMENT))


def stripped(col: str | Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def snippet(col: str | Column) -> Column:
    """The trimmed line, at most 120 characters."""
    return F.substring(stripped(col), 1, SNIPPET)


def in_fence(lines: DataFrame) -> DataFrame:
    """adds in_fence - an odd number of fence lines up to and including this one."""
    w = Window.partitionBy("repo", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("text").rlike(FENCE)
    return lines.withColumn("is_fence", fence).withColumn("in_fence", F.sum(fence.cast("int")).over(w) % 2 == 1)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """the first row of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def tail_lines(lines: DataFrame, frac: float = 0.3, n: int = 50) -> DataFrame:
    """adds n_lines, and whether a line lies in the last max(n, frac) lines, the last ten, or beyond 80 percent."""
    counted = lines.withColumn("n_lines", F.count("*").over(Window.partitionBy("repo", "path")))
    last = F.greatest(F.lit(n), F.floor(F.col("n_lines") * frac).cast("int"))
    return (
        counted.withColumn("in_tail", F.col("line") > F.col("n_lines") - last)
        .withColumn("in_last_ten", F.col("line") > F.col("n_lines") - 10)
        .withColumn("past_80", F.col("line") > F.col("n_lines") * 0.8)
    )


def look_ahead(lines: DataFrame, n: int, pattern: str, name: str = "ahead") -> DataFrame:
    """F8: the first match of ``pattern`` (group 1) in this line and the n - 1 lines after it."""
    w = Window.partitionBy("repo", "path").orderBy("line").rowsBetween(0, n - 1)
    found = F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, 1))
    return lines.withColumn(name, F.first(found, ignorenulls=True).over(w))


def carry_forward(lines: DataFrame, header: str, name: str = "section") -> DataFrame:
    """the latest header line's group 1 at or before each line."""
    w = Window.partitionBy("repo", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col("text").rlike(header), F.regexp_extract("text", header, 1))
    return lines.withColumn(name, F.last(found, ignorenulls=True).over(w))


def once(value: Column) -> Column:
    """``value`` computed once a row: an undetermined column is not repeated where later columns read it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def cut_at(df: DataFrame, lines: str, header: str, name: str = "parts") -> DataFrame:
    """Adds an array of (head, body): an array of lines cut at those that match ``header``, in place; what lies before the first has a null head."""
    heads = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.get(F.col(lines), i - 1).rlike(header))
    cut = df.where(F.size(lines) > 0).withColumn("_heads", once(F.concat(F.array(F.lit(0)), heads)))
    end = lambda k: F.coalesce(F.get("_heads", k + 1), F.size(lines) + 1)
    part = lambda h, k: F.struct(F.when(h > 0, F.get(F.col(lines), h - 1)).alias("head"), F.slice(F.col(lines), h + 1, end(k) - h - 1).alias("body"))
    return cut.withColumn(name, once(F.transform("_heads", part))).drop("_heads")


def sections(files: DataFrame, header: str) -> DataFrame:
    """F10 without a shuffle, where each file is one row: one row per header line (head) with the lines up to the next (body)."""
    cut = files.withColumn("lines", once(F.transform(F.split("content", "\n", -1), lambda x: F.substring(x, 1, MAX_LINE))))
    return cut_at(cut, "lines", header).select("repo", "path", F.explode("parts").alias("p")).select("repo", "path", "p.*").where("head is not null")


def glob_to_regex(col: str | Column) -> Column:
    """I16: fnmatch to a regular expression; ``*`` crosses ``/``."""
    out = F.regexp_replace(col, r"([.+(){}|^$\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(out, r"\*", ".*"), r"\?", "."), F.lit("$"))


def apply_ignores(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files that match no ignore pattern: exact path, subtree of it, or glob. ``patterns`` (pattern) is a small rules table."""
    p = F.broadcast(patterns.withColumn("glob_re", glob_to_regex("pattern")))
    bare = F.rtrim(F.col("pattern"))
    hit = (F.col("path") == bare) | F.col("path").startswith(F.concat(F.regexp_replace(bare, "/$", ""), F.lit("/"))) | F.expr("path rlike glob_re")
    return files.join(p, hit, "left_anti")


def drop_minified(files: DataFrame) -> DataFrame:
    """No minified bundles, source maps or lockfiles."""
    return files.where(~F.lower("base").rlike(r"(\.min\.(js|css)|\.map|[.-]lock\.(json|yaml)|^package-lock\.json|^yarn\.lock|^poetry\.lock|^pipfile\.lock|bundle\.js)$"))


def drop_build_artifacts(files: DataFrame) -> DataFrame:
    """No files with a bundler banner in the first five lines."""
    return files.where(~F.substring_index("content", "\n", 5).rlike(r"(?i)(webpackBootstrap|generated by (rollup|esbuild|parcel|webpack)|__webpack_require__)"))


VENDORED = ("node_modules", "vendor", "third_party", "site-packages", "dist-packages", ".venv", "venv")


def is_vendored(path: str | Column) -> Column:
    """A vendored directory among the parts of the path."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDORED)))


def seed_files(files: DataFrame, cap: int = 200, size: int = 1_000_000) -> DataFrame:
    """Files that may hold anchors: text kinds up to ``size`` characters, the first ``cap`` of each repo by path."""
    fit = files.where(F.col("ext").isin("md", "txt", "py", "js", "sh", "yml", "yaml", "json", "toml") & (F.length("content") <= size))
    return first_n(fit, ["repo"], ["path"], cap)


SERVER_SIGNALS = r"(?i)(mcpservers|tools/(list|call)|sampling/createmessage|@modelcontextprotocol|fastmcp|json-?rpc)"


def is_server_related(files: DataFrame) -> DataFrame:
    """Adds server_related - protocol-server signals in the path or the first 8000 characters."""
    return files.withColumn("server_related", F.substring("content", 1, 8000).rlike(SERVER_SIGNALS) | F.lower("path").rlike("mcp"))


def is_binary(data: str | Column, ext: str | Column) -> Column:
    """A binary extension, a zero byte, or bytes that are not UTF-8 in the first 1024 (a code point cut there is allowed)."""
    head = F.substring(data, 1, 1024)
    whole = F.is_valid_utf8(head.cast("string"))
    for k in (1, 2, 3):
        whole = whole | F.is_valid_utf8(F.substring(data, 1, 1024 - k).cast("string")) & (F.octet_length(F.col(data) if isinstance(data, str) else data) > 1024)
    known = F.lower(ext).isin("png", "jpg", "jpeg", "gif", "ico", "zip", "gz", "tar", "whl", "pyc", "so", "dll", "exe", "bin", "pdf", "woff", "woff2", "mp3", "mp4", "wav")
    return known | (F.instr(F.hex(head), "00") % 2 == 1) & F.hex(head).rlike("^(..)*?00") | ~whole
