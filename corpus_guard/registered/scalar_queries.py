"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_guard.functions import scalars as S
from corpus_guard.operators.lines import glob_to_regex
from corpus_guard.plans.views import oracle, table, view
from corpus_guard.registry import register

_SEV = "CASE sev WHEN 'critical' THEN {0} WHEN 'high' THEN {1} WHEN 'medium' THEN {2} WHEN 'low' THEN {3} ELSE {4} END"


@register(
    "i01_severity_and_tier",
    f"""
SELECT event_id, {_SEV.format(4, 3, 2, 1, 0)} AS score, CAST({_SEV.format(0.95, 0.8, 0.6, 0.4, 0.4)} AS DOUBLE) AS confidence,
  CASE WHEN c >= 0.92 THEN 'block' WHEN c >= 0.6 THEN 'warn' WHEN c >= 0.3 THEN 'info' ELSE 'noise' END AS tier
FROM (SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'odd' END AS sev, (event_id % 101) / 100.0 AS c FROM events)""",
)
def severity_and_tier(spark, d):
    e = table(spark, d, "events").withColumn("sev", F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "odd"))), (F.col("event_id") % 5 + 1).cast("int")))
    return e.select("event_id", S.severity_score("sev").alias("score"), S.default_confidence("sev").alias("confidence"), S.verdict_tier((F.col("event_id") % 101) / 100).alias("tier"))


@register(
    "i02_normalize_version",
    oracle(
        r"""
SELECT DISTINCT prefix || version AS spec, CASE WHEN ok THEN norm END AS loose, CASE WHEN ok AND NOT regexp_matches(prefix || version, '[\^~<>*|xX ]|^>=| - |,') THEN norm END AS strict
FROM (SELECT prefix, version, prefix IN ('', '^', '>=') AS ok, CAST(CAST(split_part(version, '.', 1) AS BIGINT) AS VARCHAR) || '.' || CAST(CAST(split_part(version, '.', 2) AS BIGINT) AS VARCHAR) || '.' || CAST(CAST(split_part(version, '.', 3) AS BIGINT) AS VARCHAR) AS norm FROM deps_v)""",
        "deps_v",
    ),
)
def normalize_version(spark, d):
    spec = view(spark, d, "deps_v").select(F.concat("prefix", "version").alias("spec")).distinct()
    return spec.select("spec", S.normalize_version("spec").alias("loose"), S.normalize_version("spec", strict_pin=True).alias("strict"))


@register(
    "i03_package_names",
    r"""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(lower(n), '[-_.]+', '-', 'g') ELSE lower(n) END AS canonical,
  regexp_replace(regexp_replace(n || CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '@1.2.3' WHEN 1 THEN '>=2.0' ELSE '' END, '(.)@.*$', '\1'), '\s*(===?|>=|<=|~=|!=|>|<|\[|;).*$', '') AS bare,
  translate(n, '013@', 'olea') AS plain, regexp_matches(lower(n), '(^|[-_])(ai|gpt|llm|agent|copilot|chatbot|rag|mcp)([-_]|$)') AS bait
FROM (SELECT p_partkey, replace(p_name, ' ', '__') || CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '-AI' WHEN 1 THEN '.0' ELSE '' END AS n FROM part)""",
)
def package_names(spark, d):
    """I3, I4, I5, I21."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").withColumn("n", F.concat(F.replace("p_name", F.lit(" "), F.lit("__")), F.when(k % 4 == 0, "-AI").when(k % 4 == 1, ".0").otherwise("")))
    spec = F.concat("n", F.when(k % 3 == 0, "@1.2.3").when(k % 3 == 1, ">=2.0").otherwise(""))
    return p.select(
        "p_partkey", S.canonical_package(F.when(k % 2 == 0, "pypi").otherwise("npm"), "n").alias("canonical"), S.strip_package_version(spec).alias("bare"),
        S.l33t_normalize("n").alias("plain"), S.looks_like_llm_bait("n").alias("bait"),
    )


@register("i06_sequence_ratio")
def sequence_ratio(spark, d):
    names = table(spark, d, "part").select(F.lower("p_name").alias("a")).distinct()
    return names.select("a", S.sequence_ratio("a", S.l33t_normalize(F.reverse("a"))).alias("ratio"))


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([A-Za-z0-9.-]+)', 1))"


@register(
    "i07_hosts",
    f"""
SELECT page_id, nullif(h, '') AS host, CASE WHEN h = '' OR regexp_matches(h, '^[0-9.]+$') OR len(l) < 2 THEN NULL WHEN array_to_string(l[-2:], '.') IN ('co.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'org.uk', 'github.io', 'co.in') AND len(l) >= 3
   THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain, CASE WHEN ends_with(h, '.s3.amazonaws.com') THEN 's3.amazonaws.com' END AS cloud
FROM (SELECT page_id, h, string_split(h, '.') AS l FROM (SELECT page_id, {_HOST} AS h FROM (
  SELECT page_id, CASE CAST(page_id % 5 AS INT) WHEN 0 THEN replace(replace(url, '.com', '.co.uk'), '.org', '.s3.amazonaws.com') WHEN 1 THEN 'http://10.0.0.1/' ELSE url END AS url FROM pages)))""",
)
def hosts(spark, d):
    """I7, I8."""
    k = F.col("page_id") % 5
    p = table(spark, d, "pages").withColumn("url", F.when(k == 0, F.replace(F.replace("url", F.lit(".com"), F.lit(".co.uk")), F.lit(".org"), F.lit(".s3.amazonaws.com"))).when(k == 1, "http://10.0.0.1/").otherwise(F.col("url")))
    p = p.withColumn("host", S.url_host("url"))
    return p.select("page_id", "host", S.registrable_domain("host").alias("domain"), S.cloud_suffix("host").alias("cloud"))


@register(
    "i09_text_measures",
    r"""
SELECT doc_id, substring(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\x1b\[[0-9;]*[A-Za-z]', '', 'g'), '[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2069}\x{feff}`]', '', 'g'), '[\x00-\x1f\x7f]+', ' ', 'g'), ' +', ' ', 'g')), 1, 200) AS clean,
  round(length(regexp_replace(t, '[^\x20-\x7e\t\n\r]', '', 'g')) / nullif(length(t), 0), 6) AS printable, sha256(t) AS digest, regexp_matches(t, '[\x{202a}-\x{202e}\x{2066}-\x{2069}\x{200e}\x{200f}]') AS bidi
FROM (SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 9 = 0 THEN chr(8238) || chr(27) || '[31m``x' || chr(8203) ELSE '' END AS t FROM documents)""",
)
def text_measures(spark, d):
    """I9, I11, I12, I19."""
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 9 == 0, "\u202e\x1b[31m``x\u200b").otherwise(""))
    docs = table(spark, d, "documents").select("doc_id", t.alias("t"))
    return docs.select("doc_id", S.sanitize_text("t").alias("clean"), F.round(S.printable_ratio("t"), 6).alias("printable"), S.sha256("t").alias("digest"), S.has_bidi("t").alias("bidi"))


@register("i10_nfkc_lower")
def nfkc(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", S.sha256(S.nfkc_lower(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "ＡＢＣ").otherwise("ABC")))).alias("digest"))


@register("i13_canonical_json")
def canonical_json(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", S.canonical_json({c: F.col(c) for c in ("user_id", "event_type", "event_id")}).alias("json"), S.dotted_get("props", "k").alias("k"))


@register(
    "i14_small_parsers",
    r"""
SELECT event_id, CASE WHEN x >= 0 AND x <= 10 THEN x END AS cvss,
  CASE WHEN regexp_matches(f, '^[0-9a-fA-F]+$') THEN 'hex' WHEN regexp_matches(f, '^[A-Z2-7]+=*$') THEN 'base32' WHEN regexp_matches(f, '^[A-Za-z0-9+/_-]+=*$') THEN 'base64' WHEN regexp_matches(f, '^[!-u]+$') THEN 'base85' END AS alphabet,
  coalesce(event_type IN ('npm', 'pypi', 'go', 'crates', 'maven', 'rubygems') AND regexp_matches(f, '^(@[a-z0-9~][a-z0-9._~-]*/)?[A-Za-z0-9][A-Za-z0-9._-]{0,127}$'), false) AS valid,
  regexp_matches('src/' || event_type || '/a.py', '^' || replace(replace(g, '.', '\.'), '*', '.*') || '$') AS globbed
FROM (SELECT event_id, event_type, TRY_CAST(regexp_extract('CVSS:' || CAST(event_id % 15 AS VARCHAR) || '.' || CAST(event_id % 10 AS VARCHAR), '(\d+(?:\.\d+)?)', 1) AS DOUBLE) AS x,
  CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'deadbeef' WHEN 1 THEN 'ABCDEFG2' WHEN 2 THEN 'abc+/Z9=' ELSE '!"#abc' END AS f, CASE WHEN event_id % 2 = 0 THEN 'src/*.py' ELSE '*.js' END AS g FROM events)""",
)
def small_parsers(spark, d):
    """I14, I16, I17, I18."""
    k = F.col("event_id")
    f = F.when(k % 4 == 0, "deadbeef").when(k % 4 == 1, "ABCDEFG2").when(k % 4 == 2, "abc+/Z9=").otherwise('!"#abc')
    e = table(spark, d, "events").withColumn("f", f).withColumn("g", glob_to_regex(F.when(k % 2 == 0, "src/*.py").otherwise("*.js"))).withColumn("p", F.concat(F.lit("src/"), "event_type", F.lit("/a.py")))
    return e.select(
        "event_id", S.cvss_score(F.concat(F.lit("CVSS:"), (k % 15).cast("string"), F.lit("."), (k % 10).cast("string"))).alias("cvss"), S.alphabet_of("f").alias("alphabet"),
        S.input_valid("event_type", "f", F.lit("1.0.0")).alias("valid"), F.expr("p rlike g").alias("globbed"),
    )


@register("i15_strip_shell_comment")
def shell_comment(spark, d):
    c = view(spark, d, "commands_v")
    return c.select("session", "turn", S.strip_shell_comment(F.concat(F.lit("echo 'a # b' "), F.regexp_replace("command", "['\"\n]", " "), F.lit(" # end"))).alias("bare"))


@register(
    "e01_entropy",
    oracle(
        """
, c AS (SELECT path, content AS t FROM files_v),
ch AS (SELECT path, x, count(*) AS n FROM (SELECT path, unnest(string_split(t, '')) AS x FROM c WHERE length(t) > 0) GROUP BY path, x),
p AS (SELECT path, x, n / sum(n) OVER (PARTITION BY path) AS p FROM ch)
SELECT c.path, coalesce(round(e, 5), 0.0) AS bits FROM c LEFT JOIN (SELECT path, -sum(p * log2(p)) AS e FROM p GROUP BY path) USING (path)""",
        "files_v",
    ),
)
def entropy(spark, d):
    f = view(spark, d, "files_v")
    return f.select("path", F.round(S.entropy("content"), 5).alias("bits"))
