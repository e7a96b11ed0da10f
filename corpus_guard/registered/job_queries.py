"""Queries of parsers, decoders and gates. ``code_v`` is all of files_v and, so that programs parse, the seeded lines of each document as files of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpus_guard.detectors import content as C
from corpus_guard.detectors import python_jobs as P
from corpus_guard.detectors import python_source as S
from corpus_guard.detectors.config_files import DETECTORS
from corpus_guard.detectors.config_sql import DETECTOR_SQL
from corpus_guard.detectors.integrity import INTEGRITY_SQL, scan_integrity
from corpus_guard.detectors.split_payloads import FRAGMENT_SQL, REASSEMBLE_SQL, find_split_payloads, reassemble
from corpus_guard.detectors.taint import TAINT_SQL, taint_flows
from corpus_guard.plans.views import oracle, table, view
from corpus_guard.registry import register
from corpus_guard.sources.archives import expand_archives, pack_archives
from corpus_guard.streaming.gates import command_gate, scan_changed


def code_v(spark, d):
    return view(spark, d, "code_v")


@register("c50_py_ast")
def py_ast(spark, d):
    return S.of_scan(S.parse_python(code_v(spark, d)), "ast")


@register("c51_py_dynamism")
def py_dynamism(spark, d):
    return S.of_scan(S.parse_python(code_v(spark, d)), "dynamism")


@register("c49_py_entrypoint")
def py_entry(spark, d):
    return S.of_scan(S.parse_python(code_v(spark, d)), "entry")


@register("c52_taint_flows", oracle(TAINT_SQL, "code_v", recursive=True))
def taint(spark, d):
    return taint_flows(code_v(spark, d))


@register("c20_decode_rescan")
def decode(spark, d):
    return P.decode_rescan(C.detect_blobs(view(spark, d, "files_v")))


@register("c20_decode_arguments")
def decode_arguments(spark, d):
    """The arguments of decode calls, by syntax tree, down the ladder."""
    return S.decoded_arguments(S.parse_python(code_v(spark, d)))


@register("j03_fragments", oracle(f", source_files AS (SELECT * FROM code_v), {FRAGMENT_SQL} SELECT * FROM frag", "code_v"))
def fragments(spark, d):
    return P.fragments(code_v(spark, d))


#: Three files of a split program; which one a file holds does not follow its path, length or place.
SPLIT = ("Y29uc29sZS5s", "b2coMSk7Y29u", "c29sZS5sb2co")


def split_fragments(spark, d):
    """All of files_v and a split program, in repos of 64 consecutive ids of a source, so that a source's size does not push its fragments over the limit of a group."""
    f = view(spark, d, "files_v").withColumn("repo", F.concat_ws("/", "repo", F.expr("file_id div 64")))
    part = F.element_at(F.array(*map(F.lit, SPLIT)), (F.col("file_id") % 3 + 1).cast("int"))
    split = f.where("path like '%/doc-%'").withColumn("repo", F.concat("repo", F.lit("/split"))).withColumn("content", F.concat(F.lit("x = '"), part, F.lit("'")))
    return P.fragments(f.unionByName(split))


_PARTS = ", ".join(f"'{x}'" for x in SPLIT)
_SPLIT_FILES = f""", f AS (SELECT repo || '/' || CAST(file_id // 64 AS VARCHAR) AS repo, path, content, file_id FROM files_v),
source_files AS (SELECT repo, path, content FROM f UNION ALL SELECT repo || '/split', path, 'x = ' || chr(39) || [{_PARTS}][CAST(file_id % 3 AS INT) + 1] || chr(39) FROM f WHERE path LIKE '%/doc-%'), {FRAGMENT_SQL}, """


@register("j04_reassemble", oracle(_SPLIT_FILES + REASSEMBLE_SQL, "files_v", recursive=True))
def reassembled(spark, d):
    return reassemble(split_fragments(spark, d))


@register("j04_split_payloads")
def split_payloads(spark, d):
    """Joined fragments down the decode ladder, of whole sources and of repos of 64 files."""
    whole = P.fragments(view(spark, d, "files_v"))
    return find_split_payloads(split_fragments(spark, d).unionByName(whole))


_KINDS_SQL = """CASE WHEN regexp_matches(command, '(curl|wget)\\s[^|;&]*\\|\\s*(sudo\\s+)?(ba|z|da)?sh\\b') THEN 'pipe-to-shell' WHEN regexp_matches(command, '(ba|z)?sh\\s+<\\(\\s*(curl|wget)') THEN 'pipe-to-shell'
WHEN regexp_matches(lower(command), '(^|[\\s;&|])evil-lib([^a-z0-9._/-]|$)') AND kind IS NOT NULL THEN 'malicious-package' ELSE '' END"""


def _gate_sql():
    from corpus_guard.operators.deps import INSTALL_KINDS

    kinds = " ".join(f"WHEN regexp_matches(command, '{p}') THEN '{k}'" for k, p in INSTALL_KINDS)
    return f", g AS (SELECT session, turn, {_KINDS_SQL} AS reason FROM (SELECT *, CASE {kinds} END AS kind FROM commands_v)) SELECT session, turn, CASE WHEN reason <> '' THEN 'block' ELSE 'approve' END AS decision, reason FROM g"


@register("k01_command_gate", oracle(_gate_sql(), "commands_v"))
def gate(spark, d):
    c = view(spark, d, "commands_v").select("session", "turn", "command")
    return command_gate(c, spark.createDataFrame([("evil-lib",)], "name string")).drop("command")


@register(
    "k04_scan_changed",
    oracle("SELECT name, CAST(manifest_id % 50 AS VARCHAR) AS item, file FROM deps_v WHERE name IN (SELECT lower(replace(p_name, ' ', '-')) FROM part WHERE p_partkey % 10 = 0) AND manifest_id % 50 IN (SELECT doc_id % 50 FROM documents WHERE doc_id % 50 < 20)", "deps_v"),
)
def changed(spark, d):
    deps = view(spark, d, "deps_v").withColumn("item", (F.col("manifest_id") % 50).cast("string")).select("name", "item", "file")
    items = table(spark, d, "documents").where("doc_id % 50 < 20").select((F.col("doc_id") % 50).cast("string").alias("item"))
    names = table(spark, d, "part").where("p_partkey % 10 = 0").select(F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"))
    return scan_changed(items, deps, names)


@register("c63_magic", oracle("SELECT path, ext, CASE WHEN file_id % 7 = 0 THEN 'elf' ELSE 'pe' END AS kind FROM files_v WHERE file_id % 7 IN (0, 1) AND ext IN ('txt', 'md', 'json', 'yml', 'html')", "files_v"))
def magic(spark, d):
    f = view(spark, d, "files_v")
    head = F.when(F.col("file_id") % 7 == 0, F.unhex(F.lit("7f454c46"))).when(F.col("file_id") % 7 == 1, F.unhex(F.lit("4d5a9000"))).otherwise(F.lit("plain text").cast("binary"))
    return P.scan_magic(f.withColumn("bytes", F.concat(head, F.col("content").cast("binary"))))


@register("c64_embedded")
def embedded(spark, d):
    f = view(spark, d, "files_v")
    return P.scan_embedded(f.withColumn("bytes", F.concat(F.col("content").cast("binary"), F.when(F.col("file_id") % 7 == 1, F.unhex(F.lit("4d5a9000"))).otherwise(F.unhex(F.lit("00"))))))


@register("c65_archive_kind", oracle("SELECT path, CASE WHEN file_id % 5 = 0 THEN 'zip' ELSE 'unsupported' END AS kind, CASE WHEN file_id % 5 = 0 THEN 'info' ELSE 'low' END AS severity FROM files_v WHERE file_id % 5 IN (0, 1)", "files_v"))
def archives(spark, d):
    f = view(spark, d, "files_v")
    head = F.when(F.col("file_id") % 5 == 0, F.unhex(F.lit("504b0304"))).when(F.col("file_id") % 5 == 1, F.unhex(F.lit("377abcaf"))).otherwise(F.lit("x").cast("binary"))
    return P.archive_kind(f.withColumn("bytes", head))


@register(
    "a21_archive_members",
    oracle("""SELECT path || '.zip!' || m AS path, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS size FROM files_v, (VALUES ('content'), ('inner!content')) t(m)""", "files_v"),
)
def archive_members(spark, d):
    """Every file packed into an archive with a nested one, and the members read back."""
    members = expand_archives(pack_archives(view(spark, d, "files_v"))).where("path not like '%!inner'")
    return members.select("path", F.sha2("content", 256).alias("sha256"), "size")


@register("c69_integrity", oracle(f", moded AS (SELECT *, CAST(33188 + CASE WHEN file_id % 5 = 0 THEN 73 ELSE 0 END AS INT) AS mode FROM code_v), {INTEGRITY_SQL}", "code_v"))
def integrity(spark, d):
    """C69; the permission bits follow from the id of a file."""
    mode = F.when(F.col("file_id") % 5 == 0, 0o100755).otherwise(0o100644)
    return scan_integrity(code_v(spark, d).withColumn("mode", mode))


def _config(fn):
    return lambda spark, d: fn(code_v(spark, d))


for _name, _fn in DETECTORS.items():
    register(_name, oracle(DETECTOR_SQL[_name], "code_v"))(_config(_fn))
