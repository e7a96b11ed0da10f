"""Substring joins, the rule index, and the prefilter, against plain versions."""

import random
import re
import unicodedata

import pytest

from corpus_guard.detectors.content import FEW_SUBSTRINGS, match_ioc_text
from corpus_guard.operators import rule_index
from corpus_guard.operators.lines import to_lines
from corpus_guard.operators.rules import Rule, Scan, audit_findings, run_scan, scan_rules, spans_lines
from corpus_guard.operators.substrings import join_substrings

FILES = "repo string, path string, ext string, content string"


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_substring_join(spark):
    r = random.Random(2)
    alphabet = "abcAB .é日\U0001f600\n$\\"
    texts = [None, "", *("".join(r.choice(alphabet) for _ in range(r.choice([1, 2, 5, 30, 200]))) for _ in range(150))]
    needles = ["", None, "a", "$", "\\", "\n", *{"".join(r.choice(alphabet) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7, 9]))) for _ in range(200)}, *(t[3:20] for t in texts if t and len(t) > 30)]
    rows, table = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame(list(enumerate(needles)), "n int, v string")
    joined = join_substrings(rows, "t", table, "v")
    assert sorted((x.i, x.n) for x in joined.collect()) == sorted((i, n) for i, t in enumerate(texts) for n, v in enumerate(needles) if t and v and v in t)
    for hint in (True, False):
        plan = plan_of(join_substrings(rows, "t", table, "v", hint=hint))
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert join_substrings(rows, "t", table.limit(0), "v").count() == 0 and join_substrings(rows.limit(0), "t", table, "v").count() == 0


def test_many_path_indicators(spark):
    values = [("path", f"/opt/tool{i}/run.sh") for i in range(3000)] + [("pth_file", "x.pth"), ("path", "ab"), ("domain", "bad.example"), ("c2_ip", "203.0.113.9")]
    texts = ["see /opt/tool17/run.sh and /opt/tool170/run.sh", "x.pth 203.0.113.9 ab", "BAD.example", None, "/opt/tool9999/run.sh"]
    lines = spark.createDataFrame([("r", "p", i, t) for i, t in enumerate(texts)], "repo string, path string, line int, text string")
    want = {(i, k, v) for i, t in enumerate(texts) for k, v in values if t and (v in t or (k in ("domain", "c2_ip") and v in t.lower()))}
    many = match_ioc_text(lines, spark.createDataFrame(values, "kind string, value string"))
    assert "NestedLoop" not in plan_of(many)
    assert {(r.line, r.kind, r.value) for r in many.collect()} == want
    few = values[-FEW_SUBSTRINGS:]
    found = match_ioc_text(lines, spark.createDataFrame(few, "kind string, value string"))
    assert "NestedLoop" not in plan_of(found)
    assert {(r.line, r.kind, r.value) for r in found.collect()} == {x for x in want if (x[1], x[2]) in few}
    assert match_ioc_text(lines, spark.createDataFrame([], "kind string, value string")).count() == 0


def test_five_thousand_rules(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rules = [Rule(f"G-{i}", "t", "c", "low", rf"(?i)\b(call{word()}|{word()}x{i})\s*\(", ("py",) if i % 3 else (), r"safe" if i % 5 == 0 else None) for i in range(4990)]
    rules += [Rule("K-1", "t", "c", "low", "", kind="keyword", values=("ignore previous", "Ｉgnore all")), Rule("M-1", "t", "c", "low", "", kind="mapping", values=("Zed",)), Rule("C-1", "t", "c", "low", "", kind="charset", values=("​",)), Rule("D-1", "t", "c", "low", r"^\d{7}$")]
    texts = []
    for i in range(300):
        parts = [word() for _ in range(6)]
        if i % 2:
            x = r.choice(rules[:4990])
            parts.insert(2, re.search(r"\((\w+)\|(\w+)\)", x.pattern)[1 + i % 3 // 2].upper() + r.choice([" (", "(", " "]) + ("safe" if i % 7 == 0 else ""))
        texts.append(" ".join(parts))
    texts += ["please IGNORE previous", "ｉｇｎｏｒｅ previous", "ＩＧNORE ALL", "Zed zed", "a​b", "1234567", None]
    lines = spark.createDataFrame([("r", f"p{i % 7}", "py" if i % 4 else "js", i, t) for i, t in enumerate(texts)], "repo string, path string, ext string, line int, text string")
    found = scan_rules(lines, rules, "many")
    assert len(plan_of(found)) < 100_000

    def hits(rule, ext, text):
        if text is None or (rule.ext and ext not in rule.ext):
            return False
        if rule.kind == "keyword":
            return any(unicodedata.normalize("NFKC", v).lower() in unicodedata.normalize("NFKC", text).lower() for v in rule.values)
        if rule.kind in ("mapping", "charset"):
            return any(v in text for v in rule.values)
        return bool(re.search(rule.pattern, text)) and not (rule.unless and re.search(rule.unless, text))

    want = sorted((i, x.id) for i, t in enumerate(texts) for x in rules if hits(x, "py" if i % 4 else "js", t))
    assert sorted((x.line, x.rule_id) for x in found.collect()) == want and len(want) > 100


@pytest.mark.parametrize("keep", ["all", "line", "file", "category"])
def test_both_plans_agree(spark, monkeypatch, keep):
    rules = (Rule("A", "t", "c", "low", "(alpha|beta)"), Rule("B", "t", "d", "low", r"(?i)beta\s"), Rule("C", "t", "c", "low", r"^x"), Rule("D", "t", "c", "low", "", kind="keyword", values=("alpha", "gamma")))
    texts = ["alpha beta\nBETA x\nx alpha gamma", "none", "", None, "x\nx\nbeta beta alpha"]
    files = spark.createDataFrame([("r", f"{i}.md", "md", t) for i, t in enumerate(texts)], FILES)
    scans = [Scan("s", rules, keep=keep), Scan("u", rules, keep=keep, fenced=False)]
    narrow = sorted(map(str, audit_findings(files, scans).collect()))
    monkeypatch.setattr(rule_index, "INDEXED_FROM", 1)
    assert sorted(map(str, audit_findings(files, scans).collect())) == narrow and len(narrow) >= 4


LOOK = [
    r"curl(?!\s+--safe)", r"(?<!\n)eval", r"^start", r"end$", r"\Aonly", r"only\Z", r"(?s)a.b", r"x++y", r"(?>ab|a)c", r"[^a]z", r"\bword\b", r"(?=.*q)k", r"tail$", r"(ab)\1", r"\Bmid\B",
]


@pytest.mark.parametrize("pattern", LOOK)
def test_prefilter_loses_no_line(spark, pattern):
    texts = [
        "curl\n --safe x", "\neval(", "a\nstart\nb", "x end\ny", "b\nonly\nc", "a\nb", "xx\nxy", "abc\nac", "az\nbz", "a word\nwordy", "k\nq", "y" * 9996 + "tailtailtail", "abab\nab", "amidb\nmid", "z" * 9996 + "word" + "word",
        "curl --safe", "q k q\nkq", "", None, "curl",
    ]
    files = spark.createDataFrame([("r", f"{i}", "md", t) for i, t in enumerate(texts)], FILES)
    scan = Scan("s", (Rule("P", "t", "c", "low", pattern),))
    want = sorted((r.file, r.line) for r in scan_rules(to_lines(files), scan.rules, "s").collect())
    assert sorted((r.file, r.line) for r in run_scan(files, scan).collect()) == want
    assert sorted((r.file, r.line) for r in audit_findings(files, [scan]).collect()) == want


def test_patterns_that_see_other_lines():
    assert spans_lines(r"a(?!b)") and spans_lines(r"(x|(y(?<=z)))") and spans_lines(r"\Ax") and spans_lines(r"x\z") and not spans_lines(r"(?i)^a[^b]*\bc$")


def test_fence_aware_scans_share_the_one_pass(spark):
    rules = (Rule("A", "t", "c", "low", "alpha"), Rule("B", "t", "c", "low", r"(?i)be+ta"))
    text = "alpha\n```\nalpha\n``` alpha\nBEETA alpha\n~~~\nbeta"
    files = spark.createDataFrame([("r", "a.md", "md", text), ("r", "b.py", "py", text)], FILES)
    found = audit_findings(files, [Scan("s", rules), Scan("f", rules, "ext = 'md'", "line", fenced=False), Scan("g", rules, fenced=False, long="skip")])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
    assert sorted((r.line, r.rule_id) for r in found.collect() if r.scanner == "f") == [(1, "A"), (5, "A")]
    assert len([r for r in found.collect() if r.scanner == "g"]) == 6


def test_only_rules_whose_literals_a_line_holds_are_asked(spark):
    from corpus_guard.operators.rules import rules_to_ask

    rules = (Rule("A", "t", "c", "low", r"sk-[a-z]+x"), Rule("B", "t", "c", "low", "(alpha|beta).*gamma"), Rule("C", "t", "c", "low", r"^\d+$"), Rule("D", "t", "c", "low", "", kind="keyword", values=("Key",)))
    lines = ["sk-ax", "beta", "beta gamma", "gamma sk-", "the key", "é", ""]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", rules_to_ask("x", rules).alias("a")).orderBy("i").collect()
    assert [sorted(r.a) for r in got] == [[0, 2], [2], [1, 2], [2], [2, 3], [2, 3], [2]]


def test_files_of_one_row_group_are_scanned_by_all_cores(spark):
    from pyspark.sql import functions as F

    from corpus_guard.plans.views import even, view
    from corpus_guard.queries import QUERIES
    from corpus_guard.registered.report_queries import findings

    sf, splits = "/root/testdata/sf0.001", {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "0"}
    held = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    want = sorted(QUERIES["g01_severity_order"](spark, sf).collect())
    try:
        for k, v in splits.items():
            spark.conf.set(k, v)
        files = view(spark, sf, "files_v")
        # many splits are planned, but three tables of one row group each are read by three tasks
        assert files.rdd.getNumPartitions() > 8 and len(held(files)) == 3
        rows = held(even(files))
        assert sum(rows) == sum(held(files)) and max(rows) * 4 <= sum(rows)
        assert "REPARTITION_BY_NUM" in plan_of(findings(spark, sf))
        assert sorted(QUERIES["g01_severity_order"](spark, sf).collect()) == want
        dealt = files.repartition(8)
        assert even(dealt) is dealt
        none = files.where("file_id < 0")
        assert even(none) is none
    finally:
        for k in splits:
            spark.conf.unset(k)
