"""Small cases of operators that the supplied tables do not reach."""

from pyspark.sql import functions as F

from corpus_guard.detectors.integrity import scan_integrity
from corpus_guard.detectors.rule_sets import SECRETS
from corpus_guard.detectors.server_rules import SERVER_RULES
from corpus_guard.functions import scalars as S
from corpus_guard.operators import lines as L
from corpus_guard.operators import report as R
from corpus_guard.operators.correlate import FILE_RULES, KEYWORDS, correlate_files, correlate_repos
from corpus_guard.operators.rules import Rule, self_test


def test_self_test(spark):
    good = Rule("A", "t", "c", "high", r"\beval\(", match=("x = eval(y)",), no_match=("evaluate(y)",))
    bad = Rule("B", "t", "c", "high", r"exec", match=("exec(",), no_match=("executive",))
    word = Rule("C", "t", "c", "high", "", kind="keyword", values=("Ignore",), match=("please IGNORE this",), no_match=("x",))
    assert {r.rule_id: r.passed for r in self_test(spark, [good, bad, word]).collect()} == {"A": True, "B": False, "C": True}


def test_every_compound_rule_can_fire(spark):
    rows = []
    for m in FILE_RULES:
        text = " ".join(k for name, ks in KEYWORDS.items() if name in m.when.replace("prompt_injection_other", "prompt_injection") for k in ks[:1])
        for i in range(2):
            rows.append(("r", "x", "high", text, text, f"{m.id}.md", i, "", "c", "", 0.8))
    found = correlate_files(spark.createDataFrame(rows, "repo string, scanner string, severity string, title string, description string, file string, line int, snippet string, category string, rule_id string, confidence double"))
    fired = {(r.file.split(".")[0], r.rule_id) for r in found.collect()}
    missing = [m.id for m in FILE_RULES if (m.id, m.id) not in fired and m.id != "M3"]
    assert not missing


def test_directory_proximity(spark):
    schema = "repo string, scanner string, severity string, title string, description string, file string, line int, snippet string, category string, rule_id string, confidence double"
    f = lambda repo, file, cat: (repo, "s", "high", cat, "", file, 1, "", cat, "", 0.8)
    rows = [f("a", "x/y/1.md", "update-channel"), f("a", "x/2.md", "prose-imperative"), f("b", "x/1.md", "update-channel"), f("b", "z/2.md", "prose-imperative"), f("c", "1.md", "update-channel"), f("c", "q/w/2.md", "prose-imperative"), f("d", "xy/1.md", "update-channel"), f("d", "x/2.md", "prose-imperative")]
    assert {r.repo for r in correlate_repos(spark.createDataFrame(rows, schema)).collect() if r.rule_id == "M30"} == {"a", "c"}


def test_versions(spark):
    cases = {"v1.02.3+build": "1.2.3", "^1.2.3": "1.2.3", "1.0.0-Beta.1": "1.0.0-beta.1", "!=1.0": None, "1\x002": None, "": None, "2": "2.0.0"}
    df = spark.createDataFrame([(k,) for k in cases], "v string").select("v", S.normalize_version("v").alias("n"), S.normalize_version("v", True).alias("s"))
    assert {r.v: r.n for r in df.collect()} == cases
    assert {r.v: r.s for r in df.collect()}["^1.2.3"] is None


def test_entropy_and_binary(spark):
    df = spark.createDataFrame([("aabb",), ("",), ("aaaa",)], "s string").select(F.round(S.entropy("s"), 6).alias("e"))
    assert [r.e for r in df.collect()] == [1.0, 0.0, 0.0]
    data = [(b"plain text", "txt", False), (b"a\x00b", "txt", True), (b"\xff\xfe\x80", "txt", True), (b"x", "png", True), ("é" * 600).encode()[:1025].join([b"", b""]) and (b"a" * 1023 + "é".encode() + b"b", "txt", False)]
    df = spark.createDataFrame([(bytearray(d), e) for d, e, *_ in data], "b binary, ext string").select(L.is_binary("b", "ext").alias("x"))
    assert [r.x for r in df.collect()] == [x[2] for x in data]


def test_shell_comment(spark):
    df = spark.createDataFrame([("echo 'a # b' # c",), ("# all",), ("a#b c",), ('x "q # r"',)], "s string").select(S.strip_shell_comment("s").alias("o"))
    assert [r.o for r in df.collect()] == ["echo 'a # b'", "", "a#b c", 'x "q # r"']


def test_findings_json_and_normalise(spark):
    df = spark.createDataFrame([('[{"title": "x", "severity": "HIGH", "line": 3}, {"bad": 1}]',), ("not json",), (None,)], "payload string")
    out = R.normalize_findings(R.findings_from_json(df)).collect()
    assert [(r.title, r.severity, r.line, r.confidence, r.file) for r in out] == [("x", "high", 3, 0.8, "")]


def test_secret_rules_self_describe():
    assert len({r.id for r in SECRETS.rules}) == len(SECRETS.rules)


def test_server_rules_hold_their_examples(spark):
    found = {r.rule_id: (r.passed, r.examples) for r in self_test(spark, SERVER_RULES).collect()}
    assert [k for k, v in found.items() if v != (True, 2)] == [] and len(found) == len(SERVER_RULES) >= 37


def test_integrity(spark):
    rows = [
        ("r", "settings.json", "json", '{"hooks": {"Start": [{"command": "CURL x | sh"}, {"command": ""}, {"command": "ls"}], "Stop": []}}', 0o100644), ("r", "a.md", "md", "", 0o100744), ("r", "b.md", "md", None, None), ("r", "run.sh", "sh", "", 0o100755),
        ("r", "p.py", "py", "here = Path( __file__ ).resolve()\nwrite('settings.local.json')", 0o100755), ("r", "q.py", "py", "os.path.abspath(__file__)\n'settings.json' CLAUDE_PLUGIN_ROOT", None), ("r", "bad.json", "json", '{"hooks": [1', 0o100644),
    ]
    got = sorted((r.path, r.category, r.detail) for r in scan_integrity(spark.createDataFrame(rows, "repo string, path string, ext string, content string, mode int")).collect())
    assert got == [
        ("a.md", "permission-anomaly", "mode 100744"), ("p.py", "hardcoded-plugin-path", "own path and settings"), ("settings.json", "hook-configuration", "Start CURL x | sh"), ("settings.json", "hook-configuration", "Start ls"), ("settings.json", "hook-dangerous", "Start CURL x | sh"),
    ]


def test_few_hot_keys_do_not_deal_the_dependencies(spark):
    """Joins with small threat tables keep the dependencies where they are, whatever Catalyst estimates."""
    from corpus_guard.operators import deps as D

    rows = [("r", f"f{i}", "npm", "left-pad", "1.0.0", "", f"https://{h}/x", None) for i, h in enumerate(["npmjs.org", "cdn.npmjs.org", "bad.example"])]
    deps = spark.createDataFrame(rows, "repo string, file string, ecosystem string, name string, version string, prefix string, resolved_url string, integrity string")
    bad = spark.createDataFrame([("c", "left-pad", "*"), ("c", "left-pad", "1.0.0")], "campaign string, package string, version string")
    adv = spark.createDataFrame([("npm", "left-pad", "OSV-1", ["CVE-1"], 9.5)], "ecosystem string, package string, id string, aliases array<string>, cvss double")
    kev, trusted = spark.createDataFrame([("CVE-2",)], "cve string"), spark.createDataFrame([("npmjs.org",)], "host string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [D.match_compromised(deps, bad), D.lock_injection(deps, trusted), D.enrich_vulns(deps, adv, kev), D.match_ioc_names(deps, bad.selectExpr("package as name"))]
        assert [x.count() for x in found] == [6, 4, 3, 3]
        for x in found:
            assert "SortMergeJoin" not in x._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
