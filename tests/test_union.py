"""The union of detectors, the literal prefilter of rules, and entropy over whole strings."""

import json
import math
import re
from collections import Counter

import pytest

from corpus_guard.detectors.rule_sets import SCANS
from corpus_guard.functions.scalars import entropy
from corpus_guard.operators.correlate import FILE_RULES, REPO_RULES, correlate
from corpus_guard.operators.rules import Rule, Scan, as_rules, audit_findings, load_rules, needed, required, run_scan
from corpus_guard.registered.report_queries import every_finding, parser_findings
from corpus_guard.schema import FINDING

SF = "/root/testdata/sf0.001"


def test_every_compound_rule_fires_on_the_tables(spark):
    found = {r.rule_id for r in correlate(every_finding(spark, SF)).select("rule_id").distinct().collect()}
    assert found == {m.id for m in FILE_RULES} | {r[0] for r in REPO_RULES}


def test_parser_findings_have_the_schema(spark):
    found = parser_findings(spark, SF)
    assert found.columns == FINDING.names
    assert {"py_ast", "taint", "decoder", "entropy"} <= {r.scanner for r in found.select("scanner").distinct().collect()}


@pytest.mark.parametrize(("pattern", "want"), [(r"\beval\s*\(", {"eval"}), (r"(?i)(Send|post).{0,9}token", {"token"}), (r"[a-z]+|x", set()), (r"(a|bc)?d+", {"d"}), (r"(curl|wget)\s", {"curl", "wget"})])
def test_required_literals(pattern, want):
    assert set(required(pattern)) == want


def test_required_literals_are_in_every_match():
    text = "\n".join(x for _, s in SCANS.values() for r in s.rules for x in r.match) + " eval( exec( curl x | sh os.environ JSON.stringify(process.env) USER root"
    for _, scan in SCANS.values():
        for r in scan.rules:
            for m in re.finditer(r.pattern, text):
                lits = required(r.pattern)
                assert not lits or any(x in m[0].lower() for x in lits), r.id


def test_fused_scan_equals_single_scans(spark):
    rules = (Rule("A-1", "t", "c", "high", r"^ab[^|]*\|x$"), Rule("A-2", "t", "c", "low", "(?i)ignore", ("md",), "not"), Rule("A-3", "t", "d", "low", "", kind="keyword", values=("Key",)))
    scans = [Scan("one", rules), Scan("two", rules, "ext = 'md'", "file", "skip", comments=False), Scan("three", rules, fenced=False, keep="line")]
    rows = [("r", f"p/{i}.md", "md", t) for i, t in enumerate(["ab\n|x", "ab |x\nIGNORE\nkey", "ignore not", None, "", "# ignore\n```\nignore\n```\nab c|x", "a" * 20_000 + " key ignore", "key"])]
    files = spark.createDataFrame(rows, "repo string, path string, ext string, content string")
    both = sorted(map(str, audit_findings(files, scans).collect()))
    assert both == sorted(str(r) for s in scans for r in run_scan(files, s).collect()) and len(both) > 10


def test_entropy_of_whole_strings(spark):
    texts = ["", None, "a", "ab", "é日本" * 50, "abc" * 700_000, " \x00x"]
    got = [r.e for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", entropy("t").alias("e")).orderBy("i").collect()]
    for t, e in zip(texts, got):
        want = None if t is None else -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0
        assert (e is None) == (want is None) and (e is None or abs(e - want) < 1e-9)


def test_rule_packs_drive_a_scan(spark, tmp_path):
    rules = [
        {"id": "P-1", "type": "regex", "pattern": "ab+c", "flags": ["IGNORECASE"], "title": "re", "severity": "high", "category": "x"}, {"id": "P-2", "type": "keyword", "values": ["\uff2bey"], "title": "kw", "severity": "low", "category": "x"},
        {"id": "P-3", "type": "mapping", "mapping": {"Zed": "z"}, "title": "map", "severity": "low", "category": "y"}, {"id": "P-4", "type": "charset", "values": ["\u200b"], "title": "cs", "severity": "low", "category": "y"}, {"id": "P-5", "type": "regex", "title": "no pattern"},
    ]
    (tmp_path / "p.json").write_text(json.dumps({"schema_version": "1.0", "pack": "p", "pack_version": 1, "rules": rules}))
    found = as_rules(load_rules(spark, str(tmp_path / "p.json")))
    files = spark.createDataFrame([("r", "a.md", "md", "xABBC\nthe key\nZed zed\n\u200b"), ("r", "b.md", "md", "zed")], "repo string, path string, ext string, content string")
    got = sorted((r.rule_id, r.line) for r in audit_findings(files, [Scan("pack", found)]).collect())
    assert got == [("P-1", 1), ("P-2", 2), ("P-3", 3), ("P-4", 4)]


def test_the_whole_audit_unites_all_detectors(spark):
    from corpus_guard.operators.correlate import correlate as compound
    from corpus_guard.plans.staging import stage
    from corpus_guard.registered.report_queries import all_findings, summarize

    base = stage(all_findings(spark, SF), "test-findings")
    assert base.columns == FINDING.names
    scanners = {r.scanner for r in base.select("scanner").distinct().collect()}
    assert {"py_ast", "taint", "decoder", "entropy", "runtime_dynamism", "entrypoint", "sast", "mcp_security", "dependencies"} <= scanners
    total = summarize(base).agg({"total": "sum"}).first()[0]
    assert total == base.count() + compound(base).count()


def test_all_needed_literals_are_asked():
    assert needed(r"\|\s*(nc|ncat|curl)\s") == (("curl", "nc", "ncat"), ("|",))
    assert needed(r"(?i)^ENV\s+\w*(TOKEN|KEY)\w*") == (("env",), ("key", "token"))
    assert needed(r"a(b|c[de])?x{0,2}y+") == (("a",), ("y",)) and needed(r"x|[a-z]+") == ()
