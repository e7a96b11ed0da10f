"""Sources and sinks on files that the tests write."""

import io
import json
import tempfile
import zipfile

import pytest

from corpus_guard.sources.archives import expand_archives, pack_archives
from corpus_guard.operators.inventory import read_corpus
from corpus_guard.operators.rules import load_rules
from corpus_guard.sources import manifests as M


def put(name, text):
    path = f"{tempfile.mkdtemp(prefix='spark-src-')}/{name}"
    with open(path, "w") as f:
        f.write(text if isinstance(text, str) else json.dumps(text))
    return path


def test_rule_pack(spark):
    rule = {"id": "A-1", "type": "regex", "pattern": "x", "title": "t", "severity": "high", "category": "c"}
    pack = {"schema_version": "1.0", "pack": "p", "pack_version": 3, "rules": [rule, {**rule, "id": "A-2", "retired": True}, {**rule, "id": "A-3", "pattern": None}, {**rule, "id": "A-4", "confidence": 7}, {**rule, "id": "A-5", "severity": "odd"}]}
    assert {r.id: r.confidence for r in load_rules(spark, put("p.json", pack)).collect()} == {"A-1": 0.8, "A-4": 1.0, "A-5": 0.4}


def test_threat_tables(spark):
    c = M.load_compromised(spark, put("c.json", {"campaigns": {"x": {"ecosystem": "npm", "packages": {"a": ["1.0", "1.1"], "b": ["*"]}}}}))
    assert sorted((r.package, r.version, r.wildcard) for r in c.collect()) == [("a", "1.0", False), ("a", "1.1", False), ("b", "*", True)]
    assert sorted((r.name, r.wildcard) for r in M.load_package_list(spark, put("l.txt", "# c\n@s/a@1.0\nb@*\n\n")).collect()) == [("@s/a", False), ("b", True)]
    with pytest.raises(ValueError, match="allowed"):
        M.load_package_list(spark, put("l.txt", "a@*\nb@*\n"), most_wild=1)
    kev = put("k.json", {"vulnerabilities": [{"cveID": f"cve-2024-{1000 + i}"} for i in range(5)] + [{"cveID": "bad"}]})
    assert M.load_kev(spark, kev).count() == 0 and M.load_kev(spark, kev, least=5).count() == 5
    osv = {"vulns": [{"id": "O1", "aliases": ["CVE-1"], "severity": [{"type": "x", "score": "9.8"}], "affected": [{"package": {"ecosystem": "PyPI", "name": "n"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "1.2"}]}]}]}, {"id": "O2"}]}
    got = {r.id: r for r in M.load_advisories(spark, put("o.json", osv)).collect()}
    assert got["O1"].fixed_in == ["1.2"] and got["O1"].cvss == 9.8 and got["O1"].ecosystem == "pypi" and got["O2"].package is None
    rel = M.load_releases(spark, put("r.json", {"name": "n", "time": {"created": "x", "1.0": "2024-01-02T00:00:00Z"}, "versions": {"1.0": {"maintainer": "m"}}}))
    assert [(r.version, r.maintainer) for r in rel.collect()] == [("1.0", "m")]


def test_findings_round_trip(spark):
    path = put("f.json", '{"repo": "a", "title": "t", "severity": "low", "line": 3}\n{broken\n')
    got = M.read_findings(spark, path).collect()
    assert sorted(str(r.category) for r in got) == ["None", "scan-incomplete"]
    out = tempfile.mkdtemp(prefix="spark-src-") + "/o"
    M.write_findings(M.read_findings(spark, path).where("repo is not null"), out, "json")
    assert spark.read.json(out).count() == 1


def test_archives(spark):
    def zipped(**members):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for k, v in members.items():
                z.writestr(k, v)
        return data.getvalue()

    deep = zipped(inner=zipped(a="x = 1", b=zipped(c="no")))
    rows = [("d.zip", bytearray(deep)), ("bad.zip", bytearray(b"PK\x03\x04junk")), ("plain.txt", bytearray(b"hello")), ("none", None)]
    got = {r.path: r for r in expand_archives(spark.createDataFrame(rows, "path string, bytes binary")).collect()}
    assert got["d.zip!inner!a"].content == "x = 1" and "d.zip!inner!b" in got and not any("!c" in k for k in got)
    assert got["bad.zip"].error and "plain.txt" not in got


def test_corpus_folder(spark):
    path = put("a.py", "print(1)")
    folder = path.rsplit("/", 1)[0]
    with open(folder + "/b.png", "wb") as f:
        f.write(b"\x89PNG")
    assert [r.base for r in read_corpus(spark, folder).collect()] == ["a.py"]
    assert read_corpus(spark, folder, aux=True).count() == 2


def test_nested_lock_and_overrides(spark):
    v1 = {"dependencies": {"a": {"version": "1", "dependencies": {"b": {"version": "2", "dependencies": {"c": {"version": "3"}}}}}}}
    df = spark.createDataFrame([("r", "package-lock.json", json.dumps(v1)), ("r", "x/package-lock.json", "not json"), ("r", "y/package-lock.json", None)], "repo string, path string, content string")
    assert sorted((r.name, r.version) for r in M.package_lock(df).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    over = {"dependencies": {"x": "1"}, "overrides": {"**/x": "9", "y": "2", "z": {".": "3", "w": {"q": "4"}}}}
    df = spark.createDataFrame([("r", "package.json", json.dumps(over))], "repo string, path string, content string")
    assert sorted((r.name, r.version) for r in M.flatten_overrides(df).collect()) == [("q", "4"), ("x", "9"), ("y", "2"), ("z", "3")]
    assert sorted((r.name, r.version, r.kind) for r in M.npm_manifest(df).collect()) == [("x", "1", "dependencies"), ("y", "2", "override")]


def test_archives_over_limits(spark):
    import io
    import tarfile
    import zipfile

    def zipped(members, how=zipfile.ZIP_STORED):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", how) as z:
            for k, v in members.items():
                z.writestr(k, v)
        return data.getvalue()

    def tarred(members, mode):
        data = io.BytesIO()
        with tarfile.open(fileobj=data, mode=mode) as t:
            for k, v in members.items():
                info = tarfile.TarInfo(k)
                info.size = len(v)
                t.addfile(info, io.BytesIO(v))
        return data.getvalue()

    many = {f"m{i:05d}": b"x%d" % i for i in range(10_000)}
    deep = zipped({"a": zipped({"b": zipped({"c": b"no"})})})
    rows = [
        ("many.zip", zipped(many)), ("many.tgz", tarred(many, "w:gz")), ("bomb.zip", zipped({"z": b"0" * 3_000_000, "ok": b"fine"}, zipfile.ZIP_DEFLATED)), ("big.tar", tarred({"big": b"1" * (11 << 17), "after": b"yes"}, "w")),
        ("deep.zip", deep), ("total.tar", tarred({f"p{i}": b"2" * (9 << 17) for i in range(13)}, "w")), ("cut.zip", zipped(many)[:5000]), ("none", None), ("text", b"hello"),
    ]
    got = expand_archives(spark.createDataFrame([(p, None if d is None else bytearray(d)) for p, d in rows], "path string, bytes binary"), {"member": 10 << 17, "bytes": 100 << 17}).collect()
    of = lambda name: [r for r in got if r.path.split("!")[0] == name]
    assert len([r for r in of("many.zip") if r.error is None]) == 1000 and [r.error for r in of("many.zip") if r.error] == ["archive-limit: 9000 members over 1000 left out"]
    assert len([r for r in of("many.tgz") if r.error is None]) == 1000 and [r.error for r in of("many.tgz") if r.error] == ["archive-limit: all further members over 1000 left out"]
    assert {r.path: (r.error or r.content) for r in of("bomb.zip")} == {"bomb.zip!z": "archive-limit: unpacks over 100 times", "bomb.zip!ok": "fine"}
    assert {r.path: (r.error or r.content) for r in of("big.tar")} == {"big.tar!big": "archive-limit: member over 1310720 bytes", "big.tar!after": "yes"}
    assert {(r.path, (r.error or "")[:21]) for r in of("deep.zip")} == {("deep.zip!a", ""), ("deep.zip!a!b", ""), ("deep.zip!a!b", "archive-limit: nested")}
    assert [r.error for r in of("total.tar") if r.error] == ["archive-limit: archive over 13107200 bytes"] and len(of("total.tar")) == 12
    assert [r.error for r in of("cut.zip")] == ["BadZipFile"] and not of("none") and not of("text")


def test_packed_archives_come_back_whole(spark):
    files = spark.createDataFrame([("a", "x\u00e9"), ("b", None), ("c", "")], "path string, content string")
    got = sorted((r.path, r.content) for r in expand_archives(pack_archives(files)).where("path not like '%!inner'").collect())
    assert got == sorted((f"{p}.zip!{m}", t) for p, t in (("a", "x\u00e9"), ("b", ""), ("c", "")) for m in ("content", "inner!content"))


def test_lockfiles_are_read_without_a_sort(spark):
    text = '[[package]]\nname = "a"\nversion = "1"\n[[package]] x\nname = "b"\n[package.dependencies]\nname = "c"\n[[package]]\nversion = "2"\n"@s/y@^1", "@s/y@2":\n  version "3"\n  version "4"\npackages:\n  /p@5(q@6):\nsnapshots:\n  /z@7:'
    df = spark.createDataFrame([("r", "f", text), ("r", "n", None), ("r", "e", "")], "repo string, path string, content string")
    want = {M.poetry_lock: [("b", "1")], M.yarn_lock: [("@s/y", "3"), ("@s/y", "4")], M.pnpm_lock: [("p", "5")]}
    for read, rows in want.items():
        found = read(df)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Window", "Sort", "Exchange")) and sorted((r.name, r.version) for r in found.collect()) == rows


def test_levels_of_overrides_are_computed_once(spark):
    df = spark.createDataFrame([("r", "f", '{"overrides": {"a": {".": "1", "b": "2"}}}')], "repo string, path string, content string")
    found = M.flatten_overrides(df)
    assert "parse_json" not in found._jdf.queryExecution().optimizedPlan().toString() and sorted((r.name, r.version) for r in found.collect()) == [("a", "1"), ("b", "2")]
