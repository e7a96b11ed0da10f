"""Reassembly of split payloads, and the one parse of Python files, with what goes down the decode ladder."""

import base64
import itertools
import random

from corpus_guard.detectors.python_jobs import decode_rescan, fragments
from corpus_guard.detectors.python_source import decoded_arguments, of_scan, parse_python
from corpus_guard.detectors.split_payloads import LEAST, find_split_payloads, fragment_groups, group_sizes, reassemble, scan_split_payloads
from corpus_guard.detectors.union import source_findings
from corpus_guard.schema import FINDING

FRAG = "repo string, path string, frag string, ord int"


def pieces(text, cuts):
    at = [0, *cuts, len(text)]
    return [text[a:b] for a, b in zip(at, at[1:])]


def test_scrambled_payload_is_put_together(spark):
    blob = base64.b64encode(b"import os; os.system('curl http://x')  ").decode()
    parts = pieces(blob, [12, 25, 33, 40])
    order = [3, 0, 4, 1, 2]  # neither path, length nor appearance
    rows = [("r", f"p{i}.js", parts[k], 9 - k) for i, k in enumerate(order)]
    found = scan_split_payloads(spark.createDataFrame(rows, FRAG)).collect()
    assert {(r.category, r.detail) for r in found} == {("split-payload", "base64 os.system")}
    one_file = spark.createDataFrame([("r", "p", f, i) for i, (_, _, f, _) in enumerate(rows)], FRAG)
    assert scan_split_payloads(one_file).count() == 0
    assert scan_split_payloads(spark.createDataFrame(rows[:2], FRAG)).count() == 0


def test_pieces_of_a_narrower_alphabet(spark):
    blob = base64.b64encode(b"eval(abcdefg) #\x20\x20 zzz").decode()
    at = next(i for i in range(len(blob) - 6) if all(c in "0123456789abcdefABCDEF" for c in blob[i : i + 2]))
    parts = pieces(blob, [at, at + 2])
    rows = [("r", f"{i}", parts[k], i) for i, k in enumerate((1, 2, 0))]
    groups = {r.grp for r in group_sizes(fragment_groups(spark.createDataFrame(rows, FRAG))).collect()}
    assert groups == {"base64+"}
    assert {r.detail for r in scan_split_payloads(spark.createDataFrame(rows, FRAG)).collect()} == {"base64 eval("}


def test_joins_of_groups(spark):
    r = random.Random(3)
    rows = [(f"r{g}", f"p{r.randrange(4)}", "".join(r.choice("abcxyzQ9") for _ in range(r.choice([6, 8, 12]))) + "z", i) for g in range(12) for i in range(r.choice([2, 3, 5, 6, 9]))]
    got = {}
    for x in reassemble(spark.createDataFrame(rows, FRAG)).collect():
        got.setdefault(x.repo, set()).add(x.blob)
    want = {}
    for repo in {x[0] for x in rows}:
        m = sorted((p, o, f) for q, p, f, o in rows if q == repo)
        if len(m) < LEAST or len({p for p, _, _ in m}) < 2:
            continue
        by_length = sorted(m, key=lambda x: (len(x[2]), x[0], x[1]))
        ways = [m, m[::-1], by_length, by_length[::-1], sorted(m, key=lambda x: (x[1], x[0]))]
        ways += itertools.permutations(m) if len(m) <= 6 else []
        want[repo] = {"".join(f for _, _, f in w) for w in ways}
    assert got == want


def test_large_groups_are_cut_and_reported(spark):
    rows = [("r", f"p{i % 7}", f"Zz{i:06d}q", i) for i in range(400)] + [("s", f"p{i}", f"Zz{i:06d}q", i) for i in range(5)]
    found = scan_split_payloads(spark.createDataFrame(rows, FRAG)).collect()
    assert [(r.repo, r.category, r.detail) for r in found] == [("r", "split-group-limit", "144 fragments left out")]
    assert max(len(r.blob) for r in reassemble(spark.createDataFrame(rows, FRAG)).where("repo = 'r'").collect()) == 256 * 9


def test_fragments_of_files_feed_the_search(spark):
    blob = base64.b64encode(b"x=1;require('child_process').exec(`id`)").decode()
    parts = pieces(blob, [14, 30, 41])
    files = [("r", f"{n}.js", f"const {n} = '{parts[k]}';") for n, k in zip("abcd", (2, 0, 3, 1))] + [("r", "e.md", None), ("q", "z", "")]
    frags = fragments(spark.createDataFrame(files, "repo string, path string, content string"))
    assert {r.detail for r in scan_split_payloads(frags).collect()} == {"base64 child_process"}
    assert scan_split_payloads(frags.limit(0)).count() == 0


CODE = """
import base64, importlib
try:
    import yaml
except ImportError:
    pip.main(['install', 'yaml'])
payload = base64.b64decode("aW1wb3J0IG9zCm9zLnN5c3RlbSgnaWQnKQ==")
data = bytes.fromhex('6576616c282278222929')
name = b"ZXZhbChpbnB1dCgpKQ==".decode()
exec(base64.b64decode(x))
importlib.import_module(name)
if datetime.now() > limit:
    pass
class A:
    def __reduce__(self):
        return 1
"""


def test_one_parse_gives_all_scans(spark):
    files = [("r", "a.py", "py", CODE), ("r", "b.py", "py", "def f(:"), ("r", "c.py", "py", None), ("r", "d.js", "js", CODE), ("r", "e.py", "py", "(" * 5000), ("r", "f.py", "py", "x = 1\n" * 50_000 + "eval(compile(y))")]
    rows = parse_python(spark.createDataFrame(files, "repo string, path string, ext string, content string"))
    of = lambda scan: {(r.path, r.line, r.category) for r in of_scan(rows, scan).collect()}
    assert of("ast") == {("a.py", 10, "encoded-exec"), ("a.py", 11, "computed-import"), ("a.py", 15, "reduce"), ("b.py", 0, "unparseable"), ("e.py", 0, "unparseable"), ("f.py", 50_001, "eval-compile")}
    assert of("dynamism") == {("a.py", 11, "dynamic-import"), ("a.py", 12, "time-bomb")}
    assert of("entry") == {("a.py", 10, "entrypoint-import-exec"), ("f.py", 50_001, "entrypoint-import-exec")}
    assert of("fallback") == {("a.py", 3, "import-else-install")}
    assert {(r.depth, r.trail, r.call) for r in decoded_arguments(rows).collect()} == {(1, "base64", "os.system"), (1, "hex", "eval("), (1, "base64", "eval(")}


def test_findings_of_python_files(spark):
    files = spark.createDataFrame([("r", "a.py", "py", CODE)], "repo string, path string, ext string, content string")
    found = source_findings(files)
    assert found.columns == FINDING.names
    assert {r.scanner for r in found.collect()} == {"py_ast", "runtime_dynamism", "entrypoint", "manifest_drift", "decoder"}


def test_signs_that_count_in_programs_only(spark):
    texts = ["import shutil\nshutil.rmtree(target)", "the helper will call shutil.rmtree(target) only after a check", "getattr(mod, 'system')('id')", "plain words of a decoded note, nothing more", "x = open('/home/u/.ssh/id_rsa').read()"]
    blobs = [("r", f"{i}", base64.b64encode(t.encode()).decode()) for i, t in enumerate(texts)]
    found = {r.path: r.call for r in decode_rescan(spark.createDataFrame(blobs, "repo string, path string, blob string")).collect()}
    assert set(found) == {"0", "2", "4"}


def test_fragments_and_blobs_do_not_wait_in_arrow_batches(spark):
    from corpus_guard.detectors.python_jobs import decode_rescan, fragments

    files = spark.createDataFrame([("r", "a", "x 'abcdef' \"abcdef\" 'ZZZZZZ1' 'short' 'abcdef'"), ("r", "n", None)], "repo string, path string, content string")
    found = fragments(files)
    assert sorted((x.path, x.frag, x.ord) for x in found.collect()) == [("a", "ZZZZZZ1", 2), ("a", "abcdef", 0)]
    calls = decode_rescan(spark.createDataFrame([("r", "b", "b3Muc3lzdGVtKCdpZCcpIyMjIyMjIyMjIyMjIyMj"), ("r", "c", "")], "repo string, path string, blob string"))
    assert {(x.path, x.depth) for x in calls.collect()} == {("b", 1)}
    assert not any(x in df._jdf.queryExecution().executedPlan().toString() for df in (found, calls) for x in ("InPandas", "InArrow", "ArrowEval"))


def test_parts_decode_where_the_whole_does():
    from corpus_guard.detectors.python_jobs import _DECODERS, _decode, decodes_in_part

    r, seen = random.Random(5), {}
    encode = (base64.b64encode, base64.b32encode, base64.b85encode, lambda b: b.hex().encode())
    for i in range(6000):
        text = "".join(r.choice("ab \t\x01é日😀") for _ in range(r.randrange(3, 90))).encode()
        blob = r.choice(encode)(text[r.randrange(3) == 2 :]).decode()
        at = r.randrange(len(blob))
        blob = (blob, blob[:at] + r.choice("=A9z") + blob[at + 1 :], blob + "=", blob[:at], blob + blob)[i % 5]
        parts = [decodes_in_part(blob[k : k + 40], blob[k + 40 : k + 80], k == 0) for k in range(0, len(blob), 40)]
        got = []
        for name, _ in _DECODERS:
            own = [x for p in parts for x in p if x[0] == name]
            n = sum(x[1] for x in own)
            if len(own) == len(parts) and n and sum(x[2] for x in own) / n >= 0.85:
                got.append(name)
        assert got[:2] == [name for name, _ in _decode(blob)], blob
        seen[tuple(got)] = seen.get(tuple(got), 0) + (len(blob) > 40)
    assert all(seen[(x,)] > 50 for x in ("hex", "base64", "base32", "base85"))


def test_large_groups_are_searched_whole(spark):
    """a payload of 400 fragments, of which the bounded search leaves 144 out."""
    text = "# é日😀 " + "x = 1; " * 300 + "os.system('id')  "
    blob = base64.b64encode(text.encode() + b" " * (-len(text.encode()) % 3)).decode()
    parts = [f for f in pieces(blob, sorted(random.Random(1).sample(range(1, len(blob)), 399)))]
    rows = [("path", f"p{i:03d}", x, 0) for i, x in enumerate(parts)] + [("back", f"p{400 - i:03d}", x, 0) for i, x in enumerate(parts)] + [("seen", f"p{i % 7}", x, i) for i, x in enumerate(parts)]
    rows += [("none", f"p{i:03d}", x[::-1], 0) for i, x in enumerate(parts)]
    frags = spark.createDataFrame(rows, FRAG)
    assert {r.category for r in scan_split_payloads(frags).collect()} == {"split-group-limit"}
    want = {(k, "split-payload", "base64 os.system") for k in ("path", "back", "seen")}
    for chunk in (40, 40 * 1024):
        assert {(r.repo, r.category, r.detail) for r in find_split_payloads(frags, chunk=chunk).collect()} == want


def test_large_groups_are_joined_as_small_ones(spark):
    r = random.Random(7)
    encode = (base64.b64encode, base64.b32encode, lambda b: b.hex().encode())
    rows = []
    for g in range(12):
        blob = encode[g % 3](b"# padding " * r.randrange(1, 12) + r.choice((b"eval(x)", b"curl http://x", b"nothing", b"\xff\xfe"))).decode()
        cuts = sorted(r.sample(range(1, len(blob)), r.choice((7, 9, 12))))
        order = list(enumerate(pieces(blob, cuts)))
        if g % 4 == 1:
            order.sort(key=lambda x: (len(x[1]), x[0]))
        rows += [(f"r{g}", f"p{(99 - i if g % 4 == 2 else i):02d}", x, i) for i, x in order]
    frags = spark.createDataFrame(rows, FRAG)
    want = sorted(map(str, find_split_payloads(frags).collect()))
    assert len(want) >= 4 and want == sorted(map(str, scan_split_payloads(frags).collect()))
    assert want == sorted(map(str, find_split_payloads(frags, most=3, chunk=40).collect()))
    assert want == sorted(map(str, find_split_payloads(frags, joined=5, chunk=80).collect()))


def test_few_long_fragments_are_tried_in_every_order(spark):
    blob = base64.b64encode(b"# " + b"pad " * 20_000 + b"; eval(x)  ").decode()
    parts = pieces(blob, [20_001, 70_002, 90_003])
    frags = spark.createDataFrame([("r", f"p{i}", parts[k], i % 2) for i, k in enumerate((2, 0, 3, 1))], FRAG)
    assert scan_split_payloads(frags).count() == 0
    assert {r.detail for r in find_split_payloads(frags).collect()} == {"base64 eval("}


def test_audit_leaves_no_fragment_out(spark):
    from corpus_guard.registered.job_queries import split_payloads
    from corpus_guard.registered.report_queries import parser_findings

    sf = "/root/testdata/sf0.01"
    assert parser_findings(spark, sf).where("scanner = 'splitstream' and category <> 'split-payload'").count() == 0
    assert {r.category for r in split_payloads(spark, sf).select("category").distinct().collect()} == {"split-payload"}
