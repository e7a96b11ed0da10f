"""Chains that follow an edge once for each seed, and taint in one pass, against plain versions."""

import random
import re

from corpus_guard.detectors.taint import ASSIGN, SINK, SOURCE, flows, taint_flows
from corpus_guard.operators.graph import reference_chains, simple_chains

EDGES, SEEDS = "repo string, src string, dst string", "repo string, src string"


def plain_chains(edges, seeds, depth):
    out = []
    for repo, seed in set(seeds):
        front, used = {seed: [(seed,)]}, set()
        for hop in range(1, depth + 1):
            best = {}
            for end, paths in front.items():
                for r, a, b in edges:
                    if r != repo or a != end or (a, b) in used:
                        continue
                    free = [p for p in paths if b not in p]
                    if free:
                        best[a, b] = (*min(free), b)
            used |= set(best)
            front = {}
            for (_, b), p in best.items():
                front.setdefault(b, []).append(p)
            out += [(repo, ">".join(p), hop) for p in best.values() if hop >= 2]
    return sorted(out)


def test_chains(spark):
    r = random.Random(8)
    edges = sorted({(f"r{r.randrange(3)}", f"n{r.randrange(9)}", f"n{r.randrange(9)}") for _ in range(120)})
    edges = [e for e in edges if e[1] != e[2]]
    seeds = [("r0", "n0"), ("r0", "n4"), ("r1", "n2"), ("r1", "n2"), ("r9", "n0")]
    got = reference_chains(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, SEEDS)).collect()
    assert sorted((x.repo, x.chain, x.hops) for x in got) == plain_chains(edges, seeds, 5)
    assert all(x.severity == ("high" if x.hops >= 3 else "medium") for x in got)


def test_chains_of_a_complete_graph(spark):
    n = 50
    edges = spark.createDataFrame([("r", f"n{i}", f"n{j}") for i in range(n) for j in range(n) if i != j], EDGES)
    seeds = spark.createDataFrame([("r", "n0"), ("r", "n1")], SEEDS)
    rows = reference_chains(edges, seeds).count()
    assert 0 < rows <= 2 * n * (n - 1)
    assert reference_chains(edges, seeds.limit(0)).count() == 0


def test_all_simple_chains(spark):
    edges = [("r", a, b) for a, b in ("ab", "ac", "bd", "cd", "de", "ea", "ef", "fg")]
    got = simple_chains(spark.createDataFrame(edges, EDGES), spark.createDataFrame([("r", "a"), ("r", "a"), ("s", "a")], SEEDS)).collect()

    def walk(path):
        for _, a, b in edges:
            if a == path[-1] and b not in path and len(path) <= 5:
                yield (*path, b)
                yield from walk((*path, b))

    want = sorted((">".join(p), len(p) - 1, "high" if len(p) > 3 else "medium") for p in walk(("a",)) if len(p) > 2)
    # both ways to d go on over d>e, which an edge followed once would cut
    assert sorted((x.chain, x.hops, x.severity) for x in got) == want and "a>b>d>e>f" in {w[0] for w in want} and "a>c>d>e>f" in {w[0] for w in want}


def plain_flows(content):
    """By reaching definitions: every use looks up the latest assignment above it."""
    lines = [x[:10_000] for x in content.split("\n")]
    defs = {i: m for i, x in enumerate(lines, 1) if (m := re.match(ASSIGN, x, re.ASCII))}

    def source(line):
        m = defs[line]
        if re.search(SOURCE, m[2]):
            return line
        found = [s for w in re.findall(r"[A-Za-z0-9_]+", m[2], re.ASCII) if (at := latest(w, line)) and (s := source(at))]
        return min(found, default=None)

    def latest(w, line):
        return max((i for i, m in defs.items() if m[1] == w and i < line), default=None)

    out = []
    for i, x in enumerate(lines, 1):
        if re.search(SINK, x):
            for w in set(re.findall(r"[A-Za-z0-9_]+", x, re.ASCII)):
                if (at := latest(w, i)) and (s := source(at)):
                    out.append((s, i, w))
    return sorted(out)


def test_taint(spark):
    r = random.Random(6)
    names = ["a", "b", "c", "d", "key"]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(r.randrange(1, 30)):
            v, u, w = (r.choice(names) for _ in range(3))
            lines.append(r.choice([f"{v} = os.environ['X']", f"{v} = {u} + {w}", f"const {v} = process.env.{u};", f"{v}: str = {u}", f"eval({v}, {u})", f"{v} = requests.get({u})", f"if {v} == {u}:", f"{v} = 1", "é" + v + f" = {u}", f"x2{v} = {u}"]))
        rows.append(("r", f"{i}.py", "py", "\n".join(lines)))
    for _, _, _, text in rows:
        assert sorted(flows(text)) == plain_flows(text)
    odd = [("r", "n.py", "py", None), ("r", "e.py", "py", ""), ("r", "t.md", "md", rows[0][3]), ("r", "long.js", "js", "k = process.env.K;\n" + "k = k + 1;\n" * 30_000 + "fetch(k)")]
    got = taint_flows(spark.createDataFrame(rows + odd, "repo string, path string, ext string, content string")).collect()
    want = sorted((p, *f) for _, p, e, t in rows for f in plain_flows(t)) + [("long.js", 1, 30_002, "k")]
    assert sorted((x.path, x.source_line, x.sink_line, x.variable) for x in got) == sorted(want) and len(want) > 50
