"""Values that come from a source and reach a sink in the same file, through assignments in line order.

Only files that hold a source and a sink are read (a filter in the JVM); each is one pass over its lines in an Arrow
job. A line is cut into words once and each word looked up among the tainted names, so the cost grows with the text, not with
text times names. No shuffle.

A name is tainted while its latest assignment above is a source or uses a tainted name; of several, the earliest
source counts. A sink line is read before its own assignment. Lines are cut at ``MAX_LINE`` characters; null content has none.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_guard.schema import MAX_LINE

EXTENSIONS = ("py", "js", "ts")
ASSIGN = r"^\s*(?:(?:const|let|var)\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*(?::[^=]+)?=\s*([^=].*)$"
SOURCE = r"(os\.environ|os\.getenv|process\.env|open\(|input\()"
SINK = r"(requests\.(get|post)|fetch\s*\(|subprocess\.|eval\s*\(|exec\s*\(|os\.system)"
_ASSIGN, _SOURCE, _SINK = (re.compile(p, re.ASCII) for p in (ASSIGN, SOURCE, SINK))
_WORD = re.compile(r"[A-Za-z0-9_]+", re.ASCII)


def flows(content: str) -> list[tuple[int, int, str]]:
    """(source line, sink line, variable) of one file."""
    tainted: dict[str, int] = {}
    out = []
    for line, text in enumerate(content.split("\n"), 1):
        text = text[:MAX_LINE]
        if tainted and _SINK.search(text):
            out += [(tainted[w], line, w) for w in dict.fromkeys(_WORD.findall(text)) if w in tainted]
        if "=" in text and (m := _ASSIGN.match(text)):
            var, value = m[1], m[2]
            if _SOURCE.search(value):
                tainted[var] = line
            elif tainted:
                source = min((tainted[w] for w in _WORD.findall(value) if w in tainted), default=None)
                if source is None:
                    tainted.pop(var, None)
                else:
                    tainted[var] = source
    return out


def taint_flows(files: DataFrame) -> DataFrame:
    """C52 over files(repo, path, ext, content): repo, path, source_line, sink_line, variable."""

    def work(batches):
        for batch in batches:
            out = [(r, p, *row) for r, p, text in zip(*(batch.column(c).to_pylist() for c in ("repo", "path", "content"))) for row in flows(text)]
            if out:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["repo", "path", "source_line", "sink_line", "variable"])

    both = files.where(F.col("ext").isin(*EXTENSIONS) & F.col("content").rlike(SOURCE) & F.col("content").rlike(SINK))
    return both.select("repo", "path", "content").mapInArrow(work, "repo string, path string, source_line int, sink_line int, variable string")


def _words(text: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array({text}, '[^A-Za-z0-9_]+'), lambda x: x <> ''))"


#: The same for DuckDB over code_v: reaching definitions as rows, taint as their transitive closure.
TAINT_SQL = f""", tl AS (SELECT repo, path, CAST(line AS INT) AS line, substring(text, 1, {MAX_LINE}) AS text FROM (
  SELECT repo, path, unnest(x) AS text, generate_subscripts(x, 1) AS line FROM (SELECT repo, path, string_split(content, chr(10)) AS x FROM code_v WHERE ext IN {EXTENSIONS}))),
defs AS (SELECT repo, path, line, regexp_extract(text, '{ASSIGN}', 1) AS var, regexp_extract(text, '{ASSIGN}', 2) AS value FROM tl WHERE regexp_matches(text, '{ASSIGN}')),
uses AS (SELECT repo, path, line, 'def' AS kind, unnest({_words('value')}) AS v FROM defs UNION ALL SELECT repo, path, line, 'sink', unnest({_words('text')}) FROM tl WHERE regexp_matches(text, '{SINK}')),
reach AS (SELECT u.repo, u.path, u.line, u.kind, u.v, max(d.line) AS from_line FROM uses u JOIN defs d ON u.repo = d.repo AND u.path = d.path AND d.var = u.v AND d.line < u.line GROUP BY ALL),
tt AS (SELECT repo, path, line, line AS src FROM defs WHERE regexp_matches(value, '{SOURCE}')
  UNION SELECT r.repo, r.path, r.line, tt.src FROM tt JOIN reach r ON r.repo = tt.repo AND r.path = tt.path AND r.from_line = tt.line AND r.kind = 'def'
  JOIN defs d ON d.repo = r.repo AND d.path = r.path AND d.line = r.line WHERE NOT regexp_matches(d.value, '{SOURCE}')),
tainted AS (SELECT repo, path, line, min(src) AS src FROM tt GROUP BY ALL)
SELECT r.repo, r.path, s.src AS source_line, r.line AS sink_line, r.v AS variable FROM reach r JOIN tainted s ON r.repo = s.repo AND r.path = s.path AND r.from_line = s.line WHERE r.kind = 'sink'"""
