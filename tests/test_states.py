"""The states of files that rules over files are asked for."""

from pyspark.sql import functions as F

from corpus_guard.operators.correlate import KEYWORDS, correlate_files, file_states, has, holds, with_tags
from corpus_guard.registered.report_queries import every_finding

SF = "/root/testdata/sf0.001"


def test_states_of_files_are_the_sets_of_their_findings(spark):
    found = with_tags(every_finding(spark, SF))
    want = found.groupBy("repo", "file").agg(*[F.bool_or(has(k)).alias(k) for k in KEYWORDS])
    want = {(r.repo, r.file): {k for k in KEYWORDS if r[k]} for r in want.collect()}
    states = file_states(found.drop("tags")).select("repo", "file", *[holds("held", k).alias(k) for k in KEYWORDS])
    assert {(r.repo, r.file): {k for k in KEYWORDS if r[k]} for r in states.collect()} == {k: v for k, v in want.items() if v}


def test_rules_are_asked_once_for_a_state(spark):
    """all rules were asked of every file."""
    cols = "repo string, scanner string, severity string, title string, description string, file string, line int, snippet string, category string, rule_id string, confidence double"
    rows = [("r", "s", "high", t, t, f, 1, "", "c", "R", 0.8) for i in range(50) for f in (f"{i}.py", None if i else "x.md") for t in ("environ", "curl", "curl")]
    found = correlate_files(spark.createDataFrame(rows, cols))
    assert "ArrayFilter" not in found._jdf.queryExecution().optimizedPlan().toString() and "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.file for r in found.where("rule_id = 'M1'").collect()} == {f"{i}.py" for i in range(50)} | {"x.md", None}
