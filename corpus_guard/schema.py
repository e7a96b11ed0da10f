"""Declared schemas and scales of the fact rows."""

from __future__ import annotations

from pyspark.sql import types as T

FINDING = T.StructType(
    [
        T.StructField("repo", T.StringType()), T.StructField("scanner", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()), T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("snippet", T.StringType()),
        T.StructField("category", T.StringType()), T.StructField("rule_id", T.StringType()), T.StructField("confidence", T.DoubleType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("ord", T.IntegerType()), T.StructField("rule_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("confidence", T.DoubleType()),
    ]
)

#: Severity scores, default confidence by severity, and verdict cut-offs.
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}
CONFIDENCE = {"critical": 0.95, "high": 0.80, "medium": 0.60, "low": 0.40}
BLOCK_AT, WARN_AT, INFO_AT = 0.92, 0.60, 0.30

MAX_LINE = 10_000
SNIPPET = 120
