"""Queries of the rule scans."""

from __future__ import annotations

from corpus_guard.detectors.rule_sets import SCANS
from corpus_guard.operators.rules import run_scan, scan_oracle
from corpus_guard.plans.views import oracle, view
from corpus_guard.registry import ORACLES, QUERIES


def _query(scan):
    return lambda spark, sf_dir: run_scan(view(spark, sf_dir, "files_v"), scan)


for _name, (_id, _scan) in SCANS.items():
    QUERIES[_name] = _query(_scan)
    ORACLES[_name] = oracle(scan_oracle(_scan), "files_v")
