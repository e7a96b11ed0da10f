"""Operators on findings, dependencies, snapshots and graphs."""
