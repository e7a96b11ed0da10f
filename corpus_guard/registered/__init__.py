"""Registered queries, one module per family."""
