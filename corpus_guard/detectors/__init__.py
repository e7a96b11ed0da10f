"""Detectors over files and lines; each returns findings."""
