"""Lens views and end-to-end plans."""
