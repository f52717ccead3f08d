"""Scans of arriving files."""
