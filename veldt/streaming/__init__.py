"""Incremental scans."""
