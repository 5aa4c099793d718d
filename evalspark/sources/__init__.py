"""Scans and sinks (S01-S21): typed tables, result trees, matrices and artifact manifests."""
