"""Operators for training-data pipelines: scoring, near-duplicate search, tokenising, decontamination."""
