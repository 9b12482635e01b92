"""Operators for training-data pipelines: search, scans, classifiers, tokens and deduplication of documents."""
