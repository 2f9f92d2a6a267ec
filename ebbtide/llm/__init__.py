"""Operators for training-data pipelines: deduplication, filtering, counting and mixing of document tables."""
