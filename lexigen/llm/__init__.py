"""Operators of a training-data pipeline: counting, packing, filtering, deduplication,
search and extraction. Nothing outside this subpackage imports it."""
