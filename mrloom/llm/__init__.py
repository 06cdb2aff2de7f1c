"""Operators for large text corpora: scans, deduplication, joins, scoring, mixing and sharding."""
