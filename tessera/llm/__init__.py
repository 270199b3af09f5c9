"""Operators of a training-data pipeline: mixing, scoring, packing, dedup, sanitising, sharding, search, language ID."""
