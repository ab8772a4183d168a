"""Operators of a training-data pipeline: packing, search, formatting, files, deduplication,
sharding, mixing and quality, each a Spark job over a table of any size."""
