"""Operators of a training-data pipeline (packing, quality, near duplicates,
extraction, dedup, sharding, mixing, language).  Nothing outside this
subpackage imports it; ``queries.py`` holds the registered queries."""
