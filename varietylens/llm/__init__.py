"""Operators of a training-data pipeline: near-duplicate search, mixing,
sharding, toxicity, fingerprints, packing, WARC archives, language ID.

Nothing else in the library imports this subpackage. Each operator module has
a general interface; ``queries`` derives the registered result tables.
"""
