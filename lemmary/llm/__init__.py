"""Training-data operators: scoring, packing, deduplication, scanning, encoding, shards.

Every operator takes and returns DataFrames, works on whole texts and defines
its results for nulls, empty texts, repeated rows and empty tables in its
docstring. Nothing else in the package imports this subpackage.
"""
