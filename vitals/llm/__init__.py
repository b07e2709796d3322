"""Training-data operators on Spark: deduplication, scans, scoring, packing, tokens.

Nothing else in the library imports this subpackage.
"""
