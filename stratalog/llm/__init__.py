"""Training-data operators: filters, deduplication, attribution, mixing and sharding.

Nothing outside this package imports it; each module works on plain DataFrames.
"""
