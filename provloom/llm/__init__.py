"""Training-data operators: mixing, tokenising, near-dedup, sharding, filters, fingerprints, scans, scoring.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""
