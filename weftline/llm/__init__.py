"""Training-data operators: search, fingerprints, joins, scans, packing, mixing and dedup.

Nothing else in the package imports this subpackage.
"""
