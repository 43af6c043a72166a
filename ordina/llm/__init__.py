"""Training-data operators: token counts, licences, dedup, mixing, extraction, quality, packing.

Nothing else in the package imports this subpackage.
"""
