"""Training-data operators: scoring, fingerprints, filters, tokenising and packing.

Nothing else in the library imports this subpackage.
"""
