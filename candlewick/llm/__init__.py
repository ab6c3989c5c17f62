"""Operators a training-data pipeline needs: dedup, fingerprints, scoring, filters, packing."""
