"""Keyed operators over DataFrames: series, patterns, text, models."""
