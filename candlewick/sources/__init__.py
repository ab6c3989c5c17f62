"""Readers, writers and the analysis views built on the base tables."""
