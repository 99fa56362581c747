"""Readers, writers and stage tables."""
