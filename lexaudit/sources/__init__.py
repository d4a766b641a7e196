"""Readers, writers and row-level import checks."""
