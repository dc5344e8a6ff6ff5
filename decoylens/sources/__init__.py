"""Readers, writers and schema work."""
