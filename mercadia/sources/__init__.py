"""Readers and writers, and the adapter from the given tables to the canonical ones."""
