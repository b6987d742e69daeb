"""Readers, writers, keyed merges and the clinical views over the test tables."""
