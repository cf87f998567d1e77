"""Readers, writers and the views over the supplied tables."""
