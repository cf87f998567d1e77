"""Operators for large text corpora; nothing else in the package imports this folder."""
