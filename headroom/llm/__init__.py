"""Operators for large text corpora; nothing else in the package uses them."""
