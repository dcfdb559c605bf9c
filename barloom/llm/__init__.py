"""Operators for preparing text corpora; nothing else in the library depends on this package."""
