"""Readers, normalisers, upserts and sinks."""
