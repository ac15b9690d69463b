"""Readers, strict JSON, digests and sinks."""
