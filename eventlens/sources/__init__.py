"""Readers, normalizers and sinks. Payloads are read from landed files, never fetched."""
