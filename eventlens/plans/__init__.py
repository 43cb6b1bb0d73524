"""Whole queries built from operators."""
