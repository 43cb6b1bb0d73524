"""Stateful operators as Structured Streaming queries."""
