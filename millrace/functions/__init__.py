"""Aggregates and functions that go beyond the built-in ones."""
