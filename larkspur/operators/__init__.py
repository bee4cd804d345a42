"""Operators of the fluent API."""
