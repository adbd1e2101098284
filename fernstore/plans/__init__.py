"""Immutable query descriptions and the fluent API that builds them."""
