"""Operators for building training corpora; nothing outside this package imports it."""
