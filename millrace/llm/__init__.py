"""Operators for language-model data. Nothing outside this package imports it."""
