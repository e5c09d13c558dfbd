"""Operators for text that trains language models. Nothing outside this package imports it."""
