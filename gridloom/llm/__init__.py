"""Operators for large text and embedding corpora; nothing else in the package imports this one."""
