"""Operators for preparing a text corpus; nothing else in the package imports them."""
