"""Readers for working trees, logs, archives and palettes."""
