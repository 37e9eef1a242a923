"""Readers of provider fixtures, catalogues and stored logs."""
