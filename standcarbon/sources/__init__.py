"""Readers, writers and layer preparation."""
