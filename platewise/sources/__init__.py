"""Readers, writers and table validation."""
