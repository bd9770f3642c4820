"""Readers, writers and edge extraction."""
