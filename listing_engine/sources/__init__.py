"""Readers, writers and extraction from raw pages."""
