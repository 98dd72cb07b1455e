"""Readers, writers and storage encodings."""
