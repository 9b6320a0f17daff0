"""Readers, writers and adapters that turn tables into units and tokens."""
