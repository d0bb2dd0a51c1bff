"""Readers, writers and injected model calls."""
