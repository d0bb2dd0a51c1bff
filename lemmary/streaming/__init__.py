"""Structured Streaming forms; an extension beyond the batch operators."""
