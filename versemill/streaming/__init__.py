"""Structured Streaming twins of the batch event operators."""
