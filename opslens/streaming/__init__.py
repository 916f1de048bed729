"""Structured Streaming flows that share the batch column expressions."""
