"""Structured Streaming: histories that grow batch by batch."""
