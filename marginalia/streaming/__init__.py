"""Streaming upserts."""
