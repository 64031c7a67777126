"""Incremental copies with Structured Streaming."""
