"""Incremental maintenance of fact tables by Structured Streaming."""
