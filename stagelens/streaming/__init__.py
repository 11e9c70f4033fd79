"""Structured Streaming jobs over metric samples and landed applications."""
