"""Structured Streaming over immutable chunk files of logs."""
