"""Structured Streaming versions of the session fold and of message pruning."""
