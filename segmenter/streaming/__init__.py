"""Structured Streaming versions of the message-log operators."""
