"""Structured Streaming jobs over inbound mail and send events."""
