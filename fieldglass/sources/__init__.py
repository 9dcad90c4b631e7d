"""Feeds, payloads and sinks."""
