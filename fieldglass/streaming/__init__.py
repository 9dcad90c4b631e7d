"""Keyed change capture, batch and streaming."""
