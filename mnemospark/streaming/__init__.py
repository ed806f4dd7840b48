"""Streaming of the conversation memory engine."""
