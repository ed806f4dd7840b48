"""Operators of the conversation memory engine."""
