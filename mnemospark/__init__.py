"""Conversation memory on Spark: extraction, supersession, budgeted selection, recall and evaluation."""

__version__ = "0.1.0"
