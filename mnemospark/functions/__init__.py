"""Functions of the conversation memory engine."""
