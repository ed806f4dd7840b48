"""Sources of the conversation memory engine."""
