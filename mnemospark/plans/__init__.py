"""Plans of the conversation memory engine."""
