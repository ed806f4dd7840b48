"""Constants that queries and their SQL share."""

from __future__ import annotations

SEARCHES = {"a": "worthless pathetic thereou", "b": "license the terms of", "c": "êaux lére worthless worthless"}
HOOK_PROMPTS = SEARCHES
TASKS = {"budget": 900, "rendered": 1500, "created": "2024-05-01T00:00:00Z"}
THRESHOLD = 30.0
#: Live state in RE2, which knows no look-around: good where a text is short or has no value outside the window.
_NOUN = "(?i)(?:\\b(?:branch|commit|current|latest|port|release|tag|version)\\b|(?:^|[^\\p{{L}}])(?:верси|ветк|коммит|порт|релиз|текущ))"
_VALUE = "(?:\\b\\d+\\.\\d+(?:\\.\\d+)?\\b|\\b[0-9a-f]{{7,40}}\\b|\\b\\d{{3,6}}\\b)"
LIVE = "(NOT regexp_matches({0}, '(?i)^\\s*(?:i will|let me|please)\\b') AND (regexp_matches({0}, '(?i)\\b(?:currently|still|deployed)\\b') OR (regexp_matches({0}, '" + _NOUN + "') AND regexp_matches({0}, '" + _VALUE + "'))))"
