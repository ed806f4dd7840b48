"""Masks secrets and personal data, before anything else sees a text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ahead, let, word_ahead

_DASHES = "-" * 5
_NAME = "[0-9A-Za-z._-]*"
_PART = "[0-9A-Za-z_-]{8,}"
#: (pattern, replacement), applied in this order.
RULES: tuple[tuple[str, str], ...] = (
    (f"(?s){_DASHES}BEGIN[ A-Z]*PRIVATE KEY{_DASHES}.*?{_DASHES}END[ A-Z]*PRIVATE KEY{_DASHES}", "[REDACTED:private-key]"),
    (r"\bsk-(?:proj-)?[0-9A-Za-z_-]{20,}\b", "[REDACTED:api-key]"),
    (r"\bgh[oprsu]_[0-9A-Za-z]{20,}\b", "[REDACTED:github-token]"),
    (r"\bxox[abprs]-[0-9A-Za-z-]{10,}\b", "[REDACTED:slack-token]"),
    (r"\bAKIA[A-Z0-9]{16}\b", "[REDACTED:aws-key]"),
    (rf"\beyJ{_PART}\.{_PART}\.{_PART}\b", "[REDACTED:jwt]"),
    (r"(?i)\bbearer\s+[0-9A-Za-z._-]{16,}", "Bearer [REDACTED:token]"),
    (rf"(?i)\b({_NAME}(?:access[_-]?key|api[_-]?key|passwd|password|pwd|secret|token){_NAME})(\s*[=:]\s*)\S{{6,}}", "$1$2[REDACTED:secret]"),
    (r"(?i)\b(credential|passphrase|password|secret|token|ключ|креденшл|пароль|секрет|токен)\w*\s+([+/0-9A-Z_a-z-]{20,}={0,2})\b", "$1 [REDACTED:secret]"),
    (r"\b[%+.0-9A-Z_a-z-]+@[.0-9A-Za-z-]+[.][A-Za-z]{2,}\b", "[REDACTED:email]"),
)
#: What every match of a rule holds, by the rule's place: a plain search for it spares most texts the pattern.
HELD = {0: _DASHES + "BEGIN", 1: "sk-", 2: "gh", 3: "xox", 4: "AKIA", 5: "eyJ", 9: "@"}
#: Letters that the matches of a rule begin with, where that is a word.
_FIRST = {8: "cpst"}
#: How every match of a rule ends, which is found without going back over the names before it.
_ENDS = {7: ahead("kpst", rf"(?iU)(?:key|passwd|password|pwd|secret|token){_NAME}\s*[=:]\s*\S{{6,}}")}


def redact(text: Column) -> Column:
    """Ten passes over a text; each rule sees what the ones before it left."""

    def masked(x: Column, k: int) -> Column:
        pattern, by = RULES[k]
        pattern = word_ahead(_FIRST[k], "(?U)" + pattern) if k in _FIRST else "(?U)" + pattern
        if k in _ENDS:
            return let(x, lambda x: F.when(x.rlike(_ENDS[k]), F.regexp_replace(x, pattern, by)).otherwise(x))
        if k not in HELD:
            return F.regexp_replace(x, pattern, by)
        return let(x, lambda x: F.when(F.contains(x, F.lit(HELD[k])), F.regexp_replace(x, pattern, by)).otherwise(x))

    return reduce(masked, range(len(RULES)), text)
