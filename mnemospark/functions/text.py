"""Text expressions: normal forms, content ids, token lists, set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it: Unicode's and the four information separators.
SPACE = r"[\s\x1c-\x1f]"
LATIN_WORD = "['0-9A-Za-z]+"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body names it; the planner would write it out each time."""
    return F.get(F.transform(F.array(value), body), 0)


_REST = r"\x80-\x{10ffff}"


def ahead(first: str, pattern: str) -> str:
    """The same pattern, tried only at characters that a match can begin with: those of a class, in either case, and all beyond ASCII.

    For patterns whose borders, flags and alternatives take longer than looking ahead; a bare class or word is faster without.
    """
    return f"(?=[{first.lower()}{first.upper()}{_REST}])(?:{pattern})"


def word_ahead(first: str, pattern: str) -> str:
    """ahead() of a pattern whose matches begin with a word: not inside of one, either."""
    return f"(?=[{first.lower()}{first.upper()}{_REST}])(?<![0-9A-Z_a-z])(?:{pattern})"


def casefold(text: Column) -> Column:
    """Lower case, with the folds that lower() lacks and that occur in European text."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def strip(text: Column) -> Column:
    # Most texts have nothing to strip, which their ends tell without a search through all of them.
    ends = lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))
    return let(text, lambda x: F.when(ends(x).rlike(rf"(?U){SPACE}"), F.regexp_replace(x, rf"(?U)^{SPACE}+|{SPACE}+$", "")).otherwise(x))


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank; none stays at the ends."""
    return strip(F.regexp_replace(text, rf"(?U) {SPACE}+|(?! ){SPACE}+", " "))


def normalized(text: Column) -> Column:
    """The form used for ids and for finding repeats, never for what is stored. Input is taken to be NFC."""
    return squeeze(casefold(text))


def content_id(source: Column | str, middle: Column, text: Column) -> Column:
    """16 hex digits that depend on who said it, the topic or kind, and the normal form."""
    source = F.lit(source) if isinstance(source, str) else source
    return F.substring(F.sha1(F.encode(F.concat(source, F.lit("|"), middle, F.lit("|"), normalized(text)), "utf-8")), 1, 16)


def search_tokens(text: Column) -> Column:
    """Runs of letters and digits of any script, folded."""
    return F.regexp_extract_all(casefold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LATIN_WORD), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    """Distinct ASCII words of the normal form, for scoring."""
    return F.array_distinct(F.regexp_extract_all(normalized(text), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct members; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def member(words, word: Column) -> Column:
    """Whether a word (without blanks) is one of a list. One literal keeps plans small, where an array would be a node a word."""
    return F.find_in_set(word, F.lit(",".join(words))) > 0


def alternatives(words: str) -> str:
    """A regular expression for any of the words; a blank stands for white space."""
    return "(?:" + "|".join(w.replace("_", r"\s+") for w in words.split()) + ")"


def cut(text: Column, most: int) -> Column:
    """At most so many characters, with an ellipsis where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), rf"(?U){SPACE}+$", ""), F.lit("…"))).otherwise(text)


def script_share(text: Column, letters: str = r"\p{IsCyrillic}") -> Column:
    """Share of one script among word characters; NULL without any."""
    total = F.regexp_count(text, F.lit(r"(?U)\w"))
    return F.when(total > 0, F.regexp_count(text, F.lit(letters)) / total)


MONTHS = "MMMM"


def date_tokens(stamp: Column, mode: str = "full") -> Column:
    """Year, month name and weekday of the first date in a stamp, as search tokens; mode: full, month or off."""
    if mode not in ("full", "month"):
        return F.array().cast("array<string>")
    iso = F.regexp_extract(stamp, r"\d{4}[/-]\d{2}[/-]\d{2}", 0)
    year, month = F.substring(iso, 1, 4), F.substring(iso, 6, 2)
    day = F.try_to_date(F.replace(iso, F.lit("/"), F.lit("-")), "yyyy-MM-dd")
    first = F.try_to_date(F.concat(F.lit("2000-"), month, F.lit("-01")), "yyyy-MM-dd")
    name = F.lower(F.date_format(first, MONTHS))
    parts = [name] if mode == "month" else [F.when(iso != "", year), name, F.lower(F.date_format(day, "EEEE"))]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())
