"""Predicates by cue words: corrections, decisions, lessons, live state; and what identifies a thing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import CORRECTION_STOPS, RECALL_STOPS
from .text import SPACE, ahead, alternatives, casefold, let, member, search_tokens, word_ahead

CORRECTION = (
    word_ahead("cdnorstw", r"(?iU)\b" + alternatives("corrected correction disproved disproven no_longer_holds not_true overturn(?:ed)? refutation refute[sd]? retract(?:ed|ion)? scratch_that supersede[sd]? turns_out was_wrong were_wrong").replace(r"\s+", " ") + r"\b")
    + "|" + ahead("", r"(?iU)" + alternatives("беру_свои_слова была_не_права исправл(?:ение|яю) на_самом_деле не_подтвердилось неверно неправильно оказалось_не опроверг отмен(?:ено|яю) ошиб(?:ка|ки|лась|ся) поправк снимаю ты_прав уточн(?:ение|яю)").replace(r"\s+", " "))
)
DECISION = word_ahead(
    "acdglwu",
    r"(?iU)\b" + alternatives("approved chose decided decision going_with locked will_use").replace(r"\s+", " ") + r"\b"
    r"|\b" + alternatives("вывод договорились принято выбра(?:л|ла|ли|но) реш(?:ени[ея]|ено|ил|ила|или)") + r"\b"
    r"|\buse\s.+\snot\s+.",
)
_RULE_END = alternatives("always from_now_on going_forward in_future never next_time").replace(r"\s+", " ")
LESSON_RULE = word_ahead("lstw", r"(?iU)\b(?:lesson|so|therefore|which means)\b[^\n!.?]{0,40}?\b" + _RULE_END + r"\b")
LESSON_LABEL = (
    r"(?imU)^\s*(?:[*-]\s*)?(?:[A-Z][0-9A-Z]{0,15}[ -])?LESSON(?:\s+LEARNED)?(?:\s*\[[^\n\]]{0,60}\])?"
    r"(?:\s*[(][^\n)]{0,60}[)])?\s*[:\-—]\s*(.+?)\s*$"
)
STATE_WORD = word_ahead("cds", r"(?iU)\b(?:currently|deployed|still)\b|\b(?:все ещё|всё ещё)\b|\b(?:развернут|развёрнут)\w*")
STATE_NOUN = word_ahead("bclprtv", r"(?iU)(?:\b(?:branch|commit|current|latest|port|release|tag|version)\b|\b(?:верси|ветк|коммит|порт|релиз|текущ)\w*)")
STATE_VALUE = word_ahead("0-9a-f", r"(?U)\b\d{3,6}\b|\b[a-f0-9]{7,40}\b|\b\d+(?:[.]\d+){1,2}\b")
INTENT = (
    r"(?iU)^\s*(?:да\b,?\s+)?" + alternatives("i_will let_me please запусти запущу изучи изучу начни начну проведи проверь проверю сделай сделаю").replace(r"\s+", " ") + r"\b"
)
WINDOW = 40
ENTITY = ahead("#0-9a-z", r"(?U)\b(?:#\d+|[A-Z]+-\d+|[a-f0-9]{7,40})\b")
NUMBER = word_ahead("0-9", r"(?U)\b\d+(?:[,.]\d+)?%?\b")


def is_correction(line: Column) -> Column:
    return line.rlike(CORRECTION)


def is_decision(text: Column) -> Column:
    return text.rlike(DECISION)


def signature(text: Column) -> Column:
    """Ids and numbers of a line, distinct."""
    return F.array_union(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def long_words(text: Column) -> Column:
    """Folded words of four characters or more that aren't stop words, in order, with repeats."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)[\wЀ-ӿ]{4,}"), F.lit(0)), casefold)
    return F.filter(words, lambda w: ~member(CORRECTION_STOPS, w))


def refutes(correction: Column, claim: Column) -> Column:
    """Shared id or number, or two shared long words."""
    return F.arrays_overlap(signature(correction), signature(claim)) | (F.size(F.array_intersect(long_words(correction), long_words(claim))) >= 2)


def correction_topic(line: Column, external: Column) -> Column:
    """A topic for each corrected thing."""
    base = F.when(external, "retraction:external").otherwise("retraction")
    marks = F.slice(F.array_sort(signature(line)), 1, 3)
    marks = F.when(F.size(marks) > 0, marks).otherwise(F.slice(long_words(line), 1, 4))
    return F.when(F.size(marks) > 0, F.concat(base, F.lit(":"), F.array_join(marks, "-"))).otherwise(base)


def live_state(text: Column) -> Column:
    """Whether a text says something that is true now and may stop being so.

    A noun of state counts only with a value within 40 characters: the window is cut first, then searched,
    so a value that the cut changes counts as what is left of it.
    """

    def near_value(x: Column) -> Column:
        # Where the k-th noun begins: after the pieces and nouns before it.
        begins = F.transform(F.sequence(F.lit(1), F.size(x["nouns"])), lambda k: F.aggregate(F.slice(x["pieces"], 1, k), F.lit(0), lambda a, p: a + F.length(p)) + F.aggregate(F.slice(x["nouns"], 1, k - 1), F.lit(0), lambda a, n: a + F.length(n)))
        around = F.transform(
            F.arrays_zip(begins.alias("b"), x["nouns"].alias("n")),
            lambda x: F.substring(text, F.greatest(x["b"] - WINDOW, F.lit(0)) + 1, x["b"] + F.length(x["n"]) + WINDOW - F.greatest(x["b"] - WINDOW, F.lit(0))),
        )
        return F.when(F.size(x["nouns"]) > 0, F.exists(around, lambda w: w.rlike(STATE_VALUE))).otherwise(False)

    cut = F.struct(F.split(text, STATE_NOUN).alias("pieces"), F.regexp_extract_all(text, F.lit(STATE_NOUN), F.lit(0)).alias("nouns"))
    valued = text.rlike(STATE_NOUN) & let(cut, near_value)
    return F.coalesce(~text.rlike(INTENT) & (text.rlike(STATE_WORD) | valued), F.lit(False))


def content_terms(text: Column, stops: tuple[str, ...] = RECALL_STOPS) -> Column:
    """Six-character prefixes of the words that name what a text is about, distinct."""
    words = F.filter(search_tokens(text), lambda t: (F.length(t) >= 4) & ~member(stops, t))
    return F.array_distinct(F.transform(words, lambda t: F.substring(t, 1, 6)))


def bare_line(line: Column) -> Column:
    """A line without list marks at its ends."""
    return F.regexp_replace(line, r"^[ \t*-]+|[ \t*-]+$", "")


def lesson_bodies(text: Column, least: int = 25, most: int = 500) -> Column:
    """Labelled lessons of a text; if it has none, its lines that state a rule for next time."""
    fits = lambda x: F.length(x).between(least, most)
    labelled = F.filter(F.transform(F.regexp_extract_all(text, F.lit(LESSON_LABEL), F.lit(1)), lambda x: F.regexp_replace(x, rf"(?U)^{SPACE}+|{SPACE}+$", "")), fits)
    ruled = F.filter(F.transform(F.split(text, "\n"), bare_line), lambda x: fits(x) & x.rlike(LESSON_RULE))
    return F.when(F.size(labelled) > 0, labelled).otherwise(ruled)
