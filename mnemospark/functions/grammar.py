"""Shallow English grammar as expressions: sentences, factual statements, triples and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import ABBREVIATIONS, AUXILIARIES, IMPERATIVES, LEADING_STOPS, OBJECT_STOPS, ONE_VALUE, VERBS
from .text import LATIN_WORD, SPACE, alternatives, casefold, latin_words, let, member, strip, word_ahead


def _any(words: str, before: str = r"(?iU)\b", after: str = r"\b") -> str:
    return word_ahead("".join(sorted({w[0] for w in words.split()})), before + alternatives(words) + after)


_DAYS = "friday|monday|saturday|sunday|thursday|tuesday|wednesday"
_MONTHS = "april|august|december|february|january|july|june|march|may|november|october|september"
PERSONAL = _any("i i'd i'll i'm i've im mine my myself our ours us we we're we've")
HEDGED = _any("assuming consider could depending depends generally hopefully ideally if imagine may maybe might perhaps possibly probably shall should suppose typically unless usually_often whether wish wondering would")
OPENER = (
    r"(?iU)^\s*(?:"
    r"a\s+(?:couple|few)\s+(?:of\s+)?(?:ideas|options|tips)|absolutely|below\s+(?:are|is)|check\s+out|consider|feel\s+free|for\s+example"
    r"|great\s+question|here\s+(?:are|is)|i\s+(?:can|could|would)\s+(?:help|recommend|suggest)|in\s+general"
    r"|it\s+(?:can|could|depends|helps|is|may|might|was|would)|it's|let\s+me|let's|make\s+sure|many\s+(?:options|people)"
    r"|of\s+course|one\s+(?:of|option|way)|remember\s+to|some\s+(?:ideas|options|people)|sure[!,]|that's"
    r"|there\s+(?:are|is|was|were)|this\s+(?:can|could|is|would)|try|you\s+(?:can|could|may|might|need|should|want|will))\b"
)
ADVICE = r"(?iU)\byou\s+(?:can|could|may|might|need\s+to|should|want\s+to|will)\b"
REGISTER = word_ahead(
    "adfghikl",
    r"(?iU)\b(?:as\s+an\s+ai|don't\s+hesitate|feel\s+free|glad\s+to|good\s+luck|great\s+question|happy\s+to\s+help"
    r"|hope\s+(?:it|that|these|this|you)|i\s+(?:can|could)\s+help|i\s+(?:recommend|suggest)|i'd\s+(?:recommend|suggest)"
    r"|keep\s+in\s+mind|kudos|let's|lets\s+get)\b",
)
LIST_ITEM = r"(?U)^\s*(?:-|•|\*+|\d+[).])\s"
BOLD_HEAD = r"(?U)^\s*[*]{2}[^*]+[*]{2}\s*[-:]"
CONCRETE = word_ahead(
    "0-9adfijlmnopstwy",
    rf"(?iU)\b(?:\d+|{_MONTHS}|{_DAYS}|tomorrow|tonight|yesterday)\b"
    rf"|\b(?:last|next|past|this)\s+(?:fall|month|night|semester|spring|summer|week|weekend|winter|year|{_DAYS})\b"
    r"|\bin\s+(?:19|20)\d{2}\b|\bsince\s+\w",
)
AGO = r"(?iU)\w\s+ago\b"
PROPER = r"(?<![!.?]\s)(?<!^)\b[A-Z][A-Za-z]{2,}\b"
#: One search for what any of these four begins with or is; most sentences have none.
SOME = r"(?=[0-9A-Zadfijlmnopstwy\x80-\x{10ffff}])(?<![0-9A-Z_a-z])(?:[A-Z][A-Za-z]{2}|(?iU)ago\b|" + PERSONAL + "|" + CONCRETE + ")"
QUESTION = (
    r"(?iU)^\s*" + alternatives("any are can could did do does has have how is please should was were what when where which who whom whose why would") + r"\b"
    r"|\b(?:can|could|did|do|have|will|would)\s+you\b|\bany\s+(?:ideas|recommendations|suggestions|tips)\b"
)
CLAUSE = r"(?U)\s*(?:[,;]|\b(?:and|but|so)\b)\s+"
LEAST_WORDS, MOST_WORDS = 4, 45
NAME = r"(?U)\b(?:[A-Z][A-Za-z]{1,}(?:-[0-9A-Z][0-9A-Za-z]*)?|[A-Z]{2,}[-0-9A-Za-z]*)\b"


def sentences(text: Column) -> Column:
    """Sentences of a text; a split that came after an abbreviation is undone."""
    pieces = F.filter(F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"(?U)(?<=[.!?])\s+"), strip), lambda p: p != "")
    tail = lambda s: F.lower(F.element_at(F.split(F.regexp_replace(s, r"\.+$", ""), " "), -1))

    def fold(done: Column, piece: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.lit(" "), piece)))
        return F.when(F.size(done) == 0, F.array(piece)).when(member(ABBREVIATIONS, tail(last)), joined).otherwise(F.concat(done, F.array(piece)))

    return F.aggregate(pieces, F.array().cast("array<string>"), fold)


def is_factual(sentence: Column) -> Column:
    """Whether a person asserted something, rather than discussed, asked or advised."""
    colon = F.instr(sentence, ":")
    plain = (
        F.size(latin_words(sentence)).between(LEAST_WORDS, MOST_WORDS)
        & ~sentence.rlike(OPENER)
        & ~sentence.rlike(ADVICE)
        & ~sentence.rlike(REGISTER)
        & ~sentence.rlike(BOLD_HEAD)
    )
    concrete = sentence.rlike(PROPER) | sentence.rlike(CONCRETE) | sentence.rlike("[Aa][Gg][Oo]") & sentence.rlike(AGO)
    first = F.lower(F.regexp_extract(sentence, LATIN_WORD, 0))

    def asserted(said: Column) -> Column:
        personal, concrete = said["personal"], said["concrete"]
        return (
            (personal | concrete)
            & (personal | ~colon.between(1, 61))
            & (personal | ~sentence.rlike(LIST_ITEM))
            & plain
            & ~member(IMPERATIVES, first)
            & (personal & concrete | ~sentence.rlike(HEDGED))
        )

    # What few sentences have goes first.
    return (sentence != "") & ~sentence.endswith("?") & sentence.rlike(SOME) & let(F.struct(sentence.rlike(PERSONAL).alias("personal"), concrete.alias("concrete")), asserted)


def factual_parts(sentence: Column) -> Column:
    """The assertions in a sentence; of a question, the clauses that state something."""
    asked = sentence.endswith("?")
    body = strip(F.regexp_replace(sentence, r"\?+$", ""))
    clauses = F.filter(F.transform(F.split(body, CLAUSE), strip), lambda p: p != "")
    parts = F.when(~asked, F.array(sentence)).when(F.size(clauses) < 2, F.array().cast("array<string>")).otherwise(clauses)
    return F.filter(parts, lambda p: ~(asked & p.rlike(QUESTION)) & is_factual(p))


def is_verbal(word: Column) -> Column:
    """Of a word in lower case: an auxiliary, a known verb or its third person, or shaped like a past or -ing form."""
    shaped = (F.length(word) > 4) & word.rlike("^[a-z]+(?:ed|ing)$") & ~word.rlike("(?:cies|ies|ings|ness|ous|ties)$")
    third = word.endswith("s") & member(VERBS, F.regexp_replace(word, "s$", "")) | word.endswith("es") & member(VERBS, F.regexp_replace(word, "es$", ""))
    return member(AUXILIARIES, word) | member(VERBS, word) | third | shaped


def verb_root(word: Column) -> Column:
    """A stem that is the same for the tenses of a verb."""
    known = lambda s: member(VERBS, s)

    def stem(low: Column, n: int, undouble: bool) -> Column:
        s = F.substring(low, F.lit(1), F.length(low) - n)
        if undouble:
            s = F.regexp_replace(s, r"^(.*)(.)\2$", "$1$2")
        return let(s, lambda s: F.when(~known(s) & known(F.concat(s, F.lit("e"))), F.concat(s, F.lit("e"))).otherwise(s))

    def root(low: Column) -> Column:
        out = F.when(low.isin("am", "are", "be", "been", "being", "is", "was", "were"), "be").when(low.isin("had", "has", "have"), "have").when(low.isin("did", "do", "does"), "do")
        out = out.when(low.rlike("...ying$"), F.concat(F.substring(low, F.lit(1), F.length(low) - 4), F.lit("y")))
        for end, n, undouble in (("ing", 3, True), ("ied", 3, False), ("ed", 2, True), ("es", 2, False), ("s", 1, False)):
            out = out.when(low.rlike(f"...{end}$"), stem(low, n, undouble))
        return out.otherwise(low)

    return let(F.regexp_replace(F.lower(word), "^'+|'+$", ""), root)


def _first(low: Column, high: Column, test) -> Column:
    """The first index in [low, high) that passes, or NULL; indices from 0."""
    # sequence() counts down when its end is below its begin; there the range is empty.
    return F.when(low < high, F.get(F.filter(F.sequence(low, high - 1), test), 0))


def with_triple(rows: DataFrame, text: str, out: str = "triple") -> DataFrame:
    """Adds subject, predicate and object of a sentence (arrays of words), split at its finite verb, or NULL.

    A copula near the begin settles it; else the first verb does, unless the sentence opens with one
    and so commands.
    """
    at = lambda array, k: F.get(F.col(array), k)
    n = F.size("_w")
    rows = rows.withColumn("_w", latin_words(F.col(text))).withColumn("_l", F.transform("_w", F.lower))
    rows = rows.withColumn("_a", F.transform("_l", lambda w: member(AUXILIARIES, w))).withColumn("_v", F.transform("_l", is_verbal))
    rows = rows.withColumn("_s", F.coalesce(_first(F.lit(0), n, lambda k: ~member(LEADING_STOPS, at("_l", k))), n))
    rows = rows.withColumn("_c", _first(F.col("_s") + 1, F.least(n, F.col("_s") + 9), lambda k: at("_a", k)))
    commands = (F.col("_s") < n - 1) & ~at("_l", F.col("_s")).isin("i", "my", "our", "we") & at("_v", F.col("_s"))
    rows = rows.withColumn("_f", F.when(~F.coalesce(commands, F.lit(False)), _first(F.col("_s") + 1, F.least(n - 1, F.col("_s") + 9), lambda k: at("_v", k))))
    for verb, end in (("_c", "_ce"), ("_f", "_fe")):
        chain = F.coalesce(_first(F.col(verb) + 1, n, lambda k: ~at("_a", k)), n)
        rows = rows.withColumn(end, chain).withColumn(end, F.when((F.col(end) < n) & at("_v", F.col(end)), F.col(end) + 1).otherwise(F.col(end)))
    copula = F.col("_c").isNotNull() & (F.col("_ce") < n)
    verb = F.when(copula, F.col("_c")).otherwise(F.col("_f"))
    end = F.when(copula, F.col("_ce")).otherwise(F.col("_fe"))
    part = lambda a, b: F.slice("_w", a + 1, b - a)
    rows = rows.withColumn(out, F.when((n >= 3) & verb.isNotNull(), F.struct(part(F.col("_s"), verb).alias("subject"), part(verb, end).alias("predicate"), part(end, n).alias("object"))))
    return rows.drop("_w", "_l", "_a", "_v", "_s", "_c", "_f", "_ce", "_fe")


def object_head(words: Column) -> Column:
    """The first content word, or an empty string."""
    return F.coalesce(F.get(F.filter(F.transform(words, F.lower), lambda w: ~member(OBJECT_STOPS, w) & (F.length(w) > 2)), 0), F.lit(""))


def states_value(words: Column) -> Column:
    """Whether the first word that isn't a stop word has a digit or looks like a hash."""
    first = F.get(F.filter(F.transform(words, F.lower), lambda w: ~member(OBJECT_STOPS, w)), 0)
    return F.coalesce(first.rlike(r"^[a-f0-9]{7,40}$|\d"), F.lit(False))


def triple_topic(triple: Column) -> Column:
    """A key that stays the same when a statement is made again with another value or tense."""
    low = lambda a: F.transform(a, F.lower)
    subject = let(F.filter(low(triple["subject"]), lambda w: ~member(LEADING_STOPS, w)), lambda s: F.slice(s, F.greatest(F.size(s) - 2, F.lit(1)), 3))
    subject = let(subject, lambda s: F.when(F.size(s) > 0, F.array_join(s, " ")).otherwise("speaker"))
    content = F.filter(low(triple["predicate"]), lambda w: ~member(AUXILIARIES, w))
    last = F.coalesce(F.try_element_at(content, F.lit(-1)), F.try_element_at(low(triple["predicate"]), F.lit(-1)))
    parts = F.struct(subject.alias("subject"), F.coalesce(verb_root(last), F.lit("be")).alias("root"), object_head(triple["object"]).alias("head"))

    def joined(x: Column) -> Column:
        bare = F.concat(x["subject"], F.lit("|"), x["root"])
        return F.when(x["root"].isin(*ONE_VALUE) | states_value(triple["object"]) | (x["head"] == ""), bare).otherwise(F.concat(bare, F.lit("|"), x["head"]))

    return let(parts, joined)


def slug_topic(text: Column) -> Column:
    """The first six words, or a hash where a text has none."""
    words = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:[#./_-][\p{L}\p{N}]+)*|[#./0-9A-Z_a-z-]+"), F.lit(0))
    words = F.slice(F.filter(words, lambda w: w.rlike(r"[\p{L}\p{N}]")), 1, 6)
    slug = F.regexp_replace(casefold(F.array_join(words, "-")), "^-+|-+$", "")
    digest = F.substring(F.sha1(F.encode(casefold(strip(F.regexp_replace(text, rf"(?U){SPACE}+", " "))), "utf-8")), 1, 12)
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("claim:"), digest))
