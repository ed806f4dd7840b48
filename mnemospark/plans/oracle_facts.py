"""Shallow grammar in DuckDB's SQL: sentences, what counts as a fact, triples, topics. The word lists are spelled out here, so that the
SQL doesn't follow a mistake in the engine's own."""

from __future__ import annotations

NL = "chr(10)"


def _list(text: str) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in text.split()) + "]"


ABBR = _list(
    """
    am approx co dept dr e.g est etc fig i.e inc jr ltd mr mrs ms no pm prof sr st vol vs
    """
)
AUX = _list(
    """
    'll 'm 're 's 've am are be been being ca did do does get gets got had has have is was were will wo
    """
)
VERBS = _list(
    """
    accept accepted adopt adopted applied apply ate attend attended began begin book booked bought build built buy buying buys call called change
    changed choose chose cook cooked decide decided drank drink drive driving drove earn earned eat enjoy enjoyed finish finished flew fly found
    founded graduate graduated grew grow growing hate hated hire hired join joined keep kept launch launched lead learn learned learnt leave led left
    like liked likes live lived lives living love loved loves made make making manage managed married marry meet met move moved moving name named need
    needed order ordered own owned owns paid pay pick picked plan planned planning play played playing prefer preferred prefers quit raise raised ran
    read reject rejected retire retired run running save saved sell sign signed sold spend spent start started starting stop stopped studied study
    studying switch switched take taking taught teach took train trained training travel traveled travelled use used visit visited volunteer
    volunteered want wanted work worked working works write wrote
    """
)
ORDERS = _list(
    """
    add adjust aim allow alternate apply ask avoid bake begin book breathe bring call check choose clean close combine consider consult contact cook
    cool disable discover do don't dont download drink eat enable end enjoy ensure explore find focus hold hydrate include incorporate increase
    install invest join keep let lie lift limit look make measure mix monitor note open opt pack pick place plan practice prepare pull push put reach
    read reduce register relax remember repeat replace rest review rotate run save schedule see select serve set share sign sit speak spend stand
    start stay store stretch swap take talk tell track try use visit walk warm wash wear write
    """
)
LEAD = _list(
    """
    a actually also an and but just so the then well
    """
)
OBJ = _list(
    """
    a about also an and any at been being but by for from her his in into it its just more my of on our quite really some that the their them these
    this those to very with your
    """
)
ONE = _list(
    """
    attend commute drive graduate live major marry move name own rent retire study weigh work
    """
)

_DAY = "friday|monday|saturday|sunday|thursday|tuesday|wednesday"
_MONTH = "april|august|december|february|january|july|june|march|may|november|october|september"
_ME = r"(?i)\b(?:i|i''d|i''ll|i''m|i''ve|im|mine|my|myself|our|ours|us|we|we''re|we''ve)\b"
_HEDGE = r"(?i)\b(?:assuming|consider|could|depending|depends|generally|hopefully|ideally|if|imagine|may|maybe|might|perhaps|possibly|probably|shall|should|suppose|typically|unless|usually\s+often|whether|wish|wondering|would)\b"
_OPEN = (
    r"(?i)^\s*(?:a\s+(?:couple|few)\s+(?:of\s+)?(?:ideas|options|tips)|absolutely|below\s+(?:are|is)|check\s+out|consider|feel\s+free|for\s+example|great\s+question|here\s+(?:are|is)"
    r"|i\s+(?:can|could|would)\s+(?:help|recommend|suggest)|in\s+general|it\s+(?:can|could|depends|helps|is|may|might|was|would)|it''s|let\s+me|let''s|make\s+sure|many\s+(?:options|people)"
    r"|of\s+course|one\s+(?:of|option|way)|remember\s+to|some\s+(?:ideas|options|people)|sure[!,]|that''s|there\s+(?:are|is|was|were)|this\s+(?:can|could|is|would)|try|you\s+(?:can|could|may|might|need|should|want|will))\b"
)
_ADVICE = r"(?i)\byou\s+(?:can|could|may|might|need\s+to|should|want\s+to|will)\b"
_CHAT = (
    r"(?i)\b(?:as\s+an\s+ai|don''t\s+hesitate|feel\s+free|glad\s+to|good\s+luck|great\s+question|happy\s+to\s+help|hope\s+(?:it|that|these|this|you)|i\s+(?:can|could)\s+help|i\s+(?:recommend|suggest)"
    r"|i''d\s+(?:recommend|suggest)|keep\s+in\s+mind|kudos|let''s|lets\s+get)\b"
)
_ITEM = r"^\s*(?:-|•|\*+|\d+[).])\s"
_BOLD = r"^\s*[*]{2}[^*]+[*]{2}\s*[-:]"
_HARD = (
    rf"(?i)\b(?:\d+|{_MONTH}|{_DAY}|tomorrow|tonight|yesterday)\b|\b(?:last|next|past|this)\s+(?:fall|month|night|semester|spring|summer|week|weekend|winter|year|{_DAY})\b"
    r"|\bin\s+(?:19|20)\d{2}\b|\bsince\s+\w|\w\s+ago\b"
)
# Without look-behind: a capital that neither begins the text nor follows the end of a sentence.
_PROPER = r"(?:[^.!?]\s|[^\w\s])[A-Z][A-Za-z]{2,}\b"
_ASKS = r"(?i)^\s*(?:any|are|can|could|did|do|does|has|have|how|is|please|should|was|were|what|when|where|which|who|whom|whose|why|would)\b|\b(?:can|could|did|do|have|will|would)\s+you\b|\bany\s+(?:ideas|recommendations|suggestions|tips)\b"
_SPLIT = r"\s*(?:[,;]|\b(?:and|but|so)\b)\s+"
_LATIN = "regexp_extract_all({0}, '[''0-9A-Za-z]+')"


def _is(x: str, pattern: str) -> str:
    """Whether x matches. Word borders are ASCII's here, so other letters are taken for one that is."""
    return f"regexp_matches(regexp_replace({x}, '[À-ÖØ-öø-ɏͰ-ϿЀ-ӿ]', 'x', 'g'), '{pattern}')"


def factual(x: str) -> str:
    me, hard = _is(x, _ME), f"({_is(x, _HARD)} OR regexp_matches({x}, '{_PROPER}'))"
    words = _LATIN.format(x)
    return (
        f"({x} <> '' AND NOT ends_with({x}, '?') AND len({words}) BETWEEN 4 AND 45 AND NOT {_is(x, _OPEN)} AND NOT {_is(x, _ADVICE)} AND NOT {_is(x, _CHAT)} AND NOT {_is(x, _BOLD)}"
        f" AND ({me} OR NOT {_is(x, _ITEM)}) AND (NOT {_is(x, _HEDGE)} OR ({me} AND {hard})) AND NOT list_contains({ORDERS}, lower(coalesce({words}[1], '')))"
        f" AND ({me} OR NOT instr({x}, ':') BETWEEN 1 AND 61) AND ({me} OR {hard}))"
    )


def sentences(source: str) -> str:
    """CTEs that end in `sent` (transcript_id, unit_idx, role, sent, sentence), from a table with text."""
    return f"""
piece0 AS (SELECT transcript_id, unit_idx, role, list_filter(list_transform(string_split(regexp_replace(replace(text, {NL}, ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> '') AS ps FROM {source}),
piece1 AS (SELECT transcript_id, unit_idx, role, generate_subscripts(ps, 1) AS k, unnest(ps) AS p FROM piece0),
piece2 AS (SELECT *, coalesce(list_contains({ABBR}, lag(lower(string_split(regexp_replace(p, '\\.+$', ''), ' ')[-1])) OVER (PARTITION BY transcript_id, unit_idx ORDER BY k)), false) AS glued FROM piece1),
piece3 AS (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY transcript_id, unit_idx ORDER BY k) AS s FROM piece2),
sent AS (SELECT transcript_id, unit_idx, role, CAST(s - 1 AS INTEGER) AS sent, string_agg(p, ' ' ORDER BY k) AS sentence FROM piece3 GROUP BY ALL)"""


def parts(x: str) -> str:
    """The list of assertions in a sentence."""
    clauses = f"list_filter(list_transform(string_split_regex(trim(regexp_replace({x}, '\\?+$', '')), '{_SPLIT}'), lambda p: trim(p)), lambda p: p <> '')"
    return f"(CASE WHEN NOT ends_with({x}, '?') THEN CASE WHEN {factual(x)} THEN [{x}] ELSE [] END WHEN len({clauses}) < 2 THEN [] ELSE list_filter({clauses}, lambda p: NOT {_is('p', _ASKS)} AND {factual('p')}) END)"


def _verbal(y: str) -> str:
    return (
        f"(list_contains({AUX}, {y}) OR list_contains({VERBS}, {y}) OR (ends_with({y}, 's') AND list_contains({VERBS}, regexp_replace({y}, 's$', ''))) OR (ends_with({y}, 'es') AND list_contains({VERBS}, regexp_replace({y}, 'es$', '')))"
        f" OR (length({y}) > 4 AND regexp_matches({y}, '^[a-z]+(?:ed|ing)$') AND NOT regexp_matches({y}, '(?:cies|ies|ings|ness|ous|ties)$')))"
    )


def _stem(n: int, double: bool) -> str:
    s = f"left(low, length(low) - {n})"
    if double:
        s = f"(CASE WHEN length({s}) >= 2 AND right({s}, 1) = substr({s}, length({s}) - 1, 1) THEN left({s}, length({s}) - 1) ELSE {s} END)"
    return f"CASE WHEN NOT list_contains({VERBS}, {s}) AND list_contains({VERBS}, {s} || 'e') THEN {s} || 'e' ELSE {s} END"


def _fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def slug(x: str) -> str:
    words = f"list_filter(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+(?:[#./_-][\\p{{L}}\\p{{N}}]+)*|[#./0-9A-Z_a-z-]+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))[1:6]"
    s = f"regexp_replace({_fold(f'array_to_string({words}, {chr(39)}-{chr(39)})')}, '^-+|-+$', '', 'g')"
    bare = _fold(f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))")
    return f"CASE WHEN {s} <> '' THEN {s} ELSE 'claim:' || substr(sha1({bare}), 1, 12) END"


def topics(source: str, x: str, out: str) -> str:
    """CTEs that end in `out`: source with `topic` of the triple in column x, NULL without a triple, and `slug`."""
    low = lambda c: f"list_transform({c}, lambda y: lower(y))"
    return f"""
{out}1 AS (SELECT *, {_LATIN.format(x)} AS w FROM {source}),
{out}2 AS (SELECT *, {low('w')} AS l, CAST(len(w) AS BIGINT) AS n FROM {out}1),
{out}3 AS (SELECT *, list_transform(l, lambda y: list_contains({AUX}, y)) AS a, list_transform(l, lambda y: {_verbal('y')}) AS v, coalesce(list_filter(range(0, n), lambda k: NOT list_contains({LEAD}, l[k + 1]))[1], n) AS s FROM {out}2),
{out}4 AS (SELECT *, list_filter(range(s + 1, least(n, s + 9)), lambda k: a[k + 1])[1] AS c, CASE WHEN NOT coalesce(s < n - 1 AND l[s + 1] NOT IN ('i', 'my', 'our', 'we') AND v[s + 1], false) THEN list_filter(range(s + 1, least(n - 1, s + 9)), lambda k: v[k + 1])[1] END AS f FROM {out}3),
{out}5 AS (SELECT *, coalesce(list_filter(range(c + 1, n), lambda k: NOT a[k + 1])[1], n) AS ce0, coalesce(list_filter(range(f + 1, n), lambda k: NOT a[k + 1])[1], n) AS fe0 FROM {out}4),
{out}6 AS (SELECT *, CASE WHEN ce0 < n AND v[ce0 + 1] THEN ce0 + 1 ELSE ce0 END AS ce, CASE WHEN fe0 < n AND v[fe0 + 1] THEN fe0 + 1 ELSE fe0 END AS fe FROM {out}5),
{out}7 AS (SELECT *, CASE WHEN c IS NOT NULL AND ce < n THEN c ELSE f END AS verb, CASE WHEN c IS NOT NULL AND ce < n THEN ce ELSE fe END AS fin FROM {out}6),
{out}8 AS (SELECT *, n >= 3 AND verb IS NOT NULL AS triple, list_filter(l[s + 1:verb], lambda y: NOT list_contains({LEAD}, y)) AS subj, l[verb + 1:fin] AS pred, list_filter(l[fin + 1:n], lambda y: NOT list_contains({OBJ}, y)) AS obj FROM {out}7),
{out}9 AS (SELECT *, coalesce(nullif(array_to_string(subj[greatest(len(subj) - 2, 1):], ' '), ''), 'speaker') AS who, regexp_replace(coalesce(list_filter(pred, lambda y: NOT list_contains({AUX}, y))[-1], pred[-1]), '^''+|''+$', '', 'g') AS low, coalesce(list_filter(obj, lambda y: length(y) > 2)[1], '') AS head FROM {out}8),
{out}10 AS (SELECT *, coalesce(CASE WHEN low IN ('am', 'are', 'be', 'been', 'being', 'is', 'was', 'were') THEN 'be' WHEN low IN ('had', 'has', 'have') THEN 'have' WHEN low IN ('did', 'do', 'does') THEN 'do'
  WHEN regexp_matches(low, '...ying$') THEN left(low, length(low) - 4) || 'y' WHEN regexp_matches(low, '...ing$') THEN {_stem(3, True)} WHEN regexp_matches(low, '...ied$') THEN {_stem(3, False)}
  WHEN regexp_matches(low, '...ed$') THEN {_stem(2, True)} WHEN regexp_matches(low, '...es$') THEN {_stem(2, False)} WHEN regexp_matches(low, '...s$') THEN {_stem(1, False)} ELSE low END, 'be') AS root FROM {out}9),
{out} AS (SELECT * EXCLUDE (w, l, n, a, v, s, c, f, ce0, fe0, ce, fe, verb, fin, triple, subj, pred, obj, who, low, head, root), CASE WHEN triple THEN who || '|' || root || CASE WHEN list_contains({ONE}, root) OR coalesce(regexp_matches(obj[1], '^[a-f0-9]{{7,40}}$|\\d'), false) OR head = '' THEN '' ELSE '|' || head END END AS topic, {slug(x)} AS slug FROM {out}10)"""


#: From `ov` to `fact` (transcript_id, unit_idx, k, text, topic): unmarked facts and anchors that stay.
FACTS = f"""{sentences("(SELECT * FROM ov WHERE role = 'assistant')").strip()},
part0 AS (SELECT transcript_id, unit_idx, sent, {parts('sentence')} AS ps FROM sent WHERE NOT regexp_matches(sentence, '\\[C:\\s*\\d{{1,3}}\\s*%[^\\]]*\\]')),
part1 AS (SELECT transcript_id, unit_idx, sent, generate_subscripts(ps, 1) - 1 AS part, unnest(ps) AS text FROM part0),{topics('part1', 'text', 'stat')},
norm1 AS (SELECT transcript_id, unit_idx, sent * 1000 + part AS k, text, topic, trim(regexp_replace({_fold('text')}, '\\s+', ' ', 'g')) AS key FROM stat WHERE topic IS NOT NULL),
full1 AS (SELECT DISTINCT transcript_id, unit_idx FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, key ORDER BY unit_idx, k) AS rn FROM norm1) WHERE rn = 1),
open1 AS (SELECT transcript_id, unit_idx, substr(arg_min(sentence, sent), 1, 220) AS text FROM sent WHERE len({_LATIN.format('sentence')}) >= 4 AND NOT {_is('sentence', _ITEM)} GROUP BY ALL),
open2 AS (SELECT o.* FROM open1 o JOIN ov USING (transcript_id, unit_idx) WHERE length(ov.text) >= 200 AND NOT EXISTS (SELECT 1 FROM full1 f WHERE f.transcript_id = o.transcript_id AND f.unit_idx = o.unit_idx)),
both1 AS (SELECT * FROM norm1 UNION ALL SELECT transcript_id, unit_idx, 1000000000 AS k, text, 'context|' || coalesce(list_filter({_LATIN.format('lower(text)')}, lambda y: NOT list_contains({OBJ}, y) AND length(y) > 2)[1], 'turn') AS topic, trim(regexp_replace({_fold('text')}, '\\s+', ' ', 'g')) AS key FROM open2),
fact AS (SELECT transcript_id, unit_idx, k, text, topic FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, key ORDER BY unit_idx, k) AS rn FROM both1) WHERE rn = 1)"""
