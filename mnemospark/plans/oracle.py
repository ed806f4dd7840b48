"""The same queries in DuckDB's SQL, written from the rules and not from the plans."""

from __future__ import annotations

from ..operators.budget import MARKERS
from .oracle_facts import FACTS, factual, parts, sentences, topics
from .overlay import SQL as RAW
from .settings import HOOK_PROMPTS, LIVE, SEARCHES, TASKS, THRESHOLD

# Word lists, boosts and masks are spelled out here, so that the SQL doesn't follow a mistake in the engine's own.
CORRECTION_STOPS = "about after been before could from have should that their there this what when which with would было быть когда потому того тоже чтобы этом этот".split()
QUESTION_STOPS = """
a am an and are at be been did do does for had has have how i in is it me my of on or s t that the this to was were what when where which who whom
whose why with you
""".split()
RECALL_STOPS = """
about again all also and any are be been being but can could did do does done for from give had has have here how into is its just know made make many
may might more most much must need not now only our over please shall should show some take tell that the their then there these think this those
under use used using very want was were what when where which who whom whose why will with would your был была были быть взять где давай дай дальше
дать делать думаю есть зачем знаешь знаю использовать как какая какие какого какое какой каком когда которая которые который кто ладно можно надо
нужно очень поехали пожалуйста покажи показать почему привет сделай сделать сейчас спасибо та там те теперь тот тут хорошо хочешь хочу чего чему что
эта эти это этот
""".split()
KIND_BOOST = {"path": 0.85, "id": 0.9, "decision": 1.0, "claim": 1.0, "lesson": 1.4}
#: What is masked: private keys, tokens of known shapes, assignments and mentions of secrets, mail addresses.
MASKS = (
    (r"(?s)-{5}BEGIN[ A-Z]*PRIVATE KEY-{5}.*?-{5}END[ A-Z]*PRIVATE KEY-{5}", "[REDACTED:private-key]"),
    (r"\bsk-(?:proj-)?[\w-]{20,}\b", "[REDACTED:api-key]"),
    (r"\bgh[oprsu]_[A-Za-z\d]{20,}\b", "[REDACTED:github-token]"),
    (r"\bxox[abprs]-[A-Za-z\d-]{10,}\b", "[REDACTED:slack-token]"),
    (r"\bAKIA[A-Z\d]{16}\b", "[REDACTED:aws-key]"),
    (r"\beyJ(?:[\w-]{8,}\.){2}[\w-]{8,}\b", "[REDACTED:jwt]"),
    (r"(?i)\bbearer\s+[\w.-]{16,}", "Bearer [REDACTED:token]"),
    (r"(?i)\b([\w.-]*(?:api[_-]?key|access[_-]?key|secret|token|password|passwd|pwd)[\w.-]*)(\s*[:=]\s*)\S{6,}", r"\1\2[REDACTED:secret]"),
    (r"(?i)\b(password|passphrase|secret|token|credential|пароль|токен|ключ|секрет|креденшл)\w*\s+([\w+/-]{20,}={0,2})\b", r"\1 [REDACTED:secret]"),
    (r"\b[\w.%+-]+@[A-Za-z\d.-]+\.[A-Za-z]{2,}\b", "[REDACTED:email]"),
)

NL = "chr(10)"


def _fold(x: str) -> str:
    return f"replace(replace(lower({x}), 'ß', 'ss'), 'ς', 'σ')"


def _norm(x: str) -> str:
    return f"trim(regexp_replace({_fold(x)}, '\\s+', ' ', 'g'))"


def _id(source: str, middle: str, text: str) -> str:
    return f"substr(sha1('{source}|' || {middle} || '|' || {_norm(text)}), 1, 16)"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _redact(x: str) -> str:
    for pattern, to in MASKS:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


OV = f"{RAW}, ov AS (SELECT transcript_id, unit_idx, role, {_redact('text')} AS text FROM raw)"
MARK = "\\[C:\\s*(\\d{1,3})\\s*%[^\\]]*\\]"

CAL = f"""
marks AS (SELECT transcript_id, unit_idx, text AS span, string_split_regex(text, '{MARK.replace("(", "(?:", 1)}') AS gaps, regexp_extract_all(text, '{MARK}', 1) AS pcts FROM ov WHERE role = 'assistant'),
stated AS (SELECT transcript_id, unit_idx, k, span, pcts[k] AS pct, list_filter(string_split(gaps[k], {NL}), lambda x: trim(x) <> '')[-1] AS line FROM marks, unnest(range(1, len(pcts) + 1)) AS t(k)),
cal AS (SELECT transcript_id, unit_idx, CAST(k - 1 AS INTEGER) AS k, text, least(CAST(pct AS INTEGER), 100) / 100.0::DOUBLE AS confidence, lower(regexp_extract(text, '^The (.*) is ', 1)) || '|be' AS topic
  FROM (SELECT *, regexp_replace(trim(line), '^.*[.!?…]\\s+', '') AS text FROM stated))"""

RET = f"""
lined AS (SELECT transcript_id, unit_idx, role, generate_subscripts(string_split(text, {NL}), 1) AS k, unnest(string_split(text, {NL})) AS line FROM ov WHERE role IN ('assistant', 'user')),
retl AS (SELECT transcript_id, unit_idx, k, trim(line) AS text, role <> 'assistant' AS external FROM lined WHERE length(trim(line)) BETWEEN 24 AND 360 AND regexp_matches(line, '(?i)\\b(corrected|correction|disproved|disproven|no longer holds|not true|overturn(ed)?|refutation|refute[sd]?|retract(ed|ion)?|scratch that|supersede[sd]?|turns out|was wrong|were wrong)\\b|(?:исправл(?:ение|яю)|поправк|отмен(?:ено|яю)|неверно|неправильно)')),
ret AS (SELECT transcript_id, unit_idx, CAST(k - 1 AS INTEGER) AS k, text, CASE WHEN external THEN 'retraction:external:' ELSE 'retraction:' END || array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b\\d+(?:[.,]\\d+)?%?\\b')))[1:3], '-') AS topic
  FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, {_norm("text")} ORDER BY unit_idx, k) AS rn FROM retl) WHERE rn = 1)"""

LES = f"""
les AS (SELECT transcript_id, unit_idx, 0 AS k, text, 'lesson:' || substr({_fold("text")}, 1, 40) AS topic FROM (
  SELECT transcript_id, unit_idx, body AS text, row_number() OVER (PARTITION BY transcript_id, {_fold("body")} ORDER BY unit_idx) AS rn
  FROM (SELECT transcript_id, unit_idx, coalesce(nullif(regexp_extract(text, '(?m)^LESSON: (.+)$', 1), ''), regexp_extract(text, '(?m)^(So next time .+)$', 1)) AS body FROM ov WHERE role = 'assistant') WHERE length(body) BETWEEN 25 AND 500) WHERE rn = 1)"""

FLOOR = f"""
pathm AS (SELECT transcript_id, unit_idx, generate_subscripts(m, 1) AS k, unnest(m) AS raw FROM (SELECT transcript_id, unit_idx, regexp_extract_all(text, '(?:^|[^\\w])([.~]?/[%+,./0-9:=@A-Z_a-z~-]+)', 1) AS m FROM ov WHERE role = 'assistant')),
path0 AS (SELECT transcript_id, unit_idx, k, rtrim(raw, '.,;:') AS text FROM pathm WHERE contains(trim(raw, '/'), '/')),
paths AS (SELECT transcript_id, unit_idx, k, text FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, {_norm("text")} ORDER BY unit_idx, k) AS rn FROM path0) WHERE rn = 1),
idm AS (SELECT transcript_id, unit_idx, family, generate_subscripts(m, 1) AS k, unnest(m) AS raw FROM (SELECT transcript_id, unit_idx, family, regexp_extract_all(text, pattern) AS m FROM ov, (VALUES (1, '\\b[0-9A-Fa-f]{{8}}-(?:[0-9A-Fa-f]{{4}}-){{3}}[0-9A-Fa-f]{{12}}\\b'), (2, '\\b[0-9a-fA-F]{{7,40}}\\b'), (3, '(?i)#\\d+\\b|\\bobs\\s+#\\d+\\b')) AS f(family, pattern) WHERE role = 'assistant')),
id0 AS (SELECT * FROM idm i WHERE NOT regexp_full_match(raw, '\\d+') AND NOT EXISTS (SELECT 1 FROM paths p WHERE p.transcript_id = i.transcript_id AND p.unit_idx <= i.unit_idx AND contains(p.text, i.raw))),
ids AS (SELECT transcript_id, unit_idx, family, k, raw AS text FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, {_norm("raw")} ORDER BY unit_idx, family, k) AS rn FROM id0) WHERE rn = 1),
decs AS (SELECT transcript_id, unit_idx, text FROM (SELECT transcript_id, unit_idx, rtrim(trim(text), '.,;:') AS text, row_number() OVER (PARTITION BY transcript_id, {_norm("rtrim(trim(text), '.,;:')")} ORDER BY unit_idx) AS rn FROM ov WHERE role = 'assistant' AND regexp_matches(text, '(?i)\\b(approved|chose|decided|decision|going with|locked|will use)\\b|\\buse\\s.+\\snot\\s+.')) WHERE rn = 1)"""

#: All claims, with ids and places.
CLAIMS = f"""{OV}, {CAL.strip()}, {RET.strip()}, {LES.strip()}, {FACTS},
claim0 AS (
  SELECT transcript_id, 0 AS rank, unit_idx, k, text, CAST(NULL AS DOUBLE) AS confidence, topic, 'retraction' AS harvester, {_id("retraction", "topic", "text")} AS id FROM ret
  UNION ALL SELECT transcript_id, 1, unit_idx, k, text, NULL, topic, 'atomic', {_id("atomic", "topic", "text")} FROM fact
  UNION ALL SELECT transcript_id, 2, unit_idx, k, text, confidence, topic, 'calibration', {_id("calibration", "topic", "text")} FROM cal
  UNION ALL SELECT transcript_id, 4, unit_idx, k, text, NULL, topic, 'lessons', {_id("lessons", "topic", "text")} FROM les),
claim1 AS (SELECT *, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY rank, unit_idx, k) - 1 AS INTEGER) AS pos FROM claim0)"""

_SIG = "list_distinct(list_concat(regexp_extract_all({0}, '\\b(?:[0-9a-f]{{7,40}}|[A-Z]+-\\d+|#\\d+)\\b'), regexp_extract_all({0}, '\\b\\d+(?:[.,]\\d+)?%?\\b')))"
_TOK = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[\\w\\p{{L}}\\p{{N}}]{{4,}}')), lambda w: NOT list_contains(" + _list(CORRECTION_STOPS).replace("{", "{{").replace("}", "}}") + ", w))"

LINKS = f"""{CLAIMS},
link AS (SELECT r.transcript_id, r.pos AS r_pos, r.id AS r_id, c.pos AS c_pos, c.id AS c_id FROM claim1 r JOIN claim1 c ON r.transcript_id = c.transcript_id AND r.harvester = 'retraction' AND c.harvester <> 'retraction'
  AND (len(list_intersect({_SIG.format("r.text")}, {_SIG.format("c.text")})) > 0 OR len(list_intersect({_TOK.format("r.text")}, {_TOK.format("c.text")})) >= 2)),
win AS (SELECT transcript_id, c_pos, c_id, arg_min(r_id, r_pos) AS r_id, min(r_pos) AS r_pos FROM link GROUP BY ALL),
up AS (SELECT transcript_id, r_pos, arg_min(c_id, c_pos) AS c_id FROM win GROUP BY ALL),
claim2 AS (SELECT c.*, w.r_id AS superseded_by, u.c_id AS supersedes FROM claim1 c LEFT JOIN win w ON w.transcript_id = c.transcript_id AND w.c_pos = c.pos LEFT JOIN up u ON u.transcript_id = c.transcript_id AND u.r_pos = c.pos)"""


def _resolved(source: str, out: str, group: str = "transcript_id") -> str:
    return f"""
{out}_last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {group}, id ORDER BY pos DESC) AS rn FROM {source}) WHERE rn = 1),
{out}_win AS (SELECT *, last_value(id) OVER w AS newest, lag(id) OVER (PARTITION BY {group}, topic ORDER BY pos) AS before, list(id) OVER w AS own FROM {out}_last
  WINDOW w AS (PARTITION BY {group}, topic ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
{out} AS (SELECT * EXCLUDE (newest, before, own, superseded_by, supersedes, pos), CAST(row_number() OVER (PARTITION BY {group} ORDER BY pos) - 1 AS INTEGER) AS pos,
  CASE WHEN id <> newest THEN newest WHEN list_contains(own, superseded_by) THEN NULL ELSE superseded_by END AS superseded_by, CASE WHEN id = newest AND before IS NOT NULL THEN before ELSE supersedes END AS supersedes FROM {out}_win)"""


RESOLVED = f"{LINKS}, {_resolved('claim2', 'claim').strip()}"

ITEMS = f"""{RESOLVED}, {FLOOR.strip()},
supp AS (SELECT transcript_id, kind, text, id, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY unit_idx, family, k) - 1 AS INTEGER) AS pos FROM (
  SELECT transcript_id, unit_idx, 0 AS family, k, 'path' AS kind, text, {_id("regex_floor", "'path'", "text")} AS id FROM paths
  UNION ALL SELECT transcript_id, unit_idx, family, k, 'id', text, {_id("regex_floor", "'id'", "text")} FROM ids
  UNION ALL SELECT transcript_id, unit_idx, 4, 0, 'decision', text, {_id("regex_floor", "'decision'", "text")} FROM decs)),
item0 AS (SELECT transcript_id, 'claim' AS bucket, text, confidence, topic, CAST(NULL AS VARCHAR) AS kind, harvester, id, superseded_by, pos FROM claim
  UNION ALL SELECT transcript_id, 'supplement', text, NULL, NULL, kind, 'regex_floor', id, NULL, pos FROM supp)"""


def _scored(source: str, out: str) -> str:
    return f"""
{out}_n AS (SELECT *, count(*) OVER (PARTITION BY transcript_id, bucket) AS n FROM {source}),
{out}_s AS (SELECT *, CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE pos / (n - 1)::DOUBLE END AS recent FROM {out}_n),
{out} AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY round(score, 12) DESC, bucket, pos) AS priority FROM (SELECT * EXCLUDE (n, recent), CASE WHEN bucket = 'claim' THEN
  (0.5::DOUBLE + 0.3::DOUBLE * coalesce(confidence, 0.5) + 0.2::DOUBLE * recent) * (CASE WHEN starts_with(topic, 'retraction') THEN 2.0 WHEN harvester = 'atomic' AND confidence IS NULL THEN 0.75 ELSE 1.0 END)::DOUBLE * (CASE WHEN superseded_by IS NULL THEN 1.0 ELSE 0.35 END)::DOUBLE
  ELSE 0.6::DOUBLE * (CASE kind WHEN 'decision' THEN 1.0 WHEN 'id' THEN 0.8 ELSE 0.7 END)::DOUBLE * (0.5::DOUBLE + 0.2::DOUBLE * recent + 0.3::DOUBLE) END AS score FROM {out}_s))"""


SCORED = f"{ITEMS}, {_scored('item0', 'item1').strip()}"

def _greedy(source: str, budget: int, out: str) -> str:
    """kept, by priority: what fits is taken, what doesn't is passed over."""
    return f"""
{out} AS (SELECT *, length(text) + 1 <= {budget} AS kept, CASE WHEN length(text) + 1 <= {budget} THEN length(text) + 1 ELSE 0 END AS used FROM {source} WHERE priority = 1
  UNION ALL SELECT i.*, f.used + length(i.text) + 1 <= {budget}, f.used + CASE WHEN f.used + length(i.text) + 1 <= {budget} THEN length(i.text) + 1 ELSE 0 END FROM {out} f JOIN {source} i ON i.transcript_id = f.transcript_id AND i.priority = f.priority + 1)"""


GREEDY = f"RECURSIVE {SCORED}, {_greedy('item1', TASKS['budget'], 'fold').strip()}"

_LINE = f"""CASE WHEN section IN (1, 3) THEN '- [' || CASE WHEN confidence IS NULL THEN 'unknown' ELSE printf('%.2f', confidence) END || CASE WHEN {LIVE.format("text")} THEN ' · VERIFY CURRENT' ELSE '' END || '] ' || text || ' (topic: ' || topic || '; id: ' || id || ')'
  || CASE WHEN section = 3 THEN ' [superseded by: ' || superseded_by || ']' ELSE '' END ELSE '- ' || text END"""
_SECTION = "CASE WHEN bucket = 'supplement' THEN CASE kind WHEN 'id' THEN 4 WHEN 'path' THEN 5 ELSE 6 END WHEN starts_with(topic, 'lesson:') THEN 2 WHEN superseded_by IS NOT NULL THEN 3 ELSE 1 END"
_HEAD = f"'# Brief' || {NL} || {NL} || 'recorded {TASKS['created']} (claims are as of this time unless a line says otherwise)' || {NL} || {NL}"



def _fit(source: str, tail: int, out: str) -> str:
    """`out`: lines with the length of all up to each, rendered."""
    # '## Claims' (10 with its break), '- None' (7) and a blank line, less the last blank line.
    return f"""
{out}_sect AS (SELECT *, {_SECTION} AS section FROM {source}),
{out}_lines AS (SELECT *, {_LINE} AS line, row_number() OVER (PARTITION BY transcript_id, section ORDER BY priority) AS fs, row_number() OVER (PARTITION BY transcript_id, CASE WHEN section >= 4 THEN 4 ELSE section END ORDER BY priority) AS fa FROM {out}_sect),
{out}_cost AS (SELECT *, length(line) + 1 + CASE WHEN fs > 1 THEN 0 ELSE CASE section WHEN 1 THEN -7 WHEN 2 THEN 12 WHEN 3 THEN 22 WHEN 4 THEN 7 WHEN 5 THEN 9 ELSE 13 END END + CASE WHEN fa = 1 AND section >= 4 THEN 15 ELSE 0 END AS c FROM {out}_lines),
{out} AS (SELECT *, length({_HEAD}) + 17 + {tail} + sum(c) OVER (PARTITION BY transcript_id ORDER BY priority ROWS UNBOUNDED PRECEDING) AS rendered FROM {out}_cost)"""


FIT = f"{SCORED}, {_fit('item1', 0, 'fit').strip()}"


def _part(section: int, head: str, order: str) -> str:
    return f"coalesce('{head}' || {NL} || string_agg(line, {NL} ORDER BY {order}) FILTER (section = {section}) || {NL} || {NL}, '')"


_BY = "-coalesce(confidence, 1.0), topic, id"


def _rendered(lines: str, tail: str = "''") -> str:
    """transcript_id, rendered; every transcript has a brief."""
    return f"""SELECT transcript_id, regexp_replace({_HEAD} || coalesce('## Claims' || {NL} || string_agg(line, {NL} ORDER BY {_BY}) FILTER (section = 1) || {NL} || {NL}, '## Claims' || {NL} || '- None' || {NL} || {NL}) || {_part(2, '## Lessons', 'pos')} || {_part(3, '## Superseded Claims', _BY)}
  || CASE WHEN count(*) FILTER (section >= 4) > 0 THEN '## Supplement' || {NL} || coalesce('### id' || {NL} || string_agg(line, {NL} ORDER BY pos) FILTER (section = 4) || {NL}, '') || coalesce('### path' || {NL} || string_agg(line, {NL} ORDER BY pos) FILTER (section = 5) || {NL}, '')
  || coalesce('### decision' || {NL} || string_agg(line, {NL} ORDER BY pos) FILTER (section = 6) || {NL}, '') ELSE '' END, '\\s+$', '') || {NL} || {tail} AS rendered FROM (SELECT DISTINCT transcript_id FROM ov) LEFT JOIN {lines} USING (transcript_id) GROUP BY transcript_id"""


RENDERED = f"{FIT} {_rendered('fit')}"
_TAIL = f"({NL} || '" + MARKERS.replace("\n", f"' || {NL} || '") + f"' || {NL})"
PAYLOAD = f"""{SCORED}, {_fit('item1', len(MARKERS) + 2, 'fit').strip()}, ok AS (SELECT * FROM fit WHERE rendered <= 3000), r AS ({_rendered('ok', _TAIL)})
SELECT transcript_id, CAST(to_json({{'hookSpecificOutput': {{'hookEventName': 'SessionStart', 'additionalContext': rendered}}}}) AS VARCHAR) AS payload FROM r"""
#: Two cuts: by score, then as rendered, with places and scores taken anew in between.
BRIEFS = f"""RECURSIVE {SCORED}, {_greedy('item1', 12000, 'fold').strip()},
again AS (SELECT * EXCLUDE (kept, used, score, priority, pos), row_number() OVER (PARTITION BY transcript_id, bucket ORDER BY pos) - 1 AS pos FROM fold WHERE kept), {_scored('again', 'item2').strip()}, {_fit('item2', 0, 'fit').strip()},
ok AS (SELECT * FROM fit WHERE rendered <= 12000) {_rendered('ok')}"""

_WORDS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+')"
_QUERIES = "queries AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SEARCHES.items()) + ") AS t(query_id, query))"
_TERMS = f"terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_WORDS.format(_fold('query'))}) AS term FROM queries) GROUP BY ALL)"


def _bm25(docs: str, key: str, out: str) -> str:
    """Scores of groups; docs has key and tokens."""
    return f"""
{out}_len AS (SELECT {key}, sum(len(tokens)) AS length FROM {docs} GROUP BY ALL),
{out}_shape AS (SELECT count(*) AS total, avg(length) AS mean FROM {out}_len),
{out}_hit AS (SELECT {key}, term, count(*) AS freq FROM (SELECT {key}, unnest(tokens) AS term FROM {docs}) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
{out}_df AS (SELECT term, count(*) AS n FROM {out}_hit GROUP BY ALL),
{out} AS (SELECT query_id, {key}, sum(times * ln(1 + (total - n + 0.5) / (n + 0.5)) * (freq * 2.5) / (freq + 1.5 * (0.25 + 0.75 * greatest(length, 1) / mean))) AS raw
  FROM terms JOIN {out}_df USING (term) JOIN {out}_hit USING (term) JOIN {out}_len USING ({key}) CROSS JOIN {out}_shape GROUP BY ALL)"""


_DOCS = f"docs AS (SELECT doc_id, source, text, {_WORDS.format(_fold('text'))} AS tokens FROM documents)"
_BOOST = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in KIND_BOOST.items()) + " ELSE 1.0 END"


def _top(source: str, n: int, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM {source}) WHERE rank <= {n}"


_FULL = f"""{_QUERIES}, {_TERMS},
docs AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, CASE doc_id % 3 WHEN 0 THEN 'claim' WHEN 1 THEN 'lesson' ELSE 'decision' END AS kind, source, text, doc_id % 7 = 0 AS superseded, '2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') AS ts, {_WORDS.format(_fold('text'))} AS tokens FROM documents),
rec AS (SELECT id, (row_number() OVER (ORDER BY ts, id) - 1) / nullif(count(*) OVER () - 1, 0)::DOUBLE AS recency FROM docs),{_bm25("docs", "id", "own")},{_bm25("docs", "source", "par")},
found AS (SELECT coalesce(o.query_id, p.query_id) AS query_id, coalesce(o.id, p.id) AS id, coalesce(o.raw, 0) + coalesce(p.raw, 0) AS raw FROM own o FULL JOIN (SELECT query_id, d.id, par.raw FROM par JOIN docs d USING (source)) p ON o.query_id = p.query_id AND o.id = p.id),
res AS (SELECT query_id, id, round(raw * {_BOOST} * (CASE WHEN superseded THEN 0.4 ELSE 1.0 END) * (1 + 0.25 * recency), 4) AS score, round(raw, 4) AS bm25, text, ts, superseded FROM found JOIN docs USING (id) JOIN rec USING (id))"""

_HOOK_TERMS = f"list_distinct(list_transform(list_filter({_WORDS}, lambda t: length(t) >= 4 AND NOT list_contains({_list(RECALL_STOPS)}, t)), lambda t: substr(t, 1, 6)))".replace("{{", "{").replace("}}", "}")


def _hook_terms(x: str) -> str:
    return _HOOK_TERMS.replace("{0}", _fold(x))


_PTOK = "list_distinct(regexp_extract_all({0}, '[a-z0-9]+'))"

_PROBES = f"""
said AS (SELECT text FROM ov WHERE role = 'assistant'), pline AS (SELECT unnest(string_split(text, {NL})) AS line FROM said),
pp AS (SELECT 'path' AS family, regexp_replace(unnest(regexp_extract_all(text, '(?:^|[^\\w.])(/(?:[0-9A-Za-z._-]+/)+[0-9A-Za-z._-]+)', 1)), '[.,;:)]+$', '') AS text FROM said),
ph AS (SELECT 'hash' AS family, unnest(list_filter(regexp_extract_all(text, '\\b[a-f0-9]{{7,40}}\\b'), lambda h: regexp_matches(h, '\\d') AND regexp_matches(h, '[a-f]'))) AS text FROM said),
plain AS (SELECT line FROM pline WHERE NOT regexp_matches(line, '\\[C:\\s*\\d{{1,3}}\\s*%[^\\]]*\\]') AND NOT regexp_matches(line, '(?:^|[^\\w.])/(?:[0-9A-Za-z._-]+/)+[0-9A-Za-z._-]+') AND len(list_filter(regexp_extract_all(line, '\\b[a-f0-9]{{7,40}}\\b'), lambda h: regexp_matches(h, '\\d') AND regexp_matches(h, '[a-f]'))) = 0),
pn AS (SELECT unnest(regexp_extract_all(line, '\\b(\\d[,.\\d]{{0,12}})\\s+([A-Za-zЀ-ӿ]{{4,20}})', 1)) AS number, unnest(regexp_extract_all(line, '\\b(\\d[,.\\d]{{0,12}})\\s+([A-Za-zЀ-ӿ]{{4,20}})', 2)) AS word FROM plain),
pf AS (SELECT 'fact' AS family, regexp_replace(number, '[.,]+$', '') || ' ' || lower(word) AS text FROM pn WHERE length(regexp_replace(number, '[.,]+$', '')) >= 2 AND lower(word) NOT IN ('and', 'for', 'that', 'the', 'with')),
pc AS (SELECT 'claim' AS family, min(t) AS text, CAST(length(min(t)) AS BIGINT) AS n FROM (SELECT regexp_replace(regexp_replace(line, '\\[C:\\s*\\d{{1,3}}\\s*%[^\\]]*\\]', '', 'g'), '^[ \\t•*—-]+|[ \\t•*—-]+$', '', 'g') AS t FROM pline WHERE regexp_matches(line, '\\[C:\\s*\\d{{1,3}}\\s*%[^\\]]*\\]')) WHERE length(t) BETWEEN 25 AND 400 GROUP BY {_norm('t')}),
pall AS (SELECT family, text, count(*) AS n FROM (SELECT * FROM pp WHERE length(text) >= 12 UNION ALL SELECT * FROM ph UNION ALL SELECT * FROM pf) GROUP BY ALL UNION ALL SELECT * FROM pc),
probes AS (SELECT family, text, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, text) AS rank FROM pall) WHERE rank <= CASE family WHEN 'hash' THEN 10 ELSE 15 END)"""

SQL: dict[str, str] = {
    "transcript_scan": "SELECT conv_id AS transcript_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS unit_idx, CASE WHEN (conv_id + turn) % 5 = 4 THEN 'assistant' ELSE role END AS role, text FROM conversations WHERE text <> ''",
    "scan_quality": "SELECT conv_id AS transcript_id, 2 * count(*) AS total, count(*) AS skipped, count(*) FILTER (text <> '') AS usable, count(*) FILTER (text <> '' AND (role = 'assistant' OR (conv_id + turn) % 5 = 4)) AS by_assistant, CASE WHEN count(*) FILTER (text <> '') > 0 AND count(*) FILTER (text <> '' AND (role = 'assistant' OR (conv_id + turn) % 5 = 4)) = 0 THEN 'no assistant rows' ELSE 'some rows skipped' END AS problem FROM conversations GROUP BY conv_id",
    "redact_documents": f"SELECT doc_id, {_redact('text')} AS text FROM documents",
    "redact_conversations": f"WITH {OV} SELECT * FROM ov",
    "normalized_text_ids": f"SELECT doc_id, {_norm('text')} AS norm, {_id('documents', 'lang', 'text')} AS id FROM documents",
    "tokens_per_document": f"SELECT doc_id, len({_WORDS.format(_fold('text'))}) AS n_tokens, len(list_distinct({_WORDS.format(_fold('text'))})) AS n_distinct FROM documents",
    "date_tokens": "SELECT event_id, [CAST(year(ts) AS VARCHAR), lower(monthname(ts)), lower(dayname(ts))] AS tokens FROM events",
    "script_share": "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^a-zA-Z0-9_\\p{L}\\p{N}]', '', 'g')) > 0 THEN round(length(regexp_replace(text, '[^äöüÄÖÜß]', '', 'g')) / length(regexp_replace(text, '[^a-zA-Z0-9_\\p{L}\\p{N}]', '', 'g'))::DOUBLE, 6) END AS share FROM documents",
    "calibration_claims": f"WITH {OV}, {CAL.strip()} SELECT transcript_id, unit_idx, k, text, confidence, topic, {_id('calibration', 'topic', 'text')} AS id FROM cal",
    "floor_paths": f"WITH {OV}, {FLOOR.strip()} SELECT transcript_id, unit_idx, text FROM paths",
    "floor_ids": f"WITH {OV}, {FLOOR.strip()} SELECT transcript_id, unit_idx, text FROM ids",
    "floor_decisions": f"WITH {OV}, {FLOOR.strip()} SELECT transcript_id, unit_idx, text FROM decs",
    "retraction_lines": f"WITH {OV}, {RET.strip()} SELECT transcript_id, unit_idx, text, topic FROM ret",
    "lesson_lines": f"WITH {OV}, {LES.strip()} SELECT transcript_id, unit_idx, text, topic FROM les",
    "harvested_claims": f"WITH {CLAIMS} SELECT transcript_id, pos, id, text, confidence, topic, harvester FROM claim1",
    "retraction_links": f"WITH {LINKS} SELECT transcript_id, pos, id, superseded_by, supersedes FROM claim2 WHERE superseded_by IS NOT NULL OR supersedes IS NOT NULL",
    "supersede_by_topic": f"WITH {RESOLVED} SELECT transcript_id, pos, id, text, topic, superseded_by, supersedes FROM claim",
    "active_claims": f"WITH {RESOLVED} SELECT transcript_id, id, text FROM claim WHERE superseded_by IS NULL",
    "supersede_orders": f"WITH src AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS pos, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS topic, CAST(NULL AS VARCHAR) AS superseded_by, CAST(NULL AS VARCHAR) AS supersedes FROM orders), {_resolved('src', 'res', 'o_custkey').strip()} SELECT o_custkey, pos, id, topic, superseded_by, supersedes FROM res",
    "cross_conv_settle": f"""WITH {ITEMS}, s0 AS (SELECT 0 AS bucket, transcript_id, pos, text, CASE WHEN starts_with(topic, 'lesson:') THEN 'lesson' ELSE 'claim' END AS kind, id, CASE WHEN NOT starts_with(topic, 'lesson:') AND contains(topic, '|') THEN topic END AS settle FROM claim1
    UNION ALL SELECT 1, transcript_id, pos, text, kind, id, NULL FROM supp),
  s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY bucket, id ORDER BY transcript_id, pos) = 1)
  SELECT id, text, kind, settle IS NOT NULL AND row_number() OVER (PARTITION BY settle ORDER BY transcript_id DESC, pos DESC) > 1 AS superseded, lpad(CAST(transcript_id AS VARCHAR), 9, '0') AS source FROM s1""",
    "claim_scores": f"WITH {SCORED} SELECT transcript_id, bucket, pos, id, round(score, 9) AS score, CAST(priority AS INTEGER) AS priority FROM item1",
    "greedy_budget": f"WITH {GREEDY} SELECT transcript_id, CAST(priority AS INTEGER) AS priority, id, bucket FROM fold WHERE kept",
    "budget_report": f"WITH {GREEDY} SELECT transcript_id, count(*) FILTER (bucket = 'claim') AS harvested_claims, count(*) FILTER (bucket = 'supplement') AS harvested_supplement, CAST(coalesce(sum(length(text) + 1) FILTER (kept), 0) AS BIGINT) AS used_chars, count(*) FILTER (kept AND bucket = 'claim') AS kept_claims, count(*) FILTER (kept AND bucket = 'supplement') AS kept_supplement, count(*) FILTER (NOT kept) AS dropped_items, CAST({TASKS['budget']} AS INTEGER) AS budget_chars FROM fold GROUP BY transcript_id",
    "rendered_fit": f"WITH {FIT} SELECT transcript_id, CAST(priority AS INTEGER) AS priority, id, CAST(rendered AS BIGINT) AS rendered FROM fit WHERE rendered <= {TASKS['rendered']}",
    "rendered_brief": f"WITH {RENDERED}",
    "live_state_flags": f"WITH {OV}, l AS (SELECT transcript_id, unit_idx, generate_subscripts(string_split(text, {NL}), 1) AS k, unnest(string_split(text, {NL})) AS line FROM ov) SELECT transcript_id, unit_idx, CAST(k - 1 AS INTEGER) AS k, {LIVE.format('line')} AS live FROM l",
    "bm25_documents": f"WITH {_QUERIES}, {_TERMS}, {_DOCS},{_bm25('docs', 'doc_id', 'own')}, r AS (SELECT query_id, doc_id AS id, round(raw, 4) AS score FROM own) {_top('r', 20, 'query_id, id, score, rank')}",
    "bm25_parent": f"WITH {_QUERIES}, {_TERMS}, {_DOCS},{_bm25('docs', 'source', 'par')} SELECT query_id, source AS parent, round(raw, 4) AS context FROM par",
    "recall_boosted": f"WITH {_FULL} {_top('res', 20, 'query_id, rank, id, score, bm25')}",
    "recall_hook_filter": f"""WITH {_FULL}, prompts AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in HOOK_PROMPTS.items())}) AS t(query_id, prompt)), best AS ({_top('res', 24, '*')}),
  flat AS (SELECT b.*, p.prompt, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM best b JOIN prompts p USING (query_id) WHERE NOT superseded AND length(trim(prompt)) >= 3),
  asked AS (SELECT *, {_hook_terms('prompt')} AS a, {_hook_terms('flat')} AS h FROM flat),
  ok AS (SELECT *, row_number() OVER (PARTITION BY query_id, substr({_fold('flat')}, 1, 120) ORDER BY rank) AS again FROM asked WHERE CASE WHEN len(a) = 0 THEN false WHEN len(a) <= 2 THEN len(list_intersect(a, h)) = len(a) ELSE len(list_intersect(a, h)) >= 2 AND len(list_intersect(a, h)) / len(a)::DOUBLE >= 0.5 END),
  few AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS n, CASE WHEN length(flat) > 200 THEN rtrim(substr(flat, 1, 200)) || '…' ELSE flat END AS short FROM ok WHERE again = 1) WHERE n <= 3),
  marked AS (SELECT *, '- [' || ts || CASE WHEN {LIVE.format('short')} THEN ' · VERIFY CURRENT' ELSE '' END || '] ' AS prefix FROM few),
  over AS (SELECT *, coalesce(sum(length(short)) OVER (PARTITION BY query_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(prefix) + length(short) > 600 AS o FROM marked)
  SELECT query_id, n AS rank, id, prefix || short AS line FROM (SELECT *, bool_or(o) OVER (PARTITION BY query_id ORDER BY n) AS ended FROM over) WHERE NOT ended""",
    "recency_rank": "SELECT CAST(event_id AS VARCHAR) AS id, round((row_number() OVER (ORDER BY ts, event_id) - 1) / nullif(count(*) OVER () - 1, 0)::DOUBLE, 9) AS recency FROM events",
    "stats_summary": f"""WITH {RESOLVED}, b AS (SELECT transcript_id, '2024-01-' || lpad(CAST(1 + transcript_id % 28 AS VARCHAR), 2, '0') AS created FROM ov GROUP BY transcript_id)
  SELECT (SELECT count(*) FROM b) AS briefs, (SELECT min(created) FROM b) AS first_brief_utc, (SELECT max(created) FROM b) AS last_brief_utc, CAST(NULL AS BIGINT) AS harvested_claims, CAST(NULL AS BIGINT) AS dropped_items, count(*) AS claims_total, CAST(sum(length(text)) AS BIGINT) AS claim_chars_total,
  count(*) FILTER (harvester = 'retraction') AS retractions, count(*) AS labelled_claims, count(superseded_by) AS superseded, count(confidence) AS marked_claims, round(avg(confidence), 3) AS mean_confidence, round(count(confidence) / count(*)::DOUBLE, 3) AS marked_share,
  round(count(*) / (SELECT count(*) FROM b)::DOUBLE, 1) AS claims_per_brief, false AS budget_measurable, true AS retractions_measurable, CAST(NULL AS BIGINT) AS lessons_total FROM claim""",
    "stats_by_harvester": f"WITH {RESOLVED}, o AS (SELECT harvester, count(*) AS n, min(transcript_id * 1000000 + pos) AS first FROM claim GROUP BY ALL) SELECT harvester AS value, n, CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS rank FROM o",
    "stats_top_topics": f"WITH {RESOLVED}, o AS (SELECT topic, count(*) AS n, min(transcript_id * 1000000 + pos) AS first FROM claim GROUP BY ALL) SELECT topic AS value, n, CAST(row_number() OVER (ORDER BY n DESC, first) AS INTEGER) AS rank FROM o QUALIFY rank <= 10",
    "probe_retention": f"""WITH p AS (SELECT item_id AS id, {_norm('text')} AS norm, {_PTOK.format(_norm('text'))} AS t FROM benchmark),
  l AS (SELECT doc_id, source, generate_subscripts(string_split(text, {NL}), 1) AS k, unnest(string_split(text, {NL})) AS line FROM documents), i AS (SELECT doc_id * 100000 + k - 1 AS seq, source AS harvester, {_norm('line')} AS norm, {_PTOK.format(_norm('line'))} AS t FROM l),
  same AS (SELECT p.id, arg_min(i.harvester, i.seq) AS h FROM p JOIN i USING (norm) GROUP BY ALL),
  pt AS (SELECT id, len(t) AS np, unnest(t) AS token FROM p), it AS (SELECT seq, harvester, len(t) AS ni, unnest(t) AS token FROM i),
  pr AS (SELECT id, seq, harvester, count(*) / (np + ni - count(*))::DOUBLE AS j FROM pt JOIN it USING (token) GROUP BY id, seq, harvester, np, ni),
  best AS (SELECT id, j, harvester FROM pr QUALIFY row_number() OVER (PARTITION BY id ORDER BY j DESC, seq) = 1)
  SELECT p.id, CASE WHEN same.h IS NOT NULL THEN 'EXACT' WHEN j >= 0.5 THEN 'PARA' ELSE 'LOST' END AS verdict, round(CASE WHEN same.h IS NOT NULL THEN 1.0 ELSE coalesce(j, 0) END, 3) AS score, CASE WHEN same.h IS NOT NULL THEN same.h WHEN j >= 0.5 THEN best.harvester END AS matched, 'arm' || (p.id % 3) AS expected FROM p LEFT JOIN same USING (id) LEFT JOIN best USING (id)""",
    "quality_coverage": "WITH d AS (SELECT d.doc_id, len(regexp_extract_all(d.text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) + len(regexp_extract_all(d.text, '\\b[0-9a-f]{16,40}\\b')) AS items, coalesce(l.quality, 0) = 1 AS evidence FROM documents d JOIN labels l USING (doc_id)) SELECT count(*) AS turns, count(*) FILTER (items > 0) AS turns_kept, count(*) FILTER (evidence) AS evidence_turns, count(*) FILTER (evidence AND items > 0) AS covered, round(count(*) FILTER (items > 0) / count(*)::DOUBLE, 4) AS kept_share, round(count(*) FILTER (evidence AND items > 0) / (count(*) FILTER (evidence))::DOUBLE, 4) AS coverage FROM d",
    "recall_at_k": f"""WITH queries AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark), {_TERMS}, {_DOCS},{_bm25('docs', 'doc_id', 'own')}, r AS (SELECT query_id, doc_id AS id, round(raw, 4) AS score FROM own), top AS ({_top('r', 10, 'query_id, id, rank')}),
  gold AS (SELECT CAST(b.item_id AS VARCHAR) AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
  h AS (SELECT g.query_id, min(rank) AS place FROM gold g LEFT JOIN top t ON t.query_id = g.query_id AND t.id = g.id GROUP BY ALL)
  SELECT query_id, coalesce(place <= 1, false) AS hit_1, coalesce(place <= 3, false) AS hit_3, coalesce(place <= 5, false) AS hit_5, coalesce(place <= 10, false) AS hit_10 FROM h""",
    "miss_causes": f"""WITH m AS (SELECT b.item_id, d.doc_id, list_distinct(list_filter({_WORDS.format(_fold('b.text'))}, lambda t: length(t) > 2 AND NOT list_contains({_list(QUESTION_STOPS)}, t))) AS q, {_WORDS.format(_fold('d.text'))} AS raw, {_WORDS.format(_fold(f"string_split(d.text, {NL})[1]"))} AS kept FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
  l AS (SELECT item_id, doc_id, list_sort(list_filter(list_intersect(q, raw), lambda t: NOT list_contains(kept, t))) AS lost FROM m) SELECT item_id, doc_id, lost, CASE WHEN len(lost) > 0 THEN 'lexical' ELSE 'ranking' END AS cause FROM l""",
    "event_threshold_segments": f"SELECT event_id, user_id, CAST(coalesce(sum(CASE WHEN value >= {THRESHOLD} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS segment FROM events",
    "compaction_segments": """WITH b AS (SELECT user_id, event_id, (SELECT min(s.event_id) FROM events s WHERE s.user_id = e.user_id AND s.event_id > e.event_id AND s.event_type = 'purchase') AS summary_at FROM events e WHERE event_type = 'error'),
  p AS (SELECT user_id, summary_at, min(event_id) AS boundary_at FROM b WHERE summary_at IS NOT NULL GROUP BY ALL) SELECT user_id, coalesce(lag(summary_at) OVER (PARTITION BY user_id ORDER BY boundary_at), -1) + 1 AS begin, boundary_at, summary_at FROM p""",
    "lesson_anti_append": f"WITH {OV}, {LES.strip()}, i AS (SELECT transcript_id, unit_idx, text, {_id('lesson', chr(39) * 2, 'text')} AS id FROM les), s AS (SELECT id FROM i WHERE text LIKE '%run 0'), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY transcript_id * 100000 + unit_idx) AS rn FROM i WHERE id NOT IN (SELECT id FROM s)) SELECT id, text FROM f WHERE rn = 1",
    "atomic_facts": f"WITH {OV}, {FACTS} SELECT transcript_id, unit_idx, text, topic FROM fact",
    "sentence_parts": f"WITH {OV}, {sentences('ov').strip()} SELECT transcript_id, unit_idx, sent, sentence, {factual('sentence')} AS factual, CAST(len({parts('sentence')}) AS INTEGER) AS parts FROM sent",
    "topic_keys": f"WITH {OV}, ln AS (SELECT transcript_id, unit_idx, generate_subscripts(string_split(text, {NL}), 1) AS k0, unnest(string_split(text, {NL})) AS line FROM ov WHERE role = 'assistant'), ln1 AS (SELECT * FROM ln WHERE line <> ''),{topics('ln1', 'line', 'keyed')} SELECT transcript_id, unit_idx, CAST(k0 - 1 AS INTEGER) AS k, line, coalesce(topic, slug) AS topic FROM keyed",
    "session_payload": f"WITH {PAYLOAD}",
    "full_briefs": f"WITH {BRIEFS}",
    "recall_budget": f"""WITH RECURSIVE {_FULL}, best AS ({_top('res', 20, 'query_id, rank, id, text')}),
  fold AS (SELECT query_id, rank, id, text, length(text) + 1 <= 5000 AS ok, CASE WHEN length(text) + 1 <= 5000 THEN length(text) + 1 ELSE 0 END AS used FROM best WHERE rank = 1
    UNION ALL SELECT b.query_id, b.rank, b.id, b.text, f.used + length(b.text) + 1 <= 5000, f.used + CASE WHEN f.used + length(b.text) + 1 <= 5000 THEN length(b.text) + 1 ELSE 0 END FROM fold f JOIN best b ON b.query_id = f.query_id AND b.rank = f.rank + 1)
  SELECT query_id, rank, id, CAST(length(text) AS INTEGER) AS chars FROM fold WHERE ok""",
    "probe_extraction": f"WITH {OV}, {_PROBES} SELECT * FROM probes",
    "probe_arms": f"""WITH {ITEMS}, {_PROBES}, live AS (SELECT DISTINCT {_norm('text')} AS norm FROM item0 WHERE superseded_by IS NULL),
  hits AS (SELECT p.family, p.text, bool_or(CASE p.family WHEN 'fact' THEN contains(norm, string_split(p.text, ' ')[1]) AND contains(norm, string_split(p.text, ' ')[2])
    WHEN 'claim' THEN len(list_intersect({_PTOK.format(_norm('p.text'))}, {_PTOK.format('norm')})) / greatest(len(list_distinct(list_concat({_PTOK.format(_norm('p.text'))}, {_PTOK.format('norm')}))), 1)::DOUBLE >= 0.5 ELSE contains(norm, {_norm('p.text')}) END) AS kept FROM probes p CROSS JOIN live GROUP BY ALL),
  t AS (SELECT family, count(*) FILTER (kept) AS kept, count(*) AS n FROM hits GROUP BY ALL UNION ALL SELECT 'all', count(*) FILTER (kept), count(*) FROM hits)
  SELECT family, kept, n, round(kept / n::DOUBLE, 4) AS share FROM t""",
    "arm_duel": f"WITH {GREEDY}, s AS (SELECT transcript_id, count(*) FILTER (kept) / count(*)::DOUBLE - count(*) FILTER (pos >= 3) / count(*)::DOUBLE AS d FROM fold GROUP BY ALL) SELECT count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS draws, count(*) FILTER (d < 0) AS losses, round(quantile_cont(d, 0.5), 4) AS median, round(min(d), 4) AS worst FROM s",
    "median_length": "SELECT CAST(length(text) AS INTEGER) AS median FROM documents WHERE text IS NOT NULL ORDER BY length(text) LIMIT 1 OFFSET (SELECT count(text) // 2 FROM documents)",
    "lessons_carried": f"""WITH {CLAIMS}, mine AS (SELECT transcript_id, text, {_fold('text')} AS key FROM les),
  found AS (SELECT text, {_fold('text')} AS key, transcript_id * 100000 + unit_idx AS seq, {_id('lesson', chr(39) * 2, 'text')} AS id FROM les), store AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
  newest AS (SELECT u.transcript_id, s.* FROM (SELECT DISTINCT transcript_id FROM ov) u CROSS JOIN store s),
  best AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY seq DESC) AS place FROM newest),
  add0 AS (SELECT b.transcript_id, b.text, b.key, b.place FROM best b WHERE place <= 2 AND NOT EXISTS (SELECT 1 FROM mine m WHERE m.transcript_id = b.transcript_id AND m.key = b.key)),
  add1 AS (SELECT transcript_id, coalesce((SELECT max(pos) FROM claim1 c WHERE c.transcript_id = a.transcript_id), -1) + row_number() OVER (PARTITION BY transcript_id ORDER BY place) AS pos, text, 'lesson:' || substr(key, 1, 40) AS topic FROM add0 a)
  SELECT transcript_id, pos, id, text, topic, CAST(NULL AS VARCHAR) AS ts FROM claim1 UNION ALL SELECT transcript_id, CAST(pos AS INTEGER), {_id('lessons', 'topic', 'text')}, text, topic, '2024-01-01T00:00:00Z' FROM add1""",
    "agent_messages": "SELECT user_id AS run_id, event_id + 1 AS line, 'assistant' AS role, event_type || ' happened' AS text FROM events WHERE event_type = 'view' AND event_id <> (SELECT max(m.event_id) FROM events m WHERE m.user_id = events.user_id)",
    "latest_by_topic_stream": "SELECT user_id || ':' || event_type AS topic, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL",
    "agent_runs": "WITH r AS (SELECT user_id AS run_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY ALL) SELECT run_id, n + 1 AS events, 't' || run_id AS thread_id, last * 10 AS input_tokens, last AS cached_input_tokens, CAST(NULL AS BIGINT) AS output_tokens, false AS parse_error FROM r",
    "session_texts": f"SELECT conv_id AS session, string_agg(role || ': ' || text, {NL} ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "retention_by_arm": "",
}


def _arm(arm: str, scored: str) -> str:
    """Kept items of an arm within an eighth of each transcript's length, against the probes of the whole texts."""
    return f"""WITH RECURSIVE {scored}, {_PROBES}, room AS (SELECT transcript_id, floor(sum(length(text)) / 8) AS room FROM full_ov GROUP BY ALL),
  fold AS (SELECT i.transcript_id, i.priority, i.text, length(i.text) + 1 <= room AS kept, CASE WHEN length(i.text) + 1 <= room THEN length(i.text) + 1 ELSE 0 END AS used, room FROM item1 i JOIN room USING (transcript_id) WHERE priority = 1
    UNION ALL SELECT i.transcript_id, i.priority, i.text, f.used + length(i.text) + 1 <= f.room, f.used + CASE WHEN f.used + length(i.text) + 1 <= f.room THEN length(i.text) + 1 ELSE 0 END, f.room FROM fold f JOIN item1 i ON i.transcript_id = f.transcript_id AND i.priority = f.priority + 1),
  live AS (SELECT DISTINCT {_norm('text')} AS norm FROM fold WHERE kept),
  hits AS (SELECT p.family, p.text, bool_or(CASE p.family WHEN 'fact' THEN contains(norm, string_split(p.text, ' ')[1]) AND contains(norm, string_split(p.text, ' ')[2])
    WHEN 'claim' THEN len(list_intersect({_PTOK.format(_norm('p.text'))}, {_PTOK.format('norm')})) / greatest(len(list_distinct(list_concat({_PTOK.format(_norm('p.text'))}, {_PTOK.format('norm')}))), 1)::DOUBLE >= 0.5 ELSE contains(norm, {_norm('p.text')}) END) AS kept FROM probes p CROSS JOIN live GROUP BY ALL),
  t AS (SELECT family, count(*) FILTER (kept) AS kept, count(*) AS n FROM hits GROUP BY ALL UNION ALL SELECT 'all', count(*) FILTER (kept), count(*) FROM hits)
  SELECT '{arm}' AS arm, family, kept, n, round(kept / n::DOUBLE, 4) AS share FROM t"""


def _tokens_ab(arm: str, words: str) -> str:
    terms = f"terms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({words.format('query')}) AS term FROM queries) GROUP BY ALL)"
    return f"""WITH queries AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query FROM benchmark UNION ALL SELECT * FROM (VALUES ('ru', 'порт панели'), ('fr', 'élu être'), ('none', '???'))), {terms}, docs AS (SELECT doc_id, {words.format('text')} AS tokens FROM documents),{_bm25('docs', 'doc_id', 'own')},
  r AS (SELECT query_id, doc_id AS id, round(raw, 4) AS score FROM own), top AS ({_top('r', 10, 'query_id, id, rank')}),
  gold AS (SELECT CAST(b.item_id AS VARCHAR) AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
  h AS (SELECT g.query_id, coalesce(min(rank), 99) AS place FROM gold g LEFT JOIN top t ON t.query_id = g.query_id AND t.id = g.id GROUP BY ALL)
  SELECT '{arm}' AS arm, (SELECT count(*) FROM queries) AS queries, (SELECT count(*) FROM queries WHERE query_id NOT IN (SELECT query_id FROM top)) AS without_result, (SELECT round(avg(CASE WHEN query_id IN (SELECT query_id FROM top) THEN 0 ELSE 1 END), 4) FROM queries) AS zero_share,
  round(avg(CAST(place <= 1 AS INTEGER)), 4) AS recall_1, round(avg(CAST(place <= 3 AS INTEGER)), 4) AS recall_3, round(avg(CAST(place <= 5 AS INTEGER)), 4) AS recall_5, round(avg(CAST(place <= 10 AS INTEGER)), 4) AS recall_10 FROM h"""


_FULL_OV = OV + ", full_ov AS (SELECT * FROM ov)"
_BARE_OV = OV.replace("ov AS (", "full_ov AS (", 1) + f", ov AS (SELECT transcript_id, unit_idx, role, regexp_replace(text, '{MARK}', '', 'g') AS text FROM full_ov)"
_ALL_ITEMS = "every AS (SELECT transcript_id, 'claim' AS bucket, pos, text FROM claim1 UNION ALL SELECT transcript_id, 'supplement', pos, text FROM supp)"
_WHOLE_PROBES = _PROBES.replace("FROM ov WHERE", "FROM full_ov WHERE")
SQL |= {
    "equal_budget_arms": " UNION ALL ".join(f"SELECT * FROM ({_arm(arm, SCORED.replace(OV, ov)).replace(_PROBES, _WHOLE_PROBES)})" for arm, ov in (("marked", _FULL_OV), ("stripped", _BARE_OV))),
    "recall_by_type": f"WITH h AS ({SQL['recall_at_k']}), k AS (SELECT h.*, unnest(['type' || (CAST(query_id AS INTEGER) % 3), 'all']) AS kind FROM h) SELECT kind, count(*) AS n, round(avg(CAST(hit_1 AS INTEGER)), 4) AS recall_1, round(avg(CAST(hit_3 AS INTEGER)), 4) AS recall_3, round(avg(CAST(hit_5 AS INTEGER)), 4) AS recall_5, round(avg(CAST(hit_10 AS INTEGER)), 4) AS recall_10 FROM k GROUP BY kind",
    "kept_volume": f"WITH {ITEMS}, {_ALL_ITEMS}, a AS (SELECT CAST(sum(length(text)) AS BIGINT) AS kept_chars FROM every), b AS (SELECT CAST(sum(length(text)) AS BIGINT) AS haystack_chars FROM ov) SELECT kept_chars, haystack_chars, round(kept_chars / haystack_chars::DOUBLE, 4) AS kept_share FROM a, b",
    "grouped_documents": f"WITH {ITEMS}, {_ALL_ITEMS} SELECT CAST(transcript_id AS VARCHAR) AS id, transcript_id AS owner, string_agg(text, {NL} ORDER BY bucket, pos) AS text FROM every GROUP BY transcript_id",
    "item_documents": f"WITH {ITEMS}, {_ALL_ITEMS} SELECT transcript_id || '#h' || (row_number() OVER (PARTITION BY transcript_id ORDER BY bucket, pos) - 1) AS id, transcript_id AS owner, text FROM every",
    "turn_documents": "SELECT conv_id || '#' || turn AS id, conv_id AS owner, text FROM conversations",
    "tokenizer_ab": f"SELECT * FROM ({_tokens_ab('any script', _WORDS.replace('{0}', _fold('{0}')))}) UNION ALL SELECT * FROM ({_tokens_ab('ascii', 'regexp_extract_all(lower({0}), ' + chr(39) + '[a-z0-9]+' + chr(39) + ')')})",
    "evidence_traces": f"""WITH {ITEMS}, s AS (SELECT transcript_id, unit_idx, text FROM claim1 UNION ALL SELECT transcript_id, unit_idx, text FROM paths UNION ALL SELECT transcript_id, unit_idx, text FROM ids UNION ALL SELECT transcript_id, unit_idx, text FROM decs),
  g AS (SELECT transcript_id, unit_idx, count(*) AS kept, list_distinct(flatten(list({_WORDS.format(_fold('text'))}))) AS held FROM s GROUP BY ALL), q AS (SELECT ['dashboard', 'port', 'token', 'user'] AS terms)
  SELECT o.transcript_id, o.unit_idx, coalesce(kept, 0) AS kept, list_sort(list_intersect(terms, coalesce(held, []))) AS hits, list_sort(list_filter(list_intersect(terms, {_WORDS.format(_fold('o.text'))}), lambda t: NOT list_contains(coalesce(held, []), t))) AS lost FROM ov o CROSS JOIN q LEFT JOIN g USING (transcript_id, unit_idx) WHERE o.role = 'user'""",
}
SQL["retention_by_arm"] = f"SELECT expected AS arm, count(*) FILTER (verdict = 'EXACT') AS exact, count(*) FILTER (verdict = 'PARA') AS para, count(*) FILTER (verdict = 'LOST') AS lost, count(*) AS n, round(count(*) FILTER (verdict <> 'LOST') / count(*)::DOUBLE, 3) AS retention_rate FROM ({SQL['probe_retention']}) GROUP BY ALL"
