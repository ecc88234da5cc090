"""DuckDB SQL for the queries of the library's own operators that SQL can express."""

from __future__ import annotations

import hashlib

from .functions.fold import ECHO_FROM, ECHO_TO

SALT = b"\x11" * 32
# A look-around becomes a character that is matched beside the span; as neighbours may share one, those beside matches are doubled first.
_RULES = (
    ("EMAIL", "e-mail", r"(?:^|[^A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24})(?:$|[^A-Za-z0-9-])", "lower(split_part(s, '@', 1)) NOT IN ('noreply', 'no-reply', 'donotreply', 'do-not-reply', 'mailer-daemon', 'postmaster')"),
    ("CARD", "card", r"(?:^|[^0-9-])([0-9](?:[ -]?[0-9]){12,18})(?:$|[^0-9-])", "card"),
    ("PHONE", "phone", r"(?:^|[^\pL\pN_+])(\+[0-9](?:[ .()-]{0,2}[0-9]){7,14})(?:$|[^0-9])", "length(regexp_replace(s, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"),
    ("IP", "IPv4", r"(?:^|[^0-9.])((?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]))(?:$|[^0-9.])", "true"),
    ("PHONE", "US phone", r"(\([0-9]{3}\)[ \t]?[0-9]{3}-[0-9]{4})", "true"),
    ("ID", "SSN", r"\b([0-9]{3}-[0-9]{2}-[0-9]{4})\b", "s[1:3] NOT IN ('000', '666') AND s[1:1] <> '9' AND s[5:6] <> '00' AND s[8:11] <> '0000'"),
)
_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({d}, length({d}) + 1 - i, 1) AS INTEGER) ELSE (2 * CAST(substr({d}, length({d}) + 1 - i, 1) AS INTEGER)) // 10 + (2 * CAST(substr({d}, length({d}) + 1 - i, 1) AS INTEGER)) % 10 END)) % 10 = 0 AND length({d}) BETWEEN 13 AND 19 AND length(replace({d}, {d}[1:1], '')) > 0"
_NETWORK = "regexp_matches({d}, '^(4([0-9]{{12}}|[0-9]{{15}}|[0-9]{{18}})|(5[1-5][0-9]{{14}}|2(2[2-9][0-9]{{13}}|[3-6][0-9]{{14}}|7[01][0-9]{{13}}|720[0-9]{{12}}))|3[47][0-9]{{13}}|6011[0-9]{{12}}([0-9]{{3}})?|65[0-9]{{14}}([0-9]{{3}})?|64[4-9][0-9]{{13}}([0-9]{{3}})?|35(2[89]|[3-8][0-9])[0-9]{{12}}([0-9]{{3}})?|3(0[0-5][0-9]{{11}}|[68][0-9]{{12}}))$')"


def _detections() -> str:
    """CTEs that end with det (doc_id, source, kind, rule, ord, s, pos): the first of each (document, kind, key)."""
    parts = []
    for i, (kind, rule, pattern, keep) in enumerate(_RULES):
        digits = "regexp_replace(s, '[^0-9]', '', 'g')"
        test = f"({_LUHN.format(d=digits)}) AND {_NETWORK.format(d=digits)}" if keep == "card" else keep
        q, read = pattern.replace("'", "''"), "text"
        if q.startswith("(?:^|"):
            wide = "(" + q[3:].replace("(?:$|", "($|")  # the characters beside a match as groups 1 and 3
            read = f"regexp_replace(text, '{wide}', '\\1\\1\\2\\3\\3', 'g')"
        parts.append(f"SELECT doc_id, source, '{kind}' AS kind, '{rule}' AS rule, {i} AS r, n, s, strpos(text, s) AS pos FROM (SELECT doc_id, source, text, unnest(regexp_extract_all(x, '{q}', 1)) AS s, generate_subscripts(regexp_extract_all(x, '{q}', 1), 1) AS n FROM (SELECT doc_id, source, text, {read} AS x FROM documents)) WHERE {test}")
    return f"WITH hits AS ({' UNION ALL '.join(parts)}), det AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, lower(s) ORDER BY r, n) AS first FROM hits) WHERE first = 1)"


def _token(attempt: int = 0) -> str:
    """The token of (kind, k), or what it is derived as again: HMAC-SHA-256 with the pads as constants."""
    again = f" || '\\x00{attempt}'::BLOB" if attempt else ""
    hexed = lambda byte: "".join(f"\\x{b ^ byte:02X}" for b in SALT.ljust(64, b"\0"))
    inner = f"unhex(sha256('{hexed(0x36)}'::BLOB || encode(kind) || '\\x00'::BLOB || encode(k){again}))"
    outer = f"sha256('{hexed(0x5C)}'::BLOB || {inner})"
    return f"kind || '_' || (CAST('0x' || substr({outer}, 1, 10) AS BIGINT) % 90000000 + 10000000)"


def _made(number: str, digits: int) -> str:
    """A capitalised word for a number, a syllable a digit."""
    syllables = "['ba', 'de', 'fa', 'go', 'lu', 'ma', 'ne', 'ro', 'sa', 'tu']"
    word = f"list_aggregate(list_transform(range(1, {digits + 1}), lambda i: {syllables}[CAST(substr(lpad(CAST({number} AS VARCHAR), {digits}, '0'), i, 1) AS INTEGER) + 1]), 'string_agg', '')"
    return f"(upper({word}[1:1]) || {word}[2:])"


_SENSITIVE = "(SELECT d.doc_id, d.source, d.text, CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS level FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))"
_NAME = "(['public', 'internal', 'confidential', 'restricted'])[level + 1]"
_REQ = "(SELECT user_id AS task_id, event_type || CASE WHEN event_id % 3 = 0 THEN '-2024' ELSE '' END AS model, k AS input, k % 7 AS w5, k % 5 AS w1, k * 3 AS read, k % 11 AS output FROM (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events))"
_PRICES = "(VALUES ('click', 4.0, 20.0, 0.25), ('view', 2.0, 10.0, 0.5), ('view-2024', 1.0, 5.0, 0.125), ('purchase', 8.0, 40.0, 1.0), ('signup', 0.5, 2.5, 0.0625)) p(id, pin, pout, pread)"
_PRICED = f"(SELECT * FROM (SELECT DISTINCT model FROM {_REQ}) m JOIN {_PRICES} ON model = id OR starts_with(model, id || '-') OR starts_with(model, id || '[') QUALIFY row_number() OVER (PARTITION BY model ORDER BY length(id) DESC) = 1)"
_COS = "1 - list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))))"
_PAIRS = f"(SELECT q.vec_id AS qid, q.label AS src, e.vec_id AS cid, e.label AS scope, {_COS} AS d FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id)"


def _window(kind: str, hours: int) -> str:
    return f"(SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + {hours * 3600} AS e FROM events WHERE event_type = '{kind}')"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


ORACLES = {
    "detect_documents": f"{_detections()} SELECT doc_id, kind, rule, lower(s) AS span_key FROM det",
    "detect_counts": f"{_detections()} SELECT source AS scope_id, kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM det GROUP BY ALL",
    "text_scripts": """
WITH c AS (SELECT doc_id, text, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l, length(regexp_replace(text, '[^Ѐ-ӿ]|[^\\pL]', '', 'g')) AS c, length(regexp_replace(text, '[^Ͱ-Ͽἀ-῿]|[^\\pL]', '', 'g')) AS g, length(regexp_replace(text, '[^\\pL]', '', 'g')) AS n FROM documents)
SELECT doc_id, CASE WHEN greatest(l, c, g) = 0 THEN NULL WHEN l >= c AND l >= g THEN 'latin' WHEN c >= g THEN 'cyrillic' ELSE 'greek' END AS script, CASE WHEN n > 0 AND c >= 0.3 * n THEN 'ru' ELSE 'en' END AS language, sha256(text) AS content_sha256 FROM c""",
    "echo_folding": f"SELECT c_custkey, translate(translate(c_name, 'ACEOPT0123', 'АСЕОРТ０１２３'), '{ECHO_FROM}', '{ECHO_TO}') AS echoed FROM customer",
    "name_parts": r"""
WITH p AS (SELECT p_partkey, list_filter(regexp_split_to_array(trim(p_name), '[\s,./\\()"''’]+'), lambda x: x <> '') AS p FROM part),
o AS (SELECT *, CASE WHEN length(p[1]) <= length(p[2]) THEN p[1] ELSE p[2] END AS a, CASE WHEN length(p[1]) <= length(p[2]) THEN p[2] ELSE p[1] END AS b FROM p)
SELECT p_partkey, CAST(len(p) AS INTEGER) AS n_parts, array_to_string(p, '|') AS parts, coalesce(a = b OR (length(a) >= 4 AND starts_with(b, a) AND length(b) - length(a) <= 3), false) AS one_stem FROM o""",
    "party_kinds": """
WITH r AS (SELECT c_custkey, (['director', 'vessel owner', 'wife of the claimant', 'bank', '', 'trustee'])[c_custkey % 6 + 1] AS role, c_custkey % 4 = 0 AS form FROM customer),
k AS (SELECT *, role IN ('vessel owner', 'bank') AS org, role IN ('director', 'wife of the claimant') AS person FROM r)
SELECT c_custkey, CASE WHEN org THEN 'ORG' WHEN person THEN 'PERSON' WHEN form THEN 'ORG' ELSE 'PERSON' END AS kind, NOT org AND person AS individual FROM k""",
    "checksums": f"""
WITH k AS (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS k FROM orders),
n AS (SELECT *, CAST('3704004405' || k || '1314' || lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') AS HUGEINT) AS iban, '41111111' || k AS d, substr(k, 2, 7) AS m FROM k)
SELECT o_orderkey, iban % 97 = 1 AS iban_ok, {_LUHN.format(d="d")} AS luhn_ok, {_LUHN.format(d="d")} AS card_ok, (7 * CAST(m[1:1] AS INT) + 6 * CAST(m[2:2] AS INT) + 5 * CAST(m[3:3] AS INT) + 4 * CAST(m[4:4] AS INT) + 3 * CAST(m[5:5] AS INT) + 2 * CAST(m[6:6] AS INT)) % 10 = CAST(m[7:7] AS INT) AS imo_ok FROM n""",
    "derive_tokens": f"{_detections()} SELECT kind, k AS span_key, {_token()} AS token FROM (SELECT DISTINCT kind, lower(s) AS k FROM det)",
    "absorb_people": f"""
WITH n AS (SELECT 'desk' || (c_custkey // 2 % 4) AS scope_id, {_made("c_custkey + 100000000", 9)} AS given, {_made("c_custkey // 2 + 1000000", 7)} AS family, c_custkey FROM customer),
p AS (SELECT scope_id, family, 'PERSON' AS kind, given || ' ' || family AS v, lower(given || ' ' || family) AS k, 1 AS wave, c_custkey AS place FROM n),
f AS (SELECT scope_id, family, 'PERSON' AS kind, family AS v, lower(family) AS k, 2 AS wave, row_number() OVER (ORDER BY lower(family)) AS place FROM p GROUP BY scope_id, family HAVING count(*) > 1),
a AS (SELECT *, {_token()} AS first FROM (SELECT * FROM p UNION ALL SELECT * FROM f)),
t AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY scope_id, first ORDER BY wave, place) = 1 THEN first ELSE {_token(1)} END AS token FROM a),
g AS (SELECT scope_id, family, string_agg(token, ',' ORDER BY token) AS shared_by FROM t WHERE wave = 1 GROUP BY scope_id, family)
SELECT t.scope_id, token, kind, v AS real_value, k AS normalized, CASE WHEN wave = 2 THEN shared_by END AS shared_by FROM t JOIN g USING (scope_id, family)""",
    "distinct_people": """
WITH n AS (SELECT c_custkey AS k, 'desk' || (c_custkey % 4) AS scope_id, unnest([0, 1]) AS n FROM customer)
SELECT scope_id, 'PERSON_' || (10000000 + 2 * k + n) AS token, (n = 1) = (k % 3 = 2) AS kept, 'PERSON_' || (10000000 + 2 * k + CASE WHEN k % 3 = 2 THEN 1 ELSE 0 END) AS person, false AS several FROM n""",
    "variant_claims": f"""
WITH n AS (SELECT 'desk' || (c_custkey // 2 % 4) AS scope_id, 'PERSON_' || (10000000 + c_custkey) AS token, {_made("c_custkey + 100000000", 9)} AS g, {_made("c_custkey // 2 + 1000000", 7)} AS f FROM customer),
v AS (SELECT scope_id, token, unnest([f || ' ' || g, g[1:1] || '. ' || f, f || ' ' || g[1:1] || '.', g[1:1] || '.' || f]) AS latin, g || ' ' || f AS own FROM n),
c AS (SELECT scope_id, token, latin AS surface FROM v UNION SELECT scope_id, token, translate(x, 'bdfglmnrstaeouD', 'бдфглмнрстаеоуД') FROM (SELECT scope_id, token, latin AS x FROM v UNION SELECT scope_id, token, own FROM v))
SELECT scope_id, surface, CASE WHEN count(DISTINCT token) = 1 THEN min(token) END AS owner, count(DISTINCT token) > 1 AS several FROM c GROUP BY scope_id, surface""",
    "restore_documents": f"{_detections()} SELECT doc_id, sha256(lower(coalesce(text, ''))) AS restored_sha256, doc_id IN (SELECT doc_id FROM det) AS hidden FROM documents WHERE source IS NOT NULL",
    "residual_surfaces": f"{_detections()} SELECT doc_id, min(s) AS found FROM det WHERE kind = 'EMAIL' AND source IS NOT NULL GROUP BY doc_id",
    "enrol_scopes": f"""{_detections()},
seeds AS (SELECT DISTINCT 'src' || (s_suppkey % 20) AS scope_id, 'ORG' AS kind, lower(s_name) AS k FROM supplier),
found AS (SELECT DISTINCT source AS scope_id, kind, lower(s) AS k FROM det WHERE source IS NOT NULL),
mail AS (SELECT DISTINCT scope_id, string_split(k, '@')[1] AS box FROM found WHERE kind = 'EMAIL'),
a AS (SELECT * FROM seeds UNION SELECT * FROM found)
SELECT scope_id, {_token()} AS token, kind, k AS normalized, 'active' AS status, CAST(1 AS BIGINT) AS n_surfaces FROM a""",
    "redact_planted": f"""
WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS c, {_made("c_custkey + 100000000", 9)} || ' ' || {_made("c_custkey % 1000 + 5000", 4)} || ' Ltd' AS name FROM customer),
d AS (SELECT doc_id, source, coalesce(text, '') AS text, 20 * (doc_id % greatest(n // 20, 1)) + 1 AS first, coalesce(TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS BIGINT) % 20, 0) AS number FROM documents, (SELECT count(*) AS n FROM customer) WHERE source IS NOT NULL),
p AS (SELECT doc_id, source, text, o.name AS own, t.name AS other, 'ORG' AS kind, lower(o.name) AS k FROM d JOIN c o ON o.c = first + number JOIN c t ON t.c = first + (number + 1) % 20),
q AS (SELECT *, {_token()} AS token FROM p)
SELECT doc_id, source AS scope_id, 1 AS redacted_count, token, CASE doc_id % 3 WHEN 0 THEN upper(own) WHEN 1 THEN replace(own, ' ', chr(160)) ELSE lower(own) END AS surface,
sha256(text || ' (' || token || ') met ' || other || '.') AS text_sha256 FROM q""",
    "settle_conversations": f"""
WITH w AS (SELECT DISTINCT conv_id, {_made("conv_id + 100000000", 9)} AS a, {_made("conv_id + 5000000", 7)} AS b, {_made("conv_id + 70000000", 8)} AS c FROM conversations),
n AS (SELECT 'conv' || conv_id AS scope_id, 'ORG' AS kind, lower(a || ' ' || b || ' ' || c || ' Ltd') AS k, upper(a[1:1] || b[1:1] || c[1:1]) AS short, b || ' ' || c AS rest FROM w)
SELECT scope_id, {_token()} AS token, CASE WHEN short < rest THEN short || '|' || rest ELSE rest || '|' || short END AS defined, CAST(4 AS BIGINT) AS n_hidden FROM n""",
    "withdrawn_restores": f"""
SELECT scope_id, conv_id || ':' || turn AS key, conv_id % 3 <> 0 OR turn % 2 <> 0 AS kept, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 THEN upper(name) END AS shown
FROM (SELECT 'desk' || (conv_id % 4) AS scope_id, conv_id, turn, {_made("conv_id + 100000000", 9)} || ' ' || {_made("conv_id + 5000000", 7)} || ' Ltd' AS name FROM conversations)""",
    "crossing_retention": """
SELECT session, id, r <= 5000 AS record_kept, r <= 5000 AND size <= 67108864 AS body_kept FROM (SELECT user_id AS session, event_id AS id, row_number() OVER w AS r,
sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) * 40000) OVER w AS size FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "transfer_standing": """
WITH e AS (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events),
d AS (SELECT user_id, ts AS decided, 't' || event_id AS id, CASE WHEN event_type = 'signup' THEN 'withdrawn' WHEN k % 4 = 0 THEN 'refused' ELSE 'allowed' END AS verdict,
CASE WHEN k % 7 = 0 THEN ts + to_hours(k % 3) ELSE ts END AS valid_from, CASE WHEN k % 5 <> 0 THEN ts + to_hours(k % 48) END AS valid_to FROM e WHERE event_type IN ('purchase', 'signup')),
r AS (SELECT v.user_id, v.event_id, v.ts, d.id, d.verdict, d.valid_from, d.valid_to FROM e v LEFT JOIN d ON d.user_id = v.user_id AND d.decided <= v.ts
WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY v.event_id ORDER BY decided DESC NULLS LAST, id DESC) = 1)
SELECT user_id AS what, event_id AS ask_id, id AS decision, CASE WHEN id IS NULL THEN 'undecided' WHEN verdict <> 'allowed' THEN verdict WHEN ts < valid_from THEN 'early' WHEN ts >= valid_to THEN 'lapsed' ELSE 'allowed' END AS standing FROM r""",
    "gateway_crossings": f"SELECT source AS actor_id, 'send' AS action, 'cloud' AS plane, {_NAME} AS sensitivity, sha256(text) AS content_hash, 'model' AS target FROM {_SENSITIVE} WHERE level <= 1",
    "gateway_refusals": f"SELECT {_NAME} AS sensitivity, count(*) AS n, min(doc_id) AS first_doc FROM {_SENSITIVE} WHERE level > 1 GROUP BY 1",
    "leak_check": "SELECT doc_id, sha256(b.t) AS surface_sha256, CAST((length(d.t) - length(replace(d.t, b.t, ''))) / length(b.t) AS BIGINT) AS n FROM (SELECT doc_id, replace(lower(text), 'ß', 'ss') AS t FROM documents) d, (SELECT DISTINCT replace(lower(text), 'ß', 'ss') AS t FROM benchmark) b WHERE contains(d.t, b.t)",
    "detect_legal": r"""
WITH n AS (SELECT count(*) AS a, count(*) FILTER (s_suppkey % 2 = 0) AS even, count(*) FILTER (s_suppkey % 2 = 1) AS odd, count(*) FILTER (s_suppkey % 3 = 0) AS third FROM supplier),
t AS (SELECT text FROM documents UNION ALL SELECT text FROM conversations),
p AS (SELECT coalesce(sum(len(list_distinct(regexp_extract_all(text, '\([0-9]{3}\)[ \t]?[0-9]{3}-[0-9]{4}')))), 0) AS phones FROM t),
l AS (SELECT unnest([
  {'rule': 'legal form', 'kind': 'ORG', 'n': a}, {'rule': 'title', 'kind': 'PERSON', 'n': a}, {'rule': 'role before', 'kind': 'PERSON', 'n': a}, {'rule': 'role after', 'kind': 'PERSON', 'n': a}, {'rule': 'cue', 'kind': 'PERSON', 'n': a},
  {'rule': 'Esq.', 'kind': 'PERSON', 'n': a}, {'rule': 'numbered party', 'kind': 'PERSON', 'n': a}, {'rule': 'mail header', 'kind': 'PERSON', 'n': a}, {'rule': 'valediction', 'kind': 'PERSON', 'n': a}, {'rule': 'attendance', 'kind': 'PERSON', 'n': 2 * a},
  {'rule': 'link', 'kind': 'PERSON', 'n': a}, {'rule': 'Russian full name', 'kind': 'PERSON', 'n': a}, {'rule': 'Russian name and patronymic', 'kind': 'PERSON', 'n': a}, {'rule': 'Russian initials', 'kind': 'PERSON', 'n': a},
  {'rule': 'Russian legal form', 'kind': 'ORG', 'n': a}, {'rule': 'vessel', 'kind': 'VESSEL', 'n': a}, {'rule': 'IMO number', 'kind': 'ID', 'n': even}, {'rule': 'US phone', 'kind': 'PHONE', 'n': a + phones}, {'rule': 'company number', 'kind': 'ID', 'n': a},
  {'rule': 'VAT number', 'kind': 'ID', 'n': a}, {'rule': 'VAT format', 'kind': 'ID', 'n': a}, {'rule': 'EIN', 'kind': 'ID', 'n': a}, {'rule': 'Russian registration', 'kind': 'ID', 'n': a}, {'rule': 'passport', 'kind': 'ID', 'n': a},
  {'rule': 'case number', 'kind': 'ID', 'n': a}, {'rule': 'register number', 'kind': 'ID', 'n': a}, {'rule': 'bar number', 'kind': 'ID', 'n': a}, {'rule': 'Russian account', 'kind': 'ACCOUNT', 'n': a}, {'rule': 'Handelsregister', 'kind': 'ID', 'n': a},
  {'rule': 'National Insurance number', 'kind': 'ID', 'n': third}, {'rule': 'SSN', 'kind': 'ID', 'n': odd}, {'rule': 'Russian passport', 'kind': 'ID', 'n': a}]) AS x FROM n, p)
SELECT x.rule AS rule, x.kind AS kind, CAST(x.n AS BIGINT) AS n FROM l WHERE x.n > 0""".replace("\\\\", "\\"),
    "leak_report": r"""
WITH k AS (SELECT lower(n_name) AS s, 'NATION' AS kind FROM nation UNION ALL SELECT lower(r_name), 'REGION' FROM region),
t AS (SELECT replace(lower(text), 'ß', 'ss') AS x FROM documents UNION ALL SELECT replace(lower(text), 'ß', 'ss') FROM conversations UNION ALL SELECT lower(n_name || ': see ' || n_name || ', pre' || n_name || '; post' || r_name || 'ish') FROM nation JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT s, kind, CAST((length(x) - length(replace(x, s, ''))) / length(s) AS BIGINT) AS n, len(regexp_extract_all(regexp_replace(x, '([^\pL\pN_])', '\1\1', 'g'), '(?:^|[^\pL\pN_])' || regexp_replace(s, '([^\pL\pN_])', '\1\1', 'g') || '(?:$|[^\pL\pN_])')) AS alone FROM t JOIN k ON contains(x, s))
SELECT kind, count(*) AS n_values, CAST(0 AS BIGINT) AS skipped, CAST(coalesce(sum(alone), 0) AS BIGINT) AS standalone, CAST(coalesce(sum(n - alone), 0) AS BIGINT) AS inside, coalesce(sum(alone), 0) > 0 AS leak
FROM (SELECT s, kind, sum(alone) AS alone, sum(n) AS n FROM k LEFT JOIN f USING (s, kind) GROUP BY s, kind) GROUP BY kind""".replace("\\\\", "\\"),
    "probe_retrieval": f"""
WITH top AS (SELECT * FROM {_PAIRS} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d, cid) <= 20),
best AS (SELECT qid, src, scope, min(d) AS d FROM top GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d) AS rank FROM best),
own AS (SELECT qid, min(d) AS own FROM {_PAIRS} WHERE scope = src GROUP BY 1),
a AS (SELECT qid, min(rank) FILTER (scope = src) AS source_rank, min(d) FILTER (scope = src) AS o, min(d) FILTER (scope <> src) AS x, count(*) AS n FROM r GROUP BY 1),
m AS (SELECT qid, source_rank, coalesce(x, 2.0) - coalesce(o, own, 2.0) AS margin, n FROM a LEFT JOIN own USING (qid))
SELECT qid AS query_id, CAST(source_rank AS INTEGER) AS source_rank, round(margin, 6) AS margin, coalesce(source_rank = 1 AND margin >= 0.05, false) AS identifies, CAST(n AS INTEGER) AS n_scopes FROM m""",
    "nearest_passages": f"SELECT qid AS query_id, place, cid AS chunk_id, round(d, 6) AS distance FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY d, cid) AS INTEGER) AS place FROM {_PAIRS}) WHERE place <= 5",
    "judge_prompts": "SELECT item_id, sha256('Records:' || chr(10) || '- A: first' || chr(10) || '- B: second' || chr(10) || chr(10) || 'Excerpt:' || chr(10) || substr(text, 1, 6000)) AS prompt_sha256 FROM benchmark",
    "price_models": f"SELECT model, id AS price_id, pin::DOUBLE AS input_price FROM {_PRICED}",
    "task_cost": f"""
WITH r AS (SELECT * FROM {_REQ}), c AS (SELECT r.*, pin::DOUBLE AS pin, (input * pin + w5 * pin * 1.25 + w1 * pin * 2 + read * pread + output * pout)::DOUBLE / 1e6 AS a, ((input + w5 + w1 + read) * pin + output * pout)::DOUBLE / 1e6 AS b FROM r LEFT JOIN {_PRICED} USING (model))
SELECT task_id, count(*) AS requests, array_to_string(list_sort(list(DISTINCT model)), ',') AS models, CAST(sum(input) AS BIGINT) AS input, CAST(sum(read) AS BIGINT) AS read, CAST(sum(output) AS BIGINT) AS output, CASE WHEN bool_and(pin IS NOT NULL) THEN round(sum(a), 4) END AS usd, CASE WHEN bool_and(pin IS NOT NULL) THEN round(sum(b) - sum(a), 4) END AS saved_usd FROM c GROUP BY task_id""",
    "usage_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "user_sessions": """
WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, g""",
    "last_view_before_error": "SELECT event_id, user_id, view_id FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS view_id FROM events WHERE event_type IN ('view', 'error')) WHERE event_type = 'error'",
    "overlapping_windows": f"SELECT p.user_id, p.event_id AS purchase_id, r.event_id AS error_id FROM {_window('purchase', 24)} p JOIN {_window('error', 12)} r ON p.user_id = r.user_id AND p.s < r.e AND r.s < p.e",
    "uncovered_purchases": f"SELECT event_id AS purchase_id FROM {_window('purchase', 24)} p WHERE NOT EXISTS (SELECT 1 FROM {_window('error', 12)} r WHERE p.user_id = r.user_id AND p.s < r.e AND r.s < p.e)",
    "route_pages": """
WITH r AS (SELECT DISTINCT array_to_string((string_split(url, '/'))[1:CASE WHEN page_id % 2 = 0 THEN 3 ELSE 4 END], '/') AS prefix FROM pages WHERE page_id % 3 = 0)
SELECT page_id, (SELECT prefix FROM r WHERE url = rtrim(prefix, '/') OR starts_with(url, rtrim(prefix, '/') || '/') ORDER BY length(rtrim(prefix, '/')) DESC LIMIT 1) AS route FROM pages""",
    "snapshot_changes": """
WITH a AS (SELECT o_orderkey, o_orderstatus || CASE WHEN o_orderkey % 13 = 1 THEN 'x' ELSE 'y' END AS d FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey, o_orderstatus || CASE WHEN o_orderkey % 13 = 2 THEN 'x' ELSE 'y' END AS d FROM orders WHERE o_orderkey % 11 <> 0)
SELECT o_orderkey, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'removed' ELSE 'changed' END AS how FROM a FULL JOIN b USING (o_orderkey) WHERE a.d IS DISTINCT FROM b.d""",
    "scan_documents_folder": "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "review_view": """
WITH n AS (SELECT user_id AS doc, event_id AS note_id, CASE WHEN event_id % 9 <> 0 THEN event_id % 97 END AS start, event_id % 5 + 1 AS importance FROM events WHERE event_type = 'view'),
d AS (SELECT event_id - event_id % 4 AS note_id, CASE WHEN event_type = 'click' THEN 'rejected' ELSE 'accepted' END AS v, ts, event_id FROM events WHERE event_type IN ('click', 'purchase')),
s AS (SELECT note_id, count(*) AS n_decisions, arg_max(v, (ts, event_id)) AS state FROM d GROUP BY 1)
SELECT doc, note_id, coalesce(state, '') AS state, coalesce(n_decisions, 0) AS n_decisions, CAST(row_number() OVER (PARTITION BY doc ORDER BY start NULLS LAST, importance DESC, note_id) AS INTEGER) AS position FROM n LEFT JOIN s USING (note_id)""",
    "review_records": "SELECT c.event_id AS id, c.event_id - 1 AS about, CASE WHEN t.event_type = 'click' THEN 'decision' ELSE 'point' END AS about_kind, t.user_id AS about_creator, c.event_type AS verdict FROM events c JOIN events t ON t.event_id = c.event_id - 1 AND t.event_type IN ('view', 'click') WHERE c.event_type = 'click'",
    "hidden_tokens": f"{_detections()}, n AS (SELECT doc_id, kind || '_0' AS token, count(*) AS n, min(pos) AS p FROM det GROUP BY ALL) SELECT doc_id, token, n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p, token) AS INTEGER) AS place FROM n",
    "party_graph": f"{_detections()} SELECT 'd:' || source AS \"from\", CASE kind WHEN 'EMAIL' THEN 't:PERSON_1' ELSE 't:ORG_1' END AS \"to\", CAST(count(*) AS BIGINT) AS weight FROM det WHERE kind IN ('EMAIL', 'IP') GROUP BY ALL",
    "share_bands": "SELECT CASE WHEN pct <= 0 THEN NULL WHEN pct > 100 THEN 'a recorded stake outside 0–100% (source figure is inconsistent)' WHEN pct >= 50 THEN '≥50%' WHEN pct >= 25 THEN '25–49%' WHEN pct >= 10 THEN '10–24%' ELSE '<10%' END AS band, count(*) AS n FROM (SELECT round(100 * o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 3) AS pct FROM orders) GROUP BY 1",
    "citation_forms": """
WITH c AS (SELECT p_partkey, unnest(['§ ' || (p_partkey % 900 + 100) || ' BGB', '§ ' || (p_partkey % 900 + 101) || ' BGB', 'Art. ' || (p_partkey % 19 + 1) || ' GG', (p_partkey % 50 + 1) || ' U.S.C. § ' || (p_partkey % 2000 + 1), 'CPR ' || (p_partkey % 80 + 1) || '.1']) AS citation FROM part)
SELECT p_partkey, citation, CASE WHEN contains(citation, 'U.S.C.') THEN 'US' WHEN starts_with(citation, 'CPR') THEN 'GB' ELSE 'DE' END AS jurisdiction, CAST(CASE WHEN regexp_matches(citation, '[ABEZHIKMNOPTYX]') THEN 2 ELSE 1 END AS INTEGER) AS n_forms, citation AS folded FROM c""",
    "request_slots": "WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text FROM conversations), s AS (SELECT 'messages/' || i || '/role' AS path, role AS s FROM t UNION ALL SELECT 'messages/' || i || '/content', text FROM t) SELECT path, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars FROM s GROUP BY path",
}
