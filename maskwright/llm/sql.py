"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP1 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i, ws FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM i),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM r, (SELECT unnest(range(35)) AS j)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e0 AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""



def _op6() -> str:
    """The spans of each rule from the text between its matches; DuckDB's patterns are the rules' own, without what only bounds backtracking."""
    from .secrets import BASE_RULES, RULES

    parts = []
    for rank, r in enumerate(RULES):
        pattern = r.pattern.replace("(?<![0-9a-f])", "").replace("}+", "}").replace(r"\b", "").replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, regexp_extract_all(x, '{pattern}', 0) AS hits, regexp_extract_all(x, '{pattern}', {r.group}) AS parts,
            string_split_regex(x, '{pattern}') AS gaps, {r.least} AS least FROM t"""
        )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
g AS ({" UNION ALL ".join(parts)}),
i AS (SELECT doc_id, rank, kind, unnest(range(1, len(hits) + 1)) AS i, hits, parts, gaps, least FROM g WHERE len(hits) > 0),
s AS (SELECT doc_id, rank, kind, CAST(list_sum(list_transform(gaps[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda v: length(v))), 0) AS BIGINT) AS s, length(hits[i]) AS n, length(parts[i]) >= least AS ok FROM i),
k AS (SELECT doc_id, rank, kind, s, kind || ':' || s || ':' || (s + n) AS span FROM s WHERE ok),
a AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY s, rank) FILTER (rank < {len(BASE_RULES)}), '') AS base, string_agg(span, ',' ORDER BY s, rank) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  (SELECT count(DISTINCT x) * {len(BASE_RULES)} FROM t) AS first_pairs, (SELECT count(DISTINCT x) * {len(RULES) - len(BASE_RULES)} FROM t) AS second_pairs
FROM t LEFT JOIN a USING (doc_id)
"""


def _op9() -> str:
    letters = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST({} AS INTEGER), 1)"
    chars = [letters.format(f"(v[{k + 1}] >> {s}) & 31") for k in range(8) for s in (15, 10, 5, 0)]
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(coalesce(url, 'urn:page:' || page_id), '[\\x00-\\x20\\x7f]', '%20', 'g') AS uri FROM pages),
h AS (SELECT page_id, uri, CAST(octet_length(encode(html)) AS BIGINT) AS n, sha1(html) AS x FROM p),
v AS (SELECT page_id, uri, n, list_transform(range(8), lambda k: CAST('0x' || substr(x, 1 + 5 * k, 5) AS BIGINT)) AS v FROM h),
d AS (SELECT page_id, uri, n, {" || ".join(chars)} AS digest FROM v),
m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS keeper FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < keeper THEN keeper END AS refers_to,
  sha256('GET ' || uri || ' HTTP/1.1') AS request_line_sha256, page_id AS metadata_page_id, n AS metadata_payload_bytes FROM m
"""


ORACLES = {"op1_substring_dedup": OP1, "op2_minhash_dedup": OP2, "op6_secret_ledger": _op6(), "op9_warc_transactions": _op9()}
