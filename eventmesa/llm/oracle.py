"""DuckDB SQL for the queries of this subpackage whose whole result SQL can express."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

#: Links by counts of shared shingles over all documents, then everything that links reach.
NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS keeper FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM q
"""

#: All windows of all items against all windows of the same lengths of all documents.
DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS text FROM (SELECT *, least(len(w), 13) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM item_windows),
starts AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d JOIN sizes ON len(w) >= k),
hits AS (SELECT doc_id, i, starts.k, item_id FROM starts JOIN item_windows ON item_windows.k = starts.k AND item_windows.text = array_to_string(w[i:i + starts.k - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _plus(x: str, cost: int | str, letter: str) -> str:
    """A way is its cost in eight digits and its letters, so the cheapest, ASCII-least way is the least text."""
    return f"printf('%08d', substr({x}, 1, 8)::INT + ({cost})) || substr({x}, 9) || '{letter}'"


#: The ways before a row, by state: nothing yet, after system, user, assistant; inserts come before it.
_P2 = f"least(s2, {_plus('s0', 2, 'I')}, {_plus('s1', 2, 'I')}, {_plus('s3', 2, 'I')})"
_CLOSED = f"s0 AS p0, s1 AS p1, {_P2} AS p2, least(s3, {_plus(_P2, 2, 'I')}) AS p3"
_ROW = ", ".join(
    f"least({_plus(f'p{to}', 3, 'D')}, {', '.join(more) or 'NULL'}) AS s{to}"
    for to, more in enumerate(
        [
            [],
            [f"CASE WHEN NOT gone AND initial = 's' THEN {_plus('p0', 'cut', 'K')} END"],
            [x for p in ("p0", "p1", "p3") for x in (f"CASE WHEN NOT gone AND initial = 'u' THEN {_plus(p, 'cut', 'K')} END", f"CASE WHEN NOT gone THEN {_plus(p, '2 + cut', 'R')} END")],
            [f"CASE WHEN NOT gone AND initial = 'a' THEN {_plus('p2', 'cut', 'K')} END", f"CASE WHEN NOT gone THEN {_plus('p2', '2 + cut', 'R')} END"],
        ]
    )
)
#: crc32 by a table of 256 remainders, the cheapest ways row by row, and the edits replayed.
REPAIR = rf"""
WITH RECURSIVE table256 AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
drawn AS (SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, table256),
changed AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, substr(role, 1, 1) AS initial FROM changed),
judged AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) NOT IN ('.', '!', '?') AS open, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
r AS (SELECT *, blank OR again AS gone, (open AND NOT blank AND NOT again)::INT AS cut FROM judged),
walk AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, '00000000' AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM conversations
  UNION ALL SELECT conv_id, i, {_ROW} FROM (SELECT r.conv_id, r.i, initial, gone, cut, {_CLOSED} FROM walk JOIN r ON r.conv_id IS NOT DISTINCT FROM walk.conv_id AND r.i = walk.i + 1)),
ended AS (SELECT conv_id, least(p0, p3) AS way FROM (SELECT conv_id, {_CLOSED} FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
letters AS (SELECT conv_id, j, way[8 + j] AS letter, len(regexp_replace(way[9:8 + j], 'I', '', 'g')) AS i FROM (SELECT conv_id, way, unnest(range(1, len(way) - 7)) AS j FROM ended)),
kept AS (SELECT l.conv_id, j, letter, role, text, initial, row_number() OVER (PARTITION BY l.conv_id ORDER BY j) AS e FROM letters l LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i WHERE letter <> 'D'),
named AS (SELECT conv_id, j, CASE letter WHEN 'K' THEN role ELSE CASE WHEN (e - max((e = 1 AND letter = 'K' AND initial = 's')::INT) OVER (PARTITION BY conv_id)) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END AS line FROM kept),
fixed AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY j) AS body FROM named GROUP BY conv_id),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  substr(way, 1, 8)::BIGINT AS cost, substr(way, 9) AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ended e LEFT JOIN fixed f ON f.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLE_SQL = {"op2_near_dedup": NEAR_DEDUP, "op8_warc": WARC, "op9_decontamination": DECONTAMINATION, "op13_conversation_repair": REPAIR}
