"""The same results as the corpus queries, stated plainly in DuckDB SQL.

Each text compares windows, shingles or strings by their whole content and
enumerates what the operators avoid to enumerate, so it is for small tables.
Documents are numbered by (id, text), NULL id first and NULL text empty, like
in the operators.
"""

from __future__ import annotations

from sparkloom.llm.urls import LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _leads(n: int) -> str:
    """A word and the n - 1 words after it."""
    return ", ".join(["word", *(f"lead(word, {j}) OVER v" for j in range(1, n))])


def _numbered(word: str, lower: bool) -> str:
    """d (k, doc_id, n) and words (k, i from 1, n, word) of all documents."""
    text = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')" if lower else "coalesce(text, '')"
    return f"""t AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS k, doc_id,
 regexp_extract_all({text}, '{word}') AS w FROM documents),
d AS (SELECT k, doc_id, len(w) AS n FROM t),
words AS (SELECT k, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t)"""


def jaccard_components(n: int, percent: int) -> str:
    return f"""WITH RECURSIVE {_numbered(WORD, True)},
spread AS (SELECT k, i, n, concat_ws(' ', {_leads(n)}) AS s FROM words WINDOW v AS (PARTITION BY k ORDER BY i)),
sets AS (SELECT DISTINCT k, s FROM spread WHERE i = 1 OR i + {n - 1} <= n),
sizes AS (SELECT k, count(*) AS m FROM sets GROUP BY k),
common AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.k < b.k GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.k = a JOIN sizes y ON y.k = b WHERE 100 * c >= {percent} * (x.m + y.m - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT k, k AS far FROM d UNION SELECT r.k, e.b FROM reach r JOIN edges e ON e.a = r.far),
least_of AS (SELECT k, min(far) AS c FROM reach GROUP BY k)
SELECT d.doc_id, coalesce(m, 0) AS n_shingles, f.doc_id AS component_id
FROM d LEFT JOIN sizes USING (k) JOIN least_of USING (k) JOIN d f ON f.k = c"""


def substring_windows(window: int) -> str:
    return f"""WITH {_numbered(WORD, False)},
spread AS (SELECT k, i, n, word, concat_ws(' ', {_leads(window)}) AS s FROM words WINDOW v AS (PARTITION BY k ORDER BY i)),
judged AS (SELECT k, i, row_number() OVER (PARTITION BY s ORDER BY k, i) > 1 AS again FROM spread WHERE i + {window - 1} <= n),
covered AS (SELECT k, i, word, coalesce(max(again::INT) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW), 0) AS gone
 FROM words LEFT JOIN judged USING (k, i))
SELECT doc_id, count(word) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
 sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
FROM d LEFT JOIN covered USING (k) GROUP BY k, doc_id"""


def contamination(window: int) -> str:
    return f"""WITH {_numbered(PLAIN_WORD, True)},
b AS (SELECT row_number() OVER () AS r, coalesce(CAST(item_id AS VARCHAR), '') AS item,
 regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{PLAIN_WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
item_words AS (SELECT r AS k, item, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM b),
item_spread AS (SELECT item, i, n, least(n, {window}) AS size, [{_leads(window)}] AS x FROM item_words WINDOW v AS (PARTITION BY k ORDER BY i)),
patterns AS (SELECT DISTINCT item, size, array_to_string(x[1:size], ' ') AS s FROM item_spread WHERE i + size - 1 <= n),
spread AS (SELECT k, i, n, [{_leads(window)}] AS x FROM words WINDOW v AS (PARTITION BY k ORDER BY i)),
sizes AS (SELECT DISTINCT size FROM patterns),
windows AS (SELECT k, i, size, array_to_string(x[1:size], ' ') AS s FROM spread JOIN sizes ON i + size - 1 <= n),
hits AS (SELECT k, i, size, item FROM windows JOIN patterns USING (size, s)),
places AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + size)) AS i FROM (SELECT DISTINCT k, i, size FROM hits)) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT doc_id, n AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (k) LEFT JOIN items USING (k)"""


def repeated_bytes(depth: int, chunk: int = 1000) -> str:
    """Texts as hexadecimal digits, in overlapping chunks so that a digit pair is found without scanning a long text."""
    return f"""WITH t AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
d AS (SELECT k, doc_id, length(h) // 2 AS n FROM t),
cut AS (SELECT k, c, substr(h, {2 * chunk} * c + 1, {2 * (chunk + depth - 1)}) AS piece
 FROM (SELECT k, h, unnest(range(0, (length(h) // 2 + {chunk - 1}) // {chunk})) AS c FROM t)),
bytes AS (SELECT k, {chunk} * c + j AS i, substr(piece, 2 * j + 1, 2) AS byte, CASE WHEN 2 * j + {2 * depth} <= length(piece) THEN md5(substr(piece, 2 * j + 1, {2 * depth})) END AS s
 FROM (SELECT k, c, piece, unnest(range(0, least({chunk}, length(piece) // 2))) AS j FROM cut)),
judged AS (SELECT k, i, byte, s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 AS again FROM bytes),
covered AS (SELECT k, i, byte, max(again::INT) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN {depth - 1} PRECEDING AND CURRENT ROW) AS gone FROM judged),
runs AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY k ORDER BY i), 0) = 0 AS opens FROM covered)
SELECT doc_id, n AS n_bytes, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed, count(*) FILTER (opens) AS n_spans,
 sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (gone = 0), ''))) AS kept_sha256
FROM d LEFT JOIN runs USING (k) GROUP BY k, doc_id, n"""
