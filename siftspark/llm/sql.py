"""DuckDB twins of queries of this folder, over the whole tables."""

from __future__ import annotations

from siftspark.llm import licenses


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _license_scan() -> str:
    """Every word of every text against every notice and phrase, without filters."""
    notices = licenses.notices_of(licenses.NOTICES, licenses.CONTAINMENT)
    words = ", ".join(
        f"({t}, {_text(n.label)}, {n.layer}, {n.need}, {len(n.words)}, {_text(w.decode())})"
        for t, n in enumerate(notices) for w in sorted(n.words))
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, pos, {_text(label)} AS label FROM words WHERE "
        + " AND ".join(f"w{k or ''} = {_text(w)}" for k, w in enumerate(text.split()))
        for text, label in licenses.PHRASES.items())
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS parts
  FROM documents
),
listed AS (
  SELECT r, unnest(parts) AS w, generate_subscripts(parts, 1) - 1 AS pos FROM texts
),
words AS (
  SELECT r AS doc_id, pos, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3
  FROM listed WINDOW o AS (PARTITION BY r ORDER BY pos)
),
places AS ({phrases}),
base AS (
  SELECT doc_id AS r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id
),
notices(t, label, layer, need, size, w) AS (VALUES {words}),
hits AS (
  SELECT l.r, n.t, n.label, n.need, n.size, n.w, l.pos // n.layer - k AS block
  FROM listed l JOIN notices n ON l.w = n.w, (VALUES (0), (1)) shift(k)
  WHERE l.pos // n.layer >= k
),
blocks AS (
  SELECT r, any_value(label) AS label, count(DISTINCT w) / any_value(size) AS share
  FROM hits GROUP BY r, t, block HAVING count(DISTINCT w) >= any_value(need)
),
found AS (SELECT r, max(share) AS share FROM blocks GROUP BY r),
labelled AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM blocks UNION ALL SELECT doc_id, label FROM places) GROUP BY r
)
SELECT doc_id, len(parts)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM texts LEFT JOIN base USING (r) LEFT JOIN found USING (r) LEFT JOIN labelled USING (r)
"""


_TERMS = """regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+')"""

RANKED_SEARCH = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
known AS (SELECT r, doc_id, len(terms)::BIGINT AS n FROM texts WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM known),
items AS (
  SELECT DISTINCT i, item_id, term FROM (
    SELECT i, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark))
),
bags AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM texts)
  WHERE term IN (SELECT term FROM items) GROUP BY r, term
),
weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM bags, totals GROUP BY term, docs
),
scored AS (
  SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score
  FROM items JOIN bags USING (term) JOIN weighed USING (term) JOIN known USING (r), totals
  GROUP BY i, item_id, doc_id, r
),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


# DuckDB has no crc32: the table of 256 remainders is made here, by the polynomial.
CONVERSATION_TRIE = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
    list_concat([i], range(8)), lambda a, x: xor(a >> 1, 3988292384::BIGINT * (a & 1)))) AS t
),
said AS (
  SELECT conv_id AS c, turn, length(coalesce(text, '')) AS chars,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said
  FROM conversations WHERE conv_id IS NOT NULL
),
turns AS (SELECT c, said, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, said) AS pos FROM said),
convs AS (
  SELECT c, c - c % 100 AS g, n, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), crc
),
heads AS (
  SELECT v.c, t.pos AS depth, t.said, t.chars FROM convs v JOIN turns t ON t.c = v.g AND t.pos <= v.h
),
lengths AS (SELECT c, count(*) AS k FROM heads GROUP BY c),
rebuilt AS (
  SELECT * FROM heads UNION ALL
  SELECT t.c, t.pos - v.h + coalesce(k, 0), t.said, t.chars
  FROM turns t JOIN convs v USING (c) LEFT JOIN lengths USING (c) WHERE t.pos > v.h
),
whole AS (
  SELECT c, count(depth) AS m, coalesce(list(said ORDER BY depth) FILTER (depth IS NOT NULL), []) AS path,
         coalesce(list(chars ORDER BY depth) FILTER (depth IS NOT NULL), []) AS lens
  FROM convs LEFT JOIN rebuilt USING (c) GROUP BY c
),
prefixes AS (
  SELECT c, m, depth, md5(array_to_string(path[1:depth], ',')) AS key, CASE WHEN depth > 0 THEN lens[depth] ELSE 0 END AS chars
  FROM (SELECT *, unnest(range(m + 1)) AS depth FROM whole)
),
nodes AS (
  SELECT depth, key, count(*) AS n_convs, min(c) AS owner, (count(*) - 1) * any_value(chars) AS value,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (m = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, key
),
edges AS (
  SELECT n.depth, n.key, p.key AS parent_key, o.owner AS parent
  FROM nodes n JOIN prefixes p ON p.c = n.owner AND p.depth = n.depth - 1 JOIN nodes o ON o.key = p.key AND o.depth = p.depth
),
children AS (SELECT depth - 1 AS depth, parent_key AS key, count(*) AS n_children FROM edges GROUP BY ALL),
subtrees AS (
  SELECT p.depth, p.key, sum(n.value) AS saved, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM nodes n LEFT JOIN children k USING (depth, key) JOIN prefixes p ON p.c = n.owner AND p.depth <= n.depth GROUP BY p.depth, p.key
)
SELECT owner AS conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved::BIGINT AS saved_tokens, ends_sha256
FROM nodes LEFT JOIN edges USING (depth, key) LEFT JOIN children USING (depth, key) JOIN subtrees USING (depth, key)
"""


# Windows and strings are listed one by one; texts as hexadecimal digits, since DuckDB cuts text by characters.
SUBSTRING_DEDUP = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
starts AS (
  SELECT r, doc_id, k, list_slice(words, k, k + 12) AS win FROM (
    SELECT r, doc_id, words, unnest(range(1, len(words) - 11)) AS k FROM texts WHERE len(words) >= 13)
),
again AS (
  SELECT r, k FROM (SELECT r, k, doc_id, min(doc_id) OVER (PARTITION BY win) AS first FROM starts) WHERE first < doc_id
),
gone AS (SELECT DISTINCT r, k + j AS k FROM again, range(13) t(j)),
rest AS (
  SELECT r, string_agg(w, ' ' ORDER BY k) AS kept, count(*) AS n
  FROM (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS k FROM texts) ANTI JOIN gone USING (r, k) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN rest USING (r)
"""

SUFFIX_DEDUP = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT r, doc_id, k, md5_number(substr(h, 2 * k + 1, 200)) AS s FROM (
    SELECT r, doc_id, h, unnest(range(len(h) // 2 - 99)) AS k FROM texts WHERE len(h) >= 200)
),
again AS (
  SELECT r, k FROM (SELECT r, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS n FROM starts) WHERE n > 1
),
steps AS (
  SELECT r, k, k - lag(k, 1, -1000) OVER (PARTITION BY r ORDER BY k) > 100 AS opens FROM again
),
spans AS (
  SELECT r, min(k) AS a, max(k) + 100 AS b FROM (
    SELECT r, k, sum(opens::INT) OVER (PARTITION BY r ORDER BY k) AS span FROM steps) GROUP BY r, span
),
edges AS (
  SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before, lead(a) OVER (PARTITION BY r ORDER BY a) AS after FROM spans
),
rest AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN after IS NULL THEN substr(h, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept
  FROM edges JOIN texts USING (r) GROUP BY r
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM texts LEFT JOIN rest USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": SUBSTRING_DEDUP, "op9_suffix_dedup": SUFFIX_DEDUP, "op11_conversation_trie": CONVERSATION_TRIE,
        "op12_ranked_search": RANKED_SEARCH, "op13_license_scan": _license_scan()}
