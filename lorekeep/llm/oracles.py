"""SQL twins (DuckDB) of the queries that SQL can express on whole tables."""

from __future__ import annotations

from lorekeep.llm.archives import REVISIT_BYTES
from lorekeep.llm.licences import FORMS, LEAST, SAME, TEMPLATES, pairs_of

_ARCHIVES = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body,
         regexp_replace(coalesce(url, '-'), '[\\x00-\\x20]', '%20', 'g') AS url
  FROM pages
), d AS (
  SELECT page_id, url, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < last THEN last END AS refers_to,
       url,
       CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id < last THEN NULL ELSE true END AS verified
FROM r
"""

_SHINGLES = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id,
         CASE WHEN len(words) = 0 THEN []
              WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
              ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
  FROM w
), g AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)
  UNION ALL
  SELECT b, a FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)
), reach(node, other) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
  SELECT node, min(other) AS low FROM reach GROUP BY node
)
SELECT s.doc_id, len(grams) AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id
FROM s LEFT JOIN least ON s.doc_id = least.node
"""


def _licences() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rows = ", ".join(f"({quoted(k)}, [{', '.join(map(quoted, pairs_of(v)))}])" for k, v in TEMPLATES.items())
    same = "CASE licence " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in SAME.items()) + f" ELSE regexp_replace(licence, '{FORMS}', '') END"
    return f"""
WITH t(licence, template) AS (VALUES {rows}),
l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), u AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1))::INTEGER AS line, unnest(lines) AS unit FROM l
  UNION ALL
  SELECT doc_id, 0, text FROM l WHERE len(lines) > 1
), w AS (
  SELECT doc_id, line, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS words FROM u
), p AS (
  SELECT doc_id, line,
         CASE WHEN len(words) > 1
              THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
              ELSE words END AS pairs
  FROM w WHERE words[1] <> ''
), m AS (
  SELECT doc_id, line, licence AS form, len(template) AS n_template,
         {same} AS licence,
         2.0::DOUBLE * len(list_intersect(pairs, template)) / (len(pairs) + len(template)) AS dice
  FROM p JOIN t ON len(pairs) <= 3 * len(template) AND len(template) <= 3 * len(pairs)
)
, b AS (
  SELECT * FROM m WHERE dice >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, n_template DESC, form DESC) = 1
)
SELECT doc_id, line, licence, dice FROM b
WHERE line > 0 OR NOT EXISTS (SELECT 1 FROM b o WHERE o.doc_id = b.doc_id AND o.line > 0 AND o.licence = b.licence)
"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(node, other) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
  SELECT node, min(other) AS low FROM reach GROUP BY node
), n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       coalesce(vec_id <= coalesce(low, vec_id), false) AS kept
FROM embeddings LEFT JOIN least ON vec_id = node LEFT JOIN n ON vec_id = a
"""

_RANKED = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents
), t AS (
  SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS words FROM d
), p AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, t GROUP BY term, docs
), q AS (
  SELECT DISTINCT item_id, text FROM benchmark
), i AS (
  SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM q
), c AS (
  SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL
), s AS (
  SELECT item_id, row, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM c JOIN p USING (term) JOIN w USING (term), t GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""

_COLLOCATIONS = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p
), t AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda m:
    list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))))) AS phrase
  FROM w
), f AS (
  SELECT lang, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE contains(phrase, ' ')
), k AS (
  SELECT lang, phrase, a, ws, unnest(range(1, len(ws))) AS k FROM c
), s AS (
  SELECT k.lang, k.phrase, a, k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN t ON t.lang = k.lang
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k + 1:], ' ')
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (
  SELECT lang, a, unnest(flatten(list_transform(range(2, len(ws)), lambda m:
    list_transform(range(1, len(ws) - m + 2), lambda j: array_to_string(ws[j:j + m - 1], ' '))))) AS phrase
  FROM c WHERE len(ws) > 2
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a)
QUALIFY rank <= 2000
"""

ORACLES = {
    "op1_arc_to_warc": _ARCHIVES,
    "op2_shingle_join": _SHINGLES,
    "op6_licence_scan": _licences(),
    "op11_multi_index": _NEAR_VECTORS,
    "op12_ranked_search": _RANKED,
    "op13_phrase_mining": _COLLOCATIONS,
}
