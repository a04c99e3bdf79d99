"""The registered queries once more as plain SQL for DuckDB, written from the semantics, not from the plans."""

from __future__ import annotations

# White space at text ends, as one SQL string literal.
_SP = (
    "'\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　'"
)
_NL = "chr(10)"


def _strip(x: str) -> str:
    return f"trim({x}, {_SP})"


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


# ── chat rows ────────────────────────────────────────────────────────────────

_CHAT = f"""ev AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS kk FROM events
), chat AS (
  SELECT strftime(ts, '%Y-%m-%d') || '.csv' AS source, event_id AS position,
    CAST(event_id AS VARCHAR) AS id, 'm' || CAST(event_id AS VARCHAR) AS "MsgSvrID",
    CASE WHEN kk >= 40 AND kk < 45 THEN '动画表情' WHEN kk >= 45 AND kk < 50 THEN ''
         WHEN kk >= 50 AND kk < 55 THEN NULL ELSE 'text' END AS type_name,
    CASE event_type WHEN 'purchase' THEN '1' WHEN 'click' THEN ' 0 ' WHEN 'error' THEN 'x'
         WHEN 'view' THEN '1.0' END AS is_sender,
    CASE WHEN kk = 99 THEN chr(9) ELSE ' u' || user_id END AS talker,
    CASE WHEN event_type = 'view' AND kk < 30 THEN '[' || event_type || '] ' || kk
         WHEN event_type = 'signup' AND kk < 30 THEN '表情' || kk
         WHEN event_type = 'signup' AND kk >= 90 THEN 'I''ve accepted your friend request. Now let''s chat!'
         WHEN event_type = 'click' AND kk < 20 THEN '　' || kk || chr(9)
         WHEN event_type = 'error' AND kk < 40 THEN '<msg>' || kk || '</msg>'
         WHEN event_type = 'error' AND kk >= 95 THEN ' 　'
         ELSE '  ' || event_type || ' number ' || kk || chr(10) END AS msg,
    CASE WHEN kk < 90 THEN strftime(ts, '%Y-%m-%d %H:00:00') WHEN kk < 95 THEN '' ELSE 'not a time' END AS "CreateTime",
    CASE WHEN kk < 60 THEN 'export' END AS src,
    CASE WHEN kk >= 70 THEN 'room' || kk ELSE '' END AS room_name,
    CASE WHEN kk < 10 THEN '1' WHEN kk < 20 THEN 'yes' END AS is_forward
  FROM ev
), judged AS (
  SELECT *, {_strip('msg')} AS body FROM chat
), valid AS (
  SELECT * FROM judged
  WHERE length(body) > 2 AND NOT starts_with(body, '[') AND NOT starts_with(body, '表情')
    AND NOT contains(coalesce(type_name, ''), '动画表情')
    AND body <> 'I''ve accepted your friend request. Now let''s chat!' AND NOT contains(body, '<msg>')
), cleaned AS (
  SELECT * FROM valid
  QUALIFY row_number() OVER (PARTITION BY source, coalesce("CreateTime", ''), msg ORDER BY position) = 1
), counts AS (
  SELECT c.source, c.total, c.total - coalesce(v.n, 0) AS filtered,
    coalesce(v.n, 0) - coalesce(k.n, 0) AS duplicates, coalesce(k.n, 0) AS kept,
    round((c.total - coalesce(k.n, 0)) * 100.0 / c.total, 1) AS saved_pct
  FROM (SELECT source, count(*) AS total FROM chat GROUP BY source) c
  LEFT JOIN (SELECT source, count(*) AS n FROM valid GROUP BY source) v ON v.source = c.source
  LEFT JOIN (SELECT source, count(*) AS n FROM cleaned GROUP BY source) k ON k.source = c.source
)"""

_RECORDS = f"""normal AS (
  SELECT source, position, {_strip('talker')} AS talker, {_strip('msg')} AS msg,
    coalesce(CAST(CASE WHEN regexp_full_match({_strip('is_sender')}, '[+-]?[0-9]+') THEN {_strip('is_sender')} END AS BIGINT), 0) AS is_sender,
    nullif("CreateTime", '') AS "CreateTime", nullif("MsgSvrID", '') AS "MsgSvrID",
    nullif(type_name, '') AS type_name, nullif(src, '') AS src, nullif(room_name, '') AS room_name,
    TRY_CAST(is_forward AS BIGINT) AS is_forward, id
  FROM chat WHERE {_strip('talker')} <> '' AND {_strip('msg')} <> ''
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) + 1 AS row_no FROM normal
), marked AS (
  SELECT *, (length(msg) > 2 AND NOT starts_with(msg, '[') AND NOT starts_with(msg, '表情')
      AND NOT contains(coalesce(type_name, ''), '动画表情')
      AND msg <> 'I''ve accepted your friend request. Now let''s chat!' AND NOT contains(msg, '<msg>')) AS ok,
    sha256(source || '|' || row_no || '|' || coalesce("CreateTime", '') || '|' || msg) AS record_hash
  FROM numbered
), docs AS (
  SELECT source, row_no, talker || CASE WHEN room_name IS NOT NULL THEN '@' || room_name ELSE '' END || ': ' || msg AS content,
    talker, coalesce(CAST(epoch(TRY_CAST("CreateTime" AS TIMESTAMP)) AS BIGINT), 0) AS chat_time,
    coalesce("CreateTime", '') AS chat_time_str, coalesce(room_name, '') AS room, is_sender, is_forward,
    msg AS msg_content, record_hash
  FROM marked WHERE ok
), keyed AS (
  SELECT *, md5(source || chat_time || msg_content) AS id FROM docs
  QUALIFY row_number() OVER (PARTITION BY md5(source || chat_time || msg_content) ORDER BY source, row_no) = 1
)"""

_FULL = _with(_CHAT, _RECORDS)

_LIMIT = """own AS (
  SELECT source, least(length(msg_content), 200) AS len,
    row_number() OVER (PARTITION BY {part} ORDER BY least(length(msg_content), 200)) - 1 AS pos,
    count(*) OVER (PARTITION BY {part}) AS n
  FROM docs WHERE is_sender = 1
), pick AS (
  SELECT {part} AS g, max(n) AS n, max(CASE WHEN pos = least(floor(n * 90 / 100), n - 1) THEN len END) AS len FROM own GROUP BY 1
)"""

# ── textbook pages ───────────────────────────────────────────────────────────

_BOOK = f"""book AS (
  SELECT source || '.pdf' AS source, doc_id + 1 AS page, n_chars < 50 AS ocr,
    'NOTES' || {_NL} || 'Page ' || (doc_id + 1) || repeat({_NL}, 3) || '  ' ||
    CASE lang WHEN 'en' THEN 'Chapter ' || (doc_id + 1) || ' of ' || source
              WHEN 'fr' THEN '第' || (doc_id + 1) || '节 part ' || source
              WHEN 'de' THEN '1.' || (doc_id + 1) || ' part ' || source
              ELSE 'chapter ' || (doc_id + 1) END
    || ' ' || {_NL} || {_NL} || replace(text, {_NL}, {_NL} || {_NL}) || repeat({_NL}, 5)
    || 'Copyright © ' || source || {_NL} AS text
  FROM documents
)"""
_PLAIN_BOOK = f"""book AS (
  SELECT source, doc_id AS page, length({_strip('text')}) < 50 AS ocr,
    replace(text, {_NL}, {_NL} || {_NL}) AS text FROM documents
)"""


def _no_noise(x: str) -> str:
    for p in (
        "^Principle and Technology of Database\\s*$", "^NOTES\\s*$", "^Copyright\\s*©.*$", "^Page\\s+[0-9]+\\s*$",
    ):
        x = f"regexp_replace({x}, '(?m){p}', '', 'g')"
    return _strip(f"regexp_replace({x}, '\\n{{3,}}', {_NL} || {_NL}, 'g')")


_HEAD = "'^(第[一二三四五六七八九十0-9]+[章节]\\s+|[0-9]+\\.[0-9]+(\\.[0-9]+)?\\s+|(?i:chapter)\\s+[0-9]+)'"


def _kind(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, {_HEAD}) THEN "
        f"CASE WHEN contains({x}, '章') OR starts_with({x}, 'Chapter') THEN 'chapter' "
        f"WHEN contains({x}, '节') OR regexp_matches({x}, '^[0-9]+\\.[0-9]+') THEN 'section' END END"
    )


_HEADED = f"""clean AS (
  SELECT source, page, ocr, t AS text FROM (SELECT *, {_no_noise('text')} AS t FROM book) WHERE t <> ''
), lines AS (
  SELECT source, page, i, {_strip('parts[i]')} AS line
  FROM (SELECT source, page, string_split(text, {_NL}) AS parts,
          unnest(range(1, len(string_split(text, {_NL})) + 1)) AS i FROM clean)
), heads AS (
  SELECT source, page, i, line, {_kind('line')} AS kind FROM lines WHERE {_kind('line')} IS NOT NULL
), last_in_page AS (
  SELECT source, page, arg_max(line, i) FILTER (kind = 'chapter') AS ch, max(i) FILTER (kind = 'chapter') AS chi,
    arg_max(line, i) FILTER (kind = 'section') AS se, max(i) FILTER (kind = 'section') AS sei
  FROM heads GROUP BY source, page
), page_events AS (
  SELECT c.*, l.ch AS ch_event,
    CASE WHEN l.ch IS NOT NULL THEN CASE WHEN coalesce(l.sei, 0) > l.chi THEN l.se ELSE '' END ELSE l.se END AS se_event
  FROM clean c LEFT JOIN last_in_page l ON l.source = c.source AND l.page = c.page
), headed AS (
  SELECT source, page, ocr, text,
    coalesce(last_value(ch_event IGNORE NULLS) OVER w, '前言') AS chapter,
    coalesce(last_value(se_event IGNORE NULLS) OVER w, '') AS section
  FROM page_events
  WINDOW w AS (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""

_CHUNKED = f"""parts AS (
  SELECT source, page, list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda x: {_strip('x')}), lambda x: x <> '') AS ps
  FROM headed
), paras AS (
  SELECT source, page, i, ps[i] AS p, {_kind('ps[i]')} AS kind FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM parts)
), fold AS (
  SELECT source, page, ocr, CAST(0 AS BIGINT) AS i, '' AS cur, chapter, section, CAST(NULL AS VARCHAR) AS done FROM headed
  UNION ALL
  SELECT f.source, f.page, f.ocr, p.i,
    CASE WHEN length(f.cur) + length(p.p) + 1 > 1000
         THEN CASE WHEN length(f.cur) > 200 THEN right(f.cur, 200) || {_NL} || p.p ELSE p.p END
         WHEN f.cur <> '' THEN f.cur || {_NL} || p.p ELSE p.p END,
    CASE WHEN p.kind = 'chapter' THEN p.p ELSE f.chapter END,
    CASE WHEN p.kind = 'chapter' THEN '' WHEN p.kind = 'section' THEN p.p ELSE f.section END,
    CASE WHEN length(f.cur) + length(p.p) + 1 > 1000 AND f.cur <> '' THEN f.cur END
  FROM fold f JOIN paras p ON p.source = f.source AND p.page = f.page AND p.i = f.i + 1
), pieces AS (
  SELECT source, page, ocr, i, 0 AS last, chapter, section, done AS text FROM fold WHERE done IS NOT NULL
  UNION ALL
  SELECT source, page, ocr, i, 1, chapter, section, cur FROM fold f
  WHERE i = (SELECT len(ps) FROM parts q WHERE q.source = f.source AND q.page = f.page) AND {_strip('cur')} <> ''
), chunks AS (
  SELECT source, page, ocr, chapter, section, text, 'textbook' AS type,
    row_number() OVER (PARTITION BY source, page ORDER BY i, last) - 1 AS chunk_no
  FROM pieces
)"""


def _book_sql(book: str, *more: str) -> str:
    return _with(book, _HEADED, _CHUNKED, *more, recursive=True)


_OWNED = """keyed AS (
  SELECT *, md5(text) AS text_hash, md5(source || '|' || page || '|' || chunk_no || '|' || text) AS id FROM chunks
), open_chunks AS (
  SELECT * FROM keyed {where}
), fresh AS (
  SELECT o.* FROM open_chunks o JOIN (SELECT text_hash, min(source) AS owner FROM open_chunks GROUP BY 1) m
    ON m.text_hash = o.text_hash AND m.owner = o.source
)"""

# ── vectors and search ───────────────────────────────────────────────────────

_SIM = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
scored AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS sim,
    1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS cos_dist,
    list_distance(CAST(embedding AS DOUBLE[]), qv) ** 2 AS l2_dist
  FROM embeddings, q
)"""

_MEMORY = """memory AS (
  SELECT event_id AS id, event_id AS seq, 'u' || user_id || ': ' || event_type || ' ' || props AS content,
    event_type AS collection, 'u' || user_id AS talker, CAST(floor(epoch(ts)) AS BIGINT) AS chat_time,
    CASE WHEN event_type = 'view' THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS chat_time_str
  FROM events
)"""


def _mmr(k: int, fetch_k: int, dist: str = "cos_dist") -> str:
    return f"""cand AS (SELECT * FROM scored ORDER BY {dist}, id LIMIT {fetch_k}),
pair AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM cand a, cand b),
pickrun AS (
  SELECT 0 AS t, id, sim, CAST(NULL AS DOUBLE) AS near, CAST(NULL AS INTEGER) AS picked FROM cand
  UNION ALL
  SELECT x.t + 1, x.id, x.sim, greatest(x.near, p.s), CASE WHEN x.id = x.best THEN x.t + 1 ELSE x.picked END
  FROM (
    SELECT *, first_value(id) OVER (ORDER BY (picked IS NOT NULL),
        CASE WHEN near IS NULL THEN sim ELSE 0.6 * sim - 0.4 * near END DESC, sim DESC, id) AS best
    FROM pickrun
  ) x JOIN pair p ON p.a = x.id AND p.b = x.best
  WHERE x.t < {k}
),
hits AS (SELECT id, CAST(picked AS BIGINT) AS rank FROM pickrun WHERE t = {k} AND picked IS NOT NULL)"""


def _near(hits: str, minutes: int, per: int) -> str:
    w = minutes * 60
    return f"""near_all AS (
  SELECT h.rank AS anchor_rank, m.*, 1 - abs(m.chat_time - a.chat_time) / CAST({w} AS DOUBLE) AS proximity
  FROM {hits} h JOIN memory a ON a.id = h.id JOIN memory m ON m.chat_time BETWEEN a.chat_time - {w} AND a.chat_time + {w}
),
near AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_rank ORDER BY chat_time, seq) AS neighbour_pos
  FROM near_all
  QUALIFY row_number() OVER (PARTITION BY anchor_rank ORDER BY chat_time, seq) <= {per}
)"""


def _search(k: int = 15, minutes: int = 30, per: int = 8, cap: int = 50) -> str:
    return ",\n".join(
        (
            _SIM,
            _MEMORY,
            _mmr(k, max(4 * k, 60), "l2_dist"),
            _near("hits", minutes, per),
            f"""arrivals AS (
  SELECT m.id, m.content, m.chat_time, m.chat_time_str, 'semantic' AS result_source, CAST(1 AS DOUBLE) AS score, h.rank AS hit, 0 AS pos
  FROM hits h JOIN memory m ON m.id = h.id
  UNION ALL
  SELECT id, content, chat_time, chat_time_str, 'temporal', greatest(0, proximity) * CAST(0.5 AS DOUBLE), anchor_rank, neighbour_pos FROM near
),
firsts AS (
  SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY content ORDER BY hit, pos) = 1
),
found AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, hit, pos) AS rank FROM firsts
  QUALIFY row_number() OVER (ORDER BY score DESC, hit, pos) <= {cap}
)""",
        )
    )




def _hashed(source: str, key: str, text: str) -> str:
    """{source}_vectors (id, v): a vector in 64 places for each row, from its words one by one."""
    words = f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{C0}}-\\x{{24F}}]+|[^\\x00-\\x7F]')"
    return f"""{source}_codes AS (
  SELECT id, CAST('0x' || left(md5(w), 8) AS BIGINT) % 128 AS code FROM (SELECT {key} AS id, unnest({words}) AS w FROM {source})
), {source}_sums AS (
  SELECT id, b, coalesce(n, 0) AS n
  FROM (SELECT {key} AS id, unnest(range(64)) AS b FROM {source})
  LEFT JOIN (SELECT id, code % 64 AS b, sum(CASE WHEN code < 64 THEN 1 ELSE -1 END) AS n FROM {source}_codes GROUP BY 1, 2) USING (id, b)
), {source}_vectors AS (
  SELECT id, list(CASE WHEN size = 0 THEN 0 ELSE floor(n * CAST(1000 AS DOUBLE) / size + 0.5) END ORDER BY b) AS v
  FROM (SELECT *, sqrt(CAST(sum(n * n) OVER (PARTITION BY id) AS DOUBLE)) AS size FROM {source}_sums) GROUP BY id
)"""


_FOUND = "SELECT id, content, result_source, round(score, 6) AS score, rank FROM "

_BOOK_HITS = f"""{_SIM},
{_mmr(8, 40)},
stored AS (SELECT *, row_number() OVER (ORDER BY page, chunk_no) - 1 AS id FROM chunks),
passages AS (
  SELECT c.id, c.text AS content, c.source, c.page, c.chapter, c.section, h.rank AS r
  FROM stored c JOIN hits h ON h.id = c.id
),
results AS (
  SELECT *, row_number() OVER (ORDER BY r) AS rank FROM (
    SELECT * FROM passages QUALIFY row_number() OVER (PARTITION BY source, page, content ORDER BY r) = 1)
  QUALIFY row_number() OVER (ORDER BY r) <= 15
)"""

# ── model answers ────────────────────────────────────────────────────────────

_ANSWERS = f"""answers AS (
  SELECT d.doc_id,
    CASE lang WHEN 'en' THEN '[Retrieve] 否，是' WHEN 'fr' THEN '[Retrieve]是' WHEN 'de' THEN '不是'
      ELSE CASE WHEN quality = 1 THEN '无' END END AS routing,
    CASE lang
      WHEN 'en' THEN '[IsRel] ' || right(CAST(n_chars AS VARCHAR), 1) || ' ' || CASE WHEN n_chars > 500 THEN '相关' ELSE '不相关' END
        || {_NL} || '[IsRel]1 相关' || {_NL} || '[IsRel] 1 不相关' || {_NL}
      WHEN 'fr' THEN right(CAST(n_chars AS VARCHAR), 1) || '. ' || CASE WHEN n_chars > 500 THEN '相关' ELSE '不相关' END
        || {_NL} || ' 2: 不相关' || {_NL} || '77) 相关' || {_NL}
      WHEN 'de' THEN '段落' || right(CAST(n_chars AS VARCHAR), 1) || '：' || CASE WHEN n_chars > 500 THEN '相关' ELSE '不相关' END
        || {_NL} || '段落 88: 相关' || {_NL}
      ELSE 'No labels.' || {_NL} END
    || text
    || CASE quality WHEN 1 THEN {_NL} || '[IsSup] 完全支持' WHEN 0 THEN {_NL} || '[IsSup]无支持' ELSE '' END
    || CASE lang WHEN 'en' THEN {_NL} || '[IsUse] 5 points' WHEN 'fr' THEN {_NL} || '[IsUse] 1-5'
         WHEN 'de' THEN {_NL} || '[IsUse] 9' ELSE '' END
    || {_NL} || 'note [Retrieve] x' || {_NL} || '<s>end</s> [a' || {_NL} || 'b] <paragraph>p' || {_NL} || 'q</paragraph>' AS output
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def _pairs(pattern: str) -> str:
    return (
        f"list_zip(regexp_extract_all(output, '{pattern}', 1), regexp_extract_all(output, '{pattern}', 2))"
    )


_REL = "\\[IsRel\\]\\s*([0-9]+)\\s*(相关|不相关)"
_NUMLINE = "(?m)(?:^|\\n)\\s*([0-9]+)[.:)]\\s*(相关|不相关)"
_PARLINE = "段落\\s*([0-9]+)\\s*[：:]\\s*(相关|不相关)"
_SUP = "\\[IsSup\\]\\s*(完全支持|部分支持|无支持)"
_USE = "\\[IsUse\\]\\s*([0-9])"
_ANYTAG = "\\[(?:Retrieve|IsRel|IsSup|IsUse)\\][^\\n]*(?:\\n|$)"


def _untag(x: str) -> str:
    return f"regexp_replace({x}, '{_ANYTAG}', '', 'g')"


_GROUNDED = (
    f"list_filter(string_split(output, {_NL}), lambda x: NOT regexp_matches(x, '{_SUP}') "
    f"AND NOT regexp_matches(x, '{_USE}') AND NOT regexp_matches(x, '{_REL}'))"
)

_PERSONAS = """personas AS (
  SELECT c_custkey AS seq, 'p' || c_custkey AS id, c_name AS name, 'persona_' || lower(c_mktsegment) AS collection,
    c_acctbal > 0 AS own, c_nationkey AS n, c_mktsegment AS seg
  FROM customer WHERE c_custkey <> 0
)"""

ORACLES = {
    "valid_messages": _with(_CHAT) + "SELECT source, position, msg FROM valid",
    "cleaned_messages": _with(_CHAT) + 'SELECT source, position, "CreateTime", msg FROM cleaned',
    "cleaning_counts": _with(_CHAT) + "SELECT * FROM counts",
    "cleaning_totals": _with(_CHAT)
    + "SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(kept) AS BIGINT) AS kept, CAST(sum(total) - sum(kept) AS BIGINT) AS saved, "
    "round((sum(total) - sum(kept)) * 100.0 / sum(total), 1) AS saved_pct FROM counts",
    "normalised_records": _FULL
    + 'SELECT source, position, id, "MsgSvrID", type_name, is_sender, talker, msg, "CreateTime", src, room_name, is_forward, '
    "CAST(\"CreateTime\" IS NOT NULL AS BIGINT) AS has_time, CAST(room_name IS NOT NULL AS BIGINT) AS has_room, "
    "coalesce(type_name, 'text') AS msg_type FROM normal",
    "sparse_records": _FULL
    + "SELECT source, position, '{\"talker\":\"' || talker || '\",\"msg\":\"' || msg || '\",\"is_sender\":' || is_sender "
    "|| CASE WHEN \"CreateTime\" IS NOT NULL THEN ',\"CreateTime\":\"' || \"CreateTime\" || '\"' ELSE '' END "
    "|| CASE WHEN type_name IS NOT NULL THEN ',\"type_name\":\"' || type_name || '\"' ELSE '' END "
    "|| CASE WHEN is_forward IS NOT NULL THEN ',\"is_forward\":' || is_forward ELSE '' END || '}' AS record FROM normal",
    "numbered_records": _FULL + "SELECT source, position, row_no FROM numbered",
    "chat_documents": _FULL + "SELECT * FROM docs",
    "chat_times": "SELECT event_id, CASE event_type "
    "WHEN 'click' THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN 'view' THEN CAST(floor(epoch(ts)) AS BIGINT) "
    "WHEN 'purchase' THEN CAST(floor(epoch(ts)) AS BIGINT) - 28800 WHEN 'signup' THEN CAST(floor(epoch(ts)) AS BIGINT) "
    "ELSE CASE WHEN value < 10 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) ELSE 0 END END AS chat_time FROM events",
    "incremental_documents": _FULL
    + "SELECT source, row_no, record_hash FROM docs WHERE record_hash NOT IN (SELECT record_hash FROM docs WHERE source < '2024-01-16.csv')",
    "load_counts": _FULL
    + "SELECT source, count(*) AS records, count(*) FILTER (NOT ok) AS filtered, "
    "count(*) FILTER (ok AND source < '2024-01-16.csv') AS already_imported, "
    "count(*) FILTER (ok AND source >= '2024-01-16.csv') AS imported FROM marked GROUP BY source",
    "upsert_documents": _FULL + "SELECT id, source, row_no, content FROM keyed",
    "merged_collection": _FULL
    + "SELECT id, source, row_no, CASE WHEN source >= '2024-01-10.csv' THEN 'incoming' ELSE 'stored' END AS run FROM keyed",
    "merged_hashes": _FULL + "SELECT DISTINCT record_hash FROM docs",
    "reply_token_limit": _with(_CHAT, _RECORDS, _LIMIT.format(part="1"))
    + "SELECT n AS own_messages, len AS length_at_percentile, CAST(greatest(30, floor(len * 1.5)) AS BIGINT) AS max_tokens FROM pick",
    "reply_token_limits_by_file": _with(_CHAT, _RECORDS, _LIMIT.format(part="source"))
    + "SELECT s.source, coalesce(n, 0) AS own_messages, len AS length_at_percentile, "
    "CAST(CASE WHEN n IS NULL THEN 150 ELSE greatest(30, floor(len * 1.5)) END AS BIGINT) AS max_tokens "
    "FROM (SELECT DISTINCT source FROM docs) s LEFT JOIN pick ON pick.g = s.source",
    "cleaned_pages": _with(_BOOK, _HEADED)
    + "SELECT source, page, CAST(ocr AS BIGINT) AS ocr, md5(text) AS text_md5, length(text) AS chars FROM clean",
    "scanned_pages": f"SELECT doc_id, CAST(length({_strip('text')}) < 50 AS BIGINT) AS needs_ocr FROM documents",
    "page_headings": _with(_BOOK, _HEADED) + "SELECT source, page, chapter, section FROM headed",
    "page_chunks": _book_sql(_BOOK)
    + "SELECT source, page, chunk_no, chapter, section, type, md5(text) AS text_md5, length(text) AS chars FROM chunks",
    "new_chunks": _book_sql(
        _PLAIN_BOOK, _OWNED.format(where="WHERE text_hash NOT IN (SELECT text_hash FROM keyed WHERE source = 'src1')")
    )
    + "SELECT id, source, page, chunk_no, text_hash FROM fresh",
    "page_counts": _with(_BOOK, _HEADED)
    + "SELECT b.source, count(*) AS total_pages, count(c.page) AS valid_pages, count(*) FILTER (c.ocr) AS ocr_pages "
    "FROM book b LEFT JOIN clean c ON c.source = b.source AND c.page = b.page GROUP BY b.source",
    "chunk_import_summary": _book_sql(_PLAIN_BOOK, _OWNED.format(where=""))
    + "SELECT c.source, c.n AS chunks, coalesce(f.n, 0) AS selected, coalesce(f.ok, 0) AS imported, coalesce(f.n - f.ok, 0) AS failed "
    "FROM (SELECT source, count(*) AS n FROM chunks GROUP BY 1) c LEFT JOIN "
    "(SELECT source, count(*) AS n, count(*) FILTER (length(text) > 200) AS ok FROM fresh GROUP BY 1) f ON f.source = c.source",
    "nearest_cosine": _with(_SIM)
    + "SELECT id, round(cos_dist, 6) AS distance, row_number() OVER (ORDER BY cos_dist, id) AS rank FROM scored "
    "QUALIFY row_number() OVER (ORDER BY cos_dist, id) <= 20",
    "nearest_l2": _with(_SIM)
    + "SELECT id, round(l2_dist, 6) AS distance, row_number() OVER (ORDER BY l2_dist, id) AS rank FROM scored "
    "QUALIFY row_number() OVER (ORDER BY l2_dist, id) <= 20",
    "nearest_two": _with(_SIM, _MEMORY)
    + "SELECT s.id, m.talker, substr(m.content, 1, 100) AS preview, round(cos_dist, 6) AS distance, "
    "row_number() OVER (ORDER BY cos_dist, s.id) AS rank FROM scored s JOIN memory m ON m.id = s.id "
    "QUALIFY row_number() OVER (ORDER BY cos_dist, s.id) <= 2",
    "diverse_hits": _with(_SIM, _mmr(15, 60), recursive=True) + "SELECT id, rank FROM hits",
    "diverse_hits_wide": _with(_SIM, _mmr(50, 200), recursive=True) + "SELECT id, rank FROM hits",
    "chat_search": _with(_search(), recursive=True) + _FOUND + "found",
    "chat_search_wide": _with(_search(4, 240, 20, 45), recursive=True) + _FOUND + "found",
    "chat_context": _with(
        _search(),
        "out_lines AS (SELECT rank, CASE WHEN chat_time_str <> '' THEN '[' || chat_time_str || '] ' "
        "WHEN chat_time <> 0 THEN '[' || chat_time || '] ' ELSE '' END || content AS line FROM found)",
        "used AS (SELECT *, sum(length(line)) OVER (ORDER BY rank) AS total FROM out_lines)",
        recursive=True,
    )
    + f"SELECT string_agg(line, {_NL} ORDER BY rank) AS context, count(*) AS lines FROM used WHERE total <= 2000",
    "result_sources": _with(_search(), recursive=True)
    + "SELECT count(*) AS results, count(*) FILTER (result_source = 'semantic') AS semantic, "
    "count(*) FILTER (result_source = 'temporal') AS temporal FROM found",
    "chain_context": _with(_SIM, _MEMORY, _mmr(20, 80, "l2_dist"), recursive=True)
    + f"SELECT string_agg(m.content, {_NL} || {_NL} ORDER BY h.rank) AS context, count(*) AS lines FROM hits h JOIN memory m ON m.id = h.id",
    "time_neighbours": _with(
        _SIM, _MEMORY,
        "hits AS (SELECT id, row_number() OVER (ORDER BY cos_dist, id) AS rank FROM scored QUALIFY row_number() OVER (ORDER BY cos_dist, id) <= 20)",
        _near("hits", 30, 8),
    )
    + "SELECT anchor_rank, neighbour_pos, id, round(greatest(0, proximity), 6) AS proximity FROM near",
    "time_range": _with(_MEMORY)
    + "SELECT id, content, chat_time FROM memory WHERE chat_time BETWEEN 1705276800 AND 1705363200 ORDER BY seq LIMIT 30",
    "sender_sample": _with(_MEMORY, "head AS (SELECT * FROM memory ORDER BY seq LIMIT 200)")
    + "SELECT (SELECT count(*) FROM memory) AS total_records, count(*) AS sample_size, "
    "string_agg(DISTINCT talker, ',' ORDER BY talker) AS senders, "
    "CAST((SELECT count(*) FROM memory) > count(*) AS BIGINT) AS is_approximate FROM head",
    "sender_count": _with(_MEMORY) + "SELECT count(*) AS total_records, count(DISTINCT talker) AS unique_senders FROM memory",
    "collection_sizes": _with(_MEMORY) + "SELECT collection, count(*) AS total_records FROM memory GROUP BY collection",
    "write_batches": _with(_MEMORY)
    + "SELECT id, collection, (row_number() OVER (PARTITION BY collection ORDER BY seq) - 1) // 500 AS batch FROM memory",
    "book_search": _book_sql(_BOOK, _BOOK_HITS)
    + "SELECT id, source, page, chapter, section, md5(content) AS text_md5, rank FROM results",
    "book_context": _book_sql(
        _BOOK, _BOOK_HITS,
        "out_lines AS (SELECT rank, '【' || CASE WHEN chapter <> '' THEN chapter || ' > ' ELSE '' END || "
        f"CASE WHEN section <> '' THEN section || ' > ' ELSE '' END || '第' || page || '页】' || {_NL} || {_strip('content')} || {_NL} AS line FROM results)",
        "used AS (SELECT *, sum(length(line)) OVER (ORDER BY rank) AS total FROM out_lines)",
    )
    + f"SELECT string_agg(line, {_NL} ORDER BY rank) AS context, count(*) AS lines FROM used WHERE total <= 4000",
    "book_sources": _book_sql(
        _BOOK, _BOOK_HITS,
        "cited AS (SELECT chapter, min(rank) AS f, arg_min(section, rank) AS section, arg_min(source, rank) AS source, "
        "list_sort(list(DISTINCT CAST(page AS VARCHAR))) AS pages FROM results WHERE chapter <> '' GROUP BY chapter)",
    )
    + "SELECT row_number() OVER (ORDER BY f) AS source_no, chapter, section, "
    "array_to_string(pages[1:3], ', ') || CASE WHEN len(pages) > 3 THEN '...' ELSE '' END AS page, source "
    "FROM cited QUALIFY row_number() OVER (ORDER BY f) <= 3",
    "relevance_labels": _with(
        _ANSWERS,
        f"forms AS (SELECT doc_id, {_pairs(_REL)} AS a, {_pairs(_NUMLINE)} AS b, {_pairs(_PARLINE)} AS c FROM answers)",
        "bounded AS (SELECT doc_id, a, list_filter(b, lambda x: CAST(x[1] AS INTEGER) BETWEEN 1 AND 15) AS b, "
        "list_filter(c, lambda x: CAST(x[1] AS INTEGER) BETWEEN 1 AND 15) AS c FROM forms)",
        "chosen AS (SELECT doc_id, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END AS ps FROM bounded)",
        "flat AS (SELECT doc_id, i, CAST(ps[i][1] AS BIGINT) AS idx, ps[i][2] = '相关' AS rel FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM chosen))",
    )
    + "SELECT doc_id, idx, CAST(arg_max(rel, i) AS BIGINT) AS relevant FROM flat GROUP BY doc_id, idx",
    "answer_labels": _with(
        _ANSWERS,
        f"read AS (SELECT doc_id, coalesce(nullif(regexp_extract(output, '{_SUP}', 1), ''), '部分支持') AS is_sup, "
        f"greatest(1, least(5, coalesce(TRY_CAST(regexp_extract(output, '{_USE}', 1) AS BIGINT), 3))) AS is_use, "
        f"md5(nullif({_strip(_untag(_strip(f'array_to_string({_GROUNDED}, {_NL})')))}, '')) AS reply_md5 FROM answers)",
    )
    + "SELECT *, CAST(is_sup = '无支持' OR is_use < 3 AS BIGINT) AS retry FROM read",
    "stripped_answers": _with(_ANSWERS)
    + f"SELECT doc_id, md5({_untag('output')}) AS without_labels_md5, "
    + "md5("
    + _strip(
        "regexp_replace(replace(replace(regexp_replace(regexp_replace(output, '(?s)<paragraph>.*?</paragraph>', '', 'g'), "
        "'\\[[^\\n]*?\\]', '', 'g'), '<s>', ''), '</s>', ''), '[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', ' ', 'g')"
    )
    + ") AS without_markup_md5 FROM answers",
    "replies_between_labels": _with(
        _ANSWERS,
        f"split AS (SELECT doc_id, output, string_split(output, {_NL}) AS ls FROM answers)",
        f"a AS (SELECT *, coalesce(list_max(list_filter(range(1, len(ls) + 1), lambda i: regexp_matches(ls[i], '{_REL}'))), 0) AS start FROM split)",
        f"b AS (SELECT *, list_min(list_filter(range(start + 1, len(ls) + 1), lambda i: regexp_matches(ls[i], '{_SUP}') OR regexp_matches(ls[i], '{_USE}'))) AS stop FROM a)",
        f"c AS (SELECT *, {_strip(f'array_to_string(ls[start + 1:coalesce(stop - 1, len(ls))], {_NL})')} AS reply FROM b)",
    )
    + f"SELECT doc_id, md5(nullif({_strip(_untag('CASE WHEN reply <> {q} THEN reply ELSE output END'.format(q=chr(39) * 2)))}, '')) AS reply_md5 FROM c",
    "retrieval_decisions": _with(_ANSWERS)
    + "SELECT doc_id, CAST(CASE WHEN routing IS NULL THEN true ELSE "
    "coalesce(nullif(regexp_extract(routing, '\\[Retrieve\\]\\s*(是|否)', 1), '') = '是', contains(routing, '是')) END AS BIGINT) AS retrieve FROM answers",
    "relevant_results": _with(_search(20), recursive=True)
    + "SELECT f.id, f.content, f.result_source, round(f.score, 6) AS score, f.rank FROM found f "
    "LEFT JOIN labels l ON l.doc_id = f.id WHERE coalesce(l.quality = 1, true)",
    "numbered_passages": _with(_search(), recursive=True)
    + f"SELECT string_agg('[' || rank || '] ' || substr(replace({_strip('content')}, {_NL}, ' '), 1, 120), {_NL} ORDER BY rank) AS passages, "
    "count(*) AS lines FROM found WHERE rank <= 15",
    "upload_messages": _with(
        "files AS (SELECT doc_id, 'doc' || doc_id AS name, lang, n_chars * n_chars AS size, CASE WHEN lang = 'en' THEN text END AS content "
        "FROM documents WHERE n_chars * n_chars <= 10 * 1024 * 1024)",
        "sized AS (SELECT *, CASE WHEN size < 1024 THEN size || ' B' "
        "WHEN size < 1048576 THEN printf('%.1f KB', floor(size * 10 / 1024.0::DOUBLE + 0.5) / 10) "
        "ELSE printf('%.1f MB', floor(size * 10 / 1048576.0::DOUBLE + 0.5) / 10) END AS size_text FROM files)",
    )
    + f"SELECT doc_id, size_text, '用户上传了文件: ' || name || CASE WHEN content <> '' THEN {_NL} || '文件内容:' || {_NL} || substr(content, 1, 1000) "
    "ELSE ' (' || lang || ', ' || size_text || ')' END AS message FROM sized",
    "reflective_replies": _with(
        f"asked AS (SELECT conv_id || '-' || turn AS request_id, text, length(text) >= 100 AS searched, string_split(text, {_NL}) AS ls FROM conversations)",
        "each AS (SELECT request_id, i AS rank, ls[i] AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM asked WHERE searched))",
        f"kept AS (SELECT request_id, rank, {_strip('line')} AS line FROM each WHERE length(substr({_strip('line')}, 1, 120)) > 40)",
        "used AS (SELECT *, sum(length(line)) OVER (PARTITION BY request_id ORDER BY rank) AS total FROM kept)",
        "ctx AS (SELECT request_id, coalesce(sum(length(line)) FILTER (total <= 600), 0) "
        "+ greatest(count(*) FILTER (total <= 600) - 1, 0) AS chars FROM used GROUP BY request_id)",
    )
    + "SELECT a.request_id, CASE WHEN c.chars IS NULL THEN 'plain ' || length(text) "
    "ELSE 'grounded ' || (length('C:') + 1 + c.chars + 2 + length('S GROUNDED')) END AS reply, "
    "CASE WHEN c.chars IS NOT NULL THEN CASE WHEN length(text) > 800 THEN '无支持' ELSE '完全支持' END "
    "WHEN a.searched THEN '无支持' END AS is_sup, "
    "CAST(CASE WHEN c.chars IS NULL THEN 1 WHEN contains(text, 'ü') THEN 2 ELSE 5 END AS BIGINT) AS is_use, "
    "CAST(a.searched AND (c.chars IS NULL OR length(text) > 800 OR contains(text, 'ü')) AS BIGINT) AS retried "
    "FROM asked a LEFT JOIN ctx c ON c.request_id = a.request_id",
    "streamed_import": _with(_CHAT, _RECORDS, _hashed("keyed", "id", "content"))
    + "SELECT id, source, row_no, content, CAST(64 AS BIGINT) AS dim, "
    "array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ',') AS vector FROM keyed JOIN keyed_vectors USING (id)",
    "streamed_session_tail": "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role, text AS content FROM conversations "
    "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "session_tail": "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role, text AS content FROM conversations "
    "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3",
    "session_history": "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role FROM conversations "
    "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 40",
    "persona_parameters": _with(_PERSONAS)
    + "SELECT id, name, collection, CAST(CASE WHEN own AND n > 10 THEN n ELSE 50 END AS BIGINT) AS k, "
    "CAST(CASE WHEN own THEN n > 5 ELSE true END AS BIGINT) AS include_nearby, CAST(30 AS BIGINT) AS time_window_minutes, "
    "CAST(CASE WHEN own AND n < 20 THEN 4 ELSE 8 END AS BIGINT) AS nearby_per_result, CAST(50 AS BIGINT) AS max_total_results, "
    "CASE WHEN own AND seg = 'BUILDING' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS lambda_mult, "
    "CAST(CASE WHEN n > 12 THEN n + 100 ELSE 500 END AS BIGINT) AS max_tokens FROM personas",
    "persona_catalogue": "WITH late AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS priority, "
    "arg_max(o_totalprice, o_orderkey) FILTER (o_totalprice > 200000) AS price, "
    "arg_max(o_orderkey % 1000, o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS max_tokens FROM orders GROUP BY o_custkey) "
    "SELECT 'p' || c_custkey AS id, c_name AS name, "
    "CAST(coalesce(max_tokens, CASE WHEN c_acctbal > 0 THEN c_nationkey + 100 END) AS BIGINT) AS max_tokens, "
    "CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS tone, priority, CAST(price AS DOUBLE) AS price, "
    "CASE WHEN c_acctbal > 0 OR priority IS NOT NULL THEN concat_ws(',', CASE WHEN c_acctbal > 0 OR max_tokens IS NOT NULL THEN 'max_tokens' END, "
    "CASE WHEN price IS NOT NULL THEN 'price' END, CASE WHEN priority IS NOT NULL THEN 'priority' END, "
    "CASE WHEN c_acctbal > 0 THEN 'tone' END) END AS names "
    "FROM customer LEFT JOIN late ON c_custkey = o_custkey WHERE c_mktsegment <> 'MACHINERY'",
    "persona_requests": _with(_PERSONAS)
    + "SELECT o_orderkey, 'p' || o_custkey AS persona_id, coalesce(p.id, (SELECT id FROM personas ORDER BY seq LIMIT 1)) AS used_persona "
    "FROM orders LEFT JOIN personas p ON p.id = 'p' || o_custkey",
    "persona_stats": _with(_PERSONAS) + "SELECT collection, count(*) AS total_records FROM personas GROUP BY collection",
    "query_guards": f"SELECT conv_id, turn, CAST({_strip('q')} = '' AS BIGINT) AS blank, "
    "CAST(regexp_matches(q, '他|她|它|那个|那些|这个|这些') AS BIGINT) AS pronoun FROM (SELECT conv_id, turn, "
    "CASE WHEN length(text) < 60 THEN ' ' || chr(9) || '　' || chr(10) WHEN length(text) < 200 THEN text || '那些' "
    "WHEN role = 'user' THEN '他' || text ELSE text END AS q FROM conversations)",
    "message_previews": f"SELECT conv_id, turn, substr(replace({_strip('text')}, {_NL}, ' '), 1, 120) AS preview, "
    "CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 300) || '...(' || length(text) || '字)' END AS short, "
    f"CASE WHEN conv_id <> 0 THEN '[' || conv_id || '] ' ELSE '' END || {_strip('text')} AS line FROM conversations",
}

# Through files, the same rows.
ORACLES["csv_chat_documents"] = ORACLES["chat_documents"]
ORACLES["csv_cleaned"] = ORACLES["cleaned_messages"]
ORACLES["csv_cleaning_counts"] = ORACLES["cleaning_counts"]

_QUERIES = """q AS (
  SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE label = 0
), scored AS (
  SELECT query_id, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv) AS sim FROM embeddings, q
), near AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 1 - sim, id) AS rank FROM scored
)"""
ORACLES["batch_nearest"] = _with(_QUERIES) + "SELECT query_id, id, round(1 - sim, 6) AS distance, rank FROM near WHERE rank <= 10"
ORACLES["batch_search"] = _with(
    _QUERIES,
    "cand AS (SELECT * FROM near WHERE rank <= 40)",
    "pair AS (SELECT a.query_id, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM cand a JOIN cand b ON a.query_id = b.query_id)",
    """run AS (
  SELECT 0 AS t, query_id, id, sim, CAST(NULL AS DOUBLE) AS near, CAST(NULL AS INTEGER) AS picked FROM cand
  UNION ALL
  SELECT x.t + 1, x.query_id, x.id, x.sim, greatest(x.near, p.s), CASE WHEN x.id = x.best THEN x.t + 1 ELSE x.picked END
  FROM (
    SELECT *, first_value(id) OVER (PARTITION BY query_id ORDER BY (picked IS NOT NULL),
        CASE WHEN near IS NULL THEN sim ELSE 0.6 * sim - 0.4 * near END DESC, sim DESC, id) AS best
    FROM run
  ) x JOIN pair p ON p.query_id = x.query_id AND p.a = x.id AND p.b = x.best
  WHERE x.t < 8
)""",
    recursive=True,
) + "SELECT query_id, id, CAST(picked AS BIGINT) AS rank FROM run WHERE t = 8 AND picked IS NOT NULL"
ORACLES["all_time_neighbours"] = _with(_MEMORY) + """SELECT a.id AS anchor_id,
  row_number() OVER (PARTITION BY a.id ORDER BY m.chat_time, m.seq) AS neighbour_pos, m.id,
  round(1 - abs(m.chat_time - a.chat_time) / CAST(1800 AS DOUBLE), 6) AS proximity
FROM memory a JOIN memory m ON m.chat_time BETWEEN a.chat_time - 1800 AND a.chat_time + 1800 AND a.chat_time > 0
QUALIFY neighbour_pos <= 8"""
ORACLES["reimported_collection"] = _FULL + (
    "SELECT id, source, row_no, CASE WHEN source = '2024-01-16.csv' THEN 'again' WHEN source >= '2024-01-10.csv' THEN 'incoming' "
    "ELSE 'stored' END AS run FROM keyed"
)
ORACLES["streamed_live_sessions"] = (
    "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, role, text AS content FROM conversations c "
    "WHERE turn >= 3 OR conv_id % 3 <> 0 OR NOT EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.turn >= 3) "
    "QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3"
)
ORACLES["streamed_replies"] = (
    "WITH e AS (SELECT * FROM events WHERE NOT (ts < '2024-01-06' AND user_id % 10 = 0)) "
    "SELECT m.event_id AS message_id, r.event_id AS reply_id, 'u' || m.user_id AS talker FROM e m JOIN e r ON m.user_id = r.user_id "
    "AND m.event_type = 'click' AND r.event_type = 'purchase' AND r.ts > m.ts AND r.ts <= m.ts + INTERVAL 6 HOURS"
)
ORACLES["cleaning_report"] = _with(_CHAT) + (
    "SELECT *, CAST(0 AS BIGINT) AS is_total FROM counts UNION ALL "
    "SELECT NULL, CAST(sum(total) AS BIGINT), CAST(sum(filtered) AS BIGINT), CAST(sum(duplicates) AS BIGINT), CAST(sum(kept) AS BIGINT), "
    "round((sum(total) - sum(kept)) * 100.0 / sum(total), 1), 1 FROM counts"
)
ORACLES["tracked_import"] = ORACLES["incremental_documents"]
ORACLES["sender_sketch"] = _with(_MEMORY) + (
    "SELECT collection, count(*) AS records, count(DISTINCT talker) AS senders, CAST(1 AS BIGINT) AS close, CAST(1 AS BIGINT) AS as_rebuilt "
    "FROM memory GROUP BY collection"
)
ORACLES["book_answers"] = _book_sql(
    _BOOK,
    "stored AS (SELECT concat_ws('/', source, page, chunk_no) AS id, text FROM chunks)",
    _hashed("stored", "id", "text"),
    _hashed("benchmark", "item_id", "text"),
) + """SELECT q.id AS item_id, s.id AS chunk, list_sum(list_transform(list_zip(s.v, q.v), lambda p: (p[1] - p[2]) ** 2)) AS distance,
  row_number() OVER (PARTITION BY q.id ORDER BY list_sum(list_transform(list_zip(s.v, q.v), lambda p: (p[1] - p[2]) ** 2)), s.id) AS rank
FROM benchmark_vectors q, stored_vectors s QUALIFY rank <= 5"""
