"""SQL (DuckDB) for the queries whose whole result SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN d.page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN d.page_id > first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""

CHAT = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text), '')) AS loss_sha256,
  CAST(sum(32 + length(coalesce(role, '')) + length(text) + len(regexp_extract_all(text, '[<\[]\\*(\|im_start\|>|\|im_sep\|>|\|im_end\|>|\|endoftext\|>|/?s>|unk>|/?INST\])'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

URLS = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) v(rule_host, rule_path, verdict)),
m AS (SELECT page_id, host, path, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
t(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.node, e.b FROM t JOIN e ON t.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM t GROUP BY 1)
SELECT node AS doc_id, coalesce(n, 0) AS n_shingles, component_id, node = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = node
"""

RULES = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS k FROM d WHERE len(w) >= 8)),
h AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
q AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(generate_series(k, k + 7)) AS i FROM h WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, source, text, x, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(x, '{WORD}')) AS nw FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{WORD}')),
f AS (SELECT source, line FROM l GROUP BY source, line HAVING count(DISTINCT text) > 20),
z AS (SELECT l.doc_id, count(*) - count(DISTINCT x) AS dup, CAST(sum(CASE WHEN f.line IS NOT NULL THEN nw ELSE 0 END) AS BIGINT) AS lost FROM l LEFT JOIN f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY 1),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(q.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM d LEFT JOIN q ON d.doc_id = q.doc_id LEFT JOIN z ON d.doc_id = z.doc_id),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - lost >= 0.3 * n_words AS kept FROM r
"""

#: CRC-32 of a string, which DuckDB lacks: a table of 256 steps, then a fold over the bytes.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def crc32(string: str) -> str:
    """The SQL of a string's checksum, beside the one row of CRC_TABLE."""
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen({string})), lambda i: CAST('0x' || substr(hex(encode({string})), 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INT)])))"


SPELLING = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
r AS (SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY 1, 2),
h AS (SELECT r, n, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h FROM r, crc),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS w, n FROM h),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(w) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
k AS (SELECT w, n, unnest(generate_series(1, length(w))) AS i FROM v),
x AS (SELECT w, n, i, substr(w, 1, i - 1) AS a, substr(w, i + 1) AS b FROM k),
d AS (SELECT DISTINCT w, n, a || b AS s FROM x),
p AS (SELECT x.w, y.w AS o, y.n FROM x JOIN x y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.w <> y.w
  UNION ALL SELECT d.w, v.w, v.n FROM d JOIN v ON d.s = v.w UNION ALL SELECT v.w, d.w, d.n FROM d JOIN v ON d.s = v.w),
q AS (SELECT w, count(*) AS n_near, arg_min(struct_pack(o := o, n := n), struct_pack(n := -n, o := o)) AS f FROM p GROUP BY 1),
g AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 5 * v.n THEN f.o END AS form, CASE WHEN f.n >= 5 * v.n THEN f.n END AS form_n FROM v LEFT JOIN q ON v.w = q.w),
t(word, root, form) AS (SELECT w, w, form FROM g UNION ALL SELECT t.word, g.w, g.form FROM t JOIN g ON g.w = t.form)
SELECT g.w AS word, g.form, t.root, g.n, n_near, form_n FROM g JOIN t ON t.word = g.w AND t.form IS NULL
"""

def _least(*ways: str) -> str:
    """The SQL of the cheapest of some ways {c: cost, a: audit, t: repaired}, ties by audit; nulls are no ways."""
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


def _way(of: str, cost: str, letter: str, said: str | None = None, when: str = "TRUE") -> str:
    text = f"list_append({of}.t, {said})" if said else f"{of}.t"
    return f"CASE WHEN {of} IS NOT NULL AND {when} THEN {{'c': {of}.c + {cost}, 'a': {of}.a || '{letter}', 't': {text}}} END"


_ADD_U = _least("y", _way("n", "2", "I", "'user:'"), _way("s", "2", "I", "'user:'"), _way("z", "2", "I", "'user:'"))
_ADD_A = _least("z", _way("y", "2", "I", "'assistant:'"))
_OPEN, _SAID = "fault NOT IN ('blank', 'duplicate')", "role || ':' || text"
_K = lambda of, initial: _way(of, "more", "K", _SAID, f"{_OPEN} AND starts_with(role, '{initial}')")
_R = lambda of, role: _way(of, "2 + more", "R", f"'{role}:' || text", _OPEN)

REPAIR = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, generate_series(1, 2) g(copy) WHERE h <> 0 AND (copy = 1 OR h = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
  lag(role) OVER (PARTITION BY conv_id ORDER BY k) AS prior FROM o),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (substr(prior, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows_ FROM f GROUP BY 1),
t AS (SELECT conv_id, 0::BIGINT AS k, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS n, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS s, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS y, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR[]) AS z FROM m
  UNION ALL SELECT conv_id, k, {_least(_way("n", "3", "D"))}, {_least(_way("s", "3", "D"), _K("n", "s"))},
    {_least(_way("y", "3", "D"), _K("n", "u"), _K("s", "u"), _K("z", "u"), _R("n", "user"), _R("s", "user"), _R("z", "user"))}, {_least(_way("z", "3", "D"), _K("y", "a"), _R("y", "assistant"))}
  FROM (SELECT f.conv_id, f.k, role, text, fault, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS more, n, s, y, {_ADD_A} AS z FROM (SELECT conv_id, k + 1 AS k, n, s, {_ADD_U} AS y, z FROM t) t JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.k = t.k)),
e AS (SELECT conv_id, {_least("n", "z")} AS w FROM (SELECT conv_id, k, n, {_ADD_A} AS z FROM (SELECT conv_id, k, n, s, {_ADD_U} AS y, z FROM t)) t WHERE k = (SELECT rows_ FROM m WHERE m.conv_id IS NOT DISTINCT FROM t.conv_id))
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.c, 0) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(array_to_string(w.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN m ON i.conv_id IS NOT DISTINCT FROM m.conv_id LEFT JOIN e ON i.conv_id IS NOT DISTINCT FROM e.conv_id
"""

VECTORS = """
WITH RECURSIVE f AS MATERIALIZED (SELECT vec_id, label, list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NOT NULL AND isfinite(x)) AS x, len(embedding) AS n FROM embeddings WHERE label IS NOT NULL),
v AS MATERIALIZED (SELECT vec_id, label, n, x, sqrt(list_inner_product(x, x)) AS r FROM f WHERE len(x) = n AND n > 0 AND list_max(list_transform(x, lambda y: abs(y))) > 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.n = b.n AND a.vec_id <> b.vec_id WHERE list_inner_product(a.x, b.x) >= 0.93 * (a.r * b.r)),
t(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT t.node, e.b FROM t JOIN e ON t.seen = e.a),
c AS (SELECT node, min(seen) AS component_id FROM t GROUP BY 1)
SELECT node AS vec_id, (SELECT count(*) FROM e WHERE a = node) AS n_links, component_id, node = component_id AS kept FROM c
"""

ORACLES = {"op2_warc": WARC, "op5_chat": CHAT, "op6_near_dedup": NEAR, "op7_url_filter": URLS, "op10_quality_rules": RULES, "op11_spelling": SPELLING, "op12_repair": REPAIR, "op13_vectors": VECTORS}
