"""SQL for the queries that SQL can express; the others are held against plain Python versions in tests/llm."""

_COMPONENTS = """
reach AS (SELECT id, id AS root FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
component AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

_ASSIGN = r'(?i)(password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)'
_KINDS = ((_ASSIGN, 2), ("AKIA[A-Z0-9]{16,}", 0), ("[0-9a-f]{24,}", 0), ("[A-Za-z0-9_-]{32,}", 0))
_MATCHES = " UNION ALL ".join(f"SELECT doc_id, src, {k} AS k, regexp_extract_all(t, '{p}') AS h, regexp_extract_all(t, '{p}', {g}) AS v, string_split_regex(t, '{p}') AS g FROM d" for k, (p, g) in enumerate(_KINDS))


def _lookup() -> str:
    """The table of op8 as SQL: which shard each slot belongs to doesn't depend on the data."""
    from gleaner.llm.queries import SHARDS
    from gleaner.llm.sharding import SLOTS, lookup_table

    table = ",".join(map(str, lookup_table(SHARDS)))
    return f"""
WITH t AS (SELECT string_split('{table}', ',') AS t), k AS (SELECT doc_id, CAST(('0x' || substring(md5(CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT % {SLOTS} AS BIGINT) AS slot FROM documents)
SELECT doc_id, slot, printf('shard-%03d', CAST(t.t[slot + 1] AS INTEGER)) AS shard FROM k, t"""


#: crc32 of UTF-8 text, from the table that its polynomial gives; `t` is a list of one row, named crc_table.
_CRC_TABLE = """crc_bits(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8)"""


def _crc32(text: str) -> str:
    bytes_ = f"[CAST('0x' || substring(hex(encode({text})), 2 * i - 1, 2) AS BIGINT) for i in range(1, octet_length(encode({text})) + 1)]"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bytes_}), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)"


def _framed(*values: str) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode(CAST({v} AS VARCHAR))) || ':' || {v} END" for v in values) + ")"


_UP = "[sha256(d[2 * i + 1] || coalesce(d[2 * i + 2], '')) for i in range(0, (len(d) + 1) // 2)]"


def _climb(name: str, levels: str, start: str) -> str:
    """Rows of `start` (id, g, i, h, o) climbed level by level: h and o are the digests from the tampered leaf, p the siblings."""
    sibling = "coalesce(l.d[CAST(xor(c.i, 1) AS BIGINT) + 1], '')"
    return f"""{name}(id, g, k, i, h, p) AS (SELECT id, g, 0, i, h, p FROM {start} UNION ALL
 SELECT c.id, c.g, c.k + 1, c.i // 2, sha256(CASE WHEN c.i % 2 = 0 THEN c.h || {sibling} ELSE {sibling} || c.h END), c.p || {sibling}
 FROM {name} c JOIN {levels} l ON l.g = c.g AND l.k = c.k WHERE len(l.d) > 1)"""


_MERKLE = f"""
WITH RECURSIVE {_CRC_TABLE},
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_framed('doc_id', 'source', 'lang', 'n_chars', 'text')} AS leaf,
  {_framed('doc_id', 'source', 'lang', "(n_chars + CASE WHEN %s %% 7 = 0 THEN 1 ELSE 0 END)" % _crc32('CAST(doc_id AS VARCHAR)'), 'text')} AS start FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS i FROM leaves),
level(g, k, d) AS (SELECT g, 0, list(leaf ORDER BY i) FROM placed GROUP BY g UNION ALL SELECT g, k + 1, {_UP} FROM level WHERE len(d) > 1),
sub AS (SELECT g, d[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS j FROM level WHERE len(d) = 1),
top_level(g, k, d) AS (SELECT '', 0, list(subroot ORDER BY j) FROM sub UNION ALL SELECT g, k + 1, {_UP} FROM top_level WHERE len(d) > 1),
low_start AS (SELECT doc_id AS id, g, i, start AS h, '' AS p FROM placed),
{_climb('low', 'level', 'low_start')},
top_start AS (SELECT x.id, '' AS g, j AS i, x.h, x.p FROM (SELECT * FROM low QUALIFY k = max(k) OVER (PARTITION BY id)) x JOIN sub USING (g)),
{_climb('high', 'top_level', 'top_start')},
folded AS (SELECT * FROM high QUALIFY k = max(k) OVER (PARTITION BY id)),
whole AS (SELECT d[1] AS root FROM top_level WHERE len(d) = 1)
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, h AS folded_root, h = root AS verified FROM placed JOIN sub USING (g) JOIN folded ON folded.id = doc_id, whole"""

_VARIANTS = f"""
WITH RECURSIVE {_CRC_TABLE},
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')) AS run FROM documents),
per_doc AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found GROUP BY ALL),
hashed AS (SELECT run, n, {_crc32('(d || run)')} AS h FROM per_doc, crc_table),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS word2, b.n AS n2 FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(word2 ORDER BY n2 DESC, word2) AS form, max(n2) AS form_n FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk(word, way, k) AS (SELECT word, word, 0 FROM formed UNION ALL SELECT w.word, f.form, k + 1 FROM walk w JOIN formed f ON f.word = w.way WHERE f.form IS NOT NULL)
SELECT f.word, form, r.root, n, n_near, form_n FROM formed f JOIN (SELECT word, last(way ORDER BY k) AS root FROM walk GROUP BY word) r USING (word)"""


ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) > 0)),
links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
nodes AS (SELECT vec_id AS id FROM embeddings),{_COMPONENTS},
counts AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN counts USING (id)""",
    "op4_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, greatest(2, len(w) - 3))]) END AS s FROM w),
flat AS (SELECT id, len(s) AS n, unnest(s) AS x FROM sets),
links1 AS (SELECT a.id AS a, b.id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT * FROM links1), nodes AS (SELECT doc_id AS id FROM documents),{_COMPONENTS}
SELECT id AS doc_id, len(s) AS n_shingles, component_id, id = component_id AS kept FROM component JOIN sets USING (id)""",
    "op6_secret_scans": f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS src, coalesce(text, '') AS t FROM documents), m AS ({_MATCHES}),
e AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m),
p AS (SELECT doc_id, src, k, v[i] AS v, CAST(list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in h[1:i - 1]]), 0) AS BIGINT) AS s, length(h[i]) AS n FROM e),
f AS (SELECT *, s + n AS z FROM p WHERE CASE k WHEN 0 THEN length(v) >= 6 WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') ELSE true END),
o AS (SELECT v, count(DISTINCT split_part(src, '/', 1)) < 3 AND count(DISTINCT src) < 6 AS live FROM f GROUP BY v),
every AS (SELECT f.*, live FROM f JOIN o USING (v) WHERE k < 3 OR (live AND NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_id = f.doc_id AND b.k < 3 AND b.s < f.z AND f.s < b.z))),
named AS (SELECT *, (['assign', 'access', 'hex', 'owned'])[k + 1] || ':' || s || ':' || z AS name FROM every)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, sha256(coalesce(string_agg(name, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256,
 coalesce(string_agg(name, ',' ORDER BY s, k), '') AS spans, count(*) FILTER (live) AS n_live FROM d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id""",
    "op8_sharding": _lookup(),
    "op12_merkle_manifest": _MERKLE,
    "op13_spelling_variants": _VARIANTS,
}
