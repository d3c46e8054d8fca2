"""DuckDB twins of the registered queries."""

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Quality rules up to the verdict; needs a relation ``d`` (doc_id, text, lang, source).
QUALITY = rf"""
w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 7], ' ')) AS c FROM p),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM v WHERE c > 1) GROUP BY 1),
s AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines FROM w LEFT JOIN r USING (doc_id)),
t AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(n_symbols * 1000 // nullif(n_words, 0), 0) AS symbols,
    coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS dup_lines, coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS repeats,
    coalesce(word_chars * 1000 // nullif(n_words, 0), 0) AS mean_length FROM s),
x AS (UNPIVOT (SELECT lang, source, symbols, dup_lines, repeats, mean_length FROM t WHERE NOT base_failed) ON symbols, dup_lines, repeats, mean_length INTO NAME rule VALUE v),
b AS (SELECT lang, source, rule, v - v % (1::BIGINT << greatest(length(bin(v)) - 7, 0)) AS v FROM x),
bg AS MATERIALIZED (SELECT lang, source, rule, v, count(*)::HUGEINT AS n FROM b GROUP BY ALL),
bl AS (SELECT lang, rule, v, sum(n)::HUGEINT AS n, (sum(sum(n)) OVER (PARTITION BY lang, rule))::HUGEINT AS total FROM bg GROUP BY lang, rule, v),
ba AS (SELECT rule, v, sum(n)::HUGEINT AS n, (sum(sum(n)) OVER (PARTITION BY rule))::HUGEINT AS total FROM bg GROUP BY rule, v),
gr AS (SELECT g.lang, g.source, g.rule, l.total AS nl, a.total AS na FROM (SELECT DISTINCT lang, source, rule FROM bg) g
    JOIN (SELECT DISTINCT lang, rule, total FROM bl) l ON l.rule = g.rule AND l.lang IS NOT DISTINCT FROM g.lang JOIN (SELECT DISTINCT rule, total FROM ba) a ON a.rule = g.rule),
u AS (SELECT gr.*, v, n * nl * na AS w FROM gr JOIN bg ON bg.rule = gr.rule AND bg.lang IS NOT DISTINCT FROM gr.lang AND bg.source IS NOT DISTINCT FROM gr.source
    UNION ALL SELECT gr.*, v, 100 * n * na FROM gr JOIN bl ON bl.rule = gr.rule AND bl.lang IS NOT DISTINCT FROM gr.lang
    UNION ALL SELECT gr.*, v, 100 * n * nl FROM gr JOIN ba ON ba.rule = gr.rule),
c AS (SELECT lang, source, rule, v, (sum(sum(w)) OVER (PARTITION BY lang, source, rule ORDER BY v))::HUGEINT AS seen, (sum(sum(w)) OVER (PARTITION BY lang, source, rule))::HUGEINT AS total
    FROM u GROUP BY lang, source, rule, v),
q AS (SELECT lang, source, rule, [min(v) FILTER (4 * seen >= total), min(v) FILTER (4 * seen >= 2 * total), min(v) FILTER (4 * seen >= 3 * total)] AS q,
    CASE rule WHEN 'symbols' THEN 100 WHEN 'dup_lines' THEN 250 WHEN 'repeats' THEN 150 ELSE 2000 END AS m FROM c GROUP BY lang, source, rule),
h AS (SELECT lang, source, max(CASE WHEN rule = 'symbols' THEN hi END) AS hs, max(CASE WHEN rule = 'dup_lines' THEN hi END) AS hd, max(CASE WHEN rule = 'repeats' THEN hi END) AS hr,
    max(CASE WHEN rule = 'mean_length' THEN hi END) AS hm, max(CASE WHEN rule = 'mean_length' THEN lo END) AS lm
    FROM (SELECT lang, source, rule, least(q[1] - 3 * (q[3] - q[1]), q[2] - m) AS lo, greatest(q[3] + 3 * (q[3] - q[1]), q[2] + m) AS hi FROM q) GROUP BY ALL),
judged AS (SELECT t.*, NOT base_failed AND coalesce(symbols <= hs, true) AND coalesce(dup_lines <= hd, true) AND coalesce(repeats <= hr, true)
    AND coalesce(mean_length <= hm, true) AND coalesce(mean_length >= lm, true) AS kept
    FROM t LEFT JOIN h ON t.lang IS NOT DISTINCT FROM h.lang AND t.source IS NOT DISTINCT FROM h.source)"""

#: Lines less those dropped; needs a relation ``d`` (doc_id, text).
LINES = r"""
ln AS (SELECT doc_id, generate_subscripts(s, 1) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM d)),
lk AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM ln),
lf AS (SELECT k, max(doc_id) AS keeper FROM lk WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
lm AS (SELECT lk.*, coalesce(lk.doc_id <> lf.keeper, false) AS gone FROM lk LEFT JOIN lf USING (k)),
deduped AS (SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM lm GROUP BY doc_id)"""

#: Words that stay after passages of 50 words are removed; needs a relation ``d`` (doc_id, text).
PASSAGES = rf"""
pw AS (SELECT doc_id, {_WORDS} AS w FROM d),
px AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM pw WHERE len(w) >= 50),
pm AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY md5(array_to_string(w[i:i + 49], ' '))) < doc_id AS hit FROM px),
pg AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM pm WHERE hit),
pl AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM pw),
cut AS (SELECT pl.doc_id, count(pg.i)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY pl.i) FILTER (pg.i IS NULL) AS kept
    FROM pl LEFT JOIN pg ON pg.doc_id = pl.doc_id AND pg.i = pl.i GROUP BY pl.doc_id)"""

#: Table of the 32-bit cyclic redundancy check, one row with a list.
_CRC_TABLE = "ct AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def _crc(text: str) -> str:
    """Checksum of a text of code points below 256, where ``ct`` is joined."""
    points = f"list_transform(string_split({text}, ''), lambda x: unicode(x)::BIGINT)"
    utf8 = f"flatten(list_transform({points}, lambda x: CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {utf8}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


_RUN = "string_agg(CASE WHEN n.pos = o.pos // (3 ** n.lv)::BIGINT THEN '|' ELSE n.h END, '' ORDER BY n.pos)"
#: Trees by levels; a run on the way up is the text of its nodes with a bar at its own place.
MERKLE = f"""WITH RECURSIVE {_CRC_TABLE},
t0 AS (SELECT *, CASE WHEN {_crc("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS received FROM documents, ct),
t1 AS (SELECT doc_id, source, {_leaf("text")} AS leaf, {_leaf("received")} AS checked FROM t0),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM t1),
nodes AS (SELECT 0 AS lv, source, pos, size, leaf AS h FROM l
    UNION ALL SELECT lv + 1, source, pos // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE size > 1 GROUP BY lv, source, pos // 3, size),
sub AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS (SELECT 0 AS lv, pos, size, h FROM sub UNION ALL SELECT lv + 1, pos // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE size > 1 GROUP BY lv, pos // 3, size),
s1 AS (SELECT o.source, o.pos, n.lv, {_RUN} AS run FROM l o JOIN nodes n ON n.source IS NOT DISTINCT FROM o.source AND n.size > 1 AND n.pos // 3 = o.pos // (3 ** (n.lv + 1))::BIGINT GROUP BY ALL),
s2 AS (SELECT o.source, n.lv + 1000 AS lv, {_RUN} AS run FROM sub o JOIN tops n ON n.size > 1 AND n.pos // 3 = o.pos // (3 ** (n.lv + 1))::BIGINT GROUP BY o.source, o.pos, n.lv),
steps AS (SELECT source, pos, list(run ORDER BY lv) AS runs FROM (SELECT * FROM s1 UNION ALL SELECT l.source, l.pos, lv, run FROM l JOIN s2 ON l.source IS NOT DISTINCT FROM s2.source) GROUP BY ALL),
f AS (SELECT doc_id, leaf, sub.h AS subroot, (SELECT h FROM tops WHERE size = 1) AS root, sha256(replace(coalesce(array_to_string(runs, ''), ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(checked, coalesce(runs, [])), lambda a, x: sha256(replace(x, '|', a))) AS folded_root
    FROM l JOIN sub ON l.source IS NOT DISTINCT FROM sub.source LEFT JOIN steps ON l.source IS NOT DISTINCT FROM steps.source AND l.pos = steps.pos)
SELECT *, folded_root = root AS verified FROM f"""

#: Near words meet by what is left of them without one letter.
SPELLING = f"""WITH RECURSIVE {_CRC_TABLE},
w0 AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
w1 AS (SELECT d, run, count(*) AS c FROM w0 WHERE length(run) >= 6 GROUP BY ALL),
w2 AS (SELECT run, c, {_crc("d || ':' || run")} AS h FROM w1, ct),
w3 AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM w2),
v AS (SELECT word, sum(c)::BIGINT AS n FROM w3 WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
dl AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS other FROM dl a JOIN dl b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word FROM dl a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word FROM dl a JOIN v b ON a.rest = b.word),
g AS (SELECT near.word, count(*) AS n_near, first(other ORDER BY v.n DESC, other) AS best, max(v.n) AS best_n FROM near JOIN v ON v.word = other GROUP BY 1),
f AS (SELECT v.word, CASE WHEN best_n >= 5 * v.n THEN best END AS form, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN g USING (word)),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at AND f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.at AND e.form IS NULL"""

ORACLES = {
    "op12_merkle": MERKLE,
    "op13_spelling": SPELLING,
    "op2_line_dedup": f"WITH d AS (SELECT doc_id, text FROM documents), {LINES} SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM deduped",
    "op10_substring_dedup": f"WITH d AS (SELECT doc_id, text FROM documents), {PASSAGES} "
    "SELECT pw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM pw LEFT JOIN cut USING (doc_id)",
    "op3_chat_formatting": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, contains(text, '</turn>') OR contains(text, '### ') OR contains(text, '\') AS b,
    contains(role, '</turn>') OR contains(role, '### ') OR contains(role, '\') OR contains(role, ': ') AS a FROM c),
n AS (SELECT *, 14 + CASE WHEN a OR b THEN length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), ': ', ':\ '))
    + length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ')) ELSE length(role) + length(text) END AS n FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n)::BIGINT AS formatted_chars FROM n GROUP BY conv_id""",
    "op4_url_filters": """WITH r(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT p.page_id, arg_max({'rule': rh || rp, 'verdict': v}, length(rh || rp)) AS x FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT p.page_id, host, path, x.rule AS rule, coalesce(x.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op5_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM k""",
    "op9_quality_rules": f"WITH d AS (SELECT doc_id, text, lang, source FROM documents), {QUALITY} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged",
}
