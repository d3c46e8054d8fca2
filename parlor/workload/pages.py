"""Registered queries on search, pages, names and languages, with their SQL twins."""

from functools import reduce

from pyspark.sql import functions as F

from parlor.operators import pages as P
from parlor.operators import search as S
from parlor.workload.fixtures import Tables

DOCS = "SELECT source AS hub_id, doc_id AS nid, text FROM documents"
ASK = "SELECT item_id AS query_id, text AS string FROM benchmark"
TAGS = "SELECT source AS hub_id, doc_id AS nid, lang || ' ' || source AS hashtag FROM documents"
COPIES = "SELECT o_orderkey AS seq, 'page-' || CAST(o_orderkey % 9 AS STRING) AS base FROM orders"
NEW_TAGS = "SELECT DISTINCT 0 AS scope, c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'new (' || CAST(c_custkey % 40 AS STRING) || ')' WHEN c_custkey % 3 = 1 THEN 'new' ELSE c_mktsegment END AS name FROM customer"
OLD_TAGS = """SELECT 0 AS scope, 'new (' || CAST(p_partkey * 3 % 200 AS STRING) || ')' AS name FROM part UNION ALL SELECT 0, 'BUILDING' FROM region"""
OLD_FILES = """SELECT 'o' || CAST(o_orderkey % 20 AS STRING) AS parent_id, 'txt' AS extension, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'a(' || CAST(o_orderkey % 30 AS STRING) || ')' END AS user_filename FROM orders"""
NEW_FILES = """SELECT 'o' || CAST(o_orderkey % 25 AS STRING) AS parent_id, 'txt' AS extension, o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'a(' || CAST(o_orderkey % 50 AS STRING) || ')' ELSE 'a' END AS name
  FROM orders"""
GETS = """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 2 = 0 THEN 'b' || CAST(o_orderkey % 60 AS STRING) ELSE 'page-' || CAST(o_orderkey % 7 AS STRING) || '-v' || CAST(o_orderkey % 50 AS STRING) END AS key,
  CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS lang, CASE o_orderkey % 2 WHEN 0 THEN 'desktop' ELSE 'mobile' END AS device FROM orders"""
HUB_KEYS = "SELECT 'h' || CAST(s_suppkey AS STRING) AS hub_id, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ' NATION_1' END AS key FROM supplier"
ASSIGN = """SELECT o_orderkey AS request_id, 'u' || CAST(o_custkey AS STRING) AS owner_id, CASE WHEN o_orderkey % 3 = 0 THEN 'h' || CAST(o_orderkey % 50 AS STRING) ELSE 'c' || CAST(o_orderkey AS STRING) END AS entity_id,
  '["r' || CAST(o_orderkey % 6 AS STRING) || '","n' || CAST(o_orderkey % 26 AS STRING) || '"]' AS tags FROM orders"""
TRANSLATE = "SELECT DISTINCT p_type AS key_code, CASE WHEN length(p_type) % 2 = 0 THEN 'fr' ELSE 'en' END AS lang, 'T ' || p_type AS content FROM part"


def _index(t: Tables):
    return S.index_build(t.sql(DOCS))


def _published(t: Tables):
    parts = [P.published_filter(t.block_history, mode).select(F.lit(mode).alias("mode"), "serial", "status", "isonline") for mode in (0, 1, 2)]
    return reduce(lambda a, b: a.unionByName(b), parts)


QUERIES = {
    "index_build": _index,
    "index_build_new": lambda t: S.index_build(t.sql(DOCS), t.sql("SELECT source AS hub_id, doc_id AS nid FROM documents WHERE lang = 'fr'")),
    "word_search": lambda t: S.word_search(t.sql(ASK), _index(t), None),
    "top_hits": lambda t: S.word_search(t.sql(ASK), _index(t), 2, 10),
    "text_search": lambda t: S.text_search(t.sql(ASK), _index(t), t.sql(TAGS), page=1, rows=20),
    "revision_number": lambda t: P.revision_number(t.block_history),
    "current_revision": lambda t: P.current_revision(t.block_history),
    "published_filter": _published,
    "next_version": lambda t: P.next_version(t.sql(COPIES), t.block),
    "unique_names": lambda t: P.unique_names(t.sql(OLD_TAGS), t.sql(NEW_TAGS), ["scope"]),
    "unique_filenames": lambda t: P.unique_filenames(t.sql(OLD_FILES), t.sql(NEW_FILES)),
    "recent_distinct": lambda t: P.recent_distinct(t.used_fonts),
    "revision_log": lambda t: P.revision_log(t.block, t.block_history, t.user_dir, 9, 2001),
    "revision_log_page": lambda t: P.revision_log(t.block, t.block_history, t.user_dir, page=2, rows=7),
    "change_history": lambda t: P.change_history(t.block_history, t.hub_media, t.user_dir, "u1", start=1000000100),
    "block_with_author": lambda t: P.block_get(t.sql(GETS), t.block, t.block_history, t.user_dir),
    "block_list": lambda t: P.block_list(t.block, t.user_dir, page=2, rows=10),
    "languages_used": lambda t: P.languages_used(t.block_history),
    "active_bases": lambda t: P.active_bases(t.language),
    "installed_languages": lambda t: P.installed_languages(t.language, t.language_dir),
    "available_languages": lambda t: P.available_languages(t.sql(HUB_KEYS), t.language, t.language_dir),
    "tag_catalog": lambda t: P.tag_catalog(t.content_tag, t.block),
    "tag_catalog_by_lang": lambda t: P.tag_catalog_by_lang(t.content_tag, t.block, t.sql(TRANSLATE), "fr"),
    "tag_by_name": lambda t: t.content_tag.where("status = 'online'").join(t.block.select("id", "hashtag"), "id").select("id", "name", "hashtag", "rank"),
    "tag_assignments": lambda t: P.tag_assignments(t.sql(ASSIGN), t.tag, t.contact, t.sql("SELECT uid AS owner_id, hub_id FROM hub_member")),
    "table_fetch": lambda t: P.table_fetch(
        t.part, ["p_partkey", "p_name", "p_size"], [("p_size", ">=", 20), ("p_type", "like", "ECON%")], [("p_size", "desc"), ("p_partkey", "asc")], page=2),
}

_IDX = r"""idx AS (SELECT hub_id, nid, word, count(*) AS occurrence FROM (SELECT source AS hub_id, doc_id AS nid,
  unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL)"""
_HITS = rf"""{_IDX}, asked AS (SELECT DISTINCT item_id AS query_id, q FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[ ,.;:!%@/=+\-_#]+')) AS q FROM benchmark) WHERE q <> ''),
  voc AS (SELECT DISTINCT word FROM idx),
  m AS (SELECT q, word, strlen(q) * 10 + CASE WHEN q = word THEN 100 ELSE 0 END AS score FROM (SELECT DISTINCT q FROM asked) a JOIN voc ON starts_with(word, q)),
  w AS (SELECT query_id, word, max(score) AS score FROM asked JOIN m USING (q) WHERE score > 25 GROUP BY ALL),
  hits AS (SELECT query_id, hub_id, nid, CAST(score AS INTEGER) AS score, word FROM (SELECT w.query_id, i.hub_id, i.nid, w.score, w.word,
    row_number() OVER (PARTITION BY w.query_id, i.hub_id, i.nid ORDER BY w.score DESC, w.word) AS rn FROM w JOIN idx i ON i.word = w.word) WHERE rn = 1)"""
_TEXT = rf"""{_IDX}, wt AS (SELECT word, CAST(round(pow(log10((SELECT count(*) FROM (SELECT DISTINCT hub_id, nid FROM idx)) / count(*)), 2) * 1000000) AS BIGINT) AS weight FROM idx GROUP BY word),
  asked AS (SELECT DISTINCT query_id, word FROM (SELECT item_id AS query_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS word FROM benchmark) WHERE word <> ''),
  s1 AS (SELECT query_id, hub_id, nid, sum(occurrence * weight) AS score FROM asked JOIN wt USING (word) JOIN idx USING (word) GROUP BY ALL),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hub_id, nid) AS rn FROM s1) WHERE rn <= 3),
  gain AS (SELECT t.query_id, i.word, sum(i.occurrence * wt.weight) AS gain FROM top t JOIN idx i ON i.hub_id = t.hub_id AND i.nid = t.nid JOIN wt ON wt.word = i.word
    WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.query_id = t.query_id AND a.word = i.word) GROUP BY ALL),
  more AS (SELECT query_id, word FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, word) AS rn FROM gain) WHERE rn <= 5),
  s2 AS (SELECT query_id, hub_id, nid, sum(occurrence * weight) AS score FROM (SELECT * FROM asked UNION ALL SELECT * FROM more) JOIN wt USING (word) JOIN idx USING (word) GROUP BY ALL),
  nm AS (SELECT hub_id, nid, unnest(regexp_split_to_array(lower(hashtag), '[^\p{{L}}\p{{N}}]+')) AS w FROM ({TAGS}) z),
  s3 AS (SELECT a.query_id, nm.hub_id, nm.nid, count(DISTINCT a.word) AS s2 FROM asked a JOIN nm ON starts_with(nm.w, a.word) WHERE nm.w <> '' GROUP BY ALL),
  f AS (SELECT COALESCE(s2.query_id, s3.query_id) AS query_id, COALESCE(s2.hub_id, s3.hub_id) AS hub_id, COALESCE(s2.nid, s3.nid) AS nid, CAST(COALESCE(s2.score, 0) AS BIGINT) AS s1, COALESCE(s3.s2, 0) AS s2
    FROM s2 FULL JOIN s3 ON s3.query_id = s2.query_id AND s3.hub_id = s2.hub_id AND s3.nid = s2.nid)"""

# the k-th later request of a name takes the k-th number that nobody has, which is at most k plus the names taken
_NAMES = """ex AS (SELECT DISTINCT {keys}, name FROM ({old}) o), fs AS (SELECT {keys}, name, min(seq) AS seq FROM ({new}) n GROUP BY ALL),
  lit AS (SELECT fs.* FROM fs WHERE NOT EXISTS (SELECT 1 FROM ex WHERE {same_ex} AND ex.name = fs.name)),
  tk AS (SELECT {keys}, name FROM ex UNION SELECT {keys}, name FROM lit),
  rest AS (SELECT n.*, row_number() OVER (PARTITION BY {nkeys}, n.name ORDER BY n.seq) AS k FROM ({new}) n WHERE NOT EXISTS (SELECT 1 FROM lit WHERE {same_lit} AND lit.seq = n.seq)),
  num AS (SELECT {rkeys}, r.name, i, row_number() OVER (PARTITION BY {rkeys}, r.name ORDER BY i) AS k
    FROM (SELECT {keys}, name, unnest(range(1, count(*) + (SELECT count(*) FROM tk) + 1)) AS i FROM rest GROUP BY {keys}, name) r
    WHERE NOT EXISTS (SELECT 1 FROM tk WHERE {same_tk} AND tk.name = r.name || '{gap}(' || i || ')'))"""

ORACLES = {
    "index_build": f"WITH {_IDX} SELECT * FROM idx",
    "index_build_new": f"WITH {_IDX} SELECT * FROM idx WHERE nid NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')",
    "word_search": f"WITH {_HITS} SELECT * FROM hits",
    "top_hits": f"WITH {_HITS} SELECT query_id, hub_id, nid, score, word FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hub_id, nid) AS rn FROM hits) WHERE rn BETWEEN 11 AND 20",
    "text_search": f"WITH {_TEXT} SELECT query_id, hub_id, nid, s1, s2 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, s1 DESC, hub_id, nid) AS rn FROM f WHERE s1 > 0 OR s2 > 0) WHERE rn <= 20",
    "revision_number": "SELECT serial, master_id, 'v' || row_number() OVER (PARTITION BY master_id ORDER BY serial) AS version FROM block_history",
    "current_revision": """SELECT serial, master_id, lang, CASE WHEN row_number() OVER (PARTITION BY master_id, lang ORDER BY serial DESC) = 1 THEN 'draft' ELSE 'history' END AS status,
      CASE WHEN isonline = 1 AND serial = max(serial) FILTER (isonline = 1) OVER (PARTITION BY master_id, lang) THEN 1 ELSE 0 END AS isonline,
      max(serial) OVER (PARTITION BY master_id) AS active FROM block_history""",
    "published_filter": """SELECT CAST(m AS INTEGER) AS mode, serial, status, isonline FROM block_history JOIN (SELECT unnest([0, 1, 2]) AS m) x
      ON (m = 0 AND status = 'draft') OR (m = 1 AND isonline = 1) OR (m = 2 AND (status = 'draft' OR isonline = 1))""",
    "next_version": f"""SELECT seq, base || '-v' || (COALESCE((SELECT max(TRY_CAST(regexp_extract(b.hashtag, '-v([0-9]+)$', 1) AS BIGINT)) FROM block b WHERE regexp_extract(b.hashtag, '^(.*)-v[0-9]+$', 1) = r.base), -1)
      + row_number() OVER (PARTITION BY base ORDER BY seq)) AS hashtag FROM ({COPIES}) r""",
    "unique_names": "WITH " + _NAMES.format(
        keys="scope", nkeys="n.scope", rkeys="r.scope", old=OLD_TAGS, new=NEW_TAGS, gap=" ", same_ex="ex.scope = fs.scope", same_lit="lit.scope = n.scope", same_tk="tk.scope = r.scope")
    + """ SELECT scope, seq, name, name AS unique_name FROM lit UNION ALL SELECT r.scope, r.seq, r.name, r.name || ' (' || num.i || ')' FROM rest r JOIN num ON num.scope = r.scope AND num.name = r.name AND num.k = r.k""",
    "unique_filenames": f"""WITH ex AS (SELECT DISTINCT parent_id, extension, user_filename AS name FROM ({OLD_FILES}) o), nw AS ({NEW_FILES}),
      lit AS (SELECT parent_id, extension, name, min(seq) AS seq FROM nw WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.parent_id = nw.parent_id AND ex.name = nw.name) GROUP BY ALL),
      tk AS (SELECT parent_id, name FROM ex UNION SELECT parent_id, name FROM lit),
      rest AS (SELECT *, row_number() OVER (PARTITION BY parent_id, base ORDER BY seq) AS k FROM (SELECT parent_id, extension, seq, regexp_replace(name, '\\([0-9]+\\)$', '') AS base FROM nw
        WHERE NOT EXISTS (SELECT 1 FROM lit WHERE lit.parent_id = nw.parent_id AND lit.seq = nw.seq))),
      num AS (SELECT r.parent_id, r.base, i, row_number() OVER (PARTITION BY r.parent_id, r.base ORDER BY i) AS k
        FROM (SELECT parent_id, base, unnest(range(1, count(*) + (SELECT count(*) FROM tk) + 1)) AS i FROM rest GROUP BY parent_id, base) r
        WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.parent_id = r.parent_id AND tk.name = r.base || '(' || i || ')'))
      SELECT parent_id, extension, seq, name AS unique_name FROM lit
      UNION ALL SELECT r.parent_id, r.extension, r.seq, r.base || '(' || num.i || ')' FROM rest r JOIN num ON num.parent_id = r.parent_id AND num.base = r.base AND num.k = r.k""",
    "recent_distinct": """SELECT owner_id, name, sys_id, ctime, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY sys_id DESC) AS place FROM used_fonts u
      WHERE sys_id = (SELECT max(sys_id) FROM used_fonts v WHERE v.owner_id = u.owner_id AND v.name = u.name)) WHERE place <= 3""",
    "revision_log": """SELECT h.master_id, b.hashtag, h.lang, h.device, h.author_id, h.serial, h.ctime, d.firstname, d.lastname, CASE WHEN h.serial = b.active THEN 1 ELSE 0 END AS active, h.status, h.isonline
      FROM block_history h JOIN block b ON b.id = h.master_id LEFT JOIN user_dir d ON d.id = h.author_id WHERE month(make_timestamp(h.ctime * 1000000)) = 9 AND year(make_timestamp(h.ctime * 1000000)) = 2001""",
    "revision_log_page": """SELECT * EXCLUDE (rn) FROM (SELECT h.master_id, b.hashtag, h.lang, h.device, h.author_id, h.serial, h.ctime, d.firstname, d.lastname, CASE WHEN h.serial = b.active THEN 1 ELSE 0 END AS active, h.status, h.isonline,
      row_number() OVER (PARTITION BY h.master_id, h.lang, h.device ORDER BY h.ctime DESC, h.serial DESC) AS rn FROM block_history h JOIN block b ON b.id = h.master_id LEFT JOIN user_dir d ON d.id = h.author_id) WHERE rn BETWEEN 8 AND 14""",
    "change_history": """SELECT x.*, d.email, d.firstname, d.lastname FROM (
      SELECT serial AS history_id, master_id AS item_id, lang, device, status, isonline, ctime, 'block' AS type, 'saved' AS modification, author_id AS user_id,
        'v' || row_number() OVER (PARTITION BY master_id ORDER BY serial) AS version FROM block_history
      UNION ALL SELECT sys_id, id, '', '', '', 0, upload_time, category, 'uploaded', owner_id, 'v1' FROM hub_media) x JOIN user_dir d ON d.id = x.user_id WHERE lower(d.email) LIKE 'u1%' AND ctime >= 1000000100""",
    "block_with_author": f"""WITH j AS (SELECT r.request_id, b.id, b.active, b.hashtag, b.type, b.mtime, b.author_id, EXISTS (SELECT 1 FROM block_history h WHERE h.master_id = b.id AND h.lang = r.lang AND h.device = r.device) AS ok
      FROM ({GETS}) r JOIN block b ON b.id = r.key OR b.hashtag = r.key)
      SELECT request_id, j.id, CASE WHEN ok THEN active END AS active, CASE WHEN ok THEN hashtag END AS hashtag, CASE WHEN ok THEN type END AS type, CASE WHEN ok THEN firstname END AS firstname,
        CASE WHEN ok THEN lastname END AS lastname, CASE WHEN ok THEN mtime END AS mtime FROM j LEFT JOIN user_dir d ON d.id = j.author_id""",
    "block_list": """SELECT * FROM (SELECT b.*, d.firstname, d.lastname, CAST(row_number() OVER (PARTITION BY type ORDER BY mtime DESC, b.id) AS INTEGER) AS place FROM block b LEFT JOIN user_dir d ON d.id = b.author_id) WHERE place BETWEEN 11 AND 20""",
    "languages_used": "SELECT DISTINCT master_id, lang FROM block_history",
    "active_bases": "SELECT hub_id, string_agg(base, ':' ORDER BY base) AS languages FROM (SELECT DISTINCT hub_id, base FROM language WHERE state = 'active') GROUP BY hub_id",
    "installed_languages": """SELECT l.hub_id, l.sys_id AS language_id, l.base, d.name, d.locale, l.state, CASE WHEN l.sys_id = min(l.sys_id) OVER (PARTITION BY l.hub_id) THEN 1 ELSE 0 END AS is_base
      FROM language l JOIN language_dir d ON d.base = l.base WHERE l.state IN ('active', 'replaced')""",
    "available_languages": f"""SELECT r.hub_id, d.base, d.name, d.locale FROM ({HUB_KEYS}) r JOIN language_dir d ON starts_with(lower(d.name), lower(trim(r.key)))
      WHERE NOT EXISTS (SELECT 1 FROM language l WHERE l.hub_id = r.hub_id AND l.base = d.base AND l.state IN ('active', 'replaced'))""",
    "tag_catalog": """SELECT c.name, c.description AS content, CAST(1 AS BIGINT) AS part, string_agg(b.hashtag, ' ' ORDER BY c.sys_id) AS ids FROM content_tag c JOIN block b ON b.id = c.id WHERE c.status = 'online' GROUP BY c.name, c.description""",
    "tag_catalog_by_lang": f"""WITH g AS (SELECT c.name, c.description, string_agg(b.hashtag, ' ' ORDER BY c.sys_id) AS ids FROM content_tag c JOIN block b ON b.id = c.id WHERE c.status = 'online' GROUP BY c.name, c.description)
      SELECT g.name, g.ids, CAST(1 AS BIGINT) AS part, g.description, t.content, (SELECT min(group_rank) FROM content_tag x WHERE x.name = g.name) AS rank FROM g LEFT JOIN ({TRANSLATE}) t ON t.key_code = g.name AND t.lang = 'fr'""",
    "tag_by_name": "SELECT c.id, c.name, b.hashtag, c.rank FROM content_tag c JOIN block b ON b.id = c.id WHERE c.status = 'online'",
    "tag_assignments": f"""SELECT request_id, owner_id, entity_id, CASE WHEN NOT EXISTS (SELECT 1 FROM tag WHERE tag_id = json_extract_string(tags, '$[0]')) OR NOT EXISTS (SELECT 1 FROM tag WHERE tag_id = json_extract_string(tags, '$[1]')) THEN 'TAG_NOT_FOUND'
      WHEN NOT EXISTS (SELECT 1 FROM contact c WHERE c.owner_id = r.owner_id AND c.id = r.entity_id) AND NOT EXISTS (SELECT 1 FROM hub_member m WHERE m.uid = r.owner_id AND m.hub_id = r.entity_id) THEN 'INVALID_ENTITY' ELSE 'OK' END AS status
      FROM ({ASSIGN}) r""",
    "table_fetch": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 20 AND p_type LIKE 'ECON%' ORDER BY p_size DESC, p_partkey LIMIT 15 OFFSET 15",
}
