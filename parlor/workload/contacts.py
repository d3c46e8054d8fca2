"""Registered queries on contacts, with their SQL twins."""

from pyspark.sql import functions as F

from parlor.functions import expr as X
from parlor.operators import contacts as C
from parlor.operators import trees
from parlor.plans.skew import paginate, top_in_groups
from parlor.workload.book import BOOK
from parlor.workload.fixtures import Tables

CANDIDATES = """SELECT c_custkey AS row_no, 'u' || CAST(c_custkey AS STRING) AS owner_id, 'u' || CAST((c_custkey * 3 + c_custkey % 8 + 1) % 150 AS STRING) AS entity,
  'F' || CAST((c_custkey * 3 + 2) % 150 AS STRING) AS firstname, 'L' || CAST((c_custkey * 3 + 2) % 150 AS STRING) AS lastname,
  CASE WHEN c_custkey % 2 = 0 THEN 'c' || CAST(c_custkey AS STRING) END AS contact_id FROM customer"""
KEYS = """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'u' || CAST(c_custkey AS STRING) WHEN c_custkey % 3 = 1
  THEN 'u' || CAST(c_custkey AS STRING) || '@d' || CAST(c_nationkey AS STRING) || '.example' ELSE 'x' || CAST(c_custkey AS STRING) END AS key FROM customer"""
PAIRS = """SELECT 'u' || CAST(o_custkey AS STRING) AS owner_id, 'u' || CAST((o_custkey * 3 + o_orderkey % 8 + 1) % 150 AS STRING) AS user_id FROM orders"""


def _args(t: Tables):
    return t.contact, t.contact_email, t.user_dir, t.contact_block


def _display(t: Tables):
    d = t.user_dir.select(F.col("id").alias("entity"), F.col("email").alias("d_email"))
    return (
        t.contact.join(C.default_email(t.contact_email), C.KEY, "left").join(d, "entity", "left")
        .select("owner_id", "id", X.display_name("surname", "firstname", "lastname", "ce_email", "d_email").alias("surname"),
                X.full_name("firstname", "lastname").alias("fullname"), F.col("surname").alias("given_surname"))
    )


QUERIES = {
    "display_name": _display,
    "prefix_search": lambda t: t.contact.where(X.any_starts_with(["firstname", "lastname", "surname"], " f12 ")).select("owner_id", "id"),
    "contains_search": lambda t: t.block.where(X.holds("hashtag", "-V1")).select("id", "hashtag"),
    "archived_option": lambda t: C.archived_option(t.contact, t.archive_entity, "archived").select("owner_id", "id", "status"),
    "paginate": lambda t: paginate(t.contact.select("owner_id", "id", "sys_id"), ["owner_id"], [F.col("sys_id").asc()], 2, 4),
    "dynamic_sort": lambda t: top_in_groups(
        _display(t).select("owner_id", "id", "surname"), ["owner_id"],
        [*C.sort_columns("NAME", "DESC", F.col("id"), F.col("surname")), F.col("id").asc()], 5, "place"),
    "contact_list": lambda t: C.contact_list(*_args(t)[:3], t.socket, t.contact_block, t.archive_entity),
    "contact_list_tagged": lambda t: C.contact_list(
        *_args(t)[:3], t.socket, t.contact_block, t.archive_entity, tagged=trees.tagged_below(t.tag, t.map_tag, "r1"), sort_by="name", order="asc", page=1, rows=3),
    "contact_search": lambda t: C.contact_search(*_args(t), "F1"),
    "contact_search_domain": lambda t: C.contact_search_domain(*_args(t), "s2"),
    "contact_pick": lambda t: C.contact_pick(
        *_args(t), "l", "paper", t.sql("SELECT DISTINCT email FROM user_dir WHERE domain_id < 5")),
    "contact_card": lambda t: C.contact_card(
        t.contact, t.contact_email, t.contact_phone, t.contact_address, t.map_tag, t.tag, t.user_dir, t.contact_block, t.archive_entity),
    "same_name": lambda t: C.same_name(t.contact, t.sql("SELECT owner_id, 'new' || id AS id, firstname || ' ' || lastname AS key FROM contact")),
    "block_flags": lambda t: C.block_flags(*_args(t)),
    "presence": lambda t: C.presence(t.contact, t.socket, t.user_dir),
    "presence_on_server": lambda t: C.presence_on_server(t.contact, t.socket, "srv1"),
    "contact_duplicates": lambda t: C.contact_duplicates(t.contact, t.sql(CANDIDATES)),
    "resolve_identity": lambda t: C.resolve_identity(t.sql(KEYS), t.user_dir),
    "contacts_of_identity": lambda t: C.contacts_of_identity(t.sql(KEYS), t.user_dir, t.contact),
    "room_contact": lambda t: C.room_contact(t.sql(PAIRS), *_args(t)),
    "blacklist_show": lambda t: C.blacklist_show(t.blacklist, t.user_dir, 1, 2),
    "invite_notifications": lambda t: C.invite_notifications(t.contact, t.user_dir),
    "invite_count": lambda t: C.invite_count(t.contact, t.user_dir),
    "contact_export": lambda t: C.contact_export(t.contact, t.contact_email, t.contact_phone, t.contact_address, t.user_dir),
}

_FLAGS = "by_me AS is_blocked, by_them AS is_blocked_me"
_USER = "CASE WHEN {} IS NULL THEN 0 ELSE 1 END AS is_user"
_VISIBLE = "status IN ('memory', 'sent', 'invitation', 'informed', 'accept', 'active')"
#: The list of a book, and what a search in it returns.
_LIST = f"""SELECT owner_id, id, entity, status, ctime, firstname, lastname, surname AS given_surname, shown AS surname, username, {_USER.format('person_id')}, {_FLAGS}, filed AS is_archived,
  CASE WHEN entity IN (SELECT uid FROM socket WHERE state = 'active') THEN connected ELSE 0 END AS online, 1 AS is_mycontact, 1 AS is_need_email, 'my_contact' AS type, sys_id
  FROM card WHERE {_VISIBLE} AND filed = 0"""
_FOUND = f"""owner_id, id AS contact_id, ifnull(ifnull(account_id, person_id), entity) AS id, ifnull(ifnull(account_mail, person_mail), own_mail) AS email, firstname, lastname, whole_name AS fullname,
  shown AS surname, status, {_USER.format('uid')}, CASE WHEN account_id IS NULL THEN 1 ELSE 0 END AS is_need_email, 1 AS is_mycontact, {_FLAGS}"""


def _like(key: str, *columns: str) -> str:
    return "(" + " OR ".join(f"lower({c}) LIKE '{key}%'" for c in columns) + ")"


def _json(rows: str, fields: list[str], order: str) -> str:
    one = "'{' || concat_ws(',', " + ", ".join(
        f"'\"{f.split(':')[0]}\":' || {'CAST(' + f.split(':')[0] + ' AS VARCHAR)' if f.endswith(':n') else chr(39) + chr(34) + chr(39) + ' || ' + f + ' || ' + chr(39) + chr(34) + chr(39)}"
        for f in fields) + ") || '}'"
    return f"COALESCE((SELECT '[' || string_agg(replace(chr(34) || replace({one}, chr(34), chr(92) || chr(34)) || chr(34), chr(0), ''), ',' ORDER BY {order}) || ']' FROM {rows}), '[]')"


ORACLES = {
    "display_name": f"WITH {BOOK} SELECT owner_id, id, shown AS surname, whole_name AS fullname, surname AS given_surname FROM card",
    "prefix_search": f"SELECT owner_id, id FROM contact WHERE {_like('f12', 'firstname', 'lastname', 'surname')}",
    "contains_search": "SELECT id, hashtag FROM block WHERE lower(hashtag) LIKE '%-v1%'",
    "archived_option": "SELECT c.owner_id, c.id, c.status FROM contact c JOIN archive_entity a ON (a.owner_id, a.entity_id) = (c.owner_id, c.id)",
    "paginate": "SELECT owner_id, id, sys_id FROM (SELECT owner_id, id, sys_id, row_number() OVER (PARTITION BY owner_id ORDER BY sys_id) AS rn FROM contact) WHERE rn BETWEEN 5 AND 8",
    "dynamic_sort": f"""WITH {BOOK}, p AS (SELECT owner_id, id, shown, row_number() OVER (PARTITION BY owner_id ORDER BY shown DESC NULLS LAST, id) AS place FROM card)
      SELECT owner_id, id, shown AS surname, CAST(place AS INTEGER) AS place FROM p WHERE place <= 5""",
    "contact_list": f"WITH {BOOK} SELECT * EXCLUDE (sys_id) FROM ({_LIST})",
    "contact_list_tagged": f"""WITH RECURSIVE {BOOK}, below AS (SELECT 'r1' AS tag_id UNION ALL SELECT tag.tag_id FROM tag JOIN below ON tag.parent_tag_id = below.tag_id),
      marked AS (SELECT DISTINCT owner_id, id FROM map_tag JOIN below USING (tag_id)), l AS ({_LIST}),
      ranked AS (SELECT l.*, row_number() OVER (PARTITION BY l.owner_id ORDER BY surname NULLS FIRST, sys_id) AS place FROM l JOIN marked USING (owner_id, id))
      SELECT * EXCLUDE (sys_id, place) FROM ranked WHERE place <= 3""",
    "contact_search": f"WITH {BOOK} SELECT {_FOUND} FROM card WHERE {_VISIBLE} AND {_like('f1', 'firstname', 'lastname', 'surname', 'source')}",
    "contact_search_domain": f"""WITH {BOOK} SELECT owner_id, id, status, firstname, lastname, whole_name AS fullname, shown AS surname, surname AS given_surname, {_USER.format('uid')}, {_FLAGS},
      CASE WHEN firstname IS NULL AND lastname IS NULL THEN ifnull(own_mail, person_mail) END AS email, 1 AS is_mycontact, 1 AS is_need_email, 'my_contact' AS type
      FROM card WHERE {_VISIBLE} AND {_like('s2', 'firstname', 'lastname', 'surname', 'CASE WHEN firstname IS NULL AND lastname IS NULL THEN source ELSE ifnull(firstname, lastname) END')}""",
    "contact_pick": f"""WITH {BOOK}, q AS (SELECT {_FOUND} FROM card WHERE {_VISIBLE} AND status <> 'active' AND {_like('l', 'firstname', 'lastname', 'surname', 'source')})
      SELECT q.* FROM q WHERE q.email IS NOT NULL AND NOT EXISTS (SELECT 1 FROM user_dir d WHERE d.domain_id < 5 AND d.email = q.email)""",
    "contact_card": f"""WITH {BOOK}, places AS (SELECT *, json_extract_string(address, '$.street') AS street, json_extract_string(address, '$.city') AS city FROM contact_address),
      labels AS (SELECT m.owner_id, m.id, g.tag_id, g.name, g.position FROM map_tag m JOIN tag g USING (tag_id))
      SELECT c.owner_id, c.id, c.entity, c.uid, c.status, c.source, c.firstname, c.lastname, c.surname AS given_surname, c.shown AS surname, c.ctime, c.mtime, ifnull(c.connected, -1) AS connected, c.username, c.domain_id,
      {_USER.format('c.person_id')}, 1 AS is_need_email, c.by_me AS is_blocked, c.by_them AS is_blocked_me, c.filed AS is_archived, CAST(1 AS BIGINT) AS part,
      {_json("contact_email x WHERE x.owner_id = c.owner_id AND x.contact_id = c.id", ["id", "email", "category", "is_default:n"], "x.sys_id")} AS emails,
      {_json("contact_phone x WHERE x.owner_id = c.owner_id AND x.contact_id = c.id", ["id", "areacode", "phone", "category"], "x.sys_id")} AS phones,
      {_json("places x WHERE x.owner_id = c.owner_id AND x.contact_id = c.id", ["id", "street", "city", "category"], "x.sys_id")} AS addresses,
      {_json("labels x WHERE x.owner_id = c.owner_id AND x.id = c.id", ["tag_id", "name", "position:n"], "x.tag_id")} AS tags
      FROM card c""",
    "same_name": """SELECT a.owner_id, 'new' || a.id AS id, arg_min(b.id, b.sys_id) AS contact_id FROM contact a JOIN contact b ON b.owner_id = a.owner_id
      AND a.firstname || ' ' || a.lastname = b.firstname || ' ' || b.lastname GROUP BY a.owner_id, a.id""",
    "block_flags": f"WITH {BOOK} SELECT owner_id, id, {_FLAGS} FROM card",
    "presence": """SELECT c.owner_id, c.uid, d.connected AS status, min_by(struct_pack(x := COALESCE(c.firstname, d.firstname)), c.sys_id).x AS firstname,
      min_by(struct_pack(x := COALESCE(c.lastname, d.lastname)), c.sys_id).x AS lastname FROM contact c JOIN user_dir d ON d.id = c.uid
      WHERE EXISTS (SELECT 1 FROM socket s WHERE s.uid = c.uid AND s.state = 'active') GROUP BY c.owner_id, c.uid, d.connected""",
    "presence_on_server": "SELECT c.owner_id, c.uid, c.firstname, s.id AS socket_id, s.server FROM contact c JOIN socket s ON s.uid = c.uid WHERE s.state = 'active' AND s.server = 'srv1'",
    "contact_duplicates": f"""WITH k AS ({CANDIDATES}) SELECT k.row_no, 'entity' AS found_by, arg_min(c.id, c.sys_id) AS contact_id FROM k JOIN contact c ON c.owner_id = k.owner_id AND c.entity = k.entity
      WHERE k.contact_id IS NULL OR c.id <> k.contact_id GROUP BY k.row_no
      UNION ALL SELECT k.row_no, 'name', arg_min(c.id, c.sys_id) FROM k JOIN contact c ON c.owner_id = k.owner_id AND c.firstname = k.firstname AND c.lastname = k.lastname
      WHERE k.contact_id IS NULL OR c.id <> k.contact_id GROUP BY k.row_no""",
    "resolve_identity": f"WITH k AS (SELECT DISTINCT key FROM ({KEYS}) z) SELECT k.key, d.id, d.email FROM k LEFT JOIN user_dir d ON d.id = k.key OR d.email = k.key",
    "contacts_of_identity": f"""WITH k AS (SELECT DISTINCT key FROM ({KEYS}) z), r AS (SELECT k.key, d.email FROM k LEFT JOIN user_dir d ON d.id = k.key OR d.email = k.key)
      SELECT DISTINCT r.key, c.owner_id, c.id, c.status FROM r JOIN contact c ON c.entity = r.key OR c.uid = r.key OR c.entity = r.email OR c.uid = r.email""",
    "room_contact": f"""WITH {BOOK}, p AS (SELECT DISTINCT owner_id, user_id FROM ({PAIRS}) z),
      theirs AS (SELECT DISTINCT owner_id, id FROM barred_me WHERE way = 'entity')
      SELECT p.owner_id, p.user_id, c.id AS contact_id, c.firstname, c.lastname, CASE WHEN c.id IS NULL THEN d.email ELSE c.shown END AS surname, ifnull(c.by_me, 0) AS is_blocked,
        CASE WHEN theirs.id IS NULL THEN 0 ELSE 1 END AS is_blocked_me
      FROM p JOIN user_dir d ON d.id = p.user_id LEFT JOIN card c ON (c.owner_id, c.entity) = (p.owner_id, p.user_id) LEFT JOIN theirs ON (theirs.owner_id, theirs.id) = (c.owner_id, c.id)""",
    "blacklist_show": """SELECT * EXCLUDE (rn) FROM (SELECT b.owner_id, d.id, d.email, json_extract_string(profile, '$.firstname') AS firstname, json_extract_string(profile, '$.lastname') AS lastname,
      json_extract_string(profile, '$.mobile') AS mobile, row_number() OVER (PARTITION BY b.owner_id ORDER BY json_extract_string(profile, '$.firstname') || ' ' || json_extract_string(profile, '$.lastname'), d.email) AS rn
      FROM blacklist b JOIN user_dir d ON d.email = b.email) WHERE rn <= 2""",
    "invite_notifications": """SELECT c.owner_id, c.id AS contact_id, d.id AS user_id, d.email, COALESCE(c.firstname, '') AS firstname, COALESCE(c.lastname, '') AS lastname, c.message, c.status,
      CASE WHEN json_extract_string(c.metadata, '$.is_auto') = '1' THEN d.fullname ELSE trim(COALESCE(c.firstname, '') || ' ' || COALESCE(c.lastname, '')) END AS fullname
      FROM contact c JOIN user_dir d ON d.id = c.entity WHERE c.status IN ('received', 'informed', 'invitation')""",
    "invite_count": """SELECT c.owner_id, count(*) AS count FROM contact c JOIN user_dir d ON d.id = c.entity WHERE c.status IN ('received', 'informed', 'invitation') GROUP BY c.owner_id""",
    "contact_export": f"""WITH p AS (SELECT contact_id, string_agg(phone || '---' || CASE WHEN category = 'prof' THEN 'WORK' ELSE 'HOME' END, ':::' ORDER BY sys_id) AS phone FROM contact_phone GROUP BY contact_id),
      a AS (SELECT contact_id, string_agg(address || '---' || CASE WHEN category = 'prof' THEN 'WORK' ELSE 'HOME' END, ':::' ORDER BY sys_id) AS address FROM contact_address GROUP BY contact_id),
      e AS (SELECT owner_id, email, arg_min(contact_id, sys_id) AS contact_id, arg_min(is_default, sys_id) AS is_default FROM contact_email GROUP BY owner_id, email)
      SELECT e.owner_id, e.contact_id, e.email, e.is_default, COALESCE(c.firstname, m.firstname) AS firstname, COALESCE(c.lastname, m.lastname) AS lastname, c.surname,
        'https://d' || m.domain_id || '/avatar/' || m.id AS avatar, COALESCE(c.firstname, m.firstname, '') || ' ' || COALESCE(c.lastname, m.lastname, '') AS fullname,
        p.phone, a.address, CAST(1 AS BIGINT) AS part
      FROM e JOIN contact c ON c.owner_id = e.owner_id AND c.id = e.contact_id LEFT JOIN user_dir m ON m.email = e.email LEFT JOIN p ON p.contact_id = c.id LEFT JOIN a ON a.contact_id = c.id""",
}
