"""Registered queries on messages and rooms, with their SQL twins."""

from pyspark.sql import functions as F

from parlor.operators import messaging as M
from parlor.operators import presence as P
from parlor.workload.book import BOOK
from parlor.workload.fixtures import Tables

ROOMS = "SELECT m.uid AS owner_id, m.hub_id AS hub_id, h.name AS name, h.area AS area FROM hub_member m JOIN hub h ON h.id = m.hub_id"


def _unread(t: Tables):
    return M.unread_direct(t.channel, t.read_channel)


def _team(t: Tables):
    return M.unread_team(t.team_channel, t.team_read)


def _rooms(t: Tables, **options):
    return M.chat_rooms(
        t.contact, t.contact_email, t.user_dir, t.socket, t.contact_block, t.archive_entity, t.channel, t.read_channel, t.sql(ROOMS),
        t.team_channel, t.team_read, t.team_delete, **options)


def _forward(t: Tables):
    ask = t.sql("""SELECT 'q' || CAST(min(sys_id) AS STRING) AS request_id, hub_id,
        '["t' || CAST(min(sys_id) AS STRING) || '","t' || CAST(max(sys_id) AS STRING) || '"]' AS messages FROM team_channel GROUP BY hub_id""")
    return M.forward_messages(ask, t.team_channel)


QUERIES = {
    "unread_direct": _unread,
    "pages_to_read": lambda t: M.pages_to_read(_unread(t), 5),
    "unread_summary": lambda t: M.unread_summary(_unread(t)),
    "unread_summary_team": lambda t: M.unread_summary(_team(t), "uid", "hub_id"),
    "unread_team": _team,
    "unread_dashboard": lambda t: M.unread_dashboard(
        _unread(t), _team(t), t.contact, t.archive_entity, t.ticket, t.read_ticket_channel, t.user_dir),
    "unread_by_tag": lambda t: M.unread_by_tag(_unread(t), _team(t), t.contact, t.map_tag),
    "tag_counts": lambda t: M.tag_counts(t.owned_tag, M.unread_by_tag(_unread(t), _team(t), t.contact, t.map_tag)),
    "last_message": lambda t: M.last_message(t.channel),
    "last_team_message": lambda t: M.last_team_message(t.team_channel, t.hub_member, t.team_delete),
    "message_page": lambda t: M.message_page(t.channel, t.read_channel),
    "late_page": lambda t: M.late_page(t.channel, 2, 3),
    "message_metadata": lambda t: t.channel.select("owner_id", "sys_id", *M.message_columns()),
    "message_get_room": lambda t: M.message_get(
        t.team_channel, t.orders.select(F.concat(F.lit("t"), "o_orderkey").alias("message_id")), True).select("hub_id", "message_id", "is_seen"),
    "message_get_inbox": lambda t: M.message_get(
        t.channel, t.orders.select(F.concat(F.lit("m"), "o_orderkey").alias("message_id")), False).select("owner_id", "message_id", "is_seen"),
    "message_threads": lambda t: M.message_threads(t.thread_message, t.contact),
    "forward_messages": _forward,
    "message_attachments": lambda t: M.message_attachments(t.channel, t.hub_media),
    "delivery_status": lambda t: M.delivery_status(t.team_channel, t.team_read),
    "fully_deleted": lambda t: M.fully_deleted(t.delete_channel, t.hub_read_channel),
    "chat_rooms": lambda t: _rooms(t).drop("message", "metadata"),
    "chat_rooms_page": lambda t: _rooms(t, key="f1", flag="contact", option="active", page=2, rows=4).select("owner_id", "entity_id", "display", "message"),
    "group_chat_rooms": lambda t: M.group_chat_rooms(t.sql(ROOMS), t.team_channel, t.team_read, t.team_delete, "supplier#00000000"),
    "chat_room_info": lambda t: M.chat_room_info(
        _rooms(t), t.sql("SELECT owner_id, id AS key FROM contact WHERE sys_id % 3 = 0")).select("owner_id", "entity_id", "contact_id", "status", "room_count"),
    "presence_totals": lambda t: P.online_contacts(t.contact, t.socket),
}

_UNREAD = """unread AS (SELECT c.owner_id, c.entity_id, count(*) AS room_count FROM channel c
  JOIN read_channel r ON r.owner_id = c.owner_id AND r.entity_id = c.entity_id AND r.uid = r.owner_id
  WHERE c.author_id = c.entity_id AND c.sys_id > r.ref_sys_id GROUP BY ALL)"""
_TEAM = """teamun AS (SELECT r.hub_id, r.uid, count(c.sys_id) AS room_count FROM team_read r
  LEFT JOIN team_channel c ON c.hub_id = r.hub_id AND c.author_id <> r.uid AND c.sys_id > r.ref_sys_id GROUP BY ALL)"""
_TAGUN = """byt AS (SELECT owner_id, tag_id, CAST(sum(room_count) AS BIGINT) AS room_count FROM (
  SELECT u.owner_id, mt.tag_id, u.room_count FROM unread u JOIN contact c ON c.owner_id = u.owner_id AND c.uid = u.entity_id
    JOIN map_tag mt ON mt.id = c.id AND mt.owner_id = c.owner_id
  UNION ALL SELECT t.uid, mt.tag_id, t.room_count FROM teamun t JOIN map_tag mt ON mt.id = t.hub_id AND mt.owner_id = t.uid) GROUP BY ALL)"""
_LAST = """lastm AS (SELECT owner_id, entity_id, max(sys_id) AS ref_sys_id, left(arg_max(message, sys_id), 100) AS message, max(ctime) AS ctime,
  max_by(struct_pack(x := metadata), sys_id).x AS metadata,
  CASE WHEN max_by(struct_pack(x := attachment), sys_id).x IS NOT NULL THEN 1 ELSE 0 END AS is_attachment FROM channel GROUP BY owner_id, entity_id)"""
_LASTT = """lastt AS (SELECT m.hub_id, m.uid, max(c.sys_id) AS ref_sys_id FROM hub_member m
  LEFT JOIN (SELECT mm.hub_id, mm.uid, tc.sys_id FROM hub_member mm JOIN team_channel tc ON tc.hub_id = mm.hub_id
     WHERE NOT EXISTS (SELECT 1 FROM team_delete d WHERE d.hub_id = mm.hub_id AND d.uid = mm.uid AND d.ref_sys_id = tc.sys_id)) c
  ON c.hub_id = m.hub_id AND c.uid = m.uid GROUP BY m.hub_id, m.uid)"""
#: Rooms of the list: contacts who are users, chats without such a contact, and private rooms.
_ROOMLIST = f"""{_UNREAD}, {_TEAM}, {_LAST}, {_LASTT}, {BOOK},
people AS (SELECT card.*, CASE WHEN surname IS NULL AND firstname IS NULL AND lastname IS NULL THEN ifnull(own_mail, account_mail) ELSE shown END AS title FROM card WHERE account_id IS NOT NULL),
strangers AS (SELECT lastm.*, user_dir.fullname AS title FROM lastm JOIN user_dir ON user_dir.id = lastm.entity_id ANTI JOIN contact k ON k.owner_id = lastm.owner_id AND k.uid = lastm.entity_id),
shared AS (SELECT m.uid AS owner_id, m.hub_id, h.name AS title, lastt.ref_sys_id FROM hub_member m JOIN hub h ON h.id = m.hub_id AND h.area = 'private' JOIN lastt ON (lastt.hub_id, lastt.uid) = (m.hub_id, m.uid)),
listed AS (
  SELECT 'contact' AS flag, 'active' AS status, p.owner_id, p.account_id AS entity_id, p.owner_id AS hub_id, p.account_id AS user_id, p.id AS contact_id, p.id AS ak, p.firstname, p.lastname, p.title AS display,
    ifnull(unread.room_count, 0) AS room_count, lastm.message, lastm.ctime, ifnull(lastm.is_attachment, 0) AS is_attachment, p.by_me AS is_blocked, p.by_user AS is_blocked_me
  FROM people p LEFT JOIN lastm ON (lastm.owner_id, lastm.entity_id) = (p.owner_id, p.account_id) LEFT JOIN unread ON (unread.owner_id, unread.entity_id) = (p.owner_id, p.account_id)
  UNION ALL
  SELECT 'contact', CASE WHEN (s.owner_id, s.entity_id) IN (SELECT (owner_id, entity) FROM contact) THEN 'memory' ELSE 'nocontact' END, s.owner_id, s.entity_id, s.owner_id, NULL, NULL, s.entity_id, NULL, NULL, s.title,
    0, s.message, s.ctime, s.is_attachment, 0, 0 FROM strangers s
  UNION ALL
  SELECT 'share', 'active', s.owner_id, s.hub_id, s.hub_id, NULL, NULL, s.hub_id, NULL, NULL, s.title, ifnull(teamun.room_count, 0), left(t.message, 100), t.ctime, CASE WHEN t.attachment IS NULL THEN 0 ELSE 1 END, 0, 0
  FROM shared s LEFT JOIN teamun ON (teamun.hub_id, teamun.uid) = (s.hub_id, s.owner_id) LEFT JOIN team_channel t ON (t.hub_id, t.sys_id) = (s.hub_id, s.ref_sys_id)),
roomlist AS (SELECT listed.*, CASE WHEN (owner_id, ak) IN (SELECT (owner_id, entity_id) FROM archive_entity) THEN 1 ELSE 0 END AS is_archived,
  CASE WHEN user_id IN (SELECT uid FROM socket WHERE state = 'active') THEN 1 ELSE 0 END AS online FROM listed)"""
_META = """json_extract_string(metadata, '$.call_status') AS call_status, json_extract_string(metadata, '$.duration') AS call_duration,
  COALESCE(json_extract_string(metadata, '$.message_type'), 'chat') AS message_type, CAST(json_extract(attachment, '$[0]') AS VARCHAR) AS attachment_first,
  CAST(json_array_length(attachment) AS INTEGER) AS attachment_count, CASE WHEN attachment IS NOT NULL AND trim(attachment) <> '' THEN 1 ELSE 0 END AS is_attachment"""

ORACLES = {
    "unread_direct": f"WITH {_UNREAD} SELECT * FROM unread",
    "pages_to_read": f"WITH {_UNREAD} SELECT owner_id, entity_id, room_count // 5 + 1 AS page FROM unread",
    "unread_summary": f"WITH {_UNREAD} SELECT owner_id, entity_id, room_count AS room, CAST(sum(room_count) OVER (PARTITION BY owner_id) AS BIGINT) AS total FROM unread",
    "unread_summary_team": f"WITH {_TEAM} SELECT uid, hub_id, room_count AS room, CAST(sum(room_count) OVER (PARTITION BY uid) AS BIGINT) AS total FROM teamun",
    "unread_team": f"WITH {_TEAM} SELECT * FROM teamun",
    "unread_dashboard": f"""WITH {_UNREAD}, {_TEAM}, x AS (
      SELECT u.owner_id, 'c' AS kind, u.room_count, EXISTS (SELECT 1 FROM archive_entity a WHERE a.owner_id = c.owner_id AND a.entity_id = c.id) AS arch
      FROM unread u JOIN contact c ON c.owner_id = u.owner_id AND c.uid = u.entity_id
      UNION ALL SELECT t.uid, 's', t.room_count, EXISTS (SELECT 1 FROM archive_entity a WHERE a.owner_id = t.uid AND a.entity_id = t.hub_id) FROM teamun t WHERE t.room_count > 0),
    y AS (SELECT owner_id, sum(room_count) FILTER (kind = 's' AND NOT arch) AS s, sum(room_count) FILTER (kind = 'c' AND NOT arch) AS c,
      sum(room_count) FILTER (arch) AS a, count(*) FILTER (NOT arch) AS h FROM x GROUP BY owner_id),
    tk AS (SELECT d.id, CASE WHEN d.domain_id = 0 THEN
        (SELECT count(*) FROM ticket t LEFT JOIN read_ticket_channel r ON r.ticket_id = t.ticket_id AND r.uid = d.id WHERE t.last_sys_id > COALESCE(r.ref_sys_id, 0))
      ELSE (SELECT count(*) FROM ticket t JOIN read_ticket_channel r ON r.ticket_id = t.ticket_id AND r.uid = d.id WHERE t.last_sys_id > r.ref_sys_id AND t.uid = d.id) END AS k
      FROM user_dir d)
    SELECT tk.id AS owner_id, CAST(COALESCE(s, 0) AS BIGINT) AS share_chat_cnt, CAST(COALESCE(c, 0) AS BIGINT) AS contact_chat_cnt,
      CAST(COALESCE(a, 0) AS BIGINT) AS archive_chat_cnt, CAST(k AS BIGINT) AS support_cnt, COALESCE(h, 0) AS head_chat_cnt,
      CAST(COALESCE(s, 0) + COALESCE(c, 0) + COALESCE(a, 0) + k AS BIGINT) AS total_cnt FROM tk LEFT JOIN y ON y.owner_id = tk.id""",
    "unread_by_tag": f"WITH {_UNREAD}, {_TEAM}, {_TAGUN} SELECT * FROM byt",
    "tag_counts": f"""WITH {_UNREAD}, {_TEAM}, {_TAGUN}, up AS (SELECT DISTINCT owner_id, parent_tag_id AS tag_id, 1 AS has FROM owned_tag WHERE parent_tag_id IS NOT NULL)
      SELECT p.owner_id, p.tag_id, p.parent_tag_id, p.name, p.position, ifnull(up.has, 0) AS is_any_child, CAST(ifnull(b.room_count, 0) AS BIGINT) AS room_count
      FROM owned_tag p LEFT JOIN up USING (owner_id, tag_id) LEFT JOIN byt b USING (owner_id, tag_id) WHERE p.parent_tag_id IS NULL""",
    "last_message": f"WITH {_LAST} SELECT * FROM lastm",
    "last_team_message": f"""WITH {_LASTT} SELECT l.hub_id, l.uid, l.ref_sys_id, left(c.message, 100) AS message, c.ctime,
      CASE WHEN c.attachment IS NOT NULL THEN 1 ELSE 0 END AS is_attachment
      FROM lastt l LEFT JOIN team_channel c ON c.hub_id = l.hub_id AND c.sys_id = l.ref_sys_id""",
    "message_page": f"""SELECT c.owner_id, c.entity_id, (row_number() OVER (PARTITION BY c.owner_id, c.entity_id ORDER BY c.sys_id DESC) - 1) // 45 + 1 AS page,
      c.sys_id, c.author_id, c.message, c.message_id, c.ctime, {_META}, CASE WHEN m.ref_sys_id < c.sys_id THEN 1 ELSE 0 END AS is_notify,
      CASE WHEN m.ref_sys_id >= c.sys_id THEN 1 ELSE 0 END AS is_readed, CASE WHEN h.ref_sys_id >= c.sys_id THEN 1 ELSE 0 END AS is_seen
      FROM channel c JOIN read_channel m ON m.owner_id = c.owner_id AND m.entity_id = c.entity_id AND m.uid = c.owner_id
      JOIN read_channel h ON h.owner_id = c.owner_id AND h.entity_id = c.entity_id AND h.uid = c.entity_id""",
    "late_page": """SELECT owner_id, entity_id, sys_id, author_id, message_id, thread_id, message, ctime, metadata, attachment FROM (
      SELECT *, row_number() OVER (PARTITION BY owner_id, entity_id ORDER BY sys_id DESC) AS rn FROM channel) WHERE rn BETWEEN 4 AND 6""",
    "message_metadata": f"SELECT owner_id, sys_id, {_META} FROM channel",
    "message_get_room": """SELECT hub_id, message_id, CASE WHEN len(json_keys(metadata, '$._seen_')) >= len(json_keys(metadata, '$._delivered_')) THEN 1 ELSE 0 END AS is_seen
      FROM team_channel WHERE message_id IN (SELECT 't' || o_orderkey FROM orders)""",
    "message_get_inbox": "SELECT owner_id, message_id, 1 AS is_seen FROM channel WHERE message_id IN (SELECT 'm' || o_orderkey FROM orders)",
    "message_threads": """SELECT c.owner_id, c.entity_id, c.sys_id, c.message_id, c.thread_id, COALESCE(p.message, 'DELETED') AS thread_message,
      p.author_id AS thread_author_id, (SELECT arg_min(k.id, k.sys_id) FROM contact k WHERE k.owner_id = c.owner_id AND k.entity = p.author_id) AS thread_contact_id
      FROM thread_message c LEFT JOIN thread_message p ON p.owner_id = c.owner_id AND p.entity_id = c.entity_id AND p.message_id = c.thread_id WHERE c.thread_id IS NOT NULL""",
    "forward_messages": """WITH a AS (SELECT hub_id, min(sys_id) AS lo, max(sys_id) AS hi FROM team_channel GROUP BY hub_id),
      r AS (SELECT hub_id, lo, lo AS k, 2 AS place FROM a UNION ALL SELECT hub_id, lo, hi, 1 FROM a)
      SELECT 'q' || lo AS request_id, r.hub_id, message_id AS forward_message_id, place, message, nullif(attachment, '[]') AS attachment,
        '{"forward_message_id":"' || message_id || '","message":"' || message || '"' ||
        CASE WHEN nullif(attachment, '[]') IS NULL THEN '' ELSE ',"attachment":"' || replace(attachment, '"', '\\"') || '"' END || ',"hub_id":"' || r.hub_id || '"}' AS node
      FROM r JOIN team_channel c ON c.hub_id = r.hub_id AND c.sys_id = r.k""",
    "message_attachments": """SELECT m.owner_id, m.entity_id, m.message_id, CAST(i AS INTEGER) AS position, json_extract_string(attachment, '$[' || i || '].hub_id') AS hub_id,
      f.id AS nid, f.owner_id AS file_owner_id, f.user_filename, f.category, f.extension, f.mimetype, f.filesize
      FROM (SELECT owner_id, entity_id, message_id, attachment, unnest(range(CAST(json_array_length(attachment) AS BIGINT))) AS i FROM channel) m
      JOIN hub_media f ON f.id = json_extract_string(attachment, '$[' || i || '].nid') AND f.hub_id = json_extract_string(attachment, '$[' || i || '].hub_id')""",
    "delivery_status": """SELECT c.hub_id, c.message_id, count(*) AS delivered, count(*) FILTER (r.ref_sys_id >= c.sys_id) AS seen,
      CASE WHEN count(*) FILTER (r.ref_sys_id >= c.sys_id) >= count(*) THEN 1 ELSE 0 END AS is_seen
      FROM team_channel c JOIN team_read r ON r.hub_id = c.hub_id GROUP BY c.hub_id, c.message_id""",
    "fully_deleted": """SELECT DISTINCT d.hub_id, d.ref_sys_id FROM delete_channel d WHERE NOT EXISTS (SELECT 1 FROM hub_read_channel r WHERE r.hub_id = d.hub_id
      AND NOT EXISTS (SELECT 1 FROM delete_channel e WHERE e.hub_id = d.hub_id AND e.ref_sys_id = d.ref_sys_id AND e.uid = r.uid))""",
    "chat_rooms": f"WITH {_ROOMLIST} SELECT * EXCLUDE (ak, message) FROM roomlist",
    "chat_rooms_page": f"""WITH {_ROOMLIST}, f AS (SELECT r.* FROM roomlist r JOIN contact c ON c.id = r.contact_id WHERE r.is_archived = 0 AND
      (lower(c.firstname) LIKE 'f1%' OR lower(c.lastname) LIKE 'f1%' OR lower(c.surname) LIKE 'f1%' OR lower(c.source) LIKE 'f1%'))
      SELECT owner_id, entity_id, display, message FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY COALESCE(ctime, 0) DESC, entity_id) AS rn FROM f) WHERE rn BETWEEN 5 AND 8""",
    "group_chat_rooms": f"""WITH {_TEAM}, {_LASTT} SELECT m.uid AS owner_id, m.hub_id AS id, h.name AS group_name, COALESCE(t.room_count, 0) AS room_count, left(c.message, 100) AS message, c.ctime
      FROM hub_member m JOIN hub h ON h.id = m.hub_id LEFT JOIN teamun t ON t.hub_id = m.hub_id AND t.uid = m.uid
      JOIN lastt l ON l.hub_id = m.hub_id AND l.uid = m.uid LEFT JOIN team_channel c ON c.hub_id = m.hub_id AND c.sys_id = l.ref_sys_id
      WHERE lower(h.name) LIKE 'supplier#00000000%'""",
    "chat_room_info": f"""WITH {_ROOMLIST} SELECT owner_id, entity_id, contact_id, status, room_count FROM roomlist r
      WHERE EXISTS (SELECT 1 FROM contact k WHERE k.owner_id = r.owner_id AND k.sys_id % 3 = 0 AND (k.id = r.contact_id OR k.id = r.entity_id))""",
    "presence_totals": """SELECT c.owner_id, count(DISTINCT c.uid) AS online_contacts, count(*) AS online_sockets FROM contact c JOIN socket s ON s.uid = c.uid
      WHERE s.state = 'active' GROUP BY c.owner_id""",
}
