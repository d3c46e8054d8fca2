"""Registered queries on notifications and logs, with their SQL twins."""

from pyspark.sql import functions as F

from parlor.functions import expr as X
from parlor.operators import message_changes as JM
from parlor.operators import notify as N
from parlor.workload.changes import CLEARING, ROOMS
from parlor.workload.fixtures import Tables

DESK = "SELECT m.uid AS owner_id, m.hub_id AS hub_id, h.area AS area FROM hub_member m JOIN hub h ON h.id = m.hub_id WHERE h.area <> 'dmz'"
VIEWERS = """SELECT m.hub_id, m.id, m.metadata, m.owner_id, g.entity_id AS uid FROM hub_media m JOIN permission g ON g.resource_id = 'o' || CAST(m.sys_id AS STRING)
  UNION ALL SELECT hub_id, id, metadata, owner_id, owner_id FROM hub_media
  UNION ALL SELECT hub_id, id, metadata, owner_id, 'u' || CAST(sys_id % 150 AS STRING) FROM hub_media"""
ACKS = """SELECT id, 'u' || CAST(sys_id % 9 AS STRING) AS uid, CASE WHEN sys_id % 3 = 0 THEN '{"acknowledge":["u1","u2"]}' WHEN sys_id % 3 = 1 THEN '{"acknowledge":[]}' ELSE '{}' END AS metadata
  FROM hub_media"""


def _items(t: Tables, cleared=None, unmarked=True):
    return N.notification_items(
        t.contact, t.user_dir, t.channel, t.read_channel, t.sql(DESK), t.team_channel, t.team_read, t.hub_media, t.ticket, t.read_ticket_channel, cleared=cleared, unmarked=unmarked)


def _cleared(t: Tables):
    """Markers of users who cleared everything while every tenth file was yet to come."""
    early = t.hub_media.where("sys_id % 10 <> 9")
    return JM.clear_file_markers(t.sql(CLEARING), t.sql(ROOMS), early)


QUERIES = {
    "media_new": lambda t: t.sql(VIEWERS).select("hub_id", "id", "uid", X.is_new("metadata", "owner_id", "uid").alias("is_new")),
    "new_files": lambda t: N.new_files(t.hub_media, t.hub_member),
    "new_files_after_clear": lambda t: N.new_files(t.hub_media, t.hub_member, _cleared(t)),
    "notification_items_after_clear": lambda t: _items(t, _cleared(t)),
    "notification_center_after_clear": lambda t: N.notification_center(_items(t, _cleared(t)), t.contact, t.contact_email, t.user_dir, t.hub, t.map_tag, t.tag),
    "notification_entity_after_clear": lambda t: N.notification_entity(_items(t, _cleared(t)), t.sql(DESK), t.user_dir),
    "media_notified": lambda t: t.sql(ACKS).select("id", "uid", X.is_notified("metadata", "uid").alias("notified")),
    "visible_media": lambda t: t.hub_media.where(X.is_visible("file_path", "category")).select("hub_id", "id", X.clean_path("file_path").alias("path")),
    "calendar_filter": lambda t: t.block_history.where(X.in_calendar(F.col("ctime") + F.col("serial") * 4000, month=3, year=2002)).select("serial", "ctime"),
    "calendar_range": lambda t: t.block_history.where(X.in_calendar("ctime", start=1000000100, end=1000005000)).select("serial", "ctime"),
    "notification_items": _items,
    "notification_center": lambda t: N.notification_center(
        _items(t, unmarked=False), t.contact, t.contact_email, t.user_dir, t.hub, t.map_tag, t.tag, N.unmarked_tickets(t.ticket, t.read_ticket_channel, t.user_dir)),
    "notification_entity": lambda t: N.notification_entity(_items(t), t.sql(DESK), t.user_dir),
    "action_log_feed": lambda t: N.action_log_feed(t.hub_log, t.hub_member, t.user_dir, 2, 4),
    "backup_log": lambda t: N.backup_log(t.hub_log, 1, 5),
    "login_history": lambda t: N.login_history(t.login_log, t.cookie),
    "login_history_page": lambda t: N.login_history(t.login_log, t.cookie, 2, 6).select("owner_id", "sys_id", "status"),
    "mark_unread": lambda t: N.mark_unread(t.mark),
    "mark_unread_total": lambda t: N.mark_unread(t.mark, False),
}

_NEW = """newf AS (SELECT m.hub_id, m.uid, count(*) AS cnt, max(f.upload_time) AS ctime FROM hub_member m JOIN hub_media f ON f.hub_id = m.hub_id
  WHERE NOT regexp_matches(f.file_path, '^/__(chat|trash)__') AND f.category <> 'root' AND json_exists(f.metadata, '$._seen_') AND f.owner_id <> m.uid
    AND NOT EXISTS (SELECT 1 FROM file_seen s WHERE s.hub_id = f.hub_id AND s.id = f.id AND s.uid = m.uid) GROUP BY m.hub_id, m.uid)"""
_ITEMS = f"""{_NEW}, desk AS ({DESK}), items AS (
  SELECT c.owner_id, c.id AS resource_id, c.entity AS entity_id, c.owner_id AS hub_id, c.mtime AS ctime, 'personal' AS area, 'contact' AS category, CAST(1 AS BIGINT) AS cnt
    FROM contact c WHERE c.status IN ('received', 'informed', 'invitation') AND c.entity IN (SELECT id FROM user_dir)
  UNION ALL SELECT c.owner_id, c.message_id, c.author_id, c.owner_id, c.ctime, 'personal', 'chat', 1 FROM channel c JOIN read_channel r ON r.owner_id = c.owner_id AND r.entity_id = c.entity_id AND r.uid = c.owner_id
    JOIN contact k ON k.owner_id = c.owner_id AND k.uid = c.entity_id WHERE c.author_id = c.entity_id AND c.sys_id > r.ref_sys_id
  UNION ALL SELECT r.uid, NULL, r.hub_id, r.hub_id, max(c.ctime), d.area, 'teamchat', count(*) FROM team_read r JOIN desk d ON d.hub_id = r.hub_id AND d.owner_id = r.uid
    JOIN team_channel c ON c.hub_id = r.hub_id AND c.sys_id > r.ref_sys_id GROUP BY r.uid, r.hub_id, d.area
  UNION ALL SELECT n.uid, NULL, n.hub_id, n.hub_id, n.ctime, d.area, 'media', n.cnt FROM newf n JOIN desk d ON d.hub_id = n.hub_id AND d.owner_id = n.uid
  UNION ALL SELECT t.uid, CAST(t.ticket_id AS VARCHAR), CAST(t.ticket_id AS VARCHAR), 'Support Ticket', r.ctime, 'personal', 'ticket', 1 FROM ticket t
    JOIN user_dir u ON u.id = t.uid AND u.domain_id <> 0 LEFT JOIN read_ticket_channel r ON r.ticket_id = t.ticket_id AND r.uid = t.uid WHERE t.last_sys_id > COALESCE(r.ref_sys_id, 0)
  UNION ALL SELECT u.id, CAST(t.ticket_id AS VARCHAR), CAST(t.ticket_id AS VARCHAR), 'Support Ticket', r.ctime, 'personal', 'ticket', 1 FROM user_dir u
    JOIN read_ticket_channel r ON r.uid = u.id JOIN ticket t ON t.ticket_id = r.ticket_id WHERE u.domain_id = 0 AND t.last_sys_id > r.ref_sys_id
  UNION ALL SELECT u.id, 'unmarked', 'unmarked', 'Support Ticket', NULL, 'personal', 'ticket', count(*) FROM user_dir u JOIN ticket t ON t.last_sys_id > 0
    WHERE u.domain_id = 0 AND NOT EXISTS (SELECT 1 FROM read_ticket_channel r WHERE r.ticket_id = t.ticket_id AND r.uid = u.id) GROUP BY u.id)"""
#: The feed with a row for each ticket that a member of the support team never opened.
_EACH = _ITEMS.replace("SELECT u.id, 'unmarked', 'unmarked', 'Support Ticket', NULL, 'personal', 'ticket', count(*) FROM", "SELECT u.id, CAST(t.ticket_id AS VARCHAR), CAST(t.ticket_id AS VARCHAR), 'Support Ticket', NULL, 'personal', 'ticket', 1 FROM").replace(
    " AND r.uid = u.id) GROUP BY u.id)", " AND r.uid = u.id))")
_CLEARED = f"""clr AS (SELECT r.hub_id, r.owner_id AS uid, max(f.sys_id) AS seen_upto FROM ({ROOMS}) r JOIN hub_media f ON f.hub_id = r.hub_id AND f.sys_id % 10 <> 9
    WHERE r.area IN ('private', 'share', 'public') AND r.owner_id IN ({CLEARING}) GROUP BY r.hub_id, r.owner_id),
  {_NEW.replace("AND f.owner_id <> m.uid", "AND f.owner_id <> m.uid AND NOT EXISTS (SELECT 1 FROM clr WHERE clr.hub_id = m.hub_id AND clr.uid = m.uid AND f.sys_id <= clr.seen_upto)")}"""
_COUNTS = "SELECT owner_id, entity_id, hub_id, category, area, CAST(sum(cnt) AS BIGINT) AS cnt, max(ctime) AS ctime FROM items GROUP BY ALL"

_CENTER = f"""WITH {_ITEMS}, b AS ({_COUNTS}),
      ck AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, k ORDER BY p, sys_id) AS rn FROM (
        SELECT owner_id, uid AS k, 0 AS p, sys_id, id, firstname, lastname, surname, status FROM contact WHERE uid IS NOT NULL
        UNION ALL SELECT owner_id, entity, 1, sys_id, id, firstname, lastname, surname, status FROM contact WHERE entity IS NOT NULL)) WHERE rn = 1),
      j AS (SELECT b.*, c.id AS contact_id, d.id AS user_id, c.firstname AS cf, c.lastname AS cl, c.surname AS cs, c.status, d.firstname AS df, d.lastname AS dl, d.email AS de, h.name AS hn, e.email AS ce,
        COALESCE(c.id, d.id, CASE WHEN b.hub_id = 'Support Ticket' THEN b.entity_id ELSE b.hub_id END) AS key_id
        FROM b LEFT JOIN user_dir d ON d.id = b.entity_id LEFT JOIN ck c ON c.owner_id = b.owner_id AND c.k = b.entity_id LEFT JOIN hub h ON h.id = b.hub_id
        LEFT JOIN contact_email e ON e.contact_id = c.id AND e.is_default = 1)
      SELECT owner_id, contact_id, user_id, key_id, COALESCE(cf, df) AS firstname, COALESCE(cl, dl) AS lastname,
        CASE WHEN hub_id = 'Support Ticket' THEN entity_id WHEN COALESCE(contact_id, user_id) IS NULL THEN hn ELSE
          COALESCE(cs, CASE WHEN COALESCE(cf, cl) IS NULL THEN COALESCE(ce, de) ELSE COALESCE(cf, '') || ' ' || COALESCE(cl, '') END, hn) END AS surname,
        COALESCE(ce, de) AS email, status, hub_id, ctime, category, cnt, area,
        (SELECT string_agg(m.tag_id, ',') FROM map_tag m WHERE m.owner_id = j.owner_id AND m.id = j.key_id) AS tag_id, CAST(1 AS BIGINT) AS part FROM j"""

ORACLES = {
    "media_new": f"""SELECT hub_id, id, uid, CASE WHEN metadata IS NOT NULL AND json_exists(metadata, '$._seen_') AND owner_id <> uid
      AND NOT list_contains(json_keys(metadata, '$._seen_'), uid) THEN 1 ELSE 0 END AS is_new FROM ({VIEWERS}) v""",
    "new_files": f"WITH {_NEW} SELECT * FROM newf",
    "media_notified": f"""SELECT id, uid, CASE WHEN json_exists(metadata, '$.acknowledge') AND NOT json_contains(metadata, '"' || uid || '"') THEN 1 ELSE 0 END AS notified FROM ({ACKS}) a""",
    "visible_media": """SELECT hub_id, id, regexp_replace(regexp_replace(file_path, '/+', '/', 'g'), '<.*>', '', 'g') AS path FROM hub_media
      WHERE NOT regexp_matches(file_path, '^/__(chat|trash)__') AND category <> 'root'""",
    "calendar_filter": "SELECT serial, ctime FROM block_history WHERE month(make_timestamp((ctime + serial * 4000) * 1000000)) = 3 AND year(make_timestamp((ctime + serial * 4000) * 1000000)) = 2002",
    "calendar_range": "SELECT serial, ctime FROM block_history WHERE ctime BETWEEN 1000000100 AND 1000005000",
    "notification_items": f"WITH {_ITEMS} SELECT * FROM items",
    "notification_center": _CENTER.replace(_ITEMS, _EACH),
    "notification_entity": f"""WITH {_ITEMS}, k AS (SELECT * FROM items WHERE (category <> 'teamchat' OR area = 'private') AND (category <> 'media' OR area <> 'personal')),
      b AS (SELECT owner_id, entity_id, hub_id, category, area, CAST(sum(cnt) AS BIGINT) AS cnt, max(ctime) AS ctime FROM k GROUP BY ALL),
      ten AS (SELECT id AS owner_id, id AS tenant_id, 'personal' AS area FROM user_dir UNION ALL SELECT owner_id, hub_id, area FROM desk)
      SELECT t.owner_id, t.tenant_id, COALESCE(b.entity_id, t.tenant_id) AS entity_id, COALESCE(b.hub_id, t.tenant_id) AS hub_id, t.area, COALESCE(b.category, 'empty') AS category,
        COALESCE(b.cnt, 0) AS cnt, CASE WHEN b.category IS NULL THEN 0 ELSE b.ctime END AS ctime
      FROM ten t LEFT JOIN b ON b.owner_id = t.owner_id AND CASE WHEN b.area = 'personal' THEN b.owner_id ELSE b.hub_id END = t.tenant_id""",
    "action_log_feed": """SELECT hub_id, viewer, sys_id, category, log, ctime FROM (SELECT *, row_number() OVER (PARTITION BY hub_id, viewer ORDER BY ctime DESC, sys_id DESC) AS rn FROM (
      SELECT a.hub_id, m.uid AS viewer, a.sys_id, a.category, CASE WHEN a.category = 'media' THEN a.log || ' by ' || d.firstname || ' ' || d.lastname ELSE a.log END AS log, a.ctime
      FROM hub_log a JOIN user_dir d ON d.id = a.uid JOIN hub_member m ON m.hub_id = a.hub_id
      WHERE a.notify_to = 'all' OR (a.notify_to = 'member' AND a.entity_id = m.uid) OR (a.notify_to = 'admin' AND m.permission & 16 > 0))) WHERE rn BETWEEN 5 AND 8""",
    "backup_log": """SELECT hub_id, sys_id, uid, category, log, ctime FROM (SELECT *, row_number() OVER (PARTITION BY hub_id ORDER BY ctime, sys_id) AS rn FROM hub_log WHERE action = 'backup') WHERE rn <= 5""",
    "login_history": """SELECT l.owner_id, l.sys_id, l.cookie_id, l.intime, l.outtime, json_extract_string(metadata, '$.timezone') AS timezone, json_extract_string(metadata, '$.city') AS city,
      json_extract_string(metadata, '$.ip') AS ip, CASE WHEN c.id IS NULL THEN 'inactive' ELSE 'active' END AS status
      FROM login_log l LEFT JOIN cookie c ON c.id = l.cookie_id AND c.uid = l.owner_id WHERE l.intime IS NOT NULL""",
    "login_history_page": """SELECT owner_id, sys_id, status FROM (SELECT l.owner_id, l.sys_id, CASE WHEN c.id IS NULL THEN 'inactive' ELSE 'active' END AS status,
      row_number() OVER (PARTITION BY l.owner_id ORDER BY l.sys_id DESC) AS rn FROM login_log l LEFT JOIN cookie c ON c.id = l.cookie_id AND c.uid = l.owner_id WHERE l.intime IS NOT NULL) WHERE rn BETWEEN 7 AND 12""",
    "mark_unread": "SELECT owner_id, conversation_id, count(*) AS count FROM mark WHERE status = 'new' GROUP BY ALL",
    "mark_unread_total": "SELECT owner_id, count(*) AS count FROM mark WHERE status = 'new' GROUP BY ALL",
}
ORACLES |= {f"{n}_after_clear": ORACLES[n].replace(_NEW, _CLEARED) for n in ("new_files", "notification_items", "notification_entity")}
ORACLES["notification_center_after_clear"] = _CENTER.replace(_NEW, _CLEARED)
