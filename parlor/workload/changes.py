"""Registered queries on change sets, with their SQL twins."""

from pyspark.sql import functions as F

from parlor.operators import changes as J
from parlor.operators import contact_changes as JC
from parlor.operators import message_changes as JM
from parlor.operators import messaging as M
from parlor.operators import room_changes as JR
from parlor.workload.fixtures import Tables

NOW = 1_800_000_000
NU = "(SELECT max(user_id) + 1 FROM events)"
NH = "(SELECT count(*) FROM supplier)"
BLACK = f"""SELECT 'u' || CAST(o_custkey % 60 AS STRING) AS owner_id, o_orderkey AS sys_id, 'w' || CAST(o_orderkey % 17 AS STRING) || '@b.example' AS email,
  CASE o_orderkey % 4 WHEN 0 THEN 'upsert' WHEN 1 THEN 'delete' ELSE 'insert' END AS op, o_orderkey AS seq FROM orders"""
OLD_BLACK = """SELECT 'u' || CAST(c_custkey % 60 AS STRING) AS owner_id, max(c_custkey) AS sys_id, 'w' || CAST(c_custkey % 19 AS STRING) || '@b.example' AS email FROM customer GROUP BY c_custkey % 60, c_custkey % 19"""
ORDERS = """SELECT 'u1' AS owner_id, '["r3","r1","n4"]' AS ids FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'u2', '["r0","n1"]' FROM region WHERE r_regionkey = 1"""
OWNED_TAGS = "SELECT 'u1' AS owner_id, tag_id, position FROM tag UNION ALL SELECT 'u2', tag_id, position FROM tag UNION ALL SELECT 'u3', tag_id, position FROM tag"
POSTS = f"""SELECT * FROM (SELECT event_id AS seq, 'u' || CAST(user_id AS STRING) AS author_id, 'u' || CAST((user_id * 5 + 1) % {NU} AS STRING) AS entity_id,
  CASE WHEN event_id % 4 = 0 THEN 'm' || CAST(event_id AS STRING) ELSE 'p' || CAST(CAST(floor(event_id / 2) AS BIGINT) AS STRING) END AS message_id,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS message, CAST(NULL AS STRING) AS attachment, 1710000000 + event_id AS ctime, CASE WHEN event_id % 6 = 1 THEN 'm' || CAST(event_id - 1 AS STRING) END AS thread_id,
  CASE WHEN event_id % 7 = 0 THEN 'm' || CAST(event_id % 50 AS STRING) END AS forward_message_id, 'h' || CAST(event_id % 5 AS STRING) AS forward_hub_id FROM events) p0 WHERE author_id <> entity_id"""
TEAM_POSTS = f"""SELECT event_id AS seq, 'h' || CAST(event_id % {NH} AS STRING) AS hub_id, 'u' || CAST((user_id + 1) % {NU} AS STRING) AS author_id,
  CASE WHEN event_id % 3 = 0 THEN 't' || CAST(event_id AS STRING) ELSE 'tp' || CAST(event_id % 4000 AS STRING) END AS message_id, event_type AS message, CASE WHEN event_id % 4 = 1 THEN 't' || CAST(event_id - 2 * {NH} AS STRING) END AS thread_id, CAST(NULL AS STRING) AS attachment, 1710000000 + event_id AS ctime FROM events"""
ACKS = f"""SELECT 'u' || CAST(user_id AS STRING) AS uid, 'u' || CAST((user_id * 3 + event_id % 8 + 1) % {NU} AS STRING) AS entity_id,
  CASE WHEN event_id % 6 = 5 THEN 'zz' ELSE 'm' || CAST(event_id AS STRING) END AS message_id FROM events"""
DELS = f"""SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 'u' || CAST((user_id * 3 + event_id % 8 + 1) % {NU} AS STRING) ELSE 'u' || CAST(user_id AS STRING) END AS uid,
  CASE event_id % 5 WHEN 1 THEN 'me' WHEN 2 THEN 'bad' WHEN 3 THEN 'me' ELSE 'all' END AS option, 'm' || CAST(event_id AS STRING) AS message_id FROM events
  UNION ALL SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u' || CAST((user_id * 3 + event_id % 8 + 1) % {NU} AS STRING) ELSE 'u' || CAST(user_id AS STRING) END,
  CASE event_id % 5 WHEN 1 THEN 'me' WHEN 2 THEN 'bad' WHEN 3 THEN 'me' ELSE 'all' END, 'zz' FROM events WHERE event_id % 11 = 0"""
TEAM_DELS = f"""SELECT event_id AS request_id, 'h' || CAST(event_id % {NH} AS STRING) AS hub_id, CASE WHEN event_id % 4 = 0 THEN 'u' || CAST(user_id AS STRING) ELSE 'u' || CAST((user_id + 1) % {NU} AS STRING) END AS uid,
  CASE WHEN event_id % 8 < 3 THEN 'all' ELSE 'me' END AS option, 't' || CAST(event_id AS STRING) AS message_id FROM events"""
TWO = "SELECT hub_id, min(uid) AS uid FROM team_delete GROUP BY hub_id UNION SELECT hub_id, max(uid) FROM team_delete GROUP BY hub_id"
TWO_STONES = "SELECT hub_id, uid, ref_sys_id FROM team_delete"
ROOMS = "SELECT m.uid AS owner_id, m.hub_id AS hub_id, h.area AS area FROM hub_member m JOIN hub h ON h.id = m.hub_id"
CLEARING = "SELECT id AS uid FROM user_dir WHERE connected = 1"
CLEAR_ONE = "SELECT m.uid AS uid, m.hub_id AS entity_id FROM hub_member m WHERE m.sys_id % 11 = 0"
CLEAR_INBOX = "SELECT owner_id AS uid, min(entity_id) AS entity_id FROM read_channel GROUP BY owner_id"
CALLS = f"""SELECT * FROM (SELECT event_id AS seq, 'u' || CAST(user_id AS STRING) AS author_id, 'u' || CAST((user_id * 5 + 1) % {NU} AS STRING) AS entity_id, 'call' || CAST(event_id AS STRING) AS message_id,
  CASE event_type WHEN 'signup' THEN 'cancel' WHEN 'view' THEN 'leave' WHEN 'purchase' THEN 'reject' ELSE 'ring' END AS type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 100 END AS duration,
  CASE WHEN event_id % 5 = 0 THEN 'callee' ELSE 'caller' END AS role, 1710000000 + event_id AS ctime FROM events) c0 WHERE author_id <> entity_id"""
TICKETS = "SELECT o_custkey AS ticket_id, 'u' || CAST(o_custkey % 70 AS STRING) AS author_id, o_orderkey + 5 AS sys_id FROM orders"
MAILED = "SELECT owner_id, sys_id, id, CASE WHEN sys_id % 4 = 0 THEN entity || '@d' || CAST(sys_id % 25 AS STRING) || '.example' ELSE entity END AS entity, status FROM contact"
CHILD = """SELECT owner_id, id AS contact_id, '[{"email":"a' || CAST(sys_id AS STRING) || '@x.example","category":"prof","is_default":1},{"email":"b@x.example","category":"priv","is_default":0}]' AS emails,
  '[{"areacode":"+1","phone":"' || CAST(sys_id AS STRING) || '","category":"priv"}]' AS phones,
  CASE WHEN sys_id % 2 = 0 THEN '[{"street":"S' || CAST(sys_id AS STRING) || '","city":"C","category":"priv"}]' ELSE '[]' END AS addresses FROM contact WHERE status = 'active'"""
GONE = "SELECT owner_id, id FROM contact WHERE status = 'memory'"
EDITS = """SELECT owner_id, id, CASE WHEN sys_id % 2 = 0 THEN '' ELSE 'E' || CAST(sys_id AS STRING) END AS surname, 'first' AS firstname, '' AS lastname, 'msg' AS message,
  CASE WHEN sys_id % 3 = 0 THEN entity ELSE 'new' || CAST(sys_id AS STRING) END AS entity, sys_id AS seq FROM contact WHERE sys_id % 5 <> 0"""
BLOCK_ADD = "SELECT owner_id, id AS contact_id FROM contact WHERE status = 'received'"
BLOCK_DEL = "SELECT owner_id, id AS contact_id FROM contact WHERE status = 'active'"
GRANTS = """SELECT hub_id, '*' AS resource_id, uid AS entity_id, permission, CAST(0 AS BIGINT) AS expiry_time, 'system' AS assign_via FROM hub_member
  UNION ALL SELECT hub_id, id, CASE WHEN sys_id % 2 = 0 THEN 'nobody' ELSE owner_id END, 3, CAST(0 AS BIGINT), CASE WHEN sys_id % 3 = 0 THEN 'link' ELSE 'share' END FROM hub_media"""
GRANT_CHANGES = f"""SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'revoke' ELSE 'grant' END AS op, 'h' || CAST(o_orderkey % {NH} AS STRING) AS hub_id,
  CASE WHEN o_orderkey % 5 = 0 THEN '*' ELSE 'd' || CAST(o_orderkey - (o_orderkey % 2) * {NH} AS STRING) END AS resource_id,
  CASE WHEN o_orderkey % 9 = 0 AND o_orderkey % 5 <> 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'nobody' ELSE 'u' || CAST(o_custkey AS STRING) END AS entity_id,
  CAST(o_orderkey % 32 AS INT) AS permission, o_orderkey % 4 AS hours, CASE WHEN o_orderkey % 2 = 0 THEN 'link' ELSE 'share' END AS assign_via FROM orders"""
OWNER_MOVES = "SELECT hub_id, uid FROM hub_member WHERE permission = 31"
MOVES = f"""SELECT o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN 'leave' WHEN 1 THEN 'leave_all' ELSE 'join' END AS op, 'h' || CAST(o_orderkey % {NH} AS STRING) AS hub_id, 'u' || CAST(o_custkey % 400 AS STRING) AS uid,
  CAST(o_orderkey % 8 AS INT) AS permission FROM orders"""
LEAVERS = "SELECT id AS uid FROM user_dir WHERE connected = 1"
REVS = """SELECT o_orderkey AS seq, CASE o_orderkey % 10 WHEN 0 THEN 'unpublish' WHEN 1 THEN 'rename' WHEN 2 THEN 'delete_lang' WHEN 3 THEN 'publish' WHEN 4 THEN 'copy'
    ELSE CASE WHEN o_orderkey % 501 = 7 THEN 'purge' WHEN o_orderkey % 100 = 5 THEN 'archive' ELSE 'save' END END AS op,
  CASE WHEN o_orderkey % 10 IN (3, 4) THEN 'b' || CAST(o_custkey % 50 AS STRING) WHEN o_orderkey % 5000 = 12 THEN NULL ELSE 'b' || CAST(o_orderkey % 55 AS STRING) END AS master_id,
  CASE WHEN o_orderkey % 10 = 4 THEN CASE o_orderkey % 4 WHEN 0 THEN 'en' ELSE 'es' END ELSE CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'zh' END END AS lang,
  CASE WHEN o_orderkey % 300 IN (12, 102) THEN NULL ELSE CASE o_orderkey % 2 WHEN 0 THEN 'desktop' ELSE 'mobile' END END AS device, 'u' || CAST(o_custkey AS STRING) AS author_id,
  CASE WHEN o_orderkey % 4 = 0 THEN 'page-' || CAST(o_orderkey % 7 AS STRING) || '-v' || CAST(o_orderkey % 50 AS STRING) WHEN o_orderkey % 9 = 1 THEN 'both-' || CAST(o_orderkey % 97 AS STRING) ELSE 'new-' || CAST(o_orderkey % 55 AS STRING) END AS hashtag,
  CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS isonline, 1500000000 + o_orderkey AS ctime, CASE WHEN o_orderkey % 10 IN (3, 4) THEN o_orderkey + CASE WHEN o_orderkey % 70 = 3 THEN 1 ELSE 0 END END AS target,
  CASE WHEN o_orderkey % 20 = 4 THEN 'cp' || CAST(o_orderkey AS STRING) END AS copy_id FROM orders"""
TAG_EDITS = """SELECT n_nationkey AS seq, 'add' AS op, 'z' || CAST(n_nationkey AS STRING) AS tag_id, 'r' || CAST(n_regionkey AS STRING) AS parent_tag_id, CASE WHEN n_nationkey % 2 = 0 THEN 'NATION_3' ELSE 'fresh' END AS name FROM nation
  UNION ALL SELECT 100 + n_nationkey, 'rename', 'n' || CAST(n_nationkey AS STRING), NULL, 'renamed ' || CAST(n_nationkey AS STRING) FROM nation WHERE n_nationkey % 3 = 0
  UNION ALL SELECT 200 + n_nationkey, 'assign', CASE WHEN n_nationkey % 4 = 0 THEN 'r' || CAST(n_regionkey AS STRING) ELSE 'n' || CAST(n_nationkey AS STRING) END, CASE WHEN n_nationkey % 4 = 0 THEN 'n' || CAST(n_nationkey AS STRING) ELSE 'r' || CAST((n_regionkey + 2) % 5 AS STRING) END, NULL FROM nation
  UNION ALL SELECT 300 + n_nationkey, 'remove', 'n' || CAST(n_nationkey AS STRING), NULL, NULL FROM nation WHERE n_nationkey % 6 = 2"""
LANGS = """SELECT p_partkey AS seq, hub_id, base, CASE p_partkey % 3 WHEN 0 THEN 'deleted' WHEN 1 THEN 'frozen' ELSE 'active' END AS state FROM language JOIN part ON p_partkey = sys_id + 1"""
PAGES = "SELECT 'b' || CAST(o_custkey % 50 AS STRING) || '-' || CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'zh' END AS key, 'old' AS content, 'tag' AS hashtag FROM orders GROUP BY 1"
PAGE_CHANGES = "SELECT o_orderkey AS seq, 'b' || CAST(o_custkey % 60 AS STRING) AS id, CASE o_orderkey % 2 WHEN 0 THEN 'en' ELSE 'de' END AS lang, 'text ' || CAST(o_orderkey AS STRING) AS content, o_orderstatus AS hashtag FROM orders"


def _private(t: Tables):
    return JM.apply_deletes(t.sql(DELS), t.channel)


def _team(t: Tables):
    return JM.apply_team_deletes(t.sql(TEAM_DELS), t.team_channel, t.sql(TWO_STONES), t.sql(TWO))


def _sync(t: Tables):
    return JC.contact_sync(t.contact_sync, t.user_dir, t.contact, t.contact_email, t.contact_phone, t.contact_address)


def _invites(t: Tables):
    return JC.email_invites(t.token, t.user_dir, t.sql(MAILED))


def _posted_threads(t: Tables):
    """Threads of the inboxes once the posts are in them."""
    cols = ["owner_id", "entity_id", "sys_id", "author_id", "message", "message_id", "thread_id"]
    inbox = t.channel.select(*cols).unionByName(JM.post_messages(t.sql(POSTS), t.channel).select(*cols))
    return M.message_threads(inbox, t.contact).select("owner_id", "entity_id", "message_id", "thread_id", "thread_message", "thread_author_id")


def _revisions(t: Tables):
    return JR.revisions(t.block_history, t.block, t.sql(REVS))


QUERIES = {
    "upsert": lambda t: J.upsert(t.sql(OLD_BLACK), t.sql(BLACK), ["owner_id", "email"]),
    "reposition": lambda t: J.positions_from_list(t.sql(ORDERS), t.sql(OWNED_TAGS), "tag_id"),
    "index_upsert": lambda t: JR.index_upsert(t.sql(PAGES), t.sql(PAGE_CHANGES)),
    "post_messages": lambda t: JM.post_messages(t.sql(POSTS), t.channel),
    "post_team_messages": lambda t: JM.post_team_messages(t.sql(TEAM_POSTS), t.team_channel),
    "posted_threads": lambda t: _posted_threads(t),
    "clear_one_entity": lambda t: JM.clear_team_markers(t.sql(CLEAR_ONE), t.sql(ROOMS), t.team_read),
    "clear_one_inbox": lambda t: JM.clear_private_markers(t.sql(CLEAR_INBOX), t.read_channel),
    "markers_after_post": lambda t: JM.markers_after_post(JM.post_team_messages(t.sql(TEAM_POSTS), t.team_channel), t.team_read),
    "apply_acks": lambda t: JM.apply_acks(t.sql(ACKS), t.channel, t.read_channel),
    "delete_status": lambda t: JM.delete_status(t.sql(DELS).withColumn("owner_id", F.col("uid")), t.channel, "owner_id"),
    "apply_deletes": lambda t: _private(t).select("owner_id", "message_id"),
    "last_after_deletes": lambda t: M.last_message(_private(t)).drop("metadata"),
    "deleted_files": lambda t: JM.deleted_files(t.channel, _private(t), t.hub_media),
    "usage_after_deletes": lambda t: JM.usage_after(t.disk_usage, JM.deleted_files(t.channel, _private(t), t.hub_media)),
    "apply_team_deletes": lambda t: _team(t)[0].select("hub_id", "message_id"),
    "team_tombstones": lambda t: _team(t)[1],
    "clear_team_markers": lambda t: JM.clear_team_markers(t.sql(CLEARING), t.sql(ROOMS), t.team_read),
    "clear_file_markers": lambda t: JM.clear_file_markers(t.sql(CLEARING), t.sql(ROOMS), t.hub_media),
    "clear_private_markers": lambda t: JM.clear_private_markers(t.sql(CLEARING), t.read_channel),
    "clear_ticket_markers": lambda t: JM.clear_ticket_markers(t.sql(CLEARING), t.ticket, t.read_ticket_channel),
    "call_log": lambda t: JM.call_log(t.sql(CALLS), t.channel),
    "guests_and_tickets": lambda t: JM.ticket_posts(t.sql(TICKETS), t.ticket, t.read_ticket_channel)[0],
    "ticket_markers": lambda t: JM.ticket_posts(t.sql(TICKETS), t.ticket, t.read_ticket_channel)[1],
    "invitation_fold": lambda t: JC.invitation_fold(t.relation_event, user_dir=t.user_dir),
    "email_invites": lambda t: _invites(t)["received"].drop("id"),
    "email_invite_rewrites": lambda t: _invites(t)["contact"],
    "email_invite_tokens": lambda t: _invites(t)["token"],
    "contact_sync": lambda t: _sync(t)["contact"],
    "contact_sync_phones": lambda t: _sync(t)["phone"],
    "contact_sync_emails": lambda t: _sync(t)["email"],
    "contact_sync_addresses": lambda t: _sync(t)["address"],
    "contact_sync_pairs": lambda t: _sync(t)["sync"],
    "contact_children": lambda t: JC.replace_children(t.contact_email, JC.children_from_json(t.sql(CHILD))["email"].drop("id"), t.sql(CHILD)),
    "contact_child_phones": lambda t: JC.replace_children(t.contact_phone, JC.children_from_json(t.sql(CHILD))["phone"].drop("id"), t.sql(CHILD)),
    "contact_child_addresses": lambda t: JC.replace_children(t.contact_address, JC.children_from_json(t.sql(CHILD))["address"].drop("id"), t.sql(CHILD)),
    "contact_delete": lambda t: JC.delete_contacts(t.sql(GONE), t.contact, {"phone": t.contact_phone}, t.map_tag, t.contact_block)["contact"].select("owner_id", "id"),
    "contact_delete_phones": lambda t: JC.delete_contacts(t.sql(GONE), t.contact, {"phone": t.contact_phone}, t.map_tag, t.contact_block)["phone"].select("owner_id", "id"),
    "contact_edit": lambda t: JC.contact_edit(t.sql(EDITS), t.contact),
    "block_edit": lambda t: J.block_edit(t.contact_block, t.contact, t.sql(BLOCK_ADD), t.sql(BLOCK_DEL)),
    "apply_grants": lambda t: JR.apply_grants(t.sql(GRANTS), t.sql(GRANT_CHANGES), NOW),
    "make_owner": lambda t: JR.make_owner(t.sql(GRANTS), t.sql(OWNER_MOVES)),
    "membership": lambda t: JR.membership(t.hub_member, t.sql(MOVES)),
    "membership_desk": lambda t: JR.desk_nodes(JR.membership(t.hub_member, t.sql(MOVES)), t.hub),
    "offboard": lambda t: JR.offboard(t.hub_member, t.sql(LEAVERS)),
    "revisions": lambda t: _revisions(t)["history"],
    "revision_pages": lambda t: _revisions(t)["block"],
    "revision_refused": lambda t: _revisions(t)["refused"],
    "tag_edit": lambda t: JR.tag_edit(t.tag, t.sql(TAG_EDITS)),
    "language_state": lambda t: JR.language_state(t.language, t.sql(LANGS)),
    "subscription_fold": lambda t: JR.subscription_fold(t.billing_event),
}

_A = "CASE WHEN split_part(e, '|', 2) = 'L' THEN split_part(s, '|', 1) ELSE split_part(s, '|', 2) END"
_B = "CASE WHEN split_part(e, '|', 2) = 'L' THEN split_part(s, '|', 2) ELSE split_part(s, '|', 1) END"
_NA = f"""CASE split_part(e, '|', 1) WHEN 'invite' THEN CASE ({_B}) WHEN 'sent' THEN 'active' WHEN 'informed' THEN 'active' WHEN 'active' THEN 'informed' ELSE 'sent' END
  WHEN 'accept' THEN CASE WHEN ({_A}) IN ('received', 'invitation') THEN 'active' ELSE ({_A}) END WHEN 'acknowledge' THEN CASE WHEN ({_A}) = 'informed' THEN 'active' ELSE ({_A}) END
  WHEN 'refuse' THEN CASE ({_A}) WHEN 'received' THEN 'none' WHEN 'invitation' THEN 'memory' ELSE ({_A}) END ELSE 'none' END"""
_NB = f"""CASE split_part(e, '|', 1) WHEN 'invite' THEN CASE ({_B}) WHEN 'none' THEN 'received' WHEN 'memory' THEN 'invitation' WHEN 'sent' THEN 'informed' ELSE ({_B}) END
  WHEN 'accept' THEN CASE WHEN ({_A}) IN ('received', 'invitation') AND ({_B}) <> 'none' THEN 'informed' ELSE ({_B}) END
  WHEN 'delete' THEN CASE WHEN ({_A}) = 'none' THEN ({_B}) WHEN ({_B}) IN ('none', 'received') THEN 'none' ELSE 'memory' END ELSE ({_B}) END"""
_FOLD = f"""WITH p AS (SELECT seq, least(actor, target) AS low, greatest(actor, target) AS high, event || '|' || CASE WHEN actor < target THEN 'L' ELSE 'H' END AS e FROM relation_event WHERE actor <> target),
  f AS (SELECT low, high, list_reduce(list_prepend('none|none', list(e ORDER BY seq)), lambda s, e: CASE WHEN split_part(e, '|', 2) = 'L' THEN ({_NA}) || '|' || ({_NB}) ELSE ({_NB}) || '|' || ({_NA}) END) AS st FROM p GROUP BY low, high),
  r AS (SELECT low AS owner_id, high AS entity, split_part(st, '|', 1) AS status FROM f UNION ALL SELECT high, low, split_part(st, '|', 2) FROM f)
  SELECT owner_id, entity, status, CASE WHEN status IN ('informed', 'active') THEN entity END AS uid FROM r WHERE status <> 'none' AND owner_id IN (SELECT id FROM user_dir)"""
_POST = f"""pp AS ({POSTS}), ib AS (SELECT seq, author_id, message_id, message, thread_id, attachment, ctime, forward_message_id, forward_hub_id, author_id AS owner_id, entity_id FROM pp
    UNION ALL SELECT seq, author_id, message_id, message, thread_id, attachment, ctime, forward_message_id, forward_hub_id, entity_id, author_id FROM pp),
  fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, message_id ORDER BY seq) AS rn FROM ib) q WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM channel c WHERE c.owner_id = q.owner_id AND c.message_id = q.message_id))"""
_STATUS = """st AS (SELECT request_id, CASE WHEN bool_or(option NOT IN ('me', 'all')) THEN 'INVALID_OPTION' WHEN bool_or(author_id IS NULL) THEN 'INVALID_MESSAGES'
  WHEN bool_or(option = 'all' AND author_id <> uid) THEN 'INVALID_OPTION' ELSE 'OK' END AS status FROM (SELECT d.*, c.author_id FROM rq d LEFT JOIN {table} c ON c.{tenant} = d.{by} AND c.message_id = d.message_id) GROUP BY request_id)"""
_DEL = f"""rq AS ({DELS}), {_STATUS.format(table='channel', tenant='owner_id', by='uid')}, ok AS (SELECT rq.* FROM rq JOIN st USING (request_id) WHERE status = 'OK'),
  aft AS (SELECT c.* FROM channel c WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.uid = c.owner_id AND ok.message_id = c.message_id)
    AND NOT EXISTS (SELECT 1 FROM ok JOIN channel o ON o.owner_id = ok.uid AND o.message_id = ok.message_id WHERE ok.option = 'all' AND o.entity_id = c.owner_id AND ok.message_id = c.message_id)),
  los AS (SELECT DISTINCT f.hub_id, f.id, f.filesize FROM (SELECT attachment, unnest(range(CAST(json_array_length(attachment) AS BIGINT))) AS i FROM channel WHERE message_id NOT IN (SELECT message_id FROM aft)) x
    JOIN hub_media f ON f.id = json_extract_string(x.attachment, '$[' || i || '].nid') AND f.hub_id = json_extract_string(x.attachment, '$[' || i || '].hub_id'))"""
_TDEL = f"""rq AS ({TEAM_DELS}), {_STATUS.format(table='team_channel', tenant='hub_id', by='hub_id')}, ok AS (SELECT rq.*, c.sys_id FROM rq JOIN st USING (request_id) JOIN team_channel c ON c.hub_id = rq.hub_id AND c.message_id = rq.message_id WHERE status = 'OK'),
  two AS ({TWO}), sto AS (SELECT hub_id, uid, ref_sys_id FROM team_delete UNION SELECT hub_id, uid, sys_id FROM ok WHERE option = 'me'),
  gon AS (SELECT hub_id, sys_id FROM ok WHERE option = 'all' UNION SELECT s.hub_id, s.ref_sys_id FROM sto s WHERE NOT EXISTS (SELECT 1 FROM two WHERE two.hub_id = s.hub_id
    AND NOT EXISTS (SELECT 1 FROM sto z WHERE z.hub_id = s.hub_id AND z.ref_sys_id = s.ref_sys_id AND z.uid = two.uid)))"""
_CLR = f"clr AS (SELECT DISTINCT r.hub_id, r.owner_id AS uid FROM ({ROOMS}) r WHERE r.area IN ('private', 'share', 'public') AND r.owner_id IN ({CLEARING}))"
_LIVE = "live AS (SELECT d.id AS user_id, k.inviter_id, k.email FROM token k JOIN user_dir d ON d.email = k.email WHERE k.status = 'active' AND k.inviter_id IS NOT NULL AND d.id <> k.inviter_id)"
_DUE = "due AS (SELECT DISTINCT owner_id, uid, status FROM contact_sync WHERE status <> 'ok'), pt AS (SELECT due.owner_id, d.* FROM due JOIN user_dir d ON d.id = due.uid WHERE due.status <> 'delete')"
_KEPT_CHILD = "WHERE NOT EXISTS (SELECT 1 FROM due WHERE due.owner_id = x.owner_id AND due.uid = x.contact_id)"
_GR = f"""g0 AS ({GRANTS}), ch AS ({GRANT_CHANGES}),
  al AS (SELECT hub_id, resource_id, entity_id, permission, expiry_time, assign_via, -1 AS seq, 'grant' AS op FROM g0
    UNION ALL SELECT hub_id, resource_id, entity_id, permission, CASE WHEN hours = 0 THEN 0 ELSE {NOW} + hours * 3600 END, assign_via, seq, op FROM ch WHERE entity_id <> ''),
  rv AS (SELECT hub_id, resource_id, max(seq) FILTER (entity_id = '') AS any_at, max(seq) FILTER (entity_id IN ('nobody', '*')) AS link_at FROM ch WHERE op = 'revoke' GROUP BY 1, 2),
  la AS (SELECT *, max(seq) OVER (PARTITION BY hub_id, resource_id, entity_id) AS last FROM al),
  ev AS (SELECT la.* EXCLUDE (last) FROM la LEFT JOIN rv USING (hub_id, resource_id) WHERE op = 'grant' AND seq = last AND coalesce(any_at < seq, true)
    AND NOT (assign_via = 'link' AND coalesce(link_at >= seq, false)))"""
_MEM = f"""mv AS ({MOVES}), al AS (SELECT hub_id, uid, permission, -1 AS seq, 'join' AS op FROM hub_member UNION ALL SELECT hub_id, uid, permission, seq, op FROM mv WHERE op <> 'leave_all'),
  now AS (SELECT hub_id, uid, permission FROM al WHERE op = 'join' AND NOT EXISTS (SELECT 1 FROM al b WHERE b.hub_id = al.hub_id AND b.uid = al.uid AND b.seq > al.seq)
    AND NOT EXISTS (SELECT 1 FROM mv w WHERE w.op = 'leave_all' AND w.uid = al.uid AND w.seq > al.seq))"""
_REV = f"""cg AS ({REVS}), src AS (SELECT cg.*, h.master_id AS of, h.lang AS flang, h.device AS fdev, CASE WHEN op = 'copy' AND copy_id IS NOT NULL THEN copy_id ELSE cg.master_id END AS page,
    op IN ('save', 'rename') OR (op = 'copy' AND copy_id IS NOT NULL) AS names FROM cg LEFT JOIN block_history h ON h.serial = cg.target),
  fst AS (SELECT hashtag, arg_min(page, seq) AS winner FROM src WHERE names AND hashtag NOT IN (SELECT hashtag FROM block) GROUP BY hashtag),
  jd AS (SELECT src.*, CASE WHEN op NOT IN ('save', 'rename', 'publish', 'unpublish', 'copy', 'delete_lang', 'purge') THEN 'unknown_op'
      WHEN op IN ('publish', 'copy') AND (of IS NULL OR of <> master_id OR (op = 'publish' AND flang <> lang)) THEN 'unknown_revision'
      WHEN names AND (EXISTS (SELECT 1 FROM block b WHERE b.hashtag = src.hashtag AND b.id <> page) OR EXISTS (SELECT 1 FROM fst WHERE fst.hashtag = src.hashtag AND winner <> page)) THEN 'hash_exist'
      WHEN op = 'copy' AND copy_id IS NULL AND (EXISTS (SELECT 1 FROM block_history h WHERE h.master_id = src.master_id AND h.lang = src.lang AND h.device = fdev)
        OR EXISTS (SELECT 1 FROM cg s WHERE s.op = 'save' AND s.master_id = src.master_id AND s.lang = src.lang AND s.device = fdev AND s.seq < src.seq)) THEN 'confirm_copy' END AS reason FROM src),
  ok AS (SELECT * FROM jd WHERE reason IS NULL), mx AS (SELECT max(serial) AS m FROM block_history),
  rw AS (SELECT serial, master_id, author_id, lang, device, isonline, ctime, -1 AS seq FROM block_history
    UNION ALL SELECT m + 1 + seq, page, author_id, lang, CASE op WHEN 'copy' THEN fdev ELSE device END, CASE op WHEN 'copy' THEN 0 ELSE isonline END, ctime, seq FROM ok, mx WHERE op IN ('save', 'copy')),
  dl AS (SELECT * FROM ok WHERE op IN ('purge', 'delete_lang')),
  lv AS (SELECT * FROM rw WHERE NOT EXISTS (SELECT 1 FROM dl WHERE dl.seq >= rw.seq AND dl.master_id = rw.master_id AND (op = 'purge' OR (dl.lang = rw.lang AND dl.device IS NULL) OR (dl.lang = rw.lang AND dl.device = rw.device)))
    AND NOT EXISTS (SELECT 1 FROM dl WHERE op = 'delete_lang' AND dl.master_id IS NULL AND dl.lang = rw.lang AND dl.seq >= rw.seq)),
  tm AS (SELECT lv.*, (SELECT max(seq) FROM ok WHERE op = 'publish' AND ok.target = lv.serial) AS pub,
    (SELECT max(seq) FROM ok WHERE op = 'unpublish' AND ok.master_id = lv.master_id AND ok.lang = lv.lang AND ok.device = lv.device) AS off FROM lv),
  oo AS (SELECT *, greatest(seq, coalesce(pub, -1)) AS drafted, nullif(greatest(CASE WHEN isonline = 1 THEN seq ELSE -2 END, coalesce(pub, -2)), -2) AS o FROM tm),
  lf AS (SELECT * EXCLUDE (o), CASE WHEN off IS NULL OR o > off THEN o END AS o FROM oo)"""

ORACLES = {
    "upsert": f"""WITH o AS ({OLD_BLACK}), c AS ({BLACK}), k AS (SELECT owner_id, email FROM o UNION SELECT owner_id, email FROM c),
      l AS (SELECT owner_id, email, list(sys_id * 10 + CASE op WHEN 'upsert' THEN 1 WHEN 'delete' THEN 2 ELSE 3 END ORDER BY seq) AS ops FROM c GROUP BY owner_id, email),
      f AS (SELECT k.owner_id, k.email, list_reduce(list_prepend(COALESCE(o.sys_id, -1), COALESCE(l.ops, CAST([] AS BIGINT[]))), lambda s, e: CASE e % 10 WHEN 1 THEN e // 10 WHEN 2 THEN -1 ELSE CASE WHEN s = -1 THEN e // 10 ELSE s END END) AS sys_id
        FROM k LEFT JOIN o ON o.owner_id = k.owner_id AND o.email = k.email LEFT JOIN l ON l.owner_id = k.owner_id AND l.email = k.email)
      SELECT owner_id, email, CAST(sys_id AS BIGINT) AS sys_id FROM f WHERE sys_id <> -1""",
    "reposition": f"""SELECT g.owner_id, g.tag_id, CASE WHEN g.owner_id = 'u1' AND g.tag_id = 'r3' THEN 0 WHEN g.owner_id = 'u1' AND g.tag_id = 'r1' THEN 1 WHEN g.owner_id = 'u1' AND g.tag_id = 'n4' THEN 2
      WHEN g.owner_id = 'u2' AND g.tag_id = 'r0' THEN 0 WHEN g.owner_id = 'u2' AND g.tag_id = 'n1' THEN 1 ELSE g.position END AS position FROM ({OWNED_TAGS}) g""",
    "index_upsert": f"""WITH c AS (SELECT id || '-' || lang AS key, arg_max(content, seq) AS content, arg_max(hashtag, seq) AS hashtag FROM ({PAGE_CHANGES}) z GROUP BY 1)
      SELECT * FROM c UNION ALL SELECT * FROM ({PAGES}) p WHERE p.key NOT IN (SELECT key FROM c)""",
    "post_messages": f"""WITH {_POST} SELECT owner_id, entity_id, COALESCE((SELECT max(sys_id) FROM channel c WHERE c.owner_id = fr.owner_id), 0) + row_number() OVER (PARTITION BY owner_id ORDER BY seq) AS sys_id, author_id, message_id,
      nullif(message, '') AS message, thread_id, attachment, ctime, CASE WHEN forward_message_id IS NOT NULL THEN 1 ELSE 0 END AS is_forward,
      '{{"_seen_":{{"' || author_id || '":1}},"_delivered_":{{"' || author_id || '":' || ctime || ',"' || CASE WHEN author_id = owner_id THEN entity_id ELSE owner_id END || '":' || ctime || '}}' ||
      CASE WHEN forward_message_id IS NULL THEN '' ELSE ',"forward_message_id":"' || forward_message_id || '","forward_hub_id":"' || forward_hub_id || '"' END || '}}' AS metadata FROM fr""",
    "post_team_messages": f"""WITH fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hub_id, message_id ORDER BY seq) AS rn FROM ({TEAM_POSTS}) p) q WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM team_channel c WHERE c.hub_id = q.hub_id AND c.message_id = q.message_id))
      SELECT hub_id, COALESCE((SELECT max(sys_id) FROM team_channel c WHERE c.hub_id = fr.hub_id), 0) + row_number() OVER (PARTITION BY hub_id ORDER BY seq) AS sys_id, author_id, message_id, nullif(message, '') AS message, thread_id, attachment, ctime FROM fr""",
    "markers_after_post": f"""WITH fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hub_id, message_id ORDER BY seq) AS rn FROM ({TEAM_POSTS}) p) q WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM team_channel c WHERE c.hub_id = q.hub_id AND c.message_id = q.message_id)),
      n AS (SELECT hub_id, author_id AS uid, COALESCE((SELECT max(sys_id) FROM team_channel c WHERE c.hub_id = fr.hub_id), 0) + row_number() OVER (PARTITION BY hub_id ORDER BY seq) AS ref_sys_id FROM fr)
      SELECT hub_id, uid, max(ref_sys_id) AS ref_sys_id FROM (SELECT hub_id, uid, ref_sys_id FROM team_read UNION ALL SELECT * FROM n) GROUP BY ALL""",
    "posted_threads": f"""WITH {_POST}, b AS (SELECT owner_id, entity_id, author_id, message, message_id, thread_id FROM channel UNION ALL SELECT owner_id, entity_id, author_id, nullif(message, ''), message_id, thread_id FROM fr)
      SELECT c.owner_id, c.entity_id, c.message_id, c.thread_id, coalesce(p.message, 'DELETED') AS thread_message, p.author_id AS thread_author_id
      FROM b c LEFT JOIN b p ON (p.owner_id, p.entity_id, p.message_id) = (c.owner_id, c.entity_id, c.thread_id) WHERE c.thread_id IS NOT NULL""",
    "clear_one_entity": f"""WITH clr AS (SELECT DISTINCT r.hub_id, r.owner_id AS uid FROM ({ROOMS}) r JOIN ({CLEAR_ONE}) o ON (o.uid, o.entity_id) = (r.owner_id, r.hub_id) WHERE r.area IN ('private', 'share', 'public'))
      SELECT hub_id, uid, ref_sys_id FROM team_read r ANTI JOIN clr USING (hub_id, uid)
      UNION ALL SELECT hub_id, uid, coalesce((SELECT max(ref_sys_id) FROM team_read r WHERE r.hub_id = clr.hub_id), 0) FROM clr""",
    "clear_one_inbox": f"""WITH n AS (SELECT owner_id, entity_id, owner_id AS uid, max(ref_sys_id) AS ref_sys_id FROM read_channel WHERE uid <> owner_id AND (owner_id, entity_id) IN (SELECT (uid, entity_id) FROM ({CLEAR_INBOX})) GROUP BY owner_id, entity_id)
      SELECT owner_id, entity_id, uid, ref_sys_id FROM read_channel r ANTI JOIN n USING (owner_id, entity_id, uid) UNION ALL SELECT * FROM n""",
    "apply_acks": f"""WITH a AS (SELECT DISTINCT * FROM ({ACKS}) z), x AS (
      SELECT a.uid AS owner_id, a.entity_id, a.uid, c.sys_id FROM a JOIN channel c ON c.owner_id = a.uid AND c.message_id = a.message_id
      UNION ALL SELECT a.entity_id, a.uid, a.uid, c.sys_id FROM a JOIN channel c ON c.owner_id = a.entity_id AND c.message_id = a.message_id
      UNION ALL SELECT a.uid, a.entity_id, a.entity_id, 0 FROM a JOIN channel c ON c.owner_id = a.uid AND c.message_id = a.message_id
      UNION ALL SELECT a.entity_id, a.uid, a.entity_id, 0 FROM a JOIN channel c ON c.owner_id = a.entity_id AND c.message_id = a.message_id
      UNION ALL SELECT owner_id, entity_id, uid, ref_sys_id FROM read_channel) SELECT owner_id, entity_id, uid, max(sys_id) AS ref_sys_id FROM x GROUP BY ALL""",
    "delete_status": f"WITH {_DEL} SELECT request_id, status FROM st",
    "apply_deletes": f"WITH {_DEL} SELECT owner_id, message_id FROM aft",
    "last_after_deletes": f"""WITH {_DEL} SELECT owner_id, entity_id, sys_id AS ref_sys_id, left(message, 100) AS message, ctime, CASE WHEN attachment IS NOT NULL THEN 1 ELSE 0 END AS is_attachment
      FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, entity_id ORDER BY sys_id DESC) AS rn FROM aft) WHERE rn = 1""",
    "deleted_files": f"WITH {_DEL} SELECT * FROM los",
    "usage_after_deletes": f"WITH {_DEL} SELECT u.hub_id, CAST(u.size - COALESCE((SELECT sum(filesize) FROM los WHERE los.hub_id = u.hub_id), 0) AS BIGINT) AS size FROM disk_usage u",
    "apply_team_deletes": f"WITH {_TDEL} SELECT hub_id, message_id FROM team_channel c WHERE NOT EXISTS (SELECT 1 FROM gon WHERE gon.hub_id = c.hub_id AND gon.sys_id = c.sys_id)",
    "team_tombstones": f"WITH {_TDEL} SELECT hub_id, uid, ref_sys_id FROM sto WHERE NOT EXISTS (SELECT 1 FROM gon WHERE gon.hub_id = sto.hub_id AND gon.sys_id = sto.ref_sys_id)",
    "clear_team_markers": f"""WITH {_CLR} SELECT hub_id, uid, ref_sys_id FROM team_read r WHERE NOT EXISTS (SELECT 1 FROM clr WHERE clr.hub_id = r.hub_id AND clr.uid = r.uid)
      UNION ALL SELECT hub_id, uid, COALESCE((SELECT max(ref_sys_id) FROM team_read r WHERE r.hub_id = clr.hub_id), 0) FROM clr""",
    "clear_file_markers": f"WITH {_CLR} SELECT clr.hub_id, uid, (SELECT max(sys_id) FROM hub_media m WHERE m.hub_id = clr.hub_id) AS seen_upto FROM clr WHERE hub_id IN (SELECT hub_id FROM hub_media)",
    "clear_private_markers": f"""WITH n AS (SELECT owner_id, entity_id, owner_id AS uid, max(ref_sys_id) AS ref_sys_id FROM read_channel WHERE uid <> owner_id AND owner_id IN ({CLEARING}) GROUP BY owner_id, entity_id)
      SELECT owner_id, entity_id, uid, ref_sys_id FROM read_channel r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.owner_id = r.owner_id AND n.entity_id = r.entity_id AND n.uid = r.uid) UNION ALL SELECT * FROM n""",
    "clear_ticket_markers": f"""WITH n AS (SELECT t.ticket_id, t.uid, max(r.ref_sys_id) AS ref_sys_id FROM ticket t JOIN read_ticket_channel r ON r.ticket_id = t.ticket_id WHERE t.uid IN ({CLEARING}) GROUP BY ALL)
      SELECT ticket_id, uid, ref_sys_id FROM read_ticket_channel r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.ticket_id = r.ticket_id AND n.uid = r.uid) UNION ALL SELECT * FROM n""",
    "call_log": f"""WITH c AS (SELECT * FROM ({CALLS}) z WHERE role = 'caller' AND type IN ('cancel', 'leave', 'reject')),
      b AS (SELECT seq, author_id AS owner_id, entity_id, author_id, message_id, ctime, type, duration, 'caller' AS r FROM c UNION ALL SELECT seq, entity_id, author_id, author_id, message_id, ctime, type, duration, 'callee' FROM c)
      SELECT owner_id, entity_id, COALESCE((SELECT max(sys_id) FROM channel x WHERE x.owner_id = b.owner_id), 0) + row_number() OVER (PARTITION BY owner_id ORDER BY seq) AS sys_id, author_id, message_id, 'call' AS message, ctime,
        '{{"message_type":"call","call_status":"' || type || '","duration":' || COALESCE(duration, 0) || ',"role":"' || r || '"}}' AS metadata FROM b""",
    "guests_and_tickets": f"SELECT t.ticket_id, t.uid, greatest(t.last_sys_id, (SELECT max(sys_id) FROM ({TICKETS}) p WHERE p.ticket_id = t.ticket_id)) AS last_sys_id FROM ticket t",
    "ticket_markers": f"""SELECT ticket_id, uid, max(r) AS ref_sys_id FROM (SELECT ticket_id, uid, ref_sys_id AS r FROM read_ticket_channel
      UNION ALL SELECT ticket_id, author_id, sys_id FROM ({TICKETS}) p WHERE ticket_id IN (SELECT ticket_id FROM ticket)) GROUP BY ALL""",
    "invitation_fold": _FOLD,
    "email_invites": f"""WITH {_LIVE}, m AS ({MAILED}) SELECT DISTINCT l.user_id AS owner_id, l.inviter_id AS entity, d.firstname, d.lastname, 'received' AS status FROM live l JOIN user_dir d ON d.id = l.inviter_id
      WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.owner_id = l.user_id AND m.entity = l.inviter_id)""",
    "email_invite_rewrites": f"WITH {_LIVE}, m AS ({MAILED}) SELECT m.owner_id, m.sys_id, m.id, COALESCE((SELECT min(l.user_id) FROM live l WHERE l.inviter_id = m.owner_id AND l.email = m.entity), m.entity) AS entity, m.status FROM m",
    "email_invite_tokens": f"WITH {_LIVE} SELECT inviter_id, sys_id, email, CASE WHEN email IN (SELECT email FROM live) THEN 'passive' ELSE status END AS status FROM token",
    "contact_sync": f"""WITH {_DUE} SELECT c.owner_id, c.id, c.entity, c.uid, c.firstname, c.lastname, c.status FROM contact c WHERE NOT EXISTS (SELECT 1 FROM due WHERE due.owner_id = c.owner_id AND due.uid = c.entity)
      UNION ALL SELECT owner_id, id, id, id, firstname, lastname, 'active' FROM pt""",
    "contact_sync_phones": f"WITH {_DUE} SELECT owner_id, contact_id, areacode, phone, category FROM contact_phone x {_KEPT_CHILD} UNION ALL SELECT owner_id, id, json_extract_string(profile, '$.areacode'), json_extract_string(profile, '$.mobile'), 'prof' FROM pt",
    "contact_sync_emails": f"WITH {_DUE} SELECT owner_id, contact_id, email, category, is_default FROM contact_email x {_KEPT_CHILD} UNION ALL SELECT owner_id, id, email, 'prof', 1 FROM pt",
    "contact_sync_addresses": f"WITH {_DUE} SELECT owner_id, contact_id, address, category FROM contact_address x {_KEPT_CHILD} UNION ALL SELECT owner_id, id, CAST(json_extract(profile, '$.address') AS VARCHAR), 'prof' FROM pt",
    "contact_sync_pairs": "SELECT uid, owner_id, 'ok' AS status FROM contact_sync WHERE status <> 'delete'",
    "contact_children": """SELECT owner_id, contact_id, email, category, is_default FROM contact_email e WHERE contact_id NOT IN (SELECT id FROM contact WHERE status = 'active')
      UNION ALL SELECT owner_id, id, 'a' || sys_id || '@x.example', 'prof', 1 FROM contact WHERE status = 'active' UNION ALL SELECT owner_id, id, 'b@x.example', 'priv', 0 FROM contact WHERE status = 'active'""",
    "contact_child_phones": """SELECT owner_id, contact_id, areacode, phone, category FROM contact_phone WHERE contact_id NOT IN (SELECT id FROM contact WHERE status = 'active')
      UNION ALL SELECT owner_id, id, '+1', CAST(sys_id AS VARCHAR), 'priv' FROM contact WHERE status = 'active'""",
    "contact_child_addresses": """SELECT owner_id, contact_id, address, category FROM contact_address WHERE contact_id NOT IN (SELECT id FROM contact WHERE status = 'active')
      UNION ALL SELECT owner_id, id, '{"street":"S' || sys_id || '","city":"C"}', 'priv' FROM contact WHERE status = 'active' AND sys_id % 2 = 0""",
    "contact_delete": "SELECT owner_id, id FROM contact WHERE status <> 'memory'",
    "contact_delete_phones": "SELECT owner_id, id FROM contact_phone WHERE contact_id NOT IN (SELECT id FROM contact WHERE status = 'memory')",
    "contact_edit": f"""WITH e AS ({EDITS}), mv AS (SELECT c.owner_id, c.entity FROM contact c JOIN e ON e.owner_id = c.owner_id AND e.id = c.id WHERE c.status NOT IN ('informed', 'received', 'active') AND e.entity <> c.entity)
      SELECT c.owner_id, c.id, CASE WHEN e.id IS NOT NULL THEN nullif(e.surname, '') ELSE c.surname END AS surname, CASE WHEN e.id IS NOT NULL THEN nullif(e.firstname, '') ELSE c.firstname END AS firstname,
        CASE WHEN e.id IS NOT NULL THEN nullif(e.lastname, '') ELSE c.lastname END AS lastname, CASE WHEN e.id IS NOT NULL THEN e.message ELSE c.message END AS message, CASE WHEN e.id IS NOT NULL THEN e.entity ELSE c.entity END AS entity,
        CASE WHEN e.id IS NOT NULL AND c.status NOT IN ('informed', 'received', 'active') AND e.entity <> c.entity THEN 'memory' ELSE c.status END AS status, c.uid
      FROM contact c LEFT JOIN e ON e.owner_id = c.owner_id AND e.id = c.id WHERE NOT (c.status = 'received' AND EXISTS (SELECT 1 FROM mv WHERE mv.entity = c.owner_id AND mv.owner_id = c.entity))""",
    "block_edit": """SELECT c.owner_id, c.id AS contact_id, c.entity, c.uid FROM contact c WHERE (c.status = 'received' OR c.id IN (SELECT contact_id FROM contact_block)) AND c.status <> 'active'""",
    "apply_grants": f"""WITH {_GR}, own AS (SELECT DISTINCT hub_id FROM ev WHERE resource_id = '*' AND permission = 63)
      SELECT hub_id, resource_id, entity_id, permission, expiry_time, assign_via FROM ev WHERE hub_id IN (SELECT hub_id FROM own)
      UNION ALL SELECT hub_id, resource_id, entity_id, permission, expiry_time, assign_via FROM g0 WHERE hub_id NOT IN (SELECT hub_id FROM own)""",
    "make_owner": f"""WITH r AS (SELECT hub_id, min(uid) AS uid FROM ({OWNER_MOVES}) z GROUP BY hub_id), g AS ({GRANTS})
      SELECT g.* FROM g LEFT JOIN r ON r.hub_id = g.hub_id WHERE NOT (r.hub_id IS NOT NULL AND g.resource_id = '*' AND (g.permission = 63 OR g.entity_id = r.uid)) UNION ALL SELECT hub_id, '*', uid, 63, CAST(0 AS BIGINT), 'system' FROM r""",
    "membership": f"WITH {_MEM} SELECT * FROM now",
    "membership_desk": f"WITH {_MEM} SELECT now.uid AS owner_id, h.id, h.name AS user_filename, 'hub' AS category FROM now JOIN hub h ON h.id = now.hub_id",
    "offboard": f"""WITH g AS ({LEAVERS}), lost AS (SELECT DISTINCT hub_id FROM hub_member WHERE permission = 63 AND uid IN (SELECT uid FROM g))
      SELECT hub_id, uid FROM (SELECT m.hub_id, m.uid, row_number() OVER (PARTITION BY m.hub_id ORDER BY CASE WHEN permission = 63 THEN 0 WHEN permission & 16 > 0 THEN 1 ELSE 2 END, m.uid) AS rn
      FROM hub_member m WHERE m.hub_id IN (SELECT hub_id FROM lost) AND m.uid NOT IN (SELECT uid FROM g)) WHERE rn = 1""",
    "revisions": f"""WITH {_REV} SELECT serial, master_id, lang, CASE WHEN row_number() OVER (PARTITION BY master_id, lang ORDER BY drafted DESC, serial DESC) = 1 THEN 'draft' ELSE 'history' END AS status,
      CASE WHEN o IS NOT NULL AND row_number() OVER (PARTITION BY master_id, lang ORDER BY o DESC NULLS LAST, serial DESC) = 1 THEN 1 ELSE 0 END AS isonline,
      first_value(serial) OVER (PARTITION BY master_id ORDER BY drafted DESC, serial DESC) AS active, author_id, device, ctime FROM lf""",
    "revision_pages": f"""WITH {_REV}, nm AS (SELECT page, arg_max(hashtag, seq) AS tag FROM ok WHERE names GROUP BY page), ac AS (SELECT master_id AS id, max_by(serial, (drafted, serial)) AS active FROM lf GROUP BY master_id)
      SELECT ac.id, ifnull(nm.tag, b.hashtag) AS hashtag, ac.active FROM ac LEFT JOIN nm ON nm.page = ac.id LEFT JOIN block b ON b.id = ac.id""",
    "revision_refused": f"WITH {_REV} SELECT seq, op, master_id, hashtag, reason, CASE reason WHEN 'hash_exist' THEN 1 ELSE 0 END AS hash_exist FROM jd WHERE reason IS NOT NULL",
    "tag_edit": f"""WITH RECURSIVE ed AS ({TAG_EDITS}),
      ad AS (SELECT tag_id, parent_tag_id, seq, row_number() OVER (ORDER BY seq) AS pos, CASE WHEN name = 'fresh' AND row_number() OVER (PARTITION BY name ORDER BY seq) = 1 THEN name
        ELSE name || ' (' || (row_number() OVER (PARTITION BY name ORDER BY seq) - CASE WHEN name = 'fresh' THEN 1 ELSE 0 END) || ')' END AS name FROM ed WHERE op = 'add'),
      nw AS (SELECT tag_id, parent_tag_id, name, CAST(position AS INTEGER) AS position FROM tag UNION ALL SELECT tag_id, parent_tag_id, name, CAST((SELECT max(position) FROM tag) + pos AS INTEGER) FROM ad),
      dn AS (SELECT tag_id AS anc, tag_id AS d FROM nw UNION ALL SELECT dn.anc, nw.tag_id FROM dn JOIN nw ON nw.parent_tag_id = dn.d),
      mv AS (SELECT tag_id, arg_max(parent_tag_id, seq) AS np FROM ed WHERE op = 'assign' GROUP BY tag_id),
      xx AS (SELECT nw.tag_id, CASE WHEN mv.np IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dn WHERE dn.anc = nw.tag_id AND dn.d = mv.np) THEN mv.np ELSE nw.parent_tag_id END AS parent_tag_id,
        COALESCE((SELECT arg_max(name, seq) FROM ed WHERE op = 'rename' AND ed.tag_id = nw.tag_id), nw.name) AS name, nw.position FROM nw LEFT JOIN mv ON mv.tag_id = nw.tag_id),
      rm AS (SELECT tag_id FROM ed WHERE op = 'remove' UNION SELECT xx.tag_id FROM rm JOIN xx ON xx.parent_tag_id = rm.tag_id)
      SELECT * FROM xx WHERE tag_id NOT IN (SELECT tag_id FROM rm)""",
    "language_state": f"""WITH RECURSIVE o AS (SELECT hub_id, base, state, row_number() OVER (PARTITION BY hub_id ORDER BY seq) AS n FROM ({LANGS}) z),
      f AS (SELECT CAST(0 AS BIGINT) AS n, hub_id, sys_id, base, state FROM language
        UNION ALL SELECT o.n, f.hub_id, f.sys_id, f.base, CASE WHEN f.base = o.base AND NOT (o.state IN ('frozen', 'deleted') AND count(*) FILTER (f.state = 'active') OVER (PARTITION BY f.hub_id) <= 1) THEN o.state ELSE f.state END
          FROM f JOIN o ON o.hub_id = f.hub_id AND o.n = f.n + 1)
      SELECT hub_id, sys_id, base, arg_max(state, n) AS state FROM f GROUP BY hub_id, sys_id, base""",
    "subscription_fold": """WITH e AS (SELECT *, CASE WHEN type = 'customer.subscription.deleted' OR (type = 'customer.subscription.updated' AND status = 'incomplete_expired') THEN 'ended'
        WHEN type LIKE 'customer.%' THEN 'row' WHEN type = 'invoice.paid' THEN 'paid' ELSE 'failed' END AS kind FROM billing_event),
      s AS (SELECT entity_id, arg_max(kind, seq) AS kind, arg_max(subscription_id, seq) AS sid, arg_max(status, seq) AS st FROM e WHERE kind IN ('ended', 'row') GROUP BY entity_id),
      p AS (SELECT entity_id, arg_max(kind, seq) AS kind FROM e WHERE kind IN ('paid', 'failed') GROUP BY entity_id),
      x AS (SELECT entity_id, max(seq) FILTER (kind = 'paid') AS r, max(seq) FILTER (kind = 'ended') AS d, count(*) FILTER (kind = 'paid') AS n FROM e GROUP BY entity_id)
      SELECT x.entity_id, CASE WHEN s.kind = 'row' THEN sid END AS subscription_id, CASE WHEN s.kind = 'row' THEN st END AS status, CASE p.kind WHEN 'failed' THEN 'open' WHEN 'paid' THEN 'paid' END AS payment,
        r AS renewed_seq, n AS n_paid, CASE WHEN r IS NOT NULL AND (d IS NULL OR r > d) THEN 'pro' ELSE 'basic' END AS plan FROM x LEFT JOIN s ON s.entity_id = x.entity_id LEFT JOIN p ON p.entity_id = x.entity_id""",
}
