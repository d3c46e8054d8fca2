-- name: user_dir
SELECT 'u' || CAST(c_custkey AS STRING) AS id,
       'u' || CAST(c_custkey AS STRING) || '@d' || CAST(c_nationkey AS STRING) || '.example' AS email,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS firstname,
       CASE WHEN c_custkey % 11 = 0 OR c_custkey % 7 = 0 THEN NULL ELSE c_name END AS lastname,
       c_nationkey AS domain_id,
       CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS connected,
       'nick' || CAST(c_custkey % 1100 AS STRING) AS username,
       CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END || ' ' ||
       CASE WHEN c_custkey % 11 = 0 OR c_custkey % 7 = 0 THEN '' ELSE c_name END AS fullname,
       '{"firstname":"' || c_mktsegment || '","lastname":"' || c_name || '","mobile":"06' || CAST(c_custkey AS STRING) ||
       '","areacode":"+33","address":{"city":"C' || CAST(c_nationkey AS STRING) || '"}}' AS profile
FROM customer
;
-- name: contact
WITH o AS (SELECT o_orderkey AS k, o_custkey AS oc,
                  CASE WHEN o_custkey < (SELECT max(user_id) + 1 FROM events)
                       THEN (o_custkey * 3 + o_orderkey % 8 + 1) % (SELECT max(user_id) + 1 FROM events)
                       ELSE (o_orderkey * 7 + 3) % (SELECT count(*) FROM customer) END AS ec
           FROM orders),
     p AS (SELECT oc, ec, min(k) AS k FROM o GROUP BY oc, ec),
     q AS (SELECT oc, ec, k, CASE k % 7 WHEN 0 THEN 'memory' WHEN 1 THEN 'sent' WHEN 2 THEN 'received'
                 WHEN 3 THEN 'invitation' WHEN 4 THEN 'informed' ELSE 'active' END AS status
           FROM p WHERE oc <> ec)
SELECT k AS sys_id, 'u' || CAST(oc AS STRING) AS owner_id, 'c' || CAST(k AS STRING) AS id,
       CASE WHEN k % 5 = 0 THEN 'S' || CAST(k AS STRING) END AS surname,
       CASE WHEN k % 3 = 0 THEN NULL ELSE 'F' || CAST(ec AS STRING) END AS firstname,
       CASE WHEN k % 4 = 0 THEN NULL ELSE 'L' || CAST(ec AS STRING) END AS lastname,
       'u' || CAST(ec AS STRING) AS entity,
       CASE WHEN status IN ('informed', 'active') THEN 'u' || CAST(ec AS STRING) END AS uid,
       CASE WHEN k % 6 = 1 THEN 's' || CAST(k AS STRING) || '@src.example' END AS source,
       CASE WHEN k % 6 = 1 THEN '{"source":"s' || CAST(k AS STRING) || '@src.example","is_auto":' || CAST(k % 2 AS STRING) || '}' END AS metadata,
       CASE WHEN k % 9 = 4 THEN 'hello ' || CAST(k AS STRING) END AS message,
       status, 1000000000 + k AS ctime, 1000000000 + 2 * k AS mtime
FROM q
;
-- name: channel
WITH m AS (SELECT event_id, user_id AS a, (user_id * 3 + event_id % 8 + 1) % (SELECT max(user_id) + 1 FROM events) AS b, event_type,
                  CASE WHEN event_id % 10 = 3 THEN '{"message_type":"call","call_status":"missed","duration":"' || CAST(event_id % 60 AS STRING) || '"}'
                       ELSE props END AS metadata,
                  CASE WHEN event_id % 6 = 0 THEN '[{"hub_id":"h' || CAST(event_id % 900 % (SELECT count(*) FROM supplier) AS STRING) || '","nid":"d' || CAST(event_id % 900 AS STRING) || '"}]'
                       WHEN event_id % 6 = 1 THEN '[{"hub_id":"h' || CAST(event_id % 700 % (SELECT count(*) FROM supplier) AS STRING) || '","nid":"d' || CAST(event_id % 700 AS STRING) || '"},{"hub_id":"h3","nid":"d' || CAST(event_id % 500 AS STRING) || '"}]'
                       WHEN event_id % 6 = 2 THEN '[]' END AS attachment
           FROM events)
SELECT event_id AS sys_id, 'u' || CAST(a AS STRING) AS owner_id, 'u' || CAST(b AS STRING) AS entity_id,
       'u' || CAST(a AS STRING) AS author_id, 'm' || CAST(event_id AS STRING) AS message_id,
       event_type AS message, 1700000000 + event_id AS ctime, metadata, attachment, CAST(NULL AS STRING) AS thread_id
FROM m WHERE a <> b
UNION ALL
SELECT event_id, 'u' || CAST(b AS STRING), 'u' || CAST(a AS STRING), 'u' || CAST(a AS STRING),
       'm' || CAST(event_id AS STRING), event_type, 1700000000 + event_id, metadata, attachment, CAST(NULL AS STRING)
FROM m WHERE a <> b
;
-- name: read_channel
SELECT owner_id, entity_id, owner_id AS uid, max(CASE WHEN sys_id % 3 = 0 THEN sys_id ELSE 0 END) AS ref_sys_id
FROM channel GROUP BY owner_id, entity_id
UNION ALL
SELECT owner_id, entity_id, entity_id, max(CASE WHEN sys_id % 4 = 0 THEN sys_id ELSE 0 END)
FROM channel GROUP BY owner_id, entity_id
;
-- name: hub
SELECT 'h' || CAST(s_suppkey AS STRING) AS id, 'u' || CAST(s_suppkey AS STRING) AS owner_id, s_name AS name,
       s_suppkey % 4 AS serial,
       CASE s_suppkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'share' WHEN 2 THEN 'public' ELSE 'dmz' END AS area
FROM supplier
;
-- name: hub_channel
SELECT 'h' || CAST(conv_id % 10 AS STRING) AS hub_id, conv_id * 100 + turn AS sys_id, role AS author_id,
       'g' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS message_id, text AS message,
       1700000000 + conv_id * 100 + turn AS ctime
FROM conversations
;
-- name: hub_read_channel
SELECT hub_id, author_id AS uid, max(CASE WHEN sys_id % 5 = 0 THEN sys_id ELSE 0 END) AS ref_sys_id
FROM hub_channel GROUP BY hub_id, author_id
;
-- name: tag
SELECT 'r' || CAST(r_regionkey AS STRING) AS tag_id, NULL AS parent_tag_id, r_name AS name, r_regionkey AS position FROM region
UNION ALL
SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), n_name, 5 + n_nationkey FROM nation
UNION ALL
SELECT DISTINCT 'n' || CAST(c_nationkey AS STRING) || '.' || c_mktsegment, 'n' || CAST(c_nationkey AS STRING),
       c_mktsegment || ' ' || CAST(c_nationkey AS STRING), 100 + c_nationkey FROM customer
;
-- name: map_tag
SELECT 'n' || CAST(c.c_nationkey AS STRING) || '.' || c.c_mktsegment AS tag_id, k.id AS id, k.owner_id AS owner_id
FROM contact k JOIN customer c ON k.entity = 'u' || CAST(c.c_custkey AS STRING)
;
-- name: media
SELECT id AS hub_id, 'root' AS id, '0' AS parent_id, 'u0' AS owner_id, 'folder' AS category, CAST(0 AS BIGINT) AS filesize, '/' AS user_filename, CAST(0 AS BIGINT) AS upload_time FROM hub
UNION ALL
SELECT 'h' || CAST(o_orderkey % (SELECT count(*) FROM supplier) AS STRING), 'o' || CAST(o_orderkey AS STRING), 'root', 'u' || CAST(o_custkey AS STRING), 'folder', 0,
       'order-' || CAST(o_orderkey AS STRING), 1000000000 + o_orderkey FROM orders
UNION ALL
SELECT 'h' || CAST(o_orderkey % (SELECT count(*) FROM supplier) AS STRING),
       'f' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING),
       'o' || CAST(l_orderkey AS STRING), 'u' || CAST(o_custkey AS STRING),
       CASE l_returnflag WHEN 'A' THEN 'image' WHEN 'N' THEN 'document' ELSE 'video' END,
       CAST(floor(l_quantity) AS BIGINT), 'line-' || CAST(l_linenumber AS STRING), 1000000000 + l_orderkey
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
;
-- name: permission
SELECT '*' AS resource_id, id AS entity_id, CASE WHEN domain_id = 0 THEN 63 WHEN domain_id < 5 THEN 31 ELSE 7 END AS permission,
       0 AS expiry_time FROM user_dir
UNION ALL
SELECT 'o' || CAST(o_orderkey AS STRING), 'u' || CAST((o_custkey + 1) % 10 AS STRING), 3,
       CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1000000000 + o_orderkey END FROM orders WHERE o_orderkey % 10 = 0
;
-- name: action_log
SELECT event_id AS sys_id, 'u' || CAST(user_id AS STRING) AS uid,
       CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' WHEN 'view' THEN 'changed' WHEN 'click' THEN 'backup' ELSE 'removed' END AS action,
       CASE event_id % 4 WHEN 0 THEN 'media' WHEN 1 THEN 'permission' WHEN 2 THEN 'member' ELSE 'admin' END AS category,
       CASE event_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'member' ELSE 'admin' END AS notify_to,
       'u' || CAST((user_id + 1) % 10 AS STRING) AS entity_id, props AS log, 1700000000 + event_id AS ctime
FROM events
;
-- name: login_log
SELECT event_id AS sys_id, 'u' || CAST(user_id AS STRING) AS owner_id, 'k' || CAST(user_id AS STRING) || '-' || CAST(event_id % 3 AS STRING) AS cookie_id,
       props AS metadata, CASE WHEN event_type <> 'error' THEN 1700000000 + event_id END AS intime,
       CASE WHEN event_type = 'error' THEN 1700000000 + event_id END AS outtime
FROM events
;
-- name: block_history
SELECT o_orderkey AS serial, 'b' || CAST(o_custkey % 50 AS STRING) AS master_id, 'u' || CAST(o_custkey AS STRING) AS author_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'zh' END AS lang,
       CASE o_orderkey % 2 WHEN 0 THEN 'desktop' ELSE 'mobile' END AS device,
       CASE o_orderstatus WHEN 'O' THEN 'draft' ELSE 'history' END AS status,
       CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS isonline, 1000000000 + o_orderkey AS ctime
FROM orders
;
-- name: archive_entity
SELECT owner_id, id AS entity_id FROM contact WHERE sys_id % 10 = 0
UNION ALL
SELECT owner_id, id FROM hub WHERE serial = 1
;
-- name: contact_email
SELECT k.sys_id AS sys_id, k.owner_id AS owner_id, 'e' || CAST(k.sys_id AS STRING) AS id, k.id AS contact_id, d.email AS email,
       CASE WHEN k.sys_id % 2 = 0 THEN 'prof' ELSE 'priv' END AS category, CASE WHEN k.sys_id % 4 = 3 THEN 0 ELSE 1 END AS is_default
FROM contact k JOIN user_dir d ON d.id = k.entity
;
-- name: contact_phone
SELECT sys_id * 2 AS sys_id, owner_id, 'p' || CAST(sys_id AS STRING) AS id, id AS contact_id, '+33' AS areacode,
       CAST(100000 + sys_id AS STRING) AS phone, 'prof' AS category FROM contact WHERE sys_id % 3 <> 0
UNION ALL
SELECT sys_id * 2 + 1, owner_id, 'q' || CAST(sys_id AS STRING), id, '', CAST(200000 + sys_id AS STRING), 'priv' FROM contact WHERE sys_id % 6 = 1
;
-- name: contact_address
SELECT sys_id, owner_id, 'a' || CAST(sys_id AS STRING) AS id, id AS contact_id, 'priv' AS category,
       '{"street":"' || CAST(sys_id % 100 AS STRING) || ' Main","city":"C' || CAST(sys_id % 9 AS STRING) || '"}' AS address
FROM contact WHERE sys_id % 5 <> 0
;
-- name: contact_block
SELECT sys_id, owner_id, id AS contact_id, entity, uid FROM contact WHERE sys_id % 20 = 7
;
-- name: socket
SELECT 's' || CAST(event_id AS STRING) AS id, 'u' || CAST(user_id AS STRING) AS uid, 'srv' || CAST(event_id % 3 AS STRING) AS server,
       CASE WHEN event_id % 5 = 0 THEN 'active' ELSE 'idle' END AS state
FROM events WHERE event_type = 'signup' AND event_id % 7 < 2
;
-- name: disk_usage
SELECT 'h' || CAST(l_suppkey AS STRING) AS hub_id, CAST(sum(floor(l_quantity)) AS BIGINT) AS size FROM lineitem GROUP BY l_suppkey
;
-- name: ticket
SELECT o_custkey AS ticket_id, 'u' || CAST(o_custkey % 50 AS STRING) AS uid, max(o_orderkey) AS last_sys_id FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey
;
-- name: read_ticket_channel
SELECT ticket_id, uid, last_sys_id - ticket_id % 2 AS ref_sys_id, 1700000000 + ticket_id AS ctime FROM ticket WHERE ticket_id % 4 <> 0
;
-- name: block
SELECT master_id AS id, 'page-' || CAST(count(*) % 7 AS STRING) || '-v' || substr(master_id, 2) AS hashtag, min(author_id) AS author_id,
       max(serial) AS active, max(ctime) AS mtime, CASE WHEN count(*) % 2 = 0 THEN 'page' ELSE 'block' END AS type
FROM block_history GROUP BY master_id
;
-- name: content_tag
SELECT p_partkey AS sys_id, 'b' || CAST(p_partkey % 50 AS STRING) AS id, p_type AS name, p_brand AS description,
       CASE WHEN p_partkey % 4 = 0 THEN 'offline' ELSE 'online' END AS status, p_size AS rank, p_size % 5 AS group_rank
FROM part
;
-- name: delete_channel
SELECT c.hub_id AS hub_id, c.sys_id AS ref_sys_id, r.uid AS uid FROM hub_channel c JOIN hub_read_channel r ON r.hub_id = c.hub_id
WHERE c.sys_id % 4 = 0 OR (c.sys_id % 3 = 0 AND r.uid = 'user')
;
-- name: member_import
SELECT c_custkey AS row_no, CASE WHEN c_custkey % 13 = 0 THEN '' ELSE c_mktsegment END AS firstname,
       CASE WHEN c_custkey % 26 = 0 THEN '' ELSE c_name END AS lastname,
       CASE WHEN c_custkey % 17 = 0 THEN 'not-an-email' WHEN c_custkey % 19 = 0 THEN ''
            ELSE 'n' || CAST(c_custkey % 900 AS STRING) || '@x.example' END AS email,
       CASE WHEN c_custkey % 23 = 0 THEN 'abc' ELSE '06' || CAST(10000000 + c_custkey AS STRING) END AS mobile,
       CASE WHEN c_custkey % 29 = 0 THEN '' ELSE '+33' END AS areacode, CASE WHEN c_custkey % 10 = 3 THEN 'nick' ELSE 'ident' END || CAST(c_custkey % 1200 AS STRING) AS ident,
       c_custkey % 3 AS domain_id
FROM customer
;
-- name: contact_csv
SELECT c_custkey AS row_no, 'u' || CAST(c_custkey % 40 AS STRING) AS owner_id, c_mktsegment AS firstname, c_name AS lastname,
       CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'u' || CAST(c_custkey % 700 AS STRING) || '@d' || CAST(c_nationkey AS STRING) || '.example' END AS email1,
       CASE WHEN c_custkey % 4 = 0 THEN 'w' || CAST(c_custkey AS STRING) || '@y.example' ELSE 'bad' END AS email2,
       '+33 6 ' || CAST(c_custkey AS STRING) AS phone1, '1 Main St, Town, Land' AS address1
FROM customer
;
-- name: relation_event
SELECT event_id AS seq, 'u' || CAST(user_id AS STRING) AS actor, 'u' || CAST((user_id + 1 + event_id % 3) % 150 AS STRING) AS target,
       CASE event_type WHEN 'signup' THEN 'invite' WHEN 'view' THEN 'accept' WHEN 'click' THEN 'acknowledge' WHEN 'error' THEN 'refuse' ELSE 'delete' END AS event
FROM events
;
-- name: billing_event
SELECT event_id AS seq, 'u' || CAST(user_id AS STRING) AS entity_id, 'sub' || CAST(user_id % 40 AS STRING) AS subscription_id,
       CASE event_type WHEN 'signup' THEN 'customer.subscription.created' WHEN 'view' THEN 'customer.subscription.updated' WHEN 'purchase' THEN 'invoice.paid'
            WHEN 'error' THEN 'invoice.payment_failed' ELSE 'customer.subscription.deleted' END AS type,
       CASE WHEN event_id % 11 = 0 THEN 'incomplete_expired' ELSE 'active' END AS status, value AS amount
FROM events
;
-- name: hub_member
SELECT 'h' || CAST(l_suppkey AS STRING) AS hub_id, 'u' || CAST(o_custkey AS STRING) AS uid, min(l_orderkey * 10 + l_linenumber) AS sys_id,
       CASE WHEN l_suppkey = o_custkey THEN 63 WHEN (l_suppkey + o_custkey) % 9 = 0 THEN 31 WHEN o_custkey % 2 = 0 THEN 7 ELSE 3 END AS permission
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY l_suppkey, o_custkey
;
-- name: team_channel
SELECT 'h' || CAST(event_id % (SELECT count(*) FROM supplier) AS STRING) AS hub_id, event_id AS sys_id, 'u' || CAST(user_id AS STRING) AS author_id,
       't' || CAST(event_id AS STRING) AS message_id, event_type || ' ' || CAST(value AS STRING) AS message, 1700000000 + event_id AS ctime,
       CASE WHEN event_id % 7 = 3 THEN 't' || CAST(event_id - (SELECT count(*) FROM supplier) AS STRING) END AS thread_id,
       CASE WHEN event_id % 6 = 1 THEN '[{"hub_id":"h2","nid":"d' || CAST(event_id % 700 AS STRING) || '"}]' END AS attachment,
       CASE event_id % 3 WHEN 0 THEN '{"_seen_":{"u1":1,"u2":2},"_delivered_":{"u1":1,"u2":2}}' WHEN 1 THEN '{"_seen_":{"u1":1},"_delivered_":{"u1":1,"u2":2}}' END AS metadata
FROM events
;
-- name: team_read
SELECT hub_id, uid, sys_id * 31 % (SELECT max(event_id) + 1 FROM events) AS ref_sys_id, 1600000000 + sys_id AS ctime
FROM hub_member WHERE sys_id % 5 <> 0
;
-- name: team_delete
SELECT c.hub_id AS hub_id, c.author_id AS uid, c.sys_id AS ref_sys_id FROM team_channel c WHERE c.sys_id % 3 = 0
UNION
SELECT c.hub_id, m.uid, c.last_id FROM (SELECT hub_id, max(sys_id) AS last_id FROM team_channel GROUP BY hub_id) c JOIN hub_member m ON m.hub_id = c.hub_id
WHERE m.sys_id % 4 = 0
;
-- name: hub_media
SELECT 'h' || CAST(o_orderkey % (SELECT count(*) FROM supplier) AS STRING) AS hub_id, o_orderkey AS sys_id, 'd' || CAST(o_orderkey AS STRING) AS id,
       'u' || CAST(o_custkey AS STRING) AS owner_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'document' WHEN 2 THEN 'video' ELSE 'folder' END AS category,
       CASE WHEN o_orderkey % 20 = 7 THEN '/__chat__/f' WHEN o_orderkey % 20 = 8 THEN '/__trash__/f' ELSE '/docs//f<b>' END || CAST(o_orderkey AS STRING) AS file_path,
       'file-' || CAST(o_orderkey AS STRING) AS user_filename, 'txt' AS extension, 'text/plain' AS mimetype,
       CAST(floor(o_totalprice) AS BIGINT) AS filesize, 1000000000 + o_orderkey AS upload_time,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN '{}'
            ELSE '{"_seen_":{"u' || CAST(o_custkey AS STRING) || '":1600000001,"u' || CAST((o_custkey * 3 + 1) % (SELECT count(*) FROM customer) AS STRING) || '":1600000002}}' END AS metadata
FROM orders
;
-- name: file_seen
SELECT hub_id, id, owner_id AS uid FROM hub_media WHERE sys_id % 5 > 1
UNION
SELECT 'h' || CAST(o_orderkey % (SELECT count(*) FROM supplier) AS STRING), 'd' || CAST(o_orderkey AS STRING),
       'u' || CAST((o_custkey * 3 + 1) % (SELECT count(*) FROM customer) AS STRING)
FROM orders WHERE o_orderkey % 5 > 1
;
-- name: blacklist
SELECT k.owner_id AS owner_id, k.sys_id AS sys_id, d.email AS email FROM contact k JOIN user_dir d ON d.id = k.entity WHERE k.sys_id % 12 = 5
;
-- name: language_dir
SELECT 'l' || CAST(n_nationkey AS STRING) AS base, lower(n_name) AS name, 'l' || CAST(n_nationkey AS STRING) || '_' || CAST(n_regionkey AS STRING) AS locale FROM nation
;
-- name: language
SELECT hub_id, min(k) AS sys_id, base, CASE min(k) % 4 WHEN 0 THEN 'deleted' WHEN 1 THEN 'frozen' WHEN 2 THEN 'replaced' ELSE 'active' END AS state
FROM (SELECT 'h' || CAST(p_partkey * 7 % (SELECT count(*) FROM supplier) AS STRING) AS hub_id, p_partkey AS k, 'l' || CAST(p_size % 25 AS STRING) AS base FROM part) q
GROUP BY hub_id, base
;
-- name: used_fonts
SELECT 'u' || CAST(user_id AS STRING) AS owner_id, event_id AS sys_id, 'font' || CAST(event_id * 7 % 12 AS STRING) AS name, 1700000000 + event_id AS ctime
FROM events
;
-- name: mark
SELECT 'u' || CAST(conv_id % 40 AS STRING) AS owner_id, 'v' || CAST(conv_id % 7 AS STRING) AS conversation_id,
       CASE WHEN (conv_id + turn) % 3 = 0 THEN 'new' ELSE 'read' END AS status
FROM conversations
;
-- name: token
SELECT 'u' || CAST(o_custkey AS STRING) AS inviter_id, o_orderkey AS sys_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'x' || CAST(o_orderkey % 400 AS STRING) || '@new.example'
            ELSE 'u' || CAST(o_orderkey * 11 % (SELECT count(*) FROM customer) AS STRING) || '@d' || CAST(o_orderkey % 25 AS STRING) || '.example' END AS email,
       CASE WHEN o_orderkey % 4 = 0 THEN 'passive' ELSE 'active' END AS status
FROM orders WHERE o_orderkey % 2 = 0
;
-- name: contact_sync
SELECT uid, owner_id, CASE sys_id % 6 WHEN 5 THEN 'new' WHEN 0 THEN 'update' WHEN 1 THEN 'delete' ELSE 'ok' END AS status
FROM contact WHERE uid IS NOT NULL
;
-- name: form_submission
SELECT event_id AS row_no, event_type AS subject, CAST(value AS STRING) AS amount, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1700000000 + event_id END AS ctime,
       CAST(event_id % 200 AS STRING) || '.' || CAST(user_id % 250 AS STRING) || '.' || CAST(event_id * 7 % 250 AS STRING) || '.' || CAST(event_id % 250 AS STRING) AS ip
FROM events
;
-- name: ip_range
SELECT (n_nationkey * 8) * CAST(16777216 AS BIGINT) + r_regionkey * CAST(3276800 AS BIGINT) AS ip_from,
       (n_nationkey * 8) * CAST(16777216 AS BIGINT) + r_regionkey * CAST(3276800 AS BIGINT) + n_nationkey * CAST(100000 AS BIGINT) AS ip_to, n_name AS country
FROM nation JOIN region ON n_regionkey = r_regionkey
;
-- name: cookie
SELECT DISTINCT 'k' || CAST(user_id AS STRING) || '-' || CAST(event_id % 3 AS STRING) AS id, 'u' || CAST(user_id AS STRING) AS uid
FROM events WHERE user_id % 3 <> 0
;
-- name: thread_message
SELECT c.owner_id, c.entity_id, c.sys_id, c.author_id, c.message, c.message_id, c.ctime,
       CASE WHEN c.sys_id % 5 = 0 THEN 'm' || CAST(f.first_id AS STRING) WHEN c.sys_id % 5 = 1 THEN 'gone' END AS thread_id
FROM channel c JOIN (SELECT owner_id, entity_id, min(sys_id) AS first_id FROM channel GROUP BY owner_id, entity_id) f
  ON f.owner_id = c.owner_id AND f.entity_id = c.entity_id
-- name: grant_rule
SELECT hub_id, '*' AS resource_id, uid AS entity_id, permission, 0 AS expiry_time, '' AS message FROM hub_member WHERE permission > 7
UNION ALL
SELECT 'h' || CAST(o_orderkey % (SELECT count(*) FROM supplier) AS STRING), 'o' || CAST(o_orderkey AS STRING), 'u' || CAST((o_custkey + 1) % 10 AS STRING), 3,
       CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1000000000 + o_orderkey END, 'shared o' || CAST(o_orderkey AS STRING) FROM orders WHERE o_orderkey % 10 = 0
UNION ALL
SELECT hub_id, 'root', uid, 1, 0, 'root' FROM hub_member WHERE permission = 3
UNION ALL
SELECT id, 'root', '*', 1, 0, 'guests' FROM hub WHERE area = 'public'
;
-- name: grant_request
SELECT DISTINCT 'h' || CAST(o_orderkey % (SELECT count(*) FROM supplier) AS STRING) AS hub_id, CASE WHEN l_partkey % 40 = 0 THEN 'nobody' WHEN l_partkey % 3 = 0 THEN 'u' || CAST((o_custkey + 1) % 10 AS STRING)
  ELSE 'u' || CAST(l_partkey % (SELECT count(*) FROM customer) AS STRING) END AS uid,
  'f' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' || CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING) AS node_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
;
-- name: hub_log
SELECT sys_id, 'h' || CAST(sys_id % (SELECT count(*) FROM supplier) AS STRING) AS hub_id, uid, action, category, notify_to,
  'u' || CAST(sys_id * 3 % (SELECT count(*) FROM customer) AS STRING) AS entity_id, log, ctime
FROM action_log
;
-- name: desk_node
SELECT uid AS owner_id, hub_id AS id, 'root' AS parent_id, 'hub' AS category, hub_id AS user_filename, CAST(0 AS BIGINT) AS filesize, sys_id % 3 AS rank FROM hub_member
UNION ALL
SELECT owner_id, id, '0', category, user_filename, filesize, sys_id % 3 FROM hub_media
;
-- name: owned_tag
WITH u AS (SELECT DISTINCT owner_id, tag_id FROM map_tag),
     n AS (SELECT DISTINCT u.owner_id AS owner_id, t.parent_tag_id AS tag_id FROM u JOIN tag t ON t.tag_id = u.tag_id),
     r AS (SELECT DISTINCT n.owner_id AS owner_id, t.parent_tag_id AS tag_id FROM n JOIN tag t ON t.tag_id = n.tag_id)
SELECT o.owner_id AS owner_id, t.tag_id AS tag_id, CASE WHEN o.owner_id LIKE '%7' THEN NULL ELSE t.parent_tag_id END AS parent_tag_id, t.name AS name, t.position AS position
FROM (SELECT * FROM u UNION ALL SELECT * FROM n UNION ALL SELECT * FROM r) o JOIN tag t ON t.tag_id = o.tag_id
