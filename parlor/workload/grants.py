"""Registered queries on tag trees, grants, rooms and usage, with their SQL twins."""

from pyspark.sql import functions as F

from parlor.functions import expr as X
from parlor.operators import grants as G
from parlor.operators import rooms as R
from parlor.operators import trees
from parlor.workload.fixtures import Tables

NOW = 1_000_005_000
PROPOSED = """SELECT 'r' || CAST(n_regionkey AS STRING) AS tag_id, 'n' || CAST(n_nationkey AS STRING) AS parent_tag_id FROM nation
  UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST((n_regionkey + 1) % 5 AS STRING) FROM nation"""
REMOVED = "SELECT 'n' || CAST(n_nationkey AS STRING) AS tag_id FROM nation WHERE n_nationkey % 4 = 1"


def _effective(t: Tables):
    return G.effective_grant(t.grant_request, t.media, t.grant_rule)


QUERIES = {
    "tag_closure": lambda t: trees.tag_closure(t.tag),
    "tag_entities": lambda t: trees.tag_entities(trees.tag_closure(t.tag), t.map_tag),
    "tag_cycle_check": lambda t: trees.tag_cycle_check(trees.tag_closure(t.tag), t.sql(PROPOSED)),
    "tag_remove": lambda t: trees.tag_remove(t.tag, t.map_tag, t.sql(REMOVED))[0],
    "tag_remove_mappings": lambda t: trees.tag_remove(t.tag, t.map_tag, t.sql(REMOVED))[1],
    "nearest_grant": lambda t: G.nearest_grant(t.media, t.grant_rule),
    "effective_grant": _effective,
    "media_ttl": lambda t: G.media_ttl(_effective(t), NOW),
    "grants_from_hours": lambda t: t.orders.select(
        F.concat(F.lit("o"), "o_orderkey").alias("resource_id"), G.expiry_from_hours(F.col("o_orderkey") % 5, NOW).alias("expiry_time")),
    "has_permission": lambda t: t.permission.where(X.has_bit("permission", X.ADMIN_BIT)).select(
        "resource_id", "entity_id", X.flag(F.col("permission") == X.OWNER_MASK).alias("is_owner")),
    "orphan_rooms": lambda t: G.orphan_rooms(
        t.hub.select(F.col("id").alias("hub_id")), t.hub_member.withColumn("resource_id", F.lit("*"))),
    "hubs_of_user": lambda t: R.hubs_of_user(t.hub_member, t.hub),
    "hub_directory": lambda t: R.hub_directory(t.desk_node, t.hub, t.disk_usage, 2, 10),
    "hub_access": lambda t: R.hub_access(t.hub_member, t.user_dir, "bu", "u7"),
    "privilege": lambda t: R.privilege(
        t.sql("SELECT 'h' || CAST(l_suppkey AS STRING) AS hub_id, CASE WHEN l_partkey % 30 = 0 THEN 'nobody' ELSE 'u' || CAST(l_partkey AS STRING) END AS uid FROM lineitem"),
        t.hub_member, t.hub),
    "data_usage": lambda t: R.data_usage(t.media, t.hub, t.disk_usage),
    "disk_adjust": lambda t: R.disk_adjust(t.disk_usage, t.hub_media.where("sys_id % 7 = 0")),
}

_CLOSURE = """clo AS (SELECT tag_id AS ancestor, tag_id AS descendant, 0 AS depth FROM tag
  UNION ALL SELECT clo.ancestor, tag.tag_id, clo.depth + 1 FROM clo JOIN tag ON tag.parent_tag_id = clo.descendant)"""
_UP = """up AS (SELECT hub_id, id, id AS anc, 0 AS d, parent_id AS nxt FROM media UNION ALL SELECT up.hub_id, up.id, m.id, d + 1, m.parent_id FROM up JOIN media m ON m.id = up.nxt AND m.hub_id = up.hub_id)"""
_EFF = f"""{_UP}, req AS (SELECT hub_id, uid, node_id, CASE WHEN uid IN ('nobody', 'ffffffffffffffff') THEN '*' ELSE uid END AS who FROM grant_request),
  cand AS (SELECT r.hub_id, r.uid, r.node_id, g.permission, g.expiry_time, g.message, CASE WHEN u.d = 0 THEN 0 ELSE 1 + u.d END AS pri FROM req r JOIN up u ON u.id = r.node_id AND u.hub_id = r.hub_id
      JOIN grant_rule g ON g.resource_id = u.anc AND g.entity_id = r.who AND g.hub_id = r.hub_id
    UNION ALL SELECT r.hub_id, r.uid, r.node_id, g.permission, g.expiry_time, g.message, 1 FROM req r JOIN grant_rule g ON g.resource_id = '*' AND g.entity_id = r.who AND g.hub_id = r.hub_id),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hub_id, uid, node_id ORDER BY pri, permission DESC, expiry_time DESC) AS rn FROM cand) WHERE rn = 1),
  eff AS (SELECT r.hub_id, r.uid, r.node_id, CAST(COALESCE(b.expiry_time, 0) AS BIGINT) AS expiry_time, COALESCE(b.message, '') AS message, COALESCE(b.permission, 0) AS permission
    FROM req r LEFT JOIN best b ON b.hub_id = r.hub_id AND b.uid = r.uid AND b.node_id = r.node_id)"""

ORACLES = {
    "tag_closure": f"WITH RECURSIVE {_CLOSURE} SELECT * FROM clo",
    "tag_entities": f"WITH RECURSIVE {_CLOSURE} SELECT DISTINCT clo.ancestor AS tag_id, m.owner_id, m.id FROM clo JOIN map_tag m ON m.tag_id = clo.descendant",
    "tag_cycle_check": f"""WITH RECURSIVE {_CLOSURE} SELECT p.tag_id, p.parent_tag_id,
      CASE WHEN EXISTS (SELECT 1 FROM clo WHERE clo.ancestor = p.tag_id AND clo.descendant = p.parent_tag_id) THEN 1 ELSE 0 END AS is_cycle FROM ({PROPOSED}) p""",
    "tag_remove": f"WITH RECURSIVE {_CLOSURE} SELECT * FROM tag WHERE tag_id NOT IN (SELECT descendant FROM clo WHERE ancestor IN ({REMOVED}))",
    "tag_remove_mappings": f"WITH RECURSIVE {_CLOSURE} SELECT * FROM map_tag WHERE tag_id NOT IN (SELECT descendant FROM clo WHERE ancestor IN ({REMOVED}))",
    "nearest_grant": f"""WITH RECURSIVE {_UP} SELECT m.hub_id, m.id, n.anc AS resource_id FROM media m LEFT JOIN (SELECT hub_id, id, arg_min(anc, d) AS anc FROM up
      WHERE (hub_id, anc) IN (SELECT (hub_id, resource_id) FROM grant_rule) GROUP BY hub_id, id) n ON n.id = m.id AND n.hub_id = m.hub_id""",
    "effective_grant": f"WITH RECURSIVE {_EFF} SELECT * FROM eff",
    "media_ttl": f"WITH RECURSIVE {_EFF} SELECT hub_id, uid, node_id, CASE WHEN expiry_time = 0 THEN 0 ELSE expiry_time - {NOW} END AS ttl FROM eff",
    "grants_from_hours": f"SELECT 'o' || o_orderkey AS resource_id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE {NOW} + 3600 * (o_orderkey % 5) END AS expiry_time FROM orders",
    "has_permission": "SELECT resource_id, entity_id, CASE WHEN permission = 63 THEN 1 ELSE 0 END AS is_owner FROM permission WHERE permission & 16 > 0",
    "orphan_rooms": "SELECT id AS hub_id FROM hub WHERE id NOT IN (SELECT hub_id FROM hub_member WHERE permission = 63)",
    "hubs_of_user": "SELECT m.uid, h.id, h.name, h.owner_id AS hub_owner_id, m.permission AS privilege, h.area, h.serial FROM hub_member m JOIN hub h ON h.id = m.hub_id WHERE h.area <> 'dmz'",
    "hub_directory": """SELECT owner_id, nid, pid, hub_id, filename, filesize, area, rank FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY rank DESC, filename DESC, nid) AS rn FROM (
      SELECT n.owner_id, n.id AS nid, n.parent_id AS pid, CASE WHEN category = 'hub' THEN n.id ELSE n.owner_id END AS hub_id,
        CASE WHEN category = 'hub' THEN (SELECT name FROM hub h WHERE h.id = n.id) ELSE user_filename END AS filename,
        CASE WHEN category = 'hub' THEN (SELECT size FROM disk_usage d WHERE d.hub_id = n.id) ELSE filesize END AS filesize,
        CASE WHEN category = 'hub' THEN (SELECT area FROM hub h WHERE h.id = n.id) ELSE 'personal' END AS area, rank FROM desk_node n)) WHERE rn BETWEEN 11 AND 20""",
    "hub_access": """SELECT m.hub_id, m.uid, d.firstname, d.lastname, d.email, m.permission AS privilege, CASE WHEN m.permission & 16 > 0 THEN 1 ELSE 0 END AS is_admin,
      CASE WHEN m.permission = 63 THEN 1 ELSE 0 END AS is_owner FROM hub_member m JOIN user_dir d ON d.id = m.uid
      WHERE m.uid <> 'u7' AND (lower(d.firstname) LIKE 'bu%' OR lower(d.lastname) LIKE 'bu%' OR lower(d.email) LIKE 'bu%')""",
    "privilege": """WITH q AS (SELECT DISTINCT 'h' || CAST(l_suppkey AS STRING) AS hub_id, CASE WHEN l_partkey % 30 = 0 THEN 'nobody' ELSE 'u' || CAST(l_partkey AS STRING) END AS uid FROM lineitem)
      SELECT q.hub_id, q.uid, COALESCE(m.permission, CASE WHEN h.area = 'public' THEN 1 WHEN q.uid = 'nobody' THEN -1 ELSE 0 END) AS privilege
      FROM q JOIN hub h ON h.id = q.hub_id LEFT JOIN hub_member m ON m.hub_id = q.hub_id AND m.uid = q.uid""",
    "data_usage": """SELECT COALESCE(p.owner_id, h.owner_id) AS owner_id, CAST(COALESCE(p.s, 0) AS BIGINT) AS personal, CAST(COALESCE(h.s, 0) AS BIGINT) AS hub
      FROM (SELECT owner_id, sum(filesize) AS s FROM media GROUP BY owner_id) p
      FULL JOIN (SELECT h.owner_id, sum(u.size) AS s FROM hub h JOIN disk_usage u ON u.hub_id = h.id GROUP BY h.owner_id) h ON h.owner_id = p.owner_id""",
    "disk_adjust": """SELECT u.hub_id, CAST(u.size - COALESCE((SELECT sum(filesize) FROM hub_media m WHERE m.hub_id = u.hub_id AND m.sys_id % 7 = 0), 0) AS BIGINT) AS size FROM disk_usage u""",
}
