"""Contact book of the SQL twins: common table expressions over contacts, their e-mails, the directory and the blocks.

``card`` has one row per contact with what is shown of it; ``barred_me`` the contacts whose other side blocks the owner, by the way the other side is found.
"""

BOOK = """mail AS (SELECT owner_id, contact_id, email FROM contact_email WHERE is_default = 1),
bars AS (SELECT owner_id AS blocker, entity AS target FROM contact_block UNION SELECT owner_id, uid FROM contact_block),
names AS (SELECT owner_id, owner_id AS target FROM contact UNION SELECT id, email FROM user_dir),
ways AS (SELECT owner_id, id, 'entity' AS way, entity AS blocker FROM contact UNION ALL SELECT owner_id, id, 'uid', uid FROM contact
  UNION ALL SELECT mail.owner_id, contact_id, 'mail', user_dir.id FROM mail JOIN user_dir USING (email)),
barred_me AS (SELECT DISTINCT owner_id, id, way FROM ways JOIN names USING (owner_id) JOIN bars USING (blocker, target)),
flags AS (SELECT owner_id, id, CAST(max(m) AS INTEGER) AS by_me, CAST(max(h) FILTER (way <> 'uid') AS INTEGER) AS by_them, CAST(max(h) FILTER (way <> 'mail') AS INTEGER) AS by_user, CAST(max(a) AS INTEGER) AS filed
  FROM (SELECT owner_id, id, '' AS way, 0 AS m, 0 AS h, 0 AS a FROM contact UNION ALL SELECT owner_id, contact_id, '', 1, 0, 0 FROM contact_block
    UNION ALL SELECT owner_id, id, way, 0, 1, 0 FROM barred_me UNION ALL SELECT owner_id, entity_id, '', 0, 0, 1 FROM archive_entity) GROUP BY owner_id, id),
card AS (SELECT k.*, mail.email AS own_mail, person.id AS person_id, person.email AS person_mail, account.id AS account_id, account.email AS account_mail, account.connected, account.username, account.domain_id,
  concat(k.firstname, ' ', k.lastname) AS whole_name, flags.by_me, flags.by_them, flags.by_user, flags.filed,
  CASE WHEN k.surname IS NULL AND k.firstname IS NULL AND k.lastname IS NULL THEN ifnull(mail.email, person.email) WHEN k.surname IS NULL THEN concat(k.firstname, ' ', k.lastname) ELSE k.surname END AS shown
  FROM contact k JOIN flags USING (owner_id, id) LEFT JOIN mail ON (mail.owner_id, mail.contact_id) = (k.owner_id, k.id)
  LEFT JOIN user_dir person ON person.id = k.entity LEFT JOIN user_dir account ON account.id = k.uid)"""
