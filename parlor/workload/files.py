"""Registered queries on loading, imports and exports, with their SQL twins."""

from pyspark.sql import functions as F

from parlor.operators import contacts as C
from parlor.session import written
from parlor.sources import imports as I
from parlor.sources import tables as S
from parlor.workload.fixtures import Tables

NOW = 1_800_000_000
SPEC = [
    {"name": "event_type", "type": "enum", "value": ["click", "view", "signup", "purchase"]}, {"name": "value", "type": "float"},
    {"name": "user_id", "type": "int", "default": "0"}, {"name": "note", "type": "mediumtext", "default": "none"}, {"name": "extra", "type": "int", "default": "null"},
]
RAW = """SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'abc' ELSE CAST(value AS STRING) END AS value, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id AS STRING) END AS user_id FROM events"""
CALLS = """SELECT owner_id, CASE WHEN intime IS NULL THEN 'out' ELSE 'in' END AS option, cookie_id, metadata, COALESCE(intime, outtime) AS happened FROM login_log"""


def _csv(t: Tables):
    return I.import_contacts(I.normalise_csv(t.contact_csv), t.user_dir, t.contact)


def _cards(t: Tables):
    return I.export_vcards(C.contact_export(t.contact, t.contact_email, t.contact_phone, t.contact_address, t.user_dir))


def _vcards(t: Tables):
    """Exported cards of one owner arrive at the owner with the next number."""
    cards = _cards(t).select(
        F.xxhash64("owner_id", "email").alias("row_no"), F.concat(F.lit("u"), (F.substring("owner_id", 2, 20).cast("bigint") + 1).cast("string")).alias("owner_id"), F.col("vcard").alias("text"))
    rows = written(I.normalise_vcards(cards))  # the import reads its rows twice, and each time would export the cards anew
    return I.import_contacts(rows, t.user_dir, t.contact)


def _valid(t: Tables):
    return I.validate_members(t.member_import, t.user_dir)


def _mended(t: Tables):
    """The import less its faulty rows, as a batch of its own."""
    good = _valid(t).where("error = 0").select(F.col("index").alias("row_no"))
    return I.validate_members(t.member_import.join(good, "row_no", "left_semi"), t.user_dir)


QUERIES = {
    "load_tables": lambda t: S.table_report({n: S.conform(getattr(t, n), n) for n in S.SCHEMAS}),
    "import_contacts_csv": lambda t: _csv(t).select("row_no", "owner_id", "entity", "firstname", "lastname", "outcome"),
    "import_csv_emails": lambda t: I.imported_tables(_csv(t))["email"].join(I.imported_tables(_csv(t))["contact"].select("owner_id", F.col("id").alias("contact_id"), "entity"), ["owner_id", "contact_id"]).drop("contact_id"),
    "import_csv_phones": lambda t: I.imported_tables(_csv(t))["phone"].drop("contact_id"),
    "import_csv_addresses": lambda t: I.imported_tables(_csv(t))["address"].drop("contact_id"),
    "import_report": lambda t: I.import_report(_csv(t)),
    "import_contacts_vcard": lambda t: _vcards(t).select("owner_id", "entity", "firstname", "lastname", "outcome"),
    "import_vcard_phones": lambda t: I.imported_tables(_vcards(t))["phone"],
    "validate_members": lambda t: _valid(t).withColumn("errorstatus", F.array_join("errorstatus", "|")),
    "validate_batch": lambda t: I.batch_valid(_valid(t)),
    "load_members": lambda t: I.load_members(_mended(t), "org1")[0].drop("id"),
    "load_members_refused": lambda t: I.load_members(_valid(t), "org1")[0].agg(F.count(F.lit(1)).alias("n_loaded")),
    "table_from_spec": lambda t: I.table_from_spec(SPEC, t.sql(RAW)),
    "duplicate_keys": lambda t: I.duplicate_keys(I.table_from_spec(SPEC, t.sql(RAW)), ["event_type", "user_id"]),
    "ingest_forms": lambda t: I.ingest_forms(t.form_submission, ["subject", "amount"], t.ip_range, NOW),
    "append_events": lambda t: I.login_rows(t.sql(CALLS)),
    "export_contacts_vcard": _cards,
}

_EMAIL = r"'^[^@\s]+@[^@\s]+\.[^@\s]+$'"
_PHONE = r"'^\+?[0-9][0-9 .\-]{3,}$'"
_CSV = f"""imp AS (SELECT c.*, CASE WHEN regexp_matches(email1, {_EMAIL}) THEN email1 WHEN regexp_matches(email2, {_EMAIL}) THEN email2 END AS mail FROM contact_csv c),
  ent AS (SELECT imp.*, COALESCE(d.id, mail) AS entity FROM imp LEFT JOIN user_dir d ON d.email = imp.mail),
  res AS (SELECT *, CASE WHEN entity IS NULL THEN 'noemail' WHEN EXISTS (SELECT 1 FROM contact k WHERE k.owner_id = ent.owner_id AND k.entity = ent.entity)
    OR EXISTS (SELECT 1 FROM ent e WHERE e.owner_id = ent.owner_id AND e.entity = ent.entity AND e.row_no < ent.row_no) THEN 'alreadyincontact' ELSE 'loaded' END AS outcome FROM ent)"""
_VALID = f"""mem AS (SELECT row_no AS index, domain_id, firstname, lastname, email, mobile, areacode, lower(ident) AS ident FROM member_import
    WHERE firstname || lastname || email || mobile || areacode || ident <> ''),
  lagged AS (SELECT *, CASE WHEN ident <> '' THEN lag(index) OVER (PARTITION BY domain_id, ident ORDER BY index) END AS ip, CASE WHEN email <> '' THEN lag(index) OVER (PARTITION BY email ORDER BY index) END AS ep,
    CASE WHEN ident <> '' THEN row_number() OVER (PARTITION BY domain_id, ident ORDER BY index) - 1 ELSE 0 END AS ident_earlier, CASE WHEN email <> '' THEN row_number() OVER (PARTITION BY email ORDER BY index) - 1 ELSE 0 END AS email_earlier FROM mem),
  val AS (SELECT index, domain_id, firstname, lastname, email, mobile, areacode, ident, ident_earlier, email_earlier, concat_ws('|',
    CASE WHEN firstname = '' AND lastname = '' THEN 'EMPTY_NAMES' END, CASE WHEN email = '' THEN 'EMPTY_EMAIL' END, CASE WHEN mobile = '' THEN 'EMPTY_MOBLIE' END, CASE WHEN areacode = '' THEN 'EMPTY_AREACODE' END,
    CASE WHEN email <> '' AND NOT regexp_matches(email, {_EMAIL}) THEN 'INVALID_EMAIL_FORMAT' END, CASE WHEN mobile <> '' AND NOT regexp_matches(mobile, {_PHONE}) THEN 'INVALID_PHONE_FORMAT' END,
    CASE WHEN ident = '' THEN 'EMPTY_IDENT' END, CASE WHEN EXISTS (SELECT 1 FROM user_dir d WHERE d.email = l.email) THEN 'EMAIL_NOT_AVAILABLE' END,
    CASE WHEN EXISTS (SELECT 1 FROM user_dir d WHERE d.username = l.ident AND d.domain_id = l.domain_id) THEN 'IDENT_NOT_AVAILABLE' END, 'IDENT_DUPLICATE (' || ip || ')', 'EMAIL_DUPLICATE (' || ep || ')') AS errorstatus FROM lagged l)"""
_SPEC = f"""spec AS (SELECT CASE WHEN event_type IN ('click', 'view', 'signup', 'purchase') THEN event_type END AS event_type, TRY_CAST(value AS DOUBLE) AS value,
  CASE WHEN user_id = '' THEN CAST(0 AS BIGINT) ELSE TRY_CAST(user_id AS BIGINT) END AS user_id, 'none' AS note, CAST(NULL AS BIGINT) AS extra,
  CASE WHEN event_type NOT IN ('click', 'view', 'signup', 'purchase') OR TRY_CAST(value AS DOUBLE) IS NULL THEN 0 ELSE 1 END AS is_valid FROM ({RAW}) r)"""
_EXPORT = """p AS (SELECT contact_id, string_agg(DISTINCT 'TEL;TYPE=' || CASE WHEN category = 'prof' THEN 'WORK' ELSE 'HOME' END || ',voice;VALUE=uri:tel:' || phone || chr(10), '' ORDER BY
    'TEL;TYPE=' || CASE WHEN category = 'prof' THEN 'WORK' ELSE 'HOME' END || ',voice;VALUE=uri:tel:' || phone || chr(10) DESC) AS tel FROM contact_phone GROUP BY contact_id),
  e AS (SELECT owner_id, email, arg_min(contact_id, sys_id) AS contact_id FROM contact_email GROUP BY owner_id, email)"""


def _count(table: str, enum: str, js: str) -> str:
    return f"SELECT '{table}' AS table_name, count(*) AS n_rows, count(*) FILTER ({enum}) AS n_bad_enum, count(*) FILTER ({js}) AS n_bad_json FROM {table}"


ORACLES = {
    "load_tables": " UNION ALL ".join([
        _count("channel", "false", "(attachment IS NOT NULL AND NOT json_valid(attachment)) OR (metadata IS NOT NULL AND NOT json_valid(metadata))"),
        _count("contact", "status NOT IN ('memory', 'sent', 'received', 'invitation', 'informed', 'accept', 'active')", "metadata IS NOT NULL AND NOT json_valid(metadata)"),
        _count("contact_address", "category NOT IN ('prof', 'priv')", "NOT json_valid(address)"),
        _count("block_history", "device NOT IN ('desktop', 'tablet', 'mobile') OR status NOT IN ('draft', 'history')", "false"),
        _count("action_log", "action NOT IN ('added', 'deleted', 'changed', 'left', 'removed', 'backup', 'connection') OR category NOT IN ('media', 'permission', 'member', 'admin', 'title') OR notify_to NOT IN ('all', 'member', 'admin')", "false"),
        _count("hub_media", "false", "metadata IS NOT NULL AND NOT json_valid(metadata)"),
        _count("language", "state NOT IN ('deleted', 'active', 'frozen', 'replaced')", "false"),
        _count("contact_email", "category NOT IN ('prof', 'priv')", "false"),
        _count("contact_phone", "category NOT IN ('prof', 'priv')", "false"),
        _count("team_channel", "false", "(attachment IS NOT NULL AND NOT json_valid(attachment)) OR (metadata IS NOT NULL AND NOT json_valid(metadata))"),
        _count("login_log", "false", "metadata IS NOT NULL AND NOT json_valid(metadata)"),
        *[_count(n, "false", "false") for n in ("read_channel", "team_read", "team_delete", "contact_block", "archive_entity", "tag", "map_tag", "permission")],
    ]),
    "import_contacts_csv": f"WITH {_CSV} SELECT row_no, owner_id, entity, firstname, lastname, outcome FROM res",
    "import_csv_emails": f"""WITH {_CSV} SELECT owner_id, email1 AS email, 1 AS is_default, 'prof' AS category, entity FROM res WHERE outcome = 'loaded' AND regexp_matches(email1, {_EMAIL})
      UNION ALL SELECT owner_id, email2, CASE WHEN regexp_matches(email1, {_EMAIL}) THEN 0 ELSE 1 END, CASE WHEN regexp_matches(email1, {_EMAIL}) THEN 'priv' ELSE 'prof' END, entity
      FROM res WHERE outcome = 'loaded' AND regexp_matches(email2, {_EMAIL})""",
    "import_csv_phones": f"WITH {_CSV} SELECT owner_id, '6 ' || row_no AS phone, '+33' AS areacode, 1 AS is_default, 'prof' AS category FROM res WHERE outcome = 'loaded'",
    "import_csv_addresses": f"WITH {_CSV} SELECT owner_id, '1 Main St' AS street, ' Town' AS city, ' Land' AS country, 1 AS is_default, 'priv' AS category FROM res WHERE outcome = 'loaded'",
    "import_report": f"WITH {_CSV} SELECT count(*) AS total, count(*) FILTER (outcome = 'loaded') AS loaded, count(*) FILTER (outcome = 'noemail') AS noemail, count(*) FILTER (outcome = 'alreadyincontact') AS alreadyincontact FROM res",
    "import_contacts_vcard": """WITH e AS (SELECT owner_id, email, arg_min(contact_id, sys_id) AS contact_id FROM contact_email GROUP BY owner_id, email),
      x AS (SELECT 'u' || (CAST(substr(e.owner_id, 2) AS BIGINT) + 1) AS owner_id, COALESCE(m.id, e.email) AS entity, COALESCE(c.firstname, m.firstname) AS f, COALESCE(c.lastname, m.lastname) AS l, c.surname, split_part(e.email, '@', 1) AS lp
        FROM e JOIN contact c ON c.owner_id = e.owner_id AND c.id = e.contact_id LEFT JOIN user_dir m ON m.email = e.email)
      SELECT owner_id, entity, CASE WHEN f IS NULL OR l IS NULL OR surname IS NULL THEN lp ELSE l END AS firstname, CASE WHEN f IS NULL OR l IS NULL OR surname IS NULL THEN lp ELSE f END AS lastname,
        CASE WHEN EXISTS (SELECT 1 FROM contact k WHERE k.owner_id = x.owner_id AND k.entity = x.entity) THEN 'alreadyincontact' ELSE 'loaded' END AS outcome FROM x""",
    "validate_members": f"WITH {_VALID} SELECT *, CASE WHEN errorstatus = '' THEN 0 ELSE 1 END AS error FROM val",
    "validate_batch": f"WITH {_VALID} SELECT CASE WHEN max(errorstatus) = '' THEN 1 ELSE 0 END AS valid, count(*) AS n_rows FROM val",
    "load_members": f"WITH {_VALID} SELECT email, firstname, lastname, ident AS username, mobile, areacode, domain_id FROM val WHERE errorstatus = ''",
    "load_members_refused": f"WITH {_VALID} SELECT CASE WHEN count(*) FILTER (errorstatus <> '') > 0 THEN 0 ELSE count(*) END AS n_loaded FROM val",
    "table_from_spec": f"WITH {_SPEC} SELECT * FROM spec",
    "duplicate_keys": f"WITH {_SPEC} SELECT event_type, user_id, count(*) AS n_rows FROM spec GROUP BY ALL HAVING count(*) > 1",
    "ingest_forms": f"""WITH f AS (SELECT *, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS n FROM form_submission)
      SELECT row_no, subject, amount, COALESCE(ctime, {NOW}) AS ctime, (SELECT arg_min(country, ip_from) FROM ip_range r WHERE f.n BETWEEN r.ip_from AND r.ip_to) AS geoloc FROM f""",
    "append_events": f"""SELECT owner_id, cookie_id, metadata, CASE WHEN option = 'in' THEN happened END AS intime, CASE WHEN option <> 'in' THEN happened END AS outtime,
      strftime(make_timestamp(happened * 1000000), '%Y-%m-%d') AS day FROM ({CALLS}) c""",
    "export_contacts_vcard": f"""WITH {_EXPORT}, x AS (SELECT e.owner_id, e.email, COALESCE(c.firstname, m.firstname) AS f, COALESCE(c.lastname, m.lastname) AS l, c.surname AS s, 'https://d' || m.domain_id || '/avatar/' || m.id AS av, p.tel
        FROM e JOIN contact c ON c.owner_id = e.owner_id AND c.id = e.contact_id LEFT JOIN user_dir m ON m.email = e.email LEFT JOIN p ON p.contact_id = c.id)
      SELECT owner_id, email, CAST(1 AS BIGINT) AS part, 'BEGIN:VCARD' || chr(10) || 'VERSION:4.0' || chr(10) || COALESCE('N:' || f || ';' || l || ';' || s || ';.;' || chr(10), '') || 'FN:' || COALESCE(f, '') || ' ' || COALESCE(l, '') || chr(10) ||
        COALESCE('PHOTO;MEDIATYPE=image/gif:' || av || chr(10), '') || COALESCE(tel, '') || 'EMAIL:' || email || chr(10) || 'END:VCARD' || chr(10) AS vcard FROM x""",
}
