"""Contact files, member lists, forms, tables from a specification, event logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlor.functions import expr as X
from parlor.plans.skew import rank_in_groups

# Heading rules of contact files and value formats.
EMAIL_HEADING = r"(?i)^e[-]*mail"
PHONE_HEADING = r"(?i)^(phone|mobile)"
ADDRESS_HEADING = r"(?i)^(address|location)"
FIRST_HEADING = r"(?i)^(first|given) *name"
LAST_HEADING = r"(?i)^(last|family) *name"
MIDDLE_HEADING = r"(?i)^(additionnal|middle) *name"
TYPE_HEADING = r"(?i)^.+ type$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE = r"^\+?[0-9][0-9 .\-]{3,}$"


def read_contact_csv(spark: SparkSession, path: str) -> DataFrame:
    """A quoted cell may hold line breaks and doubled quotes; a file is then read by one task, so large imports come as several files."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_vcards(spark: SparkSession, path: str) -> DataFrame:
    """One row per card: ``text``."""
    return spark.read.option("lineSep", "END:VCARD").text(path).select(F.col("value").alias("text")).where(F.col("text").contains("BEGIN:VCARD"))


def _cells(df: DataFrame, keys: Sequence[str]) -> Column:
    cells = [F.struct(F.lit(c).alias("k"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns if c not in keys]
    return F.filter(F.array(*cells), lambda x: x["v"].isNotNull() & (x["v"] != "") & ~x["k"].rlike(TYPE_HEADING))


def _first_value(cells: Column, heading: str) -> Column:
    # a later heading of the same kind overrides an earlier one
    return F.try_element_at(F.filter(cells, lambda x: x["k"].rlike(heading)), F.lit(-1))["v"]


def _phone(v: Column) -> Column:
    """A leading plus splits off the area code; the separator set includes the plus, so empty leading parts go."""
    parts = F.split(v, r"[ -.:;_]+")
    parts = F.when(parts[0] == "", F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    plus = v.rlike(r"^ *\+")
    return F.struct(
        F.when(plus, F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " ")).otherwise(v).alias("phone"),
        F.when(plus, F.concat(F.lit("+"), parts[0])).otherwise(F.lit("")).alias("areacode"))


def _address(v: Column) -> Column:
    """Last part is the country, the one before the city, the rest the street."""
    x = F.split(v, ",")
    many = F.contains(v, F.lit(","))
    return F.struct(
        F.when(many, F.array_join(F.slice(x, 1, F.greatest(F.size(x) - 2, F.lit(0))), ",")).otherwise(v).alias("street"),
        F.when(many, F.try_element_at(x, F.lit(-2))).otherwise(F.lit("")).alias("city"),
        F.when(many, F.try_element_at(x, F.lit(-1))).otherwise(F.lit("")).alias("country"))


def normalise_csv(csv: DataFrame, keys: Sequence[str] = ("row_no", "owner_id")) -> DataFrame:
    """Wide rows with free headings to names and arrays of e-mails, phones and addresses.

    Everything happens inside the row (its width bounds the arrays), so there is no shuffle.
    """
    wide = csv.select(*keys, _cells(csv, keys).alias("cells"))
    cells = F.col("cells")
    mails = F.transform(F.filter(cells, lambda x: x["k"].rlike(EMAIL_HEADING) & x["v"].rlike(EMAIL)), lambda x: x["v"])
    phones = F.transform(F.filter(cells, lambda x: x["k"].rlike(PHONE_HEADING)), lambda x: _phone(x["v"]))
    places = F.transform(F.filter(cells, lambda x: x["k"].rlike(ADDRESS_HEADING)), lambda x: _address(x["v"]))
    return wide.select(
        *keys, _first_value(cells, FIRST_HEADING).alias("firstname"), _first_value(cells, LAST_HEADING).alias("lastname"),
        _first_value(cells, MIDDLE_HEADING).alias("surname"), mails.alias("emails"), phones.alias("phones"), places.alias("addresses"))


def normalise_vcards(cards: DataFrame, keys: Sequence[str] = ("row_no", "owner_id")) -> DataFrame:
    """Card text to the same shape: names from ``N`` or from the e-mail's local part."""
    text = F.regexp_replace(F.regexp_replace("text", r"\r\n", "\n"), r"\n[ \t]", "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")

    def values(name: str) -> Column:
        # after a quoted parameter block the value starts at the first free colon
        own = F.filter(F.col("lines"), lambda x: x.rlike(f"(?i)^{name}[;:]"))
        return F.transform(own, lambda x: F.regexp_extract(x, r'^[A-Za-z]+(?:;(?:"[^"]*"|[^":])*)?:(.*)$', 1))

    cut = cards.select(*keys, lines.alias("lines")).select(
        *keys, values("EMAIL").alias("emails"), values("TEL").alias("tel"), values("ADR").alias("adr"), F.try_element_at(values("N"), F.lit(1)).alias("n"))
    local = F.split(F.split(F.col("emails")[0], "@")[0], r"\.")
    n = F.split("n", ";")
    places = F.transform("adr", lambda a: F.struct(
        F.try_element_at(F.split(a, ";"), F.lit(3)).alias("street"),
        F.trim(F.concat_ws(" ", F.try_element_at(F.split(a, ";"), F.lit(4)), F.try_element_at(F.split(a, ";"), F.lit(5)))).alias("city"),
        F.try_element_at(F.split(a, ";"), F.lit(7)).alias("country")))
    phones = F.transform("tel", lambda p: F.struct(F.regexp_replace(p, "^tel:", "").alias("phone"), F.lit("").alias("areacode")))
    return cut.select(
        *keys, F.coalesce(F.try_element_at(n, F.lit(2)), local[0]).alias("firstname"),
        F.coalesce(F.try_element_at(n, F.lit(1)), F.coalesce(F.try_element_at(local, F.lit(2)), local[0])).alias("lastname"),
        F.lit(None).cast("string").alias("surname"), "emails", phones.alias("phones"), places.alias("addresses"))


def import_contacts(rows: DataFrame, user_dir: DataFrame, contact: DataFrame) -> DataFrame:
    """Normalised rows with ``entity`` and ``outcome``: loaded, noemail or alreadyincontact.

    An entity the owner already has, or that an earlier row of the file brings, is not loaded again.
    """
    people = user_dir.select(F.col("email").alias("mail"), F.col("id").alias("d_id"))
    named = rows.withColumn("mail", F.try_element_at("emails", F.lit(1))).join(people, "mail", "left").withColumn("entity", F.coalesce("d_id", "mail"))
    known = contact.select("owner_id", "entity").distinct().withColumn("known", F.lit(1))
    first = named.where("entity IS NOT NULL").groupBy("owner_id", "entity").agg(F.min("row_no").alias("first_no"))
    outcome = (
        F.when(F.col("entity").isNull(), F.lit("noemail"))
        .when((F.col("known") == 1) | (F.col("row_no") > F.col("first_no")), F.lit("alreadyincontact")).otherwise(F.lit("loaded")))
    return (
        named.join(known, ["owner_id", "entity"], "left").join(first, ["owner_id", "entity"], "left")
        .select("row_no", "owner_id", "entity", "firstname", "lastname", "surname", F.col("mail").alias("source"), "emails", "phones", "addresses", outcome.alias("outcome"))
        .withColumn("id", X.short_id("owner_id", "entity"))
    )


def imported_tables(imported: DataFrame) -> dict[str, DataFrame]:
    """Contact, e-mail, phone and address rows of the loaded file rows."""
    ok = imported.where("outcome = 'loaded'")
    head = ok.select("owner_id", "id", "entity", "firstname", "lastname", "surname", "source", F.lit("independant").alias("category"))

    def child(column: str, *fields: str) -> DataFrame:
        return ok.select("owner_id", F.col("id").alias("contact_id"), F.posexplode(column).alias("pos", "x")).select(
            "owner_id", "contact_id", "pos", *[F.col(f"x.{f}") for f in fields], X.flag(F.col("pos") == 0).alias("is_default"))

    kind = F.when(F.col("pos") == 0, F.lit("prof")).otherwise(F.lit("priv")).alias("category")
    mails = ok.select("owner_id", F.col("id").alias("contact_id"), F.posexplode("emails").alias("pos", "email")).select(
        "owner_id", "contact_id", "email", X.flag(F.col("pos") == 0).alias("is_default"), kind)
    phones = child("phones", "phone", "areacode").select("owner_id", "contact_id", "phone", "areacode", "is_default", kind)
    places = child("addresses", "street", "city", "country").select("owner_id", "contact_id", "street", "city", "country", "is_default", F.lit("priv").alias("category"))
    return {"contact": head, "email": mails, "phone": phones, "address": places}


def import_report(imported: DataFrame) -> DataFrame:
    return imported.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "loaded").alias("loaded"), F.count_if(F.col("outcome") == "noemail").alias("noemail"),
        F.count_if(F.col("outcome") == "alreadyincontact").alias("alreadyincontact"))


def _earlier(members: DataFrame, column: str, *scope: str) -> DataFrame:
    """``(index, prev, count)``: the row before with the same value (in its scope), and how many rows came before."""
    keys = [*scope, column]
    some = members.where((F.col(column) != "") & F.forall(F.array(*[F.col(c).isNotNull() for c in keys]), lambda x: x)).select(*keys, "index")
    ranked = rank_in_groups(some, keys, "index", "_r")
    before = ranked.select(*keys, (F.col("_r") + 1).alias("_r"), F.col("index").alias(f"{column}_prev"))
    return ranked.join(before, [*keys, "_r"]).select("index", f"{column}_prev", (F.col("_r") - 1).alias(f"{column}_earlier"))


def validate_members(members: DataFrame, user_dir: DataFrame) -> DataFrame:
    """``members(row_no, domain_id, firstname, lastname, email, mobile, areacode, ident)`` with all error codes of each row.

    An e-mail is taken or free everywhere, an ident in its domain: the same ident may be free in one and taken in another.

    Rows blank in all six fields are dropped; the ident is lower-cased; ``index`` is the file's own row number.
    A duplicate names the nearest earlier row with the same value, and ``ident_earlier``/``email_earlier`` count
    all of them: the chain leads to every earlier row without listing a quadratic number of pairs.
    """
    fields = ("firstname", "lastname", "email", "mobile", "areacode", "ident")
    clean = members.select(F.col("row_no").alias("index"), "domain_id", *[F.coalesce(F.lower(c) if c == "ident" else F.col(c), F.lit("")).alias(c) for c in fields])
    clean = clean.where(F.concat(*fields) != "")
    mails = user_dir.select("email").distinct().withColumn("mail_used", F.lit(1))
    idents = user_dir.select("domain_id", F.lower("username").alias("ident")).distinct().withColumn("ident_used", F.lit(1))
    seen = (
        clean.join(mails, "email", "left").join(idents, ["domain_id", "ident"], "left")
        .join(_earlier(clean, "ident", "domain_id"), "index", "left").join(_earlier(clean, "email"), "index", "left"))
    empty = {c: F.col(c) == "" for c in fields}

    def code(test: Column, text: str) -> Column:
        return F.when(test, F.lit(text))

    status = F.array_compact(F.array(
        code(empty["firstname"] & empty["lastname"], "EMPTY_NAMES"), code(empty["email"], "EMPTY_EMAIL"), code(empty["mobile"], "EMPTY_MOBLIE"),
        code(empty["areacode"], "EMPTY_AREACODE"), code(~empty["email"] & ~F.col("email").rlike(EMAIL), "INVALID_EMAIL_FORMAT"),
        code(~empty["mobile"] & ~F.col("mobile").rlike(PHONE), "INVALID_PHONE_FORMAT"), code(empty["ident"], "EMPTY_IDENT"),
        code(F.col("mail_used") == 1, "EMAIL_NOT_AVAILABLE"), code(F.col("ident_used") == 1, "IDENT_NOT_AVAILABLE"),
        F.concat(F.lit("IDENT_DUPLICATE ("), F.col("ident_prev").cast("string"), F.lit(")")),
        F.concat(F.lit("EMAIL_DUPLICATE ("), F.col("email_prev").cast("string"), F.lit(")"))))
    return seen.select(
        "index", "domain_id", *fields, status.alias("errorstatus"), F.coalesce("ident_earlier", F.lit(0)).alias("ident_earlier"),
        F.coalesce("email_earlier", F.lit(0)).alias("email_earlier")).withColumn("error", X.flag(F.size("errorstatus") > 0))


def batch_valid(validated: DataFrame) -> DataFrame:
    return validated.agg(F.coalesce(F.max("error"), F.lit(0)).alias("e"), F.count(F.lit(1)).alias("n_rows")).select(X.flag(F.col("e") == 0).alias("valid"), "n_rows")


def load_members(validated: DataFrame, organisation: str) -> tuple[DataFrame, DataFrame]:
    """New users, and their assignment to the organisation. A batch with an invalid row is refused whole: nothing is loaded.

    Every new member gets all members of the organisation as contacts.  The assignment is kept as one row per new
    member; ``assigned_contacts`` opens it for the users asked for.
    """
    if "domain_id" not in validated.columns:  # a batch of no domain
        validated = validated.withColumn("domain_id", F.lit(None).cast("int"))
    errors = validated.agg(F.coalesce(F.sum("error"), F.lit(0))).scalar()
    users = validated.where(errors == 0).select(
        X.short_id("domain_id", "ident", "email").alias("id"), "email", "firstname", "lastname", F.col("ident").alias("username"), "mobile", "areacode", "domain_id")
    return users, users.select(F.col("id").alias("uid"), F.lit(organisation).alias("org_id"), F.lit("new").alias("status"))


def assigned_contacts(assignments: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """Contact pairs of the ``wanted(uid)`` users only: their organisation's ``members(org_id, uid)``."""
    mine = assignments.join(wanted.select("uid").distinct(), "uid", "left_semi").select("org_id", "uid")
    return mine.join(members.select("org_id", F.col("uid").alias("owner_id")), "org_id").where("uid <> owner_id").select("uid", "owner_id")


# Types a table specification may name.
SPEC_TYPES = {"mediumtext": "string", "enum": "string", "int": "bigint", "integer": "bigint", "float": "double"}


def table_from_spec(spec: Sequence[Mapping[str, Any]], raw: DataFrame) -> DataFrame:
    """Typed table from ``[{name, type, value?, default?}]`` over text columns.

    A missing value takes the default (``null`` means none); ``is_valid`` is 0 where a value does not fit its type
    or its enum.  Other types are kept as text.
    """
    columns, bad = [], F.lit(False)
    for c in spec:
        kind = str(c["type"]).lower()
        target = SPEC_TYPES.get(kind, "string")
        given = F.nullif(F.col(c["name"]).cast("string"), F.lit("")) if c["name"] in raw.columns else F.lit(None).cast("string")
        default = c.get("default")
        default = None if default is None or str(default).lower() in ("", "null") else str(default)
        value = F.coalesce(given, F.lit(default)) if default is not None else given
        typed = value.try_cast(target)
        wrong = value.isNotNull() & typed.isNull()
        if kind == "enum":
            wrong = value.isNotNull() & ~value.isin(*c["value"])
        bad = bad | wrong
        columns.append(F.when(~wrong, typed).alias(c["name"]))
    return raw.select(*columns, X.flag(~bad).alias("is_valid"))


def duplicate_keys(table: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def ingest_forms(submissions: DataFrame, columns: Sequence[str], ip_range: DataFrame, now_epoch: int) -> DataFrame:
    """Submissions on the form's columns with ``ctime`` and the country of the address.

    The range look-up is an equi-join on the upper 16 bits of the address, then a comparison; a range is listed
    under each prefix it touches.
    """
    spread = ip_range.select("ip_from", "ip_to", "country", F.explode(F.sequence(F.shiftright("ip_from", 16), F.shiftright("ip_to", 16))).alias("prefix"))
    numbered = submissions.withColumn("ip_no", X.ip_number("ip")).withColumn("prefix", F.shiftright("ip_no", 16))
    found = (
        numbered.select("row_no", "ip_no", "prefix").join(spread, "prefix").where("ip_no BETWEEN ip_from AND ip_to")
        .groupBy("row_no").agg(F.min_by("country", "ip_from").alias("geoloc")))
    return numbered.join(found, "row_no", "left").select(
        "row_no", *[F.col(c) for c in columns], F.coalesce("ctime", F.lit(now_epoch).cast("bigint")).alias("ctime"), "geoloc")


def login_rows(calls: DataFrame) -> DataFrame:
    """``calls(owner_id, option, cookie_id, metadata, happened)``: one row per sign-in (``in``) or sign-out."""
    came = F.col("option") == "in"
    return calls.select(
        "owner_id", "cookie_id", "metadata", F.when(came, F.col("happened")).alias("intime"), F.when(~came, F.col("happened")).alias("outtime"),
        F.to_date(F.timestamp_seconds("happened")).cast("string").alias("day"))


def append_by_day(rows: DataFrame, path: str) -> None:
    """Append to Parquet with one folder per day; the sort keeps the number of open files small."""
    rows.repartitionByRange("day").sortWithinPartitions("day").write.mode("append").partitionBy("day").parquet(path)


def export_vcards(exported: DataFrame) -> DataFrame:
    """One card text per exported contact e-mail.

    Fixed line order, one ``TEL``/``ADR`` line per number and address, equal lines once, lines with a missing
    field left out.
    """
    def text(column: str | Column) -> Column:
        return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("null"))

    def each(column: str) -> Column:
        return F.coalesce(F.split(column, ":::"), F.array().cast("array<string>"))

    def tel(p: Column) -> Column:
        x = F.split(p, "---")
        return F.concat(F.lit("TEL;TYPE="), x[1], F.lit(",voice;VALUE=uri:tel:"), x[0], F.lit("\n"))

    def adr(a: Column) -> Column:
        kind, place = F.split(a, "---")[1], F.split(a, "---")[0]
        street, city, country = (text(F.get_json_object(place, f"$.{k}")) for k in ("street", "city", "country"))
        return F.concat(F.lit("ADR;TYPE="), kind, F.lit(';LABEL="'), street, F.lit("\n"), city, F.lit("\n"), country, F.lit('";;'),
                        street, F.lit(";"), city, F.lit(";"), country, F.lit("\n"))

    lines = F.flatten(F.array(
        F.array(F.lit("BEGIN:VCARD\n"), F.lit("VERSION:4.0\n"), F.concat(F.lit("N:"), text("firstname"), F.lit(";"), text("lastname"), F.lit(";"), text("surname"), F.lit(";.;\n")),
                F.concat(F.lit("FN:"), text("fullname"), F.lit("\n")), F.concat(F.lit("PHOTO;MEDIATYPE=image/gif:"), text("avatar"), F.lit("\n"))),
        F.transform(each("phone"), tel), F.transform(each("address"), adr),
        F.array(F.concat(F.lit("EMAIL:"), text("email"), F.lit("\n")), F.lit("END:VCARD\n"))))
    kept = F.filter(F.array_distinct(lines), lambda x: ~x.rlike("undefined|null"))
    return exported.select("owner_id", "email", "part", F.array_join(kept, "").alias("vcard"))


def write_vcards(cards: DataFrame, path: str) -> None:
    """One text folder per owner; a large owner spreads over several files."""
    cards.select("owner_id", "vcard").repartition("owner_id", F.pmod(F.xxhash64("vcard"), F.lit(32))).write.mode("overwrite").partitionBy("owner_id").text(path)
