"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str

# Permission bits and masks.
ADMIN_BIT = 16
OWNER_MASK = 63
ATTACHMENT_MASK = 15

PREVIEW = 100


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def display_name(surname: Col, first: Col, last: Col, own_mail: Col, directory_mail: Col) -> Column:
    """Surname; else an e-mail when both names are missing; else "first last" with NULL as ''."""
    return F.coalesce(
        _c(surname),
        F.when(F.coalesce(_c(first), _c(last)).isNull(), F.coalesce(_c(own_mail), _c(directory_mail)))
        .otherwise(full_name(first, last)),
    )


def full_name(first: Col, last: Col) -> Column:
    return F.concat(F.coalesce(_c(first), F.lit("")), F.lit(" "), F.coalesce(_c(last), F.lit("")))


def no_filter(key: str | None) -> bool:
    """An empty key and '0' mean "no filter"."""
    return key is None or key in ("", "0")


def starts_with(column: Col, key: str) -> Column:
    """Prefix test without regard to case and accents; the key is trimmed."""
    return F.startswith(F.collate(_c(column), "UNICODE_CI_AI"), F.collate(F.lit(key.strip()), "UNICODE_CI_AI"))


def any_starts_with(columns: Iterable[Col], key: str | None) -> Column:
    if no_filter(key):
        return F.lit(True)
    test = F.lit(False)
    for column in columns:
        test = test | F.coalesce(starts_with(column, key), F.lit(False))
    return test


def holds(column: Col, part: str) -> Column:
    """Substring test without regard to case."""
    return F.contains(F.lower(_c(column)), F.lit(part.lower()))


def has_bit(permission: Col, bit: int) -> Column:
    return _c(permission).bitwiseAND(F.lit(bit)) > 0


def flag(test: Column) -> Column:
    """0/1 as the result sets carry it; NULL counts as 0."""
    return F.when(test, F.lit(1)).otherwise(F.lit(0))


def message_type(metadata: Col) -> Column:
    return F.coalesce(F.get_json_object(_c(metadata), "$.message_type"), F.lit("chat"))


def seen_map(metadata: Col) -> Column:
    return F.from_json(F.get_json_object(_c(metadata), "$._seen_"), "map<string,bigint>")


def is_new(metadata: Col, owner: Col, uid: Col, sys_id: Col | None = None, seen_upto: Col | None = None) -> Column:
    """A file is new for a user who does not own it and is not in its ``_seen_`` map.

    Missing, invalid or empty metadata, or metadata without the map, is never new; nor is a file up to the user's ``seen_upto``, if given.
    """
    seen = seen_map(metadata)
    beyond = F.lit(True) if seen_upto is None else F.coalesce(_c(sys_id) > _c(seen_upto), F.lit(True))
    return flag(beyond & F.try_parse_json(_c(metadata)).isNotNull() & seen.isNotNull()
                & ~F.map_contains_key(seen, _c(uid)) & (_c(owner) != _c(uid)))


def is_notified(metadata: Col, uid: Col) -> Column:
    """``acknowledge`` exists and does not name the user."""
    named = F.from_json(F.get_json_object(_c(metadata), "$.acknowledge"), "array<string>")
    return flag(named.isNotNull() & ~F.array_contains(named, _c(uid)))


def clean_path(path: Col) -> Column:
    """Runs of slashes become one, and everything between the first ``<`` and the last ``>`` goes."""
    return F.regexp_replace(F.regexp_replace(_c(path), "/+", "/"), "<.*>", "")


def is_visible(path: Col, category: Col) -> Column:
    return ~_c(path).rlike("^/__(chat|trash)__") & (_c(category) != "root")


def in_calendar(epoch: Col, month: int = 0, year: int = 0, start: int = 0, end: int = 0) -> Column:
    """Optional bounds on epoch seconds; 0 leaves a bound out.

    A year alone is turned into epoch bounds, so that a scan can skip row groups.
    """
    c, test = _c(epoch), F.lit(True)
    if year:
        test = test & (c >= _midnight(year)) & (c < _midnight(year + 1))
    if month:
        test = test & (F.month(F.timestamp_seconds(c)) == month)
    if start:
        test = test & (c >= start)
    if end:
        test = test & (c <= end)
    return test


def _midnight(year: int) -> int:
    import calendar

    return calendar.timegm((year, 1, 1, 0, 0, 0))


def short_id(*parts: Col) -> Column:
    """Repeatable 16-character id from a natural key, so that a rerun makes the same rows."""
    return F.substring(F.sha2(F.concat_ws("|", *[_c(p) for p in parts]), 256), 1, 16)


def ip_number(ip: Col) -> Column:
    part = F.split(_c(ip), r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.try_element_at(part, F.lit(i + 1)).try_cast("bigint")
    return number


def page_of(rank: Col, rows: int = 45) -> Column:
    return F.floor((_c(rank) - 1) / rows) + 1
